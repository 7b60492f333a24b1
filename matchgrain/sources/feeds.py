"""Feeds held as JSON text, one payload a row: scoreboards and news as typed rows for the sinks of ``merge``.

Payloads are parsed by a fixed schema, so unknown fields are skipped; text that is no JSON object gives error rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEAM = "struct<id:string, abbreviation:string, displayName:string, name:string>"
COMPETITOR = f"struct<homeAway:string, score:string, winner:boolean, team:{TEAM}>"
VENUE = "struct<id:string, fullName:string, shortName:string, address:struct<city:string, state:string, country:string>, indoor:boolean>"
EVENT = (
    "id string, uid string, date string, name string, shortName string, season struct<year:int, type:int, slug:string>, week struct<number:int>, "
    "status struct<displayClock:string, period:int, type:struct<state:string, completed:boolean, detail:string>>, "
    f"competitions array<struct<attendance:long, venue:{VENUE}, competitors:array<{COMPETITOR}>>>"
)
ARTICLE = "dataSourceIdentifier string, id string, headline string, title string, description string, abstract string, story string, published string, lastModified string, type string"
#: Status by state.
STATES = {"pre": "scheduled", "in": "in_progress", "post": "final"}


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def instant(column: str) -> Column:
    """An ISO date with ``Z`` or an offset as UTC time; null where it is none."""
    whole = F.regexp_replace(F.replace(F.col(column), F.lit("Z"), F.lit("+00:00")), r"(T\d\d:\d\d)(?=[+-]|$)", "$1:00")
    return whole.try_cast("timestamp")


def status_of(state: Column, completed: Column) -> Column:
    known = F.lit("scheduled")
    for name, status in STATES.items():
        known = F.when(state == name, status).otherwise(known)
    return F.when(completed, "final").otherwise(known)


def parsed(feed: DataFrame, schema: str, payload: str) -> DataFrame:
    """The columns of the feed beside the fields of its payload, all null where it is no JSON object."""
    return feed.withColumn("_p", F.from_json(payload, schema)).select(*feed.columns, "_p.*")


def scoreboard(feed: DataFrame, payload: str = "payload", at: str = "ingested") -> DataFrame:
    """One event a row with its venue and competitors; ``error`` where it has no id.

    ``feed`` has the payload and the time of ingestion, which stands in for a date that cannot be read. The year of
    the season is the date's and its type 2 where they are missing.
    """
    e = parsed(feed.select(payload, at), EVENT, payload)
    first = F.get("competitions", F.lit(0))
    date = F.coalesce(instant("date"), F.col(at))
    kind = F.col("status.type")
    done = F.coalesce(kind["completed"], F.lit(False))
    return e.select(
        text_of("id").alias("event_id"), text_of("uid").alias("uid"), date.alias("date"), text_of("name").alias("name"), text_of("shortName").alias("short_name"),
        F.coalesce("season.year", F.year(date)).alias("season_year"), F.coalesce("season.type", F.lit(2)).alias("season_type"), text_of("season.slug").alias("season_slug"),
        F.col("week.number").alias("week"), status_of(kind["state"], done).alias("status"), F.coalesce(kind["detail"], F.when(done, "Final").otherwise("")).alias("status_detail"),
        text_of("status.displayClock").alias("clock"), F.col("status.period").alias("period"), first["attendance"].alias("attendance"),
        first["venue"].alias("venue"), first["competitors"].alias("competitors"), (text_of("id") == "").alias("error"), F.col(at).alias("ingested"),
    )


def venues(events: DataFrame) -> DataFrame:
    """One row for each venue that has an id, the last one ingested; the country is USA where it is missing."""
    v = events.where(text_of("venue.id") != "").select(
        F.col("venue.id").alias("venue_id"), F.coalesce("venue.fullName", "venue.shortName", F.lit("")).alias("name"), text_of("venue.address.city").alias("city"),
        text_of("venue.address.state").alias("state"), F.coalesce("venue.address.country", F.lit("USA")).alias("country"), F.coalesce("venue.indoor", F.lit(True)).alias("indoor"), "ingested", "event_id",
    )
    best = F.max_by(F.struct("name", "city", "state", "country", "indoor"), F.struct("ingested", "event_id")).alias("v")
    return v.groupBy("venue_id").agg(best).select("venue_id", "v.*")


def competitors(events: DataFrame) -> DataFrame:
    """One row for each side with a team id. A side that is not named is away; with a name of another kind the second is home."""
    c = events.where("not error").select("event_id", F.posexplode("competitors").alias("ord", "c")).where(text_of("c.team.id") != "")
    side = F.coalesce("c.homeAway", F.lit("away"))
    side = F.when(side.isin("home", "away"), side).when(F.col("ord") == 1, "home").otherwise("away")
    team = F.col("c.team")
    return c.select(
        "event_id", team["id"].alias("team_id"), side.alias("home_away"), text_of("c.score").alias("score"), F.col("c.winner").alias("winner"), "ord",
        F.coalesce(team["abbreviation"], F.lit("")).alias("abbreviation"), F.coalesce(team["displayName"], team["name"], F.lit("")).alias("display_name"),
    )


def missing_teams(sides: DataFrame, teams: DataFrame) -> DataFrame:
    """The teams of a batch that are not known yet, each once, as its first side (by event) names it."""
    new = sides.join(teams.select("team_id"), "team_id", "left_anti")
    return new.groupBy("team_id").agg(F.min_by(F.struct("abbreviation", "display_name"), F.struct("event_id", "ord")).alias("t")).select("team_id", "t.*")


def articles(feed: DataFrame, payload: str = "payload") -> DataFrame:
    """One article a row, its id from the data source or else its own; the headline or else the title, cut at 500 characters; ``error`` where either is missing."""
    a = parsed(feed.select(payload), ARTICLE, payload)
    key = F.coalesce(F.nullif("dataSourceIdentifier", F.lit("")), F.nullif("id", F.lit("")))
    head = F.coalesce(F.nullif("headline", F.lit("")), "title", F.lit(""))
    return a.select(
        key.alias("article_id"), F.substring(head, 1, 500).alias("headline"), F.coalesce(F.nullif("description", F.lit("")), "abstract", F.lit("")).alias("description"), text_of("story").alias("story"),
        instant("published").alias("published"), instant("lastModified").alias("last_modified"), text_of("type").alias("type"), (key.isNull() | (head == "")).alias("error"),
    )
