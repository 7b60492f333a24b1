"""Feeds of reports held as JSON text: teams, injuries, transactions, season statistics, rosters and standings.

A feed has the columns league, payload and ingested. Payloads are parsed by fixed schemas, so unknown fields are
skipped; text that is no JSON object, or has no items, gives no rows. Rows that lack what they need have ``error``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrain.sources.feeds import parsed, text_of

TEAM = "id string, uid string, slug string, abbreviation string, displayName string, shortDisplayName string, name string, nickname string, location string, color string, alternateColor string, isActive boolean, isAllStar boolean"
TEAMS = "sports array<struct<leagues:array<struct<teams:array<string>>>>>"
INJURY = "struct<athlete:struct<id:string, displayName:string, fullName:string, position:struct<abbreviation:string>>, team:struct<id:string>, status:string, description:string, shortComment:string, type:string>"
TRANSACTION = "struct<id:string, date:string, description:string, text:string, type:string, athlete:struct<id:string, displayName:string>, team:struct<id:string>>"
SEASON = "season struct<year:int>, stats string, splits string"
PLAYER = "struct<id:string, firstName:struct<default:string>, lastName:struct<default:string>, sweaterNumber:string, positionCode:string, headshot:string>"
STANDING = "struct<teamAbbrev:string, gamesPlayed:int, wins:int, losses:int, otLosses:int, points:int, pointPctg:double, divisionName:string, conferenceName:string>"
#: Injury statuses by the lower-case text of the report; any other is 'other'.
STATUSES = {"out": "out", "doubtful": "doubtful", "questionable": "questionable", "injured reserve": "ir", "ir": "ir", "day-to-day": "day_to_day", "probable": "day_to_day"}
#: The statistics that count appearances, the first usable one first.
APPEARANCES = ("appearances", "gamesPlayed", "games_played", "starts")


def first_text(*columns: str) -> Column:
    """The first of these that is neither null nor empty, else an empty text."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns), F.lit(""))


def items(feed: DataFrame, kind: str, *fields: str) -> DataFrame:
    """One item a row as ``i``, from the first of the fields that holds any."""
    rows = parsed(feed, ", ".join(f"{f} array<{kind}>" for f in fields), "payload")
    some = F.coalesce(*(F.when(F.size(f) > 0, F.col(f)) for f in fields))
    return rows.select("league", "ingested", F.posexplode(some).alias("ord", "i"))


def teams(feed: DataFrame) -> DataFrame:
    """Teams of the first sport and league of each payload, boxed in a field ``team`` or bare; ``error`` without an id."""
    of = parsed(feed, TEAMS, "payload")
    each = of.select("league", "ingested", F.explode(F.get(F.get("sports", F.lit(0))["leagues"], F.lit(0))["teams"]).alias("raw"))
    t = each.withColumn("t", F.from_json(F.coalesce(F.get_json_object("raw", "$.team"), "raw"), TEAM)).select("league", "ingested", "t.*", "raw")
    names = {"uid": "uid", "slug": "slug", "abbreviation": "abbreviation", "displayName": "display_name", "shortDisplayName": "short_display_name", "name": "name", "nickname": "nickname", "location": "location", "color": "color", "alternateColor": "alternate_color"}
    flag = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    return t.select(
        "league", text_of("id").alias("team_id"), *(text_of(c).alias(n) for c, n in names.items()), flag("isActive", True).alias("is_active"), flag("isAllStar", False).alias("is_all_star"),
        "raw", (text_of("id") == "").alias("error"), "ingested",
    )


def injury_status(text: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in STATUSES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.trim(F.lower(text))), F.lit("other"))


def injuries(feed: DataFrame, teams: DataFrame) -> DataFrame:
    """The injuries of each league, for ``replace_snapshot``; ``error`` without an athlete's name, no team where it is unknown.

    ``teams`` has league and team_id, each pair once.
    """
    i = items(feed, INJURY, "items", "injuries")
    rows = i.select(
        "league", first_text("i.athlete.id").alias("athlete_id"), first_text("i.athlete.displayName", "i.athlete.fullName").alias("athlete_name"), first_text("i.athlete.position.abbreviation").alias("position"),
        injury_status(first_text("i.status")).alias("status"), first_text("i.status").alias("status_display"), first_text("i.description", "i.shortComment").alias("description"), first_text("i.type").alias("injury_type"),
        F.nullif("i.team.id", F.lit("")).alias("_team"), "ingested",
    ).withColumn("error", F.col("athlete_name") == "")
    return with_team(rows, teams)


def with_team(rows: DataFrame, teams: DataFrame) -> DataFrame:
    """The rows with the id of their team if it is known in their league, else null."""
    known = teams.select("league", F.col("team_id").alias("_team"), F.col("team_id"))
    return rows.join(known, ["league", "_team"], "left").drop("_team")


def transactions(feed: DataFrame, teams: DataFrame) -> DataFrame:
    """Transactions, their date from the first ten characters; ``error`` without a description.

    Those with an id are for ``upsert`` by league and id; without one (``transaction_id`` null) each is a row of its own.
    """
    i = items(feed, TRANSACTION, "items", "transactions")
    rows = i.select(
        "league", F.nullif("i.id", F.lit("")).alias("transaction_id"), F.substring("i.date", 1, 10).try_cast("date").alias("date"), first_text("i.description", "i.text").alias("description"), first_text("i.type").alias("type"),
        first_text("i.athlete.id").alias("athlete_id"), first_text("i.athlete.displayName").alias("athlete_name"), F.nullif("i.team.id", F.lit("")).alias("_team"), "ord", "ingested",
    ).withColumn("error", F.col("description") == "")
    return with_team(rows, teams)


def season_stats(feed: DataFrame, season_type: int = 2) -> DataFrame:
    """Season statistics of athletes, for ``upsert`` by league, athlete, season and its type.

    ``feed`` also has athlete_id and season; a season that is missing or 0 is the payload's, else 0. ``stats`` is the JSON
    text of the payload's stats, or of its splits where those are missing or empty.
    """
    rows = feed.withColumn("_p", F.from_json("payload", SEASON))
    usable = lambda c: F.when(~F.trim(F.col(c)).isin("", "{}", "[]", "null"), F.col(c))
    year = F.coalesce(F.nullif("season", F.lit(0)), F.col("_p.season.year"), F.lit(0))
    stats = F.coalesce(usable("_p.stats"), usable("_p.splits"), F.lit("{}"))
    return rows.select("league", F.col("athlete_id").cast("string").alias("athlete_id"), year.alias("season"), F.lit(season_type).alias("season_type"), stats.alias("stats"), "ingested")


def appearances(stats: Column) -> Column:
    """The appearances that JSON statistics count: of the known fields, the first with a number that is not negative, or with the text of any number."""
    number = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
    of = F.try_parse_json(stats)

    def field(name: str) -> Column:
        # text keeps its quotes in the JSON form of the variant, numbers have none
        json, text = F.to_json(F.try_variant_get(of, f"$.{name}", "variant")), F.get_json_object(stats, f"$.{name}")
        value = F.when(text.rlike(number), F.trim(text).try_cast("double"))
        return F.when(json.startswith('"') | (value >= 0), value)

    return F.coalesce(*map(field, APPEARANCES))


def synced_teams(old: DataFrame, feed: DataFrame) -> DataFrame:
    """All teams, those of the feed active and with its values, the others inactive.

    ``old`` has team_id, abbreviation, name, full_name, franchise_id. The name is the last word of the full one.
    """
    rows = feed.withColumn("t", F.explode(F.from_json("payload", "data array<struct<id:string, fullName:string, triCode:string, rawTricode:string, franchiseId:string>>")["data"])).where("t.id is not null")
    full = first_text("t.fullName")
    new = rows.select(F.col("t.id").alias("team_id"), F.struct(first_text("t.triCode", "t.rawTricode").alias("abbreviation"), F.coalesce(F.element_at(F.split(F.trim(full), r"\s+"), -1), F.lit("")).alias("name"), full.alias("full_name"), first_text("t.franchiseId").alias("franchise_id")).alias("v"), "ingested")
    new = new.groupBy("team_id").agg(F.max_by("v", F.struct("ingested", "v")).alias("v")).select("team_id", "v.*")
    gone = old.select(new.columns).join(new, "team_id", "left_anti").withColumn("is_active", F.lit(False))
    return new.withColumn("is_active", F.lit(True)).unionByName(gone)


def rosters(feed: DataFrame) -> DataFrame:
    """One player a row, the last by time of ingestion; ``feed`` also has team_id."""
    p = parsed(feed, f"forwards array<{PLAYER}>, defensemen array<{PLAYER}>, goalies array<{PLAYER}>", "payload")
    empty = F.array().cast(f"array<{PLAYER}>")
    rows = p.select("team_id", "ingested", F.explode(F.concat(*(F.coalesce(F.col(c), empty) for c in ("forwards", "defensemen", "goalies")))).alias("p")).where("p.id is not null")
    first, last = first_text("p.firstName.default"), first_text("p.lastName.default")
    rows = rows.select(
        F.col("p.id").alias("player_id"), first.alias("first_name"), last.alias("last_name"), F.trim(F.concat(first, F.lit(" "), last)).alias("full_name"),
        first_text("p.sweaterNumber").alias("sweater_number"), first_text("p.positionCode").alias("position"), F.col("team_id").alias("current_team"), first_text("p.headshot").alias("headshot"), "ingested",
    )
    values = [c for c in rows.columns if c not in ("player_id", "ingested")]
    return rows.groupBy("player_id").agg(F.max_by(F.struct(*values), F.struct("ingested", *values)).alias("v")).select("player_id", "v.*").withColumn("is_active", F.lit(True))


def standings(feed: DataFrame, teams: DataFrame) -> DataFrame:
    """Standings by team and date; ``team_id`` is null where no team has the abbreviation, which the sink drops and reports.

    ``teams`` has team_id and abbreviation. The date is that of the payload, else of ingestion.
    """
    rows = parsed(feed, f"standingsDate string, standings array<{STANDING}>", "payload").select("standingsDate", "ingested", F.explode("standings").alias("s"))
    boxed = F.get_json_object("s.teamAbbrev", "$.default")
    count = lambda c: F.coalesce(f"s.{c}", F.lit(0))
    rows = rows.select(
        F.coalesce(boxed, "s.teamAbbrev", F.lit("")).alias("abbreviation"), F.coalesce(F.substring("standingsDate", 1, 10).try_cast("date"), F.col("ingested").cast("date")).alias("date"),
        count("gamesPlayed").alias("games_played"), count("wins").alias("wins"), count("losses").alias("losses"), count("otLosses").alias("ot_losses"), count("points").alias("points"),
        F.coalesce("s.pointPctg", F.lit(0.0)).alias("point_pct"), first_text("s.divisionName").alias("division"), first_text("s.conferenceName").alias("conference"), "ingested",
    )
    return rows.join(teams.select("team_id", "abbreviation"), "abbreviation", "left")
