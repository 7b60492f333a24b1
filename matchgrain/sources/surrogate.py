"""Match tables derived from the shared test tables by whole-number arithmetic, so that SQL gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrain.operators import fixtures


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def competitors(spark: SparkSession, sf_dir: str, clubs: bool = False) -> DataFrame:
    """Two rows of events are the home and away side of a match: event_id, team_id, home_away, score, ord and facts of the row."""
    e = table(spark, sf_dir, "events")
    team = F.col("user_id") % 20 if clubs else F.col("user_id")
    v = F.col("value")
    goals = F.when(v < 20, 0).when(v < 45, 1).when(v < 75, 2).when(v < 120, 3).otherwise(4)
    return e.select(
        F.expr("event_id div 2").alias("event_id"), team.alias("team_id"), F.when(F.col("event_id") % 2 == 0, "home").otherwise("away").alias("home_away"),
        goals.cast("string").alias("score"), (F.col("event_id") % 2).cast("int").alias("ord"), "ts", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def matches(spark: SparkSession, sf_dir: str, clubs: bool = False) -> DataFrame:
    """match_id, league, kickoff, status, home_id, away_id, home_score, away_score; a team never plays itself."""
    rows = competitors(spark, sf_dir, clubs).withColumnsRenamed({"ts": "kickoff", "event_type": "league"})
    sides = fixtures.pivot(rows, ("kickoff", "league", "k")).withColumnRenamed("event_id", "match_id").where("home_id <> away_id")
    status = F.when(F.col("k") % 10 == 0, "scheduled").otherwise("final").alias("status")
    return sides.select("match_id", "league", "kickoff", status, "home_id", "away_id", *(fixtures.score_of(F.col(c)).alias(c) for c in ("home_score", "away_score")))


def finals(spark: SparkSession, sf_dir: str, clubs: bool = False) -> DataFrame:
    return fixtures.completed(matches(spark, sf_dir, clubs))


def games(spark: SparkSession, sf_dir: str, clubs: bool = False) -> DataFrame:
    return fixtures.team_games(finals(spark, sf_dir, clubs))


def odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten prices of each club match: two providers, three outcomes and two totals at 2.5."""
    m = matches(spark, sf_dir, clubs=True).select("match_id")
    picks = [("1x2", s, "", k) for k, s in enumerate(("home", "draw", "away"))] + [("totals", s, "2.5", k) for k, s in enumerate(("over", "under"))]
    rows = [
        F.struct(F.lit(p).alias("provider"), F.lit(market).alias("market"), F.lit(s).alias("selection"), F.lit(line).alias("line"), (1.5 + (F.col("match_id") * 37 + k * 101 + i * 13) % 500 / 100.0).alias("decimal_odds"))
        for i, p in enumerate(("fd-avg", "fd-max"))
        for market, s, line, k in picks
    ]
    return m.select("match_id", F.explode(F.array(*rows)).alias("o")).select("match_id", "o.*")


def goal_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given goal rates of each scheduled club match."""
    m = matches(spark, sf_dir, clubs=True).where("status = 'scheduled'")
    return m.select("match_id", ((F.col("home_id") * 7 + 10) % 23 / 10.0 + 0.3).alias("lam"), ((F.col("away_id") * 5 + 3) % 19 / 10.0 + 0.2).alias("mu"), F.lit(-0.1).alias("rho"))


def injuries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(injuries, season statistics): customers are athletes, their nations leagues, orders of a year appearances."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    kinds = F.array(*map(F.lit, ("out", "ir", "doubtful", "questionable", "day_to_day", "other")))
    league = F.col("c_nationkey").alias("league")
    rows = c.select(league, (F.col("c_custkey") % 50).alias("team_id"), F.col("c_custkey").alias("athlete_id"), F.col("c_name").alias("athlete_name"), F.get(kinds, (F.col("c_custkey") % 6).cast("int")).alias("status"))
    stats = o.groupBy(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("season")).agg(F.count("*").alias("appearances"))
    stats = stats.join(c.select("c_custkey", league), "c_custkey").select("league", F.col("c_custkey").alias("athlete_id"), "season", "appearances")
    return rows, stats


def club_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clubs of each league with made names."""
    t = F.col("team_id").cast("string")
    clubs = competitors(spark, sf_dir, clubs=True).select(F.col("event_type").alias("league"), "team_id").distinct()
    return clubs.select("league", "team_id", F.concat(F.lit("T"), t).alias("abbreviation"), F.concat(F.lit("Team "), t).alias("display_name"))


def club_injuries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(injuries, season statistics) of the clubs: the nation of an athlete gives the league, every fourth athlete's statistics are not kept."""
    names = F.array(*map(F.lit, ("view", "signup", "click", "error", "purchase")))
    league = F.get(names, (F.col("league") % 5).cast("int"))
    rows, stats = injuries(spark, sf_dir)
    return rows.where("athlete_id % 3 > 0").withColumns({"league": league, "team_id": F.col("athlete_id") % 20}), stats.where("athlete_id % 4 > 0").withColumn("league", league)


def catalog_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """sports (regions), leagues (nations), teams (suppliers, active with a balance above zero), and the club matches as events with their competitors."""
    slug = lambda c: F.lower(F.replace(F.col(c), F.lit(" "), F.lit("-"))).alias("slug")
    s, m = table(spark, sf_dir, "supplier"), matches(spark, sf_dir, clubs=True)
    return {
        "sports": table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), slug("r_name"), F.col("r_name").alias("name")),
        "leagues": table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), slug("n_name"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("sport_id")),
        "teams": s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("abbreviation"), F.col("s_name").alias("display_name"), (F.col("s_acctbal") > 0).alias("is_active"), F.col("s_nationkey").alias("league_id")),
        "events": m.select(F.col("match_id").alias("id"), F.col("kickoff").alias("date"), "status", (F.col("match_id") % 25).alias("league_id")),
        "competitors": m.select(F.col("match_id").alias("event_id"), F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(s).alias("home_away"), (F.col(f"{s}_id") + 1).alias("team_id"), F.col(f"{s}_score").alias("score")) for i, s in enumerate(("home", "away"))))).alias("c")).select("event_id", "c.*"),
    }


def scoreboard_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON payload of a match for each event row: its state from the type of the row, its two sides from the user."""
    e = table(spark, sf_dir, "events")
    state = F.when(F.col("event_id") % 4 == 0, "pre").when(F.col("event_id") % 4 == 1, "in").when(F.col("event_id") % 4 == 2, "post")
    side = lambda name, id: F.struct(name.alias("homeAway"), F.struct(id.cast("string").alias("id"), F.concat(F.lit("team "), id.cast("string")).alias("name")).alias("team"))
    sides = F.array(side(F.when(F.col("event_id") % 5 > 0, "home"), F.col("user_id")), side(F.lit("other"), F.col("user_id") + 1))
    competition = F.struct(F.struct((F.col("user_id") % 7).cast("string").alias("id"), F.lit("ground").alias("shortName")).alias("venue"), sides.alias("competitors"))
    day = F.when(F.col("event_id") % 9 > 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm'Z'")).otherwise("to be set")
    payload = F.struct(
        F.when(F.col("event_id") % 11 > 0, F.col("event_id")).alias("id"), day.alias("date"), F.struct(F.struct(state.alias("state"), (F.col("event_id") % 6 == 0).alias("completed")).alias("type")).alias("status"),
        F.array(competition).alias("competitions"),
    )
    return e.select(F.to_json(payload).alias("payload"), F.lit("2020-01-01").cast("timestamp").alias("ingested"))


def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of league history as CSV text for each event row, some without a date, a time, a team or a price."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    text = lambda c: c.cast("string")
    return e.select(
        F.when(n % 3 == 0, "E0").when(n % 3 == 1, "i1").otherwise("ZZ").alias("Division"), F.when(n % 13 > 0, F.date_format("ts", "yyyy-MM-dd")).otherwise("soon").alias("MatchDate"),
        F.when(n % 4 == 1, F.date_format("ts", "HH:mm")).when(n % 4 == 2, "late").alias("MatchTime"), F.concat(F.lit(" Team "), text(n)).alias("HomeTeam"), F.when(n % 17 > 0, F.concat(F.lit("Side "), text(F.col("user_id")))).alias("AwayTeam"),
        F.concat(text(n % 5), F.lit(".0")).alias("FTHome"), text(n % 3).alias("FTAway"), text(n % 400 / 100.0).alias("OddHome"), F.when(n % 2 == 0, " 2.1 ").otherwise("x").alias("MaxOver25"),
    )


def injury_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload of one injury for each customer; every ninth has no name."""
    c = table(spark, sf_dir, "customer")
    n = F.col("c_custkey")
    status = F.get(F.array(*map(F.lit, ("Out", " Injured Reserve", "Day-To-Day", "flu"))), (n % 4).cast("int"))
    item = F.struct(F.struct(n.alias("id"), F.when(n % 9 > 0, F.col("c_name")).alias("fullName")).alias("athlete"), status.alias("status"), F.struct((n % 50).alias("id")).alias("team"))
    return c.select(F.col("c_nationkey").alias("league"), F.to_json(F.struct(F.array(item).alias("injuries"))).alias("payload"), F.lit("2020-01-01").cast("timestamp").alias("ingested"))


def injury_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The teams with even numbers below 50 of each nation."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("league"), F.explode(F.sequence(F.lit(0), F.lit(48), F.lit(2)).cast("array<string>")).alias("team_id"))


def transaction_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload of one transaction for each order; some without an id, a date or a description."""
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    item = F.struct(F.when(n % 5 > 0, n).alias("id"), F.when(n % 7 > 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm'Z'")).otherwise("soon").alias("date"), F.when(n % 6 > 0, F.col("o_orderpriority")).alias("text"), F.struct((F.col("o_custkey") % 50).alias("id")).alias("team"))
    return o.select((n % 25).cast("int").alias("league"), F.to_json(F.struct(F.array(item).alias("items"))).alias("payload"), F.lit("2020-01-01").cast("timestamp").alias("ingested"))


def stats_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season statistics as JSON under changing field names, as numbers and as text."""
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    blob = F.struct(F.when(n % 4 == 0, n % 40 - 5).alias("appearances"), F.when(n % 4 < 2, (n % 30).cast("string")).alias("gamesPlayed"), F.when(n % 4 == 2, "many").alias("games_played"), F.when(n % 3 > 0, n % 20 / 2.0).alias("starts"))
    return o.select("o_orderkey", F.to_json(blob).alias("stats"))
