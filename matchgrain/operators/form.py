"""Team form from team games: splits, last games, streaks, momentum, time-decayed means, opponent strength, rest."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrain.operators.fixtures import micros

DAY = 86_400_000_000


def latest() -> list[Column]:
    """The order of games from the latest on."""
    return [F.desc("kickoff"), F.desc("match_id")]


def record(condition: Column | None = None) -> list[Column]:
    """The columns of a split record over the games that meet a condition."""
    on = (lambda x: x) if condition is None else (lambda x: F.when(condition, x))
    count = lambda x: F.count(on(F.when(x, 1)))
    won, drawn, played = count(F.col("result") == "win"), count(F.col("result") == "draw"), F.count(on(F.lit(1)))
    mean = lambda c: F.coalesce(F.try_divide(F.sum(on(F.col(c))), played), F.lit(0.0))
    return [
        played.alias("played"), won.alias("wins"), drawn.alias("draws"), count(F.col("result") == "loss").alias("losses"),
        F.coalesce(F.sum(on(F.col("scored"))), F.lit(0)).alias("scored"), F.coalesce(F.sum(on(F.col("conceded"))), F.lit(0)).alias("conceded"),
        mean("scored").alias("avg_scored"), mean("conceded").alias("avg_conceded"),
        F.coalesce(F.try_divide(won + 0.5 * drawn, played), F.lit(0.0)).alias("win_pct"),
    ]


def splits(games: DataFrame) -> DataFrame:
    """Record of each team, overall and by side, with points a game and goal difference; one shuffle."""
    sided = games.select("team_id", "result", "scored", "conceded", "points", F.explode(F.array(F.lit("overall"), F.col("side"))).alias("split"))
    out = sided.groupBy("team_id", "split").agg(*record(), F.sum("points").alias("points"))
    return out.withColumn("ppg", F.col("points") / F.col("played")).withColumn("goal_diff", F.col("scored") - F.col("conceded"))


def side_sets(games: DataFrame) -> DataFrame:
    """Games and goals by team and side, by team, and over all, as grouping sets; the grouped-out keys are null."""
    sets = games.groupingSets([["team_id", "side"], ["team_id"], []], "team_id", "side")
    return sets.agg(F.count("*").alias("played"), F.sum("scored").alias("scored"), F.sum("conceded").alias("conceded"), F.sum("points").alias("points"))


def last_games(games: DataFrame, n: int = 10) -> DataFrame:
    """The latest n games of each team, numbered from 1."""
    rn = F.row_number().over(Window.partitionBy("team_id").orderBy(*latest()))
    return games.withColumn("rn", rn).where(F.col("rn") <= n)


def weighted(games: DataFrame, half_life_days: float, anchor: Column | None = None) -> DataFrame:
    """Means weighted by 2 ** (-age / half life), the age in days before the anchor, by default the team's latest game."""
    at = anchor if anchor is not None else F.max("kickoff").over(Window.partitionBy("team_id"))
    age = F.greatest((micros(at) - micros(F.col("kickoff"))) / F.lit(float(DAY)), F.lit(0.0))
    weight = F.exp(F.lit(-math.log(2) / half_life_days) * age) if half_life_days > 0 else F.lit(1.0)
    mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(f"w_{c}")
    return games.withColumn("w", weight).groupBy("team_id").agg(F.sum("w").alias("effective_games"), mean("points"), mean("scored"), mean("conceded"))


def momentum(games: DataFrame, window: int = 10, recent: int = 5) -> DataFrame:
    """Means over the latest few games less those over the window."""
    gap = lambda c: (F.avg(F.when(F.col("rn") <= recent, F.col(c))) - F.avg(c)).alias(f"d_{c}")
    return last_games(games, window).groupBy("team_id").agg(F.count("*").alias("games"), gap("points"), gap("scored"), gap("conceded"))


def streaks(games: DataFrame) -> DataFrame:
    """The run of equal results that each team's latest game ends, such as W3."""
    order = Window.partitionBy("team_id").orderBy(*latest())
    first = F.first("result").over(order)
    marked = games.select("team_id", F.row_number().over(order).alias("rn"), first.alias("latest"), (F.col("result") != first).alias("other"))
    run = F.coalesce(F.min(F.when(F.col("other"), F.col("rn"))) - 1, F.max("rn"))
    out = marked.groupBy("team_id", "latest").agg(run.alias("length"))
    return out.select("team_id", "latest", "length", F.concat(F.upper(F.substring("latest", 1, 1)), F.col("length").cast("string")).alias("streak"))


def opponent_strength(games: DataFrame) -> DataFrame:
    """For each team the mean, over the games it played, of the opponent's mean goal difference in the league.

    The league rates count games from the team's first one on and strictly before its latest. A team has one such
    range, so games join its distinct opponents on (league, opponent) with the range as the residual; how often an
    opponent was met is a weight, not more rows.
    """
    own = games.groupBy("league", "team_id").agg(F.min("kickoff").alias("since"), F.max("kickoff").alias("until"))
    faced = games.groupBy("league", "team_id", "opponent_id").agg(F.count("*").alias("times"))
    spans = faced.join(own, ["league", "team_id"])
    played = games.select("league", F.col("team_id").alias("opponent_id"), "kickoff", (F.col("scored") - F.col("conceded")).alias("margin"))
    rates = spans.join(played, ["league", "opponent_id"]).where("kickoff >= since and kickoff < until")
    rates = rates.groupBy("league", "team_id", "opponent_id").agg(F.max("times").alias("times"), F.avg("margin").alias("rate"))
    return rates.groupBy("league", "team_id").agg(F.sum("times").alias("rated_games"), (F.sum(F.col("times") * F.col("rate")) / F.sum("times")).alias("strength"))


def head_to_head(fixtures: DataFrame, limit: int = 10) -> DataFrame:
    """The latest meetings of each pair of teams, seen from the smaller id."""
    a, b = F.least("home_id", "away_id"), F.greatest("home_id", "away_id")
    home_first = F.col("home_id") < F.col("away_id")
    rows = fixtures.where("home_id <> away_id").select(
        a.alias("team_a"), b.alias("team_b"), "kickoff", "match_id",
        F.when(home_first, F.col("home_score")).otherwise(F.col("away_score")).alias("a_score"),
        F.when(home_first, F.col("away_score")).otherwise(F.col("home_score")).alias("b_score"),
    )
    rn = F.row_number().over(Window.partitionBy("team_a", "team_b").orderBy(*latest()))
    rows = rows.withColumn("rn", rn).where(F.col("rn") <= limit)
    won = lambda x: F.count(F.when(x, 1))
    return rows.groupBy("team_a", "team_b").agg(
        F.count("*").alias("played"), won(F.col("a_score") > F.col("b_score")).alias("a_wins"), won(F.col("a_score") < F.col("b_score")).alias("b_wins"),
        won(F.col("a_score") == F.col("b_score")).alias("draws"), F.sum("a_score").alias("a_points"), F.sum("b_score").alias("b_points"),
        F.avg(F.col("a_score") + F.col("b_score")).alias("avg_total"), F.max("kickoff").alias("last_met"),
    )


def meetings(fixtures: DataFrame, limit: int = 10) -> DataFrame:
    """The meetings that ``head_to_head`` counts, one a row, the latest first from ``rn`` 1."""
    a, b = F.least("home_id", "away_id").alias("team_a"), F.greatest("home_id", "away_id").alias("team_b")
    rows = fixtures.where("home_id <> away_id").select(a, b, "match_id", "kickoff", "home_id", "away_id", "home_score", "away_score")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("team_a", "team_b").orderBy(*latest()))).where(F.col("rn") <= limit)


def rest(appearances: DataFrame, congestion_days: int = 14, congested_from: int = 4) -> DataFrame:
    """Whole days since each team's previous match and its matches in the days before, for every appearance.

    ``appearances`` has team_id, match_id, kickoff. The window reaches back ``congestion_days`` (inclusive) to strictly
    before the match. Teams are the partitions: a team's history is bounded by its calendar.
    """
    at = appearances.withColumn("at", micros(F.col("kickoff")))
    by_time = Window.partitionBy("team_id").orderBy("at")
    gap = (F.col("at") - F.max("at").over(by_time.rangeBetween(Window.unboundedPreceding, -1))) / F.lit(float(DAY))
    window = by_time.rangeBetween(-congestion_days * DAY, -1)
    out = at.withColumn("rest_days", F.greatest(F.floor(gap), F.lit(0)).cast("int")).withColumn("recent", F.count("*").over(window))
    return out.select("team_id", "match_id", "kickoff", "rest_days", "recent", (F.col("recent") >= congested_from).alias("congested"))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: list[str]) -> DataFrame:
    """Each left row with the values of the latest right row of its key strictly before it, by one union and one window.

    Ties of time on the right go to the later values in their order. A left row without an earlier one keeps nulls.
    """
    wide = left.withColumn("_v", F.lit(None).cast(right.select(F.struct(*value).alias("v")).schema["v"].dataType)).withColumn("_left", F.lit(1))
    facts = right.select(F.col(by), F.col(at), F.struct(*value).alias("_v"), F.lit(0).alias("_left"))
    seen = Window.partitionBy(by).orderBy(micros(F.col(at))).rangeBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.when(F.col("_left") == 0, F.struct(F.col(at).alias("t"), F.col("_v").alias("v")))).over(seen)
    joined = wide.unionByName(facts, allowMissingColumns=True).withColumn("_m", latest).where("_left = 1")
    return joined.select(*left.columns, *(F.col(f"_m.v.{c}").alias(c) for c in value))
