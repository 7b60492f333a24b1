"""Fixtures and team games: two-sided matches from competitor rows, and one row for each team of each match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score_of(score: Column) -> Column:
    """A whole number written as text, else null: '110' is 110; '', 'N/A' and '110.5' are null."""
    text = F.trim(score)
    return F.when(text.rlike(r"^[+-]?[0-9]{1,9}$"), F.try_to_number(F.regexp_replace(text, r"^\+", ""), F.lit("S999999999"))).cast("int")


def pivot(competitors: DataFrame, facts: tuple[str, ...] = ()) -> DataFrame:
    """One row for each event with exactly two competitors.

    ``competitors`` has event_id, team_id, home_away, score, ord. Where the labels are one 'home' and one 'away', they
    decide; otherwise the smaller ``ord`` is away and the other home. ``facts`` are columns of the event, taken from a
    row labelled home. One shuffle on the event, of aggregates of fixed size.
    """
    side = F.struct("ord", "home_away", "team_id", "score")
    more = [F.max(F.when(F.col("home_away") == "home", F.struct(*facts))).alias("facts")] if facts else []
    both = competitors.groupBy("event_id").agg(F.count("*").alias("n"), F.min(side).alias("one"), F.max(side).alias("two"), *more).where("n = 2")
    one, two = F.col("one"), F.col("two")
    swapped = (one["home_away"] == "home") & (two["home_away"] == "away")
    pick = lambda field: (F.when(swapped, one[field]).otherwise(two[field]), F.when(swapped, two[field]).otherwise(one[field]))
    (home, away), (hs, as_) = pick("team_id"), pick("score")
    return both.select("event_id", home.alias("home_id"), away.alias("away_id"), hs.alias("home_score"), as_.alias("away_score"), *(F.col(f"facts.{c}").alias(c) for c in facts))


def completed(fixtures: DataFrame, before: Column | None = None) -> DataFrame:
    """Final fixtures with both scores, strictly before a time."""
    out = fixtures.where("status = 'final' and home_score is not null and away_score is not null")
    return out if before is None else out.where(F.col("kickoff") < before)


def observations(fixtures: DataFrame, before: Column | None = None, max_matches: int | None = None) -> DataFrame:
    """What a fit sees of each league: completed fixtures strictly before a time, at most the ``max_matches`` latest that have scores.

    Equal kickoffs go by match_id. The limit is a rank that partitions prune before the shuffle, so a league's whole
    history is not held in one task.
    """
    out = completed(fixtures, before).select("match_id", "league", "kickoff", "home_id", "away_id", "home_score", "away_score")
    if max_matches is None:
        return out
    rank = F.row_number().over(Window.partitionBy("league").orderBy(F.desc("kickoff"), F.desc("match_id")))
    return out.withColumn("_rank", rank).where(F.col("_rank") <= max_matches).drop("_rank")


def outcome(scored: Column, conceded: Column) -> Column:
    """'win', 'draw' or 'loss'."""
    return F.when(scored > conceded, "win").when(scored < conceded, "loss").when(scored == conceded, "draw")


def team_games(fixtures: DataFrame) -> DataFrame:
    """Two rows for each fixture, one from either side; no shuffle."""
    view = lambda side, own, other: F.struct(
        F.col(f"{own}_id").alias("team_id"), F.col(f"{other}_id").alias("opponent_id"), F.lit(side).alias("side"),
        F.col(f"{own}_score").alias("scored"), F.col(f"{other}_score").alias("conceded"),
    )
    sides = F.explode(F.array(view("home", "home", "away"), view("away", "away", "home"))).alias("g")
    out = fixtures.select("match_id", "league", "kickoff", sides).select("match_id", "league", "kickoff", "g.*")
    result = outcome(F.col("scored"), F.col("conceded"))
    points = F.when(result == "win", 3).when(result == "draw", 1).otherwise(0)
    return out.withColumn("result", result).withColumn("points", points)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp."""
    return F.unix_micros(ts.cast("timestamp"))
