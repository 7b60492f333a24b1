"""League baselines, injury burdens and forecasts from form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrain.operators.fixtures import micros
from matchgrain.operators.form import DAY, latest

#: Severity of a status: fixed values.
SEVERITY = {"out": 1.0, "ir": 1.0, "doubtful": 0.75, "questionable": 0.4, "day_to_day": 0.3, "other": 0.2}
UNKNOWN_SEVERITY = 0.2


def league_baseline(fixtures: DataFrame, sample: int = 200) -> DataFrame:
    """Means, home advantage, spread of the margin and draw rate of the latest final fixtures of each league.

    The sample is taken before fixtures without scores are dropped. The spread is 10 where it is zero or unknown.
    """
    rn = F.row_number().over(Window.partitionBy("league").orderBy(*latest()))
    rows = fixtures.where("status = 'final'").withColumn("rn", rn).where(F.col("rn") <= sample).where("home_score is not null and away_score is not null")
    return summary(rows.groupBy("league"))


def summary(grouped) -> DataFrame:
    margin = F.col("home_score") - F.col("away_score")
    spread = F.stddev_pop(margin)
    return grouped.agg(
        F.count("*").alias("n"), F.avg("home_score").alias("avg_home"), F.avg("away_score").alias("avg_away"), F.avg(margin).alias("home_advantage"),
        F.when(spread > 0, spread).otherwise(10.0).alias("margin_sd"), F.avg((margin == 0).cast("double")).alias("draw_rate"),
    )


def trailing_baseline(fixtures: DataFrame, days: int = 7) -> DataFrame:
    """For every fixture the baseline of its league over the days strictly before it.

    A fixture reads the sums over the fixtures before it and those before its days, and takes the second from the first, so
    the work does not grow with what the days hold. Time is cut into spans of ``days``; a fixture counts in its own span
    and, as history, in the next, so that a window's partition is two spans of a league, however long the league's history is.
    """
    margin = F.col("home_score") - F.col("away_score")
    values = {"n": F.lit(1), "home": F.col("home_score"), "away": F.col("away_score"), "margin": margin, "draws": (margin == 0).cast("int")}
    at, length = micros(F.col("kickoff")), days * DAY
    span = F.floor(at / length)
    read = lambda when, sign: F.struct(when.alias("at"), F.lit(sign).alias("sign"))
    reads = fixtures.select("match_id", "league", span.alias("span"), F.explode(F.array(read(at, 1), read(at - length, -1))).alias("r")).select("match_id", "league", "span", "r.*")
    final = fixtures.where("status = 'final' and home_score is not null and away_score is not null")
    facts = final.select("league", at.alias("at"), F.explode(F.array(span, span + 1)).alias("span"), *(v.cast("long").alias(f"_{c}") for c, v in values.items()))
    before = Window.partitionBy("league", "span").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    known = reads.unionByName(facts, allowMissingColumns=True).withColumns({f"_{c}": F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)) for c in values}).where("sign is not null")
    out = known.groupBy("league", "span", "match_id").agg(*(F.sum(F.col("sign") * F.col(f"_{c}")).alias(f"_{c}") for c in values))
    part = lambda c, name: F.try_divide(F.col(f"_{c}"), F.col("_n")).alias(name)
    return out.select("match_id", "league", F.col("_n").alias("n"), part("home", "avg_home"), part("away", "avg_away"), part("margin", "home_advantage"), part("draws", "draw_rate"))


def severity(status: Column) -> Column:
    """The weight of an absence."""
    weights = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    return F.coalesce(F.try_element_at(weights, status), F.lit(UNKNOWN_SEVERITY))


def appearance_share(stats: DataFrame) -> DataFrame:
    """Appearances of each athlete's latest season as a share of the most in the league that season, at most 1.

    ``stats`` has league, athlete_id, season, appearances. The most is joined from an aggregate, not a window, so a
    large league stays spread.
    """
    latest = stats.groupBy("league", "athlete_id").agg(F.max_by(F.struct("season", "appearances"), "season").alias("s"))
    latest = latest.select("league", "athlete_id", "s.season", "s.appearances")
    most = stats.groupBy("league", "season").agg(F.max("appearances").alias("most"))
    share = F.least(F.try_divide(F.col("appearances").cast("double"), F.col("most")), F.lit(1.0))
    return latest.join(most, ["league", "season"]).select("league", "athlete_id", "season", share.alias("importance"))


def injury_burden(injuries: DataFrame, shares: DataFrame, shown: int = 10) -> DataFrame:
    """Absences of each team of each league: how many, their summed severity times importance, counts by status, the weightiest names.

    ``injuries`` has league, team_id, athlete_id, athlete_name, status. Unknown importance counts as 1. The list holds
    the first ``shown`` by name, then ordered by weight.
    """
    rows = injuries.join(shares.select("league", "athlete_id", "importance"), ["league", "athlete_id"], "left")
    rows = rows.withColumn("weight", severity(F.col("status")) * F.coalesce("importance", F.lit(1.0)))
    rn = F.row_number().over(Window.partitionBy("league", "team_id").orderBy("athlete_name", "athlete_id"))
    named = rows.withColumn("rn", rn).where(F.col("rn") <= shown).groupBy("league", "team_id").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("athlete_name").alias("name")))).alias("top")
    )
    total = rows.groupBy("league", "team_id").agg(
        F.count("*").alias("absences"), F.sum("weight").alias("burden"), F.count("importance").alias("known"),
        *(F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s}") for s in SEVERITY),
    )
    return total.join(named.select("league", "team_id", F.array_join(F.transform("top", lambda x: x["name"]), ",").alias("top")), ["league", "team_id"])
