"""Match projections from form: expected scores, margin, outcome probabilities and how far they can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrain.functions.columns import once
from matchgrain.functions.rounding import exact_round

#: Least games of a split that is used, least games of a projection of medium confidence, spread of margins if unknown: fixed values.
MIN_SPLIT, MIN_GAMES, MARGIN_SD = 3, 4, 10.0
#: A rational approximation of the error function (Abramowitz and Stegun, 7.1.26, within 1.5e-7): fixed values.
ERF_P, ERF = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function, within 1e-7."""
    z = F.abs(x) / 2**0.5
    t = 1 / (1 + ERF_P * z)
    tail = F.lit(0.0)
    for c in reversed(ERF):
        tail = (tail + c) * t
    half = 0.5 * tail * F.exp(-z * z)
    return F.when(x >= 0, 1 - half).otherwise(half)


def expected(attack: str, defence: str) -> Column:
    """The mean of what the attack scores and the defence concedes, by side where that has games enough, else overall."""
    use = lambda team, c: F.when(F.col(f"{team}_own.played") >= MIN_SPLIT, F.col(f"{team}_own.{c}")).when(F.col(f"{team}_all.played") > 0, F.col(f"{team}_all.{c}"))
    scoring, conceding = use(attack, "avg_scored"), use(defence, "avg_conceded")
    return F.coalesce((scoring + conceding) / 2, scoring, conceding, F.lit(0.0))


def rounded_shares(home: Column, draw: Column, away: Column) -> Column:
    """Outcome probabilities of four places; the likeliest (the first of equal ones) takes what rounding leaves."""
    names = ("home_win", "draw", "away_win")

    def shared(p: Column) -> Column:
        rest = 1 - (p[0] + p[1] + p[2])
        leader = F.when((p[0] >= p[1]) & (p[0] >= p[2]), 0).when(p[1] >= p[2], 1).otherwise(2)
        return F.struct(*(F.when(leader == i, exact_round(p[i] + rest, 4)).otherwise(p[i]).alias(c) for i, c in enumerate(names)))

    return once(F.array(*(exact_round(p, 4) for p in (home, draw, away))), shared)


def from_form(rows: DataFrame) -> DataFrame:
    """Projections of fixtures (match_id, league, home_id, away_id) from records and baselines beside them; no join, no shuffle.

    ``rows`` has for each side its record there and overall (home_own, home_all, away_own, away_all: played, avg_scored
    and avg_conceded of two places) and the league's sample, home_advantage, margin_sd and draw_rate. Where a split is
    thin, half of the league's home advantage is added for the home side and taken from the other. Scores are at least
    zero; scores and margin have two places. Margins are normal around the expected one; the league's share of draws is set
    aside first. Confidence is 'none' without games or a sample, 'medium' from MIN_GAMES games of both, else 'low'.
    """
    thin = (F.col("home_own.played") < MIN_SPLIT) | (F.col("away_own.played") < MIN_SPLIT)
    edge = F.when(thin, F.col("home_advantage") / 2).otherwise(0.0)
    rows = rows.withColumns({"_home": F.greatest(expected("home", "away") + edge, F.lit(0.0)), "_away": F.greatest(expected("away", "home") - edge, F.lit(0.0))})
    rows = rows.withColumn("margin", exact_round(F.col("_home") - F.col("_away"), 2))
    share = normal_cdf(F.col("margin") / F.when(F.col("margin_sd") > 0, F.col("margin_sd")).otherwise(MARGIN_SD))
    free = 1 - F.col("draw_rate")
    games = F.least("home_all.played", "away_all.played")
    trust = F.when((games == 0) | (F.col("sample") == 0), "none").when(games >= MIN_GAMES, "medium").otherwise("low")
    rows = rows.withColumns({"_p": rounded_shares(free * share, F.col("draw_rate"), free * (1 - share)), "confidence": trust})
    return rows.select("match_id", "league", "home_id", "away_id", exact_round(F.col("_home"), 2).alias("expected_home"), exact_round(F.col("_away"), 2).alias("expected_away"), exact_round(F.col("_home") + F.col("_away"), 2).alias("expected_total"), "margin", "_p.*", "confidence")
