"""Walk-forward replay: each match is forecast by a fit of what came before it, refitted every so many matches, and bet on."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrain.functions.rounding import exact_round
from matchgrain.functions.written import written
from matchgrain.operators import asof, model, projection, value
from matchgrain.operators.fixtures import completed, micros, team_games
from matchgrain.operators.form import DAY

FIT = ["half_life_days", "league", "fit"]
CELL = ["league", "home_id", "away_id", "home_score", "away_score"]
#: Half-lives of a span: sums within one stay far below the largest double, and what is older than the last one counts for nothing.
SPAN = 500
#: The gap between the best and the worst log loss of a sweep below which candidates do not differ: fixed value.
SPREAD = 0.005
#: Points whose fits are made in one task, and numbers of an array over the fits that it makes side by side: bounds of memory.
BLOCK, SIDE_BY_SIDE = 512, 2**15


def schedule(finals: DataFrame, refit_every: int = 1) -> DataFrame:
    """Final fixtures with the number of league matches strictly before them and the fit in force, ``point``.

    Fits begin at the first match with MIN_MATCHES before it and follow every ``refit_every`` matches; earlier ones
    have a null point. Ties in time keep the order of ids. Counts run over days and within them, so that no task holds a
    league's whole history.
    """
    rows = asof.running(finals, ["league"], {"n": F.lit(1)}, ["match_id"]).withColumnRenamed("before_n", "before")
    waiting = rows.where(F.col("before") < model.MIN_MATCHES).groupBy("league").agg(F.count("*").alias("_waiting"))  # all of them come before the others
    rows = rows.join(waiting, "league", "left")
    point = F.when(F.col("before") >= model.MIN_MATCHES, F.floor((F.col("upto_n") - F.coalesce("_waiting", F.lit(0)) - 1) / refit_every))
    return rows.withColumn("point", point.cast("long")).drop("upto_n", "_waiting")


def candidates(half_lives: list[float]) -> Column:
    return F.explode(F.array(*(F.lit(float(h)) for h in half_lives))).alias("half_life_days")


def states(planned: DataFrame, half_lives: list[float]) -> DataFrame:
    """What a fit needs of the history, kept up as it grows: a row each time a pairing has a score again.

    Rows (half_life_days, league, home_id, away_id, scores, kickoff, n, w, from, to): how often the pairing had that score
    so far, the sum of weights 2 ** (-age / half life) as of this kickoff, and the range of points, from <= point < to,
    whose latest state this is. Weights are summed by running sums in spans of SPAN half-lives, each scaled to its begin; of
    earlier spans only the last one counts in a double. Rows of one pairing and score are few.
    """
    league = Window.partitionBy("league", "kickoff")
    last = planned.groupBy("league").agg((F.max("point") + 1).alias("_points")).where("_points is not null")
    rows = planned.select(*CELL, "match_id", "kickoff", (F.coalesce(F.max("point").over(league), F.lit(-1)) + 1).alias("from"))
    return kept_up(rows.join(last, "league"), half_lives)


def kept_up(rows: DataFrame, half_lives: list[float]) -> DataFrame:
    """``states`` of final fixtures with ``from``, the first point after each, and ``_points``, how many its league has."""
    rows = rows.select("*", candidates(half_lives))
    cell = Window.partitionBy("half_life_days", *CELL)
    day = micros(F.col("kickoff")) / F.lit(float(DAY))
    rows = rows.withColumn("_lives", (day - F.min(day).over(cell)) / F.col("half_life_days"))
    rows = rows.withColumn("_span", F.floor(F.col("_lives") / SPAN))
    rows = rows.withColumn("_x", F.pow(F.lit(2.0), F.col("_lives") - F.col("_span") * SPAN))
    order = cell.orderBy("kickoff", "match_id")
    own = Window.partitionBy("half_life_days", *CELL, "_span").orderBy("kickoff", "match_id").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.coalesce(F.sum("_x").over(cell.orderBy("_span").rangeBetween(-1, -1)), F.lit(0.0)) * F.lit(2.0**-SPAN)
    to = F.coalesce(F.lead("from").over(order), F.col("_points"))
    rows = rows.withColumns({"w": (F.sum("_x").over(own) + carried) / F.col("_x"), "n": F.row_number().over(order).cast("long"), "to": to})
    return rows.where(F.col("from") < F.col("to")).select("half_life_days", *CELL, "kickoff", "n", "w", "from", "to")


def in_blocks(carried: DataFrame, rows: DataFrame, anchors: DataFrame, half_lives: list[float], sweeps: int) -> DataFrame:
    """Ratings of every (half_life_days, league, fit) of ``anchors`` (league, block, fit, anchor), from the matches strictly before its anchor.

    A block of fits is made by one task from the states in force at its begin, ``carried``, and its own matches, ``rows`` with
    the block that they fall into: so rows are matches, and blocks times the pairings and scores seen so far.
    """
    at, lives = lambda c: micros(F.col(c)).alias("at"), candidates(half_lives)
    facts = carried.withColumn("block", F.explode(F.sequence(F.col("from"), F.col("to") - 1))).select("half_life_days", "block", *CELL, at("kickoff"), "w", "n")
    facts = facts.unionByName(rows.where("block >= 0").select(lives, "block", *CELL, at("kickoff"), F.lit(1.0).alias("w"), F.lit(1).cast("long").alias("n")))
    facts = facts.unionByName(anchors.select(lives, "league", "block", at("anchor"), "fit"), allowMissingColumns=True)
    kinds = f"half_life_days double, league {rows.schema['league'].dataType.simpleString()}, fit long" + model.RATINGS.removeprefix("league string")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as little data is much work here
    return facts.repartition(parts, "half_life_days", "league", "block").groupBy("half_life_days", "league", "block").applyInPandas(lambda pdf: fit_block(pdf, sweeps), kinds)


def fit_block(pdf: pd.DataFrame, sweeps: int) -> pd.DataFrame:
    """The ratings of one block's fits. Sums by pairing are aged from fit to fit and take up what lies between two."""
    anchors, facts = pdf[pdf["fit"].notna()].sort_values("at"), pdf[pdf["fit"].isna()].sort_values(["at", *CELL[1:]])
    if not len(facts) or not len(anchors):
        return pd.DataFrame()
    life = float(pdf["half_life_days"].iloc[0]) * DAY
    ends, met = np.unique(facts[["home_id", "away_id"]].to_numpy("int64"), axis=0, return_inverse=True)
    p, met = model.Pairings(*ends.T), met.reshape(-1)
    hg, ag = facts["home_score"].to_numpy(float), facts["away_score"].to_numpy(float)
    sums, is_low = model.pairing_sums(hg, ag) * facts["w"].to_numpy(float), (hg <= 1) & (ag <= 1)
    at, n, times = facts["at"].to_numpy("int64"), facts["n"].to_numpy(float), anchors["at"].to_numpy("int64")
    upto = np.searchsorted(at, times)
    now, seen, begin = np.zeros((len(sums), len(ends))), np.zeros(len(ends), bool), 0
    wide, out = max(1, SIDE_BY_SIDE // len(ends)), []
    for first in range(0, len(times), wide):
        some = range(first, min(first + wide, len(times)))
        s, m = np.zeros((*now.shape, len(some))), np.zeros((len(ends), len(some)), bool)
        for k, i in enumerate(some):
            new = slice(begin, upto[i])
            now *= 2.0 ** (-(times[i] - times[max(i - 1, 0)]) / life)
            aged = sums[:, new] * 2.0 ** (-(times[i] - at[new]) / life)
            for j in range(len(now)):
                now[j] += np.bincount(met[new], aged[j], len(ends))
            seen[met[new]], begin = True, upto[i]
            s[..., k], m[:, k] = now, seen
        matches = np.concatenate([[0.0], n.cumsum()])[upto[some.start : some.stop]]
        low = np.concatenate([[0], is_low.cumsum()])[upto[some.start : some.stop]] > 0
        can = (matches >= model.MIN_MATCHES) & (m.any(0))
        can &= (p.total("home", m.astype(float)) + p.total("away", m.astype(float)) > 0).sum(0) > 1
        if can.any():
            got = model.fit_together(p, m[:, can], s[..., can], low[can], sweeps)
            out.append(rating_rows(p.teams, got, anchors["fit"].to_numpy("int64")[some.start : some.stop][can], matches[can]))
    if not out:
        return pd.DataFrame()
    rows = pd.concat(out, ignore_index=True)
    return rows.assign(half_life_days=pdf["half_life_days"].iloc[0], league=pdf["league"].iloc[0])[[*FIT, *(c.split()[0] for c in model.RATINGS.split(", ")[1:])]]


def rating_rows(teams: np.ndarray, got: dict, fits: np.ndarray, matches: np.ndarray) -> pd.DataFrame:
    """A row for each team that a fit knows."""
    fit, team = np.nonzero(got["known"].T)
    rows = {"fit": fits[fit], "team_id": teams[team], "matches": matches[fit].astype("int64"), "attack": got["attack"][team, fit], "defence": got["defence"][team, fit]}
    rows |= {c: got[c][fit] for c in ("home_advantage", "rho", "effective", "converged", "sweeps", "log_likelihood")}
    return pd.DataFrame(rows).assign(reliable=lambda r: r["converged"] & (r["effective"] >= model.MIN_EFFECTIVE))


def fits(planned: DataFrame, half_lives: list[float], sweeps: int = model.SWEEPS) -> DataFrame:
    """Ratings of every (half_life_days, league, fit), from the matches strictly before its first match, weighted by age at it.

    ``planned`` has ``fit`` beside ``point``, as ``with_fits`` gives it.
    """
    blocks = planned.withColumn("point", F.floor(F.col("point") / BLOCK))
    kickoff = Window.partitionBy("league", "kickoff")
    own = blocks.select(*CELL, "kickoff", F.max("point").over(kickoff).alias("block"))
    anchors = planned.where("point = fit").groupBy("league", "fit").agg(F.min("kickoff").alias("anchor")).withColumn("block", F.floor(F.col("fit") / BLOCK))
    return in_blocks(states(blocks, half_lives), own, anchors, half_lives, sweeps)


def with_fits(planned: DataFrame) -> DataFrame:
    """``schedule`` with ``fit``, the first point whose first match has the kickoff of the point's: such points have the same fit."""
    anchors = planned.where("point is not null").groupBy("league", "point").agg(F.min("kickoff").alias("_anchor"))
    anchors = anchors.withColumn("fit", F.min("point").over(Window.partitionBy("league", "_anchor"))).drop("_anchor")
    return planned.join(anchors, ["league", "point"], "left")


def fits_before(fixtures: DataFrame, finals: DataFrame, half_life_days: float = 120.0, sweeps: int = model.SWEEPS) -> DataFrame:
    """Ratings of each league as of each kickoff of its fixtures, from the final ones strictly before; columns of ``fit_pairs`` by league and kickoff.

    Kickoffs are the points, in blocks; fixtures of one kickoff share a fit. Kickoffs with too few matches before have none.
    """
    times = fixtures.select("league", "kickoff").distinct().withColumn("_time", F.lit(1))
    both = finals.select(*CELL, "match_id", "kickoff").unionByName(times, allowMissingColumns=True)
    both = asof.running(both, ["league"], {"n": F.coalesce("_time", F.lit(0)).cast("long")}, ["match_id"])
    both = written(both.withColumn("_own", F.coalesce(F.max("_time").over(Window.partitionBy("league", "kickoff")), F.lit(0))), "times")
    points = both.where("_time = 1").select("league", F.col("before_n").alias("fit"), F.col("kickoff").alias("anchor"))
    last = points.groupBy("league").agg(F.ceil(F.count("*") / BLOCK).alias("_points"))
    rows = both.where("_time is null").select(*CELL, "match_id", "kickoff", F.ceil((F.col("before_n") + F.col("_own")) / BLOCK).alias("from"))
    ratings = in_blocks(kept_up(rows.join(last, "league"), [half_life_days]), rows.withColumn("block", F.col("from") - 1), points.withColumn("block", F.floor(F.col("fit") / BLOCK)), [half_life_days], sweeps)
    return ratings.join(points, ["league", "fit"]).withColumnRenamed("anchor", "kickoff").drop("half_life_days", "fit")


def model_projection(fixtures: DataFrame, ratings: DataFrame) -> DataFrame:
    """Projections of the fixtures whose teams are both rated as of their kickoff, in the columns of ``projection.from_form``.

    Expected scores are the goal rates, of two places; probabilities are the model's. Confidence is 'high' of a reliable
    fit, 'medium' of a converged one, else 'low'.
    """
    by = ["league", "kickoff"]
    side = lambda s, *more: ratings.select(*by, F.col("team_id").alias(f"{s}_id"), F.col("attack").alias(f"_{s}_a"), F.col("defence").alias(f"_{s}_d"), *more)
    both = fixtures.select("match_id", *by, "home_id", "away_id").join(side("home", "home_advantage", "rho", "converged", "reliable"), [*by, "home_id"]).join(side("away"), [*by, "away_id"])
    rates = {"lam": F.col("_home_a") * F.col("_away_d") * F.col("home_advantage"), "mu": F.col("_away_a") * F.col("_home_d")}
    rows = model.match_odds(model.score_cells(both.withColumns({c: F.greatest(x, F.lit(model.RATE_FLOOR)) for c, x in rates.items()})))
    two = lambda x, name: exact_round(x, 2).alias(name)
    trust = F.when(F.col("reliable"), "high").when(F.col("converged"), "medium").otherwise("low").alias("confidence")
    rows = rows.withColumn("_p", projection.rounded_shares(F.col("home"), F.col("draw"), F.col("away"))).drop("draw")
    return rows.select("match_id", "league", "home_id", "away_id", two(F.col("lam"), "expected_home"), two(F.col("mu"), "expected_away"), two(F.col("lam") + F.col("mu"), "expected_total"), two(F.col("lam") - F.col("mu"), "margin"), "_p.*", trust)


def projections(fixtures: DataFrame, others: DataFrame, half_life_days: float = 120.0, lookback: int = asof.LOOKBACK, sweeps: int = model.SWEEPS) -> DataFrame:
    """The model's projection of each fixture where a fit before it knows both teams, else the one from form; ``source`` tells which.

    ``others`` are all fixtures of the leagues, final ones among them. Nothing after a fixture's kickoff counts.
    """
    finals = completed(others)
    by_model = model_projection(fixtures, fits_before(fixtures, finals, half_life_days, sweeps)).withColumn("source", F.lit("dixon_coles"))
    by_form = asof.projection_before(fixtures, others, team_games(finals)).withColumn("source", F.lit("fallback_form"))
    return by_model.unionByName(by_form.join(by_model.select("match_id"), "match_id", "left_anti"))


def forecasts(planned: DataFrame, ratings: DataFrame, half_lives: list[float]) -> DataFrame:
    """The scheduled matches with goal rates under the fit in force; ``skipped`` is 'no_history', 'unknown_team' or null."""
    planned = planned.select(candidates(half_lives), "*")
    home = ratings.select(*FIT, F.col("team_id").alias("home_id"), F.col("attack").alias("_ha"), F.col("defence").alias("_hd"), "home_advantage", "rho", "effective", "reliable")
    away = ratings.select(*FIT, F.col("team_id").alias("away_id"), F.col("attack").alias("_aa"), F.col("defence").alias("_ad"))
    both = planned.join(home, [*FIT, "home_id"], "left").join(away, [*FIT, "away_id"], "left")
    lam, mu = F.col("_ha") * F.col("_ad") * F.col("home_advantage"), F.col("_aa") * F.col("_hd")
    known = lam.isNotNull() & mu.isNotNull()
    skipped = F.when(F.col("point").isNull(), "no_history").when(~known, "unknown_team")
    rates = [F.when(known, F.greatest(x, F.lit(model.RATE_FLOOR))).alias(n) for x, n in ((lam, "lam"), (mu, "mu"))]
    return both.select(*(c for c in planned.columns if c != "fit"), *rates, "rho", "effective", "reliable", skipped.alias("skipped"))


def replay(finals: DataFrame, half_lives: list[float], refit_every: int = 1, sweeps: int = model.SWEEPS) -> DataFrame:
    """All forecasts of a replay under each half-life, written once, as reports read them several times."""
    planned = with_fits(schedule(finals, refit_every))
    return written(forecasts(planned, fits(planned, half_lives, sweeps), half_lives), "replay")


def account(replayed: DataFrame, min_effective: float = model.MIN_EFFECTIVE) -> DataFrame:
    """By half-life and league: matches scored, those skipped and why, those scored but not bet on, and the number of fits."""
    count = lambda x: F.count(F.when(x, 1))
    return replayed.groupBy("half_life_days", "league").agg(
        count(F.col("skipped").isNull()).alias("scored"), count(F.col("skipped") == "no_history").alias("skipped_no_history"),
        count(F.col("skipped") == "unknown_team").alias("skipped_unknown_team"), count(F.col("skipped").isNull() & (F.col("effective") < min_effective)).alias("skipped_unreliable_fit"),
        F.countDistinct("point").alias("refits"),
    )


def outcomes(replayed: DataFrame) -> DataFrame:
    """Outcome probabilities of the scored matches beside what happened; computed within the row."""
    return model.match_odds(model.score_cells(replayed.where("skipped is null"))).withColumn("outcome", value.actual(F.col("home_score"), F.col("away_score")))


def report(scored: DataFrame, by: tuple[str, ...] = ("half_life_days", "league")) -> DataFrame:
    """Scores of the model, and of a forecast that gives every match its group's outcome rates."""
    by = list(by)
    share = lambda o: F.avg((F.col("outcome") == o).cast("double")).alias(o)
    rates = scored.groupBy(*by).agg(*map(share, ("home", "draw", "away")))
    base = value.scores(scored.select(*by, "outcome").join(rates, by), by).select(*by, *(F.col(c).alias(f"base_{c}") for c in ("log_loss", "brier", "accuracy")))
    return value.scores(scored, by).join(base, by)


def bets(replayed: DataFrame, odds: DataFrame, min_effective: float = model.MIN_EFFECTIVE, **limits) -> DataFrame:
    """Value bets of each match by the fit in force, settled: none before the fit carries ``min_effective`` matches of weight.

    Returns ``value_bets`` columns with half_life_days, league, kickoff and won; bets of unknown markets have a null ``won``.
    """
    trusted = replayed.where((F.col("skipped").isNull()) & (F.col("effective") >= min_effective))
    keep = ("half_life_days", "match_id", "league", "kickoff", "home_score", "away_score")
    models = model.summary(model.score_cells(trusted), keep).drop("fair_odds")
    out = value.value_bets(odds, models, **limits)
    return out.withColumn("won", value.settled(*map(F.col, ("market", "selection", "line", "home_score", "away_score"))))


def betting(replayed: DataFrame, odds: DataFrame, min_effective: float = model.MIN_EFFECTIVE, **limits) -> DataFrame:
    """By half-life and league what betting on the replay made: an ordered fold of the bankroll over the matches and their bets.

    Columns: events_with_odds (trusted matches with a price), then those of ``value.ledger_report``; leagues without bets have
    zeros and nulls and a bankroll of 1.
    """
    by = ["half_life_days", "league"]
    trusted = replayed.where((F.col("skipped").isNull()) & (F.col("effective") >= min_effective))
    priced = trusted.join(odds.select("match_id").distinct(), "match_id", "left_semi").groupBy(*by).agg(F.count("*").alias("events_with_odds"))
    made = value.ledger_report(written(value.ledger(bets(replayed, odds, min_effective, **limits), by), "ledger"), by)
    out = replayed.select(*by).distinct().join(priced, by, "left").join(made, by, "left")
    return out.fillna({"events_with_odds": 0, "bets": 0, "wins": 0, "staked": 0.0, "profit": 0.0, "final_bankroll": 1.0, "growth": 0.0, "max_drawdown": 0.0})


def document(replayed: DataFrame, odds: DataFrame, **limits) -> DataFrame:
    """The whole report of a replay, one row by half-life and league: counts, scores, base rates, market, calibration and betting.

    Log losses, Brier scores and shares have four decimals, as the parts that are compared with one another are rounded first.
    """
    by = ["half_life_days", "league"]
    scored = written(outcomes(replayed), "outcomes")
    four = lambda df: df.select(*by, *(F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in by))
    priced = written(value.consensus(odds), "consensus")
    market = value.against_market(scored, priced, by)

    def binned(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.withColumns({c: F.round(c, 4) for c in ("predicted", "observed")})
        return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bin", "n", "predicted", "observed"))).alias(name))

    out = account(replayed).join(four(report(scored)).drop("n"), by, "left")
    pack = lambda df, name: df.select(*by, F.struct(*(c for c in df.columns if c not in by)).alias(name))
    for part, name in ((four(market), "market"), (betting(replayed, odds, **limits), "betting")):
        out = out.join(pack(part, name), by, "left")
    out = out.join(binned(value.calibration(scored, by=by), "calibration"), by, "left")
    return out.join(binned(value.market_calibration(scored, priced, by), "market_calibration"), by, "left")


def half_life_sweep(finals: DataFrame, half_lives: list[float], refit_every: int = 5, sweeps: int = model.SWEEPS) -> DataFrame:
    """Candidates ranked by log loss in each league: one replay whose fits are keyed by half-life, so the history is read once.

    Log losses, Brier scores and accuracies have four decimals; equal ones keep the order of the half-lives; candidates
    without a scored match come last with nulls. ``spread`` is the worst log loss less the best, ``distinct`` whether it
    reaches SPREAD.
    """
    replayed = replay(finals, half_lives, refit_every, sweeps)
    scored = report(outcomes(replayed)).select("half_life_days", "league", F.col("n").alias("forecasts"), *(F.round(c, 4).alias(c) for c in ("log_loss", "brier", "accuracy")), F.round("base_log_loss", 4).alias("baseline_log_loss"))
    out = replayed.select("half_life_days", "league").distinct().join(scored, ["half_life_days", "league"], "left").fillna({"forecasts": 0})
    league = Window.partitionBy("league")
    rank = F.row_number().over(league.orderBy(F.col("log_loss").asc_nulls_last(), "half_life_days"))
    out = out.withColumns({"rank": rank, "spread": F.round(F.max("log_loss").over(league) - F.min("log_loss").over(league), 4)})
    return out.withColumn("distinct", F.col("spread") >= SPREAD)
