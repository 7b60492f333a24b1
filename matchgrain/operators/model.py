"""Scoreline model: Poisson goals with a low-score correction, score grids, markets, and the grouped rating fit."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrain.functions.columns import once
from matchgrain.functions.written import written

#: Goals 0..10 of each side, the rate floor, over/under lines, correct scores shown: fixed values of the model.
GOALS, RATE_FLOOR, LINES, TOP_SCORES = 10, 1e-6, (0.5, 1.5, 2.5, 3.5, 4.5), 8
#: Least matches of a fit, least effective matches of a reliable one, sweeps and tolerance of the fit.
MIN_MATCHES, MIN_EFFECTIVE, SWEEPS, TOLERANCE = 20, 60.0, 200, 1e-9
RATINGS = "league string, team_id long, attack double, defence double, home_advantage double, rho double, matches long, effective double, converged boolean, sweeps int, reliable boolean, log_likelihood double"


def poisson(goals: Column, rate: Column) -> Column:
    rate = F.greatest(rate, F.lit(RATE_FLOOR))
    return F.exp(-rate) * F.pow(rate, goals) / F.factorial(goals)


def low_score(hg: Column, ag: Column, lam: Column, mu: Column, rho: Column) -> Column:
    """The factor by which 0-0, 0-1, 1-0 and 1-1 differ from independence."""
    return (
        F.when((hg == 0) & (ag == 0), 1 - lam * mu * rho).when((hg == 0) & (ag == 1), 1 + lam * rho)
        .when((hg == 1) & (ag == 0), 1 + mu * rho).when((hg == 1) & (ag == 1), 1 - rho).otherwise(F.lit(1.0))
    )


def score_cells(rates: DataFrame, places: int | None = None) -> DataFrame:
    """``rates`` (lam, mu, rho and any other columns) with ``cells``: the 121 scores (hg, ag, p) of each row, which sum to 1.

    Each side's Poisson terms are computed once a row, and the total is the product of their sums but for the four low
    scores, so each cell is a product of two terms. Cells stay in their row: markets add them up without a shuffle. To make
    rows of such an array take explode_outer: for explode Spark infers a filter on its size, which computes it twice.
    """
    lam, mu, rho = F.col("lam"), F.col("mu"), F.col("rho")
    terms = lambda rate: F.transform(F.sequence(F.lit(0), F.lit(GOALS)), lambda g: poisson(g, rate))

    def weights(t: Column) -> Column:
        def of(i: Column) -> Column:
            hg, ag = F.floor(i / (GOALS + 1)).cast("int"), (i % (GOALS + 1)).cast("int")
            return F.struct(hg.alias("hg"), ag.alias("ag"), F.greatest(F.get(t["h"], hg) * F.get(t["a"], ag) * low_score(hg, ag, lam, mu, rho), F.lit(0.0)).alias("q"))

        return F.transform(F.sequence(F.lit(0), F.lit((GOALS + 1) ** 2 - 1)), of)

    def shares(cells: Column) -> Column:
        of = lambda x, total: F.try_divide(x, total) if places is None else F.round(F.try_divide(x, total), places)
        total = F.aggregate(cells, F.lit(0.0), lambda s, c: s + c["q"])
        return once(total, lambda t: F.transform(cells, lambda c: F.struct(c["hg"].alias("hg"), c["ag"].alias("ag"), of(c["q"], t).alias("p"))))

    return rates.withColumn("cells", once(once(F.struct(terms(lam).alias("h"), terms(mu).alias("a")), weights), shares))


def score_grid(rates: DataFrame) -> DataFrame:
    """(match_id, hg, ag, p): a row for each cell."""
    return score_cells(rates).select("match_id", F.explode_outer("cells").alias("c")).select("match_id", "c.*")


def fair(p: Column) -> Column:
    return F.when(p > 0, F.round(F.try_divide(F.lit(1.0), p), 3))


def sums(parts: dict) -> Column:
    """A struct of sums over the cells of a row, each of p where a condition holds, or of the value it gives: one pass."""
    def step(acc: Column, c: Column) -> Column:
        return F.struct(*((acc[name] + f(c)).alias(name) for name, f in parts.items()))

    return F.aggregate("cells", F.struct(*(F.lit(0.0).alias(name) for name in parts)), step)


def p_if(condition):
    return lambda c: F.when(condition(c), c["p"]).otherwise(0.0)


OUTCOMES = {"home": p_if(lambda c: c["hg"] > c["ag"]), "draw": p_if(lambda c: c["hg"] == c["ag"]), "away": p_if(lambda c: c["hg"] < c["ag"])}
BOTH_SCORE = {"btts": p_if(lambda c: (c["hg"] > 0) & (c["ag"] > 0))}
EXPECTED = {"exp_home": lambda c: c["p"] * c["hg"], "exp_away": lambda c: c["p"] * c["ag"]}
OVER = {f"over_{i}": p_if(lambda c, x=x: c["hg"] + c["ag"] > x) for i, x in enumerate(LINES)}


def match_odds(rows: DataFrame) -> DataFrame:
    """Rows with cells become rows with home, draw and away probabilities, double chances and fair prices."""
    out = rows.withColumn("_o", sums(OUTCOMES)).drop("cells").select("*", "_o.*").drop("_o")
    out = out.select("*", (F.col("home") + F.col("draw")).alias("home_draw"), (F.col("home") + F.col("away")).alias("home_away"), (F.col("draw") + F.col("away")).alias("draw_away"))
    return out.select("*", *(fair(F.col(c)).alias(f"fair_{c}") for c in ("home", "draw", "away")))


def totals(rows: DataFrame) -> DataFrame:
    """A row for each line of each row with cells: over and under, both teams to score, expected goals."""
    out = rows.withColumn("_o", sums(OVER | BOTH_SCORE | EXPECTED)).drop("cells")
    lines = F.explode_outer(F.array(*(F.struct(F.lit(x).alias("line"), F.col(f"_o.over_{i}").alias("over")) for i, x in enumerate(LINES)))).alias("l")
    out = out.select(*(c for c in out.columns if c != "_o"), lines, "_o.btts", "_o.exp_home", "_o.exp_away").select("*", "l.*").drop("l")
    return out.select("*", (1 - F.col("over")).alias("under"), (F.col("exp_home") + F.col("exp_away")).alias("exp_total"), (F.col("exp_home") - F.col("exp_away")).alias("supremacy"))


def likeliest(k: int) -> Column:
    """The k likeliest cells of a row; ties in the order of the grid."""
    return F.slice(F.array_sort(F.transform("cells", lambda c: F.struct((-c["p"]).alias("minus"), c["hg"].alias("hg"), c["ag"].alias("ag")))), 1, k)


def correct_scores(rows: DataFrame, k: int = TOP_SCORES) -> DataFrame:
    """(match_id, hg, ag, p, rank): the k likeliest scores of each row with cells."""
    out = rows.select("match_id", F.posexplode_outer(likeliest(k)).alias("i", "c"))
    return out.select("match_id", "c.hg", "c.ag", (-F.col("c.minus")).alias("p"), (F.col("i") + 1).alias("rank"))


def log_tau(hg: np.ndarray, ag: np.ndarray, lam: np.ndarray, mu: np.ndarray, rho: float) -> np.ndarray:
    t = np.ones(len(hg))
    for h, a, value in ((0, 0, 1 - lam * mu * rho), (0, 1, 1 + lam * rho), (1, 0, 1 + mu * rho), (1, 1, np.full(len(hg), 1 - rho))):
        at = (hg == h) & (ag == a)
        t[at] = value[at]
    return np.log(t) if (t > 0).all() else np.full(len(hg), -np.inf)


def best_rho(hg: np.ndarray, ag: np.ndarray, w: np.ndarray, lam: np.ndarray, mu: np.ndarray) -> float:
    """The correction that is likeliest, on a grid that is refined four times; 0 without low scores."""
    low = (hg <= 1) & (ag <= 1)
    lo = max(-0.3, float((-1 / lam).max()), float((-1 / mu).max())) + 1e-6
    hi = min(0.3, float((1 / (lam * mu)).min()), 1.0) - 1e-6
    if not low.any() or lo >= hi:
        return 0.0
    best = 0.0
    for _ in range(4):
        grid = np.linspace(lo, hi, 61)
        value = [float((w[low] * log_tau(hg[low], ag[low], lam[low], mu[low], r)).sum()) for r in grid]
        best, step = float(grid[int(np.argmax(value))]), (hi - lo) / 60
        lo, hi = max(lo, best - step), min(hi, best + step)
    return best


def fit_group(home: np.ndarray, away: np.ndarray, hg: np.ndarray, ag: np.ndarray, w: np.ndarray, n: int, sweeps: int = SWEEPS) -> dict:
    """Attack and defence of n teams and the home advantage, block by block until no block changes by TOLERANCE; with the log-likelihood."""
    att, dfc, ha = np.ones(n), np.ones(n), 1.0
    total = lambda key, x: np.bincount(key, x, n)
    scored, conceded = total(home, w * hg) + total(away, w * ag), total(home, w * ag) + total(away, w * hg)
    converged, done = False, 0
    for done in range(1, sweeps + 1):  # noqa: B007
        need = total(home, w * dfc[away] * ha) + total(away, w * dfc[home])
        new = np.where(need > 0, np.maximum(scored / np.where(need > 0, need, 1), RATE_FLOOR), att)
        change = float(np.abs(new - att).max())  # before the scale is pinned, so that it counts as a change
        scale = math.exp(float(np.log(new).mean()))
        att, dfc = new / scale, dfc * scale
        need = total(away, w * att[home] * ha) + total(home, w * att[away])
        new = np.where(need > 0, np.maximum(conceded / np.where(need > 0, need, 1), RATE_FLOOR), dfc)
        change, dfc = max(change, float(np.abs(new - dfc).max())), new
        base = float((w * att[home] * dfc[away]).sum())
        if base > 0:
            new_ha = max(float((w * hg).sum()) / base, RATE_FLOOR)
            change, ha = max(change, abs(new_ha - ha)), new_ha
        if change < TOLERANCE:
            converged = True
            break
    lam, mu = np.maximum(att[home] * dfc[away] * ha, RATE_FLOOR), np.maximum(att[away] * dfc[home], RATE_FLOOR)
    rho = best_rho(hg, ag, w, lam, mu)
    return {"attack": att, "defence": dfc, "home_advantage": ha, "rho": rho, "converged": converged, "sweeps": done, "log_likelihood": log_likelihood(hg, ag, w, lam, mu, rho)}


def log_likelihood(hg: np.ndarray, ag: np.ndarray, w: np.ndarray, lam: np.ndarray, mu: np.ndarray, rho: float) -> float:
    """The weighted log-likelihood of the scores, minus infinity if the correction rules one out."""
    terms = lambda k, rate: k * np.log(rate) - rate - np.array([math.lgamma(x + 1) for x in k])
    return float((w * (terms(hg, lam) + terms(ag, mu) + log_tau(hg, ag, lam, mu, rho))).sum())


class Pairings:
    """Teams and met pairings of several fits, for sums over pairings by team that are made of all fits side by side: arrays have a column for each fit."""

    def __init__(self, home: np.ndarray, away: np.ndarray):
        self.teams, ends = np.unique([home, away], return_inverse=True)
        self.home, self.away = ends.reshape(2, -1)
        self._by = {}
        for side, key in (("home", self.home), ("away", self.away)):
            order = np.argsort(key, kind="stable")
            some, starts = np.unique(key[order], return_index=True)
            self._by[side] = order, some, starts

    def total(self, side: str, x: np.ndarray) -> np.ndarray:
        order, some, starts = self._by[side]
        out = np.zeros((len(self.teams), x.shape[1]))
        out[some] = np.add.reduceat(x[order], starts)
        return out


def rated_together(p: Pairings, known: np.ndarray, w: np.ndarray, wh: np.ndarray, wa: np.ndarray, sweeps: int = SWEEPS) -> dict:
    """The ratings of ``fit_group`` for several fits side by side, from the weights of each pairing and its weighted goals of either side.

    ``known`` tells the teams of each fit. A fit that has converged keeps its ratings; the others go on without it.
    """
    teams, fits = known.shape
    out = {"attack": np.ones((teams, fits)), "defence": np.ones((teams, fits)), "home_advantage": np.ones(fits), "converged": np.zeros(fits, bool), "sweeps": np.zeros(fits, int)}
    scored, conceded = p.total("home", wh) + p.total("away", wa), p.total("home", wa) + p.total("away", wh)
    goals, size = wh.sum(0), known.sum(0)
    live, att, dfc, ha = np.arange(fits), np.ones((teams, fits)), np.ones((teams, fits)), np.ones(fits)

    def block(old: np.ndarray, total: np.ndarray, need: np.ndarray) -> np.ndarray:
        return np.where(need > 0, np.maximum(total / np.where(need > 0, need, 1), RATE_FLOOR), old)

    for done in range(1, sweeps + 1):
        if not len(live):
            break
        new = block(att, scored, p.total("home", w * dfc[p.away] * ha) + p.total("away", w * dfc[p.home]))
        change = np.abs(new - att).max(0)
        scale = np.exp(np.where(known, np.log(new), 0).sum(0) / size)
        att, dfc = np.where(known, new / scale, 1), np.where(known, dfc * scale, 1)
        new = block(dfc, conceded, p.total("away", w * att[p.home] * ha) + p.total("home", w * att[p.away]))
        change, dfc = np.maximum(change, np.abs(new - dfc).max(0)), new
        base = (w * att[p.home] * dfc[p.away]).sum(0)
        edge = np.where(base > 0, np.maximum(goals / np.where(base > 0, base, 1), RATE_FLOOR), ha)
        change, ha = np.maximum(change, np.abs(edge - ha)), edge
        end = (change < TOLERANCE) | (done == sweeps)
        if end.any():
            at = live[end]
            for name, x in (("attack", att), ("defence", dfc), ("home_advantage", ha)):
                out[name][..., at] = x[..., end]
            out["converged"][at], out["sweeps"][at] = change[end] < TOLERANCE, done
            go = ~end
            live, att, dfc, ha, scored, conceded, goals, size, known, w = live[go], att[:, go], dfc[:, go], ha[go], scored[:, go], conceded[:, go], goals[go], size[go], known[:, go], w[:, go]
    return out


def best_rhos(low: list[np.ndarray], any_low: np.ndarray, met: np.ndarray, lam: np.ndarray, mu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The corrections that ``best_rho`` finds, and the weighted logarithms of their factors, for several fits side by side.

    ``low`` has the weights of 0-0, 0-1, 1-0 and 1-1 by pairing. What is maximised is concave, so the first best place of a grid
    is where its steps stop rising, and is found by halving.
    """
    slopes = (-lam * mu, lam, mu, np.full_like(lam, -1.0))
    used = [(w, s) for w, s in zip(low, slopes, strict=True) if w.any()]

    def value(rho: np.ndarray) -> np.ndarray:
        return sum(((w * np.log(np.maximum(1 + s * rho, 1e-300))).sum(0) for w, s in used), np.zeros(lam.shape[1]))

    lo = np.maximum(-0.3, np.where(met, np.maximum(-1 / lam, -1 / mu), -np.inf).max(0)) + 1e-6
    hi = np.minimum(np.minimum(0.3, np.where(met, 1 / (lam * mu), np.inf).min(0)), 1.0) - 1e-6
    none, best = ~any_low | (lo >= hi), np.zeros(lam.shape[1])
    lo, hi = np.where(none, 0, lo), np.where(none, 0, hi)
    for _ in range(4):
        step = (hi - lo) / 60
        left, right = np.zeros(len(lo), int), np.full(len(lo), 60)
        while (left < right).any():
            mid = (left + right) // 2
            rises = value(lo + (mid + 1) * step) > value(lo + mid * step)
            left, right = np.where(rises & (left < right), mid + 1, left), np.where(rises, right, mid)
        best = lo + left * step
        lo, hi = np.maximum(lo, best - step), np.minimum(hi, best + step)
    best = np.where(none, 0.0, best)
    return best, value(best)


def fit_together(p: Pairings, met: np.ndarray, s: np.ndarray, any_low: np.ndarray, sweeps: int = SWEEPS) -> dict:
    """``fit_group`` for several fits side by side, whose pairings are ``met`` so far, from the sums of ``pairing_sums``."""
    w, wh, wa, constant, *low = s
    known = p.total("home", met.astype(float)) + p.total("away", met.astype(float)) > 0
    out = rated_together(p, known, w, wh, wa, sweeps)
    att, dfc = out["attack"], out["defence"]
    lam, mu = np.maximum(att[p.home] * dfc[p.away] * out["home_advantage"], RATE_FLOOR), np.maximum(att[p.away] * dfc[p.home], RATE_FLOOR)
    rho, corrected = best_rhos(low, any_low, met, lam, mu)
    likely = (wh * np.log(lam) + wa * np.log(mu) - w * (lam + mu) - constant).sum(0) + corrected
    return out | {"known": known, "rho": rho, "effective": w.sum(0), "log_likelihood": likely}


def pairing_sums(hg: np.ndarray, ag: np.ndarray) -> np.ndarray:
    """What a fit needs of a score, a row each, to be weighted and added up by pairing: 1, the goals of either side, the constant of its
    likelihood, and whether it is 0-0, 0-1, 1-0 or 1-1."""
    constant = np.array([math.lgamma(h + 1) + math.lgamma(a + 1) for h, a in zip(hg, ag, strict=True)])
    return np.array([np.ones(len(hg)), hg, ag, constant, *((hg == h) & (ag == a) for h in (0, 1) for a in (0, 1))], float)


def weight(age: Column, half_life_days: float) -> Column:
    """The weight of a match so many days old."""
    return F.exp(-math.log(2) / half_life_days * F.greatest(age, F.lit(0.0)))


def days_between(since: Column, until: Column) -> Column:
    return (F.unix_micros(until.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 86_400_000_000.0


def fit_pairs(rows: DataFrame, by: list[str], sweeps: int = SWEEPS) -> DataFrame:
    """Ratings of every team of each group with at least MIN_MATCHES matches and two teams.

    ``rows`` has the group, home_id, away_id, the scores, w (summed weight) and n, one row for each pairing and score,
    so a task gets at most teams squared times scores rows, however long the history. A fit is reliable if it
    converged over an effective MIN_EFFECTIVE matches.
    """
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by) + RATINGS.removeprefix("league string")
    names = [c.split()[0].strip("`") for c in kinds.split(", ")]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["home_id", "away_id", "home_score", "away_score"])
        teams = np.unique(pdf[["home_id", "away_id"]].to_numpy())
        if pdf["n"].sum() < MIN_MATCHES or len(teams) < 2:
            return pd.DataFrame(columns=names)
        at = lambda c: np.searchsorted(teams, pdf[c].to_numpy())
        got = fit_group(at("home_id"), at("away_id"), pdf["home_score"].to_numpy(float), pdf["away_score"].to_numpy(float), pdf["w"].to_numpy(), len(teams), sweeps)
        group = {c: pdf[c].iloc[0] for c in by}
        return pd.DataFrame(group | {"team_id": teams, "matches": pdf["n"].sum(), "effective": pdf["w"].sum(), "reliable": got["converged"] and pdf["w"].sum() >= MIN_EFFECTIVE} | got)[names]

    return rows.groupBy(*by).applyInPandas(fit, kinds)


def fit_leagues(fixtures: DataFrame, half_life_days: float = 120.0, sweeps: int = SWEEPS, fit=fit_pairs) -> DataFrame:
    """Ratings of every team of each league from final fixtures, weighted by age before the league's latest.

    ``fixtures`` has league, home_id, away_id, scores and kickoff; matches of one pairing and score are summed first. ``fit``
    is fit_pairs, a task for each league, or fit_by_sweeps, jobs for each sweep.
    """
    latest = fixtures.groupBy("league").agg(F.max("kickoff").alias("anchor"))
    w = weight(days_between(F.col("kickoff"), F.col("anchor")), half_life_days)
    rows = fixtures.join(latest, "league").groupBy("league", "home_id", "away_id", "home_score", "away_score").agg(F.sum(w).alias("w"), F.count("*").alias("n"))
    return fit(rows, ["league"], sweeps)


def rated(fixtures: DataFrame, ratings: DataFrame) -> DataFrame:
    """Goal rates (match_id, league, lam, mu, rho) of fixtures whose two teams are rated, with both teams' ratings and the fit's figures."""
    side = lambda s, *more: ratings.select("league", F.col("team_id").alias(f"{s}_id"), F.col("attack").alias(f"{s}_attack"), F.col("defence").alias(f"{s}_defence"), *more)
    fit = ["home_advantage", "rho", "matches", "effective", "converged", "sweeps", "reliable"]
    both = fixtures.select("match_id", "league", "home_id", "away_id").join(side("home", *fit), ["league", "home_id"]).join(side("away"), ["league", "away_id"])
    lam, mu = F.col("home_attack") * F.col("away_defence") * F.col("home_advantage"), F.col("away_attack") * F.col("home_defence")
    return both.withColumns({"lam": F.greatest(lam, F.lit(RATE_FLOOR)), "mu": F.greatest(mu, F.lit(RATE_FLOOR))})


def markets(rows: DataFrame, k: int = TOP_SCORES) -> DataFrame:
    """Rows with cells become rows with ``expected`` goals, which are their rates, and ``markets``, an array of (market, line, selection, probability, fair_odds).

    Markets are 1x2, double_chance, totals, btts and correct_score (the k likeliest, ties in the order of the grid).
    Probabilities have five decimals, fair prices and expected goals three.
    """
    out = rows.withColumns({"_o": sums(OUTCOMES | BOTH_SCORE | OVER), "_top": likeliest(k)}).drop("cells")
    o = lambda c: F.col(f"_o.{c}")
    row = lambda market, line, selection, p: F.struct(F.lit(market).alias("market"), F.lit(line).alias("line"), selection.alias("selection"), F.round(p, 5).alias("probability"), fair(p).alias("fair_odds"))
    each = [row("1x2", "", F.lit(s), o(s)) for s in ("home", "draw", "away")]
    each += [row("double_chance", "", F.lit(f"{a}_or_{b}"), o(a) + o(b)) for a, b in (("home", "draw"), ("home", "away"), ("draw", "away"))]
    each += [row("totals", str(x), F.lit(s), p) for i, x in enumerate(LINES) for s, p in (("over", o(f"over_{i}")), ("under", 1 - o(f"over_{i}")))]
    each += [row("btts", "", F.lit("yes"), o("btts")), row("btts", "", F.lit("no"), 1 - o("btts"))]
    exact = F.transform("_top", lambda c: row("correct_score", "", F.concat_ws("-", c["hg"].cast("string"), c["ag"].cast("string")), -c["minus"]))
    home, away = F.col("lam"), F.col("mu")
    expected = F.struct(*(F.round(x, 3).alias(n) for n, x in (("home_goals", home), ("away_goals", away), ("total_goals", home + away), ("supremacy", home - away))))
    return out.withColumns({"expected": expected, "markets": F.concat(F.array(*each), exact)}).drop("_o", "_top")


def summary(rows: DataFrame, keep: tuple[str, ...] = ("match_id",), k: int = TOP_SCORES) -> DataFrame:
    """A row for each market, line and selection of each row with cells, with its columns ``keep``."""
    return markets(rows, k).select(*keep, F.explode_outer("markets").alias("r")).select(*keep, "r.*")


def forecast(fixtures: DataFrame, ratings: DataFrame) -> DataFrame:
    """A document for each fixture whose two teams are rated: model, teams, expected goals and all markets.

    Goal rates come from ``rated``; model has the fit's figures, teams each side's attack and defence of four decimals.
    """
    side = lambda s: F.struct(F.round(f"{s}_attack", 4).alias("attack"), F.round(f"{s}_defence", 4).alias("defence")).alias(s)
    fit = [F.round("home_advantage", 4).alias("home_advantage"), F.round("rho", 4).alias("rho"), "matches", F.round("effective", 2).alias("effective_matches"), "converged", "sweeps", "reliable"]
    return markets(score_cells(rated(fixtures, ratings))).select("match_id", "league", F.struct(*fit).alias("model"), F.struct(side("home"), side("away")).alias("teams"), "expected", "markets")


def unrated(fixtures: DataFrame, ratings: DataFrame) -> DataFrame:
    """The fixtures that ``rated`` leaves out, with the sides that the fit does not know."""
    teams = ratings.select("league", "team_id").distinct()
    known = lambda side: teams.select("league", F.col("team_id").alias(f"{side}_id"), F.lit(True).alias(f"_{side}"))
    both = fixtures.join(known("home"), ["league", "home_id"], "left").join(known("away"), ["league", "away_id"], "left")
    missing = F.array_compact(F.array(*(F.when(F.col(f"_{s}").isNull(), s) for s in ("home", "away"))))
    return both.select("match_id", "league", "home_id", "away_id", missing.alias("unknown")).where(F.size("unknown") > 0)


def fit_by_sweeps(rows: DataFrame, by: list[str], sweeps: int = SWEEPS) -> DataFrame:
    """The ratings of ``fit_pairs`` without a task that holds a group: each sweep is a few grouped sums over the pairings.

    For leagues whose pairings do not fit one task. Ratings are a written table that a sweep joins to the pairings by
    opponent, once for attacks and once for defences; the scale and the home advantage are sums by group. A group whose blocks all
    change by less than TOLERANCE is done and keeps its ratings; the driver reads whether any group is left. The
    correction is searched as ``best_rho`` does, a grid of candidates beside the low scores, and the log-likelihood
    is added up over the scores.
    """
    rows = written(rows, "scores")
    facts = rows.groupBy(*by).agg(F.sum("n").alias("matches"), F.sum("w").alias("effective"), F.sum(F.col("w") * F.col("home_score")).alias("_goals")).where(F.col("matches") >= MIN_MATCHES)
    side = lambda own, other, home: F.struct(F.col(f"{own}_id").alias("team_id"), F.col(f"{other}_id").alias("opponent_id"), F.lit(home).alias("home"), (F.col("w") * F.col(f"{own}_score")).alias("s"), (F.col("w") * F.col(f"{other}_score")).alias("c"))
    faced = rows.select(*by, "w", F.explode(F.array(side("home", "away", True), side("away", "home", False))).alias("f")).select(*by, "w", "f.*")
    faced = written(faced.groupBy(*by, "team_id", "opponent_id", "home").agg(*(F.sum(c).alias(c) for c in ("w", "s", "c"))), "faced")
    goals = faced.groupBy(*by, "team_id").agg(F.sum("s").alias("_s"), F.sum("c").alias("_c"))
    teams = goals.groupBy(*by).agg(F.count("*").alias("_teams")).where("_teams > 1")
    fixed = written(goals.join(facts, by).join(teams, by), "goals")
    one = F.lit(1.0)
    state = fixed.select("*", one.alias("attack"), one.alias("defence"), one.alias("home_advantage"), F.lit(False).alias("converged"), F.lit(0).alias("sweeps"))

    def need(state: DataFrame, rate: str, at_home: bool) -> DataFrame:
        """What opponents' ratings let each team expect per unit of its own."""
        other = state.select(*by, F.col("team_id").alias("opponent_id"), F.col(rate).alias("_r"), F.col("home_advantage").alias("_h"))
        edge = F.when(F.col("home") == F.lit(at_home), F.col("_h")).otherwise(1.0)
        return faced.join(other, [*by, "opponent_id"]).groupBy(*by, "team_id").agg(F.sum(F.col("w") * F.col("_r") * edge).alias("_need"))

    def block(state: DataFrame, name: str, total: str, needs: DataFrame) -> DataFrame:
        new = F.when(F.col("_need") > 0, F.greatest(F.try_divide(F.col(total), F.col("_need")), F.lit(RATE_FLOOR))).otherwise(F.col(name))
        return state.join(needs, [*by, "team_id"]).withColumns({"_new": new, "_change": F.greatest("_change", F.abs(new - F.col(name)))}).drop("_need")

    while True:
        live = written(state.where("not converged").withColumn("_change", F.lit(0.0)), "ratings")
        done = state.where("converged")
        if live.isEmpty() or live.agg(F.max("sweeps")).first()[0] >= sweeps:
            break
        new = block(live, "attack", "_s", need(live, "defence", True))
        scale = new.groupBy(*by).agg(F.exp(F.avg(F.log("_new"))).alias("_scale"))
        new = new.join(scale, by).withColumns({"attack": F.col("_new") / F.col("_scale"), "defence": F.col("defence") * F.col("_scale")}).drop("_new", "_scale")
        new = written(new, "attacks")
        new = block(new, "defence", "_c", need(new, "attack", False)).withColumn("defence", F.col("_new")).drop("_new")
        new = written(new, "defences")
        away = new.select(*by, F.col("team_id").alias("opponent_id"), F.col("defence").alias("_d"))
        base = faced.where("home").join(new.select(*by, "team_id", "attack"), [*by, "team_id"]).join(away, [*by, "opponent_id"]).groupBy(*by).agg(F.sum(F.col("w") * F.col("attack") * F.col("_d")).alias("_base"))
        edge = F.when(F.col("_base") > 0, F.greatest(F.try_divide(F.col("_goals"), F.col("_base")), F.lit(RATE_FLOOR))).otherwise(F.col("home_advantage"))
        most = new.groupBy(*by).agg(F.max("_change").alias("_most"))
        new = new.drop("_change").join(base, by).join(most, by).withColumn("_edge", edge)
        change = F.greatest("_most", F.abs(F.col("_edge") - F.col("home_advantage")))
        new = new.withColumns({"converged": change < TOLERANCE, "home_advantage": F.col("_edge"), "sweeps": F.col("sweeps") + 1}).drop("_base", "_most", "_edge")
        state = written(new.select(state.columns).unionByName(done), "state")
    rates = lambda s, *more: state.select(*by, F.col("team_id").alias(f"{s}_id"), F.col("attack").alias(f"_{s}_a"), F.col("defence").alias(f"_{s}_d"), *more)
    met = rows.join(rates("home", "home_advantage"), [*by, "home_id"]).join(rates("away"), [*by, "away_id"])
    lam, mu = F.col("_home_a") * F.col("_away_d") * F.col("home_advantage"), F.col("_away_a") * F.col("_home_d")
    met = written(met.select(*by, "home_score", "away_score", "w", F.greatest(lam, F.lit(RATE_FLOOR)).alias("lam"), F.greatest(mu, F.lit(RATE_FLOOR)).alias("mu")), "rates")
    low = met.where("home_score <= 1 and away_score <= 1")
    ends = met.groupBy(*by).agg(
        (F.greatest(F.lit(-0.3), F.max(-1 / F.col("lam")), F.max(-1 / F.col("mu"))) + 1e-6).alias("lo"), (F.least(F.lit(0.3), F.min(1 / (F.col("lam") * F.col("mu"))), F.lit(1.0)) - 1e-6).alias("hi"),
        F.lit(0.0).alias("rho"),
    )
    factor = low_score(*map(F.col, ("home_score", "away_score", "lam", "mu", "rho")))
    for _ in range(4):
        step = (F.col("hi") - F.col("lo")) / 60
        tried = ends.where("lo < hi").select(*by, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("i")).withColumn("rho", F.col("lo") + F.col("i") * step)
        value = tried.join(low, by).groupBy(*by, "i").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("rho").alias("rho"), F.min(factor).alias("_least"), F.sum(F.col("w") * F.log(factor)).alias("_v"))
        best = value.groupBy(*by).agg(F.max_by(F.struct("lo", "hi", "rho"), F.struct(F.when(F.col("_least") > 0, F.col("_v")).otherwise(F.lit(float("-inf"))), -F.col("i"))).alias("b")).select(*by, "b.*")
        ends = written(best.select(*by, F.greatest("lo", F.col("rho") - step).alias("lo"), F.least("hi", F.col("rho") + step).alias("hi"), "rho"), "correction")
    # a group without low scores has no row and no correction
    met = met.join(ends.select(*by, "rho"), by, "left").fillna({"rho": 0.0})
    terms = lambda k, rate: F.col(k) * F.log(rate) - F.col(rate) - F.log(F.factorial(k).cast("double"))
    likely = met.groupBy(*by).agg(F.first("rho").alias("rho"), F.sum(F.col("w") * (terms("home_score", "lam") + terms("away_score", "mu") + F.log(factor))).alias("log_likelihood"))
    out = state.join(likely, by).withColumn("reliable", F.col("converged") & (F.col("effective") >= MIN_EFFECTIVE))
    return out.select(*by, "team_id", "attack", "defence", "home_advantage", "rho", "matches", "effective", "converged", "sweeps", "reliable", "log_likelihood")
