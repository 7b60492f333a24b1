"""The replay against a plain walk over the matches, and prices and payloads on cases with known answers."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchgrain.operators import model, value, walkforward


def matches(n=90, teams=7, seed=4):
    r, start, rows = random.Random(seed), datetime(2024, 1, 1), []
    for i in range(n):
        home, away = r.sample(range(teams if i < 60 else teams + 1), 2)
        rows.append((i, "a", start + timedelta(days=i // 3), home, away, r.randrange(4), r.randrange(3)))
    return rows


SCHEMA = "match_id long, league string, kickoff timestamp_ntz, home_id long, away_id long, home_score int, away_score int"


def walk(rows, every, half_life=30.0):
    """(the fit in force at each match or why there is none, the number of fits)."""
    fitted, since, refits, out = None, 0, 0, {}
    for i, _, kickoff, home, away, _, _ in rows:
        past = [m for m in rows if m[2] < kickoff]
        if fitted is None or since >= every:
            if len(past) < model.MIN_MATCHES:
                out[i] = "no_history"
                continue
            teams = sorted({t for m in past for t in m[3:5]})
            at = lambda k, past=past, teams=teams: np.array([teams.index(m[k]) for m in past])
            w = np.array([0.5 ** ((kickoff - m[2]).total_seconds() / 86400 / half_life) for m in past])
            fitted = model.fit_group(at(3), at(4), np.array([float(m[5]) for m in past]), np.array([float(m[6]) for m in past]), w, len(teams))
            fitted |= {"effective": w.sum(), "ratings": dict(zip(teams, zip(fitted["attack"], fitted["defence"], strict=True), strict=True))}
            since, refits = 0, refits + 1
        since += 1
        out[i] = fitted if home in fitted["ratings"] and away in fitted["ratings"] else "unknown_team"
    return out, refits


def rates(fit, home, away):
    r = fit["ratings"]
    return r[home][0] * r[away][1] * fit["home_advantage"], r[away][0] * r[home][1]


@pytest.mark.parametrize("every", [1, 7])
def test_replay_equals_a_walk(spark, every):
    rows = matches()
    replayed = walkforward.replay(spark.createDataFrame(rows, SCHEMA), [30.0, 5.0], every)
    account = {r.half_life_days: r for r in walkforward.account(replayed, 30.0).collect()}
    for half_life in (30.0, 5.0):
        want, refits = walk(rows, every, half_life)
        got = {r.match_id: r for r in replayed.where(F.col("half_life_days") == half_life).collect()}
        assert got.keys() == want.keys()
        for i, _, _, home, away, _, _ in rows:
            if isinstance(want[i], str):
                assert got[i].skipped == want[i]
            else:
                lam, mu = rates(want[i], home, away)
                assert got[i].skipped is None and abs(got[i].lam - lam) < 1e-6 and abs(got[i].mu - mu) < 1e-6
                assert abs(got[i].effective - want[i]["effective"]) < 1e-9 * want[i]["effective"] and abs(got[i].rho - want[i]["rho"]) < 1e-5
        a, fitted = account[half_life], [f for f in want.values() if not isinstance(f, str)]
        assert (a.refits, a.scored, a.skipped_unreliable_fit) == (refits, len(fitted), sum(f["effective"] < 30 for f in fitted)) and a.skipped_unknown_team > 0


def test_fits_of_blocks_equal_a_walk_and_equal_times_share_one(spark, monkeypatch):
    monkeypatch.setattr(walkforward, "BLOCK", 4)
    rows = matches(120)
    df = spark.createDataFrame(rows, SCHEMA)
    want, _ = walk(rows, 1)
    planned = walkforward.with_fits(walkforward.schedule(df))
    points = {r.point: r.fit for r in planned.where("point is not null").collect()}
    assert len(set(points.values())) * 3 <= len(points) + 2  # three matches a day
    ratings = walkforward.fits(planned, [30.0])
    assert {r.fit for r in ratings.select("fit").distinct().collect()} == set(points.values())
    got = {r.match_id: r for r in walkforward.forecasts(planned, ratings, [30.0]).collect()}
    before = {(r.kickoff, r.team_id): r for r in walkforward.fits_before(df, df, 30.0).collect()}
    for i, _, kickoff, home, away, _, _ in rows:
        if isinstance(want[i], str):
            assert got[i].skipped == want[i]
            continue
        fit = want[i]
        assert (got[i].lam, got[i].mu) == pytest.approx(rates(fit, home, away), abs=1e-7) and got[i].rho == pytest.approx(fit["rho"], abs=1e-5)
        r = before[kickoff, home]
        assert (r.attack, r.defence, r.home_advantage) == pytest.approx((*fit["ratings"][home], fit["home_advantage"]), abs=1e-7)
        assert (r.converged, r.effective, r.log_likelihood) == (fit["converged"], pytest.approx(fit["effective"], rel=1e-9), pytest.approx(fit["log_likelihood"], rel=1e-9))
        assert r.matches == sum(m[2] < kickoff for m in rows) and abs(r.sweeps - fit["sweeps"]) <= 1


def test_what_fits_read_does_not_grow_with_fits_times_pairings(spark, monkeypatch):
    read, make = [], walkforward.fit_block
    rows = [(i, "a", datetime(2024, 1, 1) + timedelta(hours=i), i % 9, 9 + i * 7 % 8, i % 3, i % 2) for i in range(400)]
    monkeypatch.setattr(walkforward, "BLOCK", 100)
    monkeypatch.setattr(walkforward, "fit_block", lambda pdf, sweeps: make(pdf, sweeps).assign(matches=len(pdf)))
    planned = walkforward.with_fits(walkforward.schedule(spark.createDataFrame(rows, SCHEMA)))
    made = walkforward.fits(planned, [30.0], 3).select("fit", "matches").distinct().collect()
    cells = len({m[3:] for m in rows})
    assert len(made) == 380 and all(r.matches <= cells + 2 * 100 for r in made)


def test_weights_of_long_histories_do_not_overflow(spark):
    start = datetime(1900, 1, 1)
    days = [0, 1, 40_000, 40_001, 40_001, 40_600, 45_500]
    rows = [(i, "a", start + timedelta(days=d), 1, 2, 1, 0) for i, d in enumerate(days)] + [(100 + i, "a", start + timedelta(days=45_501), 3 + i, 30 + i, 0, 0) for i in range(40)]
    rows += [(200, "a", start + timedelta(days=45_502), 1, 2, 3, 3)]
    planned = walkforward.schedule(spark.createDataFrame(rows, SCHEMA))
    got = {(r.kickoff, r.n): r.w for r in walkforward.states(planned, [1.0]).where("home_id = 1 and away_score = 0").collect()}
    assert list(got.values()) == [pytest.approx(1.0)]  # only the last state is ever read
    planned = planned.withColumn("point", F.col("match_id"))  # every match is a fit
    got = {r.n: r.w for r in walkforward.states(planned, [1.0]).where("home_id = 1 and away_score = 0").collect()}
    want = {n: sum(2.0 ** -(days[n - 1] - d) for d in days[:n]) for n in range(1, 8)}
    assert all(got[n] == pytest.approx(want[n], rel=1e-12) for n in got) and set(got) == {1, 2, 3, 5, 6, 7}


ODDS = "match_id long, provider string, market string, selection string, line string, decimal_odds double"


def grid_of(lam, mu, rho):
    p = {(h, a): math.exp(-lam - mu) * lam**h / math.factorial(h) * mu**a / math.factorial(a) for h in range(11) for a in range(11)}
    for (h, a), t in {(0, 0): 1 - lam * mu * rho, (0, 1): 1 + lam * rho, (1, 0): 1 + mu * rho, (1, 1): 1 - rho}.items():
        p[h, a] = max(p[h, a] * t, 0)
    total = sum(p.values())
    return {k: v / total for k, v in p.items()}


def test_betting_on_the_replay_equals_a_fold(spark):
    rows, r = matches(), random.Random(2)
    kinds = {("1x2", "home", ""): lambda h, a: h > a, ("1x2", "draw", ""): lambda h, a: h == a, ("1x2", "away", ""): lambda h, a: h < a, ("totals", "over", "2.5"): lambda h, a: h + a > 2.5, ("totals", "under", "2.5"): lambda h, a: h + a < 2.5}
    odds = [(m[0], p, *k, round(1.5 + 4 * r.random(), 2)) for m in rows if m[0] % 4 for p in ("x", "y") for k in kinds]
    df = spark.createDataFrame(odds, ODDS)
    want, _ = walk(rows, 7)
    bank, peak, drawdown, staked, returned, flat, unreliable, priced = 1.0, 1.0, 0.0, 0.0, 0.0, [], 0, 0
    for i, _, _, home, away, hg, ag in rows:
        if isinstance(want[i], str):
            continue
        if want[i]["effective"] < 25:
            unreliable += 1
            continue
        own = [o for o in odds if o[0] == i]
        priced += bool(own)
        grid, found = grid_of(*rates(want[i], home, away), want[i]["rho"]), []
        for _, p, market, selection, line, o in own:
            of = [x for x in own if x[1:3] == (p, market) and x[4] == line]
            prob = round(sum(v for (h, a), v in grid.items() if kinds[market, selection, line](h, a)), 5)
            implied, ev = (1 / o) / sum(1 / x[5] for x in of), prob * o - 1
            if prob - implied >= 0.05 and ev > 0:
                found.append((-round(ev, 5), p, market, selection, line, o, round(min(0.25 * (prob * o - 1) / (o - 1), 0.05), 5)))
        for _, _, market, selection, line, o, share in sorted(found):
            won, stake = kinds[market, selection, line](hg, ag), share * bank
            staked, returned, bank = staked + stake, returned + stake * o * won, bank + (stake * (o - 1) if won else -stake)
            flat.append(o - 1 if won else -1.0)
            peak = max(peak, bank)
            drawdown = max(drawdown, (peak - bank) / peak)
    replayed = walkforward.replay(spark.createDataFrame(rows, SCHEMA), [30.0], 7)
    b = walkforward.betting(replayed, df, 25.0).first()
    assert (b.bets, b.wins, b.events_with_odds) == (len(flat), sum(x > 0 for x in flat), priced) and b.bets > 20
    assert (b.final_bankroll, b.staked, b.profit, b.max_drawdown) == pytest.approx((bank, staked, returned - staked, drawdown), abs=2e-4)
    assert b.flat_stake_yield == pytest.approx(sum(flat) / len(flat), abs=1e-4)
    assert walkforward.account(replayed, 25.0).first().skipped_unreliable_fit == unreliable > 0
    whole = walkforward.document(replayed, df, min_effective=25.0).first()
    assert whole.betting.bets == b.bets and whole.scored == sum(x.n for x in whole.calibration) / 3 and whole.market.matches > 0
    bins = {}
    for i, *_, hg, ag in rows:
        prices = {s: o for m, p, market, s, _, o in odds if (m, p, market) == (i, "x", "1x2")}
        if isinstance(want[i], str) or not prices:
            continue
        for s, o in prices.items():
            share = (1 / o) / sum(1 / x for x in prices.values())
            bins.setdefault(min(int(share * 10), 9), []).append((share, kinds["1x2", s, ""](hg, ag)))
    assert [tuple(x) for x in whole.market_calibration] == [(k, len(v), pytest.approx(sum(p for p, _ in v) / len(v), abs=1e-4), pytest.approx(sum(y for _, y in v) / len(v), abs=1e-4)) for k, v in sorted(bins.items())]
    assert whole.market.matches == sum(map(len, bins.values())) / 3
    none = walkforward.betting(replayed, df, 1e9).first()
    assert (none.bets, none.final_bankroll, none.hit_rate) == (0, 1.0, None)


def test_projections_use_the_fit_before_each_fixture_or_else_form(spark):
    rows = matches()
    want, _ = walk(rows, 1)
    schema = SCHEMA.replace("kickoff timestamp_ntz,", "kickoff timestamp_ntz, status string,")
    df = spark.createDataFrame([(*m[:3], "final", *m[3:]) for m in rows] + [(900, "a", datetime(2024, 1, 2), "scheduled", 1, 2, None, None)], schema)
    some = df.where("match_id in (5, 40, 41, 61, 89, 900)")
    got = {r.match_id: r for r in walkforward.projections(some, df, 30.0).collect()}
    assert set(got) == {5, 40, 41, 61, 89, 900}
    for i, _, _, home, away, _, _ in rows:
        if i not in got:
            continue
        if isinstance(want[i], str):
            assert got[i].source == "fallback_form"
            continue
        (lam, mu), f = rates(want[i], home, away), want[i]
        p = {k: sum(v for (h, a), v in grid_of(lam, mu, f["rho"]).items() if on(h, a)) for k, on in (("home_win", lambda h, a: h > a), ("draw", lambda h, a: h == a), ("away_win", lambda h, a: h < a))}
        assert got[i].source == "dixon_coles" and abs(got[i].expected_home - lam) < 0.0051 and abs(got[i].margin - (lam - mu)) < 0.0051
        assert all(abs(got[i][k] - p[k]) < 2e-4 for k in p) and round(sum(got[i][k] for k in p), 6) == 1
        assert got[i].confidence == ("low" if not f["converged"] else "high" if f["effective"] >= model.MIN_EFFECTIVE else "medium")
    assert {r.source for r in got.values()} == {"dixon_coles", "fallback_form"}


def test_sweep_ranks_candidates_and_keeps_those_without_matches(spark):
    rows = matches() + [(1000 + i, "b", datetime(2024, 1, 1) + timedelta(days=i), 1, 2, 0, 0) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = walkforward.half_life_sweep(df, [5.0, 30.0, 365.0]).collect()
    a = sorted((r for r in got if r.league == "a"), key=lambda r: r["rank"])
    assert [r["rank"] for r in a] == [1, 2, 3] and [r.log_loss for r in a] == sorted(r.log_loss for r in a) and len({r.forecasts for r in a}) == 1
    assert a[0].spread == pytest.approx(a[2].log_loss - a[0].log_loss, abs=1e-9) and a[0].distinct == (a[0].spread >= 0.005)
    assert [(r.forecasts, r.log_loss, r.distinct) for r in got if r.league == "b"] == [(0, None, None)] * 3


def test_prices(spark):
    cases = {"+50": 50.0, "-110": 1.9091, "EVEN": 2.0, "OFF": None, ".5": 1.005, "5.": 5.0, "1e2": 2.0, "+150": 2.5, "1": 1.01, None: None, "": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", value.price(F.col("t")).alias("p")).collect()
    assert {r.t: r.p for r in rows} == cases


def test_fit_by_sweeps_equals_the_fit_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(model, "TOLERANCE", 2e-3)
    rows = [(m[1], *m[3:], 0.9 ** (i % 40), 1) for i, m in enumerate(matches(60, 5))] + [("b", 1 + i % 3, 4 + i % 2, 1 + i % 2, i % 3, 1.0, 1) for i in range(24)] + [("c", 1, 2, 0, 0, 1.0, 3)]
    df = spark.createDataFrame(rows, "league string, home_id long, away_id long, home_score int, away_score int, w double, n long")
    for sweeps in (2, 30):
        got = {(r.league, r.team_id): r for r in model.fit_by_sweeps(df, ["league"], sweeps).collect()}
        want = {}
        for league in ("a", "b"):  # "c" has too few matches
            own = [r for r in rows if r[0] == league]
            teams = sorted({t for r in own for t in r[1:3]})
            at = lambda k, own=own, teams=teams: np.array([teams.index(r[k]) for r in own])
            w = np.array([r[5] for r in own])
            fit = model.fit_group(at(1), at(2), np.array([float(r[3]) for r in own]), np.array([float(r[4]) for r in own]), w, len(teams), sweeps)
            want |= {(league, t): fit | {"attack": fit["attack"][i], "defence": fit["defence"][i], "effective": w.sum(), "matches": len(own)} for i, t in enumerate(teams)}
        assert got.keys() == want.keys() and len(got) > 8
        for k, r in got.items():
            assert all(abs(r[c] - want[k][c]) < 1e-9 for c in ("attack", "defence", "home_advantage", "effective")), k
            assert abs(r.rho - want[k]["rho"]) < 1e-6 and abs(r.log_likelihood - want[k]["log_likelihood"]) < 1e-6
            assert (r.converged, r.sweeps, r.matches) == (want[k]["converged"], want[k]["sweeps"], want[k]["matches"])
            assert r.reliable == (r.converged and r.effective >= model.MIN_EFFECTIVE)


def test_grid_sums_to_one_under_strong_corrections(spark):
    rates = spark.createDataFrame([(1, 3.0, 2.5, 0.3), (2, 0.2, 0.1, -0.3)], "match_id long, lam double, mu double, rho double")
    assert all(abs(r.s - 1) < 1e-9 for r in model.score_grid(rates).groupBy("match_id").agg(F.sum("p").alias("s")).collect())
