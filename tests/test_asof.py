"""What is known strictly before each fixture, on small leagues with known answers and against plain loops."""

import random
from datetime import datetime, timedelta, timezone
from statistics import pstdev

import pytest
from pyspark.sql import functions as F

from matchgrain.functions.rounding import exact_round
from matchgrain.operators import asof, baseline, fixtures

MATCHES = "match_id long, league string, kickoff timestamp, status string, home_id long, away_id long, home_score int, away_score int"


def utc(*x):
    return datetime(*x, tzinfo=timezone.utc)


def table(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], MATCHES)


@pytest.fixture
def high_scoring(spark):
    day = lambda d: utc(2024, 12, d, 19)
    rows = [("nba", day(d), "final", h, a, x, y) for d, h, a, x, y in ((1, 1, 2, 110, 100), (3, 2, 1, 105, 95), (5, 1, 2, 100, 100), (7, 3, 1, 90, 120), (9, 1, 3, 115, 90))]
    return table(spark, [*rows, ("nba", day(15), "scheduled", 1, 2, None, None)])


@pytest.fixture
def low_scoring(spark):
    base = utc(2024, 12, 20, 19)
    rows = [("x", base - timedelta(days=d), "final", h, a, x, y) for d, h, a, x, y in ((20, 1, 3, 1, 3), (12, 3, 1, 0, 2), (8, 1, 2, 3, 0), (4, 2, 1, 1, 2), (2, 1, 3, 2, 0))]
    return table(spark, [*rows, ("x", base, "scheduled", 1, 2, None, None)])


def form_of(m, match_id, team_id, **kw):
    return asof.form_before(m, fixtures.team_games(fixtures.completed(m)), **kw).where(f"match_id = {match_id} and team_id = {team_id}").first()


def test_form_of_the_next_fixture(spark, high_scoring):
    r = form_of(high_scoring, 6, 1)
    assert (r.overall.played, r.overall.wins, r.overall.draws, r.overall.losses) == (5, 3, 1, 1)
    assert (r.home.played, r.away.played, r.overall.scored, r.overall.conceded) == (3, 2, 540, 485)
    assert (r.overall.avg_scored, r.overall.avg_conceded, r.overall.win_pct, r.streak, r.points_per_game) == (108.0, 97.0, 0.7, "W2", 2.0)
    assert [g.match_id for g in r.games] == [5, 4, 3, 2, 1]


def test_form_looks_back_so_many_games_and_never_ahead(spark, high_scoring):
    assert [g.match_id for g in form_of(high_scoring, 6, 1, lookback=2).games] == [5, 4]
    first = form_of(high_scoring, 1, 1)
    assert first.games == [] and first.overall.played == 0 and first.streak == "" and first.weighted.effective_games == 0
    assert [g.match_id for g in form_of(high_scoring, 4, 1).games] == [3, 2, 1]


def test_time_decay_and_momentum(spark, low_scoring):
    r = form_of(low_scoring, 6, 1, half_life_days=0)
    assert r.weighted.effective_games == 5 and r.weighted.points == pytest.approx(12 / 5)
    r = form_of(low_scoring, 6, 1, half_life_days=2, latest=3)
    w = [2 ** (-d / 2) for d in (2, 4, 8, 12, 20)]
    assert r.weighted.points == pytest.approx(3 * sum(w[:4]) / sum(w))
    assert (r.momentum.games, r.momentum.points) == (3, 3.0) and r.momentum.points_delta == pytest.approx(3 - 12 / 5)


def test_meetings_and_baseline_of_the_next_fixture(spark, high_scoring):
    m = asof.meetings_before(high_scoring, fixtures.completed(high_scoring)).where("match_id = 6").first()
    assert (m.played, m.home_wins, m.away_wins, m.draws, m.home_points, m.away_points, m.avg_total_points) == (3, 1, 1, 1, 305, 305, 203.33)
    assert [x.match_id for x in m.meetings] == [3, 2, 1]
    b = asof.baseline_before(high_scoring).where("match_id = 6").first()
    margins = [10, 10, 0, -30, 25]
    assert (b["sample"], b.avg_home, b.avg_away, b.home_advantage, b.margin_sd, b.draw_rate) == (5, 104.0, 101.0, 3.0, round(pstdev(margins), 2), 0.2)
    b = asof.baseline_before(high_scoring).where("match_id = 1").first()
    assert (b["sample"], b.avg_home, b.margin_sd, b.draw_rate) == (0, 0.0, 10.0, 0.0)


def league(n, seed):
    r, start = random.Random(seed), utc(2024, 1, 1)
    rows = []
    for _ in range(n):
        h, a = r.sample(range(6), 2)
        score = (None, None) if r.random() < 0.15 else (r.randrange(4), r.randrange(4))
        status = "scheduled" if r.random() < 0.2 else "final"
        rows.append((r.choice("pq"), start + timedelta(hours=r.randrange(n)), status, h, a, *score))  # many kickoffs are equal
    return rows


def plain(rows):
    """For each fixture the finals of its league strictly before it, the latest first."""
    rows = [(i, *r) for i, r in enumerate(rows, 1)]
    done = sorted((r for r in rows if r[3] == "final"), key=lambda r: (r[2], r[0]), reverse=True)
    return rows, lambda f: [r for r in done if r[1] == f[1] and r[2] < f[2]]


def test_forms_strengths_and_baselines_equal_plain_loops(spark):
    source = league(150, 3)
    rows, before = plain(source)
    m = table(spark, source)
    games = fixtures.team_games(fixtures.completed(m))
    form = asof.form_before(m, games, lookback=4)
    got = {(r.match_id, r.team_id): r for r in form.collect()}
    strength = {(r.match_id, r.team_id): r for r in asof.strength_before(form, games).collect()}
    baseline = {r.match_id: r for r in asof.baseline_before(m, sample=7).collect()}
    recent = {r.match_id: r for r in asof.baseline_before(m, sample=7, window_days=1).collect()}
    assert len(got) == len(strength) == 2 * len(rows) and len(baseline) == len(recent) == len(rows)
    for f in rows:
        past = [r for r in before(f) if r[6] is not None and r[7] is not None]
        for team in f[4:6]:
            own = [r for r in past if team in r[4:6]][:4]
            mine = got[f[0], team]
            assert [g.match_id for g in mine.games] == [r[0] for r in own]
            scored = [r[6] if r[4] == team else r[7] for r in own]
            assert mine.overall.avg_scored == (round(sum(scored) / len(scored), 2) if own else 0.0)
            faced = []
            for r in own:
                other = r[5] if r[4] == team else r[4]
                span = [(x[6] - x[7]) * (1 if x[4] == other else -1) for x in past if other in x[4:6] and x[2] >= own[-1][2]]
                faced.append(sum(span) / len(span))
            assert strength[f[0], team].rated_games == len(own)
            assert strength[f[0], team].strength == (pytest.approx(sum(faced) / len(faced)) if own else None)
        for known, sample in ((baseline, before(f)[:7]), (recent, [r for r in before(f) if r[2] >= f[2] - timedelta(days=1)][:7])):
            margins = [r[6] - r[7] for r in sample if r[6] is not None and r[7] is not None]
            b = known[f[0]]
            assert (b["sample"], b.home_advantage) == (len(margins), round(sum(margins) / len(margins), 2) if margins else 0.0)
            assert b.margin_sd == (round(pstdev(margins), 2) if len(margins) > 1 and pstdev(margins) > 0 else 10.0)


def test_context_counts_the_finals_of_the_days_before(spark):
    source = league(200, 9)
    rows, before = plain(source)
    m = table(spark, source)
    got = {(r.match_id, r.side): r for r in asof.context_before(m, m.where("status = 'final'"), days=2, congested_from=3).collect()}
    assert len(got) == 2 * len(rows)
    for f in rows:
        for side, team in (("home", f[4]), ("away", f[5])):
            own = [r for r in before(f) if team in r[4:6]]
            recent = sum(r[2] >= f[2] - timedelta(days=2) for r in own)
            assert got[f[0], side][1:] == (team, side, (f[2] - own[0][2]).days if own else None, recent, recent >= 3)


def test_fixtures_of_one_time_share_a_form_and_rows_without_a_time_stay(spark):
    rows = [("x", utc(2024, 1, 1 + i // 8), "final", 1 + i % 2, 2 - i % 2, i % 3, i % 2) for i in range(32)] + [("x", None, "final", 1, 2, 1, 0), (None, utc(2024, 1, 9), "final", 1, 2, 1, 0)]
    m = table(spark, rows)
    games = fixtures.team_games(fixtures.completed(m))
    assert asof.form_at(m, games).where("league = 'x' and kickoff is not null").count() == 2 * 4
    form = asof.form_before(m, games)
    assert form.count() == 2 * len(rows) == asof.strength_before(form, games).count()
    assert form.where("kickoff is null").count() == form.where("league is null").count() == 2


@pytest.mark.parametrize("make", ["context", "trailing"])
def test_dense_days_take_no_longer_than_their_matches(spark, make, capsys):
    """Many matches within the days: a window that slides adds them up for each fixture anew, 5 * 10**9 steps here."""
    n = F.col("id")
    m = spark.range(100_000).select(n.alias("match_id"), F.lit("x").alias("league"), F.timestamp_seconds(n).alias("kickoff"), F.lit("final").alias("status"), F.lit(1).cast("long").alias("home_id"), F.lit(2).cast("long").alias("away_id"), (n % 4).cast("int").alias("home_score"), (n % 3).cast("int").alias("away_score"))
    if make == "context":
        out = asof.context_before(m, m)
        got = out.agg(F.sum("recent")).first()[0]
        want = 2 * sum(range(100_000))
    else:
        out = baseline.trailing_baseline(m)
        got, want = out.agg(F.sum("n")).first()[0], sum(range(100_000))
        last = out.where("match_id = 99999").first()
        assert (last.n, last.avg_home, last.avg_away) == (99_999, pytest.approx(sum(i % 4 for i in range(99_999)) / 99_999), pytest.approx(sum(i % 3 for i in range(99_999)) / 99_999))
    assert got == want
    out.explain(True)
    assert "RangeFrame, unbounded" in (plan := capsys.readouterr().out) and "RangeFrame, -" not in plan


def test_projection_knows_nothing_of_later_games(spark, low_scoring):
    games = fixtures.team_games(fixtures.completed(low_scoring))
    got = {r.match_id: r for r in asof.projection_before(low_scoring, low_scoring, games).collect()}
    assert got[1].confidence == "none" and (got[1].expected_home, got[1].home_win, got[1].draw) == (0.0, 0.5, 0.0)
    last = got[6]  # home 1: split of 3 at home, away 2: one away game only
    # means of what 1 scores at home (2.0) and 2 concedes overall (2.5), and of what 2 scores (0.5) and 1 concedes there (1.0); no home advantage
    assert (last.confidence, last.expected_home, last.expected_away, last.margin) == ("low", 2.25, 0.75, 1.5)
    assert round(last.home_win + last.draw + last.away_win, 6) == 1


def test_rounding_is_that_of_the_exact_value(spark):
    r = random.Random(5)
    values = [k / 200 for k in range(1, 400)] + [r.uniform(-50, 50) for _ in range(300)] + [2.675, 1.005, 0.125, -0.125, 0.375, 1e9 + 0.005, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", exact_round(F.col("x"), 2).alias("two"), exact_round(F.col("x"), 3).alias("three"))
    for row in df.collect():
        assert (row.two, row.three) == (round(row.x, 2), round(row.x, 3))
    assert spark.range(1).select(exact_round(F.lit(None).cast("double"), 2).alias("n")).first().n is None
