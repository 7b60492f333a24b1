"""Documents of fixtures and the sentences in them, on a small league with known answers."""

from datetime import datetime, timedelta, timezone

import pytest

from matchgrain.operators import analysis, asof, baseline, fixtures

MATCHES = "match_id long, league string, kickoff timestamp, status string, home_id long, away_id long, home_score int, away_score int"
BASE = datetime(2024, 12, 20, 19, tzinfo=timezone.utc)
#: Days before the base, home, away, goals.
PLAYED = [(20, 1, 3, 1, 3), (12, 3, 1, 0, 2), (8, 1, 2, 3, 0), (4, 2, 1, 1, 2), (2, 1, 3, 2, 0)]


@pytest.fixture(scope="module")
def league(spark):
    rows = [(i, "x", BASE - timedelta(days=d), "final", h, a, x, y) for i, (d, h, a, x, y) in enumerate(PLAYED, 1)]
    rows += [(6, "x", BASE - timedelta(days=1), "final", 2, 3, None, None), (7, "x", BASE, "scheduled", 1, 2, None, None), (8, "x", BASE, "scheduled", 3, 9, None, None), (9, "y", BASE, "scheduled", None, 1, None, None)]
    return spark.createDataFrame(rows, MATCHES)


@pytest.fixture(scope="module")
def documents(spark, league):
    names = spark.createDataFrame([("x", 1, "ONE", "Team One"), ("x", 2, "TWO", "Team Two"), ("y", 1, "WHY", "Other League")], "league string, team_id long, abbreviation string, display_name string")
    hurt = spark.createDataFrame([("x", 1, 10, "Ann", "out"), ("x", 1, 11, "Bo", "doubtful"), ("x", 2, 12, "Cy", "out"), ("y", 1, 13, "Di", "ir")], "league string, team_id long, athlete_id long, athlete_name string, status string")
    seen = spark.createDataFrame([("x", 10, 2024, 10), ("x", 99, 2024, 20)], "league string, athlete_id long, season int, appearances int")
    asked = league.where("status = 'scheduled'")
    form = asof.form_before(asked, fixtures.team_games(fixtures.completed(league)))
    burden = baseline.injury_burden(hurt, baseline.appearance_share(seen))
    return {r.match_id: r for r in analysis.documents(asked, league, form, names, asof.projection_of(asked, league, form), burden).collect()}


def test_sentences_in_order(documents):
    said = documents[7].insights
    assert said[0] == "ONE last 5: 4-0-1 (2.0 scored / 0.8 conceded per game)."
    assert said[1] == "ONE is on a W4 run."
    two = said.index("TWO last 2: 0-0-2 (0.5 scored / 2.5 conceded per game).")
    # team 3 has -2/3 a game and was met three times, team 2 has -2 and was met twice
    assert said[two - 1] == "ONE faced weaker-than-average opponents (-1.20 goal difference per game)."
    # since the first game of team 2, team 1 has +3, +1 and +2
    assert said[two + 1] == "TWO faced stronger-than-average opponents (+2.00 goal difference per game), so that record flatters it less than it looks."
    rest = said[two + 2 :]
    assert rest[:6] == [
        "ONE has played 4 matches in 14 days.",
        "ONE had only 2 days' rest.",
        "ONE has 2 listed absences, weighted 1.2.",
        "TWO had only 1 days' rest.",
        "TWO has 1 listed absence, weighted 1.0 (playing time unknown).",
        "Head-to-head over 2 meetings: ONE 2 - 0 TWO, 3.0 combined points per game.",
    ]
    assert rest[6].startswith("Model leans ONE by ") and rest[7] == analysis.SAY["fallback"] and len(rest) == 8


def test_parts_of_the_document(documents):
    r = documents[7]
    assert (r.home.team.display_name, r.away.team.abbreviation, r.home.form.point_differential, r.home.form.streak) == ("Team One", "TWO", 6, "W4")
    assert (r.home.context.rest_days, r.home.context.matches_in_last_14_days, r.home.context.congested) == (2, 4, True)
    # the final match without scores is a match played, but no game of the form
    assert (r.away.context.rest_days, r.away.context.matches_in_last_14_days, r.away.form.overall.played) == (1, 3, 2)
    assert (r.home.context.injuries["count"], r.home.context.injuries.weighted, r.home.context.injuries.importance_known) == (2, 1.25, True)
    assert r.home.context.injuries.players == "Bo,Ann" and r.head_to_head.played == 2 and r.league_baseline.sample == 5
    assert r.projection.source == "fallback_form" and (r.confidence, r.lookback) == ("low", 10)


def test_unknown_teams_and_empty_tables(spark, league, documents):
    said = documents[8].insights
    assert "No completed games on record for 9." in said and "No previous meetings on record between these teams." in said
    assert documents[8].confidence == "none" and documents[8].away.context.rest_days is None
    missing = documents[9]
    assert missing.home.team.abbreviation == "" and missing.home.form.overall.played == 0 and missing.away.context.injuries["count"] == 1
    none = league.where("false")
    form = asof.form_before(none, fixtures.team_games(fixtures.completed(none)))
    names = spark.createDataFrame([], "league string, team_id long, abbreviation string, display_name string")
    assert analysis.insights(analysis.documents(none, none, form, names, asof.projection_of(none, none, form))).count() == 0
