"""Lists and details on rows without references, with unknown fields and equal dates; what a fit sees of a league."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from matchgrain.operators import catalog, fixtures


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "sports": spark.createDataFrame([(1, "soccer")], "id long, slug string"),
        "leagues": spark.createDataFrame([(10, "eng.1", "Premier", 1), (11, "lost", "No sport", None)], "id long, slug string, name string, sport_id long"),
        "teams": spark.createDataFrame([(1, "ONE", "b", True, 10), (2, "TWO", "a", False, 10), (3, "ORF", "c", True, None), (4, "LST", "d", None, 10), (5, "FIV", "a", True, 10)], "id long, abbreviation string, display_name string, is_active boolean, league_id long"),
        "events": spark.createDataFrame([(7, "2024-01-02", "scheduled", 10), (8, "2024-01-02", "scheduled", 10), (6, None, "scheduled", 10), (9, "2024-01-01", "final", 10), (5, "2024-01-01", "scheduled", 11)], "id long, date string, status string, league_id long"),
        "competitors": spark.createDataFrame([(7, 1, "away", 2, 0), (7, 0, "home", 1, 3), (8, 0, "home", 77, 1)], "event_id long, ord int, home_away string, team_id long, score int"),
    }


def test_lists_hold_active_rows_with_their_references(tables):
    rows = lambda *a: [r.id for r in catalog.default_order(catalog.team_list(tables["teams"], tables["leagues"], tables["sports"], *a), "team", "id").collect()]
    assert rows() == rows(True) == [5, 1] and rows(False) == []
    detail = catalog.team_detail(tables["teams"], tables["leagues"], tables["sports"]).where("id = 1").first()
    assert tuple(detail.league) == (10, "eng.1", "Premier", "soccer") and "league_slug" not in detail.asDict()


def test_optional_references_keep_rows(tables):
    out = catalog.refer(tables["teams"].withColumn("_id", F.lit(0)).drop("_id"), tables["leagues"], "league_id", {"display_name": "name"}, required=False)
    assert {r.id: r.display_name for r in out.collect()} == {1: "Premier", 2: "Premier", 3: None, 4: "Premier", 5: "Premier"}


def test_details_nest_competitors_in_order(tables):
    rows = {r.id: r for r in catalog.event_detail(*(tables[k] for k in ("events", "leagues", "sports", "competitors", "teams"))).collect()}
    assert set(rows) == {6, 7, 8, 9}
    assert [(c.home_away, c.team_abbreviation, c.score) for c in rows[7].competitors] == [("home", "ONE", 3), ("away", "TWO", 0)]
    assert rows[8].competitors == [] and rows[9].competitors == []


def test_next_events_and_fields(tables):
    listed = catalog.event_list(tables["events"], tables["leagues"], tables["sports"])
    pick = lambda *a: [r.id for r in catalog.next_of_league(listed, *a).collect()]
    assert pick("ENG.1", "Soccer", "scheduled") == [6, 7, 8] and pick("eng.1", "SOCCER", "scheduled", 2) == [6, 7] and pick("ita.1", "soccer", "final") == []
    ids = lambda asked: {r.id for r in catalog.by_fields(tables["events"], asked, {"status"}).collect()}
    assert ids({"status": "final", "date": "2024-01-02"}) == {9} and ids({"status": ""}) == ids({"other": "x"}) == {5, 6, 7, 8, 9} and ids({"status": "x"}) == set()


def test_observations_are_counted_after_scores(spark):
    at = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)
    rows = [(1, "x", at(1), "final", 1, 2, 1, 0), (2, "x", at(2), "final", 2, 1, None, 0), (3, "x", at(3), "final", 1, 2, 2, 2), (4, "x", at(3), "final", 2, 1, 0, 0), (5, "x", at(4), "scheduled", 1, 2, 1, 1), (6, "x", at(5), "final", 1, 2, 1, 1), (7, "y", at(1), "final", 1, 2, 1, 1)]
    m = spark.createDataFrame(rows, "match_id long, league string, kickoff timestamp, status string, home_id long, away_id long, home_score int, away_score int")
    ids = lambda *a: sorted(r.match_id for r in fixtures.observations(m, *a).collect())
    assert ids() == [1, 3, 4, 6, 7] and ids(F.lit(at(5)), 2) == [3, 4, 7] and ids(F.lit(at(3)), 2) == [1, 7] and ids(None, 1) == [6, 7]
