"""Feed parsers on payloads with missing, odd and broken parts."""

import json
from datetime import datetime

from matchgrain.sources import feeds

NOW = datetime(2024, 5, 6, 7, 8, 9)


def batch(spark, payloads):
    rows = [(p if isinstance(p, str) or p is None else json.dumps(p), NOW) for p in payloads]
    return spark.createDataFrame(rows, "payload string, ingested timestamp")


def test_scoreboard(spark):
    side = lambda i, **more: {"team": {"id": i, "name": f"t{i}"}, **more}
    state = lambda s, **more: {"type": {"state": s, **more}}
    payloads = [
        {"id": 1, "date": "2023-01-02T03:04Z", "status": state("in"), "competitions": [{"venue": {"id": "v", "shortName": "s"}, "competitors": [side("5", homeAway="home", score="2"), side("6")]}]},
        {"id": "2", "date": "soon", "status": state("pre", completed=True), "season": {"year": 2020}, "competitions": [{"competitors": [side("5", homeAway="x"), side("7", homeAway="y"), {"team": {}}]}]},
        {"id": "3", "date": "2023-12-31T23:59:30+02:00", "status": state("odd")},
        {"name": "no id"},
        "broken",
        None,
    ]
    events = feeds.scoreboard(batch(spark, payloads))
    got = {r.event_id: r for r in events.where("not error").collect()}
    assert sorted(got) == ["1", "2", "3"] and events.where("error").count() == 3
    assert got["1"].date == datetime(2023, 1, 2, 3, 4) and got["2"].date == NOW and got["3"].date == datetime(2023, 12, 31, 21, 59, 30)
    assert [(got[i].status, got[i].status_detail, got[i].season_year, got[i].season_type) for i in "123"] == [("in_progress", "", 2023, 2), ("final", "Final", 2020, 2), ("scheduled", "", 2023, 2)]
    assert [tuple(r) for r in feeds.venues(events).collect()] == [("v", "s", "", "", "USA", True)]
    sides = feeds.competitors(events)
    assert sorted((r.event_id, r.team_id, r.home_away, r.score, r.ord) for r in sides.collect()) == [("1", "5", "home", "2", 0), ("1", "6", "away", "", 1), ("2", "5", "away", "", 0), ("2", "7", "home", "", 1)]
    known = spark.createDataFrame([("5",)], "team_id string")
    assert sorted(tuple(r) for r in feeds.missing_teams(sides, known).collect()) == [("6", "", "t6"), ("7", "", "t7")]


def test_articles(spark):
    got = feeds.articles(batch(spark, [{"dataSourceIdentifier": "d", "id": 4, "headline": "h" * 600}, {"id": 4, "title": "t", "published": "2023-01-02T03:04:05Z"}, {"title": "none"}, {"id": 9}, "["]))
    rows = {r.article_id: r for r in got.where("not error").collect()}
    assert sorted(rows) == ["4", "d"] and len(rows["d"].headline) == 500 and got.where("error").count() == 3
    assert rows["4"].headline == "t" and rows["4"].published == datetime(2023, 1, 2, 3, 4, 5)
