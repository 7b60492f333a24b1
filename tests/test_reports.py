"""Report feeds on payloads with missing, odd and broken parts."""

import json
from datetime import date, datetime

from pyspark.sql import functions as F

from matchgrain.sources import reports

NOW = datetime(2024, 5, 6, 7, 8, 9)


def feed(spark, payloads, league="a"):
    return spark.createDataFrame([(league, p if isinstance(p, str) or p is None else json.dumps(p), NOW) for p in payloads], "league string, payload string, ingested timestamp")


def known(spark):
    return spark.createDataFrame([("a", "5"), ("b", "6")], "league string, team_id string")


def test_teams(spark):
    teams = [{"team": {"id": 5, "displayName": "Five", "isActive": False}}, {"id": "6", "name": "six"}, {"team": {"name": "none"}}]
    got = reports.teams(feed(spark, [{"sports": [{"leagues": [{"teams": teams}]}]}, {}, "x", None]))
    rows = {(r.team_id, r.display_name, r.name, r.is_active, r.is_all_star, r.error) for r in got.collect()}
    assert rows == {("5", "Five", "", False, False, False), ("6", "", "six", True, False, False), ("", "", "none", True, False, True)}


def test_injuries(spark):
    items = [{"athlete": {"id": 1, "fullName": "A"}, "status": " Injured Reserve ", "team": {"id": 5}}, {"athlete": {"displayName": "B"}, "status": "Flu", "shortComment": "c", "team": {"id": 6}}, {"status": "out"}]
    got = {(r.athlete_name, r.status, r.team_id, r.description, r.error) for r in reports.injuries(feed(spark, [{"items": [], "injuries": items}, "[", None]), known(spark)).collect()}
    assert got == {("A", "ir", "5", "", False), ("B", "other", None, "c", False), ("", "out", None, "", True)}


def test_transactions(spark):
    items = [{"id": 9, "date": "2024-01-02T03:04Z", "text": "t", "team": {"id": "5"}}, {"date": "soon", "description": "d"}, {"id": 3}]
    got = {(r.transaction_id, r.date, r.description, r.team_id, r.error) for r in reports.transactions(feed(spark, [{"transactions": items}]), known(spark)).collect()}
    assert got == {("9", date(2024, 1, 2), "t", "5", False), (None, None, "d", None, False), ("3", None, "", None, True)}


def test_season_stats_and_appearances(spark):
    payloads = [{"season": {"year": 2021}, "stats": {"gamesPlayed": "12"}}, {"stats": {}, "splits": {"appearances": -1, "starts": 3}}, {"stats": {"appearances": "-2"}}, {"stats": {"appearances": "many", "gamesPlayed": True, "games_played": 4.5}}, "no", None]
    rows = feed(spark, payloads).withColumns({"athlete_id": F.lit(7), "season": F.lit(0)})
    got = reports.season_stats(rows).withColumn("n", reports.appearances(F.col("stats")))
    assert sorted(((r.season, r.n) for r in got.collect()), key=repr) == sorted([(2021, 12.0), (0, 3.0), (0, -2.0), (0, 4.5), (0, None), (0, None)], key=repr)


def test_hockey(spark):
    old = spark.createDataFrame([("1", "AAA", "x", "y x", "9"), ("2", "BBB", "z", "z", "8")], "team_id string, abbreviation string, name string, full_name string, franchise_id string")
    new = reports.synced_teams(old, feed(spark, [{"data": [{"id": 2, "fullName": "New York  Bees", "rawTricode": "BBC"}, {"id": 3}]}]))
    assert {(r.team_id, r.abbreviation, r.name, r.is_active) for r in new.collect()} == {("1", "AAA", "x", False), ("2", "BBC", "Bees", True), ("3", "", "", True)}
    roster = {"forwards": [{"id": 1, "firstName": {"default": "A"}, "lastName": {"default": "B"}, "sweaterNumber": 9}], "goalies": [{"id": 2, "lastName": {"default": "C"}}]}
    players = reports.rosters(feed(spark, [roster, {}, "x"]).withColumn("team_id", F.lit("2")))
    assert {(r.player_id, r.full_name, r.sweater_number, r.current_team) for r in players.collect()} == {("1", "A B", "9", "2"), ("2", "C", "", "2")}
    table = {"standingsDate": "2024-02-03T00:00", "standings": [{"teamAbbrev": {"default": "AAA"}, "wins": 3}, {"teamAbbrev": "BBB", "points": 5}, {"teamAbbrev": "ZZZ"}]}
    got = reports.standings(feed(spark, [table]), old)
    assert {(r.team_id, r.wins, r.points, r.date) for r in got.collect()} == {("1", 3, 0, date(2024, 2, 3)), ("2", 0, 5, date(2024, 2, 3)), (None, 0, 0, date(2024, 2, 3))}
