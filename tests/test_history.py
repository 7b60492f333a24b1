"""League history from CSV with missing, odd and repeated rows."""

from datetime import UTC, datetime

from matchgrain.sources import history

TEXT = """Division,MatchDate,MatchTime,HomeTeam,AwayTeam,FTHome,FTAway,HomeElo,OddHome,OddDraw,OddAway,Over25,MaxHome,HomeShots,AwayTarget,Extra
E0,2021-08-14,15:00,Alpha,Beta,2.0,1,1500.5,1.5,x,1.0,2.2,1000,7,3.9,z
e0,2022-01-02,,Beta ,Alpha,0,0,,2.5,,,,,,,
E0,2022-01-03,late,Alpha,Beta,nan,1,,,,,,,,,
E0,soon,12:00,Alpha,Beta,1,1,,,,,,,,,
XY9,2022-7-1,9:30:15,Gamma,Delta,1,3,,,,,,1001,,,
E0,2021-08-14,18:00,Alpha,Beta,3,1,1500.5,,4.0,,,,,,
E0,,,Alpha,Beta,3,1,,,,,,,,,
"""


def test_history(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text(TEXT)
    loaded = history.matches(history.read_csv(spark, str(path)))
    assert loaded.count() == 5 and loaded.where("skipped").count() == 1
    events = {r.name: r for r in history.events(loaded).selectExpr("*", "date_format(date, 'yyyy-MM-dd HH:mm:ss') as at").collect()}
    assert {n: (r.at, r.league, r.season_year, r.short_name) for n, r in events.items()} == {
        "Beta at Alpha": ("2021-08-14 18:00:00", "eng.1", 2021, "BET @ ALP"),
        "Alpha at Beta": ("2022-01-02 12:00:00", "eng.1", 2021, "ALP @ BET"),
        "Delta at Gamma": ("2022-07-01 09:30:15", "fd.xy9", 2022, "DEL @ GAM"),
    }
    assert all(len(r.event_id) == 22 for r in events.values())
    key = events["Beta at Alpha"].event_id
    sides = {(r.home_away, r.score, r.winner, r.ord, len(r.statistics)) for r in history.sides(loaded).where(f"event_id = '{key}'").collect()}
    assert sides == {("home", "3", True, 1, 0), ("away", "1", False, 0, 0)}
    prices = {(r.provider, r.market, r.selection, r.line, r.decimal_odds) for r in history.odds(loaded).where(f"event_id = '{key}'").collect()}
    assert prices == {("fd-avg", "1x2", "home", "", 1.5), ("fd-avg", "1x2", "draw", "", 4.0), ("fd-avg", "totals", "over", "2.5", 2.2), ("fd-max", "1x2", "home", "", 1000.0)}
    assert history.teams(loaded).count() == 4 and history.odds(loaded).count() == 5


def test_history_filters_and_statistics(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text(TEXT)
    rows = history.read_csv(spark, str(path))
    assert history.matches(rows, "xy9").count() == 1
    assert history.matches(rows, "E0", until="2021-12-31").count() == 2
    first = history.matches(rows, "E0", until="2021-08-14 15:00:00")
    stats = {r.home_away: [(s.name, s.value) for s in r.statistics] for r in history.sides(first).collect()}
    assert stats == {"home": [("shots", 7)], "away": [("shotsOnTarget", 3)]}
    assert history.events(history.matches(rows.limit(0))).count() == 0
    row = spark.createDataFrame([("2020-02-03",)], "d string").select(history.kickoff(history.F.col("d"), history.F.lit(None).cast("string")).alias("k")).first()
    assert row.k.replace(tzinfo=UTC) == datetime(2020, 2, 3, 12, tzinfo=UTC)
