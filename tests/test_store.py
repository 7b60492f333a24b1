"""The versioned store, the registry of feeds and the state of last payloads."""

import json
import os

import pytest
from pyspark.sql import functions as F

from matchgrain.streaming import feeds, store

ROWS = "k long, v string, at int"


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_batches_rewrite_touched_buckets_and_count_what_they_did(spark, tmp_path):
    s = store.Store(spark, f"{tmp_path}/t", buckets=50)
    first = spark.range(2000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(0).alias("at"))
    assert s.apply(0, {"t": store.upserted(first, ["k"], "at")}) == {"t": {"created": 2000, "updated": 0, "errors": 0, "total": 2000}}
    whole = size(f"{tmp_path}/t/data")
    batch = spark.createDataFrame([(1, "new", 1), (1, "newer", 2), (5000, "x", 1), (None, "bad", 1)], ROWS)
    assert s.apply(1, {"t": store.upserted(batch, ["k"], "at")})["t"] == {"created": 1, "updated": 1, "errors": 1, "total": 3}
    assert size(f"{tmp_path}/t/data") - whole < 0.1 * whole  # two of fifty buckets
    got = {r.k: r.v for r in s.read("t").collect()}
    assert len(got) == 2001 and got[1] == "newer" and got[5000] == "x"
    assert {r.k for r in s.read("t", 0).where("k in (1, 5000)").collect()} == {1}


def test_a_batch_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    s = store.Store(spark, f"{tmp_path}/t", buckets=4, keep=2)
    rows = lambda *x: store.upserted(spark.createDataFrame(list(x), ROWS), ["k"], "at")
    s.apply(0, {"t": rows((1, "a", 0), (2, "a", 0))})
    boom = store.Change(spark.createDataFrame([(1, "z", 1)], ROWS), ["k"], lambda old, new: new.select(F.raise_error(F.lit("lost")).cast("long").alias("k"), "v", "at", F.lit("created").alias("action")))
    with pytest.raises(Exception, match="lost"):
        s.apply(1, {"u": rows((9, "u", 0)), "t": boom})
    assert sorted((r.k, r.v) for r in s.read("t").collect()) == [(1, "a"), (2, "a")] and s.read("u") is None and s.versions() == [0]
    for n in (1, 2, 3):
        s.apply(n, {"t": rows((1, f"b{n}", n))})
    s.apply(3, {"t": rows((1, "again", 9))})  # the same batch once more
    assert sorted((r.k, r.v) for r in s.read("t").collect()) == [(1, "again"), (2, "a")] and s.versions() == [2, 3]
    assert [r.v for r in s.read("t", 2).where("k = 1").collect()] == ["b2"]


def test_parts_without_rows_lose_their_old_ones(spark, tmp_path):
    s = store.Store(spark, f"{tmp_path}/t", buckets=3)
    kids = lambda *x: spark.createDataFrame(list(x), "p long, c string")
    s.apply(0, {"t": store.replaced(kids((1, "a"), (1, "b"), (2, "c"), (3, "d")), kids((1, ""), (2, ""), (3, "")), ["p"])})
    s.apply(1, {"t": store.replaced(kids((1, "z")), kids((1, ""), (2, "")), ["p"])})
    assert sorted((r.p, r.c) for r in s.read("t").collect()) == [(1, "z"), (3, "d")]


def land(folder, feed, name, rows):
    os.makedirs(f"{folder}/{feed}", exist_ok=True)
    with open(f"{folder}/{feed}/{name}.json", "w") as f:
        f.writelines(json.dumps({"league": league, "payload": json.dumps(p), "ingested": f"2024-01-0{day}T00:00:00"}) + "\n" for league, p, day in rows)


def test_feeds_refresh_side_by_side_and_one_failure_stops_no_other(spark, tmp_path):
    landed, args = f"{tmp_path}/landed", (spark, f"{tmp_path}/landed", f"{tmp_path}/stores", f"{tmp_path}/checkpoints")
    team = lambda i, name: {"team": {"id": i, "displayName": name}}
    land(landed, "teams", "a", [("nba", {"sports": [{"leagues": [{"teams": [team("1", "one"), team("2", "two"), {"team": {"name": "none"}}]}]}]}, 1)])
    land(landed, "scoreboard", "a", [("nba", {"id": "7", "date": "2024-01-02T03:04Z", "status": {"type": {"state": "pre"}}, "competitions": [{"competitors": [{"team": {"id": "1"}}, {"team": {"id": "2"}}]}]}, 1)])
    land(landed, "news", "a", [("nba", {"id": "n", "headline": "h"}, 1)])
    land(landed, "injuries", "a", [("nba", {"items": [{"athlete": {"id": "5", "displayName": "A"}, "status": "Out", "team": {"id": "1"}}]}, 1), ("nfl", {"items": [{"athlete": {"displayName": "B"}}]}, 1)])
    land(landed, "transactions", "a", [("nba", {"items": [{"id": "t1", "description": "d"}, {"description": "no id"}, {"id": "t2"}]}, 1)])
    price = lambda home, **more: {"items": [{"provider": {"id": "p"}, "homeTeamOdds": home, **more}]}
    land(landed, "odds", "a", [("nba", {"event": "7", "odds": price("+150", drawOdds="OFF")}, 1), ("nba", {"odds": price("2.0")}, 1), ("nba", {"event": "8", "odds": "down"}, 1), ("nba", {"event": "7", "odds": price("+200")}, 2)])
    tries = []

    def fails(batch, s):
        tries.append(1)
        raise ValueError("feed is down")

    told = feeds.refresh(*args, wait_seconds=0.0, registry=feeds.FEEDS | {"news": feeds.Feed(fails, "1 hour")})
    assert "feed is down" in told["news"]["error"] and len(tries) == 3 and all(x["error"] is None for n, x in told.items() if n != "news")
    assert told["teams"]["counts"]["teams"] == {"created": 2, "updated": 0, "errors": 1, "total": 3}
    assert told["transactions"]["counts"]["transactions"] == {"created": 2, "updated": 0, "errors": 1, "total": 3}
    assert told["odds"]["counts"]["odds"] == {"created": 1, "updated": 0, "errors": 2, "total": 3} and told["teams"]["counts"]["leagues"]["created"] == 1
    read = lambda feed, t: store.Store(spark, f"{tmp_path}/stores/{feed}").read(t).collect()
    assert sorted((r.league, r.athlete_name, r.team_id) for r in read("injuries", "injuries")) == [("nba", "A", "1"), ("nfl", "B", None)]
    assert [(r.match_id, r.provider, r.market, r.selection, r.decimal_odds) for r in read("odds", "odds")] == [("7", "p", "1x2", "home", 3.0)]
    assert [(r.league, r.name, r.abbreviation) for r in read("teams", "leagues")] == [("nba", "Nba", "NBA")]
    land(landed, "scoreboard", "b", [("nba", {"id": "7", "date": "2024-01-02T03:04Z", "status": {"type": {"state": "post"}}, "competitions": [{"competitors": [{"team": {"id": "2"}}]}]}, 2)])
    land(landed, "injuries", "b", [("nba", {"items": [{"athlete": {"displayName": "C"}}]}, 2), ("nfl", {"items": []}, 2)])
    told = feeds.refresh(*args)
    assert told["scoreboard"]["counts"]["events"]["updated"] == 1 and told["news"]["counts"]["articles"]["created"] == 1 and told["teams"]["counts"] == {}
    assert [(r.event_id, r.status) for r in read("scoreboard", "events")] == [("7", "final")] and [r.team_id for r in read("scoreboard", "competitors")] == ["2"]
    assert sorted((r.league, r.athlete_name) for r in read("injuries", "injuries")) == [("nba", "C"), ("nfl", "B")]


def test_late_and_repeated_payloads_are_dropped_over_batches(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    got = []
    stream = spark.readStream.schema("id string, payload string, ingested timestamp").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    last = feeds.latest_payloads(stream, "id")

    def arrive(name, *rows):
        with open(f"{tmp_path}/in/{name}.json", "w") as f:
            f.writelines(json.dumps({"id": i, "payload": p, "ingested": f"2024-01-01T00:00:0{s}"}) + "\n" for i, p, s in rows)
        query = last.writeStream.foreachBatch(lambda df, n: got.extend((r.id, r.payload, r.ingested) for r in df.collect())).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        out = sorted((i, p, t.second) for i, p, t in got)
        got.clear()
        return out

    assert arrive("a", ("x", "1", 3), ("x", "0", 1), ("y", "1", 2), (None, "n", 1)) == [("x", "0", 1), ("x", "1", 3), ("y", "1", 2)]
    assert arrive("b", ("x", "late", 2), ("y", "1", 5), ("x", "1", 3)) == []
    assert arrive("c", ("y", "2", 6), ("y", "late", 4), ("x", "2", 9)) == [("x", "2", 9), ("y", "2", 6)]


def test_slugs_become_names(spark):
    slugs = {"eng-premier.1": "Eng Premier.1", "fd.e0": "Fd.E0", "nba": "Nba", "": ""}
    rows = spark.createDataFrame([(k,) for k in slugs], "s string").select("s", feeds.titled(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in rows} == slugs
