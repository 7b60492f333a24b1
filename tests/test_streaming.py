"""A stream of scoreboards: upserted events, replaced sides, and the same tables when it goes on later."""

import json

from matchgrain.streaming import refresh

SCHEMA = "payload string, ingested timestamp"


def payload(event, state, *teams):
    return json.dumps({"id": event, "date": "2023-01-02T03:04Z", "status": {"type": {"state": state}}, "competitions": [{"competitors": [{"team": {"id": t}} for t in teams]}]})


def test_scoreboards_refresh_tables(spark, tmp_path):
    feed, folder = tmp_path / "feed", f"{tmp_path}/tables"

    def arrive(name, rows):
        feed.mkdir(exist_ok=True)
        (feed / name).write_text("".join(json.dumps({"payload": p, "ingested": f"2023-01-02T00:00:0{k}"}) + "\n" for k, p in enumerate(rows)))
        refresh.refresh_scoreboard(spark.readStream.schema(SCHEMA).json(str(feed)), folder, f"{tmp_path}/checkpoint").awaitTermination()

    def tables(n):
        read = lambda t: spark.read.parquet(f"{folder}/version={n}/{t}")
        return sorted((r.event_id, r.status) for r in read("events").collect()), sorted((r.event_id, r.team_id) for r in read("competitors").collect())

    arrive("a.json", [payload("1", "pre", "5", "6"), payload("2", "pre", "7", "8"), payload("1", "in", "5", "6"), "broken"])
    assert tables(0) == ([("1", "in_progress"), ("2", "scheduled")], [("1", "5"), ("1", "6"), ("2", "7"), ("2", "8")])
    arrive("b.json", [payload("2", "post", "9"), payload("3", "pre")])
    assert tables(1) == ([("1", "in_progress"), ("2", "final"), ("3", "scheduled")], [("1", "5"), ("1", "6"), ("2", "9")])
