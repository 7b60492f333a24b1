"""Scoreboards as a stream: each batch upserts its events and replaces their sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from matchgrain.sources import feeds, merge


def versioned(stream: DataFrame, folder: str, checkpoint: str, step: Callable[[DataFrame, dict[str, DataFrame] | None], dict[str, DataFrame]]) -> StreamingQuery:
    """Run ``step`` over each batch and the tables of the version before; it returns the tables of the next version.

    Batch n reads version n - 1 and overwrites version n, so a batch that is run again after a failure gives the
    same tables. The tables ``step`` returns must have the same names in every batch. Older versions stay.
    """
    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = f"{folder}/version={n - 1}"
        held = spark.read.parquet(f"{before}/names").collect() if n else []  # one row for each table
        tables = step(batch, {r["name"]: spark.read.parquet(f"{before}/{r['name']}") for r in held} or None)
        for name in tables:
            tables[name].write.mode("overwrite").parquet(f"{folder}/version={n}/{name}")
        spark.createDataFrame([(x,) for x in tables], "name string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/version={n}/names")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scoreboard_step(batch: DataFrame, old: dict[str, DataFrame] | None) -> dict[str, DataFrame]:
    """Events by id, the last payload of a batch standing for its event, and the sides of those events alone.

    ``batch`` has a payload and its time of ingestion. Payloads without an event id are left out.
    """
    events = merge.latest(feeds.scoreboard(batch).where("not error"), ["event_id"], "ingested")
    sides, facts = feeds.competitors(events), events.drop("competitors", "venue", "error")
    if old:
        sides = merge.replace_children(old["competitors"], sides, events, ["event_id"])
        facts = merge.upsert(old["events"], facts, ["event_id"]).drop("action")
    return {"events": facts, "competitors": sides}


def refresh_scoreboard(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return versioned(stream, folder, checkpoint, scoreboard_step)
