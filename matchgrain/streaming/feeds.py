"""All feeds refreshed from landed payloads: one stream each, retried by batch, so that a failing feed stops no other."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from matchgrain.operators import value
from matchgrain.sources import feeds, merge, reports
from matchgrain.streaming.store import Change, Store, created, replaced, upserted

LANDED = "league string, payload string, ingested timestamp"
TEAMS = "league string, team_id string"


@dataclass
class Feed:
    """``step`` turns a batch of payloads (league, payload, ingested) and the store into changes; ``every`` is how often it runs."""

    step: Callable[[DataFrame, Store], dict[str, Change]]
    every: str


def known_teams(store: Store) -> DataFrame:
    held = store.read("teams")
    return store.spark.createDataFrame([], TEAMS) if held is None else held.select("league", "team_id")


def scoreboard(batch: DataFrame, store: Store) -> dict[str, Change]:
    events = feeds.scoreboard(batch)
    last = merge.latest(events.where("not error"), ["event_id"], "ingested")
    facts = events.withColumn("event_id", F.when(~F.col("error"), F.col("event_id"))).drop("competitors", "venue", "error")
    return {"events": upserted(facts, ["event_id"], "ingested"), "competitors": replaced(feeds.competitors(last), last, ["event_id"])}


def titled(slug: Column) -> Column:
    """Every run of letters with a capital first, hyphens as spaces: 'eng-premier.1' is 'Eng Premier.1'."""
    parts = F.split(F.replace(slug, F.lit("-"), F.lit(" ")), r"(?<=[^A-Za-z])")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 2**30)))), "")


def leagues(batch: DataFrame) -> Change:
    """The leagues of a batch that are not known yet, named after their slug."""
    rows = batch.where("league is not null").select("league").distinct()
    return created(rows.select("league", titled(F.col("league")).alias("name"), F.substring(F.upper("league"), 1, 10).alias("abbreviation")), ["league"])


def teams(batch: DataFrame, store: Store) -> dict[str, Change]:
    rows = reports.teams(batch)
    return {"leagues": leagues(batch), "teams": upserted(rows.drop("error").withColumn("team_id", F.nullif("team_id", F.lit(""))), ["league", "team_id"], "ingested")}


def news(batch: DataFrame, store: Store) -> dict[str, Change]:
    rows = feeds.articles(batch).withColumn("ingested", F.coalesce("last_modified", "published", F.lit(0).cast("timestamp")))
    return {"articles": upserted(rows.drop("error"), ["article_id"], "ingested", F.col("headline") == "")}


def injuries(batch: DataFrame, store: Store) -> dict[str, Change]:
    """The last payload of a league that has any injury replaces the league's; empty payloads change nothing."""
    rows = reports.injuries(batch, known_teams(store))
    last = rows.groupBy("league").agg(F.max("ingested").alias("ingested"))
    rows = rows.join(last, ["league", "ingested"]).where("not error").drop("error")
    return {"injuries": replaced(rows, last, ["league"])}


def transactions(batch: DataFrame, store: Store) -> dict[str, Change]:
    """Those with an id replace the one of that id; each of those without one is a row of its own, under a key of the row itself."""
    rows = reports.transactions(batch, known_teams(store)).drop("error")
    own = F.concat(F.lit("row-"), F.sha2(F.to_json(F.struct(*rows.columns)), 256))
    return {"transactions": upserted(rows.withColumn("key", F.coalesce("transaction_id", own)), ["league", "key"], "ingested", F.col("description") == "")}


def odds(batch: DataFrame, store: Store) -> dict[str, Change]:
    """Prices by event, provider, market, selection and line; a payload is {"event": id, "odds": the provider entries}.

    A payload that cannot be read, or has no event or entries, is one error and stops nothing.
    """
    rows = batch.select("league", "ingested", F.get_json_object("payload", "$.event").alias("match_id"), F.get_json_object("payload", "$.odds").alias("payload"))
    readable = F.col("match_id").isNotNull() & F.coalesce(F.get_json_object("payload", "$.items").startswith("["), F.lit(False))
    priced = value.parse_payloads(rows.where(readable))
    bad = rows.where(~readable).select("league", "ingested")
    return {"odds": upserted(priced.unionByName(bad, allowMissingColumns=True), ["match_id", "provider", "market", "selection", "line"], "ingested")}


FEEDS = {"teams": Feed(teams, "1 day"), "scoreboard": Feed(scoreboard, "1 minute"), "news": Feed(news, "15 minutes"), "injuries": Feed(injuries, "1 hour"), "transactions": Feed(transactions, "1 hour"), "odds": Feed(odds, "15 minutes")}


def refresh(spark: SparkSession, landed: str, folder: str, checkpoints: str, names: list[str] | None = None, once: bool = True, retries: int = 2, wait_seconds: float = 1.0, registry: dict[str, Feed] | None = None) -> dict[str, dict]:
    """Run the named feeds (all by default), each over the JSON lines under ``landed/<feed>`` into a store ``folder/<feed>``.

    ``once`` takes what has landed and ends; else feeds run every ``every`` until they are stopped. A batch that fails is
    tried ``retries`` times more before its stream fails; other feeds go on. Feeds that read teams use the last version of
    the teams' store. Returns for each feed the counts of its tables over the batches of this run, and its error or None.
    """
    registry = registry or FEEDS
    told: dict[str, dict] = {}
    streams = {}
    for name in names or list(registry):
        feed, out = registry[name], told.setdefault(name, {"counts": {}, "error": None})
        store = Store(spark, f"{folder}/{name}")
        if name != "teams":
            teams_store = Store(spark, f"{folder}/teams")
            store.read = lambda t, *a, own=store, other=teams_store, **k: Store.read(other if t == "teams" else own, t, *a, **k)

        def write(batch: DataFrame, n: int, feed: Feed = feed, store: Store = store, out: dict = out) -> None:
            for left in range(retries, -1, -1):
                try:
                    done = store.apply(n, feed.step(batch, store))
                    break
                except Exception:
                    if not left:
                        raise
                    time.sleep(wait_seconds)
            for table, counts in done.items():
                sums = out["counts"].setdefault(table, dict.fromkeys(counts, 0))
                for k, v in counts.items():
                    sums[k] += v

        rows = spark.readStream.schema(LANDED).json(f"{landed}/{name}")
        trigger = {"availableNow": True} if once else {"processingTime": feed.every}
        streams[name] = rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoints}/{name}").trigger(**trigger).start()
        if name == "teams" and once:  # the others look teams up
            wait(streams.pop(name), out)
    for name, stream in streams.items():
        if once:
            wait(stream, told[name])
    return told


def wait(stream, out: dict) -> None:
    try:
        stream.awaitTermination()
    except Exception as error:  # noqa: BLE001  of this feed alone, and told
        out["error"] = str(error)


def latest_payloads(stream: DataFrame, key: str, payload: str = "payload", at: str = "ingested", late_seconds: int = 86_400) -> DataFrame:
    """A stream of (key, payload, at) with each payload that is newer than all before it and other than the last of its key.

    Late and repeated payloads are dropped, over batches too, as the last one of each key is state; a key's state is
    forgotten when the watermark has passed its last payload by ``late_seconds``, and what is later than that does not count.
    """
    shape = f"{key} string, {payload} string, {at} timestamp"

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, text = state.get if state.exists else (None, None)
        out = []
        rows = pd.concat(list(frames), ignore_index=True).sort_values([at, payload], kind="stable")
        for value, when in zip(rows[payload], rows[at], strict=True):
            if last is None or when.value > last:
                if value != text:
                    out.append((keys[0], value, when))
                last, text = when.value, value
        state.update((last, text))
        state.setTimeoutTimestamp(max(last // 1_000_000, state.getCurrentWatermarkMs()) + 1 + late_seconds * 1000)
        if out:
            yield pd.DataFrame(out, columns=[key, payload, at])

    rows = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).cast("string").alias(key), payload, at).withWatermark(at, f"{late_seconds} seconds")
    return rows.groupBy(key).applyInPandasWithState(step, shape, "last long, text string", "append", GroupStateTimeout.EventTimeTimeout)

