"""A versioned store of keyed tables: a batch rewrites the buckets that its keys touch, and a manifest makes it visible."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from matchgrain.sources import merge

MANIFEST = "name string, bucket int, path string"
ACTIONS = ("created", "updated", "errors")


@dataclass
class Change:
    """What a batch does to one table: its rows, the key that deals them into buckets, and how they meet the old ones.

    ``combine(old, new)`` returns the rows of the touched buckets with their ``action`` (created, updated or kept). ``parts``
    are rows whose buckets are touched too, such as parents that have lost all children. ``bad`` marks rows in error.
    """

    rows: DataFrame
    bucket_by: list[str]
    combine: Callable[[DataFrame, DataFrame], DataFrame]
    parts: DataFrame | None = None
    bad: Column | None = None


def upserted(rows: DataFrame, keys: list[str], at: str, bad: Column | None = None) -> Change:
    """The last row of each key by time replaces the old one; rows without a key, or marked bad, are errors."""
    wrong = F.lit(False) if bad is None else F.coalesce(bad, F.lit(False))
    for k in keys:
        wrong = wrong | F.col(k).isNull()
    return Change(rows, keys, lambda old, new: merge.upsert(old, new, keys, at), bad=wrong)


def created(rows: DataFrame, keys: list[str]) -> Change:
    """Rows whose key is not there yet are added, each key once; others change nothing."""
    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").withColumn("action", F.lit("created"))
        return fresh.unionByName(old.withColumn("action", F.lit("kept")))

    return Change(rows, keys, combine)


def replaced(rows: DataFrame, parts: DataFrame, by: list[str]) -> Change:
    """The rows of each part (a parent, a snapshot) are the new ones alone; a part without rows loses its old ones."""
    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        of = lambda df, action: df.withColumn("action", F.lit(action))
        return of(new, "created").unionByName(of(old.join(parts.select(*by).distinct(), by, "left_anti"), "kept"))

    return Change(rows, by, combine, parts=parts)


class Store:
    """Tables under a folder that driver and executors share. Readers see the last committed version, whole.

    A bucket is a folder of Parquet files named by version; a version's manifest lists the bucket folders of all tables and
    is written last, so a batch that dies leaves the version before it readable, and runs again under its number. Of
    versions the last ``keep`` stay, others go with the buckets that only they name. A manifest has at most ``buckets``
    rows for each table.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, keep: int = 2) -> None:
        self.spark, self.folder, self.buckets, self.keep = spark, folder.rstrip("/"), buckets, keep
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def children(self, folder: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(folder))) if self.fs.exists(self.path(folder)) else []

    def drop(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def versions(self) -> list[int]:
        """The committed versions."""
        return sorted(int(x) for x in self.children(f"{self.folder}/manifests") if self.fs.exists(self.path(f"{self.folder}/manifests/{x}/_SUCCESS")))

    def manifest(self, version: int | None) -> dict[tuple[str, int], str]:
        if version is None:
            return {}
        return {(r["name"], r["bucket"]): r["path"] for r in self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifests/{version}").collect()}

    def read(self, name: str, version: int | None = None, buckets: set[int] | None = None) -> DataFrame | None:
        """A table as of a version, by default the last one; of some buckets only if given; None if it has none there."""
        version = max(self.versions(), default=None) if version is None else version
        paths = [p for (t, b), p in sorted(self.manifest(version).items()) if t == name and (buckets is None or b in buckets)]
        return self.spark.read.parquet(*paths) if paths else None

    def bucket(self, keys: list[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def apply(self, version: int, changes: dict[str, Change]) -> dict[str, dict[str, int]]:
        """Make ``version`` from the one before it and the changes; counts (created, updated, errors, total) of each table.

        A version that is already committed is made anew. Counts are observed in the pass that writes.
        """
        base = max((v for v in self.versions() if v < version), default=None)
        entries, counts = self.manifest(base), {}
        for name, change in changes.items():
            for left in self.children(f"{self.folder}/data/{name}"):  # of a batch that died
                if left.startswith(f"v{version}-"):
                    self.drop(f"{self.folder}/data/{name}/{left}")
            bad = F.lit(False) if change.bad is None else change.bad
            dealt = lambda df: df.withColumn("_bucket", self.bucket(change.bucket_by))  # noqa: B023, E731
            good = change.rows.where(~bad)
            keyed = good.select(*change.bucket_by) if change.parts is None else good.select(*change.bucket_by).union(change.parts.select(*change.bucket_by))
            touched = {r["_bucket"] for r in dealt(keyed).select("_bucket").distinct().collect()}
            old = self.read(name, base, touched) if touched and base is not None else None
            merged = change.combine(good.limit(0) if old is None else old, good)
            merged = merged.unionByName(change.rows.where(bad).withColumn("action", F.lit("errors")))
            seen = Observation()
            count = lambda a: F.count(F.when(F.col("action") == a, 1)).alias(a)
            out = dealt(merged.observe(seen, *map(count, ACTIONS)).where("action <> 'errors'").drop("action"))
            path = f"{self.folder}/data/{name}/v{version}-{uuid.uuid4().hex}"
            out.repartition("_bucket").write.partitionBy("_bucket").parquet(path)
            counts[name] = {a: seen.get[a] for a in ACTIONS}
            counts[name]["total"] = sum(counts[name].values())
            entries = {(t, b): p for (t, b), p in entries.items() if t != name or b not in touched}
            entries |= {(name, int(x.split("=")[1])): f"{path}/{x}" for x in self.children(path) if x.startswith("_bucket=")}
        rows = self.spark.createDataFrame([(t, b, p) for (t, b), p in entries.items()], MANIFEST)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifests/{version}")
        self.expire(version)
        return counts

    def expire(self, version: int) -> None:
        """Drop versions beyond the last ``keep`` and the bucket folders that only they name."""
        known = [v for v in self.versions() if v <= version]
        kept = {p for v in known[-self.keep :] for p in self.manifest(v).values()}
        for v in known[: -self.keep]:
            for p in set(self.manifest(v).values()) - kept:
                self.drop(p)
            self.drop(f"{self.folder}/manifests/{v}")
