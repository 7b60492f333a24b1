"""Idempotent sinks: upserts by natural key, snapshot replacement, and counts of what a batch did."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last row of each key by time; one aggregate with map-side combine, no sort."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), at).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in others)).select(rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], at: str | None = None, optional: str | None = None) -> DataFrame:
    """The rows of ``new`` and those of ``old`` whose key is not among them, with the action that each row went through.

    Of several rows of a key in ``new`` the last by ``at`` counts or, without it, the one whose values sort last; the
    aggregate leaves rows by key, as the joins need them. A row with a null key is an error row and is left out; only the
    key ``optional`` may be null, and each row without it is a new row of its own.
    """
    named = new.dropna(subset=keys)
    others = [c for c in new.columns if c not in keys]
    if others:
        row = F.struct(*others)
        named = named.groupBy(*keys).agg((F.max_by(row, at) if at else F.max(row)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in others)).select(new.columns)
    else:
        named = named.distinct()
    old_keys = old.select(*keys).withColumn("_was", F.lit(1))
    written = named.join(old_keys, keys, "left").withColumn("action", F.when(F.col("_was").isNull(), "created").otherwise("updated")).drop("_was")
    out = written.unionByName(old.join(named.select(*keys), keys, "left_anti").withColumn("action", F.lit("kept")))
    if optional is None:
        return out
    blank = new.dropna(subset=[k for k in keys if k != optional]) if len(keys) > 1 else new
    return out.unionByName(blank.where(F.col(optional).isNull()).withColumn("action", F.lit("created")))


def replace_snapshot(old: DataFrame, new: DataFrame, part: list[str]) -> DataFrame:
    """Old rows, but for each part that ``new`` has, the new ones alone; an empty batch changes nothing."""
    return new.unionByName(old.join(new.select(*part).distinct(), part, "left_anti"))


def replace_children(old: DataFrame, new: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """The children of ``parents`` are the new ones alone, none of them too; other parents keep theirs."""
    return new.unionByName(old.join(parents.select(*keys).distinct(), keys, "left_anti"))


def counts(merged: DataFrame) -> DataFrame:
    """Rows created, updated and kept."""
    return merged.groupBy("action").count()
