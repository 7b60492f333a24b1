"""Centroid clustering by delta Lloyd rounds: assignments and sums persist, and a round moves only what changed.

A vector whose centroid stood still, or came no further away, is compared with the centroids that moved alone: all others
were no nearer before and are where they were. Vectors that change their owner are taken from one sum and added to the
other; sums of these signed transfers are all that a round shuffles. Vectors are whole numbers and all sums are exact.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrain.llm.staging import bound_batches, staged

#: Doubles count exactly while components are no larger than this, over up to 2**8 of them; larger vectors are compared as Python numbers.
EXACT = float(2**21)
#: Sums cross the shuffle in pieces of so many bits, so that no number of rows overflows one.
LIMB = 30
LONG = 2**63 - 1
#: Rows that one numpy step compares.
STEP = 4096
STATE = "v array<double>, prev int, owner int, distance long"


def usable(v: Column, width: int) -> Column:
    """Whether a vector has ``width`` components, none of them null or not finite."""
    return v.isNotNull() & (F.size(v) == width) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


class Centroids:
    """The centroids as whole numbers, and those that the last round moved."""

    def __init__(self, rows: list[tuple[int, ...]], moved: list[int]) -> None:
        self.rows, self.moved = rows, np.array(sorted(moved), np.int64)
        self.exact = all(abs(x) <= EXACT for c in rows for x in c)
        self.c = np.array(rows, np.float64).reshape(len(rows), -1)

    def distances(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Squared distances of exact vectors from the centroids ``of``."""
        c = self.c[of]
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)

    def assign(self, x: np.ndarray, owner: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, distance): the nearest centroids, the first of equal ones. ``distance`` -1 is not known; as a result it is beyond a long."""
        owner, distance = owner.copy(), distance.copy()
        every = np.arange(len(self.rows))
        small = np.abs(x).max(axis=1, initial=0) <= EXACT if self.exact else np.zeros(len(x), bool)
        for i in np.flatnonzero(~small):
            v = [int(t) for t in x[i]]
            far = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in self.rows]
            owner[i] = min(every, key=lambda k: (far[k], k))
            distance[i] = far[owner[i]] if far[owner[i]] <= LONG else -1
        known = small & (distance >= 0)
        whole = np.flatnonzero(small & ~known)
        at = np.flatnonzero(known)
        if len(at) and len(self.moved):
            d = self.distances(x[at], self.moved)
            column = np.searchsorted(self.moved, owner[at])
            mine = (column < len(self.moved)) & (self.moved[np.minimum(column, len(self.moved) - 1)] == owner[at])  # the owner moved
            now = np.where(mine, d[np.arange(len(at)), np.minimum(column, len(self.moved) - 1)], distance[at])
            away = now > distance[at]
            best = d.argmin(axis=1)
            least, to = d[np.arange(len(at)), best], self.moved[best]
            better = (least < now) | ((least == now) & (to < owner[at]))
            owner[at] = np.where(better, to, owner[at])
            distance[at] = np.where(better, least, now).astype(np.int64)
            whole = np.concatenate([whole, at[away]])
        if len(whole):
            d = self.distances(x[whole], every)
            owner[whole] = d.argmin(axis=1)
            distance[whole] = d.min(axis=1).astype(np.int64)
        return owner, distance


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def assigned(rows: DataFrame, at: Centroids, width: int, scale: float | None) -> DataFrame:
    """Rows (id, v, prev, owner, distance) under new centroids; ``scale`` turns raw vectors into whole numbers first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, STEP):
                batch = whole.slice(a, STEP)
                x, n = matrix(batch.column(1), width), batch.num_rows
                if scale is not None:
                    x = np.floor(scale * x)
                prev = batch.column(2).to_numpy()
                owner, distance = at.assign(x, prev, batch.column(3).fill_null(-1).to_numpy())
                vs = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), vs, pa.array(prev), pa.array(owner.astype(np.int32)), pa.array(distance, mask=distance < 0)], names=["id", "v", "prev", "owner", "distance"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {STATE}")


def limbs(x: int) -> Iterator[tuple[int, int]]:
    """The signed pieces of a whole number, the lowest first."""
    sign, x, i = (-1 if x < 0 else 1), abs(x), 0
    while x:
        yield i, sign * (x & ((1 << LIMB) - 1))
        x, i = x >> LIMB, i + 1


def transfers(state: DataFrame, k: int, width: int) -> DataFrame:
    """(cluster, component, limb, total) that owners gain or lose by the vectors that moved; component ``width`` counts vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([matrix(batch.column(0), width), np.ones(batch.num_rows)])
            small = np.abs(x).max(axis=1) <= EXACT
            for column, sign in ((1, -1), (2, 1)):
                who = batch.column(column).to_numpy()
                on = small & (who >= 0)
                part = np.zeros((k, width + 1))
                np.add.at(part, who[on], x[on])
                total += sign * part.astype(np.int64).astype(object)
                for i in np.flatnonzero(~small & (who >= 0)):
                    total[who[i]] += sign * np.array([int(t) for t in x[i]], object)
        rows = [(c, i, j, part) for (c, i), x in np.ndenumerate(total) if x for j, part in limbs(int(x))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "component", "limb", "total"])

    moved = state.where("prev <> owner").select("v", "prev", "owner")
    return moved.mapInArrow(run, "cluster int, component int, limb int, total long").groupBy("cluster", "component", "limb").agg(F.sum("total").alias("total"))


def delta_lloyd(vectors: DataFrame, *, k: int = 16, rounds: int = 3, scale: float = 64, width: int = 64, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Clusters of the vectors floor(scale * x) of ``width`` components after ``rounds`` updates of ``k`` centroids.

    Centroids start as the vectors with the smallest sha256 of ``seed:id``, in that order (equal ids by vector, null
    ids last). A round assigns each vector to the nearest centroid by squared distance, the first of equal ones, and
    moves each centroid that owns vectors to floor(sum / count) by component. Then vectors are assigned once more.
    Vectors of another length, or with a null or non-finite component, take no part; rows that repeat are vectors of
    their own. With fewer than ``k`` vectors there are fewer centroids; an empty table gives an empty result. Other
    columns are ignored. ``scale`` is a power of two, so that the product is exact. Only centroids and their sums, ``k``
    rows, come to the driver. Returns id, cluster, distance, cluster_inertia, inertia (sums of distances; null
    where a long cannot hold it), centroid_sha256 (of the final components joined by ``,``).
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    raw = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v"), width))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last()
    start = raw.orderBy(order, "v").limit(k).collect()
    if not start:
        return raw.select("id", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string")))).withColumnRenamed("id", id_col).limit(0)
    rows = [tuple(int(x) for x in np.floor(scale * np.array(r["v"]))) for r in start]
    at = Centroids(rows, range(len(rows)))
    fresh = raw.select("id", "v", F.lit(-1).alias("prev"), F.lit(None).cast("long").alias("distance"))
    state = staged(assigned(fresh, at, width, scale), "clusters")
    sums = None
    for _ in range(rounds):
        gained = transfers(state, len(rows), width)
        sums = staged(gained if sums is None else sums.union(gained).groupBy("cluster", "component", "limb").agg(F.sum("total").alias("total")), "sums")
        total: dict[tuple[int, int], int] = defaultdict(int)
        for c, i, j, x in sums.collect():  # at most k * (width + 1) numbers
            total[c, i] += x << (LIMB * j)
        new = [tuple(total[c, i] // total[c, width] for i in range(width)) if total[c, width] else old for c, old in enumerate(at.rows)]
        at = Centroids(new, [c for c, old in enumerate(at.rows) if new[c] != old])
        if not len(at.moved):
            break
        state = staged(assigned(state.select("id", "v", F.col("owner").alias("prev"), "distance"), at, width, None), "clusters")
    found = {r["owner"]: r for r in state.groupBy("owner").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.count("*").alias("n"), F.count("distance").alias("known")).collect()}
    exact = lambda x, whole: int(x) if whole and x <= LONG else None
    whole = all(r["n"] == r["known"] for r in found.values())
    inertia = exact(sum(r["d"] or 0 for r in found.values()), whole)
    facts = [(c, exact(r["d"] or 0, r["n"] == r["known"]), inertia, hashlib.sha256(",".join(map(str, at.rows[c])).encode()).hexdigest()) for c, r in sorted(found.items())]
    info = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select(F.col("id").alias(id_col), F.col("owner").alias("cluster"), "distance").join(F.broadcast(info), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
