"""Hard negatives by one-dimensional distance keys.

Vectors x of one band of norms get one more component, sqrt(M**2 - |x|**2) with the band's largest norm M, so that all of
them lie on a sphere and the inner product with a query q falls as the distance from (q, 0) grows: distance**2 =
|q|**2 + M**2 - 2 * q * x. Pivots on the sphere, from a bounded sample, own the vectors nearest to them, and the index
holds all vectors sorted by (pivot, distance to it). Vectors of a score of at least s lie within the radius
r = sqrt(|q|**2 + M**2 - 2 * s) of the query, so their keys lie within r of the query's own distance from the pivot. A query
scans the blocks of its key intervals, and lowers s until its windows hold their top k at scores of at least s, or s has
come to a window's end. What was not scanned scores less than s, which certifies the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchgrain.llm.staging import bound_batches, staged

#: Ratio of the largest to the smallest norm of a band; pivots of vectors of one length.
BAND, PIVOTS = 1.25, 32
#: Rows of the sample that pivots and first scores are taken from.
SAMPLE = 4096
#: Most bytes of vectors of a block, and scores that a task computes at once.
BLOCK_BYTES, PAIRS = 8_000_000, 2_000_000
#: Doubles add up exactly below this; larger products are taken of Python numbers.
EXACT = 2.0**53
#: The ends of a long, at which scores stop, with room below and above for windows without an end.
LOW, HIGH = -(2**63) + 2, 2**63 - 3
NONE, ALL = -(2**63), 2**63 - 1
#: Keys are rounded doubles: intervals are this much wider, as a share of the band's norm.
SLACK = 1e-6


def rows_by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each vector length."""
    widths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(widths) - widths
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        yield at, flat[starts[at][:, None] + np.arange(w)]


def vector_array(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def norms(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, initial=0)
    safe = np.where(top > 0, top, 1)
    return top * np.sqrt(((x / safe[:, None]) ** 2).sum(axis=1))


def bands(x: np.ndarray) -> np.ndarray:
    """The band of each norm; -1 of zero vectors. Vectors are whole numbers, so other norms are at least 1."""
    n = norms(x)
    return np.where(n > 0, np.floor(np.log(np.maximum(n, 1)) / np.log(BAND)), -1).astype(np.int64)


def band_norm(band: np.ndarray) -> np.ndarray:
    """The largest norm of a band."""
    return np.where(band >= 0, BAND ** (band + 1.0) * (1 + 1e-9), 0.0)


def to_pivots(x: np.ndarray, pivots: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Distances of vectors (extended to the norm ``top``) from each pivot on the sphere of that norm."""
    at = np.maximum(top, 1e-300)[:, None]
    return top[:, None] * np.sqrt(np.maximum(2 - 2 * (x / at) @ pivots.T, 0))


def query_distances(q: np.ndarray, pivots: np.ndarray, top: float) -> np.ndarray:
    """Distances of (q, 0) from each pivot on the sphere of norm ``top``."""
    return np.sqrt(np.maximum((norms(q) ** 2)[:, None] + top**2 - 2 * top * (q @ pivots.T), 0))


def radius(size: np.ndarray, top: float, score: np.ndarray, pad: np.ndarray) -> np.ndarray:
    """Within which distance of queries (their squared norms ``size``) all vectors of at least a score lie; -1 if there can be none."""
    square = size + top * top - 2 * score
    return np.where(square >= -pad * (top + 1), np.sqrt(np.maximum(square, 0)), -1.0)


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """Unit vectors, up to ``n``: the directions of rows each far from those before it."""
    size = norms(x)
    unit = x[size > 0] / size[size > 0][:, None]
    if not len(unit):
        return np.zeros((1, x.shape[1]))
    chosen, near = [0], unit @ unit[0]
    while len(chosen) < n:
        at = int(near.argmin())
        if near[at] > 1 - 1e-9:
            break
        chosen.append(at)
        near = np.maximum(near, unit @ unit[at])
    return unit[chosen]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products as longs; beyond a long they stop at LOW and HIGH."""
    if not q.shape[1]:
        return np.zeros((len(q), len(x)), np.int64)
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < EXACT:
        return (q @ x.T).astype(np.int64)
    a, b = (np.array([[int(t) for t in row] for row in m], object).reshape(m.shape) for m in (q, x))
    return np.array([[min(max(int(s), LOW), HIGH) for s in row] for row in a @ b.T], np.int64).reshape(len(q), len(x))


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest scores, equal ones by id."""
    at = np.arange(len(score))
    if len(at) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((ids[at], -score[at]))][:k]


class Index:
    """All vectors, sorted by (length, band, pivot, key) in written blocks, and what a bounded sample says of them."""

    def __init__(self, rows: DataFrame) -> None:
        """``rows`` has id, label, v: whole numbers as doubles."""
        spark = rows.sparkSession
        bound_batches(spark)
        self.size = rows.count()
        taken = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
        self.sample: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in {len(r["v"]) for r in taken}:
            of = [r for r in taken if len(r["v"]) == w]
            self.sample[w] = np.array([r["label"] for r in of]), np.array([r["v"] for r in of]).reshape(len(of), w)
        self.pivots = {w: spread(x, PIVOTS) for w, (_, x) in self.sample.items()}
        known = spark.sparkContext.broadcast(self.pivots)

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, x in rows_by_width(batch.column(2)):
                    w, n = x.shape[1], len(x)
                    band, some = bands(x), batch.take(pa.array(at))
                    far = to_pivots(x, known.value.get(w, np.zeros((1, w))), band_norm(band))
                    pivot = far.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, w, np.int32)), pa.array(band.astype(np.int32)), pa.array(pivot.astype(np.int32)), pa.array(far[np.arange(n), pivot]), *some.columns], names=["w", "band", "pivot", "key", "id", "label", "v"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, held, last = TaskContext.get().partitionId() << 32, 0, None
            for batch in batches:
                code = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
                own = []
                for c in code:
                    held += 1
                    if c != last or held * 8 * max(1, c[0]) > BLOCK_BYTES:
                        block, held, last = block + 1, 1, c
                    own.append(block)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *batch.columns], names=["block", *batch.schema.names])

        kinds = "w int, band int, pivot int, key double, id long, label long, v array<double>"
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        order = ["w", "band", "pivot", "key", "id"]  # ids too, so that equal vectors spread over partitions
        keyed = rows.select("id", "label", "v").mapInArrow(key, kinds)
        self.rows = staged(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(cut, f"block long, {kinds}"), "index")
        self.blocks = staged(self.rows.groupBy("block", "w", "band", "pivot").agg(F.min("key").alias("low"), F.max("key").alias("high")), "blocks")
        self.bands: dict[int, list[int]] = {}
        for w, band in sorted(self.blocks.select("w", "band").distinct().collect()):  # a few hundred at most: bands are powers of BAND
            self.bands.setdefault(w, []).append(band)

    def search(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """(qid, win, id, score, rank): the k largest scores of each window of each query, ties to the smaller id.

        ``queries`` has qid, label, v, tops and floors: windows floor <= score <= top over rows of the query's label if
        ``same``, else of other labels, without the row ``qid`` itself.
        """
        spark = queries.sparkSession
        index, rank = spark.sparkContext.broadcast((self.sample, self.pivots, self.bands)), max(1, -(-2 * k * SAMPLE // max(self.size, 1)))
        empty = self.rows.limit(0).select(F.col("id").alias("qid"), F.lit(0).alias("win"), "id", F.lit(0).cast("long").alias("score"))
        seed = Guess(self.sample)

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = [seed.least(np.array(v, float), label, tops, floors, same, rank) for label, v, tops, floors in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.int64())], names=[*batch.schema.names, "s"])

        shape = "qid long, label long, v array<double>, tops array<long>, floors array<long>, s long"
        asked = staged(queries.select("qid", "label", "v", "tops", "floors").mapInArrow(first, shape), "queries")
        active = asked.withColumn("before", F.lit(ALL))  # scores from ``before`` on have been scanned
        found = empty
        while not active.isEmpty():
            found = staged(top_k(found.union(self.scan(active, index, same, k)), k).drop("rank"), "found")
            held = found.groupBy("qid", "win").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
            each = active.select("qid", "s", F.posexplode(F.arrays_zip("tops", "floors")).alias("win", "w")).select("qid", "s", "win", "w.floors").join(held, ["qid", "win"], "left")
            # a window is open while unscanned scores may be in its top k; its kth score so far bounds what can be
            full = F.coalesce("n", F.lit(0)) >= k
            open_ = (F.col("s") > F.col("floors")) & (~full | (F.col("kth") < F.col("s")))
            need = each.where(open_).groupBy("qid").agg(F.min(F.greatest("floors", F.when(full, F.col("kth")).otherwise(F.lit(NONE)))).alias("need"))
            active = staged(active.join(need, "qid").withColumns({"before": F.col("s"), "s": F.col("need")}).drop("need"), "open")
        return top_k(found, k)

    def scan(self, active: DataFrame, index, same: bool, k: int) -> DataFrame:
        """(qid, win, id, score) of the k best rows in each block that a query's new key intervals meet."""

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, pivots, all_bands = index.value
            for whole in batches:
                for a in range(0, whole.num_rows, 256):
                    batch = whole.slice(a, 256)
                    s, before = (batch.column(i).to_numpy().astype(np.float64) for i in (5, 6))
                    top = np.array([max(t) for t in batch.column(3).to_pylist()], np.float64)
                    for at, q in rows_by_width(batch.column(2)):
                        size = norms(q) ** 2
                        for band in all_bands.get(q.shape[1], ()):
                            m = float(band_norm(np.array([band]))[0])
                            from_pivots = query_distances(q, pivots.get(q.shape[1], np.zeros((1, q.shape[1]))), m)
                            pad = SLACK * (m + np.sqrt(size)) + 1e-9
                            outer, done, inner = (radius(size, m, score[at], pad) for score in (s, np.where(before >= float(ALL), np.inf, before), top))
                            i, p = np.nonzero(np.broadcast_to((outer >= 0)[:, None], from_pivots.shape))
                            d = from_pivots[i, p]
                            some = batch.take(pa.array(at[i]))
                            value = [d - outer[i] - pad[i], d + outer[i] + pad[i], np.where(done[i] >= 0, d - done[i] - pad[i], np.inf), np.where(done[i] >= 0, d + done[i] + pad[i], -np.inf), inner[i] - d - pad[i]]
                            n = len(i)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(n, q.shape[1], np.int32)), pa.array(np.full(n, band, np.int32)), pa.array(p.astype(np.int32)), *map(pa.array, value), *some.columns[:5]],
                                names=["w", "band", "pivot", "from", "to", "was_from", "was_to", "inside", "qid", "label", "v", "tops", "floors"],
                            )

        query = "qid long, label long, v array<double>, tops array<long>, floors array<long>"
        probes = active.select("qid", "label", "v", "tops", "floors", "s", "before").mapInArrow(reach, f"w int, band int, pivot int, `from` double, `to` double, was_from double, was_to double, inside double, {query}")
        # a block is scanned if it meets the new interval, has not met an earlier one, and is not wholly nearer than any window begins
        new = (F.col("high") >= F.col("from")) & (F.col("low") <= F.col("to")) & ~((F.col("high") >= F.col("was_from")) & (F.col("low") <= F.col("was_to"))) & (F.col("high") >= F.col("inside"))
        asked = probes.join(self.blocks, ["w", "band", "pivot"]).where(new).select("block", F.lit(1).alias("kind"), "qid", "label", "v", "tops", "floors")
        held = self.rows.select("block", F.lit(0).alias("kind"), F.col("id").alias("qid"), "label", "v", *(F.lit(None).cast("array<long>").alias(c) for c in ("tops", "floors")))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, ids, labels, x = None, [], [], []
            for batch in batches:
                key = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(key)) + 1), len(key)] if len(key) else [0]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    piece, own = batch.slice(a, b - a), key[a] // 2
                    if own != block:
                        block, ids, labels, x = own, [], [], []
                    (_, v), *_ = rows_by_width(piece.column(4))  # one length a block
                    if key[a] % 2 == 0:
                        ids.append(piece.column(2).to_numpy())
                        labels.append(piece.column(3).to_numpy())
                        x.append(v)
                    elif ids:
                        ids, labels, x = [np.concatenate(ids)], [np.concatenate(labels)], [np.concatenate(x)]
                        yield from scores(piece, v, ids[0], labels[0], x[0])

        def scores(piece: pa.RecordBatch, v: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            qids, own = piece.column(2).to_numpy(), piece.column(3).to_numpy()
            tops, floors = piece.column(5).to_pylist(), piece.column(6).to_pylist()
            step = max(1, PAIRS // len(x))
            for a in range(0, len(v), step):
                score, out = products(v[a : a + step], x), []
                for i, row in enumerate(score, a):
                    fits = np.flatnonzero(((labels == own[i]) == same) & (ids != qids[i]) & (row >= min(floors[i])) & (row <= max(tops[i])))
                    some = row[fits]
                    for win, (top, floor) in enumerate(zip(tops[i], floors[i], strict=True)):
                        on = fits[(some >= floor) & (some <= top)]
                        at = on[best(row[on], ids[on], k)] if len(on) else on
                        out.append((np.full(len(at), qids[i]), np.full(len(at), win, np.int32), ids[at], row[at]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["qid", "win", "id", "score"])

        both = held.union(asked).repartition("block").sortWithinPartitions("block", "kind")
        return both.mapInArrow(compare, "qid long, win int, id long, score long")


class Guess:
    """First scores to search down to, from the sample."""

    def __init__(self, sample: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        self.sample = sample

    def least(self, q: np.ndarray, label: int, tops: list[int], floors: list[int], same: bool, rank: int) -> int:
        """The least, over the windows, of the score that ``rank`` sampled rows of the window reach; a window's end if not so many do."""
        labels, x = self.sample.get(len(q), (np.zeros(0, np.int64), np.zeros((0, len(q)))))
        score = np.sort(products(q[None], x[(labels == label) == same])[0])
        out = []
        for top, floor in zip(tops, floors, strict=True):
            n = int(np.searchsorted(score, top, side="right"))
            out.append(max(floor, int(score[n - rank]) if n >= rank else NONE))
        return min(out)


def top_k(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid", "win").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def whole_vectors(rows: DataFrame, scale: float) -> DataFrame:
    """(id, label, v) with v = floor(scale * v) as whole doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in rows_by_width(batch.column(2)):
                some = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), vector_array(np.floor(scale * x) + 0.0)], names=["id", "label", "v"])

    return rows.select("id", "label", "v").mapInArrow(run, "id long, label long, v array<double>")


def hard_negatives(vectors: DataFrame, *, anchor_every: int = 100, positives: int = 5, negatives: int = 5, least_percent: int = 80, scale: float = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """For each anchor and each of its positives the nearest rows of other labels in a window below the positive's score.

    Vectors become floor(scale * x); scores are integer inner products, larger first, ties to the smaller id. Anchors are
    rows whose id is divisible by ``anchor_every``; positives their first rows of the same label; negatives the first rows
    of other labels with least_percent * positive_score <= 100 * score <= 100 * positive_score, so none if the
    positive's score is negative. Rows with a null id or label, or a vector that is null or holds a null or non-finite
    component, take no part. Rows that repeat an id count once (the smallest label, then vector). Vectors of another
    length than the anchor's are no candidates; scores beyond a long stop near its ends. Other columns are ignored; an empty
    table gives an empty result. ``scale`` is a power of two. Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score. The result is exact: the index is searched until what is left cannot matter.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).dropna()
    rows = rows.where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    index = Index(staged(whole_vectors(rows, scale), "vectors"))
    anchors = index.rows.where(F.col("id") % anchor_every == 0).select(F.col("id").alias("qid"), "label", "v")
    every = anchors.withColumns({"tops": F.array(F.lit(ALL)), "floors": F.array(F.lit(NONE))})
    near = staged(index.search(every, True, positives).select("qid", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    least = lambda p: -F.floor(-p * F.lit(least_percent).cast("decimal(20,0)") / 100)
    ends = near.where("positive_score >= 0").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", F.col("positive_score").alias("top"), least(F.col("positive_score")).cast("long").alias("floor")))).alias("ends"))
    windows = anchors.join(ends, "qid").select("qid", "label", "v", F.transform("ends", lambda e: e["top"]).alias("tops"), F.transform("ends", lambda e: e["floor"]).alias("floors"))
    far = index.search(windows, False, negatives).select("qid", (F.col("win") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return far.join(near, ["qid", "place"]).select(F.col("qid").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
