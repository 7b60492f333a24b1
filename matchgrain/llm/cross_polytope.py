"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchgrain.llm.staging import bound_batches, staged

#: Bytes of vectors that one part of a table holds about; heavier parts are salted.
PART_BYTES = 8_000_000
#: Queries that a task compares at once, and scored pairs that it keeps before it cuts them to the best.
QUERY_ROWS, PAIRS = 1_000, 1_000_000
#: Ratio of the largest to the smallest norm of one band.
BAND = 1.25
#: Lengths of vectors with fewer sampled rows are searched whole.
LEAST_SAMPLE = 64


def pseudo_rotation(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform; the width must be a power of two."""
    rng, d = np.random.default_rng(seed), x.shape[1]
    for _ in range(3):
        x = x * rng.choice([-1.0, 1.0], d)
        h = 1
        while h < d:
            y = x.reshape(len(x), -1, 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), d)
            h *= 2
        x = x / np.sqrt(d)
    return x


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors with columns of zeros up to a power of two, norm bands)."""
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    band = np.floor((np.log(top) + np.log(norm))[:, 0] / np.log(BAND)).astype(np.int64)
    return np.pad(x / norm, ((0, 0), (0, width - x.shape[1]))), band


def nearest_axis(y: np.ndarray) -> np.ndarray:
    """The nearest signed axis of rotated vectors: 2 * axis, and 1 more if negative."""
    axis = np.abs(y).argmax(axis=1)
    return axis * 2 + (y[np.arange(len(y)), axis] < 0)


def signed(y: np.ndarray) -> np.ndarray:
    """The product of rotated vectors with each signed axis."""
    return np.stack([y, -y], axis=2).reshape(len(y), -1)


def bucket_codes(x: np.ndarray, tables: int, seed: int) -> np.ndarray:
    """For each row its norm band and, for each table, the nearest axes of two rotations."""
    unit, band = directions(x)
    return np.column_stack([band] + [nearest_axis(pseudo_rotation(unit, seed + t)) for t in range(2 * tables)])


def probe_scores(near: list[np.ndarray], codes: np.ndarray, t: int) -> np.ndarray:
    """How early queries (rows) probe the buckets of ``codes`` (columns) in table t: the band's largest norm times
    the sum of the query's products with both axes."""
    return (near[2 * t][:, codes[:, 1 + 2 * t]] + near[2 * t + 1][:, codes[:, 2 + 2 * t]]) * band_top(codes[:, 0])


def band_top(band: np.ndarray) -> np.ndarray:
    return np.exp(np.clip((band + 1) * np.log(BAND), -700, 700))


def query_products(x: np.ndarray, tables: int, seed: int) -> list[np.ndarray]:
    unit, _ = directions(x)
    return [signed(pseudo_rotation(unit, seed + t)) for t in range(2 * tables)]


def by_width(rows: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each vector length."""
    widths = rows.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.cumsum(np.concatenate([[0], widths[:-1]])) if len(widths) else widths
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        yield at, flat[starts[at][:, None] + np.arange(w)]


class Fit:
    """What the bounded samples say: bucket codes of sampled rows by length, and the share of rows to probe."""

    def __init__(self, codes: dict[int, np.ndarray], tables: int, seed: int) -> None:
        self.codes, self.tables, self.seed, self.share = codes, tables, seed, {}

    def learn(self, w: int, queries: np.ndarray, near: list[np.ndarray], target: float) -> None:
        """The share of rows that each table must probe to meet ``target`` of the true neighbours of ``queries``."""
        codes, need = self.codes.get(w), []
        if codes is None:
            return
        for i, x in enumerate(near):
            products = query_products(queries[i : i + 1], self.tables, self.seed)
            own = bucket_codes(x, self.tables, self.seed)
            best = np.ones(len(x))
            for t in range(self.tables):
                known = np.sort(probe_scores(products, codes, t)[0])
                best = np.minimum(best, 1 - np.searchsorted(known, probe_scores(products, own, t)[0]) / len(known))
            need.append(best)
        self.share[w] = float(np.quantile(np.concatenate(need), target)) if need else 1.0

    def limits(self, w: int, products: list[np.ndarray], least: int) -> np.ndarray:
        """(table, query) the smallest score of a bucket that is probed."""
        codes = self.codes.get(w)
        if codes is None or len(codes) < LEAST_SAMPLE or w not in self.share:
            return np.full((self.tables, len(products[0])), -np.inf)
        n = max(int(np.ceil(self.share[w] * len(codes))), least)
        if n >= len(codes):
            return np.full((self.tables, len(products[0])), -np.inf)
        return np.array([np.partition(probe_scores(products, codes, t), len(codes) - n, axis=1)[:, len(codes) - n] for t in range(self.tables)])


class Part:
    """The rows of one part of a table, sorted by bucket."""

    def __init__(self, batches: list[pa.RecordBatch], fit: Fit, table: int) -> None:
        rows = pa.Table.from_batches(batches).combine_chunks()
        self.ids, vs = rows.column("ids").combine_chunks(), rows.column("v").combine_chunks()
        self.low = self.ids.flatten().to_numpy()[self.ids.offsets.to_numpy()[:-1] - self.ids.offsets[0].as_py()]
        self.table, self.fit, self.widths = table, fit, {}
        for at, x in by_width(vs):
            unit, band = directions(x)
            one, two = (nearest_axis(pseudo_rotation(unit, fit.seed + 2 * table + j)) for j in range(2))
            order = np.lexsort((two, one, band))
            at, x, key = at[order], x[order], np.column_stack([band, one, two])[order]
            cut = np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1
            self.widths[x.shape[1]] = at, x, key[np.concatenate([[0], cut])], np.concatenate([[0], cut, [len(x)]])

    def best(self, queries: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the k best rows for each query among the buckets that it probes."""
        none = np.zeros(0, np.int64)
        if queries.shape[1] not in self.widths:
            return none, none, np.zeros(0)
        at, x, keys, edges = self.widths[queries.shape[1]]
        unit, _ = directions(queries)
        one, two = (np.ascontiguousarray(signed(pseudo_rotation(unit, self.fit.seed + 2 * self.table + j)).T) for j in range(2))
        kept = (none, none, np.zeros(0))
        kth, pairs, held = np.full(len(queries), -np.inf), [], 0

        def cut() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q, r, s = (np.concatenate(c) for c in zip(kept, *pairs, strict=True))
            order = np.lexsort((self.low[at[r]], -s, q))
            q, r, s = q[order], r[order], s[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            kth[q[place == k - 1]] = s[place == k - 1]
            return q[place < k], r[place < k], s[place < k]

        for (_, b1, b2), top, lo, hi in zip(keys, band_top(keys[:, 0]), edges[:-1], edges[1:], strict=True):
            asking = np.flatnonzero((one[b1] + two[b2]) * top >= limit)
            step = max(1, PAIRS // max(1, len(asking)))
            for a in range(lo, hi, step) if len(asking) else ():
                score = queries[asking] @ x[a : min(a + step, hi)].T
                i, j = np.nonzero(score >= kth[asking][:, None])
                pairs.append((asking[i], a + j, score[i, j]))
                held += len(i)
                if held > PAIRS:
                    kept, pairs, held = cut(), [], 0
        q, r, _ = cut()
        return q, at[r], (queries[q] * x[r]).sum(axis=1)


def search(vectors: DataFrame, *, query_every: int = 20, k: int = 20, tables: int = 4, target: float = 0.97, sample: int = 8192, sample_queries: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7) -> DataFrame:
    """The k candidates with the largest inner product for each query, of those that some probed bucket holds.

    Queries are the rows whose id is divisible by ``query_every``; candidates all rows but the query's own. Rows
    with a null id, or a vector that is null, empty, zero or holds a null, NaN or infinity take no part. Rows that
    repeat an id count once (the smallest vector). Vectors of another length than the query's are no candidates.
    Equal vectors are one class that carries its k + 1 smallest ids, which is all that a result can show of it, so
    large groups of copies cost no more than one row. Extra columns are ignored; an empty table gives an empty
    result. Ties go to the smaller id. Returns query_id, rank, vec_id, score.

    A bucket is a band of norms and the nearest signed axes of two pseudo-rotations. A query probes buckets in the
    order of the band's largest norm times the sum of its products with both axes, as far as a share of all rows
    goes. Two bounded samples set this share: ``sample`` rows tell how rows spread over buckets, and the true
    neighbours of ``sample_queries`` rows among all rows tell how far to probe to meet ``target`` of them. Every
    row is indexed. Lengths with few sampled rows are searched whole.
    """
    bound_batches(vectors.sparkSession)
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull()).where(~bad & F.exists(v, lambda x: x != 0))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    salted = rows.withColumn("_h", F.xxhash64("v")).withColumn("_g", F.xxhash64("v", F.lit(1))).withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = Window.partitionBy("_h", "_g", "_salt").orderBy("id")
    first = salted.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1)
    first = first.withColumn("_r", F.row_number().over(Window.partitionBy("_h", "_g").orderBy("id"))).where(F.col("_r") <= k + 1)
    classes = staged(first.groupBy("_h", "_g").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min_by("v", "id").alias("v")), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    total, longest = classes.agg(F.coalesce(F.sum(8 * F.size("v")), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0))).first()
    fit = fitted(classes, k, tables, target, sample, sample_queries, seed)
    known = vectors.sparkSession.sparkContext.broadcast(fit)
    slots = max(1, -(-total // PART_BYTES))

    def slot(axis: np.ndarray, w: int) -> np.ndarray:
        return axis * min(slots, 2 * w) // (2 * w)

    salts = []  # by table: parts into which each range of first axes is cut, by its share of the sampled rows
    for t in range(tables):
        share = np.zeros(slots)
        for w, codes in fit.codes.items():
            np.add.at(share, slot(codes[:, 1 + 2 * t], 1 << max(0, w - 1).bit_length()), w)
        salts.append(np.maximum(1, np.ceil(share / max(1, share.sum()) * total / PART_BYTES)).astype(np.int64))
    begins = np.cumsum(np.concatenate([[0], *salts]))[: tables * slots].reshape(tables, slots)
    shape = "part long, kind int, tab int, id long, ids array<long>, v array<double>, floor double"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vs = batch.column(0), batch.column(1)
            for at, x in by_width(vs):
                unit, _ = directions(x)
                take, n = pa.array(at), len(at)
                for t in range(tables):
                    s = slot(nearest_axis(pseudo_rotation(unit, seed + 2 * t)), unit.shape[1])
                    part = begins[t][s] + at % salts[t][s]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, t, np.int32)), pa.nulls(n, pa.int64()), ids.take(take), vs.take(take), pa.nulls(n, pa.float64())], names=["part", "kind", "tab", "id", "ids", "v", "floor"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = known.value
        for whole in batches:
            for a in range(0, whole.num_rows, QUERY_ROWS):
                batch = whole.slice(a, QUERY_ROWS)
                ids, vs = batch.column(0), batch.column(1)
                for at, x in by_width(vs):
                    products = query_products(x, tables, seed)
                    limits = fit.limits(x.shape[1], products, 2 * k)
                    for t in range(tables):
                        one = products[2 * t]
                        s = slot(np.arange(one.shape[1]), one.shape[1] // 2)
                        reach = np.maximum.reduceat(one, np.flatnonzero(np.diff(s, prepend=-1)), axis=1) + products[2 * t + 1].max(axis=1)[:, None]
                        asked = np.maximum(reach, 0) * (longest * BAND * 1.001) >= limits[t][:, None]
                        for col, of in enumerate(np.unique(s)):
                            i = np.flatnonzero(asked[:, col])
                            for part in range(begins[t][of], begins[t][of] + salts[t][of]) if len(i) else ():
                                n, take = len(i), pa.array(at[i])
                                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(np.ones(n, np.int32)), pa.array(np.full(n, t, np.int32)), ids.take(take), pa.nulls(n, pa.list_(pa.int64())), vs.take(take), pa.array(limits[t][i])], names=["part", "kind", "tab", "id", "ids", "v", "floor"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, current, held, index = known.value, -1, [], None
        for batch in batches:
            key = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]) if len(key) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                piece, part = batch.slice(a, b - a), key[a] // 2
                if part != current:
                    current, held, index = part, [], None
                if key[a] % 2 == 0:
                    held.append(piece)
                    continue
                if not held:
                    continue
                index = index or Part(held, fit, piece.column(2)[0].as_py())
                for c in range(0, piece.num_rows, QUERY_ROWS):
                    some = piece.slice(c, QUERY_ROWS)
                    for at, x in by_width(some.column(5)):
                        q, r, score = index.best(x, some.column(6).to_numpy()[at], k + 1)
                        yield pa.RecordBatch.from_arrays([some.column(3).take(pa.array(at[q])), pa.array(score), index.ids.take(pa.array(r))], names=["query_id", "score", "ids"])

    index = classes.select("ids", "v").mapInArrow(place, shape)
    queries = rows.where(F.col("id") % query_every == 0).select("id", "v").mapInArrow(ask, shape)
    parts = index.union(queries).repartition("part").sortWithinPartitions("part", "kind")
    each = parts.mapInArrow(rank, "query_id long, score double, ids array<long>").withColumn("low", F.get("ids", F.lit(0)))
    each = each.groupBy("query_id", "low").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    each = each.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def fitted(classes: DataFrame, k: int, tables: int, target: float, sample: int, sample_queries: int, seed: int) -> Fit:
    """Bucket codes of a bounded sample of rows, and probe shares from the true neighbours of a few rows."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in by_width(batch.column(0)):
                codes = bucket_codes(x, tables, seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1])), pa.array(codes.tolist(), pa.list_(pa.int64()))], names=["w", "codes"])

    known: dict[int, list] = {}
    for r in classes.orderBy("_h", "_g").limit(sample).select("v").mapInArrow(code, "w long, codes array<long>").collect():
        known.setdefault(r["w"], []).append(r["codes"])
    fit = Fit({w: np.array(c) for w, c in known.items()}, tables, seed)
    asked = classes.orderBy("_h", "_g").limit(sample_queries).select("v", F.get("ids", F.lit(0)).alias("low")).collect()
    lows, vs = [r["low"] for r in asked], [np.array(r["v"]) for r in asked]

    def true(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).to_numpy()
            for at, x in by_width(batch.column(0)):
                for i, q in enumerate(vs):
                    if len(q) == x.shape[1]:
                        score = np.where(ids[at] == lows[i], -np.inf, x @ q)
                        best = np.argsort(-score, kind="stable")[:k]
                        best = best[score[best] > -np.inf]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), i)), pa.array(score[best]), batch.column(0).take(pa.array(at[best]))], names=["q", "score", "v"])

    pairs = classes.select("v", F.get("ids", F.lit(0)).alias("low")).mapInArrow(true, "q long, score double, v array<double>")
    pairs = pairs.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("r") <= k)
    near: dict[int, list] = {}
    for r in pairs.select("q", "v").collect():
        near.setdefault(r["q"], []).append(r["v"])
    for w in {len(q) for q in vs}:
        of = [i for i in sorted(near) if len(vs[i]) == w]
        if of:
            fit.learn(w, np.array([vs[i] for i in of]), [np.array(near[i]) for i in of], target)
    return fit
