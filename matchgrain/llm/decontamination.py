"""Benchmark decontamination: greedy string tiling of documents with benchmark items over shared-token seeds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrain.llm.staging import bound_batches, staged
from matchgrain.llm.textbytes import ALNUM, U, byte_slices, gram_hash, lower_ascii, text_bytes, word_hash, word_spans

#: Most bytes of benchmark text that are broadcast at once; more items are tiled in several blocks, one after another.
BLOCK_BYTES = 32_000_000


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each text)."""
    buf, offs = text_bytes(column)
    buf = lower_ascii(buf)
    starts, ends, first = word_spans(buf, offs, ALNUM)
    return word_hash(buf, starts, ends), first


def tile(doc_at: np.ndarray, item_at: np.ndarray, width: int, n_item: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from seeds (equal ``width``-grams): tiles (document start, item start, length).

    Seeds on one diagonal at successive places are one maximal match. The longest match is marked first (ties: first
    in the document, then in the item); what others lose to marked tokens is cut off, and their rests compete again.
    """
    order = np.lexsort((doc_at, doc_at - item_at))
    d, i = doc_at[order], item_at[order]
    cut = np.flatnonzero((np.diff(d - i) != 0) | (np.diff(d) != 1)) + 1
    begins, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(d)]])
    heap = [(-(int(e - b) + width - 1), int(d[b]), int(i[b])) for b, e in zip(begins, ends, strict=True)]
    heapq.heapify(heap)
    low = int(d.min())
    doc_free, item_free = np.ones(int(d.max()) - low + width, bool), np.ones(n_item, bool)
    tiles = []
    while heap and item_free.any():
        n, at, to = heapq.heappop(heap)
        n = -n
        free = doc_free[at - low : at - low + n] & item_free[to : to + n]
        if free.all():
            doc_free[at - low : at - low + n] = item_free[to : to + n] = False
            tiles.append((at, to, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for b, e in zip(edges[::2], edges[1::2], strict=True):
            if e - b >= width:
                heapq.heappush(heap, (-int(e - b), at + int(b), to + int(b)))
    return tiles


class Items:
    """A block of benchmark items with the sorted seeds of their tokens."""

    def __init__(self, ids: list[int], texts: list[str], width: int) -> None:
        self.ids = ids
        words, first = token_hashes(pa.array(texts, pa.string()))
        self.sizes = np.diff(first)
        grams = gram_hash(words, width)
        owner = np.repeat(np.arange(len(ids)), self.sizes)
        at = np.arange(len(grams))
        inside = at + width <= first[owner[: len(grams)] + 1] if len(grams) else np.zeros(0, bool)
        at, own = at[inside], owner[: len(grams)][inside]
        order = np.argsort(grams[at], kind="stable")
        self.seeds, self.owner, self.place = grams[at][order], own[order], (at - first[own])[order]


def contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = 5, coverage: float = 0.6, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Which documents hold a benchmark item, whole or in reordered passages.

    Tokens are runs of digits, a-z and non-ASCII characters after lower-casing A-Z. Tiles are at least ``width``
    tokens; a document is contaminated if its tiles cover at least ``coverage`` of the tokens of some item. Items
    with fewer than ``width`` tokens, a null text or a null id match nothing; repeated items count once. A null
    text is empty; document ids may be null or repeat; other columns are ignored; empty tables are fine. Returns id,
    contaminated, n_items, item_ids (ascending), max_coverage (0 without a shared seed), n_tiles (of contaminating
    items).
    """
    bound_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").groupBy("i").agg(F.min("t").alias("t"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    docs = docs.select(id_col, text_col).withColumn("_row", F.monotonically_increasing_id())
    if blocks > 1:
        docs = staged(docs, "numbered")  # all blocks must see the same row numbers
    out = [scan(docs, items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b), width, coverage, id_col, text_col) for b in range(blocks)]
    if blocks == 1:
        return out[0].drop("_row")
    joined = reduce(DataFrame.union, out)
    merged = joined.groupBy(id_col, "_row").agg(F.max("contaminated").alias("contaminated"), F.sum("n_items").alias("n_items"), F.sort_array(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), F.max("max_coverage").alias("max_coverage"), F.sum("n_tiles").alias("n_tiles"))
    return merged.drop("_row")


def scan(docs: DataFrame, items: DataFrame, width: int, coverage: float, id_col: str, text_col: str) -> DataFrame:
    rows = items.orderBy("i").collect()  # one block of items, at most about BLOCK_BYTES
    known = docs.sparkSession.sparkContext.broadcast(Items([r["i"] for r in rows], [r["t"] for r in rows], width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = known.value
        for batch in byte_slices(batches, text_col):
            words, first = token_hashes(batch.column(text_col))
            grams = gram_hash(words, width)
            lo = np.searchsorted(block.seeds, grams)
            hit = np.flatnonzero((lo < len(block.seeds)) & (block.seeds[np.minimum(lo, len(block.seeds) - 1)] == grams)) if len(block.seeds) else lo[:0]
            doc = np.searchsorted(first, hit, side="right") - 1
            inside = hit + width <= first[doc + 1]
            hit, doc = hit[inside], doc[inside]
            n = batch.num_rows
            found: list[list[int]] = [[] for _ in range(n)]
            best, tiles_of = np.zeros(n), np.zeros(n, np.int64)
            cut = np.flatnonzero(np.diff(doc)) + 1
            for places in np.split(hit, cut) if len(hit) else []:
                d = int(np.searchsorted(first, places[0], side="right")) - 1
                lo_, hi_ = np.searchsorted(block.seeds, grams[places]), np.searchsorted(block.seeds, grams[places], side="right")
                times = hi_ - lo_
                seed = np.repeat(lo_ - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
                at, owner, to = np.repeat(places - first[d], times), block.owner[seed], block.place[seed]
                for k in np.unique(owner):
                    own = owner == k
                    size = int(block.sizes[k])
                    shared = np.zeros(size + 1, np.int64)
                    np.add.at(shared, to[own], 1)
                    np.add.at(shared, np.minimum(to[own] + width, size), -1)
                    if (np.cumsum(shared)[:size] > 0).sum() < coverage * size and best[d] >= coverage:
                        continue  # cannot reach the threshold nor a larger maximum
                    tiles = tile(at[own], to[own], width, size)
                    covered = sum(t[2] for t in tiles) / size
                    best[d] = max(best[d], covered)
                    if covered >= coverage:
                        found[d].append(block.ids[k])
                        tiles_of[d] += len(tiles)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), batch.column("_row"), pa.array([bool(x) for x in found], pa.bool_()), pa.array(map(len, found), pa.int64()), pa.array(map(sorted, found), pa.list_(pa.int64())), pa.array(best), pa.array(tiles_of)],
                names=[id_col, "_row", "contaminated", "n_items", "item_ids", "max_coverage", "n_tiles"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.mapInArrow(run, f"`{id_col}` {kind}, _row long, contaminated boolean, n_items long, item_ids array<long>, max_coverage double, n_tiles long")
