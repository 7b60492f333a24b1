"""Best-fit decreasing packing of token sequences, by run lengths over a segment tree of remaining capacities."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matchgrain.llm.byte_bpe import PATTERN, RARE, byte_letters
from matchgrain.llm.staging import bound_batches, staged

#: Texts that the tokenizers library encodes at once, and documents of one step: its results take much more memory than texts.
ENCODED, STEP = 500, 64
#: Runs of white space that only the library splits without deep recursion.
LONG = re.compile(r"\s{1000}")
#: Groups by which rows of one length are numbered, so that no task gets all rows of a frequent length.
SALTS = 512


class Identifiers:
    """Identifiers, as little-endian bytes, as the tokenizers library gives them for a byte-level vocabulary.

    Most texts are encoded by tiktoken, four times as fast, with the ranks of the same file: both split and merge alike
    there. Texts with added tokens, with characters that Unicode versions class differently or with very long runs
    of white space go to the library itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark spreads the work
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token not in self.added}
        self.fast = tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def documents(self, texts: list[str]) -> list[bytes]:
        """The identifiers of each text."""
        out = [b""] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if any(a in t for a in self.added) or RARE.search(t) or LONG.search(t):
                rest.append(i)
            elif t:
                out[i] = self.fast.encode_to_numpy(t, disallowed_special=()).astype("<u4").tobytes()
        for at in range(0, len(rest), ENCODED):
            part = rest[at : at + ENCODED]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, "<u4").tobytes()
        return out


@lru_cache(maxsize=1)
def identifiers(path: str) -> Identifiers:
    return Identifiers(path)


def token_pieces(docs: DataFrame, vocabulary: str, *, id_col: str, text_col: str, size: int, end_id: int) -> DataFrame:
    """Pieces of at most ``size`` tokens of each text and the token after it; only the first may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = identifiers(vocabulary), np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                rows: list[tuple] = []
                for r, ids in enumerate(ids_of.documents([t or "" for t in batch.column(1).to_pylist()])):
                    data = ids + end
                    n = len(data) // 4
                    begin, k = 0, 0
                    while begin < n:
                        length = (n - 1) % size + 1 if k == 0 else size
                        rows.append((r, k, begin, length, zlib.crc32(data[4 * begin : 4 * (begin + length)])))
                        begin, k = begin + length, k + 1
                r, k, begin, length, crc = map(list, zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(r)), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (begin, length, crc))],
                    names=[id_col, "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


class Capacities:
    """A segment tree over capacities 0..size: which of them an open bin has left."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, capacity: int, on: bool) -> None:
        node = self.leaves + capacity
        self.any[node] = on
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least ``need`` that an open bin has left."""
        node = self.leaves + need
        if not self.any[node]:
            while node > 1 and (node % 2 or not self.any[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_layout(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over (length, count) runs.

    Bins that were filled alike stay one run, so the work and the result depend on the number of lengths, which is
    at most ``size``, not on the number of pieces. Returns rows (length, first rank, number of bins, pieces a bin,
    first bin, offset): the pieces of that length with ranks from the first on fill these bins one after another.
    """
    tree, open_runs, out, bins = Capacities(size), {}, [], 0

    def put(capacity: int, first: int, number: int) -> None:
        if capacity and number:
            open_runs.setdefault(capacity, []).append((first, number))
            tree.set(capacity, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                each = size // length
                first, number, capacity = bins, -(-left // each), size
                bins += number
            else:
                first, number = open_runs[capacity].pop()
                if not open_runs[capacity]:
                    tree.set(capacity, False)
                each = capacity // length
            full = min(number, left // each)
            if full:
                out.append((length, rank, full, each, first, size - capacity))
                put(capacity - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < number and left:  # the last pieces stand in one more bin
                out.append((length, rank, 1, left, first + full, size - capacity))
                put(capacity - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            put(capacity, first + full, number - full)
    return out


def place(pieces: DataFrame, *, id_col: str, size: int) -> DataFrame:
    """Give each piece its sequence and its offset there."""
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col), "piece"), F.lit(SALTS)))
    groups = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most ``size`` rows
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)  # at most SALTS rows
    groups = groups.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(F.col(id_col).asc_nulls_first(), "piece"))
    ranked = salted.withColumn("_rank", number.cast("long") - 1).join(groups, ["length", "_salt"])
    rows = sorted(best_fit_layout(counts, size))
    layout = np.array(rows, np.int64).reshape(-1, 6)
    span = 1 << 44
    keys = layout[:, 0] * span + layout[:, 1]
    out_cols = [c for c in pieces.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            run_of = layout[np.searchsorted(keys, length * span + rank, side="right") - 1] if len(layout) else layout
            inner = rank - run_of[:, 1]
            sequence = run_of[:, 4] + inner // run_of[:, 3]
            offset = run_of[:, 5] + inner % run_of[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out_cols), pa.array(sequence), pa.array(offset)], names=[*out_cols, "sequence_id", "offset"])

    ranked = ranked.select(*out_cols, (F.col("_rank") + F.col("_before")).alias("_rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all texts into as few sequences of ``size`` tokens as best-fit decreasing needs.

    A document is the tokenizer's identifiers of its text and then ``end_id``; a null or empty text is ``end_id``
    alone. Longer ones are cut into pieces of ``size`` tokens, of which the first may be shorter. Repeated rows and
    equal or null ids are packed one by one; other columns are ignored; an empty table gives an empty result. The
    driver sees one count for each length, at most ``size`` of them. Returns id, piece, start, length, ids_crc32,
    sequence_id, offset.
    """
    bound_batches(docs.sparkSession)
    return place(staged(token_pieces(docs, vocabulary, id_col=id_col, text_col=text_col, size=size, end_id=end_id), "pieces"), id_col=id_col, size=size)
