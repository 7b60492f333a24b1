"""Line dedup: first occurrences are streamed over range-partitioned line hashes; documents get bitmaps of the lines they keep.

Rows (line, id, place) are cut into ranges of all three columns, so that a line found in many documents is spread over as
many partitions as its rows fill, and sorted within them. One pass then sees each line's smallest document first. Only
the line that a partition begins with may have begun in an earlier one; its rows are decided by the smallest documents
of the lines at the partitions' edges, two for each partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrain.llm.staging import bound_batches, staged
from matchgrain.llm.textbytes import byte_slices

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What the streamed rows are: a line to drop, one of a partition's first line, the first document of an edge's line.
DROP, OPEN, EDGE = 0, 1, 2


def line_key(line: Column) -> Column:
    """The line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case and other letters as they are."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def fingerprint(text: Column) -> Column:
    """128 bits of a cryptographic digest."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def numbered_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, doc, lines): ``doc`` is a fingerprint of the text, which tells rows of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", F.xxhash64("text").alias("doc"), F.split("text", "\n", -1).alias("lines"))


def first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (line, id, doc, at) sorted by all of them become rows (kind, line, id, doc, at) of lines that go or may go."""

    def rows(kind: int, batch: pa.RecordBatch, at: np.ndarray) -> pa.RecordBatch:
        some = batch.take(pa.array(at))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), *some.columns], names=["kind", *batch.schema.names])

    opening, edge = None, None  # the partition's first line; (line, its first row) of the latest
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lines = batch.column(0).cast(pa.binary(16)) if pa.types.is_fixed_size_binary(batch.column(0).type) else batch.column(0)
        line = np.frombuffer(b"".join(lines.to_pylist()), "V16")
        ids, known = batch.column(1).fill_null(0).to_numpy(), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        begins = np.concatenate([[edge is None or edge[0] != line[0].tobytes()], line[1:] != line[:-1]])
        start = np.maximum.accumulate(np.where(begins, np.arange(n), -1))
        if edge is None:
            opening = line[0].tobytes()
            yield rows(EDGE, batch, np.array([0]))
        before = start < 0  # the line goes on from the last batch
        own = edge[1].column(1)[0].as_py() if edge is not None else None
        first = np.where(before, own if own is not None else 0, ids[np.maximum(start, 0)])
        named = np.where(before, own is not None, known[np.maximum(start, 0)])
        other = (first != ids) | (named != known)
        open_ = line == np.frombuffer(opening, "V16")[0]
        yield rows(DROP, batch, np.flatnonzero(other & ~open_))
        yield rows(OPEN, batch, np.flatnonzero(open_))
        if start[-1] >= 0:
            edge = line[-1].tobytes(), batch.slice(int(start[-1]), 1)
    if edge is not None and edge[0] != opening:
        yield rows(EDGE, edge[1], np.array([0]))


def dropped_lines(lines: DataFrame, least: int) -> DataFrame:
    """(id, doc, at) of the lines that go, equal rows possibly twice."""
    each = lines.select("id", "doc", F.posexplode("lines").alias("at", "line")).withColumn("line", line_key(F.col("line")))
    each = each.where(F.char_length("line") >= least).select(fingerprint(F.col("line")).alias("line"), "id", "doc", "at")
    order = ["line", F.col("id").asc_nulls_last(), "doc", "at"]
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = f"kind int, line binary, id {lines.schema['id'].dataType.simpleString()}, doc long, at int"
    told = staged(each.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(first_seen, kinds), "lines")
    first = told.where(f"kind = {EDGE}").groupBy("line").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"))
    late = told.where(f"kind = {OPEN}").join(F.broadcast(first), "line").where(~F.col("id").eqNullSafe(F.col("first.id")))  # two rows a partition at most are broadcast
    return told.where(f"kind = {DROP}").select("id", "doc", "at").union(late.select("id", "doc", "at"))


def pack(keep: np.ndarray) -> bytes:
    """A bit for each line, the first one lowest, compressed."""
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def unpack(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=n, bitorder="little").astype(bool)


def keep_bitmaps(docs: DataFrame, *, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which lines of each document stay: (id, doc, n_lines, n_dropped, keep), one row for each id and text.

    Texts are split at ``\\n``. Lines are equal by their key: without white space at both ends, A-Z in lower case. Keys
    of at least ``least`` code points that two or more ids hold lose all lines but those of the smallest id. A null or
    empty text is one empty line. Rows that repeat an id are one document in that their lines stay or go alike, null
    ids come after all others and are one id; equal rows have one bitmap. Other columns are ignored; an empty table
    gives an empty result. ``doc`` is a hash of the text, ``keep`` is read by ``unpack``; no text is shuffled.
    """
    bound_batches(docs.sparkSession)
    lines = numbered_lines(docs, id_col, text_col)
    gone = dropped_lines(lines, least).groupBy("id", "doc").agg(F.collect_set("at").alias("gone"))
    all_ = lines.select("id", "doc", F.size("lines").alias("n")).groupBy("id", "doc").agg(F.max("n").alias("n"))
    both = all_.alias("a").join(gone.alias("g"), F.col("a.id").eqNullSafe(F.col("g.id")) & (F.col("a.doc") == F.col("g.doc")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, maps = [], []
            for n, gone in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                keep = np.ones(n, bool)
                if gone.is_valid:
                    keep[gone.values.to_numpy()] = False
                counts.append(n - int(keep.sum()))
                maps.append(pack(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())], names=["id", "doc", "n_lines", "n_dropped", "keep"])

    kind = docs.schema[id_col].dataType.simpleString()
    return both.select("a.id", "a.doc", "a.n", "g.gone").mapInArrow(run, f"id {kind}, doc long, n_lines long, n_dropped long, keep binary")


def kept_texts(docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_lines, n_dropped): each row of ``docs`` with the lines that its bitmap keeps, joined by ``\\n``; null texts become empty."""
    rows = numbered_lines(docs, id_col, text_col).select("id", "doc", "text").alias("r")
    both = rows.join(bitmaps.alias("b"), F.col("r.id").eqNullSafe(F.col("b.id")) & (F.col("r.doc") == F.col("b.doc")))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches):
            texts = []
            for text, n, dropped, keep in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                texts.append("\n".join(x for x, k in zip(text.split("\n"), unpack(keep, n), strict=True) if k) if dropped else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2), batch.column(3)], names=["id", "text", "n_lines", "n_dropped"])

    out = both.select("r.id", "r.text", "b.n_lines", "b.n_dropped", "b.keep").mapInArrow(run, f"id {kind}, text string, n_lines long, n_dropped long")
    return out.withColumnsRenamed({"id": id_col, "text": text_col})
