"""Suffix-array dedup by prefix-free parsing: bytes of 100-byte strings that also start earlier in the corpus.

A rolling hash of ``GRAM`` bytes cuts each text into phrases: successive starts whose ``size``-byte strings have the
same least hash (the trigger) form one phrase, which reaches to the end of the last of these strings. A trigger
depends on the string alone, so equal strings lie in phrases of the same trigger, wherever they stand. The parse lists
the phrases of the corpus, the dictionary its distinct ones with their first places. All starts of a phrase that
the dictionary has from an earlier place are repeats at once. What is left are suffixes of different dictionary
phrases of one trigger, taken at their first places. They are brought together by trigger, and a suffix array of them,
cut at ``size`` bytes and by fingerprint, as only equality counts, gives with the places in corpus order all but the
first of equal ones. Triggers with many or long phrases would not fit one task; their suffixes are merged by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrain.llm.bitfilter import Filter
from matchgrain.llm.staging import bound_batches, staged
from matchgrain.llm.textbytes import POWERS, U, byte_slices, digests, mix, prefix_hash, span_hash, text_bytes

#: Bytes of a trigger's rolling hash.
GRAM = 32
#: Bits of a place that count the byte within its document; the rest number the documents.
AT_BITS = 30
#: Most dictionary phrases of a trigger, and most starts of each, that are sorted together in one task.
GROUP, STARTS = 256, 512
#: Phrases of at least so many bytes are told apart by digests: rolling hashes of shorter ones have no known collisions.
DIGEST_BYTES = 512
#: About so many bytes of phrases are sorted at once in a task; the phrases of one trigger always are, up to GROUP * (STARTS + size) bytes.
SORT_BYTES = 500_000


class Phrases:
    """The phrases of a block of texts: trigger, first start, number of starts, and whether the trigger stands in it twice."""

    def __init__(self, column: pa.Array, size: int) -> None:
        self.buf, self.offs = buf, _ = text_bytes(column)
        self.hash = prefix_hash(buf)
        n, span = len(buf), size - GRAM + 1
        self.trigger, self.first, self.starts, self.twice = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        long = np.flatnonzero(np.diff(self.offs) >= size)
        if len(long):
            gram = mix((self.hash[GRAM:] - self.hash[: n - GRAM + 1]) * POWERS.down[: n - GRAM + 1])
            least = sliding(np.minimum, gram, span)
            fits = np.zeros(n + 2, np.int32)  # starts whose string ends within their document
            fits[self.offs[long]] += 1
            fits[self.offs[long + 1] - size + 1] -= 1
            good = np.cumsum(fits)[: len(least)] > 0
            edge = np.ones(len(least) + 1, bool)
            edge[1:-1] = least[1:] != least[:-1]
            edge[self.offs[long]] = True
            edge[self.offs[long + 1] - size + 1] = True
            cut = np.flatnonzero(edge)
            keep = good[cut[:-1]]
            self.first, self.starts = cut[:-1][keep], np.diff(cut)[keep]
            self.trigger = least[self.first]
            self.twice = np.isin(self.trigger, close_pairs(gram, least, span))
        self.doc = np.searchsorted(self.offs, self.first, side="right") - 1

    def strings(self, begin: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Fingerprints of the strings that begin at these bytes."""
        end = begin + length
        out = span_hash(self.hash, begin, end)
        long = np.flatnonzero(end - begin >= DIGEST_BYTES)
        if len(long):
            out[long] = digests(self.buf, begin[long], end[long])
        return out


def sliding(least: np.ufunc, x: np.ndarray, span: int) -> np.ndarray:
    """The least (or greatest) of each ``span`` successive values."""
    have = 1
    while have < span:
        step = min(have, span - have)
        x = least(x[: len(x) - step], x[step:])
        have += step
    return x


def close_pairs(gram: np.ndarray, least: np.ndarray, span: int) -> np.ndarray:
    """Triggers that stand at two places near one another, so that a phrase may hold both."""
    pad = np.zeros(span - 1, U)
    at = np.flatnonzero(gram == sliding(np.maximum, np.concatenate([pad, least, pad]), span))
    order = at[np.argsort(gram[at], kind="stable")]
    value = gram[order]
    return np.unique(value[1:][value[1:] == value[:-1]])


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, n, text) without null ids: n keeps the order of ids. Rows that repeat an id are ordered by a hash of their text."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    span = rows.groupBy("id").count().agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("count").alias("most")).first()
    if span["low"] is None or span["most"] == 1 and span["high"] - span["low"] < 1 << (63 - AT_BITS):
        return rows.select("id", (F.col("id") - (span["low"] or 0)).alias("n"), "text")
    keys = rows.select("id", F.xxhash64("text").alias("k")).distinct().orderBy("id", "k").withColumn("n", F.monotonically_increasing_id())
    keys = staged(keys.select("id", "k", F.shiftright("n", 33).alias("part"), F.col("n").bitwiseAND((1 << 33) - 1).alias("row")), "numbers")
    before, offsets = 0, {}
    for part, count in sorted(keys.groupBy("part").count().collect()):  # one row for each partition
        offsets[part], before = before, before + count
    offset = F.element_at(F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv)), F.col("part"))
    keys = keys.select("id", "k", (F.col("row") + offset).alias("n"))
    return rows.withColumn("k", F.xxhash64("text")).join(keys, ["id", "k"]).select("id", "n", "text")


def phrase_rows(rows: DataFrame, size: int, out: str, make) -> DataFrame:
    """``make`` turns the phrases of each block of texts and the places of their documents into columns."""
    names, kinds = zip(*((c.split()[0], {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[c.split()[1]]) for c in out.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text", 500_000):
            p = Phrases(batch.column(1), size)
            if len(p.first):
                place = (batch.column(0).to_numpy(zero_copy_only=False)[p.doc] << AT_BITS) - p.offs[p.doc]  # of the document's first byte, less its place in the block
                columns = [x.view(np.int64) if getattr(x, "dtype", None) == U else x for x in make(p, place)]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=names)

    return rows.select("n", "text").mapInArrow(run, out)


def repeated_spans(rows: DataFrame, size: int) -> DataFrame:
    """(n, begin, length): parts of documents that are covered by strings which also start earlier."""

    def triggers(p: Phrases, place: np.ndarray) -> list[np.ndarray]:
        value, back, count = np.unique(p.trigger, return_inverse=True, return_counts=True)
        count[back[p.twice]] = 2
        return [value, count]

    found = phrase_rows(rows, size, "trigger long, n long", triggers).groupBy("trigger").agg(F.sum("n").alias("n"))
    again = Filter(staged(found.where("n > 1").select("trigger"), "triggers"))

    def parse(p: Phrases, place: np.ndarray) -> list[np.ndarray]:
        on = np.flatnonzero(again.passes(p.trigger))
        return [p.trigger[on], p.strings(p.first[on], p.starts[on] + size - 1), place[on] + p.first[on], p.starts[on], p.twice[on]]

    parsed = staged(phrase_rows(rows, size, "trigger long, phrase long, place long, starts long, twice boolean", parse), "parse")
    entries = parsed.groupBy("trigger", "phrase").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.max("twice").alias("twice"), F.max("starts").alias("starts"))
    dictionary = staged(entries, "dictionary")
    later = parsed.join(dictionary.where("n > 1").select("trigger", "phrase", "first"), ["trigger", "phrase"]).where("place > first")
    groups = dictionary.groupBy("trigger").agg(F.count("*").alias("n"), F.max("twice").alias("twice"), F.max("starts").alias("starts")).where("n > 1 or twice")
    groups = groups.select("trigger", ((F.col("n") > GROUP) | (F.col("starts") > STARTS)).alias("large"))
    mixed = staged(dictionary.join(groups, "trigger").select("first", "large"), "mixed")
    both = later.select("place", (F.col("starts") + size - 1).alias("length")).union(small_groups(rows, Filter(mixed.where("not large").select("first")), size))
    if not mixed.where("large").isEmpty():
        both = both.union(large_groups(rows, Filter(mixed.where("large").select("first")), size))
    return both.select(F.shiftright("place", AT_BITS).alias("n"), F.col("place").bitwiseAND((1 << AT_BITS) - 1).cast("int").alias("begin"), F.col("length").cast("int").alias("length"))


def small_groups(rows: DataFrame, firsts: Filter, size: int) -> DataFrame:
    """(place, length) of repeats among the phrases of each trigger, by a suffix array of each task's phrases."""

    def strings(p: Phrases, place: np.ndarray) -> list:
        on = np.flatnonzero(firsts.passes((place + p.first).view(U)))
        ends = p.first[on] + p.starts[on] + size - 1
        return [p.trigger[on], place[on] + p.first[on], [p.buf[a:b].tobytes() for a, b in zip(p.first[on], ends, strict=True)]]

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # the last trigger of a batch may go on in the next
        for batch in batches:
            if not batch.num_rows:
                continue
            trigger, at = batch.column(0).to_numpy(), 0
            bytes_to = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False))
            for cut in (np.flatnonzero(trigger[1:] != trigger[:-1]) + 1 if batch.num_rows > 1 else ()):  # where a trigger ends
                if bytes_to[cut - 1] - (bytes_to[at - 1] if at else 0) >= SORT_BYTES:
                    yield from array_of([*kept, batch.slice(at, cut - at)])
                    kept, at = [], int(cut)
            if kept and kept[-1].column(0)[-1].as_py() != trigger[at] and sum(b.nbytes for b in kept) >= SORT_BYTES:
                yield from array_of(kept)
                kept = []
            kept.append(batch.slice(at))
        yield from array_of(kept)

    def array_of(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sum(b.num_rows for b in batches):
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        buf, offs = text_bytes(table.column(2).cast(pa.large_binary()).combine_chunks().view(pa.large_string()))
        n = np.diff(offs) - size + 1
        h, owner = prefix_hash(buf), np.repeat(np.arange(len(n)), n)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        begin = offs[owner] + step
        place, trigger = table.column(1).to_numpy()[owner] + step, table.column(0).to_numpy()[owner]
        key = span_hash(h, begin, begin + size)
        order = np.lexsort((place, key, trigger))
        place, key, trigger = place[order], key[order], trigger[order]
        same = np.concatenate([[False], (key[1:] == key[:-1]) & (trigger[1:] == trigger[:-1])])
        first = place[np.maximum.accumulate(np.where(same, 0, np.arange(len(place))))]
        again = np.unique(place[same & (place > first)])
        cut = np.flatnonzero(np.diff(again, prepend=again[:1] - 2) != 1)  # successive starts become one span
        length = np.diff(cut, append=len(again)) + size - 1
        yield pa.RecordBatch.from_arrays([pa.array(again[cut]), pa.array(length)], names=["place", "length"])

    found = phrase_rows(rows, size, "trigger long, place long, string binary", strings)
    return found.repartition("trigger").sortWithinPartitions("trigger").mapInArrow(sort, "place long, length long")


def large_groups(rows: DataFrame, firsts: Filter, size: int) -> DataFrame:
    """The same where a trigger has too many or too long phrases for one task: one row for each suffix."""

    def suffixes(p: Phrases, place: np.ndarray) -> list[np.ndarray]:
        on = np.flatnonzero(firsts.passes((place + p.first).view(U)))
        n = p.starts[on]
        owner = np.repeat(on, n)
        begin = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + p.first[owner]
        return [p.trigger[owner], p.strings(begin, size), place[owner] + begin]

    found = staged(phrase_rows(rows, size, "trigger long, suffix long, place long", suffixes), "suffixes")
    merged = found.groupBy("trigger", "suffix").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").drop("last")
    return found.join(merged, ["trigger", "suffix"]).where("place > first").select("place", F.lit(size).cast("long").alias("length"))


def runs(spans: list[dict] | None) -> list[tuple[int, int]]:
    """The maximal runs [begin, end) that the spans cover."""
    out: list[list[int]] = []
    for begin, length in sorted((s["begin"], s["length"]) for s in spans or ()):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], begin + length)
        else:
            out.append([begin, begin + length])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, *, size: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte that a ``size``-byte string covers which also starts earlier: in a smaller id, or before in the same text.

    Strings never cross documents and are judged on the input. ``size`` is at least GRAM + 1; ids are whole numbers,
    texts shorter than 2**30 bytes. A null text is empty. Rows with a null id are returned whole and count as no
    earlier place; rows that repeat an id come in the order of a hash of their text, and equal rows count as one.
    Other columns are ignored; an empty table gives an empty result. Returns id, n_bytes, n_removed, n_spans,
    kept_sha256 (of what is left), removed (the runs as begin and end).
    """
    bound_batches(docs.sparkSession)
    rows = numbered(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    spans = staged(repeated_spans(rows, size).groupBy("n").agg(F.collect_list(F.struct("begin", "length")).alias("spans")), "spans")
    touched = Filter(spans.select("n"))

    marked = rows.withColumn("touched", touched.column(F.col("n")))  # the others need no shuffle
    told = marked.where("touched").join(spans, "n", "left").select("id", "text", "spans")
    told = told.union(marked.where("not touched").select("id", "text", F.lit(None).cast("array<struct<begin:int,length:int>>")))
    unnamed = docs.where(F.col(id_col).isNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    told = told.union(unnamed.withColumn("spans", F.lit(None).cast("array<struct<begin:int,length:int>>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches):
            cols: list[list] = [[], [], [], [], []]
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                data, last, parts = (text.as_py() or "").encode(), 0, []
                gone = runs(spans.as_py())
                for a, b in gone:
                    parts.append(data[last:a])
                    last = b
                parts.append(data[last:])
                values = len(data), sum(b - a for a, b in gone), len(gone), hashlib.sha256(b"".join(parts)).hexdigest(), [{"begin": a, "end": b} for a, b in gone]
                for c, v in zip(cols, values, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, kinds)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    done = told.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<begin:long,end:long>>")
    return done.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
