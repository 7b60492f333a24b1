"""Vectorised work on the UTF-8 bytes of Arrow string columns: slices, word spans and rolling hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes of text that one numpy step works on, so that a task's memory stays bounded.
SLICE_BYTES = 500_000


def byte_slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
            to = max(to, at + 1)
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(offs) or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes unchanged."""
    return np.where((buf >= 65) & (buf <= 90), buf | 32, buf)


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """A table of 256 booleans, true for bytes within the inclusive ranges."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Words of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
ALNUM = ~byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def word_spans(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each document): maximal runs of table bytes, never across documents."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    inside = table[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> None:
        if n >= len(self.up):
            size = 1 << (n + 1).bit_length()
            with np.errstate(over="ignore"):
                self.up = np.concatenate([np.ones(1, U), np.cumprod(np.full(size, BASE, U))])
                self.down = np.concatenate([np.ones(1, U), np.cumprod(np.full(size, BASE_INV, U))])


POWERS = Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a 64-bit hash."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(29))
    h = h * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Karp-Rabin prefix sums: h[j] - h[i] is the hash of buf[i:j], times a power of the base."""
    POWERS.to(len(buf) + 1)
    out = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * POWERS.up[: len(buf)], out=out[1:])
    return out


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings [start, end), equal for equal strings wherever they stand."""
    return mix((h[ends] - h[starts]) * POWERS.down[starts] + (ends - starts).astype(U))


#: Longer words are hashed by a digest, one by one; shorter ones eight bytes a step, all at once.
LONG_WORD = 64
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], U)


def digests(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit digests of byte strings, one by one: for long ones, where a rolling hash has collisions that texts can hold."""
    data = memoryview(np.ascontiguousarray(buf))
    return np.array([int.from_bytes(hashlib.blake2b(data[a:b], digest_size=8, salt=bytes([lane])).digest(), "little") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], U)


def word_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of the words [start, end); another ``lane`` gives hashes that collide for other words."""
    n = ends - starts
    out = mix(n.astype(U) + U(lane) * U(0xA0761D6478BD642F) + U(1))
    eight = np.ndarray(len(buf) + 1, "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    live, at = np.flatnonzero(n <= LONG_WORD), 0
    while len(live):
        chunk = eight[starts[live] + at] & MASKS[np.minimum(n[live] - at, 8)]
        out[live] = mix((out[live] ^ chunk) * U(0x9FB21C651E98DF25) + U(lane + 1))
        at += 8
        live = live[n[live] > at]
    long = np.flatnonzero(n > LONG_WORD)
    if len(long):
        out[long] = digests(buf, starts[long], ends[long], lane)
    return out


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n successive words that begin at each place; there are len(words) - n + 1."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.zeros(m, U)
    for i in range(n):
        out = out * U(0x9FB21C651E98DF25) + words[i : i + m]
    return mix(out)


def string_hash(text: str) -> int:
    """The word hash of one string."""
    buf = np.frombuffer(text.encode(), np.uint8)
    return int(word_hash(buf, np.array([0]), np.array([len(buf)]))[0])
