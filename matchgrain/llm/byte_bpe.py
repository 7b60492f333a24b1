"""Byte-pair merging with a heap and a linked list: token counts without identifiers."""

from __future__ import annotations

from matchgrain.llm.staging import bound_batches

import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers.pre_tokenizers import ByteLevel

#: The split of byte-level vocabularies, a fixed value of the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
SPLIT = regex.compile(PATTERN)
#: Distinct words whose counts a worker remembers in each of two generations, none longer than WORD_SIZE. Results never depend on either.
MEMO_SIZE, WORD_SIZE = 300_000, 100


def byte_letters() -> list[str]:
    """The visible letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            letters[b] = chr(b)
        else:
            letters[b] = chr(spare)
            spare += 1
    return letters


class Merges:
    """The merges of a vocabulary, its symbols as numbers."""

    def __init__(self, merges: Iterable[tuple[str, str]]) -> None:
        numbers: dict[str, int] = {}
        number = lambda symbol: numbers.setdefault(symbol, len(numbers))
        #: The symbol of each byte.
        self.letters = [number(letter) for letter in byte_letters()]
        #: The symbol that the merge of each rank makes.
        self.made: list[int] = []
        ranks = defaultdict(dict)
        for rank, (a, b) in enumerate(merges):
            ranks[number(a)][number(b)] = rank
            self.made.append(number(a + b))
        #: By left symbol: the rank of its merge with each right one.
        self.ranks = [ranks.get(symbol, {}) for symbol in range(len(numbers))]


def merge_count(data: bytes, merges: Merges) -> int:
    """Symbols left after merging: pop the lowest rank, leftmost first, until no known pair is adjacent."""
    n, ranks, made = len(data), merges.ranks, merges.made
    symbols = [merges.letters[b] for b in data]
    at = [ranks[a].get(b, -1) for a, b in zip(symbols, symbols[1:])]  # the rank of the pair that begins at each symbol
    heap = [rank << 32 | i for i, rank in enumerate(at) if rank >= 0]
    if not heap:
        return n
    heapify(heap)
    at.append(-1)
    left, right, alive = [*range(-1, n - 1)], [*range(1, n + 1)], n
    while heap:
        top = heappop(heap)
        i, rank = top & 0xFFFFFFFF, top >> 32
        if at[i] != rank:  # one of the two has been merged meanwhile
            continue
        j = right[i]
        symbols[i] = symbol = made[rank]
        right[i] = k = right[j]
        at[i] = at[j] = -1
        alive -= 1
        if k < n:
            left[k] = i
            at[i] = rank = ranks[symbol].get(symbols[k], -1)
            if rank >= 0:
                heappush(heap, rank << 32 | i)
        h = left[i]
        if h >= 0:
            at[h] = rank = ranks[symbols[h]].get(symbol, -1)
            if rank >= 0:
                heappush(heap, rank << 32 | h)
    return alive


#: Characters that every Unicode version classes alike; texts with others are split by the library itself.
RARE = regex.compile(r"[^\u0000-\u0557\u0600-\u06ff\u2010-\u2064\u20a0-\u20b9\u2190-\u21ff\u3040-\u30ff\u4e00-\u9fcb\uac00-\ud7a3\U0001f300-\U0001f64f]")
#: A space beside other white space: there a text cannot be cut before each space.
MIXED = re.compile(r"\s | \s")


#: Marks that stand at the end of a word; a run of them after letters is one piece.
MARKS = ".,;:!?"


class Memo(dict):
    """Token counts of chunks (texts after single spaces). A full memo becomes the older one, from which chunks met again return."""

    def __init__(self, merges: Merges) -> None:
        super().__init__()
        self.merges, self.older, self.pieces = merges, {}, {}

    def piece(self, piece: str) -> int:
        if (n := self.pieces.get(piece)) is None:
            n = self[piece[1:]] if piece[:1] == " " and piece[1:].isalpha() else merge_count(piece.encode(), self.merges)
            if len(piece) <= WORD_SIZE:
                if len(self.pieces) >= MEMO_SIZE:
                    self.pieces.clear()
                self.pieces[piece] = n
        return n

    def __missing__(self, chunk: str) -> int:
        if (n := self.older.get(chunk)) is None:
            word = chunk.rstrip(MARKS)
            if not word.isalpha():
                n = sum(map(self.piece, SPLIT.findall(" " + chunk)))
                if "\n" in chunk:  # the end of a line and the beginning of the next one seldom meet again
                    return n
            elif len(word) < len(chunk):
                return self[word] + self.piece(chunk[len(word) :])
            else:
                n = merge_count(b" " + chunk.encode(), self.merges)
        if len(chunk) <= WORD_SIZE:
            if len(self) >= MEMO_SIZE:
                self.older = self.copy()
                self.clear()
            self[chunk] = n
        return n


@lru_cache(maxsize=1)
def load(path: str) -> tuple[Memo, regex.Pattern | None]:
    """The memo and the pattern of added tokens of a vocabulary file, once a worker."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    merges = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
    added = [t["content"] for t in spec.get("added_tokens", [])]
    return Memo(Merges(merges)), regex.compile("|".join(map(regex.escape, added))) if added else None


def count_plain(text: str, memo: Memo) -> int:
    """Tokens of a text without added tokens. Every space between two other characters starts a piece."""
    if RARE.search(text):
        return sum(memo.piece(text[i:j]) for _, (i, j) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text))
    if MIXED.search(text) or text[:1] == " " or text[-1:] == " ":
        return sum(map(memo.piece, SPLIT.findall(text)))
    first, *rest = text.split(" ")
    return sum(map(memo.piece, SPLIT.findall(first))) + sum(map(memo.__getitem__, rest))


def count_tokens(text: str, memo: Memo, added: regex.Pattern | None) -> int:
    """Tokens of one text; a string of an added token counts as one."""
    if added is None or not added.search(text):
        return count_plain(text, memo)
    parts = added.split(text)
    return len(parts) - 1 + sum(count_plain(p, memo) for p in parts)


def token_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Bytes and tokens of each whole text.

    ``vocabulary`` is the path of a byte-level ``.json`` file, present on every executor. A null text counts as
    empty (0 bytes, 0 tokens); null ids stay; repeated rows stay repeated; other columns are ignored; an empty
    table gives an empty result. Returns id, n_bytes, n_tokens, over_limit (n_tokens > limit).
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, added = load(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [count_tokens(t, memo, added) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
