"""Toxicity: noisy-channel deobfuscation under a character language model, then a linear score of the restored text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrain.llm.staging import bound_batches
from matchgrain.llm.textbytes import byte_slices, lower_ascii, text_bytes

#: What a written character may stand for besides itself: fixed values of the channel.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: Costs, in nats: a substitution, such a character read as a boundary, a doubled letter read as one, a longer run cut
#: to one or two, and a gap between single characters that does end a word.
COST_LEET, COST_SIGN, COST_TWICE, COST_MORE, COST_END = 0.5, 0.7, 3.0, 0.3, 1.0
#: Lengths of the word beginnings that are features besides whole words.
STEMS = (3, 4, 5, 6, 7)
#: Most labelled rows that the classifier is fitted on, a sample by a hash of the id; and most features it may use.
TRAIN_ROWS, FEATURES = 20_000, 4096
#: Least toxic rows with a feature, least log-odds of one, and the L1 penalty of the fit.
LEAST, ODDS, PENALTY = 2, 1.0, 0.1
#: Distinct chunks of text that a worker remembers; then it starts afresh. Results never depend on it.
MEMO_SIZE = 100_000

WORD = re.compile(r"[^\W\d_]+")
#: Single characters, signs that may stand for letters among them, with separators between them: three or more.
SPACED = re.compile(r"(?<![\w@$!|+])(?:(?:[^\W_]|[@$!|+])[ .*_\-]{1,3}){2,}(?:[^\W_]|[@$!|+])(?![\w@$!|+])")
LETTER = re.compile(r"[^\W\d_]")
#: A character that may stand for a letter.
SIGN = re.compile(f"[{re.escape(''.join(LEET))}]")
#: A letter three times, or two letters twice.
RUN = re.compile(r"([^\W\d_])\1\1|([^\W\d_])\2.*([^\W\d_])\3")
EDGES = ".,;:?!\"'()[]{}<>#%&*=~`^/\\_-|+"
#: Those that stand for no letter.
PLAIN = "".join(c for c in EDGES if c not in LEET)
#: Character classes of the language model: a boundary, a-z, and any other letter.
OTHER, CLASSES = 27, 28


def byte_classes() -> np.ndarray:
    """The class of each byte of lower-cased UTF-8; the second and later bytes of a letter get -1."""
    table = np.zeros(256, np.int64)
    table[97:123] = np.arange(1, 27)
    table[0xC3:0xF5] = OTHER
    table[0x80:0xC0] = -1
    return table


CLASS_OF = byte_classes()


#: Between single characters: a boundary or nothing.
GAP = [(" ", COST_END), ("", 0.0)]


def letter_class(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER if c.isalpha() else 0


class CharModel:
    """Trigrams of character classes, interpolated with bigrams and single classes: costs in nats."""

    def __init__(self, counts: np.ndarray) -> None:
        c3 = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
        p1 = (c1 + 1) / (c1.sum() + CLASSES)
        p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
        p3 = (c3 + 2 * p2) / (c3.sum(axis=2, keepdims=True) + 2)
        self.cost = (-np.log(p3)).tolist()

    def decode(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The cheapest reading, by Viterbi over states of the last two classes. An option is (letters, channel cost)."""
        beam: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for options in [*lattice, [(" ", 0.0)]]:
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, path) in beam.items():
                for letters, extra in options:
                    x, y, total = a, b, cost + extra
                    for c in letters:
                        z = letter_class(c)
                        if z or y:  # boundaries in a row count once
                            total += self.cost[x][y][z]
                            x, y = y, z
                    if (x, y) not in after or total < after[x, y][0]:
                        after[x, y] = (total, (path, letters))
            beam = after
        least = min(cost for cost, _ in beam.values())
        return min(spelled(path) for cost, path in beam.values() if cost == least).strip()


def spelled(path: tuple) -> str:
    """The text of a path, a chain of (path before, letters)."""
    out = []
    while path:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out))


def letters_lattice(chunk: str) -> list[list[tuple[str, float]]]:
    """What each run of equal characters of a chunk may stand for."""
    out = []
    for c, group in groupby(chunk):
        n = len([*group])
        own = c if c.isalpha() else " "
        options = [(own * min(n, 2), COST_SIGN if c in LEET else 0.0 if n <= 2 else COST_MORE)]
        if n > 1 and c.isalpha():
            options.append((c, COST_TWICE if n == 2 else COST_MORE))
        for letter in LEET.get(c, ""):
            options += [(letter * k, COST_LEET) for k in {1, min(n, 2)}]
        out.append(options)
    return out


def spaced_lattice(text: str) -> list[list[tuple[str, float]]]:
    """Single characters with gaps, each a boundary or nothing."""
    out = []
    for c in text:
        if c.isalnum() or c in LEET:
            out.append([(c, 0.0) if c.isalpha() else (" ", COST_SIGN), *((letter, COST_LEET) for letter in LEET.get(c, ""))])
        elif out[-1] is not GAP:
            out.append(GAP)
    return out


def as_letters(lattice: list[list[tuple[str, float]]], signs: list[str]) -> list[list[tuple[str, float]]]:
    """The lattice of these characters with the signs at the edges as letters."""
    inner = [i for i, c in enumerate(signs) if c not in EDGES and c != " "]
    lead, tail = (inner[0], inner[-1]) if inner else (len(signs), -1)
    return [options[1:] if c in LEET and not lead <= i <= tail else options for i, (c, options) in enumerate(zip(signs, lattice, strict=True))]


class Restorer:
    """Words of a text as its writer meant them."""

    def __init__(self, model: CharModel) -> None:
        self.model, self.memo = model, {}

    def chunk(self, chunk: str) -> tuple[str, ...]:
        """The words of a chunk. A sign at its edge may be punctuation or a letter: the words of both readings count."""
        core = chunk.strip(EDGES)
        if core.isalpha() and not RUN.search(core):
            out = [core]
        elif RUN.search(core) or (LETTER.search(core) and SIGN.search(core)):
            out = WORD.findall(self.model.decode(letters_lattice(core)))
        else:
            out = WORD.findall(core)
        whole = chunk.strip(PLAIN)
        if whole != core and LETTER.search(core):
            out += WORD.findall(self.model.decode(as_letters(letters_lattice(whole), [c for c, _ in groupby(whole)])))
        return tuple(out)

    def spaced(self, text: str) -> str:
        lattice = spaced_lattice(text)
        read = self.model.decode(lattice)
        if text[0] in EDGES or text[-1] in EDGES:
            signs = [c for own, group in groupby(text, lambda c: c.isalnum() or c in LEET) for c in (group if own else " ")]
            read += " " + self.model.decode(as_letters(lattice, signs))
        return read

    def words(self, text: str) -> set[str]:
        low, out, memo = text.lower(), set(), self.memo
        if SPACED.search(low):
            low = SPACED.sub(lambda m: self.spaced(m[0]), low)
        if len(memo) > MEMO_SIZE:
            memo.clear()
        for c in set(low.split()):
            if (found := memo.get(c)) is None:
                found = memo[c] = self.chunk(c)
            out.update(found)
        return out


def stems(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in STEMS if len(word) > n)]


def char_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Trigram counts of all texts; the driver gets one row for each trigram of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in byte_slices(batches, text_col):
            buf, _ = text_bytes(batch.column(text_col))
            c = CLASS_OF[lower_ascii(buf)]
            c = np.concatenate([[0], c[c >= 0], [0]])
            c = c[np.concatenate([[True], (c[1:] > 0) | (c[:-1] > 0)])]
            if len(c) > 1:
                c = np.concatenate([[0], c])
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(total[on])], names=["gram", "n"])

    got = docs.select(text_col).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES**3, np.int64)
    out[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    return out


def sparse_logistic(rows: list[list[int]], y: np.ndarray, n: int, penalty: float = PENALTY, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic regression on 0/1 features, by accelerated proximal gradient."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([j for r in rows for j in r], np.int64)
    rate = 4.0 / max(1.0, float(max((len(r) for r in rows), default=0) + 1) * max(1.0, np.bincount(col, minlength=1).max(initial=0)) ** 0.5 + len(rows) ** 0.5)
    w, v, t, b = np.zeros(n), np.zeros(n), 1.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(steps):
        z = b + np.bincount(row, v[col], minlength=len(rows))
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        new = v - rate * np.bincount(col, g[row], minlength=n)
        new = np.sign(new) * np.maximum(0, np.abs(new) - rate * penalty)
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / after * (new - w), new, after
        p = g + y
        b -= g.sum() / max(1e-3, (p * (1 - p)).sum() + 1)
    return w, b


def shifted(rows: list[list[int]], y: np.ndarray, n: int, cut: float) -> float:
    """What to add to scores (in logits) so that ``cut`` tells classes apart best, by F1 over three cross-fitted folds.

    Of equally good places the one nearest to no shift is taken.
    """
    z = np.zeros(len(rows))
    fold = np.arange(len(rows)) % 3
    for k in range(3):
        own, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        w, b = sparse_logistic([rows[i] for i in rest], y[rest], n)
        z[own] = [b + sum(w[j] for j in rows[i]) for i in own]
    order = np.argsort(-z, kind="stable")
    hits, told = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    f1 = 2 * hits / (told + y.sum())
    last = np.append(z[order][1:] != z[order][:-1], True)  # equal scores fall on one side
    best = np.flatnonzero(last & (f1 >= f1[last].max() - 1e-12))
    at = math.log(cut / (1 - cut))
    places = []
    for i in best:
        high, low = z[order][i], z[order][i + 1] if i + 1 < len(z) else z[order][i] - 2.0
        places.append(min(max(at, (high + 3 * low) / 4), (3 * high + low) / 4))  # well between the two
    return at - min(places, key=lambda t: abs(t - at))


def fit(train: DataFrame, model: CharModel, cut: float, features: int) -> tuple[dict[str, float], float]:
    """Weights of features and the intercept, from rows (text, y)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, tally = Restorer(model), (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1), strict=True):
                tally[y.as_py()].update({s for w in restorer.words(text.as_py()) for s in stems(w)})
        for y, counts in enumerate(tally):
            keys = list(counts)
            for at in range(0, len(keys), 50_000):
                part = keys[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([y] * len(part), pa.int32()), pa.array([counts[k] for k in part], pa.int64())], names=["feature", "y", "n"])

    n = [0, 0]
    for r in train.groupBy("y").count().collect():  # two rows
        n[r["y"]] = r["count"]
    if not all(n):
        return {}, math.log((n[1] + 0.5) / (n[0] + 0.5)) if any(n) else 0.0
    on = lambda y: F.coalesce(F.sum(F.when(F.col("y") == y, F.col("n"))), F.lit(0))
    seen = train.select("text", "y").mapInArrow(count, "feature string, y int, n long").groupBy("feature").agg(on(0).alias("n0"), on(1).alias("n1"))
    odds = F.log((F.col("n1") + 0.5) / (n[1] + 1)) - F.log((F.col("n0") + 0.5) / (n[0] + 1))
    best = seen.where(f"n1 >= {LEAST}").withColumn("odds", odds).where(f"odds > {ODDS}").orderBy((F.col("odds") * F.sqrt("n1")).desc(), F.length("feature"), "feature").limit(features).select("feature").collect()
    index = {r["feature"]: i for i, r in enumerate(best)}

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            found = [sorted({index[s] for w in restorer.words(t.as_py()) for s in stems(w) if s in index}) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], names=["found", "y"])

    got = train.select("text", "y").mapInArrow(met, "found array<int>, y int").collect()  # at most about TRAIN_ROWS short lists
    got = sorted((r["found"], r["y"]) for r in got)
    rows, y = [f for f, _ in got], np.array([v for _, v in got], float)
    w, b = sparse_logistic(rows, y, len(index))
    return {f: float(w[i]) for f, i in index.items() if w[i]}, float(b) + shifted(rows, y, len(index), cut)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", cut: float = 0.7, train_rows: int = TRAIN_ROWS, features: int = FEATURES, keep: Sequence[str] = ()) -> DataFrame:
    """How likely each whole text is toxic, learned from labels of rows whose crc32(id as text) mod 3 is not 1.

    The language model counts all texts; the classifier is fitted on about ``train_rows`` labelled rows at most,
    chosen by a hash of the id, equal texts once, and uses at most ``features`` words and word beginnings, the most
    telling ones of these rows; scores are calibrated so that ``cut`` tells the classes of cross-fitted rows apart. Inputs of a score are the restored words of the text alone. A null
    or empty text has no words and gets the base rate; null ids count as not held out; labels with a null id or value
    are ignored; of repeated labels of an id the larger counts; repeated rows are scored one by one; other columns
    are ignored unless in ``keep``; empty tables are fine (without labels every score is 0.5). Returns id, ``keep``,
    held_out, score, predicted (1 from ``cut`` on).
    """
    bound_batches(docs.sparkSession)
    held = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = CharModel(char_counts(docs, text_col))
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).where("_id is not null and y in (0, 1)").where(~held(F.col("_id")))
    known = known.groupBy("_id").agg(F.max("y").alias("y"))
    share = min(1.0, train_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    train = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where("text is not null").join(known, "_id")
    train = train.groupBy(F.xxhash64("text").alias("_h"), "y").agg(F.min_by("text", "_id").alias("text"))
    weights, base = fit(train.select("text", "y"), model, cut, features)
    lengths = sorted({len(f) for f in weights if f[-1] != "$"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, memo = Restorer(model), {}
        for batch in batches:
            out = []
            for text in batch.column(1):
                hits: set[str] = set()
                for w in restorer.words(text.as_py() or ""):
                    if (found := memo.get(w)) is None:
                        if len(memo) > MEMO_SIZE:
                            memo.clear()
                        found = memo[w] = tuple(s for s in (w + "$", *(w[:n] for n in lengths if len(w) > n)) if s in weights)
                    if found:
                        hits.update(found)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, base + math.fsum(weights[h] for h in hits))))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(out, pa.float64())], names=[id_col, *keep, "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    scored = docs.select(id_col, text_col, *keep).mapInArrow(run, f"{kinds}, score double")
    return scored.select(id_col, *keep, held(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
