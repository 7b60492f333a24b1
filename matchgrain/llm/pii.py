"""Personal data: high-recall candidate generators, boosted trees over format and context, calibrated thresholds."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from matchgrain.llm.staging import bound_batches
from matchgrain.llm.textbytes import byte_slices

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE_KINDS = ("email", "ip", "card", "phone")

#: Generators of further candidates; they may overlap one another and the base spans.
GENERATORS = {
    "secret": re.compile(r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*[0-9])[A-Za-z0-9_/+-]{16,}+"),
    "keyed": re.compile(r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?([^\s\"']{6,})"),
    "local_phone": re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "spelled_email": re.compile(r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{1,64}\s?(?:\[at\]|\(at\)|\sat\s)\s?[a-z0-9-]{1,63}\s?(?:\[dot\]|\(dot\)|\sdot\s)\s?[a-z]{2,12}\b"),
}
KINDS = (*BASE_KINDS, *sorted(GENERATORS))
HINTS = re.compile(r"(?i)password|passwd|pwd|token|secret|key|auth|login|credential")
REACH = re.compile(r"(?i)call|phone|tel|mobile|mail|contact|reach|write|ssn|social")
BENIGN = re.compile(r"(?i)commit|version|sha|hash|isbn|build|checksum|article|item|order|model|revision|md5")
#: Characters of context that features look at on either side.
CONTEXT = 24
#: Made examples on which the trees are fitted and calibrated; the bound of the training sample.
EXAMPLES = 2400


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of a run of local characters, ``@`` and a dotted domain, in linear time."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start; matches that fail their check are dropped, without retries."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that the generators propose."""
    out = []
    for kind, pattern in GENERATORS.items():
        g = pattern.groups
        out += [(kind, m.start(g), m.end(g)) for m in pattern.finditer(text)]
    return out


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate, as numbers."""
    s, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    n = max(1, len(s))
    counts = Counter(s)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    digit, upper, lower = (sum(map(f, s)) / n for f in (str.isdigit, str.isupper, str.islower))
    return [
        float(KINDS.index(kind)), float(len(s)), digit, upper, lower, entropy, float(all(c in "0123456789abcdefABCDEF" for c in s)), sum(not c.isalnum() for c in s) / n,
        float(bool(HINTS.search(before))), float(bool(REACH.search(before))), float(bool(BENIGN.search(before))), float(before[-1:] in "\"'="), float(after[:1] in "\"'"), float(s.startswith("AKIA")), sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False)) / n,
    ]


def examples(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of candidates in made sentences: secrets and contacts, and things that only look alike."""
    rng = random.Random(seed)
    pick = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    upper, lower, digits, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    word = lambda: pick("aeioulnrst", rng.randrange(2, 9))
    good = [
        lambda: "AKIA" + pick(upper + digits, 16),
        lambda: f"password={pick(hexa, rng.randrange(8, 24))}",
        lambda: f'token = "{pick(hexa, rng.choice([32, 40, 64]))}"',
        lambda: f"{rng.choice(['secret', 'api_key', 'pwd', 'passwd'])}: {pick(lower + upper + digits, rng.randrange(10, 40))}",
        lambda: f"{rng.choice(['login', 'auth', 'key'])} {pick(lower + upper + digits, rng.randrange(20, 44))}",
        lambda: f"{rng.choice(['call', 'phone', 'tel', 'mobile'])} ({pick(digits, 3)}) {pick(digits, 3)}-{pick(digits, 4)}",
        lambda: f"{rng.choice(['ssn', 'social'])} {pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}",
        lambda: f"{rng.choice(['mail', 'write', 'contact', ''])} {pick(lower, 6)}{rng.choice([' at ', '(at)', '[at]'])}{pick(lower, 6)}{rng.choice([' dot ', '(dot)', '[dot]'])}{rng.choice(['com', 'org', 'net'])}",
    ]
    poor = [
        lambda: f"{rng.choice(['commit', 'sha', 'md5', 'checksum', 'build'])} {pick(hexa, rng.choice([32, 40, 64]))}",
        lambda: f"{word()}{pick(digits, 2)}-{word()}-{word()}-{word()}{word()}{word()}",
        lambda: f"{word()} {pick(digits, rng.randrange(16, 30))}",
        lambda: f"{rng.choice(['order', 'item', 'article', 'isbn', 'model'])} {pick(digits, 3)}-{pick(digits, 3)}-{pick(digits, 4)}",
        lambda: f"{rng.choice(['order', 'item', 'article', 'model'])} {pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}",
        lambda: f"{word()} {pick(digits, 3)} {pick(digits, 3)} {pick(digits, 4)}",
        lambda: f"token: {word()}{word()}{word()}",
        lambda: f"{pick(lower, 5)} at {pick(lower, 4)} dot {word()}",
        lambda: "_".join(word() for _ in range(4)) + pick(digits, 1),
    ]
    x, y = [], []
    while len(x) < n:
        label = len(x) % 2
        core = rng.choice(good if label else poor)()
        lead = " ".join(word() for _ in range(rng.randrange(6)))
        text = f"{lead} {core} {word()}"
        for kind, start, end in candidates(text):
            x.append(features(text, kind, start, end))
            y.append(label)
    return np.array(x[:n]), np.array(y[:n], float)


class BoostedTrees:
    """Gradient boosting of depth-2 trees on the logistic loss, with Platt-calibrated output."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2) -> None:
        held = np.arange(len(x)) % 3 == 0
        self.trees, self.platt = [], (1.0, 0.0)
        tx, ty = x[~held], y[~held]
        f = np.zeros(len(tx))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self.grow(tx, ty - p, p * (1 - p), 2)
            self.trees.append((rate, tree))
            f += rate * self.apply(tree, tx)
        z, (a, b) = self.raw(x[held]), self.platt
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            a, b = a - 0.05 * float(np.mean((p - y[held]) * z)), b - 0.05 * float(np.mean(p - y[held]))
        self.platt = (a, b)
        self.thresholds = self.calibrate(x[held], y[held])

    def grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> tuple:
        value = g.sum() / (h.sum() + 1.0)
        if not depth or len(x) < 20:
            return (value,)
        best = (1e-6, 0, 0.0)
        whole = g.sum() ** 2 / (h.sum() + 1.0)
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, cg, ch = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
            gain = cg[:-1] ** 2 / (ch[:-1] + 1) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1) - whole
            gain[v[1:] <= v[:-1]] = -1
            if len(gain) and gain.max() > best[0]:
                i = int(gain.argmax())
                best = (float(gain[i]), j, float(v[i] + v[i + 1]) / 2)
        if best[0] <= 1e-6:
            return (value,)
        left = x[:, best[1]] <= best[2]
        return (best[1], best[2], self.grow(x[left], g[left], h[left], depth - 1), self.grow(x[~left], g[~left], h[~left], depth - 1))

    def apply(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(x), tree[0])
        return np.where(x[:, tree[0]] <= tree[1], self.apply(tree[2], x), self.apply(tree[3], x))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sum((rate * self.apply(tree, x) for rate, tree in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.raw(x) + b, -30, 30)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float = 0.95) -> dict[int, float]:
        """For each kind, the least threshold from 0.5 on whose held-out precision suffices."""
        p, out = self.probability(x), {}
        for kind in np.unique(x[:, 0]):
            own = x[:, 0] == kind
            out[int(kind)] = next((t for t in np.arange(0.5, 1.0, 0.02) if (hit := own & (p >= t)).any() and y[hit].mean() >= precision), 0.99)
        return out


def all_spans(text: str, model: BoostedTrees) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, base and added spans). Of overlapping candidates the likelier stays, unless a base span covers it; base spans always do."""
    base, proposed = base_spans(text), candidates(text)
    if not proposed:
        return base, base
    p = model.probability(np.array([features(text, *c) for c in proposed]))
    good = [(-round(float(q), 9), c) for q, c in zip(p, proposed, strict=True) if q >= model.thresholds.get(KINDS.index(c[0]), 0.5)]
    taken: list[tuple[int, int]] = []
    added: list[tuple[str, int, int]] = []
    for _, (kind, start, end) in sorted(good):
        covered = any(s <= start and end <= e for _, s, e in base)
        if not covered and not any(s < end and start < e for s, e in taken):
            taken.append((start, end))
            added.append((kind, start, end))
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or union of overlapping spans, replaced by the name of its first kind."""
    out, last, done = [], 0, -1
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= done:
            out += [text[last:start], f"[{kind.upper()}]"]
        done = max(done, end)
        last = done
    return "".join([*out, text[last:]])


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of each whole text.

    Spans count code points, end exclusive. A null text is empty; ids may be null or repeat; other columns are
    ignored; an empty table gives an empty result. Returns id, n_email, n_ip, n_card, n_phone, base_sha256 (of the
    base spans), spans (base and added), redacted (the text without them; null for null).
    """
    bound_batches(docs.sparkSession)
    model = BoostedTrees(*examples(EXAMPLES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, text_col):
            rows = []
            for t in batch.column(1).to_pylist():
                base, spans = all_spans(t or "", model)
                n = Counter(k for k, _, _ in base)
                rows.append([*(n[k] for k in BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), None if t is None else redacted(t, spans)])
            cols = [*zip(*rows, strict=True)] or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])],
                names=[id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string")


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The same rows with all spans of each text replaced by the names of their kinds; null texts stay null."""
    bound_batches(docs.sparkSession)
    model = BoostedTrees(*examples(EXAMPLES))
    names = docs.columns
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, text_col):
            texts = [None if t is None else redacted(t, all_spans(t, model)[1]) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(batch.columns)], names=names)

    return docs.mapInArrow(run, docs.schema)
