"""Plain twins of packing and of base spans, and operators by row on null, repeated and clashing rows."""

import random
import re
from collections import Counter

import pytest

pytest.importorskip("matchgrain.llm")
import public_tokenizers

from matchgrain.llm import byte_bpe, packing, pii

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def plain_best_fit(lengths, size):
    """What is left in each bin when every piece, the longest first, goes to the tightest bin that takes it."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, left in enumerate(bins) if left >= n]
        if fits:
            bins[min(fits, key=bins.__getitem__)] -= n
        else:
            bins.append(size - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(25))
def test_layout_is_that_of_plain_best_fit_decreasing(seed):
    r = random.Random(seed)
    size = r.choice([7, 20, 64, 100])
    top = r.choice([size, max(1, size // 2), 5])
    lengths = [r.randint(1, top) for _ in range(r.randrange(120))]
    rows = packing.best_fit_layout(Counter(lengths), size)
    used, spans, pieces = Counter(), {}, Counter()
    for length, _, number, each, first, offset in rows:
        for b in range(first, first + number):
            used[b] += each * length
            pieces[length] += each
            spans.setdefault(b, []).extend((offset + k * length, length) for k in range(each))
    assert sorted(size - n for n in used.values()) == plain_best_fit(lengths, size) and pieces == Counter(lengths)
    for own in spans.values():  # gapless from 0
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_base_spans_are_those_of_the_plain_patterns():
    r = random.Random(8)
    parts = ["4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "10.0.0.1", "256.1.1.1", "1.2.3.4.5", "0001.2.3.255", "+1 (415) 555-0123", "+49.30.123456", "+1", "a.b+c@x.y-z.org", "@x.y", "a@b", "a@b.c@d.e", "٣٤"]
    seen = Counter()
    for i in range(4000):
        text = "".join(r.choice("0123456789. -+()@ab") for _ in range(r.randrange(60))) if i % 2 else r.choice(["", " ", "-", "x"]).join(r.choice(parts) for _ in range(r.randrange(1, 5)))
        want = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if holds(k, m[0])]
        assert pii.base_spans(text) == want, text
        seen.update(k for k, _, _ in want)
    assert min(seen[k] for k in PATTERNS) > 50


SCHEMA = "doc_id long, text string, piece int, length long, n_tokens long, offset long, spans string, redacted string"
ROWS = [(None, "mail a@b.org now"), (None, "mail a@b.org now"), (1, "one two"), (1, "one two"), (1, "other text"), (2, None), (3, ""), (4, "word " * 3000), (4, None)]


def test_rows_stand_for_themselves_whatever_their_ids(spark):
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, "x", "y") for i, t in ROWS], SCHEMA)
    tokens = Counter((r.doc_id, r.n_bytes) for r in byte_bpe.token_counts(docs, VOCABULARY).collect())
    assert tokens == Counter((i, len((t or "").encode())) for i, t in ROWS)
    found = Counter((r.doc_id, r.n_email, r.redacted) for r in pii.find_pii(docs).collect())
    assert found == Counter((i, int("@" in (t or "")), t and t.replace("a@b.org", "[EMAIL]")) for i, t in ROWS)
    packed = packing.pack(docs, VOCABULARY).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(i for i, _ in ROWS)
    assert sum(r.length for r in packed) == sum(r.n_tokens + 1 for r in byte_bpe.token_counts(docs, VOCABULARY).collect())
    spans = Counter((r.sequence_id, r.offset) for r in packed)
    assert max(spans.values()) == 1
