"""Hard negatives, clusters and line dedup against brute force, with odd rows."""

import hashlib
import math
import random

import pytest

pytest.importorskip("matchgrain.llm")
import numpy as np
from comparing import compare, connected

from matchgrain.llm import delta_lloyd, distance_keys, line_dedup, queries

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, v string, id int, w int"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_delta_lloyd", "op13_line_dedup"])
def test_queries_give_the_rows_of_their_sql(spark, name):
    compare(spark, connected(SF), queries.queries()[name], queries.oracle_sql()[name], SF)


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in rows], VECTORS)


def usable(v, width=None):
    return v is not None and (width is None or len(v) == width) and all(x is not None and math.isfinite(x) for x in v)


def whole(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def negatives(rows, every=100):
    rows = [(i, whole(v, 256), label) for i, v, label in rows if i is not None and label is not None and usable(v)]
    by_id = {}
    for i, v, label in rows:
        by_id[i] = min(by_id.get(i, (label, v)), (label, v))
    out = []
    for a, (la, va) in by_id.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v, strict=True)), i, label) for i, (label, v) in by_id.items() if i != a and len(v) == len(va))
        for p, pid, _ in [s for s in scored if s[2] == la][:5]:
            fits = [s for s in scored if s[2] != la and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(a, pid, k, i, -p, -s) for k, (s, i, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    got = distance_keys.hard_negatives(table(spark, rows), **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def cloud(n, width, groups, seed):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(groups, width))
    return [(i, [float(x) for x in (centers[i % groups] + 0.3 * r.normal(size=width)).astype(np.float32)], int(r.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("sample", [4096, 20])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, sample):
    monkeypatch.setattr(distance_keys, "SAMPLE", sample)
    monkeypatch.setattr(distance_keys, "BLOCK_BYTES", 1000)
    rows = cloud(400, 8, 5, 1)
    rows += [(1000 + i, rows[3][1], i % 2) for i in range(60)]  # copies
    rows += [(2000, [0.0] * 8, 1), (2001, [0.0] * 8, 2), (2100, [5e3] * 8, 1), (2101, [4e3] * 8, 2), (2102, [4.9e3] * 8, 1)]
    assert mined(spark, rows, anchor_every=20) == negatives(rows, 20)


def test_hard_negatives_of_odd_rows(spark):
    near = [1.0, 0.5, 0.25]
    rows = [(0, near, 1), (1, near, 1), (2, near, 2), (3, [0.9, 0.5, 0.25], 2), (4, None, 2), (5, [None, 1.0, 1.0], 2), (6, [float("nan"), 1.0, 1.0], 2), (7, [math.inf, 1.0, 1.0], 2)]
    rows += [(8, near, None), (None, near, 2), (9, near[:2], 2), (10, [], 2), (100, [], 1), (101, [], 1), (2, near, 2), (2, [0.95, 0.5, 0.25], 2), (200, [-1.0, 0.0, 0.0], 1), (300, [3e38, 1.0, 1.0], 3), (301, [3e38, 0.0, 0.0], 3)]
    got = mined(spark, rows)
    assert [r for r in got if r[0] != 300 and 300 not in r[1:2] + r[3:4] and 301 not in r[1:2] + r[3:4]] == [r for r in negatives(rows) if not {300, 301} & {r[0], r[1], r[3]}]
    assert mined(spark, []) == []


def clustered(rows, k=16, rounds=3, width=64):
    kept = sorted(((i, whole(v, 64)) for i, v, _ in rows if usable(v, width)), key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in kept[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(centers)), key=lambda c: (far(v, centers[c]), c))
    for _ in range(rounds):
        owners = [nearest(v) for _, v in kept]
        for c in range(len(centers)):
            own = [v for (_, v), o in zip(kept, owners, strict=True) if o == c]
            if own:
                centers[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = [(i, nearest(v)) for i, v in kept]
    out = [(i, c, far(v, centers[c])) for (i, c), (_, v) in zip(out, kept, strict=True)]
    total = lambda c: sum(d for _, x, d in out if c in (x, None))
    return sorted([(i, c, d, total(c), total(None), hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()) for i, c, d in out], key=repr)


def lloyd(spark, rows, **kw):
    return sorted([tuple(r) for r in delta_lloyd.delta_lloyd(table(spark, rows), **kw).collect()], key=repr)


def test_delta_lloyd_equals_plain_rounds(spark):
    rows = cloud(300, 8, 7, 2)
    odd = [(None, rows[0][1], 1), (5, rows[9][1], 1), (5, rows[9][1], None), (901, None, 1), (902, rows[0][1][:7], 1), (903, [None] * 8, 1), (904, [float("nan")] * 8, 1), (905, [math.inf] * 8, 1), (906, [], 1)]
    for rounds in (1, 3, 12):
        assert lloyd(spark, rows + odd + rows[:40], width=8, rounds=rounds) == clustered(rows + odd + rows[:40], width=8, rounds=rounds)
    assert lloyd(spark, rows[:5], width=8) == clustered(rows[:5], width=8)
    assert lloyd(spark, odd[3:], width=8) == lloyd(spark, [], width=8) == []


def test_delta_lloyd_is_exact_for_large_vectors(spark):
    r = random.Random(1)
    rows = [(i, [float(np.float32(r.uniform(-1, 1) * 10 ** r.choice([0, 3, 6]))) for _ in range(4)], 1) for i in range(120)]
    assert lloyd(spark, rows, width=4, k=6) == clustered(rows, width=4, k=6)
    far = [*rows, (500, [3e38, -3e38, 1.0, 1.0], 1)]
    got = {x[0]: x[1:3] for x in lloyd(spark, far, width=4, k=6)}
    want = {x[0]: (x[1], x[2] if x[2] < 2**63 else None) for x in clustered(far, width=4, k=6)}
    assert got == want


def test_only_moved_centroids_are_compared():
    at = delta_lloyd.Centroids([(0, 0), (10, 0), (0, 10)], [1])
    x = np.array([[1.0, 1.0], [6.0, 0.0], [9.0, 9.0]])
    owner, distance = at.assign(x, np.array([0, 0, 2]), np.array([2, 36, 82]))
    assert owner.tolist() == [0, 1, 1] and distance.tolist() == [2, 16, 82]


DOCS = "doc_id long, text string, line string, doc int, at int, kind int"


def deduped(rows, least=10):
    strip, key = " \t\n\x0b\x0c\r", {}
    lower = {c: c + 32 for c in range(65, 91)}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(x.strip(strip)) >= least:
                key.setdefault(x.strip(strip).translate(lower), set()).add((i is None, i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(own := key.get(x.strip(strip).translate(lower), ())) < 2 or min(own) == (i is None, i)]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def run_lines(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], DOCS)
    bitmaps = line_dedup.keep_bitmaps(docs)
    got = line_dedup.kept_texts(docs, bitmaps)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()], key=repr), bitmaps


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(4)
    pool = [f"a line of some words {i}" for i in range(30)] + ["short", "", "  A LINE of some words 3\t", "ÉCOLE Été 2024", "école été 2024", "ten chars!", " a line of some words 4", "\r", "a line of some words 5\x85"]
    rows = [(r.randrange(60), "\n".join(r.choice(pool) for _ in range(r.randrange(12)))) for _ in range(120)]
    rows += [(None, "a line of some words 1\nown line of null ids"), (None, "own line of null ids"), (7, None), (8, ""), (-3, "a line of some words 2\n\n"), (9, "\n".join(["the hot line here"] * 3))]
    rows += [(1000 + i, f"the hot line here\nown {i % 3}\nthe hot line here") for i in range(200)] + rows[:10]
    rows += [(2000, "\n".join(f"line number {i} of a long text" for i in range(30000))), (2001, "line number 29999 of a long text")]
    got, bitmaps = run_lines(spark, rows)
    assert got == deduped(rows)
    assert bitmaps.count() == len(set(rows))
    one = bitmaps.where("id = 2001").first()
    assert line_dedup.unpack(one.keep, one.n_lines).tolist() == [False]
    assert run_lines(spark, [])[0] == []
