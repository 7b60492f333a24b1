"""Greedy string tiling against a plain search for the longest common run of unmarked tokens."""

import random

import pytest

pytest.importorskip("matchgrain.llm")
import numpy as np

from matchgrain.llm import decontamination


def plain_tiles(doc, item, width):
    free_doc, free_item, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = None
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and free_doc[d + n] and free_item[i + n]:
                    n += 1
                if n >= width and (best is None or (-n, d, i) < best):
                    best = (-n, d, i)
        if best is None:
            return out
        n, d, i = -best[0], best[1], best[2]
        free_doc[d : d + n], free_item[i : i + n] = [False] * n, [False] * n
        out.append((d, i, n))


@pytest.mark.parametrize("seed", range(40))
def test_tiles_are_those_of_the_plain_search(seed):
    r = random.Random(seed)
    width, letters = r.choice([2, 3, 5]), r.choice(["ab", "abc", "abcdefgh"])
    item = [r.choice(letters) for _ in range(r.randrange(width, 30))]
    parts = [item[a : a + r.randrange(1, 12)] if r.random() < 0.7 else [r.choice(letters + "xy")] for a in (r.randrange(len(item)) for _ in range(8))]
    doc = [c for p in parts for c in p]
    seeds = [(d, i) for d in range(len(doc) - width + 1) for i in range(len(item) - width + 1) if doc[d : d + width] == item[i : i + width]]
    want = plain_tiles(doc, item, width)
    got = [tuple(map(int, t)) for t in decontamination.tile(*map(np.array, zip(*seeds, strict=True)), width, len(item))] if seeds else []
    assert sorted(got) == sorted(want)


def test_whole_documents_are_judged_by_their_tiles(spark):
    r, rows = random.Random(3), []
    words = [f"w{i}" for i in range(40)]
    items = {k: [r.choice(words) for _ in range(r.randrange(3, 40))] for k in range(12)}
    for k in range(60):
        own = items[r.randrange(12)]
        half = len(own) // 2
        text = own[half:] + [r.choice(words) for _ in range(r.randrange(6))] + own[: r.randrange(half + 1)] + [r.choice(words) for _ in range(5)]
        rows.append((k % 50, text))
    want = sorted((k, sorted(i for i, item in items.items() if len(item) >= 5 and sum(n for _, _, n in plain_tiles(text, item, 5)) >= 0.6 * len(item))) for k, text in rows)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items.items()], "item_id long, text string")
    got = sorted((x.doc_id, list(x.item_ids)) for x in decontamination.contamination(docs, bench).collect())
    assert got == want and 10 < sum(bool(i) for _, i in want) < 60
