"""Benchmarks in several blocks give the rows of one block, whatever ids, texts and other columns there are."""

import pytest

pytest.importorskip("matchgrain.llm")
from matchgrain.llm import decontamination


def test_blocks_give_the_rows_of_one_block(spark, monkeypatch):
    items = [(i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(6)] + [(6, None), (None, "a b c d e f"), (7, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    text = dict(items)
    rows = [(1, text[0]), (1, text[0]), (2, text[1] + " and " + text[2]), (None, text[3]), (3, None), (4, ""), (5, "word " * 200_000 + text[4]), (6, "clean text")]
    docs = spark.createDataFrame([(*r, 1, 2, True) for r in rows], "doc_id long, text string, i int, t int, contaminated boolean").repartition(3)
    run = lambda: sorted((tuple(r) for r in decontamination.contamination(docs, benchmark).collect()), key=repr)
    whole = run()
    assert [(r[0], r[3]) for r in whole if r[1]] == [(1, [0]), (1, [0]), (2, [1, 2]), (5, [4]), (None, [3])]
    assert len(whole) == len(rows)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 150)
    assert run() == whole
    assert decontamination.contamination(docs.limit(0), benchmark).count() == 0
