"""Texts that defeat rolling hashes modulo a power of two, and clashing columns of the pipeline."""

import hashlib

import pytest

pytest.importorskip("matchgrain.llm")
import corpus_pipeline
import numpy as np

from matchgrain.llm import decontamination, near_dedup, repeats, textbytes


def thue_morse(n, flip=False):
    return "".join("ab"[(i.bit_count() & 1) ^ flip] for i in range(n))


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_complementary_words_are_told_apart(spark, size):
    one, two = thue_morse(size), thue_morse(size, True)
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"{one} tail"), (4, one)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, percent=85).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 1)}
    words = " ".join(f"w{i}" for i in range(10))
    items = spark.createDataFrame([(1, f"{words} {one} {words}")], "item_id long, text string")
    bad = {r.doc_id for r in decontamination.contamination(docs.union(spark.createDataFrame([(5, f"x {words} {one} {words}")], docs.schema)), items).where("contaminated").collect()}
    assert bad == {5}


@pytest.mark.parametrize("size", [1024, 4096])
def test_repeats_of_complementary_texts_equal_brute_force(spark, size):
    texts = [thue_morse(size), thue_morse(size, True), "x" * 50 + thue_morse(size)]
    seen, want = set(), []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - 99):
            if t[i : i + 100] in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(t[i : i + 100])
        want.append((sum(gone), hashlib.sha256("".join(c for c, g in zip(t, gone, strict=True) if not g).encode()).hexdigest()))
    got = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_removed, r.kept_sha256) for r in got] == want


def test_overlap_counts_words_themselves():
    a, b = "A b c d e f g", "a b c d e f h"
    assert near_dedup.overlap(a, b) == (3, 3, 2)
    assert near_dedup.overlap("x y", "X  y") == (1, 1, 1)
    assert near_dedup.overlap("x y", "x y z w v")[2] == 0
    assert near_dedup.overlap("", "x") == (0, 1, 0)


def test_word_hashes_depend_on_the_word_alone():
    text = b"ab abc abcdefgh abcdefghi " + b"q" * 64 + b" " + b"q" * 65 + b" ab"
    buf = np.frombuffer(text, np.uint8)
    starts, ends, _ = textbytes.word_spans(buf, np.array([0, len(buf)]), textbytes.NOT_SPACE)
    h = textbytes.word_hash(buf, starts, ends)
    assert h[0] == h[-1] == textbytes.string_hash("ab") and len(set(h.tolist())) == 6
    assert not set(h.tolist()) & set(textbytes.word_hash(buf, starts, ends, 1).tolist())


def test_columns_named_like_row_numbers_are_no_row_numbers(spark):
    text = "one two three four five six"
    docs = spark.createDataFrame([(1, text, 7, 1), (2, text, 7, 1), (3, "another text that has words of its own", 7, 1)], "doc_id long, text string, _row long, _Row_ long")
    got = corpus_pipeline.without_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]
