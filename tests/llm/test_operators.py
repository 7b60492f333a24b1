"""Each operator against a brute-force version or a contract, on small fixtures with nulls, ties, copies and empty tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

pytest.importorskip("matchgrain.llm")
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matchgrain.llm import byte_bpe, cross_polytope, decontamination, license_scan, near_dedup, packing, pii, queries, repeats, toxicity, url_filter

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n int, place long"


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest table with odd rows, copies of rows, and columns whose names operators also use."""
    r = random.Random(5)
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    long = " ".join(r.choice(["tion", "the", "ouran", "ing"]) + r.choice("abcdef") for _ in range(400))
    rows += [(10_000, None), (10_001, ""), (10_002, "a" * 700), (10_003, long), (10_004, long + " more"), (10_005, long), (10_006, "é \u3000x" * 60), (10_007, " \n\t "), (10_008, long[200:600] + long[:300])]
    rows += [(10_009 + i, "x" * i + long[r.randrange(50) : r.randrange(200, 900)] + "y" * i) for i in range(20)]
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.5, 1, 2) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_repeats_equal_brute_force(docs, texts):
    seen, want = set(), {}
    for i, t in sorted(texts.items()):
        data, gone = t.encode(), bytearray(len(t.encode()))
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(data[k : k + 100])
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        want[i] = len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect()}
    assert got == want


def test_repeats_null_and_repeated_ids(spark):
    t = "abcdefghij" * 30
    rows = repeats.remove_repeats(spark.createDataFrame([(None, t), (1, t), (1, t), (2, t)], "doc_id long, text string")).collect()
    assert len(rows) == 4
    assert next(r for r in rows if r.doc_id == 2).n_removed == 300
    assert next(r for r in rows if r.doc_id is None).n_removed == 0
    assert repeats.remove_repeats(empty(spark)).count() == 0


def test_token_counts_and_packing_equal_the_library(docs, texts):
    t = Tokenizer.from_file(BPE)
    ids = {i: [*t.encode(x, add_special_tokens=False).ids] for i, x in texts.items()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in byte_bpe.token_counts(docs, BPE).collect()}
    assert got == {i: (len(texts[i].encode()), len(x), len(x) > 1024) for i, x in ids.items()}
    pieces = packing.pack(docs, BPE).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for i, x in ids.items():
        own, at = sorted(by_doc[i], key=lambda p: p.piece), 0
        for p in own:
            data = b"".join(v.to_bytes(4, "little") for v in (x + [0])[at : at + p.length])
            assert (p.start, p.ids_crc32) == (at, zlib.crc32(data)) and p.length <= 2048
            at += p.length
        assert at == len(x) + 1
    for rows in by_sequence.values():
        at = 0
        for p in sorted(rows, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    total = sum(p.length for p in pieces)
    assert len(by_sequence) <= -(-total // 2048) * 11 / 9 + 1


def test_packing_and_counts_of_an_empty_table(spark):
    assert packing.pack(empty(spark), BPE).count() == byte_bpe.token_counts(empty(spark), BPE).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(docs, texts, percent):
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if x == old else x for i, x in label.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, percent=percent).collect()}
    assert got == {i: (len(sets[i]), label[i], label[i] == i) for i in ids}


def test_near_duplicates_odd_tables(spark):
    rows = near_dedup.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "g h i j k l"), (4, "g h i j k l")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (3, 3), (3, 3), (4, 3)]
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_hyperminhash_estimates_are_close():
    import numpy as np

    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 3000, dtype=np.int64).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[1000:])
    got = near_dedup.estimates(near_dedup.registers(a)[None], near_dedup.registers(b)[None])[0]
    assert abs(got - 1 / 3) < 0.15


def test_toxicity_restores_disguised_words_and_holds_labels_out(spark):
    r = random.Random(2)
    plain = [f"{r.choice(['the', 'ouran', 'tion'])} {r.choice(['ing', 'able', 'ness'])} " * 5 for _ in range(240)]
    rows = [(i, t + ("moron here" if i % 4 == 0 else "kind person here")) for i, t in enumerate(plain)]
    odd = [(900, "the m0r0n here"), (901, "the m o r o n here"), (902, "you mooooron"), (903, None), (904, ""), (None, "kind person")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score_toxicity(docs, labels).collect()}
    assert all(got[i].predicted == (i % 4 == 0) for i, _ in rows)
    assert [got[i].predicted for i in (900, 901, 902, 903, 904)] == [1, 1, 1, 0, 0]
    assert all(x.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, x in got.items())
    none = toxicity.score_toxicity(docs, labels.limit(0)).collect()
    assert {x.score for x in none} == {0.5} and toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_url_rules_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    got = sorted(tuple(r) for r in queries.op1_url_filter(spark, SF).collect())
    assert got == sorted(con.execute(queries.URL_SQL).fetchall())
    odd = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://A.Example.ORG/es/x?y"), (3, "http://example.org"), (None, "x://b.com/de/#a://org/"), (5, "http://")], "page_id long, url string")
    rules = spark.createDataFrame(queries.RULES + [(None, "/", "block")], "host string, path string, verdict string")
    rows = sorted(((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(odd, rules).collect()), key=repr)
    assert rows == sorted([(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.org", "/es/x", "example.org/es/", "block"), (3, "example.org", "", None, "allow"), (0, "b.com", "/de/", "com/de/", "block"), (5, "", "", None, "allow")], key=repr)
    assert {r.verdict for r in url_filter.judge(odd, rules.limit(0)).collect()} == {"allow"} and url_filter.judge(odd.limit(0), rules).count() == 0


def test_license_scan_equals_brute_force(spark, docs, texts):
    extra = [(1, "Under the MIT License, under the mit license"), (2, None), (3, "apache license\nversion 2"), (4, "cc by\x00nc and CC-BY-NC"), (5, "this program is free software: redistribute it under the gnu lesser general public license")]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(20_000 + i, t) for i, t in extra], "doc_id long, text string"))
    for r in license_scan.scan(table).collect():
        text = texts.get(r.doc_id) if r.doc_id in texts else dict((20_000 + i, t or "") for i, t in extra)[r.doc_id]
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in places]
        base = sorted({label for _, label in places})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base))
        want = set(base)
        for line in text.split("\n"):
            held = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))
            want |= {label for t, label in license_scan.TEMPLATES.items() if len(held & set(t.split())) >= 0.8 * len(set(t.split())) - 1e-9}
        assert r.labels == ",".join(sorted(want))
    assert license_scan.scan(empty(spark)).count() == 0


def test_nearest_vectors_have_recall(spark):
    import numpy as np

    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = defaultdict(list)
    for r in cross_polytope.search(table).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]])
        own = sorted(got[ids[i]])
        assert [r for r, _, _ in own] == [*range(1, len(own) + 1)]
        assert all(abs(score - float(x[ids == v][0] @ x[i])) < 1e-9 for _, v, score in own)
        hits += len(best & {v for _, v, _ in own})
    assert hits >= 0.9 * 20 * len(got)


def test_nearest_vectors_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [nan, 1.0]), (4, [0.0, 0.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, []), (7, [1.0])]
    got = {(r.query_id, r.rank): r.vec_id for r in cross_polytope.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {(0, 1): 20, (0, 2): 1, (20, 1): 0, (20, 2): 1}
    assert cross_polytope.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_decontamination_finds_reordered_passages(spark):
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "too short"), (None, " ".join(words))], "item_id long, text string")
    moved = " ".join(words[20:] + ["x"] + words[:20])
    rows = [(1, "start " + " ".join(words)), (2, moved.upper()), (3, " ".join(words[:10])), (4, None), (5, ""), (None, moved), (1, "clean")]
    got = [(r.doc_id, r.contaminated, r.item_ids) for r in decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()]
    assert sorted(got, key=repr) == sorted([(1, True, [1]), (2, True, [1]), (3, False, []), (4, False, []), (5, False, []), (None, True, [1]), (1, False, [])], key=repr)
    assert decontamination.contamination(empty(spark), items).count() == 0
    assert not any(r.contaminated for r in decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), items.limit(0)).collect())


def test_base_pii_equals_plain_patterns(docs, texts):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    extra = "a@b.c d@e@f.gh 1.2.3.4 999.1.1.1 card 4111 1111 1111 1111 or +1 (555) 010-9999 +12 3 x@-.-"
    for text in [*texts.values(), extra]:
        got = [s for s in pii.base_spans(text) if s[0] == "email"]
        assert got == [("email", m.start(), m.end()) for m in email.finditer(text)]
    kinds = [k for k, _, _ in pii.base_spans(extra)]
    assert kinds.count("ip") == 1 and kinds.count("card") == 1 and kinds.count("phone") == 1


def test_pii_model_separates_examples_and_redacts(spark):
    model = pii.BoostedTrees(*pii.examples(pii.EXAMPLES))
    x, y = pii.examples(600, seed=99)
    assert ((model.probability(x) >= 0.5) == (y == 1)).mean() > 0.9
    rows = spark.createDataFrame([(1, "mail me: jane@example.org now"), (2, None), (None, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(rows).collect()}
    assert got[1].n_email == 1 and "jane" not in got[1].redacted and got[2].redacted is None and got[None].spans == ""
    assert pii.find_pii(empty(spark)).count() == pii.redact(empty(spark)).count() == 0


def test_pipeline_keeps_what_no_stage_rejects(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    clean = corpus_pipeline.without_toxic(spark, d, SF)
    scored = toxicity.score_toxicity(d, spark.read.parquet(f"{SF}/labels.parquet"))
    assert clean.count() == scored.where("predicted = 0").count() and clean.columns == d.columns
    unique = corpus_pipeline.without_copies(spark, clean, SF)
    assert unique.count() == near_dedup.near_duplicates(clean).where("kept").count()
    safe = corpus_pipeline.redacted(spark, corpus_pipeline.without_benchmark(spark, unique, SF), SF)
    assert safe.where(F.col("text").rlike(r"[a-z]@[a-z]+\.com")).count() == 0
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == safe.count()
