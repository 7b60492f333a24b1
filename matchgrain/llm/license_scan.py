"""License scans: exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrain.llm.staging import bound_batches
from matchgrain.llm.textbytes import ALNUM, byte_slices, lower_ascii, string_hash, text_bytes, word_hash, word_spans

#: Phrases whose words stand consecutively, and their labels: fixed values.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Templates for the similarity join, and their labels: short notices in our own words, then what opens or closes the
#: published license texts, which are fixed values.
TEMPLATES = {
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by 4 0 international": "cc-by",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software redistribute it under the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license version 2": "mpl-2",
    "all rights reserved no part may be reproduced without written permission": "all-rights-reserved",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-2",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-3",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all rights": "cc0",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely": "zlib",
}

#: Words that tell licenses apart: those that must stand where a template with them is met, and those that must not.
TELLING = {
    "mit": ({"mit"}, set()),
    "apache-2": ({"apache", "2"}, set()),
    "cc-by-nc": ({"nc"}, set()),
    "cc-by-sa": ({"sa"}, set()),
    "cc-by": ({"cc"}, {"nc", "sa", "nd"}),
    "gpl-3": ({"gnu", "3"}, {"lesser", "library", "affero"}),
    "gpl": ({"gnu", "general"}, {"lesser", "library", "affero"}),
    "lgpl": ({"lesser"}, set()),
    "agpl": ({"affero"}, set()),
    "isc": ({"fee"}, set()),
    "unlicense": ({"unencumbered"}, set()),
    "cc0": ({"waiving"}, set()),
    "zlib": ({"freely"}, set()),
    "mpl-2": ({"mozilla", "2"}, set()),
}
#: Words of a window for each word of its template.
SPREAD = 2


def word_counts(docs: DataFrame, words: list[str], text_col: str) -> dict[str, int]:
    """How often each of these words stands in all texts; the driver gets one row a word."""
    codes = np.array([string_hash(w) for w in words], np.uint64)
    order = np.argsort(codes)
    ranked = codes[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words), np.int64)
        for batch in byte_slices(batches, text_col):
            buf, offs = text_bytes(batch.column(text_col))
            buf = lower_ascii(buf)
            starts, ends, _ = word_spans(buf, offs, ALNUM)
            h = word_hash(buf, starts, ends)
            at = np.minimum(np.searchsorted(ranked, h), len(ranked) - 1)
            total += np.bincount(order[at[ranked[at] == h]], minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(words)), pa.int32()), pa.array(total)], names=["w", "n"])

    got = docs.select(text_col).mapInArrow(run, "w int, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(words, 0) | {words[r["w"]]: r["n"] for r in got}


class Templates:
    """Template token sets in the corpus' order of frequency, rarest first, and their filters."""

    def __init__(self, templates: dict[str, str], counts: dict[str, int], threshold: float, telling: dict[str, tuple[set[str], set[str]]]) -> None:
        self.labels, self.sets, self.need, self.width, self.telling = [], [], [], [], []
        rank = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
        self.codes = np.array([string_hash(w) for w in sorted(rank, key=rank.get)], np.uint64)  # by rank
        for text, label in templates.items():
            tokens = sorted({rank[w] for w in text.split()})
            self.labels.append(label)
            self.sets.append(tokens)
            self.need.append(max(1, math.ceil(threshold * len(tokens) - 1e-9)))
            self.width.append(SPREAD * len(text.split()))
            must, never = telling.get(label, (set(), set()))
            self.telling.append(({rank[w] for w in must & {*text.split()}}, {rank[w] for w in never}))

    def matches(self, token: np.ndarray, place: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, int, float, bool]]:
        """(template, first, last, containment, told) of the windows that meet a template, by their first word.

        ``token`` are the ranks of template words, ``place`` their places among all words, ``end`` the ends of their
        texts. ``first`` and ``last`` are indices of the shortest run from the window's first word that meets it;
        ``told`` says whether the words that tell the template apart agree.
        """
        for k, tokens in enumerate(self.sets):
            need, (must, never) = self.need[k], self.telling[k]
            own = np.flatnonzero(np.isin(token, tokens))
            at = place[own]
            stop = np.searchsorted(at, np.minimum(at + self.width[k], end[own]))
            rare = np.concatenate([[0], np.cumsum(np.isin(token[own], tokens[: len(tokens) - need + 1]))])
            begin = np.arange(len(own))
            for lo in np.flatnonzero((stop - begin >= need) & (rare[stop] > rare[begin])):  # length and prefix filters
                part = token[own[lo : stop[lo]]].tolist()
                held = set(part)
                # positional filter: the rarest word held is the first of the template's that is, so those before it are missing
                if len(tokens) - tokens.index(min(held)) < need or len(held) < need:
                    continue
                seen: set[int] = set()
                for hi, t in enumerate(part):
                    seen.add(t)
                    if len(seen) >= need:
                        break
                run = token[own[lo] : own[lo + hi] + 1]
                yield k, int(own[lo]), int(own[lo + hi]), len(held) / len(tokens), must <= held and not never & {*run.tolist()}


def scan(docs: DataFrame, *, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8, telling: dict[str, tuple[set[str], set[str]]] = TELLING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License phrases and template-like blocks of each whole text.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A block is a window of SPREAD times a
    template's words, from any word on and over line ends. A block meets the template if it holds at least
    ``threshold`` of its distinct words; tokens are ordered by their count over all texts, rarest first, and only
    blocks with a token of the template's prefix are compared. Of the labels met, licenses has those whose ``telling``
    words agree (those of the template that must stand are in the block, none that must not inside the match). Phrases may run over line ends. A null
    text is empty; ids may be null or repeat; other columns are ignored; an empty table gives an empty result. Returns
    id, n_words, n_base, first_word, last_word, base_labels, labels, licenses, score (the largest containment met, 1
    with a phrase, else 0), blocks (first line and template label of each run of overlapping matches).
    """
    bound_batches(docs.sparkSession)
    telling = {label: words for label, words in telling.items() if label in templates.values()}
    vocabulary = sorted({w for t in templates for w in t.split()}.union(*(a | b for a, b in telling.values())))
    known = Templates(templates, word_counts(docs, vocabulary, text_col), threshold, telling)
    order = np.argsort(known.codes)
    ranked = known.codes[order]
    spelled = [(np.array([string_hash(w) for w in p.split()], np.uint64), label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, text_col):
            yield scanned(batch)

    def scanned(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, offs = text_bytes(batch.column(text_col))
        n = batch.num_rows
        raw, buf = buf, lower_ascii(buf)
        starts, ends, first = word_spans(buf, offs, ALNUM)
        h = word_hash(buf, starts, ends)
        doc = np.repeat(np.arange(n), np.diff(first))
        n_base, low, high = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
        base: list[set[str]] = [set() for _ in range(n)]
        for code, label in spelled:
            hit = h[: max(0, len(h) - len(code) + 1)] == code[0]
            for i in range(1, len(code)):
                hit &= h[i : len(h) - len(code) + 1 + i] == code[i]
            for w in np.flatnonzero(hit):
                d = doc[w]
                if w + len(code) <= first[d + 1]:
                    place = w - first[d]
                    n_base[d] += 1
                    low[d] = place if low[d] < 0 else min(low[d], place)
                    high[d] = max(high[d], place)
                    base[d].add(label)
        labels, licenses = [set(x) for x in base], [set(x) for x in base]
        score = np.array([1.0 if x else 0.0 for x in base])
        blocks: list[list[dict]] = [[] for _ in range(n)]
        if len(h) and len(ranked):
            at = np.minimum(np.searchsorted(ranked, h), len(ranked) - 1)
            w = np.flatnonzero(ranked[at] == h)
            breaks = np.concatenate([[0], np.cumsum(raw == 10)])
            open_block = (-1, -1)  # template and last word of the run of matches before
            for k, lo, hi, share, told in known.matches(order[at[w]], w, first[doc[w] + 1]):
                d = doc[w[lo]]
                labels[d].add(known.labels[k])
                if told:
                    licenses[d].add(known.labels[k])
                score[d] = max(score[d], share)
                if open_block[0] != k or lo > open_block[1] or doc[w[open_block[1]]] != d:
                    blocks[d].append({"line": int(breaks[starts[w[lo]]] - breaks[offs[d]]), "label": known.labels[k]})
                open_block = k, hi
        none = low < 0
        join = lambda sets: pa.array([",".join(sorted(s)) for s in sets], pa.string())
        return pa.RecordBatch.from_arrays(
            [
                batch.column(id_col), pa.array(np.diff(first), pa.int64()), pa.array(n_base), pa.array(low.astype(np.int64), mask=none), pa.array(high.astype(np.int64), mask=none),
                join(base), join(labels), join(licenses), pa.array(score), pa.array(blocks, pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string())]))),
            ],
            names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "licenses", "score", "blocks"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, licenses string, score double, blocks array<struct<line:long,label:string>>")
