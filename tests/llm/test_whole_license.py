"""License sentences that run over lines, words scattered over long lines, and licenses that few words tell apart."""

import random

import pytest

pytest.importorskip("matchgrain.llm")
from matchgrain.llm import license_scan

ROWS = {
    1: ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that", "bsd", "bsd"),
    2: ("This Source Code Form is subject\nto the terms of the\nMozilla Public License, version 2", "mpl-2", "mpl-2"),
    3: (" filler words go here ".join("released under the mit license".split()), "", ""),
    4: ("licensed under CC BY-SA 4.0", "cc-by,cc-by-nc,cc-by-sa", "cc-by-sa"),
    5: ("licensed under CC BY-SA 4.0 international", "cc-by,cc-by-nc,cc-by-sa", "cc-by-sa"),
    6: ("licensed under CC BY 4.0 International", "cc-by", "cc-by"),
    7: ("released under the BSD license", "mit", ""),
    8: ("this work is licensed under the gnu lesser general public license version 3", "gpl-3", ""),
    9: ("released under the", "", ""),
    10: ("mit license", "", ""),
}


def test_blocks_run_over_lines_and_telling_words_decide(spark):
    rows = license_scan.scan(spark.createDataFrame([(i, t) for i, (t, _, _) in ROWS.items()], "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id: r.licenses for r in rows} == {i: x[2] for i, x in ROWS.items()}
    for r in rows:
        assert set(filter(None, ROWS[r.doc_id][1].split(","))) <= {*r.labels.split(",")}
    assert next(r for r in rows if r.doc_id == 3).labels == ""
    assert [tuple(b) for r in rows if r.doc_id == 1 for b in r.blocks] == [(0, "bsd")]


def test_windows_equal_brute_force(spark):
    r = random.Random(3)
    templates = license_scan.TEMPLATES
    pool = [t.split() for t in templates]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(r.randrange(1, 6)):
            words += [w for w in r.choice(pool) for w in [w] * (r.random() < 0.9) + ["other"] * (r.random() < 0.3)] + ["plain"] * r.randrange(20)
        texts.append("".join(w + r.choice([" ", "\n", ", "]) for w in words))
    got = {x.doc_id: x.labels for x in license_scan.scan(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), phrases={}).collect()}
    for i, text in enumerate(texts):
        words = text.replace(",", " ").split()
        want = set()
        for t, label in templates.items():
            own, width = set(t.split()), license_scan.SPREAD * len(t.split())
            if any(len(own & {*words[k : k + width]}) >= 0.8 * len(own) - 1e-9 for k in range(len(words))):
                want.add(label)
        assert got[i] == ",".join(sorted(want))


PARAGRAPHS = {
    1: ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including", "mit"),
    2: ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that", "isc"),
    3: ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either", "lgpl"),
    4: ("you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either", "gpl"),
    5: ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License\nas published by the Free Software Foundation", "agpl"),
    6: ("Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.", "bsd"),
    7: ("This is free and unencumbered software released into the public domain.", "unlicense"),
    8: ("You may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0", "apache-2"),
    9: ("the public house may not use this charge to any person without a notice of the following conditions", ""),
}


def test_published_notices_and_the_query_keeps_labels_that_agree(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, (t, _) in PARAGRAPHS.items()] + [(20, "released under the BSD license"), (21, None), (22, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    from matchgrain.llm import queries

    rows = {r.doc_id: r for r in queries.op4_license_scan(spark, str(tmp_path)).collect()}
    assert {i: rows[i].labels for i in PARAGRAPHS} == {i: x for i, (_, x) in PARAGRAPHS.items()}
    assert (rows[20].labels, rows[20].met_labels, rows[20].base_labels) == ("", "mit", "")
    assert all((rows[i].labels, rows[i].n_words, rows[i].score) == ("", 0, 0.0) for i in (21, 22))
