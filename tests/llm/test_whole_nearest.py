"""Nearest vectors against brute force where directions are uniform and norms spread, and on odd tables."""

import numpy as np
import pytest

pytest.importorskip("matchgrain.llm")
from matchgrain.llm import cross_polytope


def table(spark, x, names="vec_id long, embedding array<double>", *more):
    return spark.createDataFrame([(i, v.tolist(), *more) for i, v in enumerate(x)], names)


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_recall_on_uniform_directions(spark, spread):
    r = np.random.default_rng(3)
    x = r.normal(size=(4000, 64)) * np.exp(spread * r.normal(size=(4000, 1)))
    got = {}
    for row in cross_polytope.search(table(spark, x)).collect():
        got.setdefault(row.query_id, {})[row.rank] = row.vec_id
    hits = 0
    for i in range(0, 4000, 20):
        score = x @ x[i]
        score[i] = -np.inf
        assert sorted(got[i]) == [*range(1, 21)]
        hits += len(set(np.argsort(-score)[:20].tolist()) & set(got[i].values()))
    assert hits >= 0.9 * 20 * 200


def test_a_third_of_equal_rows_and_clashing_columns(spark):
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=(300, 8)), 2)
    x[::3] = x[0]
    got = cross_polytope.search(table(spark, x, "vec_id long, embedding array<double>, id int, v int, score int, rank int, ids int, part int, kind int, _h int", 1, 2, 3, 4, 5, 6, 7, 8)).collect()
    found = {(g.query_id, g.rank): g.vec_id for g in got}
    hits = 0
    for i in range(0, 300, 20):
        score = (x * x[i]).sum(axis=1)
        order = [int(j) for j in np.lexsort((np.arange(300), -score)) if j != i]
        own = [found[i, k + 1] for k in range(20)]
        assert own == [j for j in order if j in own]  # nearest first, equal ones by id
        assert [j for j in own if j % 3 == 0] == [j for j in order if j % 3 == 0][: sum(j % 3 == 0 for j in own)]
        hits += len(set(own) & set(order[:20]))
    assert hits >= 0.9 * 20 * 15


def test_few_long_vectors_of_several_lengths_are_searched_whole(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=5000 if i % 2 else 3).tolist()) for i in range(1, 30)] + [(40, r.normal(size=5000).tolist()), (60, r.normal(size=7).tolist())]
    got = [g.vec_id for g in cross_polytope.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()]
    x = dict(rows)
    same = [i for i in range(1, 30, 2)]  # 20 meets the rows of even ids, 40 those of odd ids, 60 no row
    assert got[-15:] == sorted(same, key=lambda i: -np.dot(x[40], x[i]))
    assert len(got) == 14 - 1 + 15
