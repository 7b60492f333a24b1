"""Upserts whose batch repeats keys, lacks them, or may lack one."""

from matchgrain.sources import merge

SHAPE = "league string, id string, text string, at int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_a_batch_may_repeat_a_key(spark):
    old = spark.createDataFrame([("x", "1", "old", 1), ("x", "2", "stays", 1)], SHAPE)
    new = spark.createDataFrame([("x", "1", "late", 3), ("x", "1", "zzz", 2), ("x", "3", "a", 5), ("x", "3", "a", 5), ("x", None, "lost", 9), (None, "4", "lost", 9)], SHAPE)
    assert rows(merge.upsert(old, new, ["league", "id"], "at")) == [("x", "1", "late", 3, "updated"), ("x", "2", "stays", 1, "kept"), ("x", "3", "a", 5, "created")]
    assert rows(merge.upsert(old, new, ["league", "id"]))[0] == ("x", "1", "zzz", 2, "updated")
    assert rows(merge.upsert(old.select("id"), new.select("id"), ["id"])) == [("1", "updated"), ("2", "kept"), ("3", "created"), ("4", "created")]


def test_rows_without_an_optional_key_are_rows_of_their_own(spark):
    old = spark.createDataFrame([("x", None, "before", 1), ("x", "1", "old", 1)], SHAPE)
    new = spark.createDataFrame([("x", None, "a", 2), ("x", None, "a", 2), (None, None, "lost", 2), ("x", "1", "new", 2)], SHAPE)
    got = rows(merge.upsert(old, new, ["league", "id"], "at", optional="id"))
    assert got == sorted([("x", None, "a", 2, "created")] * 2 + [("x", None, "before", 1, "kept"), ("x", "1", "new", 2, "updated")], key=repr)
    assert merge.upsert(old.where("false"), new.where("false"), ["league", "id"], optional="id").count() == 0
