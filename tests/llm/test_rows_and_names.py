"""Rows that differ in where a null stands, columns with any name or type, repeated rows: sharding, keeping one, the mix."""

import random

import numpy as np
import pytest

from bayesloom.llm import mixing, sharding, simhash_golay
from bayesloom.llm.shared import row_key

ROWS = [(1, "alpha beta", None, "news"), (1, "alpha beta", "news", None), (None, "alpha beta", None, "news"), (1, None, "alpha beta", "news"),
        (2, "", None, None), (2, None, "", None), (2, None, None, "")]
SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows):
    return sorted((tuple(r)[:4] for r in rows), key=repr)


def test_keys_see_where_nulls_stand(spark):
    rows = [(None, 1, [1, None], {"a": None}, (None, 1)), (1, None, [None, 1], {"b": None}, (1, None)), (None, 1, [1, None], {"a": 1}, (None, 1)),
            (None, 1, None, None, None), (None, 1, [1, None], None, None), (None, 1, None, {"a": None}, None)]
    df = spark.createDataFrame(rows, "a int, b int, c array<int>, d map<string,int>, e struct<x int, y int>")
    assert len({tuple(r) for r in df.select(*row_key(df)).collect()}) == len(rows)


def test_shard_keeps_rows_apart(spark):
    df = spark.createDataFrame(ROWS * 3, SCHEMA)
    assert plain(sharding.shard(df, 2).collect()) == plain(ROWS * 3)


def test_mixed_keeps_rows_apart(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = [tuple(r) for r in mixing.mixed(df).collect()]
    assert set(got) <= set(ROWS)
    # one source at its bound or below: all words of a text with words can come, each in its own place
    assert all(got.count(r) <= mixing.MAX_REPEATS for r in got)


def test_keep_one_keeps_a_row_of_each_text(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma", None, "news"), (1, None, "alpha beta gamma", "news")], SCHEMA)
    assert plain(simhash_golay.keep_one(df).collect()) == plain(df.collect())
    same = spark.createDataFrame([(1, "alpha beta gamma", None, "news")] * 5, SCHEMA)
    assert len(simhash_golay.keep_one(same).collect()) == 1


CLASHES = ["__key1", "__key2", "__times", "times", "__row", "row", "c0", "c1", "fp", "root", "u", "block", "p", "__copy", "size"]


@pytest.mark.parametrize("f", [sharding.shard, mixing.mixed, simhash_golay.keep_one])
def test_any_column_names_and_types(spark, f):
    df = spark.createDataFrame([(i, f"word{i} and some more words here", "x") for i in range(20)], "doc_id long, text string, source string")
    df = df.selectExpr("*", *[f"{i} AS `{c}`" for i, c in enumerate(CLASHES)], "map('a', doc_id) AS m", "array(null, doc_id) AS a", "1 AS `a.b`")
    got = f(df)
    assert got.columns[:len(df.columns)] == df.columns
    for r in got.limit(3).collect():
        assert [r[c] for c in CLASHES] == list(range(len(CLASHES))) and r["m"] == {"a": r["doc_id"]}
    empty = f(df.limit(0))
    assert empty.count() == 0


def test_repeated_rows_of_the_mix_are_numbered(spark, monkeypatch):
    """A third of all rows being one row: numbers in parts, each row decided for itself."""
    monkeypatch.setattr(mixing, "COPIES", 7)
    rows = [(1, "the same words", "a")] * 50 + [(i, "other words " * (i % 5 + 1), "ab"[i % 2]) for i in range(2, 102)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, ["doc_id"])
    got = out.collect()
    assert len(got) == len(rows) and sum(r.doc_id == 1 for r in got) == 50
    again = mixing.mix(df.repartition(5), ["doc_id"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_settling_keeps_words_and_expectations():
    base = np.random.default_rng(3)
    p, size = base.random(200), base.integers(1, 400, 200).astype(float)
    size[:3] = (9000, 4000, 4000)
    mean, n = np.zeros(200), 4000
    for k in range(n):
        out = mixing.settle(p, size, 3000.0, random.Random(k))
        assert abs(out @ size - p @ size) < 1e-6 and ((out >= 0) & (out <= 1)).all() and set(out[:3]) <= {0.0, 1.0}
        mean += out / n
    assert np.abs(mean - p).max() < 5 * 0.5 / np.sqrt(n)
    alone = mixing.settle(np.array([0.5, 0.5]), np.array([1000.0, 1.0]), 10.0, random.Random(1))
    assert alone.tolist() == [0.5, 0.5]
