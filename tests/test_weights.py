"""High-order vocabulary and generator weights as tables: numbers against a plain recomputation, nothing of them on the driver."""

import math
import random

import numpy as np
import pytest

from bayesloom.operators import encode as E
from bayesloom.operators import structure as K
from bayesloom.operators.counts import compact
from bayesloom.operators.cpt import weights_to_cpts
from bayesloom.operators.weights import DiscriminativeWeights


@pytest.fixture
def collected(monkeypatch):
    """Rows that each collect() of a test brought to the driver."""
    from pyspark.sql.classic.dataframe import DataFrame

    sizes, real = [], DataFrame.collect

    def collect(self):
        rows = real(self)
        sizes.append(len(rows))
        return rows

    monkeypatch.setattr(DataFrame, "collect", collect)
    return sizes


def test_vocabulary_and_weights_stay_off_the_driver(spark, collected):
    df = spark.range(60_000).selectExpr("int(id % 300) AS a", "int(id div 300 % 200) AS b", "int(id % 2) AS y")
    enc = K.HighOrderEncoder.fit(df, ["a", "b"], "y", {"a": 300, "b": 200, "y": 2}, 1, edges=[("y", "a"), ("y", "b"), ("a", "b")])
    assert enc.sizes == {"a": 300, "b": df.select("a", "b").distinct().count()} and enc.sizes["b"] > 10_000
    ho = enc.transform(compact(df, ["a", "b", "y"]))
    got = ho.selectExpr("min(b_ho)", "max(b_ho)", "count(distinct b_ho)").first()
    assert tuple(got) == (0, enc.sizes["b"] - 1, enc.sizes["b"])
    ordered = ho.selectExpr("a * 200 + b AS code", "b_ho").distinct().selectExpr("corr(code, b_ho) AS r").first()[0]
    assert ordered > 0.99
    w = DiscriminativeWeights(enc, "y", [0, 1])
    w.init_from_counts(ho)
    w.epoch(ho)
    weights_to_cpts(w.log_weights(), enc.cards).count()
    assert max(collected) < 200  # counts of range parts, one row of sums


def plain_epochs(rows, classes, epochs, lr, smoothing=1.0):
    """Softmax regression on (a), (a, b) blocks in numpy, projected after each step."""
    blocks = [lambda r: ((), r[0]), lambda r: ((r[0],), r[1])]
    entries = [sorted({f(r) for r in rows}) for f in blocks]
    w = [{e: np.array([math.log(smoothing + sum(1 for r in rows if f(r) == e and r[2] == c)) for c in classes]) for e in es} for f, es in zip(blocks, entries)]

    def project():
        for table in w:
            for cfg in {e[0] for e in table}:
                mine = [e for e in table if e[0] == cfg]
                total = np.log(sum(np.exp(table[e]) for e in mine))
                for e in mine:
                    table[e] = table[e] - total

    project()
    bias = np.log(np.array([sum(r[2] == c for r in rows) for c in classes]) / len(rows))
    lls = []
    for _ in range(epochs):
        grads = [dict.fromkeys(t, 0.0) for t in w]
        bias_grad, ll = 0.0, 0.0
        for r in rows:
            logit = bias + sum(t[f(r)] for f, t in zip(blocks, w))
            p = np.exp(logit - logit.max())
            p /= p.sum()
            hit = np.array([float(r[2] == c) for c in classes])
            ll += math.log(p[hit.argmax()])
            for f, g in zip(blocks, grads):
                g[f(r)] = g[f(r)] + hit - p
            bias_grad = bias_grad + hit - p
        for t, g in zip(w, grads):
            for e in t:
                t[e] = t[e] + lr * g[e] / len(rows)
        bias = bias + lr * bias_grad / len(rows)
        project()
        lls.append(ll / len(rows))
    return w, bias, lls


def test_epochs_equal_a_plain_recomputation(spark):
    rng = random.Random(4)
    rows = [(a, (a + rng.randrange(2)) % 3, (a + rng.randrange(3)) % 3) for a in (rng.randrange(3) for _ in range(300))]
    df = spark.createDataFrame(rows, "a int, b int, y int")
    enc = K.HighOrderEncoder.fit(df, ["a", "b"], "y", {"a": 3, "b": 3, "y": 3}, 1, edges=[("y", "a"), ("y", "b"), ("a", "b")])
    ho = enc.transform(compact(df, ["a", "b", "y"])).persist()
    w = DiscriminativeWeights(enc, "y", [0, 1, 2])
    w.init_from_counts(ho)
    for _ in range(3):
        w.epoch(ho, 2.0)
    want, bias, lls = plain_epochs(rows, [0, 1, 2], 3, 2.0)
    assert w.history == pytest.approx(lls)
    got = {(r.child, tuple(r.pa), r.value): r.p for r in weights_to_cpts(w.log_weights(), enc.cards).collect()}
    for child, table in zip("ab", want):
        for (cfg, value), logs in table.items():
            for y in range(3):
                assert got.pop((child, (*cfg, y), value)) == pytest.approx(math.exp(logs[y]))
    prior = np.exp(bias) / np.exp(bias).sum()
    assert [got.pop(("y", (), y)) for y in range(3)] == pytest.approx(prior.tolist()) and not got
    assert {(r.f, int(r.cfg)): r.n for r in enc.constraints().collect() if r.f == 1} == {(1, a): len({r[1] for r in rows if r[0] == a}) for a in range(3)}


def test_an_unseen_combination_gives_no_weight(spark):
    train = spark.createDataFrame([(0, 0, 0), (1, 1, 1), (0, 1, 0), (1, 1, 0)], "a int, b int, y int")
    enc = K.HighOrderEncoder.fit(train, ["a", "b"], "y", {"a": 2, "b": 2, "y": 2}, 1, edges=[("y", "a"), ("y", "b"), ("a", "b")])
    both = enc.transform(compact(train.unionByName(spark.createDataFrame([(1, 0, 1)], train.schema)), ["a", "b", "y"]))
    w = DiscriminativeWeights(enc, "y", [0, 1])
    w.init_from_counts(both)
    assert math.isfinite(w.epoch(both)) and w.table.filter("f = 1").count() == 3


def test_numbers_are_coded_in_their_own_order(spark):
    values = [2.0, 5e-11, 1e30, 1e-10, -1e300, float("inf"), 0.0]
    enc = E.CategoryEncoder.fit(spark.createDataFrame([(v,) for v in values], "x double"), ["x"])
    assert enc.categories["x"] == sorted(values)
    big = [10**18, -5, 10**18 + 1, 7]
    assert E.CategoryEncoder.fit(spark.createDataFrame([(v,) for v in big], "x long"), ["x"]).categories["x"] == sorted(big)
    from decimal import Decimal
    exact = [Decimal("1.0000000000001"), Decimal("1.0000000000000"), Decimal("-3.5")]
    got = E.CategoryEncoder.fit(spark.createDataFrame([(v,) for v in exact], "x decimal(30,13)"), ["x"]).categories["x"]
    assert got == sorted(exact)


def test_scaling_a_column_of_nulls(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 1.0), (None, None)], "a double, b double")
    m = E.MinMaxScaler.fit(df, ["a", "b"])
    assert [tuple(r) for r in m.transform(df).collect()] == [(None, 0.0), (None, 0.0), (None, None)]
    assert [tuple(r) for r in m.inverse(m.transform(df)).collect()] == [(None, 1.0), (None, 1.0), (None, None)]
