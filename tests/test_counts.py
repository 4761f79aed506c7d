import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from bayesloom.operators import counts as C

# 20-row two-column example with its expected 5 × 5 cross table (values 4..8)
Q1 = [7, 8, 8, 8, 5, 6, 4, 6, 6, 8, 4, 6, 6, 6, 6, 8, 8, 5, 8, 6]
Q2 = [6, 4, 6, 4, 8, 8, 4, 8, 7, 4, 4, 8, 8, 7, 5, 4, 8, 4, 4, 4]
XT = [[2, 0, 0, 0, 0], [1, 0, 0, 0, 1], [1, 1, 0, 2, 4], [0, 0, 1, 0, 0], [5, 0, 1, 0, 1]]


def test_cross_table_xtab20(spark):
    df = spark.createDataFrame(list(zip(Q1, Q2)), "q1 int, q2 int")
    got = {(r.q1, r.q2): r.n for r in C.cross_table(df, ["q1", "q2"]).collect()}
    vals = [4, 5, 6, 7, 8]
    for i, a in enumerate(vals):
        for j, b in enumerate(vals):
            assert got.get((a, b), 0) == XT[i][j]


def test_weighted_cross_table(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (0, 1, 0.5), (1, 0, 1.0)], "a int, b int, w double")
    got = {(r.a, r.b): r.n for r in C.cross_table(df, ["a", "b"], "w").collect()}
    assert got == {(0, 1): 2.5, (1, 0): 1.0}


def _mi(x, y):
    n = len(x)
    pxy, px, py = Counter(zip(x, y)), Counter(x), Counter(y)
    return sum(c / n * math.log2(c * n / (px[a] * py[b])) for (a, b), c in pxy.items())


def _cmi(x, z, y):
    n = len(x)
    t, xy, zy, yy = Counter(zip(x, z, y)), Counter(zip(x, y)), Counter(zip(z, y)), Counter(y)
    return sum(c / n * math.log2(c * yy[c_] / (xy[(a, c_)] * zy[(b, c_)])) for (a, b, c_), c in t.items())


def _tri(n=64, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x1 = (y + rng.integers(0, 2, n)) % 3
    x2 = rng.integers(0, 3, n)
    x3 = x1.copy()
    return [tuple(int(v) for v in r) for r in zip(x1, x2, x3, y)]


def test_mi_and_cmi_match_closed_form(spark):
    rows = _tri()
    df = spark.createDataFrame(rows, "x1 int, x2 int, x3 int, y int")
    x1, x2, x3, y = map(list, zip(*rows))
    mi = {r.feature: r.mi for r in C.mutual_info(df, ["x1", "x2", "x3"], "y").collect()}
    assert abs(mi["x1"] - _mi(x1, y)) < 1e-12
    assert abs(mi["x2"] - _mi(x2, y)) < 1e-12
    assert mi["x1"] >= 0 and mi["x2"] >= 0
    cmi = {(r.a, r.b): r.cmi for r in C.cond_mutual_info(df, [("x1", "x2"), ("x2", "x1"), ("x1", "x3")], "y").collect()}
    assert abs(cmi[("x1", "x2")] - _cmi(x1, x2, y)) < 1e-12
    assert abs(cmi[("x1", "x2")] - cmi[("x2", "x1")]) < 1e-12  # symmetric
    # identical columns: CMI = H(X|Y)
    assert abs(cmi[("x1", "x3")] - _cmi(x1, x3, y)) < 1e-12


def test_family_counts_many_families_one_job(spark):
    rows = _tri()
    df = spark.createDataFrame(rows, "x1 int, x2 int, x3 int, y int")
    fams = [("x1", ("y",)), ("x2", ("x1", "y")), ("y", ())]
    ct = C.family_counts(df, fams).collect()
    tot = Counter()
    for r in ct:
        tot[r.fam] += r.n
    assert tot == {0: 64, 1: 64, 2: 64}
    fam1 = {(r.x, tuple(r.pa)): r.n for r in ct if r.fam == 1}
    exp = Counter((b, (a, c)) for a, b, _, c in rows)
    assert fam1 == {k: float(v) for k, v in exp.items()}


def test_normalize_and_add_uniform(spark):
    df = spark.createDataFrame([(0, 0, 3.0), (1, 0, 1.0), (0, 1, 0.0), (1, 1, 0.0)], "x int, q int, n double")
    res = {(r["x"], r["q"]): r["p"] for r in C.add_uniform(df, "x", ["q"], noise=0.0).collect()}
    assert res[(0, 0)] == 0.75 and res[(1, 0)] == 0.25
    assert res[(0, 1)] == 0.5 and res[(1, 1)] == 0.5  # empty configuration → uniform
    noisy = {(r["x"], r["q"]): r["p"] for r in C.add_uniform(
        spark.createDataFrame([(0, 0, 4.0), (1, 0, 0.0)], "x int, q int, n double"), "x", ["q"], noise=0.5).collect()}
    assert abs(noisy[(1, 0)] - 0.5 / 4.5) < 1e-12
    norm = C.normalize_by_parents(spark.createDataFrame([(0, 0, [1], 3.0), (0, 1, [1], 1.0)], "fam int, x int, pa array<int>, n double"))
    assert sorted(r.p for r in norm.collect()) == [0.25, 0.75]


def test_smooth_backoff_uses_parent_level(spark):
    # x=1 never seen with (p1=1, p2=1) → falls back to P(x | p1=1)
    rows = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0), (1, 1, 0), (0, 1, 1)]
    df = spark.createDataFrame(rows, "x int, p1 int, p2 int")
    out = {(r.x, r.p1, r.p2): r.p for r in C.smooth_backoff(df, "x", ["p1", "p2"], {"x": 2, "p1": 2, "p2": 2}).collect()}
    assert out[(0, 1, 1)] == 1.0
    assert abs(out[(1, 1, 1)] - 2 / 4) < 1e-12  # P(x=1 | p1=1) = 2/4
    assert abs(out[(0, 0, 1)] - 0.5) < 1e-12  # configuration (0,1) empty → P(x | p1=0)


def test_jsd_and_wasserstein(spark):
    a = spark.createDataFrame([(0.0,), (1.0,), (1.0,), (3.0,)], "v double")
    b = spark.createDataFrame([(0.0,), (2.0,)], "v double")
    w = C.wasserstein1(a, b, ["v"]).first()["w1"]
    # F_a: 0→.25, 1→.75, 3→1 ; F_b: 0→.5, 2→1 ; ∫|F−G| = .25·1 + .25·1 + .25·1
    assert abs(w - 0.75) < 1e-12
    j = C.jsd(a, a, ["v"]).first()["jsd"]
    assert abs(j) < 1e-12
    j2 = C.jsd(spark.createDataFrame([(0,)], "v int"), spark.createDataFrame([(1,)], "v int"), ["v"]).first()["jsd"]
    assert abs(j2 - 1.0) < 1e-12


def test_running_totals_across_partitions(spark):
    rows = [(g, float(i), 1.0) for g in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, x double, a double")
    out = C.running_totals(df, "g", "x", ["a"], num_partitions=7).collect()
    for r in out:
        assert r.a_cum == r.x + 1
        assert (r.x_next == r.x + 1) if r.x < 199 else r.x_next is None
