"""Inputs that once gave wrong answers without a word."""

import math

import pytest
from pyspark.sql import functions as F

from bayesloom.operators import scores as S
from bayesloom.operators import structure as K
from bayesloom.operators.cpt import fit_cpts
from bayesloom.operators.predict import bn_map_predict
from bayesloom.operators.sample import ancestral_sample
from bayesloom.operators.search import HybridSearch, select_best_structure
from bayesloom.sources.readers import read_arff, shared_path, write_arff


def test_arff_keeps_rows_nulls_and_quotes(spark):
    rows = [(1.0, None, "x", "p"), (None, "a,b", "it's", "r"), (2.5, "@q", "%z", "n"), (3.0, "?", "", "back\\slash"), (4.0, "two words", "{x}", 'dq"'),
            (5.0, "tab\there", "line\nend", "\\n")]
    df = spark.createDataFrame(rows, "num double, a string, `b-c` string, class string")
    path = write_arff(df, shared_path(spark, "arff"), "odd names")
    got = read_arff(spark, [path + "/header", path + "/body"])
    assert got.columns == ["num", "a", "b_c", "class"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)


def test_arff_one_file_with_long_header_and_at_signs_in_the_body(spark):
    head = ["% a comment", "@relation r"] + [f"@attribute 'c {i}' {'numeric' if i else 'string'}" for i in range(40)] + ["% @data is not here"] * 12000
    head += ["@ATTRIBUTE last {'a b', \"c,d\", @data}", "@DATA"]
    body = [",".join(["1"] * 40) + ",'a b'", "% no row", "", ",".join(["?"] * 40) + ", @data", "@2" + ",3" * 39 + ",\"c,d\""]
    path = shared_path(spark, "one")
    spark.createDataFrame([(x,) for x in head + body], "v string").coalesce(1).write.text(path)
    df = read_arff(spark, path)
    assert df.schema["last"].metadata["arff_domain"] == ["a b", "c,d", "@data"]
    rows = df.select("`c 0`", "`c 39`", "last").collect()
    assert [tuple(r) for r in rows] == [("1", 1.0, "a b"), (None, None, "@data"), ("@2", 3.0, "c,d")]


def test_a_bad_code_never_takes_another_configuration(spark):
    train = spark.createDataFrame([(0, 4, 1)] * 8 + [(1, 0, 0)] * 8 + [(0, 0, 0)] * 2, "a int, b int, y int")
    cards = {"a": 2, "b": 5, "y": 2}
    edges = [("a", "y"), ("b", "y")]
    cpts = fit_cpts(train, edges, ["a", "b", "y"])
    test = spark.createDataFrame([(0, 4), (1, -1), (1, None), (5, 0), (0, 5)], "a int, b int")
    got = [(r["a"], r["b"], r["pred"]) for r in bn_map_predict(test, cpts, edges, ["a", "b", "y"], "y", cards).collect()]
    assert sorted(got, key=str) == sorted([(0, 4, 1), (1, -1, 0), (1, None, 0), (5, 0, 0), (0, 5, 0)], key=str)  # a tie goes to the lowest label
    enc = K.HighOrderEncoder.fit(train, ["a", "b"], "y", cards, 1, edges=[("y", "a"), ("y", "b"), ("a", "b")])
    codes = [r["b_ho"] for r in enc.transform(test).orderBy(F.col("b").isNull(), "b", "a").collect()]
    assert codes.count(-1) == 4 and codes[2] == enc.vocab["b"].index(4)


def test_keys_beyond_a_long(spark):
    names = [f"c{i}" for i in range(25)]
    df = spark.createDataFrame([tuple(i % 9 for i in range(25)) + (1,), tuple(8 - i % 9 for i in range(25)) + (0,)], ", ".join(f"{n} int" for n in [*names, "y"]))
    edges = [(n, "y") for n in names]
    cards = {n: 9 for n in names} | {"y": 2}
    cpts = fit_cpts(df, edges, [*names, "y"])
    got = {tuple(r)[:25]: r["pred"] for r in bn_map_predict(df, cpts, edges, [*names, "y"], "y", cards).collect()}
    assert sorted(got.values()) == [0, 1]


def test_gaussian_score_has_every_node_and_no_offset_error(spark):
    rows = [(float(i % 7), float((i * 5) % 11), float(i % 7) * 2) for i in range(77)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    far = df.withColumn("a", F.col("a") + 1e9)
    score = lambda d, e: S.structure_score(d, e, ["a", "b", "c"], {}, "bic-g")
    assert score(df, [("a", "b")]) == pytest.approx(score(far, [("a", "b")]), rel=1e-9)
    assert score(df, [("a", "c")]) == math.inf and S.gaussian_local_scores(df, [("a", "c")], ["a", "c"])["c"] == math.inf
    import numpy as np
    x = np.array(rows)
    n = len(x)
    var = np.var(x[:, 0])
    assert S.gaussian_local_scores(df, [], ["a"])["a"] == pytest.approx(-n / 2 * (math.log(2 * math.pi * var) + 1) - math.log(n))


def test_conditional_gaussian_score(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    k = rng.integers(0, 2, 200)
    x = rng.normal(size=200)
    y = np.where(k == 1, 2 * x, -x) + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(k, x, y)], "k int, x double, y double")
    want = 0.0
    for v in (0, 1):
        a, b = x[k == v], y[k == v]
        r = b - np.polyval(np.polyfit(a, b, 1), a)
        want += -len(a) / 2 * (math.log(2 * math.pi * r.var()) + 1)
    want -= 2 * 3 / 2 * math.log(200)
    assert S.conditional_gaussian_score(df, "y", ["k"], ["x"]) == pytest.approx(want)
    cards = {"k": 2}
    whole = S.structure_score(df, [("k", "y"), ("x", "y")], ["k", "x", "y"], cards, "bic-cg", continuous=["x", "y"])
    parts = S.structure_score(df.select("k"), [], ["k"], cards, "bic") + S.conditional_gaussian_score(df, "x", [], []) + want
    assert whole == pytest.approx(parts)
    assert S.structure_score(df, [], ["k"], cards, "bic-cg") == pytest.approx(S.structure_score(df, [], ["k"], cards, "bic"))
    with pytest.raises(ValueError):
        S.structure_score(df, [("x", "k")], ["k", "x"], cards, "bic-cg", continuous=["x"])


def test_gaussian_score_in_searches(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    a = rng.normal(size=300)
    b = a + rng.normal(size=300) * 0.3
    c = rng.normal(size=300)
    df = spark.createDataFrame([(float(x), float(y), float(z), int(x > 0)) for x, y, z in zip(a, b, c)], "a double, b double, c double, y int")
    edges = K.hill_climb(df, ["a", "b", "c"], {}, "bic-g")
    assert {frozenset(e) for e in edges} == {frozenset(("a", "b"))}
    res = HybridSearch(["a", "b", "y"], "y", {"a": 2, "b": 2, "y": 2}, episodes=1, epochs=1, n=1, score="bic-g").run(df.select("a", "b", "y"))
    assert math.isfinite(res.best_score)


def test_bds_prior_enters_every_move(spark):
    df = spark.createDataFrame([(i % 2, (i // 2) % 2) for i in range(16)], "a int, b int")
    cache = K.FamilyScoreCache(df, ["a", "b"], {"a": 2, "b": 2}, "bds")
    raw = cache.scores([("b", ("a",)), ("b", ())])
    (op, delta), = [x for x in K.score_neighbours(cache, [], [("+", ("a", "b"))])]
    assert delta == pytest.approx(raw["b", ("a",)] - raw["b", ()] - math.log(2))
    assert S.structure_prior_ratio("-", "bds") == math.log(2) and S.structure_prior_ratio("flip", "bds") == 0 == S.structure_prior_ratio("+", "bic")


def test_best_structure_has_edges_and_a_fixed_tie(spark):
    df = spark.createDataFrame([("k2", 1.0, "b>a"), ("k1", 1.0, "a>b"), ("k3", 0.5, "")], "state_key string, score double, edges string")
    assert tuple(select_best_structure(df).first()) == ("k1", "a>b", 1.0)
    assert tuple(select_best_structure(df, "min").first()) == ("k3", "", 0.5)
    assert select_best_structure(df.limit(0)).collect() == []


def test_unseen_configurations_draw_uniform_codes_at_any_card(spark):
    for card in (3, 400):
        df = spark.createDataFrame([(0, 1)], "p int, c int")
        cpts = fit_cpts(df, [("p", "c")], ["p", "c"]).filter("child = 'p'")
        out = ancestral_sample(spark, cpts, [("p", "c")], ["p", "c"], {"p": 1, "c": card}, 300)
        codes = [r["c"] for r in out.collect()]
        assert min(codes) >= 0 and max(codes) < card and len(set(codes)) == min(card, len(set(codes))) > 2
