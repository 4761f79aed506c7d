"""Plans that should stay as they are, and inputs at the edge of what operators take."""

import pytest
from pyspark.sql import functions as F

from bayesloom.operators import counts as C
from bayesloom.operators.discretise import Preprocessor
from bayesloom.operators.predict import GaussianNB


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_back_off_reads_the_table_once(spark):
    df = spark.createDataFrame([(i % 3, i % 4, i % 5, i % 2) for i in range(200)], "x int, a int, b int, c int")
    out = C.smooth_backoff(df, "x", ["a", "b", "c"], {"x": 4, "a": 4, "b": 5, "c": 2})
    assert plan(out).count("LogicalRDD") + plan(out).count("LocalRelation") == 1
    got = {(r.x, r.a, r.b, r.c): r.p for r in out.collect()}
    assert len(got) == 4 * 4 * 5 * 2 and got[3, 0, 0, 0] == 0.0  # a value never seen
    rows = [(i % 3, i % 4, i % 5, i % 2) for i in range(200)]

    def want(x, *pa):
        for k in range(3, -1, -1):
            group = [r for r in rows if r[1:1 + k] == pa[:k]]
            hits = sum(r[0] == x for r in group)
            if hits:
                return hits / len(group)
        return 0.0

    assert all(p == pytest.approx(want(*cell)) for cell, p in got.items())
    assert {r.x: r.p for r in C.smooth_backoff(df, "x", [], {"x": 3}).collect()} == {i: pytest.approx(sum(r[0] == i for r in rows) / 200) for i in range(3)}


def test_running_totals_stay_in_the_engine(spark):
    df = spark.createDataFrame([(i % 2, float(i), 1.0, float(i)) for i in range(300)], "g int, x double, a double, b double")
    out = C.running_totals(df, "g", "x", ["a", "b"], num_partitions=5)
    assert "Python" not in plan(out) and "MapInPandas" not in plan(out)
    rows = sorted(out.collect(), key=lambda r: (r.g, r.x))
    total = {0: 0.0, 1: 0.0}
    for r in rows:
        total[r.g] += r.b
        assert r.b_cum == pytest.approx(total[r.g]) and r.a_cum == int(r.x) // 2 + 1
    assert C.running_totals(df.limit(0), "g", "x", ["a"]).count() == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "y int, x int")
    assert C.class_prior(empty, "y").collect() == []
    assert C.entropy(empty, ["x", "y"]).first()[0] == 0.0


def test_data_line_stands_alone(spark, tmp_path):
    from bayesloom.sources.readers import read_arff

    (tmp_path / "h.arff").write_text("@relation r\n@attribute a string\n@attribute b string\n@DATA  % rows follow\nx,1\n")
    (tmp_path / "body.arff").write_text("@database,y\n@data,z\n")
    rows = read_arff(spark, [str(tmp_path / "h.arff"), str(tmp_path / "body.arff")]).collect()
    assert sorted(tuple(r) for r in rows) == [("@data", "z"), ("@database", "y"), ("x", "1")]


def test_gaussian_bayes_with_missing_and_constant_features(spark):
    df = spark.createDataFrame([(0, 1.0, None, 5.0), (0, 1.2, None, 5.0), (1, 3.0, 2.0, 5.0), (1, 3.1, 2.5, 5.0)], "y int, a double, b double, c double")
    m = GaussianNB.fit(df, ["a", "b", "c"], "y")
    assert m.mean[0]["b"] is None
    assert [r.pred for r in m.predict(df).orderBy("a").collect()] == [0, 0, 1, 1]
    flat = GaussianNB.fit(df.select("y", "c"), ["c"], "y")
    assert {r.pred for r in flat.predict(df).collect()} == {0}  # a tie goes to the lowest label
    assert GaussianNB.fit(df.limit(0), ["a"], "y").classes == []


def test_held_out_rows_follow_their_values(spark):
    """The perceptron's early stopping holds out a tenth of each value's rows, however they're dealt to partitions."""
    from collections import Counter

    from pyspark.ml.feature import VectorAssembler

    from bayesloom.operators.evaluate import held_out

    rows = [(float(i % 3), float(i % 5), float((i % 3 + i % 5) % 2)) for i in range(600)]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(rows, "a double, b double, label double"))
    got = [Counter((tuple(r.features), r.label, r.part) for r in held_out(df.repartition(n), chunk=7).collect()) for n in (1, 4)]
    assert got[0] == got[1] and sum(got[0].values()) == 600 and set(got[0].values()) == {4}
    assert held_out(df.limit(0)).count() == 0


def test_preprocessing_is_one_call(spark):
    rows = [(f"k{i}", float(i), "red" if i % 3 else "blue", "yes" if i % 4 else "no") for i in range(40)]
    fitted, train, test = Preprocessor.split(spark.createDataFrame(rows, "row_key string, x double, colour string, label string"), "label")
    assert train.columns == ["row_key", "x", "colour", "label"] == test.columns
    assert {r[0]: r[1] for r in test.groupBy("label").count().collect()} == {0: 2, 1: 6}
    assert train.unionByName(test).select(F.max("x"), F.max("colour")).first() == (4, 1) and fitted.numeric == ["x"]


def test_families_share_joint_counts(spark):
    """Every family's counts from the maximal sets equal its own; the table is read once, for fifty columns too."""
    from collections import Counter

    rows = [(i % 2, i % 3, (i * 7) % 5, i % 4 if i % 6 else None) for i in range(150)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    fams = [("a", ()), ("a", ("b",)), ("b", ("a",)), ("c", ("b", "a")), ("a", ("c", "b")), ("d", ("c",)), ("d", ()), ("a", ("b",))]
    sets, home = C.maximal_sets([frozenset((ch, *pa)) for ch, pa in fams])
    assert sets == [("a", "b", "c"), ("c", "d")] and home == [0, 0, 0, 0, 0, 1, 1, 0]
    got = {(r.fam, r.x, tuple(r.pa)): r.n for r in C.family_counts(df, fams).collect()}
    at = {c: i for i, c in enumerate("abcd")}
    want = Counter((f, r[at[ch]], tuple(r[at[p]] for p in pa)) for r in rows for f, (ch, pa) in enumerate(fams))
    assert got == want
    names = [f"f{i}" for i in range(50)]
    wide = spark.range(300).select(*[((F.col("id") * (i + 3) + F.col("id") % (i + 2)) % 2).cast("int").alias(c) for i, c in enumerate(names)], F.lit(1.0).alias("w"))
    many = [(x, (names[0], y)) for i, x in enumerate(names[1:]) for y in names[i + 2:]] + [(x, (names[0],)) for x in names[1:]]
    out = C.family_counts(wide, many, compacted=True)
    assert plan(out).count("Range (") == 1
    sample = {(r.fam, r.x, tuple(r.pa)): r.n for r in out.filter(F.col("fam").isin(0, 700, len(many) - 1)).collect()}
    data = wide.collect()
    assert sample == Counter((f, r[many[f][0]], tuple(r[p] for p in many[f][1])) for r in data for f in (0, 700, len(many) - 1))


def test_continuous_samples_take_no_more_slots_than_the_real_table(spark):
    from bayesloom.operators.evaluate import number_cells, to_cells, tstr

    real = spark.createDataFrame([(i % 4, float(i), float(i % 2), i % 2) for i in range(600)], "a int, b double, c double, target int")
    cells = number_cells(real, ["a", "b", "c"], most=50)
    assert cells["a"] == [0, 1, 2, 3] and cells["c"] == [0.0, 1.0] and 40 <= len(cells["b"]) <= 50
    odd = spark.createDataFrame([(-3.0, 1e9), (1.4, 12.0), (2.5, None)], "a double, b double")
    got = [tuple(r) for r in to_cells(odd, {c: cells[c] for c in ("a", "b")}).collect()]
    assert got[0] == (0, len(cells["b"]) - 1) and got[1][0] == 1 and got[2] == (3, None)
    syn = spark.range(2000).selectExpr("rand(1) * 3 AS a", "rand(2) * 600 AS b", "cast(id % 2 as double) + rand(3) * 0.3 AS c", "int(id % 2) AS target")
    out = tstr(syn, real, "target", ["lr"])
    assert out["lr"] == 1.0


def test_counting_ends_by_digits(spark):
    import bisect

    from bayesloom.operators.sample import count_below

    for most in (1, 2, 15, 16, 17, 255, 256, 4096, 5000):
        ends = [[(i + 1) / n for i in range(n)] for n in {1, most // 3 or 1, most}]
        rows = [(e, u) for e in ends for u in (0.0, 0.1, 0.5, 0.999, 1.0, 2.0)] + [(None, 0.5)]
        out = count_below(spark.createDataFrame(rows, "e array<double>, u double"), F.col("e"), F.col("u"), most, "k").collect()
        assert [r.k for r in out] == [bisect.bisect_right(e, u) if e else 0 for e, u in rows]


def test_map_network_as_the_classifier_of_tstr(spark):
    """Codes of several features; null features, unknown codes and rows without a possible label."""
    from bayesloom.operators.evaluate import MapClassifier, tstr

    rows = [(y, (y + i) % 2, y) for i in range(20) for y in (0, 1)] * 2
    syn = spark.createDataFrame(rows, "a int, b int, target int")
    test = spark.createDataFrame([(0, 0, 0), (1, 1, 1), (1, 0, 1), (0, 1, 1)], "a int, b int, target int")
    out = tstr(syn, test, "target", [("map", MapClassifier)])
    assert out == {"map": 0.75, "avg": 0.75}
    model = MapClassifier().fit(syn.withColumnRenamed("target", "label"))
    odd = spark.createDataFrame([(0, None, 0), (None, None, 1), (1, 9, 1), (7, 7, 0)], "a int, b int, label int")
    got = [r["prediction"] for r in model.transform(odd).orderBy("a", "b").collect()]
    assert got == [0.0, 0.0, 1.0, 0.0]  # without evidence the lowest of equally likely labels
    nothing = MapClassifier().fit(syn.limit(0).withColumnRenamed("target", "label"))
    assert [r["prediction"] for r in nothing.transform(odd).collect()] == [None] * 4


def _largest_method(spark, df) -> int:
    """Bytes of the largest method generated for ``df``."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan shows its code only after it has run
    try:
        stages = df.select("*")._jdf.queryExecution().debug().codegenToSeq()
        return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_sample_is_drawn_by_methods_that_the_jvm_compiles(spark):
    """Five features' normal quantiles and a mixture's decoding: no generated method over 8,000 bytes, above which the JVM only interprets."""
    from bayesloom.operators.discretise import MixtureDiscretiser
    from bayesloom.operators.encode import MinMaxScaler
    from bayesloom.operators.predict import GaussianNB
    from bayesloom.operators.sample import gaussian_nb_sample

    names = [f"f{i}" for i in range(5)]
    nb = GaussianNB(names, "y", [0, 1], {0: 0.5, 1: 0.5}, {c: {f: 0.0 for f in names} for c in (0, 1)},
                    {c: {f: 1.0 for f in names} for c in (0, 1)}, 2.0, {0: 1, 1: 1})
    two = MixtureDiscretiser(["a", "b"], MinMaxScaler(["a", "b"], {"a": 0.0, "b": 0.0}, {"a": 1.0, "b": 1.0}), {c: [0.5, 0.5] for c in "ab"},
                             {c: [0.2, 0.8] for c in "ab"}, {c: [0.1, 0.1] for c in "ab"})
    codes = spark.range(100).select("id", (F.col("id") % 16).cast("int").alias("a"), (F.col("id") % 16).cast("int").alias("b"))
    for df in (gaussian_nb_sample(spark, nb, 100), two.inverse(codes, "id")):
        assert 0 < _largest_method(spark, df) < 8000
        assert df.dropna().count() == 100


def test_rounds_share_one_reading_of_the_sample(spark):
    """A sample and the test rows are read once per model, and results are those of a round on its own."""
    from bayesloom.operators import evaluate

    syn = spark.range(0, 400).select((F.col("id") % 3).cast("int").alias("a"), (F.col("id") / 7).alias("x"), (F.col("id") % 2).cast("int").alias("target"))
    test = spark.range(0, 90).select((F.col("id") % 3).cast("int").alias("a"), (F.col("id") % 5).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("target"))

    class Model:
        def sample(self, n, seed):
            return syn

    made, plain = [], evaluate.onehot
    evaluate.onehot = lambda *a, **k: made.append(1) or plain(*a, **k)
    try:
        got = evaluate.multi_round(spark, {"d": (syn, test, "target")}, {"m": lambda t, y: Model()}, 3, classifiers=("lr", ("map", evaluate.MapClassifier)))
    finally:
        evaluate.onehot = plain
    alone = evaluate.tstr(syn, test, "target", ("lr", ("map", evaluate.MapClassifier)))
    assert len(made) == 2
    assert {(r["round"], r["metric"]): r["value"] for r in got.filter("metric != 'seconds'").collect()} == {
        (r, k): v for r in range(3) for k, v in alone.items()}


def test_accuracy_of_counted_rows(spark):
    from bayesloom.operators.evaluate import accuracy

    rows = spark.createDataFrame([(0, 0, 2.0), (1, 0, 1.0), (None, 0, 5.0), (1, None, 3.0), (1, 1, 4.0)], "pred int, target int, w double")
    each = rows.select("pred", "target", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    assert accuracy(rows, weight="w").first() == accuracy(each).first()
    assert tuple(accuracy(rows.limit(0), weight="w").first()) == (0.0, 0)


def test_nodes_of_many_values_are_drawn_by_compiled_methods(spark):
    """Two nodes of 80 values, as a mixture's codes have: searched by digits, the codes are those of the dense comparison."""
    from bayesloom.operators import sample
    from bayesloom.operators.cpt import fit_cpts

    df = spark.range(0, 4000).select(((F.col("id") * F.col("id")) % 80).cast("int").alias("a"), ((F.col("id") * 7 + F.col("id") % 11) % 80).cast("int").alias("b"),
                                     (F.col("id") % 3).cast("int").alias("y"))
    edges, nodes, cards = [("y", "a"), ("y", "b"), ("a", "b")], ["a", "b", "y"], {"a": 80, "b": 80, "y": 3}
    cpts = fit_cpts(df, edges, nodes)
    drawn = sample.ancestral_sample(spark, cpts, edges, nodes, cards, 3000)
    assert 0 < _largest_method(spark, drawn) < 8000
    small, sample.UNROLL_LIMIT = sample.UNROLL_LIMIT, 256
    try:
        dense = sample.ancestral_sample(spark, cpts, edges, nodes, cards, 3000)
        assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, dense.collect()))
    finally:
        sample.UNROLL_LIMIT = small


def test_networks_of_counted_rows(spark):
    from bayesloom.plans.models import BayesNetSynthesizer

    df = spark.range(0, 600).select((F.col("id") % 3).cast("int").alias("a"), (F.col("id") % 4).cast("int").alias("b"), ((F.col("id") % 12) > 5).cast("int").alias("y"))
    counted = df.groupBy("a", "b", "y").agg(F.count("*").cast("double").alias("n"))
    for name in ("hill_climb", "tree", "kdb"):
        one, two = (BayesNetSynthesizer(name).fit(d, ["a", "b"], "y", {"a": 3, "b": 4, "y": 2}, weight=w) for d, w in ((df, None), (counted, "n")))
        assert one.edges == two.edges
        assert sorted(map(repr, one.cpts.collect())) == sorted(map(repr, two.cpts.collect()))
