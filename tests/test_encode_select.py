import math

from pyspark.sql import functions as F

from bayesloom.operators import encode as E
from bayesloom.operators import select as SEL
from bayesloom.operators.discretise import UniformBins


def test_category_encoder_roundtrip_and_unknown(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "s string")
    enc = E.CategoryEncoder.fit(df, ["s"])
    assert enc.categories["s"] == ["a", "b", "c"]
    coded = enc.transform(df)
    assert [r.s for r in coded.collect()] == [1, 0, 2, 0]
    assert [r.s for r in enc.inverse(coded).collect()] == ["b", "a", "c", "a"]
    new = spark.createDataFrame([("z",), ("b",), (None,)], "s string")
    assert [r.s for r in enc.transform(new).collect()] == [-1, 1, None]


def test_numeric_categories_sort_numerically(spark):
    df = spark.createDataFrame([(10,), (9,), (100,)], "v int")
    enc = E.CategoryEncoder.fit(df, ["v"])
    assert enc.categories["v"] == [9, 10, 100]


def test_uniform_bins_edges_max_and_constant(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0), (2.0, 1.0), (5.0, 1.0), (10.0, 1.0)], "x double, c double")
    b = UniformBins.fit(df, ["x", "c"], 5)
    out = [(r.x, r.c) for r in b.transform(df).collect()]
    # edges 2, 4, 6, 8: a value on an inner edge goes up; the maximum is in the last bin
    assert [o[0] for o in out] == [0, 0, 1, 2, 4]
    assert all(o[1] == 0 for o in out)


def test_stratified_split_exact_and_partition_invariant(spark):
    rows = [(f"k{i}", i % 3) for i in range(1000)]
    df = spark.createDataFrame(rows, "row_key string, y int")
    a = SEL.stratified_split(df.repartition(1), "y", "row_key", 0.2, 7)
    b = SEL.stratified_split(df.repartition(8), "y", "row_key", 0.2, 7)
    ta = {r.row_key for r in a.filter("is_test").collect()}
    tb = {r.row_key for r in b.filter("is_test").collect()}
    assert ta == tb
    counts = {r.y: r["count"] for r in a.filter("is_test").groupBy("y").count().collect()}
    for y in range(3):
        n_y = sum(1 for _, c in rows if c == y)
        assert counts[y] == math.ceil(0.2 * n_y)
    assert a.count() == 1000


def test_sample_rows_and_cap(spark):
    df = spark.createDataFrame([(str(i),) for i in range(500)], "row_key string")
    s = SEL.sample_rows(df, n=37, seed=3)
    assert s.count() == 37 and s.distinct().count() == 37
    assert SEL.sample_rows(df, frac=0.1).count() == 50
    assert SEL.sample_cap(df, cap=1000).count() == 500
    assert SEL.sample_cap(df, cap=100).count() == 100
    # same rows as a full sort by (hash, key)
    from bayesloom.functions import hash_uniform
    ref = [r.row_key for r in df.withColumn("u", hash_uniform(F.col("row_key"), "split", "3")).orderBy("u", "row_key").limit(37).collect()]
    assert set(ref) == {r.row_key for r in s.collect()}


def test_cleaning_helpers(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 3.0, None), (3, 4.0, "b")], "a int, b double, c string")
    audit = {r.column: r.n_null for r in E.null_audit(df).collect()}
    assert audit == {"a": 0, "b": 1, "c": 1}
    assert E.drop_null_rows(df).count() == 1
    kinds = {r.column: r.is_discrete for r in E.infer_discrete_columns(df).collect()}
    assert kinds["c"] and kinds["a"]
    renamed = E.rename_hyphens(spark.createDataFrame([(1,)], "`top-left` int"))
    assert renamed.columns == ["top_left"]
    x, y, name = E.split_label(df)
    assert name == "c" and x.columns == ["a", "b"]
    s2, r2 = E.align_columns(df.select("c", "a"), df)
    assert s2.columns == ["a", "c"] == r2.columns


def test_onehot_unknown_is_zero(spark):
    train = spark.createDataFrame([("a", 1), ("b", 2)], "s string, t int")
    enc = E.CategoryEncoder.fit(train, ["s", "t"])
    test = spark.createDataFrame([("b", 2), ("z", 1)], "s string, t int")
    vecs = [r.features.toArray().tolist() for r in E.onehot(test, ["s", "t"], enc).collect()]
    assert vecs[0] == [0.0, 1.0, 0.0, 1.0]
    assert vecs[1] == [0.0, 0.0, 1.0, 0.0]


def test_scalers(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    z = [r.x for r in E.StandardScaler.fit(df, ["x"]).transform(df).collect()]
    assert z == [-1.0, 1.0]
    mm = E.MinMaxScaler.fit(df, ["x"])
    assert [r.x for r in mm.inverse(mm.transform(df)).collect()] == [1.0, 3.0]
