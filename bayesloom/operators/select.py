"""Exact, deterministic hash-order selection (P7 stratified split, P8 sample rows, P9 cap).

"The k rows of a group with the smallest hash" is found without a window over the whole group: a histogram of the leading 16
hash bits per group (one aggregation, which also gives the group sizes) leads to the bucket where the k-th row lies; a bucket
that is still large is split by the other 16 bits; the rows of that small bucket are ranked, and the k-th of them is the cut of the
group. The selection itself is then one narrow pass. A group holding a third of all rows never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bayesloom.functions import hash_uniform
from bayesloom.session import cached, written

#: rows of a bucket that are ranked in one task; larger ones are split by further hash bits first
EDGE_ROWS = 100_000


def _place(hist: DataFrame, group_cols: list[str], k: Column) -> DataFrame:
    """(groups, bucket, need, rows): the bucket in which a group's k-th row lies, and its rank there."""
    w = Window.partitionBy(*group_cols).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("__cum", F.sum("__n").over(w)).withColumn("__k", k).filter("__k > 0 and __cum >= __k")
    first = cum.groupBy(*group_cols).agg(F.min(F.struct("__b", "__cum", "__n", "__k")).alias("s"))
    return first.select(*group_cols, F.col("s.__b").alias("__bucket"), (F.col("s.__k") - F.col("s.__cum") + F.col("s.__n")).alias("__need"),
                        F.col("s.__n").alias("__rows"))


def _beside(df: DataFrame, table: DataFrame, group_cols: list[str], how: str = "left") -> DataFrame:
    """``df`` with the columns of a small per-group table; null groups match each other."""
    t = table.toDF(*[f"__g{i}" for i in range(len(group_cols))], *table.columns[len(group_cols):])
    on = [F.col(f"`{c}`").eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group_cols)]
    return df.join(t, on, how).drop(*[f"__g{i}" for i in range(len(group_cols))])


def take_smallest(df: DataFrame, key: str, quota: Column, group_cols: list[str], seed=42, flag: str | None = None) -> DataFrame:
    """Rows whose (hash, key) rank inside their group is at most the group's quota, an expression over the group's size ``n``.

    With ``flag``, all rows are returned with a boolean column instead of only the selected ones. Null is a group like any other.
    """
    u = hash_uniform(F.col(key).cast("string"), "split", str(seed))
    d = df.withColumn("__u", u).withColumn("__h", F.floor(F.col("__u") * 2**32).cast("long"))
    hist = cached(d.groupBy(*group_cols, F.shiftright("__h", 16).alias("__b")).agg(F.count(F.lit(1)).alias("__n")))
    sizes = hist.groupBy(*group_cols).agg(F.sum("__n").alias("n"))
    k = sizes.select(*group_cols, quota.cast("long").alias("__q"), "n")
    edge = cached(_place(_beside(hist, k, group_cols), group_cols, F.col("__q")))
    inside = _beside(d, edge, group_cols, "inner").filter(F.shiftright("__h", 16) == F.col("__bucket"))
    if (edge.agg(F.max("__rows")).first()[0] or 0) > EDGE_ROWS:
        fine = inside.groupBy(*group_cols, F.col("__h").alias("__b")).agg(F.count(F.lit(1)).alias("__n"), F.first("__need").alias("__need"))
        narrow = _place(fine, group_cols, F.col("__need"))
        inside = _beside(d, narrow, group_cols, "inner").filter(F.col("__h") == F.col("__bucket"))
    rank = Window.partitionBy(*group_cols).orderBy("__u", key)
    cut = (inside.withColumn("__rank", F.row_number().over(rank)).filter("__rank = __need")
           .select(*group_cols, F.col("__u").alias("__cu"), F.col(key).alias("__ck")))
    plan = written(_beside(k.withColumn("__all", F.col("__q") >= F.col("n")).select(*group_cols, "__all"), cut, group_cols))
    hist.unpersist()
    edge.unpersist()
    j = _beside(d, plan, group_cols)
    chosen = F.coalesce(F.col("__all") | (F.col("__u") < F.col("__cu")) | ((F.col("__u") == F.col("__cu")) & (F.col(key) <= F.col("__ck"))), F.lit(False))
    out = j.withColumn("__sel", chosen).drop("__u", "__h", "__all", "__cu", "__ck")
    return out.withColumnRenamed("__sel", flag) if flag else out.filter("__sel").drop("__sel")


def stratified_split(df: DataFrame, label: str, key: str = "row_key", test_frac: float = 0.2, seed=42) -> DataFrame:
    """Adds ``is_test``; per class exactly ceil(test_frac · n_class) rows are test rows.

    Deterministic: depends on the key and seed, not on partitioning.
    """
    return take_smallest(df, key, F.ceil(F.col("n") * F.lit(float(test_frac))), [label], seed, flag="is_test")


def sample_rows(df: DataFrame, key: str = "row_key", n: int | None = None, frac: float | None = None,
                seed=42) -> DataFrame:
    """N (or int(N·frac)) rows without replacement, chosen by hash order of the key."""
    if n is None and frac is None:
        raise ValueError("give n or frac")
    quota = F.lit(int(n)) if n is not None else F.floor(F.col("n") * F.lit(float(frac)))
    return take_smallest(df.withColumn("__g", F.lit(0)), key, quota, ["__g"], seed).drop("__g")


def sample_cap(df: DataFrame, key: str = "row_key", cap: int = 1000, seed=42) -> DataFrame:
    """Shrink a training table above ``cap`` rows to exactly ``cap`` rows."""
    return sample_rows(df, key, n=cap, seed=seed)
