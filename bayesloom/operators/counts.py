"""Counting and information measures (C1–C10): the core of every model.

All counts are partial+final hash aggregates (map-side combine), so a key holding a
third of the rows costs one partial row per task, not a hot reducer. Many cross
tables are computed in one pass over the compacted table (C2).
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Family = tuple  # (child, tuple(parents))

# families that are spelled out in the code of one generate step
FAMILY_BATCH = 256


def _weight(weight: str | None) -> Column:
    return F.col(weight).cast("double") if weight else F.lit(1.0)


def cross_table(df: DataFrame, cols: Sequence[str], weight: str | None = None) -> DataFrame:
    """N-way counts (or weighted sums) in long form; absent combination = absent row."""
    if not cols:
        raise TypeError("cross_table needs at least one column")
    n = F.sum(F.col(weight).cast("double")) if weight else F.count(F.lit(1))
    return df.groupBy(*cols).agg(n.alias("n"))


def compact(df: DataFrame, cols: Sequence[str], weight: str | None = None) -> DataFrame:
    """Row compaction (design rule 1): distinct model rows with their total weight ``w``."""
    return df.groupBy(*cols).agg(F.sum(_weight(weight)).alias("w"))


def family_counts(df: DataFrame, families: Sequence[Family], weight: str | None = None,
                  compacted: bool = False) -> DataFrame:
    """Counts of many families from one scan.

    Output: (fam int, x int, pa array<int>, n double) where ``fam`` indexes ``families``,
    ``x`` is the child's value and ``pa`` the parent values in family order.

    Families over the same columns share their joint counts, and a family whose columns are a subset of another's is summed from
    those: each compacted row is expanded once per *maximal* set of columns (a Generate, no shuffle) into one hash aggregate, and
    the joint counts, which are model-sized, are rolled up to all families by a second one.
    """
    if not families:
        raise ValueError("no families")
    cols = sorted({c for ch, pa in families for c in (ch, *pa)})
    base = df if compacted else compact(df, cols, weight)
    sets, home = maximal_sets([frozenset((ch, *pa)) for ch, pa in families])
    if len(sets) == len(families):
        return _expanded(base, families)
    joint = _expanded(base, [(s[0], s[1:]) for s in sets])
    joint = joint.select(F.col("fam").alias("__s"), F.concat(F.array("x"), "pa").alias("__v"), "n")
    # which values of its set's joint count are a family's child and parents; a row per family
    places = [(home[i], i, sets[home[i]].index(ch), [sets[home[i]].index(p) for p in pa]) for i, (ch, pa) in enumerate(families)]
    table = df.sparkSession.createDataFrame(places, "__s int, fam int, __x int, __pa array<int>")
    rolled = joint.join(F.broadcast(table), "__s").select(
        "fam", F.get("__v", F.col("__x")).alias("x"), F.transform("__pa", lambda i: F.get(F.col("__v"), i)).alias("pa"), "n")
    return rolled.groupBy("fam", "x", "pa").agg(F.sum("n").alias("n"))


def maximal_sets(wanted: Sequence[frozenset]) -> tuple[list[tuple], list[int]]:
    """The sets (as sorted tuples) that no other of ``wanted`` contains, and for each of ``wanted`` the place of a smallest one around it."""
    sets: list[frozenset] = []
    by_column: dict = {}
    for s in sorted(set(wanted), key=lambda s: (-len(s), sorted(s))):
        around = [by_column.get(c, set()) for c in s]
        if not (set.intersection(*around) if around else sets):
            for c in s:
                by_column.setdefault(c, set()).add(len(sets))
            sets.append(s)
    home = []
    for s in wanted:
        holders = set.intersection(*[by_column[c] for c in s])
        home.append(min(holders, key=lambda i: (len(sets[i]), i)))
    return [tuple(sorted(s)) for s in sets], home


def _expanded(base: DataFrame, families: Sequence[Family]) -> DataFrame:
    """Counts of families straight from the compacted rows, read once. Up to FAMILY_BATCH families are spelled out in generated
    code; more are a literal list of places in the row."""
    if len(families) <= FAMILY_BATCH:
        structs = [F.struct(F.lit(i).alias("fam"), F.col(ch).cast("int").alias("x"),
                            F.array(*[F.col(p).cast("int") for p in pa]).cast(T.ArrayType(T.IntegerType())).alias("pa"))
                   for i, (ch, pa) in enumerate(families)]
        exploded = base.select("w", F.inline(F.array(*structs)))
    else:
        cols = sorted({c for ch, pa in families for c in (ch, *pa)})
        at = {c: i for i, c in enumerate(cols)}
        places = F.array(*[F.struct(F.lit(i).alias("fam"), F.lit(at[ch]).alias("c"), F.array(*[F.lit(at[p]) for p in pa]).cast("array<int>").alias("p"))
                           for i, (ch, pa) in enumerate(families)])
        exploded = base.select("w", F.array(*[F.col(c).cast("int") for c in cols]).alias("v"), F.inline(places)).select(
            "w", "fam", F.get("v", F.col("c")).alias("x"), F.transform("p", lambda i: F.get(F.col("v"), i)).alias("pa"))
    return exploded.groupBy("fam", "x", "pa").agg(F.sum("w").alias("n"))


def normalize_by_parents(counts: DataFrame, group: Sequence[str] = ("fam", "pa")) -> DataFrame:
    """p = n / Σ n over the parent configuration; 0 when the total is 0.

    The window runs over an aggregated table whose groups hold at most card(child) rows.
    """
    w = Window.partitionBy(*group)
    tot = F.sum("n").over(w)
    return counts.withColumn("n_pa", tot).withColumn("p", F.when(F.col("n_pa") > 0, F.col("n") / F.col("n_pa")).otherwise(0.0))


def dense_domain(spark, cols: Sequence[str], cards: dict) -> DataFrame:
    """All code combinations of ``cols`` (Π cards rows), spread over tasks."""
    size = math.prod(int(cards[c]) for c in cols)
    rest, digits = F.col("id"), []
    for c in reversed(cols):  # the digits of the row number in mixed radix
        digits.append((rest % int(cards[c])).cast("int").alias(c))
        rest = F.floor(rest / int(cards[c])) if size < 2**52 else F.expr("0")
    if size >= 2**52:
        raise ValueError("a dense table of that many configurations cannot be written out")
    return spark.range(0, size, 1, max(1, -(-size // 500_000))).select(*digits[::-1])


def smooth_backoff(df: DataFrame, child: str, parents: Sequence[str], cards: dict,
                   weight: str | None = None) -> DataFrame:
    """C4: P(child | p1..pk) on the dense domain; a zero cell takes the estimate with the
    last parent summed out, recursively (levels k, k−1, …, 1; level 0 is the marginal)."""
    k, cols = len(parents), [child, *parents]
    dom = dense_domain(df.sparkSession, cols, cards)
    masked = [f"__m{i}" for i in range(k)]
    # every level in one aggregation: the parents' prefixes, those left out marked by -1
    n = F.sum(_weight(weight)).alias("n")
    if k:
        rolled = df.groupingSets([[F.col(child), *[F.col(p) for p in parents[:lvl]]] for lvl in range(k + 1)], child, *parents).agg(
            n, *[F.grouping(p).alias(f"__g{i}") for i, p in enumerate(parents)])
    else:
        rolled = df.groupBy(child).agg(n)
    level = F.lit(k)
    for i in range(k):
        level = level - F.col(f"__g{i}").cast("int")
    rolled = rolled.select(child, level.alias("__level"), "n", *[F.when(F.col(f"__g{i}") == 1, -1).otherwise(F.col(p)).alias(m)
                                                                 for i, (p, m) in enumerate(zip(parents, masked))])
    share = F.col("n") / F.sum("n").over(Window.partitionBy("__level", *masked))
    rolled = rolled.withColumn("__p", share).filter("__p > 0").drop("n")
    # a cell asks for its prefix on every level and takes the longest one that is there
    asked = dom.select("*", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("__level"))
    asked = asked.select("*", *[F.when(F.col("__level") > i, F.col(p)).otherwise(-1).alias(m) for i, (p, m) in enumerate(zip(parents, masked))])
    found = asked.join(rolled, [child, "__level", *masked], "left")
    return found.groupBy(*cols).agg(F.coalesce(F.max_by("__p", F.when(F.col("__p").isNotNull(), F.col("__level"))), F.lit(0.0)).alias("p"))


def add_uniform(dense: DataFrame, child: str, parents: Sequence[str], count_col: str = "n",
                noise: float = 1e-5) -> DataFrame:
    """An empty parent configuration → uniform 1/card; else noise on zero cells, renormalised.

    ``dense`` holds every (child, parents) combination with its count (0 allowed).
    """
    wdw = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    n = F.coalesce(F.col(count_col).cast("double"), F.lit(0.0))
    noisy = n + F.when(n == 0, F.lit(float(noise))).otherwise(0.0) if noise else n
    out = dense.withColumn("__raw", n).withColumn("__col", F.sum("__raw").over(wdw))
    out = out.withColumn("__noisy", noisy).withColumn("__ns", F.sum("__noisy").over(wdw)).withColumn("__k", F.count(F.lit(1)).over(wdw))
    p = F.when(F.col("__col") == 0, F.lit(1.0) / F.col("__k")).otherwise(
        F.when(F.col("__ns") > 0, F.col("__noisy") / F.col("__ns")).otherwise(F.lit(1.0) / F.col("__k")))
    return out.withColumn("p", p).drop("__raw", "__col", "__noisy", "__ns", "__k")


# ---------------------------------------------------------------- information measures


def mutual_info(df: DataFrame, features: Sequence[str], label: str, base: float = 2.0,
                weight: str | None = None, compacted: bool = False) -> DataFrame:
    """I(X;Y) for each feature, (feature, mi); base 2 by default, ``math.e`` for nats."""
    fams = [(f, (label,)) for f in features]
    ct = family_counts(df, fams, weight, compacted)
    return _mi_from_pairs(ct, base).join(
        df.sparkSession.createDataFrame([(i, f) for i, f in enumerate(features)], "fam int, feature string"),
        "fam").select("feature", "mi")


def _with_totals(ct: DataFrame, by: dict[str, list[str]]) -> DataFrame:
    """``ct`` with the sum of ``n`` over each set of columns: totals by partial aggregation, joined back, so that the cells of
    a family never meet in one task."""
    for name, keys in by.items():
        ct = ct.join(ct.groupBy(*keys).agg(F.sum("n").alias(name)), keys)
    return ct


def _mi_from_pairs(ct: DataFrame, base: float) -> DataFrame:
    """Σ n/N · log(n·N / (n_x·n_y)) from (fam, x, pa=[y], n)."""
    t = _with_totals(ct, {"__nx": ["fam", "x"], "__ny": ["fam", "pa"], "__nn": ["fam"]})
    term = F.col("n") / F.col("__nn") * F.log(F.col("n") * F.col("__nn") / (F.col("__nx") * F.col("__ny")))
    return t.groupBy("fam").agg((F.sum(term) / F.lit(math.log(base))).alias("mi"))


def cond_mutual_info(df: DataFrame, pairs: Sequence[tuple[str, str]], label: str, base: float = 2.0,
                     weight: str | None = None, compacted: bool = False) -> DataFrame:
    """I(Xi;Xj | Y) for each pair, (a, b, cmi)."""
    fams = [(a, (b, label)) for a, b in pairs]
    ct = family_counts(df, fams, weight, compacted)
    return _cmi_from_triples(ct, base).join(
        df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "fam int, a string, b string"),
        "fam").select("a", "b", "cmi")


def _cmi_from_triples(ct: DataFrame, base: float) -> DataFrame:
    """Σ n/N · log(n·n_y / (n_xy·n_zy)) from (fam, x, pa=[z, y], n)."""
    y = F.get(F.col("pa"), 1)
    z = F.get(F.col("pa"), 0)
    t = ct.withColumn("__y", y).withColumn("__z", z)
    t = _with_totals(t, {"__ny": ["fam", "__y"], "__nxy": ["fam", "x", "__y"], "__nzy": ["fam", "__z", "__y"], "__nn": ["fam"]})
    term = F.col("n") / F.col("__nn") * F.log(F.col("n") * F.col("__ny") / (F.col("__nxy") * F.col("__nzy")))
    return t.groupBy("fam").agg((F.sum(term) / F.lit(math.log(base))).alias("cmi"))


def rank_features(mi: DataFrame, features: Sequence[str], digits: int = 10) -> DataFrame:
    """Features by MI descending; ties by feature position (pinned, documented)."""
    idx = mi.sparkSession.createDataFrame([(f, i) for i, f in enumerate(features)], "feature string, idx int")
    j = mi.join(F.broadcast(idx), "feature")
    w = Window.orderBy(F.round("mi", digits).desc(), F.col("idx"))
    # a window without partition is fine here: one row per feature (model-sized)
    return j.withColumn("rank", (F.row_number().over(w) - 1).cast("int"))


def class_prior(df: DataFrame, label: str, weight: str | None = None) -> DataFrame:
    """P(y) = class count / N; an empty table has no class."""
    n = F.sum(_weight(weight))
    counts = df.groupBy(label).agg(n.alias("n"))
    total = df.agg(n.alias("t")).first()["t"]
    return counts.withColumn("prior", F.col("n") / F.lit(float(total or 1.0)))


def kl_loss(df: DataFrame, p_col: str) -> DataFrame:
    """mean(−ln(1 − p))."""
    return df.agg(F.avg(-F.log(F.lit(1.0) - F.col(p_col))).alias("kl_loss"))


def entropy(df: DataFrame, cols: Sequence[str], base: float = 2.0) -> DataFrame:
    """H(cols) from the joint counts; 0 for an empty table."""
    ct = cross_table(df, cols)
    tot = ct.agg(F.sum("n").alias("N")).first()["N"]
    p = F.col("n") / F.lit(float(tot or 1.0))
    return ct.agg(F.coalesce(-F.sum(p * F.log(p)) / F.lit(math.log(base)), F.lit(0.0)).alias("entropy"))


# ---------------------------------------------------------------- similarity of two tables


def _long_values(df: DataFrame, cols: Sequence[str], value_type: str = "double") -> DataFrame:
    parts = ", ".join(f"'{c}', CAST(`{c}` AS {value_type.upper()})" for c in cols)
    return df.select(F.expr(f"stack({len(cols)}, {parts}) as (column, value)")).filter(F.col("value").isNotNull())


def jsd(real: DataFrame, syn: DataFrame, cols: Sequence[str], base: float = 2.0) -> DataFrame:
    """Jensen–Shannon divergence of each column's histogram (column, jsd)."""
    def hist(df, name):
        h = _long_values(df, cols, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        total = h.groupBy("column").agg(F.sum("n").alias("t"))
        return h.join(total, "column").select("column", "value", (F.col("n") / F.col("t")).alias(name))
    j = hist(real, "p").join(hist(syn, "q"), ["column", "value"], "full_outer").fillna(0.0, ["p", "q"])
    m = (F.col("p") + F.col("q")) / 2
    kl = lambda a: F.when(F.col(a) > 0, F.col(a) * F.log(F.col(a) / m)).otherwise(0.0)
    return j.groupBy("column").agg(((F.sum(kl("p")) + F.sum(kl("q"))) / 2 / F.lit(math.log(base))).alias("jsd"))


def wasserstein1(real: DataFrame, syn: DataFrame, cols: Sequence[str]) -> DataFrame:
    """1-D Wasserstein distance per column, Σ |F(x) − G(x)| · (x_next − x).

    The two empirical CDFs need a running sum over the sorted distinct values, taken in two levels
    (:func:`running_totals`), so no single task ever holds a whole column.
    """
    a = _long_values(real, cols).groupBy("column", "value").agg(F.count(F.lit(1)).cast("double").alias("a"))
    b = _long_values(syn, cols).groupBy("column", "value").agg(F.count(F.lit(1)).cast("double").alias("b"))
    tot_a = {r["column"]: r["t"] for r in a.groupBy("column").agg(F.sum("a").alias("t")).collect()}
    tot_b = {r["column"]: r["t"] for r in b.groupBy("column").agg(F.sum("b").alias("t")).collect()}
    j = a.join(b, ["column", "value"], "full_outer").fillna(0.0, ["a", "b"])
    j = j.withColumn("col_id", F.element_at(F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))]), F.col("column")))
    ta = F.element_at(F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(float(tot_a.get(c, 0) or 1)))]), F.col("column"))
    tb = F.element_at(F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(float(tot_b.get(c, 0) or 1)))]), F.col("column"))
    j = j.withColumn("a", F.col("a") / ta).withColumn("b", F.col("b") / tb)
    cum = running_totals(j, "col_id", "value", ["a", "b"])
    term = F.abs(F.col("a_cum") - F.col("b_cum")) * F.coalesce(F.col("value_next") - F.col("value"), F.lit(0.0))
    return cum.groupBy("column").agg(F.sum(term).alias("w1"))


def running_totals(df: DataFrame, group_col: str, order_col: str, value_cols: Sequence[str],
                   num_partitions: int | None = None) -> DataFrame:
    """Cumulative sums of ``value_cols`` per ``group_col`` in ``order_col`` order, plus the
    next ``order_col`` value in the group (``<order>_next``), without a per-group window.

    (group, order) pairs must be unique. Two levels: rows are range-partitioned into parts and written once, so that their placement
    stands; the parts' totals (a row per part and group) run up to offsets; windows inside a part add its own running sums.
    Built-in functions only.
    """
    from bayesloom.session import written

    parts = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(parts, group_col, order_col).withColumn("__part", F.spark_partition_id()))
    totals = placed.groupBy(group_col, "__part").agg(*[F.sum(v).alias(f"__t_{v}") for v in value_cols], F.min(order_col).alias("__first"))
    in_order = Window.partitionBy(group_col).orderBy("__part")
    ahead = in_order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group_col, "__part", F.lead("__first").over(in_order).alias("__follows"),
                            *[F.coalesce(F.sum(f"__t_{v}").over(ahead), F.lit(0.0)).alias(f"__o_{v}") for v in value_cols])
    here = Window.partitionBy(group_col, "__part").orderBy(order_col)
    run = here.rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *[F.sum(v).over(run).alias(f"__c_{v}") for v in value_cols], F.lead(order_col).over(here).alias("__n"))
    both = local.join(offsets, [group_col, "__part"])
    return both.select(*df.columns, *[(F.col(f"__c_{v}") + F.col(f"__o_{v}")).alias(f"{v}_cum") for v in value_cols],
                       F.coalesce("__n", "__follows").alias(f"{order_col}_next"))
