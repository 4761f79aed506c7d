"""Conditional probability tables.

A CPT is a long DataFrame (child, pa array<int>, value, n, p, cum_lo, cum_hi): one row
per observed (parent configuration, child value). Unseen parent configurations are
uniform (handled by the consumers). Intervals come from integer running counts, so
[cum_lo, cum_hi) partitions [0, 1) exactly and the last cum_hi is 1.0.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bayesloom.operators.counts import family_counts
from bayesloom.operators.scores import parent_sets

CPT_SCHEMA = "child string, pa array<int>, value int, n double, p double, cum_lo double, cum_hi double"


def fit_cpts(df: DataFrame, edges, nodes: Sequence[str], weight: str | None = None, compacted: bool = False,
             only: Sequence[str] | None = None, materialize: bool = True) -> DataFrame:
    """G1: maximum-likelihood P(child | parents) of every node, one family-count job.

    The result is model-sized; it is cached so that the many
    small lookups built from it do not re-run the scan of the data.
    """
    ps = parent_sets(edges, nodes)
    targets = list(only) if only is not None else list(nodes)
    fams = [(n, ps[n]) for n in targets]
    ct = family_counts(df, fams, weight, compacted)
    names = df.sparkSession.createDataFrame([(i, n) for i, n in enumerate(targets)], "fam int, child string")
    ct = ct.join(F.broadcast(names), "fam").drop("fam")
    out = with_intervals(ct)
    if materialize:
        from bayesloom.session import cached
        out = cached(out)
    return out


def fit_cpts_of(df: DataFrame, networks: dict, nodes: Sequence[str], weight: str | None = None, compacted: bool = False) -> DataFrame:
    """G1 for several networks over the same nodes: children are named node@network. A family that networks share is counted
    once, and all of them in one job."""
    from bayesloom.session import cached

    sets = {name: parent_sets(edges, nodes) for name, edges in networks.items()}
    families = sorted({(n, ps[n]) for ps in sets.values() for n in nodes})
    number = {f: i for i, f in enumerate(families)}
    names = df.sparkSession.createDataFrame([(number[n, ps[n]], f"{n}@{name}") for name, ps in sets.items() for n in nodes], "fam int, child string")
    counts = family_counts(df, families, weight, compacted).join(F.broadcast(names), "fam").drop("fam")  # a row per network and node
    return cached(with_intervals(counts))


def with_intervals(ct: DataFrame, p_col: str | None = None) -> DataFrame:
    """p and [cum_lo, cum_hi) per (child, pa), ordered by value (groups ≤ card(child) rows)."""
    grp = Window.partitionBy("child", "pa")
    run = grp.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ct = ct.withColumnRenamed("x", "value") if "x" in ct.columns else ct
    if p_col is None:
        tot = F.sum("n").over(grp)
        cum = F.sum("n").over(run)
        out = (ct.withColumn("__t", tot).withColumn("__c", cum)
               .withColumn("p", F.col("n") / F.col("__t"))
               .withColumn("cum_lo", (F.col("__c") - F.col("n")) / F.col("__t"))
               .withColumn("cum_hi", F.col("__c") / F.col("__t")))
    else:
        tot = F.sum(p_col).over(grp)
        cum = F.sum(p_col).over(run)
        out = (ct.withColumn("__t", tot).withColumn("__c", cum)
               .withColumn("p", F.col(p_col) / F.col("__t"))
               .withColumn("cum_lo", (F.col("__c") - F.col(p_col)) / F.col("__t"))
               .withColumn("cum_hi", F.when(F.col("__c") >= F.col("__t"), 1.0).otherwise(F.col("__c") / F.col("__t"))))
        if "n" not in out.columns:
            out = out.withColumn("n", F.lit(None).cast("double"))
    return out.select("child", "pa", F.col("value").cast("int").alias("value"), F.col("n").cast("double").alias("n"),
                      "p", "cum_lo", "cum_hi")


def refresh_cpts(cpts: DataFrame, df: DataFrame, old_edges, new_edges, nodes, **kw) -> DataFrame:
    """Refit only the families whose parent set changed; keep the other CPT rows."""
    old_ps, new_ps = parent_sets(old_edges, nodes), parent_sets(new_edges, nodes)
    changed = [n for n in nodes if old_ps[n] != new_ps[n]]
    if not changed:
        return cpts
    fresh = fit_cpts(df, new_edges, nodes, only=changed, **kw)
    return cpts.filter(~F.col("child").isin(changed)).unionByName(fresh)


def cpt_check(cpts: DataFrame, tol: float = 1e-6) -> DataFrame:
    """(child, pa, total) of configurations whose probabilities do not sum to 1."""
    s = cpts.groupBy("child", "pa").agg(F.sum("p").alias("total"))
    return s.filter(F.abs(F.col("total") - 1.0) > tol)


def cpt_fix(cpts: DataFrame) -> DataFrame:
    """Renormalise every configuration (window over ≤ card(child) rows)."""
    return with_intervals(cpts.withColumnRenamed("p", "__p").drop("cum_lo", "cum_hi"), p_col="__p")


def weights_to_cpts(weights: DataFrame, cards: dict, noise: float = 0.0) -> DataFrame:
    """Generator log-weights (child, pa, value, logw) → CPT rows.

    exp and renormalise inside each (child, parent configuration); with ``noise`` the
    configuration is spread over the child's full domain (unseen values get ``noise``
    before renormalising, as C5 does).
    """
    grp = Window.partitionBy("child", "pa")
    w = weights.withColumn("__m", F.max("logw").over(grp)).withColumn("__e", F.exp(F.col("logw") - F.col("__m")))
    if noise:
        spark = weights.sparkSession
        dom = spark.createDataFrame([(c, k) for c, r in cards.items() for k in range(int(r))], "child string, value int")
        cfg = w.select("child", "pa").distinct().join(F.broadcast(dom), "child")
        w = cfg.join(w.select("child", "pa", "value", "__e"), ["child", "pa", "value"], "left")
        w = w.withColumn("__e", F.coalesce(F.col("__e") / F.sum("__e").over(grp), F.lit(0.0)))
        w = w.withColumn("__e", F.col("__e") + F.when(F.col("__e") == 0, F.lit(float(noise))).otherwise(0.0))
    return with_intervals(w.select("child", "pa", "value", "__e"), p_col="__e")


def cpt_check_summary(cpts: DataFrame, tol: float = 1e-9) -> DataFrame:
    """G5 report: per child, configurations checked and configurations off by more than ``tol``."""
    s = cpts.groupBy("child", "pa").agg(F.sum("p").alias("total"))
    return s.groupBy("child").agg(F.count(F.lit(1)).alias("n_configs"),
                                  F.sum((F.abs(F.col("total") - 1.0) > tol).cast("int")).alias("n_bad"))
