"""Decomposable structure scores.

Discrete scores come from one family-count job (C2) followed by two small
aggregations (per parent configuration, then per family); log-gamma is a JVM
column expression, so nothing leaves codegen.

Local scores of family (child X with r states, parents with q = Π cards configurations):
  ll    = Σ n·ln(n/n_pa)
  bic   = ll − ½·ln N·q·(r−1)
  aic   = ll − q·(r−1)
  k2    = Σ_pa [lnΓ(r) − lnΓ(N_pa + r)] + Σ_cells lnΓ(n + 1)
  bdeu  = Σ_pa [lnΓ(α/q) − lnΓ(N_pa + α/q)] + Σ_cells [lnΓ(n + α/(rq)) − lnΓ(α/(rq))]
  bds   = bdeu with q replaced by the number of observed parent configurations
Unobserved configurations contribute 0 to k2/bdeu/bds. Higher is better for all.
"""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayesloom.functions import lgamma
from bayesloom.operators.counts import Family, compact, family_counts

SCORES = ("ll", "bic", "aic", "k2", "bdeu", "bds")


def _q(parents: Sequence[str], cards: dict) -> float:
    q = 1.0
    for p in parents:
        q *= cards[p]
    return q


def local_scores(df: DataFrame, families: Sequence[Family], cards: dict, kind: str = "bic",
                 ess: float = 10.0, weight: str | None = None, compacted: bool = False,
                 n_rows: float | None = None) -> DataFrame:
    """K7: (fam, score) for each family; ``kind`` in SCORES, ``"all"`` or a callable.

    ``"all"`` returns every score of SCORES as a column from the same aggregation.
    A callable gets the Columns (n, n_pa, r, q, N) of the cell level and returns the
    per-cell term to sum (custom decomposable score).
    """
    spark = df.sparkSession
    if n_rows is None:
        w = "w" if compacted else weight
        n_rows = float(df.agg(F.sum(F.col(w).cast("double")) if w else F.count(F.lit(1))).first()[0] or 0.0)
    ct = family_counts(df, families, weight, compacted)
    meta = spark.createDataFrame(
        [(i, float(cards[ch]), _q(pa, cards)) for i, (ch, pa) in enumerate(families)], "fam int, r double, q double")
    ct = ct.join(F.broadcast(meta), "fam")
    N = F.lit(float(n_rows))
    if callable(kind):
        from pyspark.sql import Window
        t = ct.withColumn("n_pa", F.sum("n").over(Window.partitionBy("fam", "pa")))
        return t.groupBy("fam").agg(F.sum(kind(F.col("n"), F.col("n_pa"), F.col("r"), F.col("q"), N)).alias("score"))
    need_bds = kind in ("bds", "all")
    if need_bds:
        # observed parent configurations per family (BDs prior); a small aggregate
        qobs = ct.groupBy("fam").agg(F.countDistinct("pa").cast("double").alias("q_obs"))
        ct = ct.join(F.broadcast(qobs), "fam")
    else:
        ct = ct.withColumn("q_obs", F.col("q"))
    beta = F.lit(ess) / (F.col("r") * F.col("q"))
    beta_s = F.lit(ess) / (F.col("r") * F.col("q_obs"))
    cell = {
        "nlnn": F.col("n") * F.log(F.col("n")),
        "lg1": lgamma(F.col("n") + 1),
        "lgb": lgamma(F.col("n") + beta) - lgamma(beta),
        "lgs": lgamma(F.col("n") + beta_s) - lgamma(beta_s),
    }
    if kind not in ("all", "k2"):
        cell.pop("lg1")
    if kind not in ("all", "bdeu"):
        cell.pop("lgb")
    if kind not in ("all", "bds"):
        cell.pop("lgs")
    lvl1 = ct.groupBy("fam", "pa", "r", "q", "q_obs").agg(F.sum("n").alias("n_pa"), *[F.sum(v).alias(k) for k, v in cell.items()])
    npa = F.col("n_pa")
    alpha = F.lit(ess) / F.col("q")
    alpha_s = F.lit(ess) / F.col("q_obs")
    conf = {"ll": F.col("nlnn") - npa * F.log(npa)}
    if "lg1" in cell:
        conf["k2"] = lgamma(F.col("r")) - lgamma(npa + F.col("r")) + F.col("lg1")
    if "lgb" in cell:
        conf["bdeu"] = lgamma(alpha) - lgamma(npa + alpha) + F.col("lgb")
    if "lgs" in cell:
        conf["bds"] = lgamma(alpha_s) - lgamma(npa + alpha_s) + F.col("lgs")
    fam = lvl1.groupBy("fam", "r", "q").agg(*[F.sum(v).alias(k) for k, v in conf.items()])
    penalty = F.col("q") * (F.col("r") - 1)
    cols = {
        "ll": F.col("ll"),
        "bic": F.col("ll") - F.lit(0.5) * F.log(N) * penalty,
        "aic": F.col("ll") - penalty,
    }
    for k in ("k2", "bdeu", "bds"):
        if k in conf:
            cols[k] = F.col(k)
    if kind == "all":
        return fam.select("fam", *[v.alias(k) for k, v in cols.items()])
    return fam.select("fam", cols[kind].alias("score"))


def structure_prior_ratio(op: str, kind: str = "bic") -> float:
    """K8: logarithm of the structure prior after an operation over that before: ``bds`` takes a uniform prior over the three
    states of a pair of nodes in which an arc has half the mass of none (adding −ln 2, removing +ln 2, turning 0); the
    other scores have a uniform prior over networks."""
    if kind != "bds":
        return 0.0
    return {"+": -math.log(2.0), "-": math.log(2.0), "flip": 0.0}[op]


def parent_sets(edges: Sequence[tuple[str, str]], nodes: Sequence[str]) -> dict[str, tuple]:
    """Parents of each node, in node order (the order fixes the ``pa`` array layout)."""
    pos = {n: i for i, n in enumerate(nodes)}
    out = {n: [] for n in nodes}
    for s, t in edges:
        out[t].append(s)
    return {n: tuple(sorted(ps, key=lambda p: pos[p])) for n, ps in out.items()}


def structure_score(df: DataFrame, edges: Sequence[tuple[str, str]], nodes: Sequence[str], cards: dict,
                    kind: str = "bic", continuous: Sequence[str] = (), **kw) -> float:
    """K9: Σ local scores over all nodes. ``bic-g``: every node Gaussian; ``bic-cg``: the nodes in ``continuous``
    Gaussian given their discrete parents' values, the others discrete (all discrete: the same as ``bic``).

    A Gaussian node without residual variance makes the score infinite; it's never left out.
    """
    if kind == "bic-g":
        return float(sum(gaussian_local_scores(df, edges, nodes).values()))
    ps = parent_sets(edges, nodes)
    total, discrete = 0.0, [n for n in nodes if kind != "bic-cg" or n not in continuous]
    if kind == "bic-cg":
        for n in nodes:
            if n in continuous:
                total += conditional_gaussian_score(df, n, [p for p in ps[n] if p not in continuous], [p for p in ps[n] if p in continuous])
            elif any(p in continuous for p in ps[n]):
                raise ValueError(f"discrete node {n!r} has a continuous parent")
        kind = "bic"
    if discrete:
        rows = local_scores(df, [(n, ps[n]) for n in discrete], cards, kind, **kw).collect()
        total += float(sum(r["score"] for r in rows))
    return total


def moments(df: DataFrame, cols: Sequence[str], weight: str | None = None, by: Sequence[str] = ()):
    """N, means and population covariances of all column pairs (O(d²) numbers to the driver), per group of ``by`` if given.

    Products are taken around the overall mean, so a large common offset costs no precision.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    x = [F.col(c).cast("double") for c in cols]
    first = df.agg(F.sum(w).alias("__n"), *[(F.sum(w * v) / F.sum(w)).alias(f"m_{i}") for i, v in enumerate(x)]).first()
    center = [first[f"m_{i}"] or 0.0 for i in range(len(cols))]
    dx = [v - F.lit(m) for v, m in zip(x, center)]
    aggs = [F.sum(w).alias("__n")]
    for i in range(len(cols)):
        aggs.append(F.sum(w * dx[i]).alias(f"s_{i}"))
        aggs += [F.sum(w * dx[i] * dx[j]).alias(f"p_{i}_{j}") for j in range(i, len(cols))]

    def of(r) -> dict:
        d, n = len(cols), float(r["__n"] or 0.0)
        mean = np.array([r[f"s_{i}"] / n if n else 0.0 for i in range(d)])
        cov = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                cov[i, j] = cov[j, i] = r[f"p_{i}_{j}"] / n - mean[i] * mean[j] if n else 0.0
        return {"n": n, "mean": mean + np.array(center), "cov": cov, "cols": list(cols)}

    return [of(r) for r in df.groupBy(*by).agg(*aggs).collect()] if by else of(df.agg(*aggs).first())


def _residual_log_likelihood(mom: dict, child: str, parents: Sequence[str]) -> float:
    """Log-likelihood of a node regressed on its parents (least squares with intercept): −N/2·(ln(2πσ²) + 1); ∞ if σ² is 0
    up to rounding."""
    idx = {c: i for i, c in enumerate(mom["cols"])}
    y, pa, cov = idx[child], [idx[p] for p in parents], mom["cov"]
    var = cov[y, y]
    if pa:
        sxy = cov[pa, y]
        scale = np.sqrt(np.maximum(np.diag(cov)[pa], 1e-300))
        beta = np.linalg.lstsq(cov[np.ix_(pa, pa)] / np.outer(scale, scale), sxy / scale, rcond=1e-12)[0]
        var = var - float((sxy / scale) @ beta)
    if var <= 1e-12 * cov[y, y] or var <= 0:
        return math.inf
    return -mom["n"] / 2.0 * (math.log(2 * math.pi * var) + 1.0)


def gaussian_family_score(mom: dict, child: str, parents: Sequence[str]) -> float:
    """``bic-g`` of one family from the moments: log-likelihood − (k + 2)/2 · ln N for k parents."""
    return _residual_log_likelihood(mom, child, parents) - (len(parents) + 2) / 2.0 * math.log(mom["n"])


def gaussian_local_scores(df: DataFrame, edges, nodes, mom: dict | None = None) -> dict:
    """K9 ``bic-g`` of every node; ∞ for a node without residual variance."""
    mom = mom or moments(df, list(nodes))
    ps = parent_sets(edges, nodes)
    return {n: gaussian_family_score(mom, n, ps[n]) for n in nodes}


def conditional_gaussian_score(df: DataFrame, child: str, discrete: Sequence[str], continuous: Sequence[str]) -> float:
    """``bic-cg`` of a continuous node: a regression on the continuous parents for each seen configuration of the discrete ones."""
    cols = [child, *continuous]
    groups = moments(df, cols, by=list(discrete)) if discrete else [moments(df, cols)]
    n = sum(g["n"] for g in groups)
    ll = sum(_residual_log_likelihood(g, child, continuous) for g in groups)
    return ll - len(groups) * (len(continuous) + 2) / 2.0 * math.log(n)


def complexity_penalty(n_nodes: int, n_rows: float) -> float:
    """(number of CPTs / 2) · ln N."""
    return n_nodes / 2.0 * math.log(n_rows)


#: distinct rows that a task over a kept compaction takes
COMPACT_ROWS = 200_000


def compacted(df: DataFrame, cols: Sequence[str], weight: str | None = None) -> DataFrame:
    """Persisted compaction of the model columns, reused by every score of a search. In as many partitions as its rows need: a kept table stays in
    all partitions of the shuffle, and every task of every job over it sends its report to the driver."""
    from bayesloom.session import cached
    dealt = cached(compact(df, cols, weight))
    out = cached(dealt.coalesce(max(1, -(-dealt.count() // COMPACT_ROWS))))
    out.count()
    dealt.unpersist()
    return out
