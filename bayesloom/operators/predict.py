"""Prediction operators.

Model parameters are model-sized and inlined as literal arrays over the classes, so a
prediction is a narrow projection; MAP prediction of a Bayesian network joins one
broadcast lookup table per family that touches the label (its Markov blanket).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayesloom.functions import pack_codes
from bayesloom.operators.scores import parent_sets
from bayesloom.operators.sample import fits_broadcast

NEG_INF = float("-inf")
#: variance of a feature that doesn't vary
MIN_VARIANCE = 1e-12
# log of a zero probability inside lookup tables: finite, so sums stay finite and roundable
LOG_ZERO = -1e300


def argmax_expr(scores: Column) -> Column:
    """0-based index of the first maximum of a non-empty array; null if all are −inf/null
    (or at the LOG_ZERO floor, i.e. every label value has probability 0)."""
    mx = F.array_max(scores)
    return F.when(mx.isNull() | (mx <= F.lit(LOG_ZERO / 2)), None).otherwise(F.array_position(scores, mx) - 1).cast("int")


@dataclass
class GaussianNB:
    """Per class mean, variance (+ var_smoothing·max variance, ``MIN_VARIANCE`` at least) and prior.

    A class none of whose rows has a feature has no mean for it (None) and the feature no say in the class's likelihood; nor has a null in a
    row. Features that are constant everywhere have the least variance.
    """

    features: list
    label: str
    classes: list = field(default_factory=list)
    prior: dict = field(default_factory=dict)
    mean: dict = field(default_factory=dict)
    var: dict = field(default_factory=dict)
    n_rows: float = 0.0
    counts: dict = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str], label: str, var_smoothing: float = 1e-9) -> "GaussianNB":
        aggs = [F.count(F.lit(1)).alias("__n")]
        for f in features:
            aggs += [F.avg(F.col(f).cast("double")).alias(f"m_{f}"), F.var_pop(F.col(f).cast("double")).alias(f"v_{f}")]
        rows = df.groupBy(label).agg(*aggs).orderBy(label).collect()
        overall = df.agg(*[F.var_pop(F.col(f).cast("double")).alias(f) for f in features]).first()
        eps = var_smoothing * max((float(overall[f] or 0.0) for f in features), default=0.0)
        total = float(sum(r["__n"] for r in rows))
        m = cls(list(features), label, n_rows=total)
        for r in rows:
            c = r[label]
            m.classes.append(c)
            m.prior[c] = r["__n"] / total
            m.counts[c] = int(r["__n"])
            m.mean[c] = {f: None if r[f"m_{f}"] is None else float(r[f"m_{f}"]) for f in features}
            m.var[c] = {f: max(float(r[f"v_{f}"] or 0.0) + eps, MIN_VARIANCE) for f in features}
        return m

    def joint_log_likelihood(self) -> Column:
        arr = []
        for c in self.classes:
            t = F.lit(math.log(self.prior[c]))
            for f in self.features:
                v = self.var[c][f]
                if self.mean[c][f] is None:
                    continue
                term = F.lit(0.5 * math.log(2 * math.pi * v)) + F.pow(F.col(f).cast("double") - F.lit(self.mean[c][f]), 2) / F.lit(2 * v)
                t = t - F.coalesce(term, F.lit(0.0))
            arr.append(F.round(t, 9))
        return F.array(*arr)

    def predict(self, df: DataFrame, out: str = "pred", proba: str | None = None) -> DataFrame:
        """Argmax of the joint log-likelihood; optional posterior array."""
        d = df.withColumn("__jll", self.joint_log_likelihood())
        classes = F.array(*[F.lit(c) for c in self.classes])
        d = d.withColumn(out, F.element_at(classes, argmax_expr(F.col("__jll")) + 1))
        if proba:
            mx = F.array_max("__jll")
            e = F.transform("__jll", lambda v: F.exp(v - mx))
            d = d.withColumn(proba, F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))
        return d.drop("__jll")


def bn_map_predict(df: DataFrame, cpts: DataFrame, edges, nodes: Sequence[str], label: str, cards: dict,
                   out: str = "pred") -> DataFrame:
    """MAP label given all other nodes; only the label's Markov blanket matters.

    For each family containing the label (its own and its children's), a lookup table
    keyed by the family's other values gives an array over label values of
    P(child value | parents); unseen parent configurations are uniform, an observed
    configuration without the value gives 0. The row's score per label value is the sum
    of logs; rows where every label value has probability 0 get null (unpredictable).
    """
    spark = df.sparkSession
    ps = parent_sets(edges, nodes)
    C = int(cards[label])
    fams = [(label, ps[label])] + [(c, ps[c]) for c in nodes if label in ps[c]]
    d = df
    sums = [None] * C
    for i, (child, pa) in enumerate(fams):
        tab = _family_lookup(spark, cpts, child, pa, label, cards, C)
        others = [p for p in pa if p != label] + ([child] if child != label else [])
        # a null, negative or unknown code makes the key null: the lookup misses and the family is uniform
        key = pack_codes([(F.col(o), int(cards[o])) for o in others])
        tab = tab.withColumnRenamed("__arr", f"__a{i}").withColumnRenamed("__k", f"__k{i}")
        n_keys = tab.count()
        tab = F.broadcast(tab) if fits_broadcast(n_keys, C) else tab
        d = d.withColumn(f"__pk{i}", key).join(tab, F.col(f"__pk{i}") == F.col(f"__k{i}"), "left")
        uni = F.lit(math.log(1.0 / cards[child]))
        for c in range(C):
            term = F.coalesce(F.get(F.col(f"__a{i}"), c), uni)
            sums[c] = term if sums[c] is None else sums[c] + term
        d = d.drop(f"__pk{i}", f"__k{i}")
    # scores rounded to 9 decimals so that ties are pinned to the lowest label value
    total = F.array(*[F.round(t, 9) for t in sums])
    d = d.withColumn(out, argmax_expr(total))
    return d.drop(*[f"__a{i}" for i in range(len(fams))])


def _family_lookup(spark, cpts: DataFrame, child: str, pa: Sequence[str], label: str, cards: dict, C: int) -> DataFrame:
    """(__k, __arr) for one family: key over (other parents…, child value) → array over label values."""
    t = cpts.filter(F.col("child") == child)
    if child == label:
        key = pack_codes([(F.get(F.col("pa"), i), int(cards[p])) for i, p in enumerate(pa)])
        m = t.groupBy(key.alias("__k")).agg(F.map_from_entries(F.collect_list(F.struct("value", "p"))).alias("__m"))
        arr = F.transform(F.sequence(F.lit(0), F.lit(C - 1)), lambda v: F.coalesce(F.element_at(F.col("__m"), v), F.lit(0.0)))
        return m.select("__k", _logs(arr).alias("__arr"))
    j = list(pa).index(label)
    others = [(i, p) for i, p in enumerate(pa) if p != label]
    okey = pack_codes([(F.get(F.col("pa"), i), int(cards[p])) for i, p in others])
    t = t.withColumn("__o", okey).withColumn("__y", F.get(F.col("pa"), j))
    # configurations (others, y) seen in training, per "others" key
    seen = t.groupBy("__o").agg(F.collect_set("__y").alias("__seen"), F.first("pa").alias("__pa"))
    cells = t.groupBy("__o", "value").agg(F.map_from_entries(F.collect_list(F.struct("__y", "p"))).alias("__m"))
    # dense over the child's values for every observed "others" configuration
    dom = seen.select("__o", "__seen", "__pa", F.explode(F.sequence(F.lit(0), F.lit(int(cards[child]) - 1))).alias("value"))
    dom = dom.join(cells, ["__o", "value"], "left")
    uni = 1.0 / cards[child]
    arr = F.transform(F.sequence(F.lit(0), F.lit(C - 1)), lambda v: F.when(
        F.array_contains(F.col("__seen"), v), F.coalesce(F.element_at(F.col("__m"), v), F.lit(0.0))).otherwise(F.lit(uni)))
    key = pack_codes([*[(F.get(F.col("__pa"), i), int(cards[p])) for i, p in others], (F.col("value"), int(cards[child]))])
    return dom.select(key.alias("__k"), _logs(arr).alias("__arr"))


def _logs(arr):
    """ln p per element on the (model-sized) lookup table; p = 0 → LOG_ZERO."""
    return F.transform(arr, lambda p: F.when(p > 0, F.log(p)).otherwise(F.lit(LOG_ZERO)))
