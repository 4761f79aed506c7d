"""Discriminative generator weights (G3) as tables.

The model is a softmax regression from the high-order features (child value × parent configuration, one block per feature) to the
label, with each weight block projected to log-probabilities inside every (parent configuration, class) group — so after
each epoch the weights *are* log P(child | parents, y) and turn into CPTs (G4).

The weights are one table (f, i, cfg, value, w0 … w[C−1]): a row per entry of the encoder's book, a column per class, and the
classes' bias as the row f = −1. An epoch joins the compacted rows with their features' pages (broadcast by size), takes the
residuals, sums them per (f, i) in one aggregation, adds them to the weights, projects inside the groups and writes the
next table. The driver sees the sizes, the classes and one number per epoch, the mean log-likelihood.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bayesloom.operators.sample import fits_broadcast
from bayesloom.session import release, written

#: logarithm of the prior of a class without a row
NO_ROW = -30.0


class DiscriminativeWeights:
    """``table`` holds the current weights; ``history`` the mean conditional log-likelihood before each epoch's step."""

    def __init__(self, encoder, label: str, classes: list, smoothing: float = 1.0):
        self.enc, self.label, self.classes, self.smoothing = encoder, label, list(classes), smoothing
        self.columns = [f"w{k}" for k in range(len(self.classes))]
        self.table: DataFrame | None = None
        self.n_rows = 0.0
        self.history: list = []

    def _long(self, df: DataFrame, *carry):
        """A row per feature and one of the bias (f = −1, i = 0)."""
        codes = [F.struct(F.lit(-1).alias("f"), F.lit(0).alias("i"))]
        codes += [F.struct(F.lit(n).alias("f"), F.col(f"{f}_ho").alias("i")) for n, f in enumerate(self.enc.features)]
        return df.select(*carry, F.inline(F.array(*codes))).filter("i >= 0")

    def _project(self, weights: DataFrame) -> DataFrame:
        """Log-softmax inside each (feature, parent configuration) and class: windows of at most card(child) rows. The bias stays."""
        group = Window.partitionBy("f", "cfg")
        shifted = weights.select("*", *[F.max(c).over(group).alias(f"m_{c}") for c in self.columns])
        sums = shifted.select("*", *[F.sum(F.exp(F.col(c) - F.col(f"m_{c}"))).over(group).alias(f"s_{c}") for c in self.columns])
        out = [F.when(F.col("f") < 0, F.col(c)).otherwise(F.col(c) - F.col(f"m_{c}") - F.log(f"s_{c}")).alias(c) for c in self.columns]
        return sums.select("f", "i", "cfg", "value", *out, "ll")

    def _replace(self, table: DataFrame) -> None:
        old, self.table = self.table, written(table)
        if old is not None:
            release(old)

    def init_from_counts(self, compact: DataFrame) -> None:
        """Count initialisation: Laplace-smoothed log P(child | parents, y), and the classes' log shares as bias."""
        per_class = [F.sum(F.when(F.col(self.label) == c, F.col("w")).otherwise(0.0)).alias(f"n{k}") for k, c in enumerate(self.classes)]
        counts = self._long(compact, self.label, "w").groupBy("f", "i").agg(*per_class)
        book = self.enc.book.select("f", F.col("i").cast("int").alias("i"), F.col("cfg").cast("decimal(38,0)").alias("cfg"), "value")
        bias = book.sparkSession.createDataFrame([(-1, 0, None, None)], "f int, i int, cfg decimal(38,0), value int")
        self.n_rows = float(compact.agg(F.sum("w")).first()[0] or 0.0)
        start = []
        for k, c in enumerate(self.columns):
            share = F.when(F.col(f"n{k}") > 0, F.log(F.col(f"n{k}") / self.n_rows)).otherwise(NO_ROW)
            start.append(F.when(F.col("f") < 0, share).otherwise(F.log(F.coalesce(f"n{k}", F.lit(0.0)) + self.smoothing)).alias(c))
        both = book.unionByName(bias).join(counts, ["f", "i"], "left")
        self._replace(self._project(both.select("f", "i", "cfg", "value", *start, F.lit(None).cast("double").alias("ll"))))

    def _logits(self, compact: DataFrame) -> DataFrame:
        """Rows with the classes' logits l0, l1, ..: the bias and the weights of the row's entries (unseen ones: nothing)."""
        d, pages = compact, [-1, *range(len(self.enc.features))]
        for n in pages:
            code = F.lit(0) if n < 0 else F.col(f"{self.enc.features[n]}_ho")
            page = self.table.filter(F.col("f") == n).select(F.col("i").alias("__i"), *[F.col(c).alias(f"__{n + 1}_{c}") for c in self.columns])
            size = 1 if n < 0 else self.enc.sizes[self.enc.features[n]]
            page = F.broadcast(page) if fits_broadcast(size, len(self.columns)) else page
            d = d.join(page, code == F.col("__i"), "left").drop("__i")
        total = lambda c: reduce(lambda a, b: a + b, [F.coalesce(f"__{n + 1}_{c}", F.lit(0.0)) for n in pages])
        d = d.select(*compact.columns, *[total(c).alias(f"l{k}") for k, c in enumerate(self.columns)])
        return d.withColumn("__m", F.greatest(*[F.col(f"l{k}") for k in range(len(self.columns))]) if len(self.columns) > 1 else F.col("l0"))

    def epoch(self, compact: DataFrame, lr: float = 1.0) -> float:
        """One full-batch gradient step of the conditional log-likelihood, then projection. Returns the mean before the step."""
        classes = range(len(self.columns))
        d = self._logits(compact)
        d = d.withColumn("__t", reduce(lambda a, b: a + b, [F.exp(F.col(f"l{k}") - F.col("__m")) for k in classes]))
        mine = [F.col(self.label) == c for c in self.classes]
        own = F.coalesce(*[F.when(mine[k], F.col(f"l{k}")) for k in classes])
        residual = [(F.col("w") * (mine[k].cast("double") - F.exp(F.col(f"l{k}") - F.col("__m")) / F.col("__t"))).alias(f"r{k}") for k in classes]
        d = d.select(*[f"{f}_ho" for f in self.enc.features], *residual, (F.col("w") * (own - F.col("__m") - F.log("__t"))).alias("ll"))
        steps = self._long(d, *[f"r{k}" for k in classes], "ll").groupBy("f", "i").agg(
            *[F.sum(f"r{k}").alias(f"g{k}") for k in classes], F.sum("ll").alias("step_ll"))
        moved = [(F.col(c) + F.coalesce(F.col(f"g{k}"), F.lit(0.0)) * (lr / self.n_rows)).alias(c) for k, c in enumerate(self.columns)]
        joined = self.table.join(steps, ["f", "i"], "left")
        self._replace(self._project(joined.select("f", "i", "cfg", "value", *moved, (F.col("step_ll") / self.n_rows).alias("ll"))))
        ll = float(self.table.filter("f = -1").select("ll").first()[0])
        self.history.append(ll)
        return ll

    def log_weights(self) -> DataFrame:
        """(child, pa, value, logw) for G4: pa holds the parents' values in feature order, then the class; the label's rows are the bias."""
        parts = []
        for n, f in enumerate(self.enc.features):
            rest, digits = F.col("cfg"), []
            for p in reversed(self.enc.parents[f]):
                card = F.lit(int(self.enc.cards[p])).cast("decimal(38,0)")
                digits.append((rest % card).cast("int"))
                rest = F.floor((rest - rest % card) / card).cast("decimal(38,0)")
            page = self.table.filter(F.col("f") == n)
            cells = [F.struct(F.array(*digits[::-1], F.lit(int(c))).alias("pa"), F.col(w).alias("logw")) for c, w in zip(self.classes, self.columns)]
            parts.append(page.select(F.lit(f).alias("child"), "value", F.inline(F.array(*cells))).select("child", "pa", "value", "logw"))
        bias = [F.struct(F.lit(int(c)).alias("value"), F.col(w).alias("logw")) for c, w in zip(self.classes, self.columns)]
        parts.append(self.table.filter("f = -1").select(F.lit(self.label).alias("child"), F.array().cast("array<int>").alias("pa"), F.inline(F.array(*bias))))
        return reduce(DataFrame.unionByName, parts)
