"""Evaluation (V1–V11): accuracy, train-on-synthetic / test-on-real, discriminator,
Gaussian NB BIC and multi-round runs. Classifiers are Spark ML estimators; any
``pyspark.ml`` Estimator (or a factory returning one) can be passed.
"""

from __future__ import annotations

import math
import time
from typing import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bayesloom.operators.encode import CategoryEncoder, align_columns, column_kinds, onehot


def accuracy(pred: DataFrame, pred_col: str = "pred", label: str = "target", weight: str | None = None) -> DataFrame:
    """V9: share of equal predictions among non-null predictions; 0.0 when nothing is predicted. ``weight``: column with the number
    of rows that a row stands for."""
    p = pred.filter(F.col(pred_col).isNotNull())
    hit = (F.col(pred_col) == F.col(label)).cast("double")
    if weight:
        w, known = F.col(weight), F.col(label).isNotNull()  # a row without a label is predicted, but neither right nor wrong
        return p.agg(F.coalesce(F.sum(w * hit) / F.sum(F.when(known, w)), F.lit(0.0)).alias("accuracy"), F.coalesce(F.sum(w), F.lit(0)).cast("long").alias("n_predicted"))
    return p.agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"), F.count(F.lit(1)).alias("n_predicted"))


def gaussian_nb_bic(model, df: DataFrame) -> DataFrame:
    """BIC = −2·Σ ln P(true class | x) + k·ln N with k = C·2d + (C − 1); lower is better."""
    C, d = len(model.classes), len(model.features)
    jll = model.joint_log_likelihood()
    t = df.withColumn("__j", jll)
    mx = F.array_max("__j")
    lse = mx + F.log(F.aggregate(F.transform("__j", lambda v: F.exp(v - mx)), F.lit(0.0), lambda a, b: a + b))
    pos = F.array_position(F.array(*[F.lit(c) for c in model.classes]), F.col(model.label))
    t = t.withColumn("__lp", F.element_at("__j", pos.cast("int")) - lse)
    k = C * 2 * d + (C - 1)
    return t.agg((F.lit(-2.0) * F.sum("__lp") + F.lit(k) * F.log(F.count(F.lit(1)).cast("double"))).alias("bic"))


# ---------------------------------------------------------------- classifiers (V2–V5)


def classifier(name: str, n_classes: int, n_features: int, n_rows: int | None = None, seed: int = 42, trees: int = 100):
    """Spark ML stand-ins of the reference's classifiers (``trees``: of rf and xgb)."""
    from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                           OneVsRest, RandomForestClassifier)
    if name == "lr":
        # sklearn C = 1 on the summed loss ⇔ Spark's mean loss with regParam = 1/n
        reg = 1.0 / n_rows if n_rows else 0.0
        return LogisticRegression(maxIter=1000, regParam=reg, elasticNetParam=0.0, standardization=False, family="multinomial")
    if name == "mlp":
        return MultilayerPerceptronClassifier(layers=[n_features, 100, n_classes], maxIter=500, seed=seed)
    if name == "rf":
        return RandomForestClassifier(numTrees=trees, maxDepth=30, seed=seed)
    if name == "xgb":
        gbt = GBTClassifier(maxIter=trees, stepSize=0.1, seed=seed)
        return gbt if n_classes <= 2 else OneVsRest(classifier=gbt)
    raise ValueError(f"unknown classifier {name!r}")


class MapClassifier:
    """A Bayesian network as a classifier for ``tstr``: CPTs of coded columns by counting (G1), the most probable label.

    ``structure``: from (features, label) to edges, the naive one by default. Rows without a possible label get no prediction,
    which ``tstr`` counts as wrong. A column ``__w`` has the number of rows that a row stands for.
    """

    def __init__(self, structure: Callable | None = None):
        self.structure = structure

    def fit(self, df: DataFrame) -> "MapClassifier":
        from bayesloom.operators.cpt import fit_cpts
        from bayesloom.operators.structure import naive_structure

        self.features = [c for c in df.columns if c not in ("label", "features", "__w")]
        self.nodes = self.features + ["label"]
        weight = "__w" if "__w" in df.columns else None
        coded = df.select(*[F.col(f"`{c}`").cast("int").alias(c) for c in self.nodes], *([weight] if weight else []))
        top = coded.agg(*[F.max(f"`{c}`").alias(f"m{i}") for i, c in enumerate(self.nodes)]).first()
        self.cards = {c: (-1 if top[i] is None else top[i]) + 1 for i, c in enumerate(self.nodes)}
        self.edges = (self.structure or naive_structure)(self.features, "label")
        self.cpts = fit_cpts(coded, self.edges, self.nodes, weight)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the double column ``prediction``."""
        from bayesloom.operators.predict import bn_map_predict

        if not self.cards["label"]:
            return df.withColumn("prediction", F.lit(None).cast("double"))
        hidden = df.withColumnRenamed("label", "__label") if "label" in df.columns else df
        out = bn_map_predict(hidden, self.cpts, self.edges, self.nodes, "label", self.cards, "prediction")
        return out.withColumn("prediction", F.col("prediction").cast("double")).withColumnRenamed("__label", "label")


def held_out(train: DataFrame, parts: int = 10, chunk: int = 10_000) -> DataFrame:
    """(features, label, part 0 … parts − 1) of every row. Equal rows are counted, numbered ``chunk`` at a time and dealt in turn from a place that
    is a hash of their values, so a part has its share of each and doesn't depend on the partitioning."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    counted = train.groupBy(vector_to_array("features").alias("a"), "label").agg(F.count(F.lit(1)).alias("n"))
    pieces = counted.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / chunk))))
    numbers = F.sequence(F.col("piece") * chunk, F.least((F.col("piece") + 1) * chunk, F.col("n")) - 1)
    part = F.pmod(F.xxhash64("a", "label") + F.col("number"), F.lit(parts))
    return pieces.withColumn("number", F.explode(numbers)).select(array_to_vector("a").alias("features"), "label", part.alias("part"))


def fit_perceptron(estimator, train: DataFrame, block: int = 10, tol: float = 1e-4, patience: int = 2):
    """V3: a multilayer perceptron with early stopping. A tenth of the rows (``held_out``) is held out; the fit goes on in
    blocks of ``block`` iterations from the last weights until ``patience`` blocks in a row don't raise the held-out accuracy by ``tol``,
    or the estimator's own ``maxIter`` is reached. The best model is returned; without held-out rows, that of a plain fit."""
    rows = held_out(train).persist()
    fit_on, held = rows.filter("part > 0").drop("part"), rows.filter("part = 0").drop("part")
    if held.isEmpty() or fit_on.isEmpty():
        rows.unpersist()
        return estimator.fit(train)
    best, best_model, bad, done, weights = -1.0, None, 0, 0, None
    while done < estimator.getMaxIter() and bad < patience:
        step = estimator.copy().setMaxIter(min(block, estimator.getMaxIter() - done))
        model = (step.setInitialWeights(weights) if weights is not None else step).fit(fit_on)
        weights, done = model.weights, done + block
        acc = model.transform(held).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        bad = 0 if acc > best + tol else bad + 1
        if acc > best:
            best, best_model = acc, model
    rows.unpersist()
    return best_model


def number_cells(real: DataFrame, columns: Sequence[str], most: int = 256) -> dict[str, list[float]]:
    """Ascending cells of numeric columns: a column's values if it has ``most`` at most, else that many of its quantiles. A
    sketch of all columns decides which; what reaches the driver is at most ``most`` numbers a column."""
    if not columns:
        return {}
    x = {c: F.col(f"`{c}`").cast("double") for c in columns}
    sizes = real.agg(*[F.approx_count_distinct(x[c], 0.02).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    few = [c for i, c in enumerate(columns) if sizes[f"d{i}"] <= 0.9 * most]
    many, cells = [c for c in columns if c not in few], {}
    if many:
        at = [(j + 0.5) / most for j in range(most)]
        row = real.agg(*[F.percentile_approx(x[c], at, 10_000).alias(f"q{i}") for i, c in enumerate(many)]).first()
        cells = {c: sorted(set(row[f"q{i}"] or [])) for i, c in enumerate(many)}
    if few:
        pairs = real.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), x[c].alias("v")) for c in few]))).filter("v is not null").distinct()
        exact: dict = {c: [] for c in few}
        for r in pairs.collect():  # the sketch is within a few hundredths of the number
            exact[r["c"]].append(r["v"])
        cells.update({c: sorted(v) for c, v in exact.items()})
    return cells


def to_cells(df: DataFrame, cells: dict[str, list[float]]) -> DataFrame:
    """Numbers replaced by the place of the nearest cell (the upper one half way); nulls stay null."""
    from bayesloom.operators.sample import count_below

    for c, values in cells.items():
        x = F.col(f"`{c}`")
        if len(values) > 1:
            middles = F.array(*[F.lit((a + b) / 2) for a, b in zip(values, values[1:])])
            df = count_below(df, middles, x.cast("double"), len(values) - 1, "__cell")
        else:
            df = df.withColumn("__cell", F.lit(0))
        df = df.withColumn(c, F.when(x.isNotNull(), F.col("__cell")).cast("int")).drop("__cell")
    return df


def tstr(syn: DataFrame, test: DataFrame, target: str = "target", classifiers: Sequence = ("lr", "mlp", "rf"),
         seed: int = 42) -> dict:
    """V1: align columns, one-hot on the union categories, train on synthetic, accuracy on real.

    Numbers go to the nearest of the real table's cells first (``number_cells``), so that a continuous sample takes no more slots than the real
    table's values.

    ``classifiers``: names, ML estimators, classes or factories of them, or (name, one of those). Returns {classifier: accuracy or None
    (failure, with its message under '<classifier> error')} plus 'avg' over the non-null ones.
    """
    tables = TstrTables(syn, test, target)
    out = tables.evaluate(classifiers, seed)
    tables.release()
    return out


class TstrTables:
    """What ``tstr`` reads of a sample and of the test rows, whatever the classifier and the seed: each table is read once into its distinct rows,
    in cells, with their number (``__w``), and all else follows from these."""

    def __init__(self, syn: DataFrame, test: DataFrame, target: str = "target"):
        from bayesloom.session import cached

        syn, test = align_columns(syn, test)
        self.feats = feats = [c for c in test.columns if c != target]
        cells = number_cells(test, column_kinds(test.select(*feats))[0])
        label = F.col(target).cast("double").alias("label")
        self.syn, test = (to_cells(df, cells).select(*feats, label) for df in (syn, test))
        counted = [cached(df.groupBy(*feats, "label").agg(F.count(F.lit(1)).cast("double").alias("__w"))) for df in (self.syn, test)]
        self.enc = CategoryEncoder.fit(counted[0].select(*feats).unionByName(counted[1].select(*feats)), feats)
        self.n_feat = sum(self.enc.card(c) for c in feats)
        sums = [df.agg(F.sum("__w"), F.max("label")).first() for df in counted]
        tops = [r[1] for r in sums if r[1] is not None]
        self.n_rows, self.n_classes = int(sums[0][0] or 0), int(max(tops)) + 1 if tops else 2
        self.train, self.test = (onehot(df, feats, self.enc).persist() for df in counted)
        self.kept = [*counted, self.train, self.test]

    def every_row(self) -> DataFrame:
        return onehot(self.syn, self.feats, self.enc)

    def evaluate(self, classifiers: Sequence, seed: int = 42) -> dict:
        out = {}
        for c in classifiers:
            name, c = c if isinstance(c, tuple) else (c if isinstance(c, str) else type(c).__name__, c)
            try:
                est = classifier(c, self.n_classes, self.n_feat, self.n_rows, seed) if isinstance(c, str) else (
                    c() if isinstance(c, type) or not hasattr(c, "fit") else c)
                # distinct rows with their number: the same objective over far fewer rows. Forests draw rows and the perceptron takes no
                # weights: those see every row
                if c == "mlp":
                    model = fit_perceptron(est, self.every_row())
                elif c in ("lr", "xgb"):
                    model = est.setWeightCol("__w").fit(self.train)
                else:
                    model = est.fit(self.train if isinstance(est, MapClassifier) else self.every_row())
                hit = (F.col("prediction") == F.col("label")).cast("double")
                acc = model.transform(self.test).agg(F.sum(hit * F.col("__w")) / F.sum("__w")).first()[0]
                out[name] = float(acc) if acc is not None else 0.0
            except Exception as e:  # noqa: BLE001 - a failing classifier is reported as null, as in the reference
                out[name] = None
                out[f"{name} error"] = f"{type(e).__name__}: {e}"[:300]
        vals = [v for v in out.values() if isinstance(v, float)]
        out["avg"] = sum(vals) / len(vals) if vals else None
        return out

    def release(self) -> None:
        for df in self.kept:
            df.unpersist()


def discriminators(real: DataFrame, samples: DataFrame, features: Sequence[str], group: str, frac: float = 0.8, seed: int = 42,
                   key: str = "row_key", sample_key: str = "row_id", steps: int = 12) -> dict:
    """V7 for many samples at once: a logistic real-vs-synthetic model per value of ``group`` in ``samples``.

    Rows whose uniform of (group, key, real or not, ``seed``) is below ``frac`` are trained on. Features are standardised over them;
    ``steps`` full-batch gradient steps of 4 / (features + 1), a rate at which the loss can't rise, start at zero weights. Each
    step is one aggregation over the distinct rows of all groups, whatever their number; weights travel as a table of one row per
    group. Returns group → {"ls": training accuracy, "p_real": mean probability of the real rows}.
    """
    from bayesloom.functions import hash_uniform
    from bayesloom.session import cached

    spark, d = real.sparkSession, len(features)
    groups = samples.select(group).distinct()
    names = [f"__x{i}" for i in range(d)]
    values = [F.col(f).cast("double").alias(x) for f, x in zip(features, names)]
    # the real rows stand once; each group has its own draw of them
    stacked = (real.select(F.col(key).cast("string").alias("__k"), F.lit(1.0).alias("__y"), *values,
                           F.explode(F.array(*[F.lit(r[0]) for r in groups.collect()])).alias("__g"))
               .unionByName(samples.select(F.col(sample_key).cast("string").alias("__k"), F.lit(0.0).alias("__y"), *values, F.col(group).alias("__g"))))
    drawn = hash_uniform(F.col("__g").cast("string"), F.col("__k"), F.col("__y").cast("int").cast("string"), F.lit(str(seed))) < frac
    kind = stacked.schema["__g"].dataType
    rows = cached(stacked.groupBy("__g", "__y", *names).agg(F.sum(drawn.cast("double")).alias("__w"), F.count(F.lit(1)).cast("double").alias("__n")))
    w = F.col("__w")
    stats = rows.groupBy("__g").agg(F.sum(w).alias("n"), *[F.sum(w * F.col(x)).alias(f"s{i}") for i, x in enumerate(names)],
                                    *[F.sum(w * F.col(x) * F.col(x)).alias(f"q{i}") for i, x in enumerate(names)]).collect()
    model = {}
    for r in stats:
        n = r["n"] or 1.0
        mean = [(r[f"s{i}"] or 0.0) / n for i in range(d)]
        sd = [math.sqrt(max((r[f"q{i}"] or 0.0) / n - mean[i] ** 2, 0.0)) for i in range(d)]
        model[r["__g"]] = {"n": n, "mean": mean, "scale": [1 / s if s > 1e-9 else 0.0 for s in sd], "w": [0.0] * (d + 1)}

    def with_probability() -> DataFrame:
        table = spark.createDataFrame([(g, m["mean"], m["scale"], m["w"]) for g, m in model.items()],
                                      T.StructType([T.StructField("__h", kind), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("__m", "__s", "__b")]]))
        z = [((F.col(x) - F.get("__m", i)) * F.get("__s", i)).alias(f"__z{i}") for i, x in enumerate(names)]
        t = rows.join(F.broadcast(table), F.col("__g") == F.col("__h")).select("*", *z)
        logit = F.get("__b", d)
        for i in range(d):
            logit = logit + F.get("__b", i) * F.col(f"__z{i}")
        return t.withColumn("__l", logit).withColumn("__p", 1 / (1 + F.exp(-F.col("__l"))))

    for _ in range(steps):
        error = F.col("__w") * (F.col("__y") - F.col("__p"))
        got = with_probability().groupBy("__g").agg(*[F.sum(error * F.col(f"__z{i}")).alias(f"g{i}") for i in range(d)], F.sum(error).alias(f"g{d}")).collect()
        for r in got:
            m = model[r["__g"]]
            m["w"] = [b + 4.0 / (d + 1) * (r[f"g{i}"] or 0.0) / m["n"] for i, b in enumerate(m["w"])]
    hit = ((F.round("__l", 9) > 0) == (F.col("__y") == 1.0)).cast("double")
    real_n = F.when(F.col("__y") == 1.0, F.col("__n"))
    out = with_probability().groupBy("__g").agg((F.sum(w * hit) / F.sum(w)).alias("ls"), (F.sum(real_n * F.col("__p")) / F.sum(real_n)).alias("p")).collect()
    rows.unpersist()
    return {r["__g"]: {"ls": float(r["ls"] or 0.0), "p_real": float(r["p"] or 0.0)} for r in out}


def discriminator(real: DataFrame, syn: DataFrame, features: Sequence[str], frac: float = 0.8, seed: int = 42,
                  key: str = "row_key", steps: int = 12) -> dict:
    """V7: the logistic real-vs-synthetic model of one sample (first column: its key); training accuracy ``ls`` and the mean P(real) of
    the real rows."""
    got = discriminators(real, syn.withColumn("__one", F.lit(0)), features, "__one", frac, seed, key, syn.columns[0], steps)
    return got.get(0, {"ls": 0.0, "p_real": 0.0})


def evaluate_model(sample_fn: Callable[[int, int], DataFrame], test: DataFrame, target: str, n: int,
                   classifiers=("lr", "mlp", "rf"), seed: int = 42) -> dict:
    """V6: sample ``n`` rows from a fitted model and run TSTR against ``test``."""
    syn = sample_fn(n, seed)
    return tstr(syn, test, target, classifiers, seed)


def multi_round(spark, datasets: dict, models: dict, rounds: int = 3, seed: int = 42,
                classifiers=("lr", "mlp", "rf")) -> DataFrame:
    """Generate once per (dataset, model) (persisted), evaluate each round with
    seed + round; long results (dataset, round, model, metric, value) incl. seconds.

    ``datasets``: name → (train, test, target); ``models``: name → fit(train, target) returning
    an object with ``sample(n, seed)``.
    """
    rows = []
    for dname, (train, test, target) in datasets.items():
        n = train.count()
        for mname, fit in models.items():
            try:
                model = fit(train, target)
                syn = model.sample(n, seed)
                syn = (syn.drop("row_id") if "row_id" in syn.columns else syn).persist()
                syn.count()
            except Exception as e:  # noqa: BLE001 - a failing model has null results, with the reason beside them
                rows += [(dname, r, mname, "avg", None, f"{type(e).__name__}: {e}"[:300]) for r in range(rounds)]
                continue
            t0 = time.time()
            tables = TstrTables(syn, test, target)  # the same in every round; their time is the first one's
            for r in range(rounds):
                res = tables.evaluate(classifiers, seed + r)
                secs, t0 = time.time() - t0, time.time()
                rows += [(dname, r, mname, k, v, None) for k, v in res.items() if not isinstance(v, str)]
                rows += [(dname, r, mname, k, None, v) for k, v in res.items() if isinstance(v, str)]
                rows.append((dname, r, mname, "seconds", secs, None))
            tables.release()
            syn.unpersist()
    return spark.createDataFrame(rows, "dataset string, round int, model string, metric string, value double, error string")


def mean_over_rounds(results: DataFrame) -> DataFrame:
    """Mean per (dataset, model, metric) = Σ non-null values / number of rounds run."""
    rounds = F.countDistinct("round")
    return results.groupBy("dataset", "model", "metric").agg((F.sum("value") / rounds).alias("value"))
