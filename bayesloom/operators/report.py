"""Reporting (R1–R4) on long results (dataset, model, metric, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def format_results(results: DataFrame, metric: str | None = None) -> DataFrame:
    """One row per dataset, one column per model (for one metric) or per model_metric."""
    r = results if metric is None else results.filter(F.col("metric") == metric)
    key = F.col("model") if metric is not None else F.concat_ws("-", "model", "metric")
    cols = sorted(x[0] for x in r.select(key.alias("k")).distinct().collect())
    return r.withColumn("__k", key).groupBy("dataset").pivot("__k", cols).agg(F.first("value"))


def average_classifiers(results: DataFrame, classifiers=("lr", "mlp", "rf")) -> DataFrame:
    """R2: AVG metric per (dataset, model) over the classifier metrics, nulls skipped; unioned back."""
    avg = (results.filter(F.col("metric").isin(list(classifiers)))
           .groupBy("dataset", "model").agg(F.avg("value").alias("value"))
           .withColumn("metric", F.lit("avg")))
    base = results.filter(F.col("metric") != "avg")
    return base.unionByName(avg.select("dataset", "model", "metric", "value"))


def leaderboard(results: DataFrame, metric: str = "avg") -> DataFrame:
    """Models ranked per dataset by the metric (1 = best; ties share a rank)."""
    r = results.filter(F.col("metric") == metric)
    w = Window.partitionBy("dataset").orderBy(F.col("value").desc())
    return r.withColumn("rank", F.rank().over(w))


def metric_chart_data(results: DataFrame, metric: str) -> DataFrame:
    """The (dataset, model, value) series behind a bar chart of one metric."""
    return results.filter(F.col("metric") == metric).select("dataset", "model", "value").orderBy("dataset", "model")
