"""Variational mixture against a plain numpy recomputation, its bound, empty and constant columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bayesloom.operators.dirichlet import digamma, variational_fit
from bayesloom.operators.discretise import MixtureDiscretiser


def plain_step(x, offset, mu, sigma, gamma, beta0):
    log = offset - np.log(sigma) - 0.5 * ((x[:, None] - mu) / sigma) ** 2
    r = np.exp(log - log.max(1, keepdims=True))
    r /= r.sum(1, keepdims=True)
    n = r.sum(0) + 2.220446049250313e-15
    mean = (r * x[:, None]).sum(0) / n
    var = (r * (x[:, None] - mean) ** 2).sum(0)
    m0, v0 = x.mean(), x.var(ddof=1)
    beta, nu = beta0 + n, 1 + n
    a, b = 1 + n, gamma + np.concatenate([np.cumsum(n[::-1])[::-1][1:], [0]])
    psi = np.vectorize(digamma)
    stick, rest = psi(a) - psi(a + b), psi(b) - psi(a + b)
    new_mu = (beta0 * m0 + n * mean) / beta
    new_var = (v0 + var + n * beta0 / beta * (mean - m0) ** 2) / nu
    new_offset = stick + np.concatenate([[0], np.cumsum(rest)[:-1]]) - np.log(nu) / 2 + 0.5 * (math.log(2) + psi(nu / 2) - 1 / beta)
    return new_offset, new_mu, np.sqrt(new_var)


def test_digamma():
    assert digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-9)
    assert digamma(0.5) == pytest.approx(-1.9635100260214235, abs=1e-9)
    assert digamma(10.0) - digamma(9.0) == pytest.approx(1 / 9)


def test_steps_equal_numpy_and_the_bound_rises(spark):
    rng = np.random.default_rng(2)
    x = np.round(np.concatenate([rng.normal(0.2, 0.05, 300), rng.normal(0.7, 0.1, 200)]), 2)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").groupBy("x").agg(F.count("*").cast("double").alias("w")).select(F.lit("c").alias("column"), "x", "w").persist()
    start = ([0.1, 0.4, 0.8], 0.1)
    offset, mu, sigma = np.log(np.full(3, 1 / 3)), np.array(start[0]), np.full(3, 0.1)
    bounds = []
    for steps in range(1, 6):
        offset, mu, sigma = plain_step(x, offset, mu, sigma, 1 / 3, 0.1)
        p = variational_fit(df, {"c": start}, 3, steps, 0.0)["c"]
        assert p.offset == pytest.approx(offset.tolist()) and p.mu == pytest.approx(mu.tolist()) and p.sigma == pytest.approx(sigma.tolist())
        assert p.steps == steps and not p.converged
        bounds.append(p.bound)
    assert all(b >= a - 1e-6 for a, b in zip(bounds, bounds[1:]))
    assert sum(p.share) <= 1.0


def test_unused_components_go_and_odd_columns_stand(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), 4.0, None) for a in np.concatenate([rng.normal(0, 1, 300), rng.normal(12, 1, 300)])]
    df = spark.createDataFrame(rows, "x double, flat double, none double")
    m = MixtureDiscretiser.fit(df, ["x", "flat", "none"], k=6, max_iter=60)
    assert 2 <= len(m.mu["x"]) <= 6 and m.mu["x"] == sorted(m.mu["x"]) and sum(m.weights["x"]) == pytest.approx(1.0)
    assert len(m.mu["flat"]) == 1 and m.mu["none"] == [0.0] and m.ends["x"][1] <= 60
    codes = m.transform(df).agg(F.min("x"), F.max("x"), F.count("none"), F.countDistinct("flat")).first()
    assert 0 <= codes[0] and codes[1] < 8 * len(m.mu["x"]) and codes[2] == 0 and codes[3] == 1
    assert set(m.transform(df).select((F.col("x") / 8).cast("int")).distinct().toPandas().iloc[:, 0]) == set(range(len(m.mu["x"])))


def test_a_step_is_one_job_of_as_many_tasks_as_values_need(spark):
    """However many partitions the compacted table has: 64 here, of a thousand values in all."""
    df = spark.range(0, 1000, 1, 64).select(F.lit("c").alias("column"), (F.col("id") / 1000).alias("x"), F.lit(2.0).alias("w"))

    def tasks(steps: int) -> int:
        spark.sparkContext.setJobGroup(f"steps-{steps}", "")
        assert variational_fit(df, {"c": ([0.2, 0.5, 0.7], 0.1)}, 3, steps, 0.0)["c"].steps == steps
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        seen = spark.sparkContext.statusTracker()
        stages = [seen.getStageInfo(s) for j in seen.getJobIdsForGroup(f"steps-{steps}") for s in seen.getJobInfo(j).stageIds]
        return sum(s.numTasks for s in stages if s is not None)

    assert tasks(7) - tasks(3) == 4
