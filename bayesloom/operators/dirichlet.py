"""Dirichlet-process Gaussian mixtures of single columns by variational Bayes (M1).

Truncated stick-breaking: component j's share has a Beta(1 + N_j, γ + N_{j+1} + …) posterior; its mean and precision have a
normal-gamma posterior around the column's mean and variance. A step is one aggregation over the distinct values of all columns:
responsibilities under the current posterior and their sums, 3·k + 2 numbers a task and column, from which the next posterior and the evidence
lower bound follow. Tasks reckon with numpy on values packed once. A column stops when its bound, per row, changes by no more than ``tol``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


TINY = 10 * 2.220446049250313e-16
#: variance that a column of one value is given
FLOOR = 1e-6
#: distinct values that a task of a step takes
TASK_VALUES = 150_000


@dataclass
class Posterior:
    """One column's mixture: offsets (expected log share and the precision's terms), means, deviations, expected shares."""

    offset: list[float]
    mu: list[float]
    sigma: list[float]
    share: list[float]
    bound: float = -math.inf
    steps: int = 0
    converged: bool = False


def digamma(x: float) -> float:
    """ψ(x) for x > 0: the asymptotic series at x + 6, shifted back by six reciprocals."""
    z = x + 6.0
    r = 1.0 / (z * z)
    return math.log(z) - 0.5 / z - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r / 240))) - sum(1.0 / (x + i) for i in range(6))


def _packed(batches):
    """Rows (column, x, w) as blocks (column, bytes of the values, bytes of the counts), one per batch and column."""
    for batch in batches:
        column = batch.column(0)
        x, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        names = pc.unique(column)
        at = [pc.equal(column, c).to_numpy(zero_copy_only=False) for c in names]
        yield pa.RecordBatch.from_arrays([names, pa.array([x[i].tobytes() for i in at], pa.binary()), pa.array([w[i].tobytes() for i in at], pa.binary())],
                                         names=["column", "x", "w"])


def block_sums(x, w, m0: float, offset, mu, sigma):
    """n, entropy and n, x, q of every component of one block: responsibilities under the parameters, summed around the column's mean ``m0``
    (a common offset costs no digits)."""
    mu, sigma = np.array(mu)[:, None], np.array(sigma)[:, None]
    logs = np.array(offset)[:, None] - np.log(sigma) - ((x - mu) / sigma) ** 2 / 2
    logs -= logs.max(axis=0)
    r = np.exp(logs)
    total = r.sum(axis=0)
    r /= total
    entropy = (r * logs).sum(axis=0) - np.log(total)  # Σ r·ln r: a component's r may be 0, its logarithm stays finite
    r *= w
    dx = x - m0
    return np.concatenate([[w.sum(), w @ entropy], np.array([r.sum(axis=1), r @ dx, r @ (dx * dx)]).T.ravel()])


def step_sums(blocks: DataFrame, params: dict[str, tuple], k: int) -> dict[str, dict]:
    """The aggregation of one step for ``k`` components, column of ``params`` (mean, offsets, means, deviations) → its sums.

    One job without a shuffle or a join over the packed ``blocks``: the parameters go out with the tasks, a row per task and column comes back
    and the driver adds these up. Blocks of other columns are passed over.
    """
    names = ["n", "entropy", *[f"{v}{j}" for j in range(k) for v in "nxq"]]

    def run(batches):
        sums = {}
        for batch in batches:
            for c, x, w in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if c in params:
                    sums[c] = sums.get(c, 0.0) + block_sums(np.frombuffer(x.as_buffer()), np.frombuffer(w.as_buffer()), *params[c])
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
                                         names=["column", "sums"])

    parts: dict[str, list] = {}
    for r in blocks.mapInArrow(run, "column string, sums array<double>").collect():
        parts.setdefault(r["column"], []).append(r["sums"])
    return {c: dict(zip(names, map(math.fsum, zip(*rows)))) for c, rows in parts.items()}


def posterior(sums: dict, k: int, m0: float, v0: float, concentration: float, beta0: float) -> Posterior:
    """The next posterior and its bound from a column's sums."""
    n = [sums[f"n{j}"] + TINY for j in range(k)]
    xbar = [sums[f"x{j}"] / n[j] for j in range(k)]
    a, b = [1.0 + x for x in n], [concentration + math.fsum(n[j + 1:]) for j in range(k)]
    p = Posterior([], [], [], [])
    bound, behind, left = -sums["entropy"], 0.0, 1.0
    for j in range(k):
        beta, nu = beta0 + n[j], 1.0 + n[j]
        spread = max(sums[f"q{j}"] - n[j] * xbar[j] ** 2, 0.0)
        var = (v0 + spread + n[j] * beta0 / beta * xbar[j] ** 2) / nu
        both = digamma(a[j] + b[j])
        log_share = digamma(a[j]) - both + behind
        behind += digamma(b[j]) - both
        p.offset.append(log_share - math.log(nu) / 2 + (math.log(2.0) + digamma(nu / 2) - 1 / beta) / 2)
        p.mu.append(m0 + n[j] * xbar[j] / beta)
        p.sigma.append(math.sqrt(var))
        p.share.append(a[j] / (a[j] + b[j]) * left)
        left *= b[j] / (a[j] + b[j])
        bound += nu * (math.log(2.0) - math.log(var) - math.log(nu)) / 2 + math.lgamma(nu / 2) - math.log(beta) / 2
        bound += math.lgamma(a[j]) + math.lgamma(b[j]) - math.lgamma(a[j] + b[j])
    p.bound = bound
    return p


def variational_fit(compact: DataFrame, start: dict[str, tuple[list[float], float]], k: int, max_iter: int, tol: float,
                    concentration: float | None = None, mean_precision: float = 0.1) -> dict[str, Posterior]:
    """Posterior of every column of ``compact`` (column, x, w: distinct values and their counts).

    ``start``: column → (k means, common deviation) of equal components for the first responsibilities. The concentration is 1/k if not given.
    Columns that have stopped are not read any more.
    """
    from bayesloom.session import cached

    spark = compact.sparkSession
    concentration = 1.0 / k if concentration is None else concentration
    x, w = F.col("x"), F.col("w")
    base = compact.groupBy("column").agg(F.count(F.lit(1)).alias("d"), (F.sum(w * x) / F.sum(w)).alias("m")).collect()
    mean = {r["column"]: r["m"] for r in base}
    centred = compact.join(F.broadcast(spark.createDataFrame(list(mean.items()), "column string, m double")), "column") if mean else compact
    spread = {r["column"]: r["v"] for r in centred.groupBy("column").agg(
        (F.sum(w * F.pow(x - F.col("m"), 2)) / F.greatest(F.sum(w) - 1, F.lit(1.0))).alias("v")).collect()} if mean else {}
    out = {c: Posterior([math.log(1.0 / k)] * k, list(start[c][0]), [start[c][1]] * k, [1.0 / k] * k) for c in mean}
    tasks = max(1, -(-sum(r["d"] for r in base) // TASK_VALUES))  # a step is short: few tasks, however the table was dealt
    blocks = cached(compact.select("column", "x", "w").coalesce(tasks).mapInArrow(_packed, "column string, x binary, w binary"))
    for _ in range(max_iter):
        open_ = [c for c, p in out.items() if not p.converged]
        if not open_:
            break
        sums = step_sums(blocks, {c: (mean[c], out[c].offset, out[c].mu, out[c].sigma) for c in open_}, k)
        for c in open_:
            last, r = out[c], sums[c]
            out[c] = posterior(r, k, mean[c], max(spread[c], FLOOR), concentration, mean_precision)
            out[c].steps = last.steps + 1
            out[c].converged = abs(out[c].bound - last.bound) <= tol * r["n"]
    blocks.unpersist()
    return out
