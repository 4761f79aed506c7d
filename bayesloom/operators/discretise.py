"""Discretisers: equal-width bins (P5), preprocessing (P6) and the Gaussian-mixture
discretiser (M1–M5).

Fitting reads one aggregate row per pass (min/max, or EM sufficient statistics);
transforms are narrow projections with the fitted constants inlined as literals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayesloom.functions import hash_uniform, probit
from bayesloom.operators.encode import CategoryEncoder, MinMaxScaler, column_kinds


@dataclass
class UniformBins:
    """P5: ``n_bins`` equal-width bins between the column's min and max.

    Edges are min + i·((max − min)/n_bins); a value equal to an inner edge goes to the
    upper bin, the maximum goes to the last bin, a constant column is all bin 0.
    Standardising before binning (as the reference does) is affine and gives the same bins.
    """

    columns: list[str]
    n_bins: int = 5
    edges: dict[str, list[float]] = field(default_factory=dict)

    @staticmethod
    def stat_aggs(columns: list[str]) -> list:
        aggs = []
        for c in columns:
            aggs += [F.min(F.col(c).cast("double")).alias(f"lo_{c}"), F.max(F.col(c).cast("double")).alias(f"hi_{c}")]
        return aggs

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], n_bins: int = 5, stats=None) -> "UniformBins":
        """``stats``: a row holding lo_<c>/hi_<c> from an aggregation the caller already ran."""
        row = stats if stats is not None else df.agg(*cls.stat_aggs(columns)).first()
        edges = {}
        for c in columns:
            lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
            if lo is None or hi is None or lo == hi:
                edges[c] = []
            else:
                step = (hi - lo) / n_bins
                edges[c] = [lo + i * step for i in range(1, n_bins)]
        return cls(list(columns), n_bins, edges)

    def bin_expr(self, c: str, src: Column | None = None) -> Column:
        x = (src if src is not None else F.col(c)).cast("double")
        e = self.edges[c]
        if not e:
            return F.when(x.isNull(), None).otherwise(F.lit(0)).cast("int")
        total = None
        for edge in e:
            term = (x >= F.lit(edge)).cast("int")
            total = term if total is None else total + term
        return total.cast("int")

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns({c + suffix: self.bin_expr(c) for c in self.columns})


@dataclass
class Preprocessor:
    """Numeric columns → P5 bins, other columns and a string label → P1 codes, and the split into train and test rows.

    Column order afterwards: key, numeric features, categorical features, label. ``split`` is the whole call: bins and dictionaries
    fitted on the whole table, every row coded, and per class exactly ceil(``test_frac`` · n) rows marked as test rows (P7).
    """

    key: str
    label: str
    numeric: list[str]
    categorical: list[str]
    bins: UniformBins
    encoder: CategoryEncoder

    @classmethod
    def fit(cls, df: DataFrame, label: str, key: str = "row_key", n_bins: int = 5) -> "Preprocessor":
        feats = df.drop(key, label)
        num, cat = column_kinds(feats)
        label_is_num = dict(df.dtypes)[label] not in ("string",)
        enc_cols = cat + ([] if label_is_num else [label])
        return cls(key, label, num, cat, UniformBins.fit(df, num, n_bins), CategoryEncoder.fit(df, enc_cols))

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.encoder.transform(self.bins.transform(df))
        return out.select(self.key, *self.numeric, *self.categorical, F.col(self.label).cast("int").alias(self.label))

    @classmethod
    def split(cls, df: DataFrame, label: str, key: str = "row_key", n_bins: int = 5, test_frac: float = 0.2,
              seed: int = 42) -> tuple["Preprocessor", DataFrame, DataFrame]:
        """(fitted preprocessor, train rows, test rows)."""
        from bayesloom.operators.select import stratified_split

        fitted = cls.fit(df, label, key, n_bins)
        rows = stratified_split(fitted.transform(df), label, key, test_frac, seed)
        return fitted, rows.filter(~F.col("is_test")).drop("is_test"), rows.filter("is_test").drop("is_test")


# ---------------------------------------------------------------- mixture discretiser

# Z-score bin boundaries of the mixture discretiser (8 bins per mode).
Z_EDGES = [-3.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0]
BINS_PER_MODE = 8


def _phi(z: float) -> float:
    return 0.5 * (1.0 + math.erf(z / math.sqrt(2.0)))


@dataclass
class MixtureDiscretiser:
    """M1–M5: per column a Gaussian mixture on min-max-scaled values.

    Fit (M1) runs on the *compacted* columns (distinct value, count), one aggregation per step over all columns at once:
    ``method="dirichlet"`` is a Dirichlet-process mixture by variational Bayes (:mod:`bayesloom.operators.dirichlet`), which keeps the
    components that are the most likely one of some value; ``method="em"`` is plain EM, which drops components whose weight falls
    under ``prune``. Modes are numbered 0..m−1 by mean. code = 8·mode + z-bin (M3); decode (M4) draws a truncated normal
    inside the bin with a hash uniform (M5) and un-scales. ``converged`` and ``steps`` tell how each column's fit ended.
    """

    columns: list[str]
    scaler: MinMaxScaler
    weights: dict[str, list[float]] = field(default_factory=dict)
    mu: dict[str, list[float]] = field(default_factory=dict)
    sigma: dict[str, list[float]] = field(default_factory=dict)
    converged: bool = True
    offsets: dict[str, list[float]] = field(default_factory=dict)
    ends: dict[str, tuple[bool, int]] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], k: int = 10, max_iter: int = 1500, tol: float = 1e-5,
            prune: float = 1e-3, reg: float = 1e-6, method: str = "dirichlet", mean_precision: float = 0.1) -> "MixtureDiscretiser":
        from bayesloom.session import cached

        scaler = MinMaxScaler.fit(df, columns)
        scaled = scaler.transform(df.select(*columns))
        stack = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
        compact = (scaled.select(F.expr(f"stack({len(columns)}, {stack}) as (column, x)"))
                   .filter(F.col("x").isNotNull())
                   .groupBy("column", "x").agg(F.count(F.lit(1)).cast("double").alias("w")))
        compact = cached(compact)
        # init: means at evenly spaced quantiles of the rows, equal weights, common sigma
        qs = [(i + 0.5) / k for i in range(k)]
        start = scaled.agg(*[F.percentile_approx(F.col(c).cast("double"), qs, 10000).alias(c) for c in columns]).first()
        init = compact.groupBy("column").agg(
            (F.sqrt(F.sum(F.col("w") * F.col("x") * F.col("x")) / F.sum("w")
                    - F.pow(F.sum(F.col("w") * F.col("x")) / F.sum("w"), 2))).alias("s")).collect()
        w = {r["column"]: [1.0 / k] * k for r in init}
        mu = {r["column"]: [float(v) for v in start[r["column"]]] for r in init}
        sg = {r["column"]: [max((r["s"] or 0.0) / k, 1e-3)] * k for r in init}
        if method == "dirichlet":
            out = cls._dirichlet(compact, columns, scaler, mu, sg, k, max_iter, tol, mean_precision)
            compact.unpersist()
            return out
        prev_ll, converged, exprs = None, False, cls._em_exprs(k)
        for _ in range(max_iter):
            stats, ll = cls._em_step(compact, columns, w, mu, sg, k, exprs)
            for c in columns:
                if c not in stats:
                    continue
                n_j, sx, sxx, tot = stats[c]
                for j in range(k):
                    if n_j[j] <= 1e-12:
                        w[c][j] = 0.0
                        continue
                    w[c][j] = n_j[j] / tot
                    mu[c][j] = sx[j] / n_j[j]
                    var = max(sxx[j] / n_j[j] - mu[c][j] ** 2, 0.0) + reg
                    sg[c][j] = math.sqrt(var)
            if prev_ll is not None and abs(ll - prev_ll) <= tol * max(1.0, abs(prev_ll)):
                converged = True
                break
            prev_ll = ll
        compact.unpersist()
        weights, mus, sigmas = {}, {}, {}
        for c in columns:
            if c not in w:
                weights[c], mus[c], sigmas[c] = [1.0], [0.0], [1.0]
                continue
            keep = sorted([j for j in range(k) if w[c][j] >= prune], key=lambda j: mu[c][j])
            tot = sum(w[c][j] for j in keep)
            weights[c] = [w[c][j] / tot for j in keep]
            mus[c] = [mu[c][j] for j in keep]
            sigmas[c] = [sg[c][j] for j in keep]
        return cls(list(columns), scaler, weights, mus, sigmas, converged)

    @classmethod
    def _dirichlet(cls, compact, columns, scaler, mu, sg, k, max_iter, tol, mean_precision) -> "MixtureDiscretiser":
        from bayesloom.operators.dirichlet import variational_fit

        post = variational_fit(compact, {c: (mu[c], sg[c][0]) for c in mu}, k, max_iter, tol, mean_precision=mean_precision)
        whole = cls(list(columns), scaler, {c: p.share for c, p in post.items()}, {c: p.mu for c, p in post.items()},
                    {c: p.sigma for c, p in post.items()}, offsets={c: p.offset for c, p in post.items()})
        used = None  # modes that some value falls to
        for c in post:
            part = compact.filter(F.col("column") == c).select(F.lit(c).alias("c"), whole.mode_expr(c, F.col("x")).alias("j"))
            used = part if used is None else used.unionByName(part)
        kept: dict[str, list[int]] = {}
        for r in (used.distinct().collect() if used is not None else []):
            kept.setdefault(r["c"], []).append(r["j"])
        out = cls(list(columns), scaler, converged=all(p.converged for p in post.values()),
                  ends={c: (p.converged, p.steps) for c, p in post.items()})
        for c in columns:
            if c not in post:  # no value at all
                out.weights[c], out.mu[c], out.sigma[c], out.offsets[c] = [1.0], [0.0], [1.0], [0.0]
                continue
            p, keep = post[c], sorted(kept[c], key=lambda j: (post[c].mu[j], j))
            total = sum(p.share[j] for j in keep)
            out.weights[c] = [p.share[j] / total for j in keep]
            out.mu[c], out.sigma[c], out.offsets[c] = ([values[j] for j in keep] for values in (p.mu, p.sigma, p.offset))
        return out

    @staticmethod
    def _log_dens(x: Column, offset: float, mj: float, sj: float) -> Column:
        return F.lit(offset - math.log(sj)) - F.pow((x - F.lit(mj)) / F.lit(sj), 2) / 2

    @classmethod
    def _em_exprs(cls, k: int):
        """Column expressions of one E+M pass, built once per fit: they read the
        parameters from columns, so they are the same in every iteration."""
        x = F.col("x")
        half_ln_2pi = 0.5 * math.log(2 * math.pi)
        logs = [(F.get(F.col("lw"), j) - F.log(F.get(F.col("sg"), j)) - F.lit(half_ln_2pi)
                 - F.pow((x - F.get(F.col("mu"), j)) / F.get(F.col("sg"), j), 2) / 2).alias(f"__l{j}") for j in range(k)]
        mx = (F.greatest(*[F.col(f"__l{j}") for j in range(k)]) if k > 1 else F.col("__l0")).alias("__m")
        exps = [F.exp(F.col(f"__l{j}") - F.col("__m")).alias(f"__e{j}") for j in range(k)]
        total = F.col("__e0")
        for j in range(1, k):
            total = total + F.col(f"__e{j}")
        aggs = [F.sum("w").alias("tot"), F.sum(F.col("w") * (F.col("__m") + F.log("__s"))).alias("ll")]
        for j in range(k):
            r = F.col("w") * F.col(f"__e{j}") / F.col("__s")
            aggs += [F.sum(r).alias(f"n{j}"), F.sum(r * x).alias(f"sx{j}"), F.sum(r * x * x).alias(f"sxx{j}")]
        return logs, mx, exps, total.alias("__s"), aggs

    @classmethod
    def _em_step(cls, compact: DataFrame, columns, w, mu, sg, k, exprs=None):
        """One E+M pass as one aggregation. The parameters travel as a small broadcast
        table (column → arrays), not as literals, so the generated code is identical in
        every iteration and compiled once."""
        spark = compact.sparkSession
        rows = []
        for c in columns:
            if c not in w:
                continue
            lw = [math.log(w[c][j]) if w[c][j] > 0 else -1e300 for j in range(k)]
            rows.append((c, lw, [float(v) for v in mu[c]], [float(max(v, 1e-12)) for v in sg[c]]))
        params = F.broadcast(spark.createDataFrame(rows, "column string, lw array<double>, mu array<double>, sg array<double>"))
        logs, mx, exps, total, aggs = exprs or cls._em_exprs(k)
        d = compact.join(params, "column").select("column", "x", "w", *logs)
        d = d.select("column", "x", "w", *[F.col(f"__l{j}") for j in range(k)], mx)
        d = d.select("column", "x", "w", "__m", *exps).select("*", total)
        rows = d.groupBy("column").agg(*aggs).collect()
        stats, ll = {}, 0.0
        for r in rows:
            stats[r["column"]] = ([r[f"n{j}"] for j in range(k)], [r[f"sx{j}"] for j in range(k)],
                                  [r[f"sxx{j}"] for j in range(k)], r["tot"])
            ll += r["ll"]
        return stats, ll

    def mode_expr(self, c: str, x: Column) -> Column:
        """M2: most likely mode of a scaled value."""
        ws, ms, ss = self.weights[c], self.mu[c], self.sigma[c]
        if len(ws) == 1:
            return F.lit(0)
        offsets = self.offsets.get(c) or [math.log(w) if w > 0 else -1e300 for w in ws]
        arr = F.array(*[self._log_dens(x, offsets[j], ms[j], ss[j]) for j in range(len(ws))])
        return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """M2+M3: value → 8·mode + z-bin."""
        scaled = self.scaler.transform(df.select("*"))
        out = {}
        for c in self.columns:
            x = scaled[c]
            mode = self.mode_expr(c, x)
            mu = F.element_at(F.array(*[F.lit(v) for v in self.mu[c]]), mode + 1)
            sg = F.element_at(F.array(*[F.lit(v) for v in self.sigma[c]]), mode + 1)
            out[c + suffix] = (F.lit(BINS_PER_MODE) * mode + z_bin((x - mu) / sg)).cast("int")
        keep = [c for c in df.columns if c not in out]
        return scaled.select(*keep, *[v.alias(k) for k, v in out.items()])

    def inverse(self, df: DataFrame, key: str, seed=42) -> DataFrame:
        """M4: code → value: truncated normal inside the bin (M5), then un-scale.

        The uniform and the bin probability are materialised as columns first, so the
        branches of Φ⁻¹ refer to them instead of repeating the hash.
        """
        out = df
        for c in self.columns:
            code = F.col(c).cast("int")
            mode = F.floor(code / BINS_PER_MODE).cast("int")
            b = (code % BINS_PER_MODE).cast("int")
            out = out.withColumn(f"__p_{c}", truncnorm_p(b, hash_uniform(F.col(key).cast("string"), c, str(seed))))
            mu = F.element_at(F.array(*[F.lit(v) for v in self.mu[c]]), mode + 1)
            sg = F.element_at(F.array(*[F.lit(v) for v in self.sigma[c]]), mode + 1)
            out = out.withColumn(c, mu + sg * probit(F.col(f"__p_{c}"))).drop(f"__p_{c}")
        return self.scaler.inverse(out)


def z_bin(z: Column) -> Column:
    """M3: ≤−3→0, (−3,−2]→1, (−2,−1]→2, (−1,0]→3, (0,1]→4, (1,2]→5, (2,3]→6, >3→7."""
    total = None
    for e in Z_EDGES:
        term = (z > F.lit(e)).cast("int")
        total = term if total is None else total + term
    return total


# Φ at the bin boundaries −∞, −3, …, 3, +∞ (computed from erf).
PHI_EDGES = [0.0] + [_phi(z) for z in Z_EDGES] + [1.0]


def truncnorm_p(b: Column, u: Column) -> Column:
    """M5: Φlo + (Φhi − Φlo)·u for bin ``b``, clamped inside (0, 1)."""
    lo = F.element_at(F.array(*[F.lit(v) for v in PHI_EDGES[:-1]]), b + 1)
    hi = F.element_at(F.array(*[F.lit(v) for v in PHI_EDGES[1:]]), b + 1)
    p = lo + (hi - lo) * u
    return F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))


def truncnorm_z(b: Column, u: Column) -> Column:
    """M5: z ~ N(0,1) restricted to bin ``b``: Φ⁻¹(Φlo + (Φhi − Φlo)·u)."""
    return probit(truncnorm_p(b, u))
