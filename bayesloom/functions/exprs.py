"""Deterministic uniforms, the normal quantile and log-gamma as Spark column expressions.

The formulas are written once as SQL text and wrapped with ``F.expr`` so the same
arithmetic runs on every executor (and can be reproduced by any SQL engine).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hash_uniform(*parts) -> Column:
    """u in (0, 1) from md5 of ``parts`` joined by '|': (first 32 bits + 0.5) / 2^32.

    Depends only on the row key, node name and seed, never on partitioning or
    task order, so a re-executed task draws the same values.
    """
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("double")
    return (h + F.lit(0.5)) / F.lit(TWO_32)


def hash_uniform_sql(*parts_sql: str, dialect: str = "spark") -> str:
    """SQL text of :func:`hash_uniform`; ``parts_sql`` are SQL expressions."""
    inner = f"md5(concat_ws('|', {', '.join(parts_sql)}))"
    if dialect == "duckdb":
        return f"((('0x' || substr({inner}, 1, 8))::BIGINT + 0.5) / {TWO_32})"
    return f"((CAST(conv(substr({inner}, 1, 8), 16, 10) AS DOUBLE) + 0.5) / {TWO_32})"


# Coefficients of the public rational approximation of the normal
# quantile (P. J. Acklam), relative error below 1.2e-9.
_PROBIT_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
             1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_PROBIT_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
             6.680131188771972e01, -1.328068155288572e01]
_PROBIT_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
             -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_PROBIT_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
             3.754408661907416e00]
_PROBIT_LOW = 0.02425


def _horner(coefs, var: str) -> str:
    expr = repr(coefs[0])
    for c in coefs[1:]:
        expr = f"(({expr}) * {var} + {c!r})"
    return expr


def probit_sql(u: str) -> str:
    """SQL text of Φ⁻¹(u) for u in (0,1); ``u`` must be a column name or parenthesised expression."""
    ql = f"sqrt(-2.0 * ln({u}))"
    qu = f"sqrt(-2.0 * ln(1.0 - {u}))"
    qc = f"({u} - 0.5)"
    rc = f"(({u} - 0.5) * ({u} - 0.5))"
    tail_num = lambda q: _horner(_PROBIT_C, q)
    tail_den = lambda q: f"({_horner(_PROBIT_D, q)} * {q} + 1.0)"
    lower = f"({tail_num(ql)} / {tail_den(ql)})"
    upper = f"(-({tail_num(qu)} / {tail_den(qu)}))"
    central = f"({_horner(_PROBIT_A, rc)} * {qc} / ({_horner(_PROBIT_B, rc)} * {rc} + 1.0))"
    return (f"(CASE WHEN {u} < {_PROBIT_LOW} THEN {lower} "
            f"WHEN {u} > {1 - _PROBIT_LOW!r} THEN {upper} ELSE {central} END)")


def probit(u) -> Column:
    """Φ⁻¹ of a column (Spark SQL has no probit).

    As a function over an array of one: spelled out, a few of them take a projection's generated method over the size that the JVM
    compiles (8,000 bytes), and all of it is interpreted from then on.
    """
    return F.get(F.transform(F.array(_c(u)), _probit_col), 0)


def _probit_col(u: Column) -> Column:
    a, b, c, d = _PROBIT_A, _PROBIT_B, _PROBIT_C, _PROBIT_D

    def horner(coefs, v):
        out = F.lit(coefs[0])
        for k in coefs[1:]:
            out = out * v + F.lit(k)
        return out

    ql = F.sqrt(F.lit(-2.0) * F.log(u))
    qu = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u))
    qc = u - F.lit(0.5)
    rc = qc * qc
    lower = horner(c, ql) / (horner(d, ql) * ql + F.lit(1.0))
    upper = -(horner(c, qu) / (horner(d, qu) * qu + F.lit(1.0)))
    central = horner(a, rc) * qc / (horner(b, rc) * rc + F.lit(1.0))
    return F.when(u < F.lit(_PROBIT_LOW), lower).when(u > F.lit(1 - _PROBIT_LOW), upper).otherwise(central)


_HALF_LN_2PI = 0.5 * math.log(2 * math.pi)


def lgamma_sql(x: str) -> str:
    """ln Γ(x) for x > 0: Stirling series at x+6, shifted back by six logs."""
    z = f"({x} + 6.0)"
    shift = " + ".join(f"ln({x} + {k}.0)" for k in range(6))
    series = (f"(({z} - 0.5) * ln({z}) - {z} + {_HALF_LN_2PI!r} + 1.0 / (12.0 * {z}) "
              f"- 1.0 / (360.0 * power({z}, 3)) + 1.0 / (1260.0 * power({z}, 5)) "
              f"- 1.0 / (1680.0 * power({z}, 7)))")
    return f"({series} - ({shift}))"


def lgamma(x) -> Column:
    """ln Γ as a column expression (Spark SQL has none); accuracy ~1e-11 for x > 0."""
    x = _c(x)
    z = x + F.lit(6.0)
    shift = F.log(x)
    for k in range(1, 6):
        shift = shift + F.log(x + F.lit(float(k)))
    series = ((z - F.lit(0.5)) * F.log(z) - z + F.lit(_HALF_LN_2PI) + F.lit(1.0) / (F.lit(12.0) * z)
              - F.lit(1.0) / (F.lit(360.0) * F.pow(z, 3)) + F.lit(1.0) / (F.lit(1260.0) * F.pow(z, 5))
              - F.lit(1.0) / (F.lit(1680.0) * F.pow(z, 7)))
    return series - shift


def log2(x) -> Column:
    return F.log(_c(x)) / F.lit(math.log(2.0))


def round_to(x, digits: int = 6) -> Column:
    return F.round(_c(x), digits)


def hash_uniform_block(key, block: int, slot: int, seed) -> Column:
    """Uniform number ``slot`` (0–3) of the md5 digest of ``key|b<block>|seed``.

    One digest gives four independent 32-bit uniforms, so a row needs one md5 per four
    nodes. Same value as SQL ``hash_uniform_block_sql``.
    """
    digest = F.md5(F.concat_ws("|", key, F.lit(f"b{block}"), F.lit(str(seed))))
    h = F.conv(F.substring(digest, 8 * slot + 1, 8), 16, 10).cast("double")
    return (h + F.lit(0.5)) / F.lit(TWO_32)


def hash_uniform_block_sql(key_sql: str, block: int, slot: int, seed, dialect: str = "spark") -> str:
    inner = f"md5(concat_ws('|', {key_sql}, 'b{block}', '{seed}'))"
    if dialect == "duckdb":
        return f"((('0x' || substr({inner}, {8 * slot + 1}, 8))::BIGINT + 0.5) / {TWO_32})"
    return f"((CAST(conv(substr({inner}, {8 * slot + 1}, 8), 16, 10) AS DOUBLE) + 0.5) / {TWO_32})"


def digamma_sql(x: str) -> str:
    """ψ(x) for x > 0: the asymptotic series at x+6, shifted back by six reciprocals."""
    z = f"({x} + 6.0)"
    shift = " + ".join(f"1.0 / ({x} + {k}.0)" for k in range(6))
    series = (f"(ln({z}) - 1.0 / (2.0 * {z}) - 1.0 / (12.0 * power({z}, 2)) + 1.0 / (120.0 * power({z}, 4)) "
              f"- 1.0 / (252.0 * power({z}, 6)) + 1.0 / (240.0 * power({z}, 8)))")
    return f"({series} - ({shift}))"


def pack_codes(codes: list[tuple[Column, int]]) -> Column:
    """Mixed-radix key of (code, card) pairs, the last one lowest; null if any code is null, negative or not below its
    card, so that no configuration takes another one's key. A decimal where a long could overflow."""
    size = math.prod(card for _, card in codes)
    kind = "long" if size < 2**63 else "decimal(38,0)"
    if size >= 10**38:
        raise ValueError("the configurations don't fit a 38-digit key")
    key = F.lit(0).cast(kind)
    for code, card in codes:
        good = F.when((code >= 0) & (code < card), code.cast(kind))
        key = (key * F.lit(int(card)).cast(kind) + good).cast(kind)
    return key
