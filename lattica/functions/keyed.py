"""Keyed randomness: numbers that depend on a seed and on the row's own keys, not on where or how often it is computed."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a keyed number: what a double holds exactly, in whole hexadecimal digits.
DIGITS = 13


def keyed_bits(seed: int | str, *keys: str | Column) -> Column:
    """A LONG of 52 bits from the MD5 of seed and keys; any engine with MD5 gets the same."""
    parts = [F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, DIGITS), 16, 10).cast("long")


def keyed_uniform(seed: int | str, *keys: str | Column) -> Column:
    """A DOUBLE in [0, 1)."""
    return keyed_bits(seed, *keys) / F.lit(2.0 ** (4 * DIGITS))


def bits_sql(seed: int | str, *keys: str) -> str:
    """keyed_bits as DuckDB SQL."""
    parts = ", ".join([f"'{seed}'", *(f"({k})::VARCHAR" for k in keys)])
    return f"('0x' || substr(md5(concat_ws('|', {parts})), 1, {DIGITS}))::BIGINT"


def uniform_sql(seed: int | str, *keys: str) -> str:
    return f"({bits_sql(seed, *keys)} / {2.0 ** (4 * DIGITS)})"


def stochastic_round(estimate: Column, u: Column) -> Column:
    """floor(e), or one more with the probability of e's fraction."""
    return (F.floor(estimate) + F.when(u < estimate - F.floor(estimate), 1).otherwise(0)).cast("long")


def inverse_cdf(name: str, u: Column, **p: float) -> Column:
    """A draw from a named distribution at the quantile u: constant, uniform, expon, norm, logistic, weibull_min, triang."""
    loc, scale = F.lit(float(p.get("loc", 0.0))), F.lit(float(p.get("scale", 1.0)))
    if name == "constant":
        return F.lit(float(p["constant"]))
    if name == "uniform":
        return loc + scale * u
    if name == "expon":
        return loc - scale * F.log(F.lit(1.0) - u)
    if name == "logistic":
        return loc + scale * F.log(u / (F.lit(1.0) - u))
    if name == "weibull_min":
        return loc + scale * F.pow(-F.log(F.lit(1.0) - u), F.lit(1.0 / p["c"]))
    if name == "triang":
        c = float(p["c"])
        return loc + scale * F.when(u < c, F.sqrt(u * c)).otherwise(1.0 - F.sqrt((1.0 - u) * (1.0 - c)))
    if name == "norm":
        return loc + scale * _normal_quantile(u)
    raise ValueError(f"unknown distribution {name}")


def cdf(name: str, x: float, **p: float) -> float:
    """The probability of at most x; 1 - cdf is the survival function."""
    z = (x - p.get("loc", 0.0)) / p.get("scale", 1.0)
    if name == "constant":
        return float(x >= p["constant"])
    if name == "uniform":
        return min(1.0, max(0.0, z))
    if name == "expon":
        return 1 - math.exp(-z) if z > 0 else 0.0
    if name == "logistic":
        return 1 / (1 + math.exp(-z))
    if name == "weibull_min":
        return 1 - math.exp(-(z ** p["c"])) if z > 0 else 0.0
    if name == "norm":
        return 0.5 * (1 + math.erf(z / math.sqrt(2)))
    raise ValueError(f"unknown distribution {name}")


def cdf_column(name: str, x: Column, **p: float) -> Column:
    """The probability of at most x, as a column: uniform, expon, logistic, weibull_min."""
    z = (x - float(p.get("loc", 0.0))) / float(p.get("scale", 1.0))
    if name == "uniform":
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), z))
    if name == "expon":
        return F.when(z > 0, F.lit(1.0) - F.exp(-z)).otherwise(0.0)
    if name == "logistic":
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    if name == "weibull_min":
        return F.when(z > 0, F.lit(1.0) - F.exp(-F.pow(z, F.lit(float(p["c"]))))).otherwise(0.0)
    raise ValueError(f"no distribution function of {name} as a column")


def _normal_quantile(u: Column) -> Column:
    """Acklam's rational approximation, relative error below 1.2e-9."""
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)

    def poly(x: Column, k: tuple[float, ...], last: float | None = None) -> Column:
        out = F.lit(0.0)
        for v in k if last is None else (*k, last):
            out = out * x + v
        return out

    tail = lambda v: poly(F.sqrt(-2 * F.log(v)), c) / poly(F.sqrt(-2 * F.log(v)), d, 1.0)
    q = u - 0.5
    return F.when(u < 0.02425, tail(u)).when(u > 0.97575, -tail(F.lit(1.0) - u)).otherwise(q * poly(q * q, a) / poly(q * q, b, 1.0))
