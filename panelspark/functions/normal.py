"""Normal distribution and related scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Acklam's rational approximation of the inverse normal CDF (fixed values).
A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
LOW = 0.02425

EULER_GAMMA = 0.5772156649


def _poly(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution as a column expression."""
    tail = lambda q: _poly(C, q) / (_poly(D, q) * q + 1)
    q = p - 0.5
    r = q * q
    return (
        F.when(p < LOW, tail(F.sqrt(-2 * F.log(p))))
        .when(p <= 1 - LOW, _poly(A, r) * q / (_poly(B, r) * r + 1))
        .otherwise(-tail(F.sqrt(-2 * F.log(1 - p))))
    )


def _descending(n: int) -> Column:
    return F.sequence(F.lit(n), F.lit(1), F.lit(-1))


def normal_cdf(x: Column) -> Column:
    """Distribution function of the standard normal as a column expression: the series of positive terms
    1/2 + density(x) (x + x^3/3 + x^5/(3*5) + ...) within 3 of 0, the tail's continued fraction beyond."""
    # x is an array's only element, so that what it is made of is worked out once
    one = lambda v: F.when(v.isNotNull() & ~F.isnan(v), _cdf(v))
    return F.get(F.transform(F.array(x.cast("double")), one), 0)


def _cdf(v: Column) -> Column:
    size = F.abs(v)
    density = F.exp(-size * size / 2) / math.sqrt(2 * math.pi)
    near = size * F.aggregate(_descending(60), F.lit(1.0), lambda acc, k: 1 + acc * size * size / (2 * k + 1))
    tail = density / F.aggregate(_descending(60), size, lambda acc, k: size + k / acc)
    return F.when(size < 3, 0.5 + F.signum(v) * density * near).otherwise(F.when(v > 0, 1 - tail).otherwise(tail))


def erfi(x: Column) -> Column:
    """(2 / sqrt(pi)) times the integral of exp(t^2) from 0 to x, as a column expression: the series of x^(2n+1) / (n! (2n+1)),
    whose terms have one sign, within 6 of 0, the asymptotic series beyond."""
    one = lambda v: F.when(v.isNotNull() & ~F.isnan(v), _erfi(v))
    return F.get(F.transform(F.array(x.cast("double")), one), 0)


def _erfi(v: Column) -> Column:
    square = v * v
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    step = lambda acc, n: F.struct((acc["t"] * square / n).alias("t"), (acc["s"] + acc["t"] * square / n / (2 * n + 1)).alias("s"))
    near = 2 * v / math.sqrt(math.pi) * F.aggregate(F.sequence(F.lit(1), F.lit(160)), start, step, lambda acc: acc["s"])
    far = F.exp(square) / (v * math.sqrt(math.pi)) * F.aggregate(_descending(12), F.lit(1.0), lambda acc, k: 1 + acc * (2 * k - 1) / (2 * square))
    return F.when(F.abs(v) < 6, near).otherwise(far)


def expected_max_sharpe(sd: Column, trials: Column) -> Column:
    """Sharpe ratio that the best of `trials` worthless configurations is expected to show."""
    k = trials.cast("double")
    best = (1 - EULER_GAMMA) * inverse_normal(1 - 1 / k) + EULER_GAMMA * inverse_normal(1 - 1 / (k * math.e))
    return F.when(k < 2, 0.0).otherwise(sd * best)
