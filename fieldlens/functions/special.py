"""Special functions as column expressions: the incomplete beta function and what tests need of it."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Stirling's series of the logarithm of the gamma function, for z, z^3, z^5, ...
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def ln_gamma(z: Column) -> Column:
    """Logarithm of the gamma function of a positive number, by Stirling's series eight steps higher up."""
    up = z + 8
    series = F.lit(0.0)
    for k, c in enumerate(STIRLING):
        series = series + c / F.pow(up, 2 * k + 1)
    steps = F.lit(1.0)
    for k in range(8):
        steps = steps * (z + k)
    return (up - 0.5) * F.ln(up) - up + 0.5 * math.log(2 * math.pi) + series - F.ln(steps)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by products of its convergents' quotients. Its terms grow with the root of the larger parameter."""
    tiny = 1e-300
    off_zero = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)
    first = 1 / off_zero(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def turn(s: Column, part: Column) -> Column:
        d = 1 / off_zero(1 + part * s["d"])
        c = off_zero(1 + part / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    def step(s: Column, k: Column) -> Column:
        m = F.floor(k / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return turn(s, F.when(k % 2 == 0, even).otherwise(odd))

    terms = F.least(F.lit(60) + 8 * F.ceil(F.sqrt(F.greatest(a, b))), F.lit(1_000_000)).cast("int")
    return F.aggregate(F.sequence(F.lit(2), terms), start, step)["h"]


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function for positive a and b; 0 at or below 0, 1 at or above 1."""
    a, b, x = (c.cast("double") for c in (a, b, x))
    front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    low = x < (a + 1) / (a + b + 2)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(low, front * _fraction(a, b, x) / a).when(~low, 1 - front * _fraction(b, a, 1 - x) / b)


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(df / 2.0, F.lit(0.5), df / (df + t * t))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of n pairs; 0 where it is 1 or -1, null below three pairs."""
    df = (n - 2).cast("double")
    return F.when(n > 2, F.when(F.abs(r) >= 1, 0.0).otherwise(t_two_sided(r * F.sqrt(df / (1 - r * r)), df)))
