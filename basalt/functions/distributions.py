"""Distribution functions as column expressions, so that p-values stay inside a plan.

Series and continued fractions are folds over a fixed number of terms; they run
once for each row of an aggregated result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(terms: int, start: Column, step, finish=None) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, finish)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for positive x: Stirling's series at x + 8, and back."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9)
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - F.ln(product)


def digamma(x: Column) -> Column:
    """Derivative of ``log_gamma`` for positive x."""
    z = x + 6
    series = F.ln(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8)
    return series - sum((1 / (x + i) for i in range(1, 6)), 1 / x)


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal Z."""
    a = F.abs(z)
    density = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    # Near 0 the series of the integral, further out the continued fraction of the tail.
    near = 0.5 - density * _fold(60, F.struct(a.alias("term"), a.alias("sum")), lambda s, k: F.struct((s["term"] * a * a / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * a * a / (2 * k + 1)).alias("sum")), lambda s: s["sum"])
    far = density / _fold(120, a, lambda s, k: a + (121 - k) / s)
    upper = F.when(a < 3, near).otherwise(far)
    return F.when(z < 0, 1 - upper).otherwise(upper)


def normal_quantile(p: Column) -> Column:
    """z with P(Z > z) = p for p in (0, 1), by Newton steps from 0, which never overshoot."""
    tail = F.least(p, 1 - p)
    # Both functions need a column, so the steps go through a fold over it.
    step = lambda z, _: z + (normal_tail(z) - tail) * math.sqrt(2 * math.pi) * F.exp(z * z / 2)
    upper = _fold(60, F.lit(0.0), step)
    return F.when(p > 0.5, -upper).otherwise(upper)


def beta_share(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz method)."""

    def fraction(x: Column, a: Column, b: Column) -> Column:
        safe = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)

        def step(s: Column, m: Column) -> Column:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            d = 1 / safe(1 + even * s["d"])
            c = safe(1 + even / s["c"])
            h = s["h"] * c * d
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d2 = 1 / safe(1 + odd * d)
            c2 = safe(1 + odd / c)
            return F.struct(c2.alias("c"), d2.alias("d"), (h * c2 * d2).alias("h"))

        first = 1 / safe(1 - (a + b) * x / (a + 1))
        body = _fold(300, F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h")), step, lambda s: s["h"])
        return F.exp(a * F.ln(x) + b * F.log1p(-x) - F.ln(a) - (log_gamma(a) + log_gamma(b) - log_gamma(a + b))) * body

    inside = F.when(x <= (a + 1) / (a + b + 2), fraction(x, a, b)).otherwise(1 - fraction(1 - x, b, a))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def t_two_sided(t: Column, freedom: Column) -> Column:
    """P(|T| > |t|) of Student's t."""
    return beta_share(freedom / (freedom + t * t), freedom / 2, F.lit(0.5))


def kolmogorov_tail(x: Column) -> Column:
    """P(K > x) of Kolmogorov's distribution."""
    x = F.greatest(x, F.lit(1e-9))
    far = 2 * _fold(20, F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * k * k * x * x))
    near = 1 - math.sqrt(2 * math.pi) / x * _fold(20, F.lit(0.0), lambda s, k: s + F.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(x < 1, near).otherwise(far)))


def signed_rank_tail(doubled_ranks: Column, doubled_sum: Column) -> Column:
    """P(W+ >= w) when every sign is equally likely: the exact distribution for an array of doubled ranks (ties have middle ranks).

    Counts of the ways to each sum, one rank after another; they stay exact up to 50 ranks.
    """
    total = F.aggregate(doubled_ranks, F.lit(0).cast("long"), lambda s, r: s + r).cast("int")
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), total))

    def add(ways: Column, rank: Column) -> Column:
        r = rank.cast("int")
        moved = F.slice(F.concat(F.array_repeat(F.lit(0.0), r), ways), F.lit(1), F.size(ways))
        return F.zip_with(ways, moved, lambda a, b: a + b)

    ways = F.aggregate(doubled_ranks, start, add)
    at = doubled_sum.cast("int")
    upper = F.slice(ways, at + 1, F.greatest(total - at + 1, F.lit(0)))
    return F.aggregate(upper, F.lit(0.0), lambda s, w: s + w) / F.pow(F.lit(2.0), F.size(doubled_ranks))
