"""Column functions over numbers; windows are given by the columns that make a series."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def l1(value: Column, *series: str) -> Column:
    """Share of the series' sum of absolute values; 0 where that is 0."""
    return F.coalesce(value / F.nullif(F.sum(F.abs(value)).over(Window.partitionBy(*series)), F.lit(0.0)), F.lit(0.0))


def l2(value: Column, *series: str) -> Column:
    """Over the series' Euclidean length; 0 where that is 0."""
    return F.coalesce(value / F.nullif(F.sqrt(F.sum(value * value).over(Window.partitionBy(*series))), F.lit(0.0)), F.lit(0.0))


def min_max(value: Column, *series: str) -> Column:
    """0 at the series' least, 1 at its greatest value; 0 for a constant series."""
    w = Window.partitionBy(*series)
    return F.coalesce((value - F.min(value).over(w)) / F.nullif(F.max(value).over(w) - F.min(value).over(w), F.lit(0.0)), F.lit(0.0))


def z_score(value: Column, *series: str) -> Column:
    """Standardised with the sample deviation; 0 for a constant series."""
    w = Window.partitionBy(*series)
    return F.coalesce((value - F.avg(value).over(w)) / F.nullif(F.stddev_samp(value).over(w), F.lit(0.0)), F.lit(0.0))


def fisher_z(r: Column) -> Column:
    """Half of log1p(2r / (1 - r)) for the absolute correlation, held below 0.999999."""
    a = F.least(F.abs(r), F.lit(0.999999))
    return 0.5 * F.log1p(2 * a / (1 - a))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def bucket(ts: Column, start: Column, step) -> Column:
    return F.floor((ts - start) / step)


def next_on_grid(ts: Column, step) -> Column:
    """The grid point after ``ts``; a point on the grid moves on as well."""
    return (F.floor(ts / step) + 1) * step


def digits_scale(from_digits: int, to_digits: int) -> int:
    """Factor between epochs of different resolution, by their number of digits."""
    return 10 ** (to_digits - from_digits)


def megabytes(metric: Column, value: Column) -> Column:
    """Memory metrics in units of a million bytes, others as they are."""
    return F.when(metric.endswith("_mem"), value / 1e6).otherwise(value)


def student_quantile(p: float, df: int) -> float:
    """Quantile of Student's t, by bisection on the regularised incomplete beta function."""
    import math

    def cdf(t: float) -> float:
        x = df / (df + t * t)
        tail = 0.5 * _beta(df / 2, 0.5, x)
        return 1 - tail if t > 0 else tail

    def _beta(a: float, b: float, x: float) -> float:
        if x <= 0 or x >= 1:
            return min(1.0, max(0.0, x))
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
        if x > (a + 1) / (a + b + 2):
            return 1 - _beta(b, a, 1 - x)
        total = term = 1 / a
        n = 0
        while abs(term) > 1e-16 * abs(total) and n < 10_000:
            term *= x * (a + b + n) / (a + 1 + n)
            total += term
            n += 1
        return front * total

    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2
