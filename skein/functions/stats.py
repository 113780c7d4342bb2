"""Interval estimates and tests: column expressions, and small exact tests in plain Python."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.config import WILSON_Z


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def wilson(k: Column, n: Column, z: float = WILSON_Z) -> tuple[Column, Column]:
    """The Wilson interval of k of n, clipped to [0, 1]; (0, 0) where n is zero."""
    nn = F.when(n > 0, n.cast("double"))
    p = k / nn
    mid = p + F.lit(z * z) / (2 * nn)
    half = F.lit(z) * F.sqrt(p * (1 - p) / nn + F.lit(z * z) / (4 * nn * nn))
    scale = 1 + F.lit(z * z) / nn
    some = n > 0  # greatest and least skip nulls
    return (F.when(some, F.greatest((mid - half) / scale, F.lit(0.0))).otherwise(0.0), F.when(some, F.least((mid + half) / scale, F.lit(1.0))).otherwise(0.0))


def entropy(ps: Column) -> Column:
    """Shannon entropy in nats of an array of probabilities."""
    return -F.aggregate(ps, F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.ln(p)).otherwise(0.0))


def binomial_two_sided(k: int, n: int) -> float:
    """P of a split at least as uneven as k of n under one half; 1 where n is zero."""
    if n == 0:
        return 1.0
    tail = sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n
    return min(1.0, 2 * tail)


def wilcoxon_two_sided(w_plus: float, n: int, ties: float = 0.0) -> float:
    """Wilcoxon's signed-rank p by the normal approximation; ties is the sum of t**3 - t. 1 where n is zero."""
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return 1.0 if n == 0 or var <= 0 else math.erfc(abs(w_plus - n * (n + 1) / 4) / math.sqrt(2 * var))


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Fisher's exact test of a 2x2 table: the sum of the tables no likelier than this one."""
    row, col, n = a + b, a + c, a + b + c + d
    if n == 0:
        return 1.0
    log = lambda x: math.lgamma(row + 1) - math.lgamma(x + 1) - math.lgamma(row - x + 1) + math.lgamma(n - row + 1) - math.lgamma(col - x + 1) - math.lgamma(n - row - col + x + 1)
    base = math.lgamma(n + 1) - math.lgamma(col + 1) - math.lgamma(n - col + 1)
    here = log(a) - base
    return min(1.0, sum(math.exp(log(x) - base) for x in range(max(0, col - (n - row)), min(row, col) + 1) if log(x) - base <= here + 1e-7))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def corrected_resampled_t(diffs: list[float], n_train: int, n_test: int) -> tuple[float, float, float]:
    """Mean, t and p of the corrected resampled t-test; p is 1 or 0 where the differences do not vary."""
    n = len(diffs)
    mean = sum(diffs) / n
    var = sum((d - mean) ** 2 for d in diffs) / (n - 1) if n > 1 else 0.0
    if var == 0:
        return mean, 0.0 if mean == 0 else math.copysign(math.inf, mean), 1.0 if mean == 0 else 0.0
    t = mean / math.sqrt((1 / n + n_test / n_train) * var)
    return mean, t, student_two_sided(t, n - 1)
