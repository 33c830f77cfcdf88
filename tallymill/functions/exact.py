"""Exact tests and quantiles that Spark SQL has no function for, as Arrow UDFs.

All take and give columns of doubles or whole numbers; a null argument gives null.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

EPS = 1e-15


def _log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / (c if abs(c) > tiny else tiny)
            out *= c * d
        if abs(c * d - 1) < EPS:
            break
    return front * out


def beta_quantile(q: float, a: float, b: float) -> float:
    """The x whose beta_cdf is q, by bisection."""
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if beta_cdf(mid, a, b) < q:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-16:
            break
    return (lo + hi) / 2


def clopper_pearson(s: float, n: float, conf: float = 0.95) -> tuple[float, float]:
    """Exact binomial interval; an error for no trials."""
    if n <= 0 or s < 0 or s > n:
        raise ValueError("BAD_COUNTS")
    tail = (1 - conf) / 2
    return (0.0 if s == 0 else beta_quantile(tail, s, n - s + 1), 1.0 if s == n else beta_quantile(1 - tail, s + 1, n - s))


def mcnemar(b: float, c: float) -> float:
    """Two-sided exact test of discordant counts; 1 where there are none."""
    n = b + c
    if n == 0:
        return 1.0
    tail = sum(math.exp(_log_choose(n, i) - n * math.log(2)) for i in range(int(min(b, c)) + 1))
    return min(1.0, 2 * tail)


def fisher(s1: float, n1: float, s2: float, n2: float) -> float:
    """Two-sided exact test of two proportions: all tables no likelier than the given one."""
    total, n = s1 + s2, n1 + n2
    low, high = max(0, total - n2), min(n1, total)
    support = np.arange(low, high + 1)
    logs = np.array([_log_choose(n1, k) + _log_choose(n2, total - k) - _log_choose(n, total) for k in support])
    given = logs[int(s1 - low)]
    return float(min(1.0, np.exp(logs[logs <= given + 1e-7]).sum()))


def conformal_coverage(n: float, alpha: float, conf: float = 0.95) -> tuple[float, float, float]:
    """(mean, lower, upper) of the coverage that n calibration points at level alpha give."""
    rank = math.floor((n + 1) * alpha + 1e-9)
    if rank < 1:
        return 1.0, 1.0, 1.0
    a, b = n + 1 - rank, rank
    tail = (1 - conf) / 2
    return a / (a + b), beta_quantile(tail, a, b), beta_quantile(1 - tail, a, b)


def t_pvalue(n: float, mean: float, sd: float, against: float) -> float:
    """One-sided p of a mean above `against`; 1 for fewer than two values, 0 or 1 for no variance."""
    if n < 2 or math.isnan(mean):
        return 1.0
    if sd == 0:
        return 0.0 if mean > against else 1.0
    t = (mean - against) / (sd / math.sqrt(n))
    half = 0.5 * beta_cdf((n - 1) / (n - 1 + t * t), (n - 1) / 2, 0.5)
    return half if t > 0 else 1 - half


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _each(f, *columns: pd.Series) -> list:
    memory: dict = {}
    out = []
    for row in zip(*(c.astype("float64") for c in columns)):
        if any(math.isnan(x) for x in row):
            out.append(None)
            continue
        if row not in memory:
            memory[row] = f(*row)
        out.append(memory[row])
    return out


def _double(f, n_args: int):
    if n_args == 1:
        def run(a: pd.Series) -> pd.Series:
            return pd.Series(_each(f, a), dtype="float64")
    elif n_args == 2:
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(_each(f, a, b), dtype="float64")
    else:
        def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
            return pd.Series(_each(f, a, b, c, d), dtype="float64")
    return F.pandas_udf(run, DoubleType())


mcnemar_p = _double(mcnemar, 2)
fisher_p = _double(fisher, 4)
t_p = _double(t_pvalue, 4)
normal_p = _double(normal_two_sided, 1)


@F.pandas_udf(ArrayType(DoubleType()))
def clopper_pearson_ci(s: pd.Series, n: pd.Series, conf: pd.Series) -> pd.Series:
    return pd.Series(_each(lambda *a: list(clopper_pearson(*a)), s, n, conf))


@F.pandas_udf(ArrayType(DoubleType()))
def conformal_ci(n: pd.Series, alpha: pd.Series, conf: pd.Series) -> pd.Series:
    return pd.Series(_each(lambda *a: list(conformal_coverage(*a)), n, alpha, conf))


#: Steps of the grid of log temperatures.
GRID = 60


def fit_temperature(confidence: np.ndarray, correct: np.ndarray, weight: np.ndarray | None = None, high: float = 100.0) -> float:
    """The temperature in [0.05, high] of least log loss over weighted points, by a grid and golden section on its logarithm; 1 where
    fewer than two confidences or only one class are given."""
    weight = np.ones(len(confidence)) if weight is None else weight
    keep = ~np.isnan(confidence) & (weight > 0)
    p, y, w = np.clip(confidence[keep], 1e-6, 1 - 1e-6), correct[keep].astype(float), weight[keep]
    if w.sum() < 2 or y.min() == y.max():
        return 1.0
    z = np.log(p / (1 - p))

    def loss(log_t: float) -> float:
        q = np.clip(1 / (1 + np.exp(-z / math.exp(log_t))), 1e-6, 1 - 1e-6)
        return float(-(w * (y * np.log(q) + (1 - y) * np.log(1 - q))).sum() / w.sum())

    # clipped, the loss has no single valley for certain: the lowest of GRID steps tells where to look
    ends, g = (math.log(0.05), math.log(high)), (math.sqrt(5) - 1) / 2
    grid = [ends[0] + i * (ends[1] - ends[0]) / GRID for i in range(GRID + 1)]
    best = int(np.argmin([round(loss(x), 12) for x in grid]))
    lo, hi = grid[max(0, best - 1)], grid[min(GRID, best + 1)]
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = loss(a), loss(b)
    while hi - lo > 1e-9:
        if fa <= fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = loss(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = loss(b)
    return math.exp((lo + hi) / 2)
