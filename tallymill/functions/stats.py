"""Interval, rate and score formulas as Column expressions: they stay inside whole-stage code generation."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-sided 95 % quantile of the normal distribution.
Z95 = NormalDist().inv_cdf(0.975)
#: Beyond this exponent an e-value counts as infinite.
LOG_E_LIMIT = 700.0


def z_of(conf: float) -> float:
    """The two-sided normal quantile of a confidence."""
    return NormalDist().inv_cdf(0.5 + conf / 2)


def guarded(bad: Column, code: str, value: Column) -> Column:
    """value, or an error naming code where bad holds; the guard is part of the value, so it can't be pruned."""
    return F.when(bad, F.raise_error(F.lit(code))).otherwise(value)


def _wilson_ends(p: Column, n: Column, z: float) -> tuple[Column, Column]:
    q = z * z / n
    middle = (p + q / 2) / (1 + q)
    half = z * F.sqrt(p * (1 - p) / n + q / (4 * n)) / (1 + q)
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


def _rate(s: Column, n: Column) -> tuple[Column, Column]:
    safe = F.when(n > 0, n).cast("double")
    return s / safe, safe


def wilson(s: Column, n: Column, conf: float = 0.95) -> tuple[Column, Column]:
    """Wilson score interval of s successes in n; (0, 1) for no trials."""
    lower, upper = _wilson_ends(*_rate(s, n), z_of(conf))
    return F.coalesce(lower, F.lit(0.0)), F.coalesce(upper, F.lit(1.0))


def wilson_strict(s: Column, n: Column, conf: float = 0.95) -> tuple[Column, Column]:
    """As wilson, but no trials, or counts that can't be, are an error."""
    bad = (n <= 0) | (s < 0) | (s > n)
    lower, upper = wilson(s, n, conf)
    return guarded(bad, "BAD_COUNTS", lower), guarded(bad, "BAD_COUNTS", upper)


def pass_hat_k(s: Column, n: Column, k: int) -> Column:
    """The plug-in chance that k trials in a row succeed; 0 for no trials."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return F.coalesce(F.pow(_rate(s, n)[0], F.lit(float(k))), F.lit(0.0))


def pass_hat_k_strict(s: Column, n: Column, k: int) -> Column:
    return guarded((n <= 0) | (s < 0) | (s > n), "BAD_COUNTS", pass_hat_k(s, n, k))


def graduates(s: Column, n: Column, low: float = 0.10, high: float = 0.90) -> Column:
    """Whether the Wilson interval lies within [low, high]: neither trivial nor impossible."""
    lower, upper = wilson(s, n)
    return (n > 0) & (lower >= low) & (upper <= high)


def newcombe(s1: Column, n1: Column, s2: Column, n2: Column, conf: float = 0.95) -> tuple[Column, Column, Column]:
    """(lower, upper, difference) of two proportions by Newcombe's hybrid score method."""
    p1, p2 = _rate(s1, n1)[0], _rate(s2, n2)[0]
    return newcombe_of(p1, *_wilson_ends(*_rate(s1, n1), z_of(conf)), p2, *_wilson_ends(*_rate(s2, n2), z_of(conf)))


def newcombe_of(p1: Column, l1: Column, u1: Column, p2: Column, l2: Column, u2: Column) -> tuple[Column, Column, Column]:
    """newcombe from two rates and their Wilson intervals, where those are columns already."""
    d = p1 - p2
    lower = d - F.sqrt((p1 - l1) * (p1 - l1) + (u2 - p2) * (u2 - p2))
    upper = d + F.sqrt((u1 - p1) * (u1 - p1) + (p2 - l2) * (p2 - l2))
    return F.greatest(F.lit(-1.0), lower), F.least(F.lit(1.0), upper), d


def log_e(s: Column, n: Column, p0: float, p1: float) -> Column:
    """Log of the e-value increment of s successes in n for p1 against p0."""
    return s * F.lit(math.log(p1 / p0)) + (n - s) * F.lit(math.log((1 - p1) / (1 - p0)))


def guarded_exp(x: Column) -> Column:
    return F.when(x >= LOG_E_LIMIT, F.lit(float("inf"))).otherwise(F.exp(x))


def safe_r(x: Column, y: Column) -> Column:
    """Aggregate: Pearson's r, 0 where either side is constant or there are fewer than two rows."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def quality_score(accuracy: Column, r: Column, consistency: Column, ece: Column, max_bias: Column, ece_ceiling: float = 0.15) -> Column:
    """Half accuracy, three tenths agreement, a fifth consistency; less for poor calibration and bias; within [0, 1]."""
    blend = 0.5 * accuracy + 0.3 * F.greatest(F.lit(0.0), r) + 0.2 * consistency
    blend = F.greatest(F.lit(0.0), F.least(F.lit(1.0), blend))
    calibrated = 1 / (1 + F.coalesce(F.greatest(F.lit(0.0), ece - ece_ceiling), F.lit(0.0)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), blend * calibrated * F.greatest(F.lit(0.0), 1 - max_bias)))


def kappa_z(kappa: Column, human: Column, n: Column) -> Column:
    """How many standard errors kappa lies from the human baseline; 0 where that has no variance."""
    var = human * (1 - human) / F.when(n > 0, n)
    return F.when(var > 0, (kappa - human) / F.sqrt(F.when(var > 0, var))).otherwise(0.0)


def human_like(kappa: Column, human: Column, n: Column) -> Column:
    return F.abs(kappa_z(kappa, human, n)) < 1


def apply_temperature(confidence: Column, temperature: Column) -> Column:
    """A confidence rescaled on the logit scale."""
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), confidence))
    return 1 / (1 + F.exp(-F.log(p / (1 - p)) / temperature))


def accuracy_wilson(accuracy: Column, n_eff: Column, conf: float = 0.95) -> tuple[Column, Column]:
    """Wilson interval at an effective sample size; halves are rounded to even."""
    n = F.greatest(F.lit(1.0), F.bround(n_eff, 0))
    s = F.least(n, F.greatest(F.lit(0.0), F.bround(accuracy * n, 0)))
    return wilson(s, n, conf)
