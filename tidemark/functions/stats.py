"""Statistics of small inputs in Python, and their SQL functions.

Moments, ranks and sums are Spark aggregates (see ``tidemark.operators.ranks``);
here is what turns a few such numbers into probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

EULER = 0.5772156649015329


def mean(x: Sequence[float]) -> float:
    return math.fsum(x) / len(x) if x else 0.0


def stddev(x: Sequence[float]) -> float:
    """Of a population; 0 below two values."""
    if len(x) < 2:
        return 0.0
    m = mean(x)
    return math.sqrt(math.fsum((v - m) ** 2 for v in x) / len(x))


def sharpe_ratio(x: Sequence[float]) -> float:
    """0 for a constant series."""
    sd = stddev(x)
    return mean(x) / sd if sd > 0 else 0.0


def _standardised(x: Sequence[float], power: int, constant: float) -> float:
    sd = stddev(x)
    if sd == 0:
        return constant
    m = mean(x)
    return math.fsum(((v - m) / sd) ** power for v in x) / len(x)


def skewness(x: Sequence[float]) -> float:
    return _standardised(x, 3, 0.0)


def kurtosis(x: Sequence[float]) -> float:
    """Raw: 3 for a normal distribution, and for a constant series."""
    return _standardised(x, 4, 3.0)


def normal_cdf(x: float) -> float:
    """M06."""
    return 0.5 * math.erfc(-x / math.sqrt(2))


def inverse_normal_cdf(p: float) -> float:
    """P must lie strictly between 0 and 1."""
    if not 0 < p < 1:
        raise ValueError(f"p must lie strictly between 0 and 1, not {p}")
    return NormalDist().inv_cdf(p)


def psr_of(n: int, sharpe: float, skew: float, kurt: float, benchmark: float = 0.0) -> float:
    """M08 from moments: the probability that the true Sharpe ratio is above ``benchmark``."""
    if n < 2:
        raise ValueError("two returns are needed")
    spread = 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe
    if spread <= 0:
        raise ArithmeticError("skewness and kurtosis are too extreme for an estimate")
    return normal_cdf((sharpe - benchmark) * math.sqrt(n - 1) / math.sqrt(spread))


def probabilistic_sharpe_ratio(x: Sequence[float], benchmark: float = 0.0) -> float:
    """M08."""
    return psr_of(len(x), sharpe_ratio(x), skewness(x), kurtosis(x), benchmark)


def expected_max_sharpe(trials: int, variance: float) -> float:
    """The best Sharpe ratio that luck alone gives over so many trials."""
    if trials <= 1:
        return 0.0
    if variance < 0:
        raise ValueError("a variance can't be negative")
    if variance == 0:
        return 0.0
    best = (1 - EULER) * inverse_normal_cdf(1 - 1 / trials) + EULER * inverse_normal_cdf(1 - 1 / (trials * math.e))
    return math.sqrt(variance) * best


def deflated_sharpe_ratio(x: Sequence[float], trials: int | Sequence[float], variance: float | None = None) -> float:
    """From the number of trials and their variance, or from the trials' Sharpe ratios."""
    if not isinstance(trials, int):
        trials, variance = len(trials), stddev(trials) ** 2 if len(trials) > 1 else 0.0
    return probabilistic_sharpe_ratio(x, expected_max_sharpe(trials, variance or 0.0))


def _beta_fraction(x: float, a: float, b: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def incomplete_beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(x, a, b) / a
    return 1 - front * _beta_fraction(1 - x, b, a) / b


def student_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / (df + t * t), df / 2, 0.5)


def spearman_p(rho: float | None, n: int) -> float | None:
    """Two-sided p of a rank correlation by Student's t with n-2 degrees of freedom."""
    if rho is None or math.isnan(rho) or n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    return student_two_sided(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)


def chi2_tail(x: float, df: int) -> float:
    """The upper tail of a chi-squared distribution."""
    if x <= 0:
        return 1.0
    if df % 2 == 0:
        return math.exp(-x / 2) * math.fsum((x / 2) ** k / math.factorial(k) for k in range(df // 2))
    tail = math.erfc(math.sqrt(x / 2))
    return tail + math.exp(-x / 2) * math.fsum((x / 2) ** (k - 0.5) / math.gamma(k + 0.5) for k in range(1, (df + 1) // 2))


def _u_counts(n: int, m: int) -> list[int]:
    """Ways that ``n`` and ``m`` values without ties give each value of U: a Gaussian binomial."""
    out = [1] + [0] * (n * m)
    for i in range(1, n + 1):
        for k in range(len(out) - 1, m + i - 1, -1):
            out[k] -= out[k - m - i]
        for k in range(i, len(out)):
            out[k] += out[k - i]
    return out


def mann_whitney_p(u: float, n: int, m: int, ties: float = 0.0) -> float | None:
    """Two-sided p. ``ties`` is the sum of t**3 - t over groups of tied values.

    Exact if the smaller sample has 8 values or fewer and none are tied, else
    by the normal approximation with corrections for ties and continuity.
    """
    if not n or not m:
        return None
    high = max(u, n * m - u)
    if min(n, m) <= 8 and not ties:
        most = sum(_u_counts(min(n, m), max(n, m))[math.ceil(high) :])
        return min(1.0, 2 * most / math.comb(n + m, n))
    total = n + m
    spread = n * m / 12 * (total + 1 - ties / (total * (total - 1)))
    if spread <= 0:
        return 1.0
    return min(1.0, 2 * normal_cdf(-(high - n * m / 2 - 0.5) / math.sqrt(spread)))


def _column(function, *kinds):
    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        out = []
        for values in zip(*columns):
            known = all(v is not None and v == v for v in values)
            out.append(function(*(k(v) for k, v in zip(kinds, values))) if known else None)
        return pd.Series(out, dtype="float64")

    return run


def _safe_psr(n: int, sharpe: float, skew: float, kurt: float, benchmark: float) -> float | None:
    try:
        return psr_of(n, sharpe, skew, kurt, benchmark)
    except (ValueError, ArithmeticError):
        return None


def columns() -> dict:
    """Arrow functions over columns: nulls (and what has no estimate) give null."""
    return {
        "normal_cdf": _column(normal_cdf, float),
        "inverse_normal_cdf": _column(inverse_normal_cdf, float),
        "psr": _column(_safe_psr, int, float, float, float, float),
        "expected_max_sharpe": _column(expected_max_sharpe, int, float),
        "spearman_p": _column(spearman_p, float, int),
        "chi2_tail": _column(chi2_tail, float, int),
        "mann_whitney_p": _column(mann_whitney_p, float, int, int, float),
    }


def register(spark: SparkSession) -> None:
    """The same for SQL."""
    for name, function in columns().items():
        spark.udf.register(name, function)
