"""Special functions that neither Spark nor its SQL has: native expressions first, one Arrow UDF (the interval of report rows)."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The published rational Chebyshev approximations of erf and erfc (numerator, denominator; highest
# power last), for x up to 0.46875, up to 4, and beyond.
NEAR = (
    (3.20937758913846947e3, 3.77485237685302021e2, 1.13864154151050156e2, 3.16112374387056560e0, 1.85777706184603153e-1),
    (2.84423683343917062e3, 1.28261652607737228e3, 2.44024637934444173e2, 2.36012909523441209e1, 1.0),
)
MIDDLE = (
    (1.23033935479799725e3, 2.05107837782607147e3, 1.71204761263407058e3, 8.81952221241769090e2, 2.98635138197400131e2, 6.61191906371416295e1, 8.88314979438837594e0, 5.64188496988670089e-1, 2.15311535474403846e-8),
    (1.23033935480374942e3, 3.43936767414372164e3, 4.36261909014324716e3, 3.29079923573345963e3, 1.62138957456669019e3, 5.37181101862009858e2, 1.17693950891312499e2, 1.57449261107098347e1, 1.0),
)
FAR = (
    (6.58749161529837803e-4, 1.60837851487422766e-2, 1.25781726111229246e-1, 3.60344899949804439e-1, 3.05326634961232344e-1, 1.63153871373020978e-2),
    (2.33520497626869185e-3, 6.05183413124413191e-2, 5.27905102951428412e-1, 1.87295284992346725e0, 2.56852019228982242e0, 1.0),
)


def ratio(x: Column, table: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    """A quotient of two polynomials in x, by Horner's rule."""
    up, down = (F.lit(t[-1]) for t in table)
    for a in reversed(table[0][:-1]):
        up = up * x + a
    for b in reversed(table[1][:-1]):
        down = down * x + b
    return up / down


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0, to 1e-14 of its value: plain arithmetic, so it stays in generated code."""
    y = F.greatest(x, F.lit(0.1))  # branches that are not taken must not divide by zero
    near = 1.0 - x * ratio(x * x, NEAR)
    middle = F.exp(-x * x) * ratio(x, MIDDLE)
    far = F.exp(-y * y) / y * (1 / math.sqrt(math.pi) - ratio(1 / (y * y), FAR) / (y * y))
    return F.when(x == float("inf"), F.lit(0.0)).when(x <= 0.46875, near).when(x <= 4, middle).otherwise(far)


def chi2_tail_1(x: Column) -> Column:
    return erfc(F.sqrt(x / 2))


def chi2_tail_2(x: Column) -> Column:
    return F.exp(-x / 2)


def normal_two_sided(z: Column) -> Column:
    return erfc(F.abs(z) / F.lit(math.sqrt(2)))


def normal_point(level: float) -> tuple[float, float]:
    """Quantile and density there of the standard normal law."""
    if not 0 < level < 1:
        raise ValueError("a level lies between 0 and 1")
    z = NormalDist().inv_cdf(level)
    return z, NormalDist().pdf(z)


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness from the population's."""
    n = F.count(x).cast("double")
    return F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(x)


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis."""
    n = F.count(x).cast("double")
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)


def log_pmf(k: int, n: int, p: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)


def fraction_of_beta(x: float, a: float, b: float) -> float:
    """The continued fraction of the regularised incomplete beta function, evaluated from the front (quick for x below (a + 1) / (a + b + 2))."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 100_000):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + up * d, 1 + up / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return out


def beta_law(x: float, a: float, b: float) -> tuple[float, float, float]:
    """Distribution function of the beta law, its complement (each from the side on which it is exact), and the density."""
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        low = scale * fraction_of_beta(x, a, b) / a
        return low, 1 - low, scale / (x * (1 - x))
    high = scale * fraction_of_beta(1 - x, b, a) / b
    return 1 - high, high, scale / (x * (1 - x))


def beta_point(q: float, a: float, b: float, upper: bool) -> float:
    """Where the beta law's lower (or ``upper``) tail is q: Newton's steps, halving where a step leaves the bracket."""
    low, high, x = 0.0, 1.0, a / (a + b)
    for _ in range(200):
        under, over, density = beta_law(x, a, b)
        miss = (q - over) if upper else (under - q)
        low, high = (low, x) if miss > 0 else (x, high)
        step = x - miss / density if density > 0 else low
        new = step if low < step < high else (low + high) / 2
        if abs(new - x) <= 1e-16 * x or new in (low, high) and high - low < 1e-15:
            return new
        x = new
    return x


@lru_cache(maxsize=65536)
def clopper_pearson(x: int, n: int, level: float) -> tuple[float, float]:
    """Exact interval for a binomial rate: points of beta laws; 0 and 1 at the boundaries. Some steps whatever n is."""
    if not 0 <= x <= n or n < 1 or not 0 < level < 1:
        raise ValueError("0 <= x <= n, n >= 1 and a level between 0 and 1 are needed")
    tail = (1 - level) / 2
    low = 0.0 if x == 0 else beta_point(tail, x, n - x + 1, False)
    high = 1.0 if x == n else beta_point(tail, x + 1, n - x, True)
    return low, high


def exact_interval(x: Column, n: Column, level: float) -> Column:
    """struct(lower, upper): one call for each (model, level) row, not for each forecast."""

    @F.pandas_udf("lower double, upper double")
    def interval(xs: pd.Series, ns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clopper_pearson(int(a), int(b), level) for a, b in zip(xs, ns, strict=True)], columns=["lower", "upper"])

    return interval(x, n)


def binomial_quantile(q: float, n: int, p: float) -> int:
    """The least k with P(X <= k) >= q, by halving on the distribution function."""
    low, high = -1, n
    while high - low > 1:
        mid = (low + high) // 2
        if 1 - beta_law(p, mid + 1, n - mid)[0] >= q:
            high = mid
        else:
            low = mid
    return high


def reference_band(n: int, p: float, level: float = 0.95) -> tuple[float, float]:
    """Rates between which a correct model's exception rate lies with the stated probability."""
    return binomial_quantile((1 - level) / 2, n, p) / n, binomial_quantile((1 + level) / 2, n, p) / n


def reference_interval(n: Column, p: Column) -> Column:
    """struct(lower, upper) of ``reference_band``: one call for each distinct number of observations and rate."""

    @F.pandas_udf("lower double, upper double")
    def band(ns: pd.Series, ps: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([reference_band(int(a), float(b)) for a, b in zip(ns, ps, strict=True)], columns=["lower", "upper"])

    return band(n, p)
