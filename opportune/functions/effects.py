"""Column expressions for rates, ratios of rates and their uncertainty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to events, twice to totals, of every smoothed rate.
SMOOTHING = 0.5


def smoothed_rate(events: Column, total: Column, smoothing: float = SMOOTHING) -> Column:
    return (events + smoothing) / (total + 2 * smoothing)


def rate_ratio(k_pos: Column, n_pos: Column, k_neg: Column, n_neg: Column, smoothing: float = SMOOTHING) -> Column:
    """Smoothed rate after a positive result by that after a negative one: the escalation ratio."""
    return smoothed_rate(k_pos, n_pos, smoothing) / smoothed_rate(k_neg, n_neg, smoothing)


def log_ratio_variance(k_pos: Column, n_pos: Column, k_neg: Column, n_neg: Column, smoothing: float = SMOOTHING) -> Column:
    part = lambda k, n: 1 / (k + smoothing) - 1 / (n + 2 * smoothing)
    return part(k_pos, n_pos) + part(k_neg, n_neg)


def wald_bounds(ratio: Column, variance: Column, z: float = 1.96) -> tuple[Column, Column]:
    half = z * F.sqrt(variance)
    return F.exp(F.log(ratio) - half), F.exp(F.log(ratio) + half)


def e_value(ratio: Column) -> Column:
    """Strength of confounding that would explain a risk ratio; null or non-positive ratios give null."""
    r = F.when(ratio >= 1, ratio).when(ratio > 0, 1 / ratio)
    return r + F.sqrt(r * (r - 1))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0))


def logit(p: Column, edge: float = 1e-6) -> Column:
    q = F.greatest(F.lit(edge), F.least(F.lit(1 - edge), p))
    return F.log(q / (1 - q))


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def direction(ratio: Column) -> Column:
    return F.when(ratio > 1, "escalation").when((ratio > 0) & (ratio < 1), "suppression")


#: Terms of the series and the continued fraction below; enough for chi-square tails of up to a thousand degrees of freedom.
TERMS = 300


def log_gamma(a: Column) -> Column:
    """Logarithm of the gamma function of a positive number: Stirling's series, eight steps further up."""
    z = a + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    steps = a
    for k in range(1, 8):
        steps = steps * (a + k)
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - F.log(steps)


def upper_gamma(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function Q(a, x): by the series below a + 1, by the continued fraction (Lentz) from there on.

    Null arguments give null, as do a <= 0 and x < 0; Q(a, 0) is 1, Q of an infinite x is 0.
    """
    a, x = a.cast("double"), x.cast("double")
    front = F.exp(a * F.log(x) - x - log_gamma(a))
    numbers = F.sequence(F.lit(1), F.lit(TERMS)).cast("array<double>")
    term = F.struct((1 / a).alias("term"), (1 / a).alias("sum"))

    def more(s, n):
        t = s["term"] * x / (a + n)
        return F.struct(t.alias("term"), (s["sum"] + t).alias("sum"))

    lower = front * F.aggregate(numbers, term, more, lambda s: s["sum"])
    tiny = 1e-300
    away = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)
    first = 1 / away(x + 1 - a)

    def step(s, n):
        top, below = -n * (n - a), x + 1 - a + 2 * n
        d, c = 1 / away(top * s["d"] + below), away(below + top / s["c"])
        return F.struct(d.alias("d"), c.alias("c"), (s["h"] * d * c).alias("h"))

    fraction = front * F.aggregate(numbers, F.struct(first.alias("d"), F.lit(1 / tiny).alias("c"), first.alias("h")), step, lambda s: s["h"])
    value = F.when(x == 0, 1.0).when(x == float("inf"), 0.0).when(x < a + 1, 1 - lower).otherwise(fraction)
    return F.when((a > 0) & (x >= 0) & ~F.isnan(x), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def chi_square_tail(q: Column, degrees: Column) -> Column:
    """Probability of a chi-square value of at least q."""
    return upper_gamma(degrees / 2, q / 2)


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution, with its digits also where it is small."""
    return upper_gamma(F.lit(0.5), z * z / 2)
