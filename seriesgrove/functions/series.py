"""Column functions over series: arrays of numbers, computed in double.

All of them are built-in expressions, so they stay in the JVM. A null array, or
one with a null in it, gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(values) -> Column:
    return F.transform(values, lambda x: x.cast("double"))


def bound(value, f) -> Column:
    """f of a value that is worked out once, however often f names it: Spark would repeat a plain expression at every use."""
    return F.element_at(F.transform(F.array(value), f), 1)


def total(values) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double"))


def sq_euclidean(a, b) -> Column:
    """The squared Euclidean distance of two arrays of one length."""
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def mean(values) -> Column:
    return bound(values, lambda v: total(v) / F.size(v))


def _centred(v, m) -> Column:
    """The sum of squared differences to a mean."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + (x.cast("double") - m) * (x.cast("double") - m))


def moments(values) -> Column:
    """A struct of v (the values), m (their mean) and s (the population standard deviation), in two passes."""
    named = lambda **c: F.struct(*(x.alias(k) for k, x in c.items()))
    with_mean = bound(values, lambda v: named(v=v, m=total(v) / F.size(v)))
    return bound(with_mean, lambda r: named(v=r["v"], m=r["m"], s=F.sqrt(_centred(r["v"], r["m"]) / F.size(r["v"]))))


def std(values) -> Column:
    """The population standard deviation."""
    return moments(values)["s"]


def znormalize(values, least: float = 1e-5) -> Column:
    """Values less their mean, over their deviation; null for a constant series."""
    return bound(moments(values), lambda r: F.when(r["s"] > least, F.transform(r["v"], lambda x: (x.cast("double") - r["m"]) / r["s"])))


def segments(length: int, n: int) -> list[tuple[int, int]]:
    """(start, length) of n even segments; the last takes the remainder."""
    size = length // n
    return [(i * size, size if i < n - 1 else length - i * size) for i in range(n)]


def segment_stats(values, parts: list[tuple[int, int]]) -> Column:
    """An array of (start, len, mean, std), one for each segment."""

    def one(v: Column, a: int, n: int) -> Column:
        return bound(moments(F.slice(v, a + 1, n)), lambda r: F.struct(F.lit(a).alias("start"), F.lit(n).alias("len"), r["m"].alias("mean"), r["s"].alias("std")))

    return bound(values, lambda v: F.array(*(one(v, a, n) for a, n in parts)))


def almost_equal(a, b, eps: float = 1e-5) -> Column:
    """Relative equality."""
    return F.abs(F.col(a) - F.col(b) if isinstance(a, str) else a - b) <= eps * F.greatest(F.lit(1.0), F.abs(F.col(a) if isinstance(a, str) else a), F.abs(F.col(b) if isinstance(b, str) else b))


def signed_round(x, places: int = 6) -> Column:
    """A number rounded; one just below zero gives -0.0, as IEEE rounding does, where Spark's round() loses the sign."""
    return F.when((x < 0) & (x > -0.5 * 10.0**-places), F.lit(-0.0)).otherwise(F.round(x, places))


def noise(key, position) -> Column:
    """A number in [-0.5, 0.5) from two integers alone, so that other engines agree."""
    return F.pmod(key * F.lit(7919) + position * F.lit(104729) + F.lit(12345), F.lit(1000)).cast("double") / 1000 - 0.5


def noisy(values, key, scale: float) -> Column:
    """A series with portable noise added."""
    return F.transform(values, lambda x, i: x.cast("double") + scale * noise(key, i))


def to_text(values, separator: str = " ") -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), separator)


def from_text(text, separator: str = " ") -> Column:
    """Numbers of a separated text; empty parts are left out."""
    return F.transform(F.filter(F.split(text, separator), lambda x: x != ""), lambda x: x.cast("double"))


def interval(prediction, alpha) -> Column:
    """The range prediction - alpha to prediction + alpha."""
    return F.struct((prediction - alpha).alias("lo"), (prediction + alpha).alias("hi"))


def interval_text(prediction, alpha, places: int = 6) -> Column:
    """The range as text: [lo, hi]."""
    return F.format_string(f"[%.{places}f, %.{places}f]", prediction - alpha, prediction + alpha)


def sq_euclidean_within(a, b, limit) -> Column:
    """The squared Euclidean distance, or null as soon as a partial sum exceeds the limit."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, d: F.when(s <= limit, s + d * d), lambda s: F.when(s <= limit, s))


def calibrated(prediction, alpha, square: bool = False) -> Column:
    """The prediction lowered by alpha, not below 0, squared again if roots were learned."""
    low = F.greatest(F.lit(0.0), prediction - alpha)
    return low * low if square else low


def polynomial(coefficients, recall, coverage) -> Column:
    """c0 + c1 r + c2 c + c3 r c + c4 r^2 + c5 c^2, not below 0."""
    c = lambda i: F.element_at(coefficients, i + 1)
    return F.greatest(F.lit(0.0), c(0) + c(1) * recall + c(2) * coverage + c(3) * recall * coverage + c(4) * recall * recall + c(5) * coverage * coverage)


def bivariate(kind, coefficients, centres, recall, coverage) -> Column:
    """The value of a bivariate fit, not below 0.

    Coefficients are those of 1, r, c, r^2, c^2 for linear and quadratic fits; for kernel fits a constant, then one for
    each centre (r, c, width).
    """
    c = lambda i: F.element_at(coefficients, i + 1)
    surface = c(0) + c(1) * recall + c(2) * coverage + c(3) * recall * recall + c(4) * coverage * coverage
    near = F.transform(centres, lambda p: F.exp(-((recall - p["r"]) * (recall - p["r"]) + (coverage - p["c"]) * (coverage - p["c"])) / (2 * p["width"] * p["width"])))
    kernels = c(0) + F.aggregate(F.zip_with(F.slice(coefficients, 2, F.size(coefficients)), near, lambda w, k: w * k), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), F.when(kind == "kernel", kernels).otherwise(surface))
