"""Distances and transforms of array columns. Sums are left folds in double, whatever the element type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

L2, COSINE, DOT, HAMMING = "l2", "cosine", "dot", "hamming"


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def literal(vector: Sequence[float]) -> Column:
    """A constant vector of doubles."""
    return F.array(*(F.lit(float(x)) for x in vector))


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def squared_l2_bounded(a: Column, b: Column, bound: float) -> tuple[Column, Column]:
    """The squared distance and whether it exceeds ``bound``."""
    d = squared_l2(a, b)
    return d, d > F.lit(bound)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """The unit vector; null for a zero vector."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def scale(v: Column, by: float) -> Column:
    return F.transform(v, lambda x: x.cast("double") * F.lit(by))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def sign_words(v: Column, threshold: Column | float = 0.0, dim: int = 64) -> Column:
    """Bits ``x >= threshold`` packed 64 to a word, the first element in the lowest bit."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    words = []
    for lo in range(0, dim, 64):
        bits = F.transform(F.slice(v, lo + 1, min(64, dim - lo)), lambda x, i: F.when(x.cast("double") >= t, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        words.append(F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x)))
    return F.array(*words)


def valid(v: Column, dim: int) -> Column:
    """Not null, of ``dim`` elements, all finite. Never null."""
    ok = v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(ok, F.lit(False))


def score(metric: str, v: Column, q: Column) -> Column:
    """The score by which results are ranked: smaller is better for L2 and Hamming, larger for cosine and dot."""
    return {L2: squared_l2, DOT: dot, COSINE: cosine, HAMMING: hamming}[metric](v, q)


def ascending(metric: str) -> bool:
    return metric in (L2, HAMMING)
