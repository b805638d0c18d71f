"""Percentiles with a bounded relative error from signed logarithmic buckets.

A value x falls into bucket ``sign(x) * ceil(log_gamma(|x|))`` with ``gamma = (1 + a) / (1 - a)``:
all values of a bucket lie within the factor gamma, and ``2 * gamma ** i / (gamma + 1)`` differs from
each of them by at most the share ``a`` of its size. Zeros (and anything below ``TINY``) have a bucket
of their own. Counts of equal buckets add, so sketches of partitions, days or collections combine
without further error. The q-quantile is the value of the bucket that holds rank ``floor(q (n-1))``
(counted from 0), hence within ``a`` of the exact lower quantile.

Nulls, NaN and infinities are ignored; a group without numbers has no row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

TINY = 1e-12
OFFSET = 1 << 20


def bucket_of(x: Column, accuracy: float) -> Column:
    """The signed bucket of a finite double; buckets order as the values do. Null for null, NaN and infinities."""
    log_gamma = math.log((1 + accuracy) / (1 - accuracy))
    size = (F.ceil(F.log(F.abs(x)) / log_gamma) + F.lit(OFFSET)).cast("int")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, F.when(F.abs(x) < TINY, F.lit(0)).when(x > 0, size).otherwise(-size))


def value_of(bucket: Column, accuracy: float) -> Column:
    """The value that stands for a bucket."""
    gamma = (1 + accuracy) / (1 - accuracy)
    size = F.pow(F.lit(gamma), (F.abs(bucket) - OFFSET).cast("double")) * (2 / (gamma + 1))
    return F.when(bucket == 0, F.lit(0.0)).when(bucket > 0, size).otherwise(-size)


def sketch(df: DataFrame, keys: Sequence[str], value: str, accuracy: float = 0.01) -> DataFrame:
    """Bucket counts: ``*keys, bucket, n``. Partial counts are made before the shuffle."""
    b = df.select(*keys, bucket_of(F.col(value).cast("double"), accuracy).alias("bucket")).where("bucket IS NOT NULL")
    return b.groupBy(*keys, "bucket").agg(F.count("*").alias("n"))


def combine(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add sketches: to coarser keys, or those of several days or partitions united."""
    return sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: Sequence[str], qs: Sequence[float], accuracy: float = 0.01) -> DataFrame:
    """``*keys, n, q<percent>...``: one row a group, from its (at most few thousand) buckets."""
    up = W.partitionBy(*keys).orderBy("bucket")
    cum = sketches.withColumn("_c", F.sum("n").over(up)).withColumn("_n", F.sum("n").over(W.partitionBy(*keys)))
    # sums over groups need no floor: the smallest bucket whose cumulative count exceeds the rank
    picks = [F.min(F.when(F.col("_c") > F.floor(F.lit(q) * (F.col("_n") - 1)), F.col("bucket"))).alias(f"_b{i}") for i, q in enumerate(qs)]
    out = cum.groupBy(*keys).agg(F.max("_n").alias("n"), *picks)
    return out.select(*keys, "n", *(value_of(F.col(f"_b{i}"), accuracy).alias(f"q{q * 100:g}".replace(".", "_")) for i, q in enumerate(qs)))
