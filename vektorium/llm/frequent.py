"""Most frequent values of a column by combinatorial group testing.

Every partition of the input fills one sketch a group: ``depth`` rows of ``width`` buckets, each
bucket holding how many values fell into it and, for each of the 64 bits of the value's fingerprint,
how many of those had the bit set. Sketches add, so the partitions' sketches are summed bucket by
bucket (``groups x depth x width`` rows whatever the input). A value that makes up more than half
of a bucket is read straight off the bit counters: bit j of its fingerprint is set iff more than
half of the bucket's total has it. The decoded fingerprints, at most ``groups x depth x width``, are
then verified by an exact count of the values that carry them.

With ``width >= 4 / share`` a value of at least ``share`` dominates its bucket in one of ``depth``
independent rows unless in every row other values of together ``share`` or more collide with it; by
Markov's inequality that has probability at most (1/4) ** depth a value (1 in 4,000 for depth 6,
and far less on skewed data, where few values hold most of the mass).

Nulls are no values; the empty string is one; strings are equal if their bytes are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

SKETCH = "grp string, row int, bucket int, total long, bits array<long>"


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), different for every seed."""
    x = (x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)).astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch_partition(batches: Iterator[pa.RecordBatch], depth: int, width: int) -> Iterator[pa.RecordBatch]:
    """Fold a partition of (grp, fingerprint) rows into one sketch a group and emit its used buckets."""
    totals: dict[str, np.ndarray] = {}
    bits: dict[str, np.ndarray] = {}
    shifts = np.arange(64, dtype=np.uint64)
    for b in batches:
        enc = b.column(0).dictionary_encode()
        codes = enc.indices.to_numpy(zero_copy_only=False)
        prints = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        for k, g in enumerate(enc.dictionary.to_pylist()):
            values, counts = np.unique(prints[codes == k], return_counts=True)
            if g not in totals:
                totals[g], bits[g] = np.zeros((depth, width), np.int64), np.zeros((depth, width, 64), np.int64)
            for at in range(0, len(values), 65536):
                v, n = values[at : at + 65536], counts[at : at + 65536]
                weighted = ((v[:, None] >> shifts) & np.uint64(1)).astype(np.int64) * n[:, None]
                for r in range(depth):
                    where = (_mix(v, r) % np.uint64(width)).astype(np.int64)
                    order = np.argsort(where, kind="stable")
                    cut = np.flatnonzero(np.diff(where[order], prepend=-1))
                    used = where[order][cut]
                    totals[g][r, used] += np.add.reduceat(n[order], cut)
                    bits[g][r, used] += np.add.reduceat(weighted[order], cut, axis=0)
    for g in totals:
        r, w = np.nonzero(totals[g])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([g] * len(r), pa.string()), pa.array(r.astype(np.int32)), pa.array(w.astype(np.int32)), pa.array(totals[g][r, w]),
                pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * 64), pa.array(bits[g][r, w].ravel())),
            ],
            names=["grp", "row", "bucket", "total", "bits"],
        )


def group_sketch(values: DataFrame, grp: str, value: str, depth: int = 6, width: int = 512) -> DataFrame:
    """The summed sketch of ``value`` by ``grp``: ``grp, row, bucket, total, bits``.

    Sketches of other days or tables of the same depth and width may be united with it and summed
    by ``merge_sketches``.
    """
    prints = values.where(F.col(value).isNotNull() & F.col(grp).isNotNull()).select(F.col(grp).cast("string").alias("grp"), F.xxhash64(value).alias("fingerprint"))
    return merge_sketches(prints.mapInArrow(lambda it: sketch_partition(it, depth, width), SKETCH))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    bits = [F.sum(F.col("bits")[j]).alias(f"b{j}") for j in range(64)]
    return sketches.groupBy("grp", "row", "bucket").agg(F.sum("total").alias("total"), *bits).select("grp", "row", "bucket", "total", F.array(*(f"b{j}" for j in range(64))).alias("bits"))


def decode(sketch: DataFrame, share: float) -> DataFrame:
    """Fingerprints that dominate a bucket and may reach ``share``: ``grp, fingerprint, est``.

    ``est`` is the least, over the rows that yield the fingerprint, of what its bucket can hold of it
    (the smallest counter among its set bits and, for unset bits, total minus counter), so it never
    lies below the true count in a row where it dominates.
    """
    # every value falls into one bucket of each row, so any row sums to the group's count
    rows = sketch.withColumn("n", F.sum("total").over(W.partitionBy("grp", "row")))
    heavy = rows.where(F.col("total") >= F.lit(share) * F.col("n"))
    fingerprint = F.lit(0).cast("long")
    for j in range(64):
        fingerprint = fingerprint.bitwiseOR(F.when(F.col("bits")[j] * 2 > F.col("total"), F.lit((1 << j) if j < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    least = F.array_min(F.transform("bits", lambda b: F.greatest(b, F.col("total") - b)))
    return heavy.select("grp", "n", fingerprint.alias("fingerprint"), least.alias("est")).groupBy("grp", "fingerprint").agg(F.min("est").alias("est"), F.max("n").alias("n"))


def frequent_values(values: DataFrame, grp: str, value: str, share: float, depth: int = 6, width: int | None = None) -> DataFrame:
    """Values of at least ``share`` of their group's values: ``grp, value, est, n_exact, n_group``.

    ``values`` is read twice (sketch, then verification), so pass a stored table. The candidates
    are bounded by the sketch (at most ``depth / share`` a group), hence broadcast.
    """
    candidates = decode(group_sketch(values, grp, value, depth, width or max(64, int(5 / share))), share)
    rows = values.where(F.col(value).isNotNull() & F.col(grp).isNotNull()).select(F.col(grp).cast("string").alias("grp"), F.col(value).alias("value"), F.xxhash64(value).alias("fingerprint"))
    exact = rows.join(F.broadcast(candidates), ["grp", "fingerprint"]).groupBy("grp", "value").agg(F.first("est").alias("est"), F.count("*").alias("n_exact"), F.first("n").alias("n_group"))
    return exact.where(F.col("n_exact") >= F.lit(share) * F.col("n_group"))


def latest_rows(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key, the one that ranks first by ``order`` descending (nulls last); null keys are dropped."""
    for k in key:
        df = df.where(F.col(k).isNotNull())
    w = W.partitionBy(*key).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_values(values: DataFrame, grp: str, value: str, k: int, share: float) -> DataFrame:
    """The ``k`` most frequent values of each group among those of at least ``share``: adds ``rank``."""
    w = W.partitionBy("grp").orderBy(F.col("n_exact").desc(), "value")
    return frequent_values(values, grp, value, share).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
