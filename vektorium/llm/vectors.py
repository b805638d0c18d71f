"""Live records of a write log, as unit vectors in half precision, and their exact copies.

Operations take effect in ``lsn`` order, each ``lsn`` once. An insert whose vector is not ``dim``
finite numbers with at least one other than 0 is rejected and changes nothing; any other insert sets
the record ``id``; a delete removes it. Rows with a null id, lsn or kind are ignored.

Records are compared by direction, so a vector is kept as the unit vector in 16-bit floats
(``2 * dim`` bytes; a cosine computed from two of them is off by less than 0.0005). Records whose
codes are equal are copies of each other: they form a class that later stages see as one row, so a
group of copies of any size costs one row, and it is expanded only in results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

DIM = 64
#: A class of so many rows is hot. There are at most (number of rows / HOT) of them, so what is known of hot classes can be broadcast.
HOT = 1 << 16


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that have ``dim`` finite numbers, not all 0: their indices and values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = column.offsets.to_numpy()
    ok = np.diff(off) == dim
    if column.null_count:
        ok &= ~column.is_null().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(ok)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = values[(off[rows][:, None] + np.arange(dim)).ravel()].reshape(-1, dim) if len(rows) else np.zeros((0, dim))
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[good], x[good]


def encode(x: np.ndarray) -> np.ndarray:
    """Unit vectors in half precision; scaled first, so no norm over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    # + 0 turns a negative zero into zero, so copies are equal as bytes
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float16) + np.float16(0)


def codes_to_array(codes: np.ndarray) -> pa.Array:
    n, dim = codes.shape
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * dim), n, [None, pa.py_buffer(np.ascontiguousarray(codes).tobytes())]).cast(pa.binary())


def array_to_codes(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors (n, dim) as float32 from a binary column."""
    if len(column) == 0:
        return np.zeros((0, dim), np.float32)
    start = column.offset
    off = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[start : start + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]]
    return raw.view(np.float16).reshape(-1, dim).astype(np.float32)


def _encode_ops(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, lsn, is_insert, vec = b.columns
        rows, x = _matrix(vec, dim)
        ins = is_insert.to_numpy(zero_copy_only=False).astype(bool)
        keep = ins[rows]
        rows, x = rows[keep], x[keep]
        dels = np.flatnonzero(~ins)
        take = pa.array(np.concatenate([rows, dels]))
        code = pa.concat_arrays([codes_to_array(encode(x)) if len(x) else pa.array([], pa.binary()), pa.nulls(len(dels), pa.binary())])
        yield pa.RecordBatch.from_arrays([ids.take(take), lsn.take(take), code], names=["id", "lsn", "code"])


def live_records(ops: DataFrame, dim: int = DIM) -> DataFrame:
    """``id, code`` of the live records of (lsn, op_type, id, vector) rows."""
    o = ops.where("id IS NOT NULL AND lsn IS NOT NULL AND op_type IN ('insert', 'delete')")
    o = o.select("id", "lsn", (F.col("op_type") == "insert").alias("is_insert"), "vector").mapInArrow(lambda it: _encode_ops(it, dim), "id long, lsn long, code binary")
    return o.groupBy("id").agg(F.max_by("code", "lsn").alias("code")).where("code IS NOT NULL")


def copy_classes(live: DataFrame) -> DataFrame:
    """``rep, n, code``: one row for each distinct code, named by its least id; copies are counted before the shuffle."""
    return live.groupBy("code").agg(F.min("id").alias("rep"), F.count("*").alias("n")).select("rep", "n", "code")


def join_classes(rows: DataFrame, classes: DataFrame, on: list[str], size: str = "n") -> DataFrame:
    """Inner join of rows with one row a class. Hot classes are broadcast, so none of their rows are shuffled to one task."""
    hot = F.broadcast(classes.where(F.col(size) >= HOT).withColumn("_hot", F.lit(True)))
    seen = rows.join(hot, on, "left")
    mine = [c for c in classes.columns if c not in on]
    rest = seen.where("_hot IS NULL").select(*rows.columns).join(classes.where(F.col(size) < HOT), on)
    return seen.where("_hot").select(*rows.columns, *mine).unionByName(rest.select(*rows.columns, *mine))


def class_members(live: DataFrame, classes: DataFrame) -> DataFrame:
    """``rep, n, id`` of the records in classes of two or more; only hashes and ids are shuffled."""
    key = lambda df: (F.xxhash64("code").alias("h1"), F.xxhash64(F.lit(1), "code").alias("h2"))
    several = classes.where("n > 1").select("rep", "n", *key(classes))
    return join_classes(live.select("id", *key(live)), several, ["h1", "h2"]).select("rep", "n", "id")
