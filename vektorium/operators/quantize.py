"""Vector quantizers. Codes narrow the search; results are always scored again with the stored vectors.

Closed-form quantizers (8-bit and 4-bit scalar, sign bits, sign bits with norms) are column expressions
over per-dimension statistics; product quantizers train on the driver from a bounded sample and encode
in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vektorium.functions import vector as V

#: Rows at most that a product quantizer is trained on.
TRAIN_ROWS = 65_536


def ranges(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """One row: ``lo`` and ``hi`` arrays with the least and largest element of each dimension."""
    v = df.where(V.valid(F.col(vec), dim))
    s = v.agg(*(F.min(F.col(vec)[i].cast("double")).alias(f"l{i}") for i in range(dim)), *(F.max(F.col(vec)[i].cast("double")).alias(f"h{i}") for i in range(dim)))
    return s.select(F.array(*(f"l{i}" for i in range(dim))).alias("lo"), F.array(*(f"h{i}" for i in range(dim))).alias("hi"))


def with_ranges(df: DataFrame, vec: str, dim: int) -> DataFrame:
    return df.where(V.valid(F.col(vec), dim)).crossJoin(F.broadcast(ranges(df, vec, dim)))  # one row


def _top(lo: Column, hi: Column, equal: float) -> Column:
    return F.zip_with(lo, hi, lambda a, b: F.when(a == b, a + equal).otherwise(b))


def sq8_encode(v: Column, lo: Column, hi: Column) -> Column:
    """``floor(255 (clamp(x) - lo) / (hi - lo) + 0.5)`` for each dimension; equal bounds widen by 1e-6."""
    top = _top(lo, hi, 1e-6)
    share = F.zip_with(F.zip_with(v, F.arrays_zip(lo.alias("a"), top.alias("b")), lambda x, r: (F.least(F.greatest(x.cast("double"), r["a"]), r["b"]) - r["a"]) * 255.0 / (r["b"] - r["a"])), lo, lambda s, _: F.floor(s + 0.5).cast("int"))
    return share


def sq8_decode(codes: Column, lo: Column, hi: Column) -> Column:
    return F.zip_with(codes, F.arrays_zip(lo.alias("a"), _top(lo, hi, 1e-6).alias("b")), lambda c, r: c * (r["b"] - r["a"]) / 255.0 + r["a"])


def sq8_matrix(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The codes of ``sq8_encode`` for the rows of a matrix."""
    top = np.where(hi == lo, lo + 1e-6, hi)
    return np.floor((np.clip(x, lo, top) - lo) * 255.0 / (top - lo) + 0.5).astype(np.uint8)


def sq8_partitions(batches: Iterator[pa.RecordBatch], at: int, cents: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds ``code`` and ``cluster`` to rows whose vector is column ``at``."""
    from vektorium.operators.ivf import matrix, nearest_of

    for b in batches:
        x = matrix(b.column(at), len(lo))
        codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(lo)), len(x), [None, pa.py_buffer(sq8_matrix(x, lo, hi).tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns, codes, pa.array(nearest_of(x, cents)[0])], names=[*b.schema.names, "code", "cluster"])


def sq8_scores(batches: Iterator[pa.RecordBatch], query: np.ndarray, lo: np.ndarray, hi: np.ndarray, metric: str, most: int) -> Iterator[pa.RecordBatch]:
    """(id, code) -> the ``most`` best ids of a batch and their approximate scores, least first, from codes alone."""
    step = np.where(hi == lo, 1e-6, hi - lo) / 255.0
    for b in batches:
        if not len(b):
            continue
        x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(len(b), -1).astype(np.float32)
        if metric == V.L2:
            s = ((x * step.astype(np.float32) - (query - lo).astype(np.float32)) ** 2).sum(1)
        else:
            s = -(x @ (step * query).astype(np.float32)) - float(lo @ query)
            if metric == V.COSINE:
                s /= np.maximum(np.sqrt(((x * step.astype(np.float32) + lo.astype(np.float32)) ** 2).sum(1)), 1e-30)
        top = np.argpartition(s, most - 1)[:most] if most < len(s) else np.arange(len(s))
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(top)), pa.array(s[top].astype(np.float64))], names=["id", "approx"])


def int4_encode(v: Column, lo: Column, hi: Column) -> Column:
    """``round(15 clamp((x - lo) / (hi - lo)))``, two codes a byte, the first in the high half."""
    nib = F.zip_with(v, F.arrays_zip(lo.alias("a"), hi.alias("b")), lambda x, r: F.floor(F.least(F.greatest((x.cast("double") - r["a"]) / F.when(r["b"] == r["a"], 1.0).otherwise(r["b"] - r["a"]), F.lit(0.0)), F.lit(1.0)) * 15.0 + 0.5).cast("int"))
    pairs = F.sequence(F.lit(0), F.ceil(F.size(nib) / 2).cast("int") - 1)
    return F.transform(pairs, lambda i: F.element_at(nib, i * 2 + 1) * 16 + F.coalesce(F.try_element_at(nib, i * 2 + 2), F.lit(0)))


def int4_decode(codes: Column, lo: Column, hi: Column) -> Column:
    nib = F.flatten(F.transform(codes, lambda c: F.array(F.floor(c / 16).cast("int"), c % 16)))
    return F.zip_with(F.slice(nib, F.lit(1), F.size(lo)), F.arrays_zip(lo.alias("a"), hi.alias("b")), lambda c, r: r["a"] + c / 15.0 * F.when(r["b"] == r["a"], 1.0).otherwise(r["b"] - r["a"]))


def rabitq_distance(hamming: Column, norm_a: Column, norm_b: Column, dim: int) -> Column:
    """Squared distance from sign bits and norms: (|a| - |b|)^2 + 4 |a| |b| hamming / dim."""
    return (norm_a - norm_b) * (norm_a - norm_b) + 4 * norm_a * norm_b * hamming / dim


def sign_bound(words: Column, norm: Column, query: Sequence[float]) -> Column:
    """The least squared distance to ``query`` of any vector with these sign bits and this norm.

    Its dot product with the query is at most ``norm`` times the norm of the query over the dimensions where signs agree.
    """
    bit = lambda i: F.call_function("shiftright", F.get(words, (i / 64).cast("int")), i % 64).bitwiseAND(F.lit(1).cast("long"))
    agree = F.aggregate(F.transform(V.literal(query), lambda y, i: F.when((y >= 0).cast("long") == bit(i), y * y).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return norm * norm + float(np.dot(query, query)) - 2 * norm * F.sqrt(agree)


def rabitq_search(df: DataFrame, query: Sequence[float], k: int, refine: int, id_col: str, vec_col: str) -> DataFrame:
    """``id, score, rank``: the exact ``k`` nearest, whatever the table's size.

    The best ``k * refine`` by sign bits and norms, scored exactly, bound the k-th distance; then every row that
    ``sign_bound`` does not put beyond it is scored exactly.
    """
    from vektorium.operators.search import knn, rerank

    dim, q = len(query), np.array(query, np.float64)
    one = V.literal(query)
    code = df.where(V.valid(F.col(vec_col), dim)).withColumn("_w", V.sign_words(F.col(vec_col), dim=dim)).withColumn("_n", V.norm(F.col(vec_col)))
    approx = rabitq_distance(V.hamming(F.col("_w"), V.sign_words(one, dim=dim)), F.col("_n"), F.lit(float(np.sqrt(q @ q))), dim)
    near = code.select(id_col, approx.alias("_a")).orderBy("_a", id_col).limit(k * refine)
    worst = rerank(near, df, query, k, V.L2, id_col, vec_col).agg(F.max("score")).first()[0]
    if worst is None:
        return knn(df, query, k, V.L2, id_col, vec_col)
    slack = 1e-9 * (F.col("_n") * F.col("_n") + float(q @ q))  # rounding never loses a row
    return knn(code.where(sign_bound(F.col("_w"), F.col("_n"), query) <= F.lit(worst) + slack), query, k, V.L2, id_col, vec_col)


def kmeans(x: np.ndarray, k: int, rounds: int = 20, seed: int = 3) -> np.ndarray:
    """Centroids with k-means++ starts, seeded; an empty cluster takes the row farthest from its centroid."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = [x[rng.integers(len(x))]]
    d = ((x - c[0]) ** 2).sum(1)
    for _ in range(k - 1):
        p = d / d.sum() if d.sum() > 0 else None
        c.append(x[rng.choice(len(x), p=p)])
        d = np.minimum(d, ((x - c[-1]) ** 2).sum(1))
    c = np.array(c)
    for _ in range(rounds):
        dist = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
        label = dist.argmin(1)
        new = np.array([x[label == j].mean(0) if (label == j).any() else x[dist.min(1).argmax()] for j in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return c


@dataclass
class ProductQuantizer:
    """One codebook of up to 256 centroids for each of ``m`` slices, optionally after a rotation (OPQ)."""

    books: list[np.ndarray]
    rotation: np.ndarray | None = None

    @classmethod
    def train(cls, x: np.ndarray, m: int, k: int = 256, rotate: bool = False, rounds: int = 4, seed: int = 3) -> ProductQuantizer:
        if x.shape[1] % m:
            raise ValueError("the dimension must be a multiple of the number of slices")
        r = np.eye(x.shape[1]) if rotate else None
        books: list[np.ndarray] = []
        for _ in range(rounds if rotate else 1):
            y = x @ r if r is not None else x
            books = [kmeans(p, k, seed=seed) for p in np.split(y, m, axis=1)]
            if r is not None:
                approx = cls(books)._rebuild(cls(books)._codes(y))
                u, _, vt = np.linalg.svd(x.T @ approx)
                r = u @ vt
        return cls(books, r)

    def _codes(self, y: np.ndarray) -> np.ndarray:
        return np.stack([((p * p).sum(1)[:, None] - 2 * p @ b.T + (b * b).sum(1)).argmin(1) for p, b in zip(np.split(y, len(self.books), axis=1), self.books)], 1).astype(np.uint8)

    def _rebuild(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], 1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return self._codes(x @ self.rotation if self.rotation is not None else x)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        y = self._rebuild(codes)
        return y @ self.rotation.T if self.rotation is not None else y

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of a query's slices to all centroids (m, k)."""
        y = q @ self.rotation if self.rotation is not None else q
        return np.stack([((b - p) ** 2).sum(1) for p, b in zip(np.split(y, len(self.books)), self.books)])


def _encode_pq(batches: Iterator[pa.RecordBatch], pq: ProductQuantizer) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not len(b):
            continue
        x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(b), -1)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bytes(c) for c in pq.encode(x)], pa.binary())], names=["id", "code"])


def _adc(batches: Iterator[pa.RecordBatch], table: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not len(b):
            continue
        codes = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(len(b), -1)
        d = table[np.arange(table.shape[0]), codes].sum(1)
        top = np.argsort(d, kind="stable")[:k]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(top)), pa.array(d[top])], names=["id", "approx"])


def sample(df: DataFrame, vec: str, dim: int, rows: int = TRAIN_ROWS) -> np.ndarray:
    """At most ``rows`` valid vectors, taken by a threshold on a hash of the vector: no rows are sorted, and their order doesn't count."""
    v = df.where(V.valid(F.col(vec), dim)).select(vec)
    share = min(1.0, 0.9 * rows / max(1, v.count()))
    got = v.where(F.pmod(F.xxhash64(vec), F.lit(1 << 30)) < int(share * (1 << 30))).limit(rows).toArrow().column(0).combine_chunks()
    return got.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def train_pq(df: DataFrame, vec: str, dim: int, m: int, k: int = 256, rotate: bool = False) -> ProductQuantizer:
    """Train on at most ``TRAIN_ROWS`` rows."""
    return ProductQuantizer.train(sample(df, vec, dim), m, k, rotate)


def pq_search(df: DataFrame, pq: ProductQuantizer, query: Sequence[float], k: int, refine: int, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """``id, score, rank``: the best ``k * refine`` by table lookups, scored again with the stored vectors."""
    from vektorium.operators.search import rerank

    held = df.sparkSession.sparkContext.broadcast(pq)
    codes = df.where(V.valid(F.col(vec_col), dim)).select(F.col(id_col).cast("long").alias("id"), vec_col).mapInArrow(lambda it: _encode_pq(it, held.value), "id long, code binary")
    table = pq.tables(np.array(query, np.float64))
    near = codes.mapInArrow(lambda it: _adc(it, table, k * refine), "id long, approx double").orderBy("approx", "id").limit(k * refine)
    return rerank(near.select(F.col("id").alias(id_col)), df, query, k, V.L2, id_col, vec_col)
