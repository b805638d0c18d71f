"""Exact and two-stage k-nearest-neighbour search over array columns.

Results are ordered by score, then id. Rows whose vector is not valid for the dimension never match.
``k`` below 1 is an error; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from vektorium.functions import vector as V
from vektorium.operators.filters import Filter, apply

#: Query vectors held by a task at a time in batch search; larger sets are taken in blocks.
QUERY_BLOCK = 4096


def _ordered(score: Column, metric: str) -> Column:
    return score.asc() if V.ascending(metric) else score.desc()


def _checked_k(k: int) -> int:
    if k < 1:
        raise ValueError("k must be positive")
    return k


def knn(df: DataFrame, query: Sequence[float], k: int, metric: str = V.L2, id_col: str = "id", vec_col: str = "vector", filters: Sequence[Filter] = (), columns: Sequence[str] = ()) -> DataFrame:
    """The ``k`` best rows: ``id, score, rank`` and ``columns``. Filters apply before the search.

    The plan is a scan of the filtered, pruned columns and a top-k in every partition.
    """
    if metric == V.COSINE and not any(query):
        raise ValueError("a zero vector has no direction")
    rows = apply(df, filters).where(V.valid(F.col(vec_col), len(query)))
    scored = rows.select(F.col(id_col), *(c for c in columns if c != id_col), V.score(metric, F.col(vec_col), V.literal(query)).alias("score")).where("score IS NOT NULL")
    top = scored.orderBy(_ordered(F.col("score"), metric), id_col).limit(_checked_k(k))
    return top.withColumn("rank", F.row_number().over(W.orderBy(_ordered(F.col("score"), metric), id_col)).cast("int"))


def knn_threshold(df: DataFrame, query: Sequence[float], threshold: float, most: int, metric: str = V.L2, **kw) -> DataFrame:
    """The ``most`` best, then those of them within the threshold (in that order)."""
    top = knn(df, query, most, metric, **kw)
    return top.where(F.col("score") <= threshold if V.ascending(metric) else F.col("score") >= threshold)


def knn_rows(df: DataFrame, top: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """Late materialisation: the wide columns of the few rows found."""
    return df.select(id_col, *columns).join(F.broadcast(top), id_col)  # top: k rows


def _score_batch(batches: Iterator[pa.RecordBatch], qid: np.ndarray, q: np.ndarray, k: int, metric: str) -> Iterator[pa.RecordBatch]:
    best = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64)
    qq = (q * q).sum(1)
    for b in batches:
        if not len(b):
            continue
        ids = b.column(0).to_numpy()
        col = b.column(1)
        x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(b), -1)
        cross = q @ x.T
        if metric == V.L2:
            s = qq[:, None] - 2 * cross + (x * x).sum(1)
        elif metric == V.COSINE:
            n = np.sqrt((x * x).sum(1))
            s = -cross / np.where(n > 0, n, np.nan) / np.sqrt(qq)[:, None]
            s = np.where(np.isnan(s), np.inf, s)
        else:
            s = -cross
        m = min(k, len(b))
        top = np.argpartition(s, m - 1, axis=1)[:, :m]
        ss, ii = np.concatenate([best[0], np.take_along_axis(s, top, 1)], 1), np.concatenate([best[1], ids[top]], 1)
        keep = np.lexsort((ii, ss), axis=1)[:, :k]
        best = np.take_along_axis(ss, keep, 1), np.take_along_axis(ii, keep, 1)
    r, c = np.nonzero(np.isfinite(best[0]))
    s = best[0][r, c]
    yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(best[1][r, c]), pa.array(s if metric == V.L2 else -s)], names=["query_id", "id", "score"])


def _blocks(queries: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, rows = [], []
    for r in queries.toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == size:
            yield np.array(ids, np.int64), np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(rows, np.float64)


def knn_batch(df: DataFrame, queries: DataFrame, k: int, dim: int, metric: str = V.L2, id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """``query_id, id, score, rank`` for every query of (id, vector) rows.

    Queries are broadcast in blocks of ``QUERY_BLOCK``; each partition keeps the best k of each query and
    only those are shuffled. Scores come from matrix products (compare them with a tolerance).
    """
    _checked_k(k)
    rows = df.where(V.valid(F.col(vec_col), dim)).select(F.col(id_col).cast("long"), vec_col)
    queries = queries.where(V.valid(F.col(queries.columns[1]), dim))
    out = None
    for qid, q in _blocks(queries, QUERY_BLOCK):
        held = df.sparkSession.sparkContext.broadcast((qid, q))
        part = rows.mapInArrow(lambda it, held=held: _score_batch(it, *held.value, k, metric), "query_id long, id long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = df.sparkSession.createDataFrame([], "query_id long, id long, score double")
    w = W.partitionBy("query_id").orderBy(_ordered(F.col("score"), metric), "id")
    return out.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


def rerank(candidates: DataFrame, df: DataFrame, query: Sequence[float], k: int, metric: str, id_col: str, vec_col: str) -> DataFrame:
    """Exact scores of over-fetched candidates, then the best ``k``: ``id, score, rank``."""
    rows = df.select(id_col, vec_col).join(F.broadcast(candidates.select(id_col)), id_col)  # k times the refine factor rows
    return knn(rows, query, k, metric, id_col, vec_col)


def recall(found: DataFrame, truth: DataFrame, k: int, query: str = "query_id", item: str = "id") -> DataFrame:
    """``query_id, recall``: the share of each query's true ``k`` that was found."""
    both = truth.select(query, item).join(found.select(query, item).withColumn("_hit", F.lit(1)), [query, item], "left")
    return both.groupBy(query).agg((F.count("_hit") / F.lit(float(k))).alias("recall"))
