"""Reciprocal-rank fusion of two ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from vektorium.functions import vector as V
from vektorium.operators import lexical, search
from vektorium.operators.filters import Filter


def rrf(a: DataFrame, b: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """``id, score, rank`` from two lists of ``id, rank``: the sum of 1 / (rrf_k + rank), ties by id."""
    one = lambda df: df.select("id", (F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))).alias("s"))
    both = one(a).unionByName(one(b)).groupBy("id").agg(F.sum("s").alias("score"))
    top = both.orderBy(F.col("score").desc(), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), "id")).cast("int"))


def hybrid(vectors: DataFrame, texts: DataFrame, query: Sequence[float], words: str, k: int, rrf_k: int = 60, metric: str = V.L2, vec_id: str = "id", vec_col: str = "vector", text_id: str = "id", text_col: str = "text", filters: Sequence[Filter] = (), index: lexical.TextIndex | None = None) -> DataFrame:
    """Vector and lexical search with pools of max(2k, 50), fused. Filters apply to the vector side only.

    With a kept ``index`` the texts aren't read.

    Ids that are not in ``vectors`` are not visible and are dropped after the fusion.
    """
    pool = max(2 * k, 50)
    a = search.knn(vectors, query, pool, metric, vec_id, vec_col, filters).select(F.col(vec_id).alias("id"), "rank")
    hits = lexical.bm25(texts, words, pool, text_id, text_col) if index is None else index.search(words, pool)
    b = hits.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), "id"))).select("id", "rank")
    top = rrf(a, b, k, rrf_k)
    seen = vectors.select(F.col(vec_id).alias("id")).join(F.broadcast(top.select("id")), "id", "left_semi").distinct()  # top: k rows
    return top.join(F.broadcast(seen), "id", "left_semi")
