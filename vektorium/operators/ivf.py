"""k-means partitions as DataFrame operators: one update round, assignment and probing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from vektorium.functions import vector as V
from vektorium.operators.stats import centroids

#: Clusters at most, so that centroids can be broadcast (4,096 x dimension x 8 bytes).
MAX_CLUSTERS = 4096
#: Rows at most that centroids are fitted to on the driver.
TRAIN_ROWS = 65_536


def _bounded(cents: DataFrame) -> DataFrame:
    if cents.limit(MAX_CLUSTERS + 1).count() > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters")
    return F.broadcast(cents)


def nearest_of(x: np.ndarray, cents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest centroid, ties to the first."""
    label, dist = np.zeros(len(x), np.int64), np.zeros(len(x))
    for lo in range(0, len(x), 4096):
        y = x[lo : lo + 4096]
        d = (y * y).sum(1)[:, None] - 2 * y @ cents.T + (cents * cents).sum(1)
        label[lo : lo + 4096] = d.argmin(1)
        dist[lo : lo + 4096] = ((y - cents[label[lo : lo + 4096]]) ** 2).sum(1)
    return label, dist


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A column of valid vectors as doubles (n, dim)."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _assign(batches: Iterator[pa.RecordBatch], at: int, ids: np.ndarray, cents: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        label, dist = nearest_of(matrix(b.column(at), cents.shape[1]), cents)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids[label]), pa.array(dist)], names=[*b.schema.names, "cluster", "cluster_distance"])


def assign(df: DataFrame, cents: DataFrame, vec: str, dim: int) -> DataFrame:
    """Adds ``cluster`` and ``cluster_distance``: the nearest centroid by squared L2, ties to the least id.

    ``cents``: cluster, centroid; at most ``MAX_CLUSTERS`` of them are broadcast, and rows are compared with all in one
    matrix product a batch. Rows without a valid vector are left out.
    """
    held = cents.orderBy("cluster").limit(MAX_CLUSTERS + 1).collect()
    if len(held) > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters")
    rows = df.where(V.valid(F.col(vec), dim)).drop("cluster", "cluster_distance")
    schema = T.StructType([*rows.schema.fields, T.StructField("cluster", T.LongType()), T.StructField("cluster_distance", T.DoubleType())])
    if not held:
        return df.sparkSession.createDataFrame([], schema)
    one = df.sparkSession.sparkContext.broadcast((np.array([r["cluster"] for r in held], np.int64), np.array([r["centroid"] for r in held], np.float64)))
    at = rows.columns.index(vec)
    return rows.mapInArrow(lambda it: _assign(it, at, *one.value), schema)


def update(df: DataFrame, cents: DataFrame, vec: str, dim: int) -> DataFrame:
    """One k-means round: ``cluster, n, centroid``; a cluster that loses all rows keeps its centroid with n = 0."""
    new = centroids(assign(df, cents, vec, dim), "cluster", vec, dim)
    old = cents.select("cluster", F.col("centroid").alias("_old"))
    return old.join(new, "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("centroid", "_old").alias("centroid"))


def fit(df: DataFrame, vec: str, dim: int, k: int, rounds: int = 10, id_col: str = "id") -> DataFrame:
    """Centroids after ``rounds`` updates from the ``k`` rows of least id (deterministic)."""
    first = df.where(V.valid(F.col(vec), dim)).orderBy(id_col).limit(k).select(F.col(id_col).alias("cluster"), F.transform(vec, lambda x: x.cast("double")).alias("centroid")).collect()
    cents = df.sparkSession.createDataFrame(first, "cluster long, centroid array<double>")
    for _ in range(rounds):
        rows = update(df, cents, vec, dim).select("cluster", "centroid").collect()  # at most MAX_CLUSTERS rows
        cents = df.sparkSession.createDataFrame(rows, "cluster long, centroid array<double>")
    return cents


def fit_sample(df: DataFrame, vec: str, dim: int, k: int, rounds: int = 20, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Centroids (k, dim) fitted on the driver to at most ``rows`` rows, taken by a hash of the vector."""
    from vektorium.operators.quantize import kmeans, sample

    x = sample(df, vec, dim, rows)
    return kmeans(x, min(k, len(x)), rounds) if len(x) else np.zeros((0, dim))


def probe(cents: DataFrame, query: Sequence[float], n: int = 1) -> list:
    """The ``n`` clusters whose centroids are nearest to the query."""
    d = V.squared_l2(F.col("centroid"), V.literal(query))
    return [r["cluster"] for r in cents.select("cluster", d.alias("d")).orderBy("d", "cluster").limit(n).collect()]


def probes_for(assigned: DataFrame, cents: DataFrame, queries: DataFrame, k: int, dim: int, recall: float, id_col: str = "id", vec_col: str = "vector") -> tuple[int, float]:
    """The least number of probes at which ``queries`` (id, vector) find ``recall`` of their true ``k`` nearest, and the recall it gives.

    The truth is the exact search of all rows; at most one count a cluster reaches the driver.
    """
    from vektorium.operators.search import knn_batch

    truth = knn_batch(assigned, queries, k, dim, V.L2, id_col, vec_col).select("query_id", F.col("id").alias("_id"))
    one = _bounded(cents).agg(F.collect_list(F.struct("cluster", "centroid")).alias("_c"))
    i, v = (F.col(c) for c in queries.columns[:2])
    near = F.array_sort(F.transform("_c", lambda c: F.struct(V.squared_l2(v, c["centroid"]).alias("d"), c["cluster"].alias("cluster"))))
    order = queries.crossJoin(F.broadcast(one)).select(i.alias("query_id"), F.transform(near, lambda c: c["cluster"]).alias("_order"))
    at = truth.join(assigned.select(F.col(id_col).alias("_id"), "cluster"), "_id").join(order, "query_id").select(F.expr("array_position(_order, cluster)").alias("at"))
    n = {r["at"]: r["n"] for r in at.groupBy("at").agg(F.count("*").alias("n")).collect()}
    total, found, p = sum(n.values()), 0, 0
    while p == 0 or (found < recall * total and p < MAX_CLUSTERS):
        p += 1
        found += n.get(p, 0)
    return p, found / total if total else 1.0


def search(assigned: DataFrame, cents: DataFrame, query: Sequence[float], k: int, probes: int = 1, id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """Search the probed clusters only. On a table partitioned by ``cluster`` the filter prunes its files."""
    from vektorium.operators.search import knn

    return knn(assigned.where(F.col("cluster").isin(probe(cents, query, probes))), query, k, V.L2, id_col, vec_col)


def search_exact(assigned: DataFrame, cents: DataFrame, query: Sequence[float], k: int, probes: int = 1, id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """The exact ``k`` nearest from as few clusters as their balls allow.

    ``assigned`` has ``cluster`` and ``cluster_distance`` (squared). The ``probes`` nearest clusters bound the k-th distance;
    then every cluster whose ball, its largest distance around the centroid, reaches within that bound is searched.
    """
    from vektorium.operators.search import knn

    balls = assigned.groupBy("cluster").agg(F.max("cluster_distance").alias("r"), F.count("*").alias("n"))
    d = F.sqrt(V.squared_l2(F.col("centroid"), V.literal(query)))
    near = cents.join(balls, "cluster").select("cluster", d.alias("d"), F.sqrt("r").alias("r")).orderBy("d", "cluster").collect()  # at most MAX_CLUSTERS rows
    if not near:
        return knn(assigned, query, k, V.L2, id_col, vec_col)
    first = knn(assigned.where(F.col("cluster").isin([c["cluster"] for c in near[:probes]])), query, k, V.L2, id_col, vec_col).agg(F.max("score"), F.count("*")).first()
    bound = float("inf") if first[1] < k else first[0] ** 0.5
    reach = [c["cluster"] for c in near if c["d"] - c["r"] <= bound * (1 + 1e-9) + 1e-9]
    return knn(assigned.where(F.col("cluster").isin(reach)), query, k, V.L2, id_col, vec_col)
