"""Records in a log of versions: the latest at a point, tombstones, and set operations on ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W


def latest(log: DataFrame, id_col: str, order: list[str], at: Column | None = None) -> DataFrame:
    """The last row of each id by ``order``, of the rows that satisfy ``at``; null ids are ignored."""
    rows = log.where(F.col(id_col).isNotNull())
    rows = rows.where(at) if at is not None else rows
    w = W.partitionBy(id_col).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def visible(log: DataFrame, id_col: str, order: list[str], deleted: Column, at: Column | None = None) -> DataFrame:
    """Latest rows that are no deletes."""
    return latest(log, id_col, order, at).where(~F.coalesce(deleted, F.lit(False)))


def without(rows: DataFrame, tombstones: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id has no tombstone."""
    return rows.join(tombstones.select(id_col).where(F.col(id_col).isNotNull()), id_col, "left_anti")


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def only_one(a: DataFrame, b: DataFrame) -> DataFrame:
    """Symmetric difference, in one aggregation instead of two anti-joins."""
    cols = a.columns
    tagged = a.distinct().withColumn("_s", F.lit(1)).unionByName(b.distinct().withColumn("_s", F.lit(2)))
    return tagged.groupBy(*cols).agg(F.sum("_s").alias("_s")).where("_s < 3").select(*cols)
