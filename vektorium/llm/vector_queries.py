"""Groups and nearest neighbours of the live records of ``batch_ops``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vektorium.llm import grouping, neighbours, postings, vectors
from vektorium.sources.tables import read, stored

K, FOUND = 5, 0.975


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(vectors.live_records(read(spark, sf_dir, "batch_ops")), "live")


def _indexed(live: DataFrame) -> tuple[postings.Lists, DataFrame]:
    lists = postings.build(live)
    return lists, stored(postings.index(vectors.copy_classes(live), lists), "index")


def _grouped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    live = _live(spark, sf_dir)
    lists, index = _indexed(live)
    return grouping.members_of(grouping.groups(live, index, lists), live, index), live


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir)[0].select("id", "group_id")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group with its size and its five most typical ids."""
    return grouping.typical(*_grouped(spark, sf_dir), 5)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = _live(spark, sf_dir)
    _, index = _indexed(live)
    near = neighbours.all_neighbours(live, index, K, FOUND)
    return near.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def _nearest(live: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """``id_a, id_b, sim, rank``: the 5 nearest of the queries (all live records if there are none) without a threshold."""
    lists = postings.build(live)
    index = stored(postings.wide_index(vectors.copy_classes(live), lists, queries), "index")
    near = neighbours.all_neighbours(live, index, K)
    if queries is not None:  # copies of a query are found with it
        near = near.join(queries.select(F.col("id").alias("id_a")), "id_a", "left_semi")
    w = Window.partitionBy("id_a").orderBy(F.col("sim").desc(), "id_b")
    return near.select("id_a", "id_b", F.round("sim", 4).alias("sim"), F.row_number().over(w).alias("rank"))


def p5_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every live record whose id is divisible by 100, among all live records."""
    live = _live(spark, sf_dir)
    return _nearest(live, live.where("id % 100 = 0"))


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every live record, by the same search as ``p5_queries``."""
    return _nearest(_live(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p5_found, p5_queries, p5_neighbours)}
SQL: dict[str, str] = {}
