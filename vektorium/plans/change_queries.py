"""Queries over snapshot histories, with the SQL they are compared with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vektorium.operators import changes
from vektorium.sources.tables import read, shared_dir, stored

KEY, VALUES = ["segment_id"], ["seg_level", "row_count", "live_rows", "seg_path", "size_bytes", "min_id", "max_id", "deleted_ratio"]
ARGS = ("store_id", "manifest_id", KEY, VALUES, "delivered_at")


#: The history is taken in so many deliveries, each probing the index that the one before it left.
DELIVERIES = 3


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions of all stores, delivered to a fresh index in ``DELIVERIES`` parts of each store's history."""
    rows, versions = read(spark, sf_dir, "manifest_segments"), read(spark, sf_dir, "manifests")
    index = changes.SnapshotIndex(spark, f"{shared_dir(spark)}/p2-{uuid.uuid4().hex}", ["segment_id"], VALUES, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    ords = stored(changes.version_ordinals(versions, "store_id", "manifest_id").select("store_id", "manifest_id", "ord", (F.max("ord").over(Window.partitionBy("store_id"))).alias("n")), "ords")
    entries = stored(changes.history_entries(rows, *ARGS), "entries")
    out = None
    for k in range(1, DELIVERIES + 1):
        so_far = ords.where(F.col("ord") <= F.ceil(F.col("n") * k / DELIVERIES))
        found = index.apply_history(entries, so_far, "store_id", "manifest_id")
        out = found if out is None else out.unionByName(found)
    return out


def _at_once(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, versions = read(spark, sf_dir, "manifest_segments"), read(spark, sf_dir, "manifests")
    return changes.consecutive_changes(rows, versions, *ARGS), rows, versions


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new size and live rows of every changed segment."""
    both = changes.with_values(*_at_once(spark, sf_dir), *ARGS)
    return both.select("store_id", "manifest_id", "segment_id", *(F.col(f"{side}.{c}").alias(f"{side}_{c}") for c in ("size_bytes", "live_rows") for side in ("old", "new")))


def p2_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each kind by manifest."""
    return _at_once(spark, sf_dir)[0].groupBy("store_id", "manifest_id", "change_type").agg(F.count("*").alias("n"))


_BASE = """
WITH v AS (SELECT DISTINCT store_id, manifest_id FROM manifests WHERE store_id IS NOT NULL AND manifest_id IS NOT NULL),
o AS (SELECT *, lag(manifest_id) OVER w AS prev_id FROM v WINDOW w AS (PARTITION BY store_id ORDER BY manifest_id)),
s AS (SELECT *, row_number() OVER (PARTITION BY store_id, manifest_id, segment_id ORDER BY delivered_at DESC NULLS LAST) AS rn
      FROM manifest_segments WHERE store_id IS NOT NULL AND manifest_id IS NOT NULL AND segment_id IS NOT NULL),
c AS (SELECT * FROM s WHERE rn = 1),
n AS (SELECT c.*, o.prev_id FROM c JOIN o USING (store_id, manifest_id) WHERE o.prev_id IS NOT NULL),
p AS (SELECT c.*, o.manifest_id AS next_id FROM c JOIN o ON o.store_id = c.store_id AND o.prev_id = c.manifest_id),
found AS (
SELECT coalesce(n.store_id, p.store_id) AS store_id, coalesce(n.manifest_id, p.next_id) AS manifest_id, coalesce(n.segment_id, p.segment_id) AS segment_id,
  CASE WHEN p.segment_id IS NULL THEN 'added' WHEN n.segment_id IS NULL THEN 'removed'
       WHEN n.seg_level IS DISTINCT FROM p.seg_level OR n.row_count IS DISTINCT FROM p.row_count OR n.live_rows IS DISTINCT FROM p.live_rows
         OR n.seg_path IS DISTINCT FROM p.seg_path OR n.size_bytes IS DISTINCT FROM p.size_bytes OR n.min_id IS DISTINCT FROM p.min_id
         OR n.max_id IS DISTINCT FROM p.max_id OR n.deleted_ratio IS DISTINCT FROM p.deleted_ratio THEN 'changed' END AS change_type,
  p.size_bytes AS old_size_bytes, n.size_bytes AS new_size_bytes, p.live_rows AS old_live_rows, n.live_rows AS new_live_rows
FROM n FULL OUTER JOIN p ON n.store_id = p.store_id AND n.segment_id = p.segment_id AND n.manifest_id = p.next_id)
"""

QUERIES = {"p2_found": p2_found, "p2_values": p2_values, "p2_summary": p2_summary}

SQL = {
    "p2_found": _BASE + "SELECT store_id, manifest_id, segment_id, change_type FROM found WHERE change_type IS NOT NULL",
    "p2_values": _BASE + "SELECT store_id, manifest_id, segment_id, old_size_bytes, new_size_bytes, old_live_rows, new_live_rows FROM found WHERE change_type = 'changed'",
    "p2_summary": _BASE + "SELECT store_id, manifest_id, change_type, count(*) AS n FROM found WHERE change_type IS NOT NULL GROUP BY 1, 2, 3",
}
