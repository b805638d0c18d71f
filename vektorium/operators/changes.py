"""What changed between full snapshots of a table.

The state kept between deliveries is a bucketed index ``key -> hash of the other columns`` of the
last snapshot (``SnapshotIndex``). New snapshots are reduced to the same narrow form, probe the index bucket by
bucket, and only keys whose hash differs go back to the wide tables for their values. Then the new index replaces
the old one.

``apply`` takes one snapshot of one table and shuffles only it, never the index. ``apply_history`` takes any number
of versions of many tables (groups) at once: the index of each group's last version stands before the new
versions, and each version is probed against the one before it in the same bucket, so a delivery of many
versions costs one shuffle of narrow rows instead of one job a version.

Defined results: null equals null and NaN equals NaN; -0.0 equals 0.0; rows with a null in a key are
ignored; repeated rows count once; an empty snapshot removes everything; extra columns take part
only if named; versions that were applied before, or are older than the index, change nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from vektorium.sources.tables import stored

#: Manifest ordinals are counted in blocks of this many ids, so that no store's versions are sorted in one task.
VERSION_BLOCK = 4096


def row_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    """128 bits over ``columns`` in which nulls keep their place and equal values hash alike."""
    parts: list[Column] = []
    for c in columns:
        kind = df.schema[c].dataType
        col = F.col(c)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            col = F.when(F.isnan(col), F.lit(float("nan")).cast(kind)).otherwise(col + F.lit(0.0).cast(kind))
        parts += [col.isNull(), col]
    return F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(0x5EED), *reversed(parts)).alias("h2"))


def not_null(columns: Sequence[str]) -> Column:
    test = F.lit(True)
    for c in columns:
        test = test & F.col(c).isNotNull()
    return test


def version_ordinals(versions: DataFrame, group: str, version: str) -> DataFrame:
    """``group, version, ord, prev_version, next_version`` for the distinct versions of each group.

    Counted in two levels: within blocks of the id, then over the blocks (``VERSION_BLOCK`` times
    fewer rows), so a group with a third of all versions is spread over many tasks.
    """
    v = versions.where(not_null([group, version])).select(group, version).distinct()
    v = v.withColumn("_block", F.floor(F.col(version) / VERSION_BLOCK))
    in_block = W.partitionBy(group, "_block").orderBy(version)
    v = v.select(
        group, version, "_block",
        F.row_number().over(in_block).alias("_rn"),
        F.lag(version).over(in_block).alias("_prev"),
        F.lead(version).over(in_block).alias("_next"),
    )
    blocks = v.groupBy(group, "_block").agg(F.count("*").alias("_n"), F.min(version).alias("_lo"), F.max(version).alias("_hi"))
    over = W.partitionBy(group).orderBy("_block")
    blocks = blocks.select(
        group, "_block",
        (F.sum("_n").over(over) - F.col("_n")).alias("_before"),
        F.lag("_hi").over(over).alias("_prev_hi"),
        F.lead("_lo").over(over).alias("_next_lo"),
    )
    return v.join(blocks, [group, "_block"]).select(
        group, version,
        (F.col("_before") + F.col("_rn")).alias("ord"),
        F.coalesce("_prev", "_prev_hi").alias("prev_version"),
        F.coalesce("_next", "_next_lo").alias("next_version"),
    )


def history_entries(rows: DataFrame, group: str, version: str, key: Sequence[str], values: Sequence[str], delivered: str) -> DataFrame:
    """``group, *key, version, h``: the narrow form of every version.

    Of a key delivered more than once in one version the latest ``delivered`` holds (null is earliest; among equals the
    largest hash, so the result does not depend on row order).
    """
    full_key = [group, *key]
    narrow = rows.where(not_null([*full_key, version])).select(*full_key, version, F.struct(F.col(delivered).alias("d"), row_hash(rows, values).alias("h")).alias("_e"))
    one = W.partitionBy(*full_key, version).orderBy(F.col("_e").desc())
    return narrow.repartition(*full_key).withColumn("_rn", F.row_number().over(one)).where("_rn = 1").select(*full_key, version, F.col("_e.h").alias("h"))


def probe(entries: DataFrame, ords: DataFrame, group: str, version: str, key: Sequence[str]) -> DataFrame:
    """Changes ``group, version, *key, change_type`` of entries (all versions, clustered by group and key) against the version before each."""
    full_key = [group, *key]
    order = W.partitionBy(*full_key).orderBy(version)
    seen = entries.join(ords, [group, version]).select(
        *full_key, version, "prev_version", "next_version", "h",
        F.lag(version).over(order).alias("_was"), F.lag("h").over(order).alias("_was_h"), F.lead(version).over(order).alias("_will"),
    )
    events = F.array(
        F.when(
            F.col("prev_version").isNotNull(),
            F.when(F.col("_was").isNull() | (F.col("_was") != F.col("prev_version")), F.struct(F.col(version).alias("v"), F.lit("added").alias("c"))).when(
                F.col("_was_h") != F.col("h"), F.struct(F.col(version).alias("v"), F.lit("changed").alias("c"))
            ),
        ),
        F.when(
            F.col("next_version").isNotNull() & (F.col("_will").isNull() | (F.col("_will") != F.col("next_version"))),
            F.struct(F.col("next_version").alias("v"), F.lit("removed").alias("c")),
        ),
    )
    return (
        seen.select(*full_key, F.explode(F.filter(events, lambda e: e.isNotNull())).alias("_x"))
        .select(group, F.col("_x.v").alias(version), *key, F.col("_x.c").alias("change_type"))
    )


def consecutive_changes(
    rows: DataFrame, versions: DataFrame, group: str, version: str, key: Sequence[str], values: Sequence[str], delivered: str
) -> DataFrame:
    """Changes between consecutive versions of every group: ``group, version, *key, change_type``.

    ``rows`` holds the full content of each version, ``versions`` the versions that exist (those
    without rows are empty; rows of a version that is not listed are ignored). The first version of a group has no
    changes.
    """
    return probe(history_entries(rows, group, version, key, values, delivered), version_ordinals(versions, group, version), group, version, key)


def with_values(changes: DataFrame, rows: DataFrame, versions: DataFrame, group: str, version: str, key: Sequence[str], values: Sequence[str], delivered: str) -> DataFrame:
    """Old and new values of changed keys only: ``group, version, *key, old, new`` as structs."""
    full_key = [group, *key]
    prev = version_ordinals(versions, group, version).select(group, version, "prev_version")
    wanted = changes.where("change_type = 'changed'").join(prev, [group, version]).select(*full_key, version, "prev_version")
    at = wanted.select(*full_key, F.col(version).alias("_of"), F.explode(F.array(F.struct(F.col(version).alias("v"), F.lit("new").alias("side")), F.struct(F.col("prev_version").alias("v"), F.lit("old").alias("side")))).alias("_s"))
    at = at.select(*full_key, "_of", F.col("_s.v").alias(version), F.col("_s.side").alias("_side"))
    held = rows.join(at, [*full_key, version])
    held = held.groupBy(*full_key, "_of", "_side").agg(F.max_by(F.struct(*values), F.struct(F.col(delivered).alias("d"), row_hash(rows, values).alias("h"))).alias("v"))
    return held.groupBy(*full_key, "_of").agg(F.max(F.when(F.col("_side") == "old", F.col("v"))).alias("old"), F.max(F.when(F.col("_side") == "new", F.col("v"))).alias("new")).select(
        group, F.col("_of").alias(version), *key, "old", "new"
    )


class SnapshotIndex:
    """The bucketed key-to-hash index of the last snapshot, kept below ``path``.

    ``apply(snapshot)`` and ``apply_history(rows, versions)`` return the changes against the index and put the new
    index in its place. The index of generation g lies in ``path/gen=g`` as a table in ``buckets`` buckets of the key, one
    sorted file each; a generation counts once its ``_SUCCESS`` file is there, so a job that dies half-way leaves the
    earlier index in force. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], values: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.key, self.values, self.buckets = spark, path.rstrip("/"), list(key), list(values), buckets

    def _fs(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(conf), root

    def generation(self) -> int:
        """The newest complete generation; 0 before the first snapshot."""
        jvm, fs, root = self._fs()
        if not fs.exists(root):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [int(n[4:]) for n in names if n.startswith("gen=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return max(done, default=0)

    def _write(self, entries: DataFrame, keys: list[str], generation: int) -> None:
        """Write a generation: every bucket is one file, sorted by the key."""
        name = f"snapshot_index_{uuid.uuid4().hex}"
        out = entries.repartition(self.buckets, *keys).write.format("parquet").mode("overwrite").option("compression", "zstd").option("path", f"{self.path}/gen={generation}")
        out.bucketBy(self.buckets, *keys).sortBy(*keys).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the name only: the files stay

    def read(self, generation: int, schema: T.StructType, keys: list[str] | None = None) -> DataFrame:
        """The index as a bucketed table, so that joins and windows by its key need no shuffle of it."""
        keys, location = keys or self.key, f"{self.path}/gen={generation}"
        name = f"snapshot_index_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        by = ", ".join(f"`{k}`" for k in keys)
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{location}'")
        return self.spark.table(name)

    def entries(self, snapshot: DataFrame) -> DataFrame:
        """The narrow form of a snapshot; of a repeated key the largest hash holds."""
        return snapshot.where(not_null(self.key)).select(*self.key, row_hash(snapshot, self.values).alias("h")).groupBy(*self.key).agg(F.max("h").alias("h"))

    def apply(self, snapshot: DataFrame, old: DataFrame | None = None) -> DataFrame:
        """Swap in ``snapshot``; returns ``*key, change_type`` (with ``old``, the previous snapshot, also struct columns ``old`` and ``new``)."""
        g = self.generation()
        entries = self.entries(snapshot)
        self._write(entries, self.key, g + 1)
        new = self.read(g + 1, entries.schema)
        was = self.read(g, entries.schema) if g else new.limit(0)
        both = was.withColumnRenamed("h", "_old").join(new.withColumnRenamed("h", "_new"), self.key, "full_outer")
        kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
        out = both.select(*self.key, kind.alias("change_type")).where("change_type IS NOT NULL")
        if old is None:
            return out
        pick = lambda df, name: df.where(not_null(self.key)).groupBy(*self.key).agg(F.max_by(F.struct(*self.values), row_hash(df, self.values)).alias(name))
        touched = out.select(*self.key)
        o = pick(old.join(touched, self.key, "left_semi"), "old")
        n = pick(snapshot.join(touched, self.key, "left_semi"), "new")
        return out.join(o, self.key, "left").join(n, self.key, "left")

    def apply_history(self, entries: DataFrame, versions: DataFrame, group: str, version: str) -> DataFrame:
        """Changes in all versions that are newer than the index, as ``consecutive_changes`` gives them; swaps the index.

        ``entries``: the rows of (at least) these versions in narrow form, see ``history_entries``. ``path/heads=g`` keeps
        the last version of every group, also of those whose last version is empty.
        """
        keys, g = [group, *self.key], self.generation()
        listed = versions.where(not_null([group, version])).select(group, version).distinct()
        if g:
            heads = self.spark.read.schema(listed.schema).parquet(f"{self.path}/heads={g}")
            listed = listed.join(heads.withColumnRenamed(version, "_head"), group, "left").where(F.col("_head").isNull() | (F.col(version) > F.col("_head"))).select(group, version)
        ords = stored(version_ordinals(listed if not g else listed.unionByName(heads), group, version), "ords")
        fresh = entries.select(*keys, version, "h").join(ords.select(group, version, "prev_version"), [group, version])
        if g:  # of a group's head the index holds the rows
            fresh = fresh.join(heads, [group, version], "left_anti")
        both = fresh.select(*keys, version, "h")
        if g:
            both = both.unionByName(self.read(g, both.schema, keys))
        last = ords.where("next_version IS NULL").select(group, version)
        self._write(both.join(last, [group, version]).select(*keys, version, "h"), keys, g + 1)
        last.write.mode("overwrite").parquet(f"{self.path}/heads={g + 1}")
        return probe(both, ords, group, version, self.key)

    def drop_before(self, generation: int) -> None:
        """Delete index generations older than ``generation``; the newest always stays."""
        jvm, fs, root = self._fs()
        for g in range(1, min(generation, self.generation())):
            for part in ("gen", "heads"):
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}={g}"), True)
