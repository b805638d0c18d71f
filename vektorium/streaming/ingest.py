"""Streams into a versioned table, and event-time operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from vektorium.operators import policies
from vektorium.sources.store import VectorTable


def to_table(stream: DataFrame, table: VectorTable, checkpoint: str, policy: policies.Policy | None = None, available_now: bool = True) -> StreamingQuery:
    """Commit every micro-batch as one version. Rows are (vector, payload, metadata) and, if there is an
    ``op`` column, deletes are rows whose ``op`` is ``delete`` and whose ``id`` names the record.

    A batch that is replayed after a failure is recognised by its number, kept in the manifest, and skipped.
    """

    def write(batch: DataFrame, number: int) -> None:
        if table.manifest.get("stream_batch", -1) >= number:
            return
        if "op" in batch.columns:
            deletes = batch.where("op = 'delete'").select("id")
            inserts = batch.where("op IS NULL OR op != 'delete'").drop("op", "id")
        else:
            deletes, inserts = None, batch
        table.apply_batch(inserts, deletes)
        table.manifest = table.manifest | {"stream_batch": number}
        table.commit()
        if policy is not None:
            table.compact(policy=policy)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def window_counts(events: DataFrame, ts: str, keys: list[str], length: str, slide: str | None = None, late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """Counts (and sums of ``value``) by tumbling or sliding window; rows later than ``late`` are dropped in a stream."""
    aggs = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = events.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *(c for c in ("n", "total") if c in out.columns))


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Session windows: events of a key less than ``gap`` apart belong together."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def once(events: DataFrame, ts: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def run_to_memory(stream: DataFrame, name: str, mode: str = "append", before: Callable[[StreamingQuery], None] | None = None) -> DataFrame:
    """Drain a stream into an in-memory table (for tests and small looks)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    if before:
        before(q)
    q.awaitTermination()
    return stream.sparkSession.table(name)
