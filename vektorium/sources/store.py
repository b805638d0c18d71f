"""A versioned vector table on any Hadoop file system.

Layout below ``path``: ``segments/<id>/`` parquet files, ``tombstones/<version>/`` deleted ids, and
``manifests/v<number>.json``, one for each version, which lists its segments and tombstones in full. A version exists
once its manifest does; manifests are created, never overwritten, so of two writers that commit the
same version one fails; it then takes up the other's version, moves the ids and log numbers of what it has
staged behind those, and tries again. Files are deleted by ``vacuum`` only, so compaction keeps history.

Every insert and every delete has a log number (``lsn``); ``rows(as_of=n)`` is what was live after number n.
A manifest is read by name with one small read, without a Spark job; ``open`` by time bisects the names, as
``created_at`` never falls from one version to the next.

Changes are staged and seen by this handle at once (deferred inserts are seen by ``get`` and ``scan``
but not by searches until they are committed); ``commit`` makes them durable and visible to others.
"""

from __future__ import annotations

import bisect
import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql import types as T

from vektorium.functions import vector as V
from vektorium.operators import fusion, ivf, policies, quantize, search
from vektorium.operators.filters import Filter, apply, violations

RESERVED = ("id", "lsn", "vector", "payload")


class StoreError(Exception):
    """Base of the store's errors."""


class InvalidArgument(StoreError, ValueError):
    pass


class NotFound(StoreError, KeyError):
    pass


class ReadOnly(StoreError):
    pass


class Conflict(StoreError):
    """Another writer has committed this version."""


class Closed(StoreError):
    pass


class WriteBatch:
    """Inserts and deletes that are staged together by ``VectorTable.apply``."""

    def __init__(self):
        self.clear()

    def add_insert(self, vector: Sequence[float], metadata: Mapping[str, Any] | None = None, payload: bytes | None = None) -> None:
        self.inserts.append((vector, metadata or {}, payload))

    def add_delete(self, *ids: int) -> None:
        self.deletes.extend(ids)

    def clear(self) -> None:
        self.inserts: list[tuple[Sequence[float], Mapping[str, Any], bytes | None]] = []
        self.deletes: list[int] = []

    def __len__(self) -> int:
        return len(self.inserts) + len(self.deletes)


#: Files of a compacted segment have about so many bytes.
FILE_BYTES = 128 << 20
MANIFEST = "v{:012d}.json"


class VectorTable:
    """A handle on a table, at its newest version or pinned to an older one (then read-only)."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict, read_only: bool = False, flush_rows: int | None = None, observer: Callable[[str, dict], None] | None = None):
        self.spark, self.path, self.manifest, self.read_only, self.closed = spark, path.rstrip("/"), manifest, read_only, False
        self.flush_rows, self.observer = flush_rows, observer
        self._schema = T.StructType.fromJson(manifest["schema"])
        self._discard()

    def _discard(self) -> None:
        self._base, self._staged_rows = self.manifest, 0
        self._pending: list[tuple[DataFrame, bool]] = []
        self._deleted: list[DataFrame] = []

    def _tell(self, event: str, began: float, **facts) -> None:
        """Report an operation and its seconds to the observer, if there is one."""
        if self.observer is not None:
            self.observer(event, facts | {"seconds": time.time() - began})

    # files -------------------------------------------------------------------------------------------

    @staticmethod
    def _fs(spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def _write(cls, spark: SparkSession, path: str, text: str) -> None:
        """Create a file; ``Conflict`` if it is there, any other failure as it is."""
        p, fs = cls._fs(spark, path)
        try:
            out = fs.create(p, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or fs.exists(p):
                raise Conflict(path) from e
            raise
        out.write(bytearray(text.encode()))
        out.close()

    @classmethod
    def _read(cls, spark: SparkSession, path: str) -> str:
        p, fs = cls._fs(spark, path)
        stream = fs.open(p)
        try:
            return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    @classmethod
    def version_numbers(cls, spark: SparkSession, path: str) -> list[int]:
        """The versions that exist, oldest first, by the names of their manifests."""
        p, fs = cls._fs(spark, f"{path.rstrip('/')}/manifests")
        if not fs.exists(p):
            return []
        names = (f.getPath().getName() for f in fs.listStatus(p))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    @classmethod
    def _manifest(cls, spark: SparkSession, path: str, version: int) -> dict:
        return json.loads(cls._read(spark, f"{path.rstrip('/')}/manifests/{MANIFEST.format(version)}"))

    @classmethod
    def versions(cls, spark: SparkSession, path: str) -> list[dict]:
        """All manifests, oldest first."""
        return [cls._manifest(spark, path, v) for v in cls.version_numbers(spark, path)]

    def _size(self, path: str) -> int:
        p, fs = self._fs(self.spark, path)
        return int(fs.getContentSummary(p).getLength())

    # opening -----------------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, dim: int, metric: str = V.L2, metadata: T.StructType | str = "", declared: Mapping[str, str] | None = None) -> VectorTable:
        """Create an empty table; ``metadata`` holds the extra columns, ``declared`` optional field kinds that are enforced."""
        if dim < 1 or metric not in (V.L2, V.COSINE, V.DOT):
            raise InvalidArgument(f"dimension {dim}, metric {metric}")
        extra = T.StructType.fromDDL(metadata) if isinstance(metadata, str) and metadata else metadata or T.StructType([])
        if set(extra.fieldNames()) & set(RESERVED):
            raise InvalidArgument(f"columns {RESERVED} are the table's own")
        schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("lsn", T.LongType()), T.StructField("vector", T.ArrayType(T.FloatType())), *extra.fields, T.StructField("payload", T.BinaryType())])
        first = {"version": 0, "created_at": time.time(), "dim": dim, "metric": metric, "next_id": 1, "next_segment": 1, "max_lsn": 0, "segments": [], "tombstones": [], "schema": schema.jsonValue(), "declared": dict(declared or {})}
        cls._write(spark, f"{path.rstrip('/')}/manifests/{MANIFEST.format(0)}", json.dumps(first))
        return cls(spark, path, first)

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None, timestamp: float | None = None, read_only: bool = False, dim: int | None = None, metric: str | None = None, flush_rows: int | None = None, observer: Callable[[str, dict], None] | None = None) -> VectorTable:
        """The newest version, the given one, or the newest at or before ``timestamp`` (seconds).

        With ``flush_rows`` a handle commits by itself once so many rows are staged. ``observer`` is called with the name
        of each commit, compaction and vacuum and its figures.
        """
        known = cls.version_numbers(spark, path)
        past = version is not None or timestamp is not None
        if version is not None:
            known = [v for v in known if v == version]
        if timestamp is not None:
            known = known[: bisect.bisect_right(known, timestamp, key=lambda v: cls._manifest(spark, path, v)["created_at"])]
        if not known:
            raise NotFound(f"no version found in {path}")
        m = cls._manifest(spark, path, known[-1])
        if (dim and dim != m["dim"]) or (metric and metric != m["metric"]):
            raise InvalidArgument("the table has another dimension or metric")
        return cls(spark, path, m, read_only or past, flush_rows, observer)

    def close(self) -> None:
        """Discard what is staged; nothing is committed implicitly."""
        self._discard()
        self.closed = True

    def _writable(self) -> None:
        if self.closed:
            raise Closed(self.path)
        if self.read_only:
            raise ReadOnly(self.path)

    # writing -----------------------------------------------------------------------------------------

    @property
    def metadata_columns(self) -> list[str]:
        return [f.name for f in self._schema.fields if f.name not in RESERVED]

    def _staged(self, rows: DataFrame) -> DataFrame:
        """Check new rows and give them dense ids and log numbers in the order of their partitions."""
        from vektorium.sources.tables import stored

        names = rows.columns
        if "vector" not in names or set(names) - {"vector", "payload", *self.metadata_columns}:
            raise InvalidArgument(f"columns {names}")
        rows = rows.select(*((F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in self._schema.fields if f.name not in ("id", "lsn")))
        bad = violations(rows, self.manifest["declared"])
        rows = stored(rows.select("*", bad.alias("_bad"), V.valid(F.col("vector"), self.manifest["dim"]).alias("_ok"), F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")), "staged")
        parts = rows.groupBy("_p").agg(F.count("*").alias("n"), F.count(F.when(~F.col("_ok") | (F.size("_bad") > 0), 1)).alias("wrong")).orderBy("_p").collect()  # one row a partition
        if any(r["wrong"] for r in parts):
            raise InvalidArgument(f"{sum(r['wrong'] for r in parts)} rows have a vector or field of the wrong kind")
        offset, total = [], 0
        for r in parts:
            offset.append((r["_p"], total))
            total += r["n"]
        if not total:
            return self.spark.createDataFrame([], self._schema)
        begins = F.broadcast(self.spark.createDataFrame(offset, "_p int, _begin long"))  # one row a partition
        m = self.manifest
        place = F.col("_begin") + F.col("_i")
        out = rows.join(begins, "_p").select((place + m["next_id"]).alias("id"), (place + m["max_lsn"] + 1).alias("lsn"), *(f.name for f in self._schema.fields if f.name not in ("id", "lsn")))
        self.manifest = m | {"next_id": m["next_id"] + total, "max_lsn": m["max_lsn"] + total}
        self._staged_rows += total
        return out.select(*self._schema.fieldNames())

    def insert_rows(self, rows: DataFrame, searchable: bool = True) -> tuple[int, int]:
        """Stage rows of (vector, payload, metadata columns); returns the first id and the number of rows."""
        self._writable()
        first = self.manifest["next_id"]
        staged = self._staged(rows)
        self._pending.append((staged, searchable))
        n = self.manifest["next_id"] - first
        if self.flush_rows and self._staged_rows >= self.flush_rows:
            self.commit()
        return first, n

    def insert(self, vector: Sequence[float], metadata: Mapping[str, Any] | None = None, payload: bytes | None = None) -> int:
        return self.insert_many([vector], [metadata or {}], [payload])[0]

    def insert_many(self, vectors: Sequence[Sequence[float]], metadata: Sequence[Mapping[str, Any]] | None = None, payloads: Sequence[bytes | None] | None = None, searchable: bool = True) -> list[int]:
        """Stage a few records from the driver, checked before anything is staged."""
        self._writable()
        metadata, payloads = metadata or [{}] * len(vectors), payloads or [None] * len(vectors)
        if not len(vectors) == len(metadata) == len(payloads):
            raise InvalidArgument("vectors, metadata and payloads differ in number")
        if not vectors:
            return []
        if any(set(m) - set(self.metadata_columns) for m in metadata):
            raise InvalidArgument("unknown metadata column")
        fields = [f for f in self._schema.fields if f.name not in ("id", "lsn")]
        data = [tuple([float(x) for x in v] if f.name == "vector" else p if f.name == "payload" else m.get(f.name) for f in fields) for v, m, p in zip(vectors, metadata, payloads)]
        first, n = self.insert_rows(self.spark.createDataFrame(data, T.StructType(fields)).coalesce(1), searchable)
        return list(range(first, first + n))

    def delete(self, *ids: int) -> None:
        """Stage deletes; unknown ids are ignored."""
        if ids:
            self.delete_rows(self.spark.createDataFrame([(int(i),) for i in ids], "id long"))

    def delete_rows(self, ids: DataFrame) -> None:
        """Stage deletes of the ids in a table; all get one log number."""
        self._writable()
        lsn = self.manifest["max_lsn"] + 1
        self.manifest = self.manifest | {"max_lsn": lsn}
        self._deleted.append(ids.select(F.col("id").cast("long").alias("id"), F.lit(lsn).cast("long").alias("lsn")).where("id IS NOT NULL"))

    def apply_batch(self, inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> None:
        """Stage inserts and deletes together: if the inserts are refused, nothing is staged."""
        self._writable()
        if inserts is not None:
            self.insert_rows(inserts)
        if deletes is not None:
            self.delete_rows(deletes)

    def apply(self, batch: WriteBatch) -> list[int]:
        """Stage a batch of records from the driver and empty it; the ids of its inserts."""
        self._writable()
        vectors, metadata, payloads = zip(*batch.inserts) if batch.inserts else ((), (), ())
        ids = self.insert_many(vectors, metadata, payloads) if vectors else []
        self.delete(*batch.deletes)
        batch.clear()
        return ids

    def _publish(self, m: dict) -> None:
        self._write(self.spark, f"{self.path}/manifests/{MANIFEST.format(m['version'])}", json.dumps(m))
        self.manifest = m
        self._discard()

    def _stamp(self, m: dict) -> dict:
        """The next version, never older than the one before it."""
        return m | {"version": m["version"] + 1, "created_at": max(time.time(), m["created_at"])}

    def _rebase(self) -> None:
        """Take up the newest version: ids and log numbers of what is staged move behind it."""
        old, new = self._base, self._manifest(self.spark, self.path, self.version_numbers(self.spark, self.path)[-1])
        ids, lsns = new["next_id"] - old["next_id"], new["max_lsn"] - old["max_lsn"]
        own = F.when(F.col("id") >= old["next_id"], F.col("id") + ids).otherwise(F.col("id"))  # deletes may name staged rows
        move = lambda df: df.withColumn("id", own).withColumn("lsn", F.col("lsn") + lsns)
        self._pending = [(move(df), searchable) for df, searchable in self._pending]
        self._deleted = [move(df) for df in self._deleted]
        self.manifest = new | {"next_id": self.manifest["next_id"] + ids, "max_lsn": self.manifest["max_lsn"] + lsns}
        self._base = new

    def commit(self, attempts: int = 5) -> int:
        """Write what is staged as one new version; its number (the current one if nothing is staged).

        If another writer was first, what is staged moves behind its version (ids given out before by this handle are
        then larger by the same number) and the commit is tried again, up to ``attempts`` times in all.
        """
        self._writable()
        if not self._pending and not self._deleted:
            return self.manifest["version"]
        began = time.time()
        for left in range(attempts - 1, -1, -1):
            m = self._stamp(self.manifest)
            if self._pending:
                seg = self._segment(self._union([df for df, _ in self._pending]), m["next_segment"], 0)
                m |= {"next_segment": m["next_segment"] + 1, "segments": [*m["segments"], *([seg] if seg["rows"] else [])]}
            if self._deleted:
                where = f"{self.path}/tombstones/{m['version']:012d}-{time.time_ns()}"
                self._union(self._deleted).groupBy("id").agg(F.min("lsn").alias("lsn")).write.parquet(where)
                m["tombstones"] = [*m["tombstones"], where]
            rows = self._staged_rows
            try:
                self._publish(m)
            except Conflict:
                if not left:
                    raise
                self._rebase()
                continue
            self._tell("commit", began, version=m["version"], rows=rows)
            return m["version"]
        raise Conflict(self.path)

    def _segment(self, rows: DataFrame, number: int, level: int, partitions: int | None = None) -> dict:
        where = f"{self.path}/segments/{number:08d}-{time.time_ns()}"
        if partitions:
            partitions = self._write_partitions(rows, where, partitions)
        else:
            rows.sortWithinPartitions("id").write.option("compression", "zstd").parquet(where)
        numbers = [f.name for f in self._schema.fields if isinstance(f.dataType, (T.IntegralType, T.FloatType, T.DoubleType)) and f.name not in RESERVED]
        plain = [F.col(c) if isinstance(self._schema[c].dataType, T.IntegralType) else F.when(~F.isnan(c), F.col(c).cast("double")) for c in numbers]
        s = self.spark.read.schema(self._schema).parquet(where).select(*self._schema.fieldNames()).agg(F.count("*").alias("rows"), F.min("id").alias("lo"), F.max("id").alias("hi"), *(f(x).alias(f"{k}_{c}") for c, x in zip(numbers, plain) for k, f in (("min", F.min), ("max", F.max)))).first()
        # bounds keep the column's kind: as doubles, whole numbers above 2 ** 53 would be rounded
        bounds = {c: [s[f"min_{c}"], s[f"max_{c}"]] for c in numbers if s[f"min_{c}"] is not None and abs(s[f"min_{c}"]) != float("inf") and abs(s[f"max_{c}"]) != float("inf")}
        return {"id": number, "level": level, "rows": s["rows"], "min_id": s["lo"], "max_id": s["hi"], "size": self._size(where), "path": where, "numeric": bounds, "partitions": partitions or 0}

    def _write_partitions(self, rows: DataFrame, where: str, partitions: int) -> int:
        """Write rows by nearest centroid with their codes; how many partitions there are (0 for no rows)."""
        dim = self.manifest["dim"]
        cents = ivf.fit_sample(rows, "vector", dim, min(partitions, ivf.MAX_CLUSTERS))
        if not len(cents):
            rows.write.parquet(where)
            return 0
        ends = quantize.ranges(rows, "vector", dim).first()
        lo, hi = np.array(ends["lo"]), np.array(ends["hi"])
        at = self._schema.fieldNames().index("vector")
        schema = T.StructType([*self._schema.fields, T.StructField("code", T.BinaryType()), T.StructField("cluster", T.LongType())])
        held = self.spark.sparkContext.broadcast((cents, lo, hi))  # at most ivf.MAX_CLUSTERS centroids
        out = rows.select(*self._schema.fieldNames()).mapInArrow(lambda it: quantize.sq8_partitions(it, at, *held.value), schema)
        # a partition's rows lie in a few files, however unevenly they fall: the second key spreads large ones
        out = out.repartition("cluster", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("cluster", "id")
        out.write.option("compression", "zstd").partitionBy("cluster").parquet(where)
        self._write(self.spark, f"{where}/_partitions.json", json.dumps({"centroids": cents.tolist(), "lo": lo.tolist(), "hi": hi.tolist()}))
        return len(cents)

    # reading -----------------------------------------------------------------------------------------

    def _union(self, parts: Sequence[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _load(self, segments: Sequence[dict]) -> list[DataFrame]:
        """The rows of segments: the plain ones in one scan, each partitioned one in its own."""
        plain = [s["path"] for s in segments if not s.get("partitions")]
        parts = [self.spark.read.schema(self._schema).parquet(*plain)] if plain else []
        return parts + [self._partitioned(s).select(*self._schema.fieldNames()) for s in segments if s.get("partitions")]

    def _partitioned(self, seg: dict) -> DataFrame:
        """A segment written in partitions, with ``cluster`` (a folder, so filters on it prune files) and the 8-bit ``code``."""
        return self.spark.read.schema(T.StructType([*self._schema.fields, T.StructField("code", T.BinaryType()), T.StructField("cluster", T.LongType())])).parquet(seg["path"])

    def _tombstones(self, as_of: int | None = None) -> DataFrame | None:
        parts = ([self.spark.read.schema("id long, lsn long").parquet(*self.manifest["tombstones"])] if self.manifest["tombstones"] else []) + self._deleted
        if not parts:
            return None
        gone = self._union(parts)
        return (gone if as_of is None else gone.where(F.col("lsn") <= as_of)).select("id")

    def _can_match(self, seg: dict, f: Filter) -> bool:
        """Whether a segment's bounds admit a row; whole numbers are compared as such, with fractions as doubles."""
        if f.field not in seg["numeric"] or not isinstance(f.value, (int, float)) or isinstance(f.value, bool):
            return True
        lo, hi = (float(x) if isinstance(f.value, float) else x for x in seg["numeric"][f.field])
        return {"eq": lo <= f.value <= hi, "gt": hi > f.value, "gte": hi >= f.value, "lt": lo < f.value, "lte": lo <= f.value}.get(f.op, True)

    def rows(self, filters: Sequence[Filter] = (), staged: bool = True, deferred: bool = True, as_of: int | None = None) -> DataFrame:
        """Live rows, or those that were live after log number ``as_of``.

        Segments whose numbers exclude a filter aren't read; filters reach the parquet scan.
        """
        if self.closed:
            raise Closed(self.path)
        parts = self._load([s for s in self.manifest["segments"] if all(self._can_match(s, f) for f in filters)])
        parts += [df for df, searchable in self._pending if staged and (deferred or searchable)]
        out = apply(self._union(parts) if parts else self.spark.createDataFrame([], self._schema), filters)
        out = out if as_of is None else out.where(F.col("lsn") <= as_of)
        gone = self._tombstones(as_of)
        return out.join(gone, "id", "left_anti") if gone is not None else out

    def scan(self, filters: Sequence[Filter] = ()) -> DataFrame:
        """Live rows in id order."""
        return self.rows(filters).orderBy("id")

    def iterate(self, filters: Sequence[Filter] = ()) -> Iterator[Row]:
        return self.scan(filters).toLocalIterator(prefetchPartitions=True)

    def get(self, record: int) -> Row:
        parts = self._load([s for s in self.manifest["segments"] if s["min_id"] <= record <= s["max_id"]]) + [df for df, _ in self._pending]
        found = self._union(parts).where(F.col("id") == record) if parts else self.spark.createDataFrame([], self._schema)
        gone = self._tombstones()
        row = (found.join(gone, "id", "left_anti") if gone is not None else found).first()
        if row is None:
            raise NotFound(record)
        return row

    def search(self, query: Sequence[float], k: int, filters: Sequence[Filter] = (), columns: Sequence[str] | None = None, nprobes: int | None = None, refine: float | None = None) -> DataFrame:
        """``id, score, rank`` and the columns asked for (all metadata and the payload if none are named).

        Exact unless ``nprobes`` or ``refine`` is given. Of segments that ``compact`` wrote in partitions, ``nprobes`` reads only
        the partitions with the nearest centroids; ``refine`` reads the 8-bit codes first and the vectors of the best
        ``k * refine`` only. Scores are always those of the stored vectors.
        """
        if len(query) != self.manifest["dim"] or any(x != x or abs(x) == float("inf") for x in query) or k < 1:
            raise InvalidArgument("the query has the wrong dimension or no finite numbers, or k is below 1")
        cols = [*self.metadata_columns, "payload"] if columns is None else list(columns)
        rows = self.rows(filters, deferred=False) if nprobes is None and refine is None else self._candidates(query, k, filters, nprobes, refine)
        return search.knn(rows, query, k, self.manifest["metric"], "id", "vector", (), cols)

    def _candidates(self, query: Sequence[float], k: int, filters: Sequence[Filter], nprobes: int | None, refine: float | None) -> DataFrame:
        """Live rows that can be among the best, by partitions and codes; all rows of segments that have none."""
        segs = [s for s in self.manifest["segments"] if all(self._can_match(s, f) for f in filters)]
        gone, q, metric = self._tombstones(), np.array(query, np.float64), self.manifest["metric"]
        live = lambda df: df.join(gone, "id", "left_anti") if gone is not None else df
        parts = [live(apply(df, filters)) for df in self._load([s for s in segs if not s.get("partitions")]) + [df for df, searchable in self._pending if searchable]]
        for seg in (s for s in segs if s.get("partitions")):
            held = json.loads(self._read(self.spark, f"{seg['path']}/_partitions.json"))
            cents, lo, hi = (np.array(held[x]) for x in ("centroids", "lo", "hi"))
            near = np.argsort(((cents - q) ** 2).sum(1) if metric == V.L2 else -(cents @ q), kind="stable")
            rows = live(apply(self._partitioned(seg).where(F.col("cluster").isin(near[: nprobes or len(near)].tolist())), filters))
            if refine is not None:
                most = max(k, int(k * refine))
                top = rows.select("id", "code").mapInArrow(lambda it, lo=lo, hi=hi: quantize.sq8_scores(it, q, lo, hi, metric, most), "id long, approx double").orderBy("approx", "id").limit(most)
                rows = rows.where(F.col("id").isin([r["id"] for r in top.collect()]))  # k * refine ids
            parts.append(rows.select(*self._schema.fieldNames()))
        return self._union(parts) if parts else self.spark.createDataFrame([], self._schema)

    def search_iter(self, query: Sequence[float], k: int, **kw) -> Iterator[Row]:
        """The results of ``search`` one by one, best first."""
        return self.search(query, k, **kw).orderBy("rank").toLocalIterator(prefetchPartitions=True)

    def search_threshold(self, query: Sequence[float], threshold: float, most: int, **kw) -> DataFrame:
        top = self.search(query, most, **kw)
        return top.where(F.col("score") <= threshold if V.ascending(self.manifest["metric"]) else F.col("score") >= threshold)

    def search_batch(self, queries: DataFrame, k: int) -> DataFrame:
        return search.knn_batch(self.rows(deferred=False), queries, k, self.manifest["dim"], self.manifest["metric"], "id", "vector")

    def search_hybrid(self, query: Sequence[float], words: str, k: int, text_col: str, rrf_k: int = 60, filters: Sequence[Filter] = ()) -> DataFrame:
        rows = self.rows(deferred=False)
        return fusion.hybrid(rows, rows, query, words, k, rrf_k, self.manifest["metric"], "id", "vector", "id", text_col, filters)

    # maintenance -------------------------------------------------------------------------------------

    def compact(self, segments: Sequence[int] | None = None, policy: policies.Policy | None = None, partitions: int | None = None) -> int:
        """Merge segments (all, the given, or what the policy picks), leaving out deleted rows; one new version.

        With ``partitions`` the new segment is written by nearest centroid, in so many folders, with 8-bit codes beside the
        vectors. Centroids are fitted to at most ``ivf.TRAIN_ROWS`` rows; every row is assigned and encoded.
        """
        self._writable()
        if self._pending or self._deleted:
            raise InvalidArgument("commit or close first")
        began, m = time.time(), dict(self.manifest)
        task = policies.Merge(tuple(segments if segments is not None else (s["id"] for s in m["segments"])), 1)
        if policy is not None:
            task = policy([policies.Segment(s["id"], s["size"], s["level"]) for s in m["segments"]])
        if task is None or not task.segments:
            return m["version"]
        old = [s for s in m["segments"] if s["id"] in task.segments]
        rows = self._union(self._load(old)) if old else self.spark.createDataFrame([], self._schema)
        gone = self._tombstones()
        rows = rows.join(gone, "id", "left_anti") if gone is not None else rows
        rows = rows if partitions else rows.repartitionByRange(max(1, -(-sum(s["size"] for s in old) // FILE_BYTES)), "id")
        new, m["next_segment"] = self._segment(rows, m["next_segment"], task.level, partitions), m["next_segment"] + 1
        m["segments"] = [s for s in m["segments"] if s["id"] not in task.segments] + ([new] if new["rows"] else [])
        if len(old) == len(self.manifest["segments"]):
            m["tombstones"] = []  # no row they name is left
        self._publish(self._stamp(m))
        self._tell("compact", began, version=self.manifest["version"], segments=len(old), rows=new["rows"])
        return self.manifest["version"]

    def vacuum(self, retention: policies.Retention, now: float | None = None) -> list[str]:
        """Drop versions that the policy doesn't keep and the files that only they name; what was deleted."""
        self._writable()
        known = self.versions(self.spark, self.path)
        keep = retention.keep([(m["version"], m["created_at"]) for m in known], now or time.time())
        named = lambda ms: {s["path"] for m in ms for s in m["segments"]} | {t for m in ms for t in m["tombstones"]}
        drop = [m for m in known if m["version"] not in keep]
        gone = [f"{self.path}/manifests/{MANIFEST.format(m['version'])}" for m in drop] + sorted(named(drop) - named([m for m in known if m["version"] in keep]))
        for path in gone:  # manifests first, so no version is left that names a missing file
            p, fs = self._fs(self.spark, path)
            fs.delete(p, True)
        return gone

    def orphans(self, older_than: float = 86_400.0) -> list[str]:
        """Delete files that no version names, left by commits that failed, if older than so many seconds; what was deleted."""
        self._writable()
        named = {s["path"] for m in self.versions(self.spark, self.path) for s in m["segments"]} | {t for m in self.versions(self.spark, self.path) for t in m["tombstones"]}
        named, gone = {x.rsplit("/", 1)[1] for x in named}, []
        for kind in ("segments", "tombstones"):
            p, fs = self._fs(self.spark, f"{self.path}/{kind}")
            for f in fs.listStatus(p) if fs.exists(p) else []:
                if f.getPath().getName() not in named and f.getModificationTime() / 1000 <= time.time() - older_than:
                    fs.delete(f.getPath(), True)
                    gone.append(f.getPath().toString())
        return gone

    def segments(self) -> DataFrame:
        rows = [(s["id"], s["level"], s["rows"], s["size"], s["min_id"], s["max_id"]) for s in self.manifest["segments"]]
        return self.spark.createDataFrame(rows, "segment_id int, level int, n_rows long, size_bytes long, min_id long, max_id long")

    def stats(self) -> dict[str, Any]:
        m = self.manifest
        return {"version": m["version"], "dim": m["dim"], "metric": m["metric"], "segments": len(m["segments"]), "rows": sum(s["rows"] for s in m["segments"]), "size_bytes": sum(s["size"] for s in m["segments"]), "staged": len(self._pending), "max_lsn": m["max_lsn"]}
