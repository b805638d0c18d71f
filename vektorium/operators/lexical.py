"""BM25 over derived postings.

Text is split on white space and lower-cased; punctuation stays. Score: the sum over the query's words,
with multiplicity, of ``idf * tf (k1 + 1) / (tf + k1 (1 - b + b len / avg_len))`` with
``idf = ln(1 + (N - n + 0.5) / (n + 0.5))``. Documents that score above 0 are ranked by score, then id.
Null and empty texts are not documents of the index. Scores are doubles.

``bm25`` scans the texts once for a single query. ``LexicalIndex`` keeps postings: documents are added,
replaced and deleted by generations, and a search reads only the buckets of its own words.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

K1, B = 1.2, 0.75


#: Separators beyond what ``str.split`` takes: the other ASCII control characters.
_CONTROL = re.compile("[\x00-\x08\x0e-\x1b]")


def split(text: str) -> list[str]:
    """Lower-cased words between white space and control characters."""
    return (_CONTROL.sub(" ", text) if _CONTROL.search(text) else text).lower().split()


def _count(batches: Iterator[pa.RecordBatch], terms: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> id, number of words, and how often each term occurs."""
    for b in batches:
        words = [split(t) for t in b.column(1).to_pylist()]
        tf = [[w.count(t) for w in words] for t in terms]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in words], pa.int32()), *(pa.array(x, pa.int32()) for x in tf)], names=["id", "len", *(f"_tf{i}" for i in range(len(terms)))])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([split(t) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], names=["id", "words"])


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.where(F.col(text_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, words, len`` of the indexed documents.

    Words are split in Arrow batches: the JVM's regular-expression split took several times as long
    on the same texts.
    """
    return _texts(df, id_col, text_col).mapInArrow(_words, "id long, words array<string>").withColumn("len", F.size("words"))


def postings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``term, id, tf``."""
    return documents(df, id_col, text_col).select("id", F.explode("words").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))


def collection(docs: DataFrame) -> DataFrame:
    """One row: ``n_docs, avg_len``."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))


def bm25(df: DataFrame, query: str, k: int, id_col: str, text_col: str) -> DataFrame:
    """``id, score``: the best ``k``.

    Term frequencies of the few query words are taken in the scan, so nothing but one row of counts
    is exchanged: no postings are shuffled.
    """
    want = Counter(split(query))
    texts = _texts(df, id_col, text_col)
    if not want:
        return texts.select("id", F.lit(0.0).alias("score")).limit(0)
    terms = sorted(want)
    schema = "id long, len int" + "".join(f", _tf{i} int" for i in range(len(terms)))
    docs = texts.mapInArrow(lambda it: _count(it, terms), schema)
    stats = docs.agg(F.count("*").alias("_n"), F.avg("len").alias("_avg"), *(F.count(F.when(F.col(f"_tf{i}") > 0, 1)).alias(f"_df{i}") for i in range(len(terms))))
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        n, f = F.col(f"_df{i}"), F.col(f"_tf{i}")
        idf = F.log(1 + (F.col("_n") - n + 0.5) / (n + 0.5))
        part = idf * (f * (K1 + 1)) / (f + K1 * (1 - B) + K1 * B * F.col("len") / F.col("_avg"))
        for _ in range(want[t]):
            score = score + F.when(f > 0, part).otherwise(F.lit(0.0))
    any_term = F.greatest(*(F.col(f"_tf{i}") for i in range(len(terms))), F.lit(0)) > 0
    hits = docs.where(any_term).crossJoin(F.broadcast(stats))  # stats: one row
    return hits.select("id", score.alias("score")).where("score > 0").orderBy(F.col("score").desc(), "id").limit(k)


def terms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``term, df, cf, idf`` of the whole collection."""
    docs = documents(df, id_col, text_col)
    p = docs.select("id", F.explode("words").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    n = docs.agg(F.count("*").alias("_n"))
    t = p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return t.crossJoin(F.broadcast(n)).select("term", "df", "cf", F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


class TextIndex(Protocol):
    """What a lexical index offers to hybrid search."""

    def add(self, df: DataFrame, id_col: str, text_col: str) -> None: ...

    def delete(self, ids: DataFrame) -> None: ...

    def search(self, query: str, k: int) -> DataFrame: ...


class LexicalIndex:
    """Postings kept below ``path`` on shared storage; one writer at a time.

    Every ``add`` or ``delete`` is a generation g: ``postings/gen=g/bucket=b`` holds ``term, id, tf, len`` by a hash of the
    term, sorted by it; ``docs/gen=g`` ``id, len``; ``gone/gen=g`` ``id, was``, the documents of earlier generations that it
    replaces or deletes. ``state/g.json`` is written last and makes the generation count; it carries the number of documents and
    of words, so a search reads no documents. Of a repeated id in one ``add`` the longest text (then the greatest) holds.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _file(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def state(self) -> dict:
        """Generations that count, with the number of documents and words."""
        p, fs = self._file("state")
        known = sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(p) if f.getPath().getName().endswith(".json")) if fs.exists(p) else []
        if not known:
            return {"generation": 0, "parts": [], "gone": [], "n_docs": 0, "n_words": 0}
        p, fs = self._file(f"state/{known[-1]}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, state: dict) -> None:
        p, fs = self._file(f"state/{state['generation']}.json")
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()

    def _read(self, kind: str, gens: Sequence[int], schema: str) -> DataFrame:
        if not gens:
            return self.spark.createDataFrame([], schema + ", gen int")
        parts = [self.spark.read.schema(schema + (", bucket int" if kind == "postings" else "")).parquet(f"{self.path}/{kind}/gen={g}").withColumn("gen", F.lit(g)) for g in gens]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _live(self, rows: DataFrame, state: dict) -> DataFrame:
        """Rows of (id, gen) that no later generation has replaced or deleted."""
        gone = self._read("gone", state["gone"], "id long, was int").select("id", F.col("was").alias("gen"))
        return rows.join(gone, ["id", "gen"], "left_anti") if state["gone"] else rows

    def _retire(self, ids: DataFrame, state: dict, g: int) -> dict:
        """Write which live documents of earlier generations ``ids`` names; the state without them."""
        held = self._live(self._read("docs", state["parts"], "id long, len int"), state).join(ids.select("id").distinct(), "id", "left_semi")
        held.select("id", F.col("gen").alias("was"), "len").write.mode("overwrite").parquet(f"{self.path}/gone/gen={g}")
        n, words = self.spark.read.schema("id long, was int, len int").parquet(f"{self.path}/gone/gen={g}").agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        return state | {"generation": g, "gone": [*state["gone"], *([g] if n else [])], "n_docs": state["n_docs"] - n, "n_words": state["n_words"] - words}

    def add(self, df: DataFrame, id_col: str, text_col: str) -> None:
        """Add documents; those whose id is there are replaced (by nothing if the text is null or empty)."""
        state = self.state()
        g = state["generation"] + 1
        texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        one = texts.groupBy("id").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
        state = self._retire(one, state, g)
        docs = documents(one, "id", "text")
        p = docs.select("id", "len", F.explode("words").alias("term")).groupBy("term", "id").agg(F.count("*").cast("int").alias("tf"), F.first("len").alias("len"))
        p = p.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")).repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "term", "id")
        p.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/postings/gen={g}")
        docs.select("id", "len").write.mode("overwrite").parquet(f"{self.path}/docs/gen={g}")
        n, words = self.spark.read.schema("id long, len int").parquet(f"{self.path}/docs/gen={g}").agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        self._publish(state | {"parts": [*state["parts"], g], "n_docs": state["n_docs"] + n, "n_words": state["n_words"] + words})

    def delete(self, ids: DataFrame) -> None:
        """Delete documents by ``id``; unknown ids are ignored."""
        state = self.state()
        self._publish(self._retire(ids.select(F.col("id").cast("long").alias("id")), state, state["generation"] + 1))

    def search(self, query: str, k: int) -> DataFrame:
        """``id, score``: the best ``k``, as ``bm25`` gives them for the live documents."""
        want, state = Counter(split(query)), self.state()
        if not want or not state["n_docs"]:
            return self.spark.createDataFrame([], "id long, score double")
        terms = self.spark.createDataFrame(list(want.items()), "term string, times int").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")).collect()  # the query's words
        rows = self._read("postings", state["parts"], "term string, id long, tf int, len int").where(F.col("bucket").isin(sorted({t["bucket"] for t in terms})) & F.col("term").isin(sorted(want)))
        rows = self._live(rows.select("term", "id", "tf", "len", "gen"), state)
        df = rows.groupBy("term").agg(F.count("*").alias("df"))  # at most one row a word of the query
        times = F.coalesce(*(F.when(F.col("term") == t, F.lit(n)) for t, n in sorted(want.items())))
        idf = F.log(1 + (F.lit(state["n_docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B) + K1 * B * F.col("len") / F.lit(state["n_words"] / state["n_docs"]))
        scored = rows.join(F.broadcast(df), "term").select("id", (part * times).alias("s"))
        return scored.groupBy("id").agg(F.sum("s").alias("score")).where("score > 0").orderBy(F.col("score").desc(), "id").limit(k)
