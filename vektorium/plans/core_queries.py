"""Queries over vectors, metadata, text, versions and statistics, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vektorium.functions import vector as V
from vektorium.operators import filters as FL
from vektorium.operators import fusion, ivf, lexical, policies, quantize, search, stats, versions
from vektorium.operators.filters import Filter
from vektorium.sources.store import VectorTable
from vektorium.sources.tables import read, shared_dir, stored
from vektorium.streaming import ingest

DIM, K = 64, 10
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings")


def _vector(spark: SparkSession, d: str, i: int = 0) -> list[float]:
    return list(_emb(spark, d).where(F.col("vec_id") == i).select("embedding").first()[0])


def _fold(a: str, b: str, term: str) -> str:
    return f"list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip({a}, {b}), lambda p: {term})), lambda s, x: s + x)"


def _l2(a: str, b: str) -> str:
    return _fold(a, b, "(p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)")


def _dot(a: str, b: str) -> str:
    return _fold(a, b, "p[1]::DOUBLE * p[2]::DOUBLE")


def _q(i: int = 0) -> str:
    return f"(SELECT embedding AS qv FROM embeddings WHERE vec_id = {i})"


def _knn_sql(score: str, order: str, where: str = "true", k: int = K, outer: str = "true", digits: int | None = None) -> str:
    shown = f"round(score, {digits})" if digits else "score"
    return f"WITH s AS (SELECT vec_id, {score} AS score FROM embeddings, {_q()} WHERE {where}), t AS (SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score {order}, vec_id) AS INTEGER) AS rank FROM s) SELECT vec_id, {shown} AS score, rank FROM t WHERE rank <= {k} AND {outer}"


def _knn(spark, d, metric=V.L2, k=K, filters=(), **kw) -> DataFrame:
    return search.knn(_emb(spark, d), _vector(spark, d), k, metric, "vec_id", "embedding", filters, **kw)


L2SQL, DOTSQL = _l2("embedding", "qv"), _dot("embedding", "qv")
COSSQL = f"{_dot('embedding', 'qv')} / (sqrt({_dot('embedding', 'embedding')}) * sqrt({_dot('qv', 'qv')}))"


# search ---------------------------------------------------------------------------------------------------


@query(_knn_sql(L2SQL, "ASC"))
def knn_l2(spark, d):
    return _knn(spark, d)


@query(_knn_sql(DOTSQL, "DESC"))
def knn_dot(spark, d):
    return _knn(spark, d, V.DOT)


@query(_knn_sql(COSSQL, "DESC", digits=12))
def knn_cosine(spark, d):
    return _knn(spark, d, V.COSINE).withColumn("score", F.round("score", 12))


@query(_knn_sql(L2SQL, "ASC", "label = 3"))
def knn_filtered_eq(spark, d):
    return _knn(spark, d, filters=[Filter("label", "eq", 3)])


@query(_knn_sql(L2SQL, "ASC", "label IN (1, 4, 7)"))
def knn_filtered_in(spark, d):
    return _knn(spark, d, filters=[Filter("label", "in", [1, 4, 7])])


@query(_knn_sql(L2SQL, "ASC", "label >= 2 AND label < 6"))
def knn_filtered_range(spark, d):
    return _knn(spark, d, filters=[Filter("label", "gte", 2), Filter("label", "lt", 6)])


@query(_knn_sql(L2SQL, "ASC", "label IS NOT NULL AND label <> 0"))
def knn_filtered_ne(spark, d):
    return _knn(spark, d, filters=[Filter("label", "ne", 0)])


@query(_knn_sql(DOTSQL, "DESC", "label > 1 AND label <> 5"))
def knn_filtered_multi(spark, d):
    return _knn(spark, d, V.DOT, filters=[Filter("label", "gt", 1), Filter("label", "ne", 5)])


@query(_knn_sql(L2SQL, "ASC", k=50, outer="score <= 1.2"))
def knn_threshold_l2(spark, d):
    return search.knn_threshold(_emb(spark, d), _vector(spark, d), 1.2, 50, V.L2, id_col="vec_id", vec_col="embedding")


@query(_knn_sql(DOTSQL, "DESC", k=50, outer="score >= 0.4"))
def knn_threshold_dot(spark, d):
    return search.knn_threshold(_emb(spark, d), _vector(spark, d), 0.4, 50, V.DOT, id_col="vec_id", vec_col="embedding")


@query(_knn_sql(L2SQL, "ASC").replace("SELECT vec_id, score AS score, rank FROM t", "SELECT t.vec_id, score, rank, label, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS embedding FROM t JOIN embeddings USING (vec_id)"))
def knn_projection_vector(spark, d):
    """Late materialisation: the vector and label of the few rows found."""
    top = search.knn_rows(_emb(spark, d), _knn(spark, d), "vec_id", ["label", "embedding"])
    return top.withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)))


@query(f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round({_l2('e.embedding', 'q.embedding')}, 9) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0), t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS INTEGER) AS rank FROM s) SELECT query_id, id, score, rank FROM t WHERE rank <= 10")
def knn_batch(spark, d):
    e = _emb(spark, d)
    return search.knn_batch(e, e.where("vec_id % 100 = 0").select("vec_id", "embedding"), K, DIM, V.L2, "vec_id", "embedding").withColumn("score", F.round("score", 9))


@query(SQL["knn_batch"].replace("q.vec_id % 100 = 0", "true"))
def knn_batch_all(spark, d):
    """The 10 nearest of every vector: the throughput query."""
    e = _emb(spark, d)
    return search.knn_batch(e, e.select("vec_id", "embedding"), K, DIM, V.L2, "vec_id", "embedding").withColumn("score", F.round("score", 9))


@query("WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: x >= 0) AS bits FROM embeddings), s AS (SELECT b.vec_id, len(list_filter(list_zip(b.bits, q.bits), lambda p: p[1] <> p[2])) AS score FROM b, (SELECT bits FROM b WHERE vec_id = 0) q), t AS (SELECT vec_id, CAST(score AS BIGINT) AS score, CAST(row_number() OVER (ORDER BY score, vec_id) AS INTEGER) AS rank FROM s) SELECT * FROM t WHERE rank <= 10")
def knn_hamming_bq(spark, d):
    e = _emb(spark, d)
    q = e.where("vec_id = 0").select(V.sign_words(F.col("embedding")).alias("q"))
    s = e.crossJoin(F.broadcast(q)).select("vec_id", V.hamming(V.sign_words(F.col("embedding")), F.col("q")).alias("score"))
    top = s.orderBy("score", "vec_id").limit(K)
    from pyspark.sql import Window as W

    return top.withColumn("rank", F.row_number().over(W.orderBy("score", "vec_id")).cast("int"))


@query(f"WITH t AS (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_l2('e.embedding', 'q.embedding')}, e.vec_id) AS r, row_number() OVER (PARTITION BY q.vec_id, e.label = q.label ORDER BY {_l2('e.embedding', 'q.embedding')}, e.vec_id) AS rl, e.label = q.label AS same FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0) SELECT query_id, sum(CASE WHEN r <= 10 AND same AND rl <= 10 THEN 1 ELSE 0 END) / 10.0::DOUBLE AS recall FROM t GROUP BY query_id")
def recall_at_k(spark, d):
    """Recall of searching only the query's own label, against the exact search."""
    return _label_recall(spark, d, "vec_id % 100 = 0")


def _label_recall(spark, d, which: str) -> DataFrame:
    e = _emb(spark, d)
    qs = e.where(which).select("vec_id", "embedding")
    truth = search.knn_batch(e, qs, K, DIM, V.L2, "vec_id", "embedding")
    from pyspark.sql import Window as W

    q = qs.join(e.select("vec_id", "label"), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"), "label")
    near = e.join(q, "label").select("query_id", F.col("vec_id").alias("id"), V.squared_l2(F.col("embedding"), F.col("qv")).alias("s"))
    found = near.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("s", "id"))).where("r <= 10")
    return search.recall(found, truth, K)


# vector functions -----------------------------------------------------------------------------------------


@query(f"SELECT vec_id, sqrt({_dot('embedding', 'embedding')}) AS norm FROM embeddings")
def vector_norms(spark, d):
    return _emb(spark, d).select("vec_id", V.norm(F.col("embedding")).alias("norm"))


@query(f"SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / sqrt({_dot('embedding', 'embedding')}), 12)) AS unit FROM embeddings")
def vector_normalize(spark, d):
    return _emb(spark, d).select("vec_id", F.transform(V.normalize(F.col("embedding")), lambda x: F.round(x, 12)).alias("unit"))


@query("SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 2.5) AS scaled FROM embeddings")
def vector_scale(spark, d):
    return _emb(spark, d).select("vec_id", V.scale(F.col("embedding"), 2.5).alias("scaled"))


@query("SELECT op_type, count(*) AS n, count(*) FILTER (WHERE vector IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0) AS n_valid FROM batch_ops GROUP BY op_type")
def vector_validity(spark, d):
    return read(spark, d, "batch_ops").groupBy("op_type").agg(F.count("*").alias("n"), F.count(F.when(V.valid(F.col("vector"), 64), 1)).alias("n_valid"))


@query(f"SELECT vec_id, {L2SQL} AS distance, {L2SQL} > 1.5 AS exceeded FROM embeddings, {_q()}")
def vector_l2_bounded(spark, d):
    dist, over = V.squared_l2_bounded(F.col("embedding"), V.literal(_vector(spark, d)), 1.5)
    return _emb(spark, d).select("vec_id", dist.alias("distance"), over.alias("exceeded"))


# filters --------------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang FROM documents WHERE source IS NOT NULL AND contains(source, 'forge')")
def filter_contains(spark, d):
    return FL.apply(read(spark, d, "documents"), [Filter("source", "contains", "forge")]).select("doc_id", "lang")


@query("SELECT doc_id, source FROM documents WHERE source IS NOT NULL AND source <> 'forge_main'")
def filter_missing_ne(spark, d):
    return FL.apply(read(spark, d, "documents"), [Filter("source", "ne", "forge_main")]).select("doc_id", "source")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) = 69.0")
def filter_numeric_coerce(spark, d):
    """An integer in JSON metadata equals a float of the same value."""
    e = read(spark, d, "events").withColumn("doc", F.try_parse_json("props"))
    return e.where(FL.lower_json(F.col("doc"), Filter("k", "eq", 69.0))).select("event_id", F.try_variant_get("doc", "$.k", "bigint").alias("k"))


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 90 AND CAST(json_extract(props, '$.k') AS DOUBLE) <> 95")
def filter_json_range(spark, d):
    e = read(spark, d, "events").withColumn("doc", F.try_parse_json("props"))
    for f in (Filter("k", "gte", 90), Filter("k", "ne", 95), Filter("k", "ne", "text")):
        e = e.where(FL.lower_json(F.col("doc"), f))
    return e.select("event_id")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20 AND l_returnflag IN ('A', 'R') AND l_discount > 0.05")
def filter_lineitem(spark, d):
    fs = [Filter("l_quantity", "gte", 10), Filter("l_quantity", "lte", 20), Filter("l_returnflag", "in", ["A", "R"]), Filter("l_discount", "gt", 0.05)]
    return FL.apply(read(spark, d, "lineitem"), fs).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey, CASE WHEN p_retailprice IS NOT NULL AND p_retailprice <> floor(p_retailprice) THEN 'p_retailprice' END AS bad FROM part")
def schema_validate(spark, d):
    """Which rows violate a declared schema that wants whole prices."""
    p = read(spark, d, "part")
    return p.select("p_partkey", F.try_element_at(FL.violations(p, {"p_retailprice": "int", "p_name": "string", "p_size": "float"}), F.lit(1)).alias("bad"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE n_chars IS NOT NULL AND n_chars > 2000 ORDER BY doc_id")
def scan_filtered(spark, d):
    return FL.apply(read(spark, d, "documents"), [Filter("n_chars", "gt", 2000)]).select("doc_id", "lang", "n_chars").orderBy("doc_id")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 17")
def get_by_id(spark, d):
    return read(spark, d, "documents").where("doc_id = 17").select("doc_id", "lang", "source", "n_chars")


# text -----------------------------------------------------------------------------------------------------

_DOCS = r"WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[\s\x00-\x20\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda t: t <> '') AS words FROM documents WHERE text IS NOT NULL AND length(text) > 0), n AS (SELECT count(*) AS n_docs, avg(len(words)) AS avg_len FROM w)"


def _bm25_sql(words: str, k: int) -> str:
    terms = words.split()
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms))
    return f"{_DOCS}, q AS (SELECT * FROM (VALUES {values}) v(pos, term)), f AS (SELECT w.id, q.pos, q.term, len(list_filter(w.words, lambda x: x = q.term)) AS tf, len(w.words) AS dl FROM w, q), df AS (SELECT term, count(DISTINCT id) AS df FROM f WHERE tf > 0 GROUP BY term), s AS (SELECT id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * 0.25 + 1.2 * 0.75 * dl / avg_len)) AS score FROM f JOIN df USING (term), n WHERE tf > 0 GROUP BY id), r AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s) SELECT id, round(score, 9) AS score FROM r WHERE rank <= {k}"


@query(_DOCS + ", p AS (SELECT id, unnest(words) AS term FROM w), t AS (SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM p GROUP BY term) SELECT term, df, cf, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 9) AS idf FROM t, n")
def bm25_terms(spark, d):
    return lexical.terms(read(spark, d, "documents"), "doc_id", "text").withColumn("idf", F.round("idf", 9))


@query(_bm25_sql("hidden matrix batch", 20))
def bm25_topk(spark, d):
    return lexical.bm25(read(spark, d, "documents"), "Hidden matrix batch", 20, "doc_id", "text").withColumn("score", F.round("score", 9))


@query(_bm25_sql("queue queue ledger", 20))
def bm25_duplicate_terms(spark, d):
    return lexical.bm25(read(spark, d, "documents"), "queue queue ledger", 20, "doc_id", "text").withColumn("score", F.round("score", 9))


@query(_bm25_sql("vector session", 50).replace("SELECT id, round(score, 9) AS score FROM r", f", lx AS (SELECT id, rank FROM r WHERE rank <= 50), vs AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {L2SQL}, vec_id) AS rank FROM embeddings, {_q()}), u AS (SELECT id, 1.0 / (60 + rank) AS s FROM lx UNION ALL SELECT id, 1.0 / (60 + rank) FROM vs WHERE rank <= 50), z AS (SELECT id, sum(s) AS score FROM u GROUP BY id), y AS (SELECT id, score, CAST(row_number() OVER (ORDER BY round(score, 12) DESC, id) AS INTEGER) AS rank FROM z) SELECT id, round(score, 12) AS score, rank FROM y").replace("WHERE rank <= 50, lx", ", lx").replace("FROM y WHERE rank <= 50", "FROM y WHERE rank <= 10 AND id IN (SELECT vec_id FROM embeddings)"))
def hybrid_rrf(spark, d):
    return fusion.hybrid(_emb(spark, d), read(spark, d, "documents"), _vector(spark, d), "vector session", K, 60, V.L2, "vec_id", "embedding", "doc_id", "text").withColumn("score", F.round("score", 12))


def _lexical_index(spark, d) -> lexical.LexicalIndex:
    """All documents added, those in go and SQL added once more with other texts, then SQL's deleted and go's replaced by their own again."""
    docs = read(spark, d, "documents").select("doc_id", "text", "lang")
    ix = lexical.LexicalIndex(spark, f"{shared_dir(spark)}/lexical-{uuid.uuid4().hex}", 16)
    ix.add(docs, "doc_id", "text")
    ix.add(docs.where("lang IN ('go', 'sql')").withColumn("text", F.concat_ws(" ", "text", F.lit("queue queue hidden"))), "doc_id", "text")
    ix.delete(docs.where("lang = 'sql'").select(F.col("doc_id").alias("id")))
    ix.add(docs.where("lang = 'go'"), "doc_id", "text")
    return ix


@query(_bm25_sql("hidden matrix batch", 20).replace(_DOCS, _DOCS.replace("text IS NOT NULL", "text IS NOT NULL AND lang IS DISTINCT FROM 'sql'")))
def lexical_index_topk(spark, d):
    """The kept index after replacements and deletes."""
    return _lexical_index(spark, d).search("Hidden matrix batch", 20).withColumn("score", F.round("score", 9))


# versions and sets ----------------------------------------------------------------------------------------

_LATEST = "WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE user_id IS NOT NULL{at})"


@query(_LATEST.format(at="") + " SELECT user_id, event_id, event_type, value FROM l WHERE rn = 1")
def latest_version(spark, d):
    return versions.latest(read(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query(_LATEST.format(at=" AND ts <= TIMESTAMP '2024-01-05'") + " SELECT user_id, event_id, event_type FROM l WHERE rn = 1")
def time_travel(spark, d):
    return versions.latest(read(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("ts") <= F.lit("2024-01-05").cast("timestamp_ntz")).select("user_id", "event_id", "event_type")


@query(_LATEST.format(at="") + " SELECT user_id, event_id, event_type FROM l WHERE rn = 1 AND event_type <> 'error'")
def tombstone_visible(spark, d):
    return versions.visible(read(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_id", "event_type")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')")
def tombstone_antijoin(spark, d):
    gone = read(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("vec_id"))
    return versions.without(_emb(spark, d), gone, "vec_id").select("vec_id", "label")


_SETS = ("SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'", "SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 45")


def _sets(spark, d):
    li = read(spark, d, "lineitem")
    return li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")), li.where("l_quantity > 45").select(F.col("l_orderkey").alias("k"))


@query(f"{_SETS[0]} INTERSECT {_SETS[1]}")
def set_and(spark, d):
    return versions.both(*_sets(spark, d))


@query(f"{_SETS[0]} UNION {_SETS[1]}")
def set_or(spark, d):
    return versions.either(*_sets(spark, d))


@query(f"{_SETS[0]} EXCEPT {_SETS[1]}")
def set_minus(spark, d):
    a, b = _sets(spark, d)
    return a.distinct().join(b, "k", "left_anti")


@query(f"({_SETS[0]} EXCEPT {_SETS[1]}) UNION ALL ({_SETS[1]} EXCEPT {_SETS[0]})")
def set_xor(spark, d):
    return versions.only_one(*_sets(spark, d))


# statistics -----------------------------------------------------------------------------------------------

_SEG = "SELECT *, CAST(floor(l_orderkey / 10000) AS BIGINT) AS seg FROM lineitem"
_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def _segments(spark, d):
    return read(spark, d, "lineitem").withColumn("seg", F.floor(F.col("l_orderkey") / 10000))


@query("WITH l AS (" + _SEG + "), u AS (" + " UNION ALL ".join(f"SELECT seg, '{c}' AS field, {c} AS x FROM l" for c in _COLS) + ") SELECT seg, field, count(*) AS n, min(x) AS min, max(x) AS max, round(sum(x), 2) AS sum, round(sum(x * x), 1) AS sum_sq, false AS has_nan, round(var_pop(x), 3) AS variance FROM u WHERE x IS NOT NULL GROUP BY seg, field")
def segment_stats_numeric(spark, d):
    s = stats.numeric(_segments(spark, d), "seg", _COLS)
    return s.withColumns({"sum": F.round("sum", 2), "sum_sq": F.round("sum_sq", 1), "variance": F.round("variance", 3)})


_EDGE = " + ".join(f"CASE WHEN lo + (hi - lo) * {stats.EDGES[i]!r} <= x THEN 1 ELSE 0 END" for i in range(1, stats.BINS))
_HIST = f"WITH l AS ({_SEG}), e AS (SELECT seg, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM l GROUP BY seg), h AS (SELECT seg, CAST({_EDGE} AS INTEGER) AS bin, x FROM (SELECT l.seg, l_extendedprice AS x, lo, hi FROM l JOIN e USING (seg) WHERE hi > lo)), b AS (SELECT seg, bin, count(*) AS n, min(x) AS lo, max(x) AS hi FROM h GROUP BY seg, bin)"


@query(_HIST + " SELECT seg, bin, n, lo, hi FROM b")
def segment_stats_histogram(spark, d):
    return stats.histogram(_segments(spark, d), "seg", "l_extendedprice")


@query(_HIST + ", p AS (SELECT seg, n / sum(n) OVER (PARTITION BY seg) AS p FROM b) SELECT seg, round(-sum(p * log2(p)) / 4, 9) AS entropy FROM p GROUP BY seg")
def segment_stats_entropy(spark, d):
    return stats.entropy(stats.histogram(_segments(spark, d), "seg", "l_extendedprice"), "seg").withColumn("entropy", F.round("entropy", 9))


_CAT = "WITH c AS (SELECT o_orderstatus AS seg, o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY n DESC, value) AS rank, n / sum(n) OVER (PARTITION BY seg) AS p FROM c)"


@query(_CAT + " SELECT seg, count(*) AS n_distinct, max(CASE WHEN rank = 1 THEN value END) AS dominant, round(max(p), 9) AS dominant_ratio, round(-sum(p * log2(p)) / log2(count(*)), 9) AS entropy FROM r GROUP BY seg")
def segment_stats_categorical(spark, d):
    o = read(spark, d, "orders").withColumnRenamed("o_orderstatus", "seg")
    return stats.categorical(o, "seg", "o_orderpriority").withColumns({"dominant_ratio": F.round("dominant_ratio", 9), "entropy": F.round("entropy", 9)})


@query(_CAT + " SELECT seg, value, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def segment_top_values(spark, d):
    return stats.top_values(read(spark, d, "orders").withColumnRenamed("o_orderstatus", "seg"), "seg", "o_orderpriority", 3)


_CENT = "WITH x AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i), c AS (SELECT label, list(m ORDER BY i) AS centroid FROM x GROUP BY label)"


@query(_CENT + " SELECT label, (SELECT count(*) FROM embeddings e WHERE e.label = c.label) AS n, list_transform(centroid, lambda m: round(m, 9)) AS centroid FROM c")
def segment_centroids_mean(spark, d):
    return stats.centroids(_emb(spark, d), "label", "embedding", DIM).withColumn("centroid", F.transform("centroid", lambda x: F.round(x, 9)))


@query(_CENT + f", y AS (SELECT e.label, sqrt({_l2('e.embedding', 'c.centroid')}) AS dist, sqrt({_dot('e.embedding', 'e.embedding')}) AS nrm FROM embeddings e JOIN c USING (label)), z AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist) AS r, count(*) OVER (PARTITION BY label) AS n FROM y) SELECT label, max(n) AS n, round(avg(nrm), 9) AS mean_norm, round(avg(dist), 9) AS avg_distance, round(max(CASE WHEN r = least(floor(n * 0.95), n - 1) + 1 THEN dist END), 9) AS radius_95, round(max(dist), 9) AS radius_max, avg(dist) / avg(nrm) < 0.5 AS is_clustered FROM z GROUP BY label")
def segment_stats_vector(spark, d):
    s = stats.vector_stats(_emb(spark, d), "label", "embedding", DIM)
    return s.select("label", "n", *(F.round(c, 9).alias(c) for c in ("mean_norm", "avg_distance", "radius_95", "radius_max")), "is_clustered")


@query("WITH l AS (" + _SEG + ") SELECT seg FROM l GROUP BY seg HAVING min(l_extendedprice) <= 1000 AND max(l_extendedprice) >= 1000")
def segment_prune(spark, d):
    return stats.prune(stats.numeric(_segments(spark, d), "seg", ["l_extendedprice"]), "seg", "l_extendedprice", Filter("l_extendedprice", "eq", 1000.0))


@query("WITH l AS (" + _SEG + "), s AS (SELECT seg, min(l_quantity) AS a, max(l_quantity) AS b FROM l GROUP BY seg) SELECT seg, CASE WHEN b > a THEN greatest(0.0, (least(20.0, b) - greatest(10.0, a)) / (b - a)) ELSE 0.0 END AS selectivity FROM s")
def segment_selectivity(spark, d):
    return stats.range_selectivity(stats.numeric(_segments(spark, d), "seg", ["l_quantity"]), 10.0, 20.0).select("seg", "selectivity")


@query("WITH l AS (SELECT o_custkey % 16 AS seg, o_orderkey, o_orderdate FROM orders), g AS (SELECT seg, o_orderdate >= lag(o_orderdate) OVER (PARTITION BY seg ORDER BY o_orderkey) AS ok FROM l) SELECT seg, bool_and(coalesce(ok, true)) AS is_sorted FROM g GROUP BY seg")
def segment_shape(spark, d):
    o = read(spark, d, "orders").withColumn("seg", F.col("o_custkey") % 16)
    return stats.is_sorted(o, "seg", "o_orderkey", "o_orderdate")


@query("SELECT field, value, count(*) AS n FROM (SELECT 'event_type' AS field, 's:' || event_type AS value FROM events UNION ALL SELECT 'user_id', 'i:' || user_id FROM events) WHERE value IS NOT NULL GROUP BY field, value")
def inverted_index(spark, d):
    return stats.inverted_index(read(spark, d, "events"), ["event_type", "user_id"])


@query("SELECT field, value, CASE WHEN id > 0 THEN 1 + (id - 1) // 32768 ELSE 0 END AS block, count(*) AS n FROM (SELECT event_id AS id, 'event_type' AS field, 's:' || event_type AS value FROM events UNION ALL SELECT event_id, 'user_id', 'i:' || user_id FROM events) WHERE value IS NOT NULL GROUP BY ALL")
def inverted_index_blocks(spark, d):
    return stats.inverted_bitmaps(read(spark, d, "events"), "event_id", ["event_type", "user_id"]).select("field", "value", "block", "n")


@query("SELECT event_id AS id FROM events WHERE event_type = 'click' AND user_id = 5")
def inverted_index_ids(spark, d):
    """Two conditions answered from the bitmaps alone."""
    return stats.bitmap_ids(stats.inverted_bitmaps(read(spark, d, "events"), "event_id", ["event_type", "user_id"]), [("event_type", "s:click"), ("user_id", "i:5")])


@query("SELECT DISTINCT o_custkey % 16 AS seg FROM orders WHERE o_orderkey IN (1, 7, 1000)")
def segment_bloom(spark, d):
    """Segments that hold one of three keys: those that their Bloom filters admit, then checked."""
    o = read(spark, d, "orders").withColumn("seg", F.col("o_custkey") % 16)
    may = stats.bloom(o, "seg", "o_orderkey", 1 << 18)
    some = F.lit(False)
    for k in (1, 7, 1000):
        some = some | stats.bloom_may_hold(F.lit(k).cast(o.schema["o_orderkey"].dataType), 1 << 18)
    return o.where(F.col("o_orderkey").isin(1, 7, 1000)).join(may.where(some).select("seg"), "seg", "left_semi").select("seg").distinct()


@query("SELECT o_custkey % 16 AS seg, count(*) AS total_rows, count(*) FILTER (o_orderstatus IS DISTINCT FROM 'F') AS live_rows, round(1 - count(*) FILTER (o_orderstatus IS DISTINCT FROM 'F') / count(*), 9) AS deleted_ratio, len(list_filter([max(o_orderpriority)], lambda x: x IS NOT NULL)) AS n_fields FROM orders GROUP BY seg")
def segment_totals(spark, d):
    """Rows, live rows (orders of status F count as deleted) and fields that occur."""
    o = read(spark, d, "orders").withColumns({"seg": F.col("o_custkey") % 16, "never": F.lit(None).cast("string")})
    s = stats.totals(o, "seg", ["o_orderpriority", "never"], F.col("o_orderstatus") == "F")
    return s.select("seg", "total_rows", "live_rows", F.round("deleted_ratio", 9).alias("deleted_ratio"), F.size("has_fields").cast("long").alias("n_fields"))


@query(_CAT + ", c2 AS (SELECT seg, count(*) AS k, max(CASE WHEN rank = 1 THEN value END) AS dom, max(p) AS r FROM r GROUP BY seg) SELECT seg, round(CASE WHEN dom = '1-URGENT' THEN r WHEN k > 1 THEN (1 - r) / (k - 1) ELSE 0 END, 9) AS selectivity FROM c2")
def segment_selectivity_categorical(spark, d):
    o = read(spark, d, "orders").withColumnRenamed("o_orderstatus", "seg")
    return stats.categorical_selectivity(stats.categorical(o, "seg", "o_orderpriority"), "1-URGENT").select("seg", F.round("selectivity", 9).alias("selectivity"))


# quantizers and partitions --------------------------------------------------------------------------------

_RANGE = "WITH x AS (SELECT i, min(embedding[i]::DOUBLE) AS lo, max(embedding[i]::DOUBLE) AS hi FROM embeddings, range(1, 65) r(i) GROUP BY i), g AS (SELECT list(lo ORDER BY i) AS lo, list(hi ORDER BY i) AS hi FROM x)"
_SQ8 = "list_transform(range(1, 65), lambda i: CAST(floor((least(greatest(embedding[i]::DOUBLE, lo[i]), hi[i]) - lo[i]) * 255.0 / (hi[i] - lo[i]) + 0.5) AS INTEGER))"


@query(f"{_RANGE} SELECT vec_id, {_SQ8} AS codes FROM embeddings, g")
def sq8_codes(spark, d):
    return quantize.with_ranges(_emb(spark, d), "embedding", DIM).select("vec_id", quantize.sq8_encode(F.col("embedding"), F.col("lo"), F.col("hi")).alias("codes"))


@query(f"{_RANGE}, c AS (SELECT vec_id, embedding, list_transform(list_zip({_SQ8}, lo, hi), lambda p: p[1] * (p[3] - p[2]) / 255.0 + p[2]) AS back FROM embeddings, g), a AS (SELECT c.vec_id, c.embedding, qv, row_number() OVER (ORDER BY {_l2('back', 'qv')}, vec_id) AS r FROM c, {_q()}), t AS (SELECT vec_id, {L2SQL} AS score FROM a WHERE r <= 40), u AS (SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score, vec_id) AS INTEGER) AS rank FROM t) SELECT * FROM u WHERE rank <= 10")
def sq8_search(spark, d):
    """Over-fetch 40 by decoded 8-bit codes, score again exactly."""
    q, e = _vector(spark, d), quantize.with_ranges(_emb(spark, d), "embedding", DIM)
    lo, hi = F.col("lo"), F.col("hi")
    near = e.select("vec_id", V.squared_l2(quantize.sq8_decode(quantize.sq8_encode(F.col("embedding"), lo, hi), lo, hi), V.literal(q)).alias("a")).orderBy("a", "vec_id").limit(40)
    return search.rerank(near, _emb(spark, d), q, K, V.L2, "vec_id", "embedding")


@query(f"{_RANGE}, n AS (SELECT vec_id, list_transform(range(1, 65), lambda i: CAST(floor(least(greatest((embedding[i]::DOUBLE - lo[i]) / (hi[i] - lo[i]), 0.0), 1.0) * 15.0 + 0.5) AS INTEGER)) AS nib FROM embeddings, g) SELECT vec_id, list_transform(range(32), lambda i: nib[2 * i + 1] * 16 + nib[2 * i + 2]) AS codes FROM n")
def int4_codes(spark, d):
    return quantize.with_ranges(_emb(spark, d), "embedding", DIM).select("vec_id", quantize.int4_encode(F.col("embedding"), F.col("lo"), F.col("hi")).alias("codes"))


@query(SQL["knn_l2"])
def rabitq_search(spark, d):
    """No fixed number of candidates: every row whose sign bits leave it a chance is scored exactly."""
    return quantize.rabitq_search(_emb(spark, d), _vector(spark, d), K, 10, "vec_id", "embedding")


def _label_centroids(spark, d):
    return stats.centroids(_emb(spark, d), "label", "embedding", DIM).select(F.col("label").cast("long").alias("cluster"), F.transform("centroid", lambda x: F.round(x, 9)).alias("centroid"))


_ASSIGN = _CENT + f", k AS (SELECT label AS cluster, list_transform(centroid, lambda m: round(m, 9)) AS centroid FROM c), a AS (SELECT vec_id, embedding, cluster, row_number() OVER (PARTITION BY vec_id ORDER BY {_l2('embedding', 'centroid')}, cluster) AS r FROM embeddings, k), z AS (SELECT * FROM a WHERE r = 1)"


@query(_ASSIGN + ", y AS (SELECT cluster, i, avg(embedding[i]::DOUBLE) AS m FROM z, range(1, 65) r(i) GROUP BY cluster, i) SELECT CAST(cluster AS BIGINT) AS cluster, (SELECT count(*) FROM z WHERE z.cluster = y.cluster) AS n, list(round(m, 9) ORDER BY i) AS centroid FROM y GROUP BY cluster")
def kmeans_one_iteration(spark, d):
    return ivf.update(_emb(spark, d), _label_centroids(spark, d), "embedding", DIM).withColumn("centroid", F.transform("centroid", lambda x: F.round(x, 9)))


def _fitted(spark, d) -> tuple[DataFrame, DataFrame, int, float]:
    """Rows assigned to about sqrt(n) partitions fitted to a bounded sample, centroids, probes and the recall they give over the vec_ids divisible by 100."""
    e = _emb(spark, d)
    cents = ivf.fit_sample(e, "embedding", DIM, max(1, min(ivf.MAX_CLUSTERS, round(e.count() ** 0.5))))
    cents = spark.createDataFrame([(i, c) for i, c in enumerate(cents.tolist())], "cluster long, centroid array<double>")
    rows = stored(ivf.assign(e, cents, "embedding", DIM).select("vec_id", "embedding", "cluster"), "partitions")
    return rows, cents, *ivf.probes_for(rows, cents, e.where("vec_id % 100 = 0").select("vec_id", "embedding"), K, DIM, 0.9, "vec_id", "embedding")


@query()
def ivf_probe_fitted(spark, d):
    """As many partitions of k-means as give a recall of 0.9."""
    rows, cents, probes, _ = _fitted(spark, d)
    return ivf.search(rows, cents, _vector(spark, d), K, probes, "vec_id", "embedding")


@query()
def ivf_recall(spark, d):
    """Probes of ``ivf_probe_fitted``, the partitions there are, and the recall against the exact search."""
    _, cents, probes, recall = _fitted(spark, d)
    return spark.createDataFrame([(cents.count(), probes, recall)], "partitions long, probes long, recall double")


@query(SQL["knn_l2"])
def ivf_probe(spark, d):
    """The nearest partitions first, then all whose ball could still hold a nearer row: the exact result."""
    e = _emb(spark, d)
    cents = ivf.fit_sample(e, "embedding", DIM, max(1, min(ivf.MAX_CLUSTERS, round(e.count() ** 0.5))))
    cents = spark.createDataFrame([(i, c) for i, c in enumerate(cents.tolist())], "cluster long, centroid array<double>")
    rows = stored(ivf.assign(e, cents, "embedding", DIM).select("vec_id", "embedding", "cluster", "cluster_distance"), "partitions", by="cluster")
    return ivf.search_exact(rows, cents, _vector(spark, d), K, 3, "vec_id", "embedding")


@query()
def pq_search(spark, d):
    e = _emb(spark, d)
    return quantize.pq_search(e, quantize.train_pq(e, "embedding", DIM, 16, 64), _vector(spark, d), K, 8, "vec_id", "embedding", DIM)


@query()
def opq_search(spark, d):
    e = _emb(spark, d)
    return quantize.pq_search(e, quantize.train_pq(e, "embedding", DIM, 16, 64, rotate=True), _vector(spark, d), K, 8, "vec_id", "embedding", DIM)


# manifests ------------------------------------------------------------------------------------------------

_MANIFEST = [(1, 3, 0), (2, 5, 0), (3, 12, 0), (4, 6, 0), (5, 8, 0), (6, 120, 1), (7, 11, 1)]


@query("SELECT * FROM (VALUES ('leveled', 1, 1), ('leveled', 2, 1), ('leveled', 3, 1), ('leveled', 4, 1), ('leveled', 5, 1), ('size_tiered', 1, 1), ('size_tiered', 2, 1), ('size_tiered', 4, 1), ('size_tiered', 5, 1), ('tiered', 1, 1), ('tiered', 2, 1), ('tiered', 3, 1), ('tiered', 4, 1), ('tiered', 5, 1), ('tiered', 6, 1), ('tiered', 7, 1)) v(policy, segment_id, target_level)")
def compaction_policy(spark, d):
    segs = [policies.Segment(i, mb * policies.MB, level) for i, mb, level in _MANIFEST]
    picks = {n: p(segs) for n, p in (("tiered", policies.tiered()), ("size_tiered", policies.size_tiered()), ("leveled", policies.leveled()))}
    return spark.createDataFrame([(n, s, m.level) for n, m in picks.items() if m for s in m.segments], "policy string, segment_id int, target_level int")


@query("WITH m AS (SELECT DISTINCT store_id, manifest_id FROM manifests), r AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY manifest_id DESC) AS r FROM m) SELECT store_id, manifest_id FROM r WHERE r > 3")
def vacuum_plan(spark, d):
    """Versions of each store that a policy of the latest and two more drops."""
    m = read(spark, d, "manifests").select("store_id", "manifest_id").distinct()
    return policies.Retention(versions=2).dropped(m, "store_id", "manifest_id").select("store_id", "manifest_id")


# the table itself -----------------------------------------------------------------------------------------


def _table(spark, d) -> VectorTable:
    """All vectors in version 1; those of label 3 deleted in 2, inserted again under other names in 3; compacted in 4."""
    e = _emb(spark, d).select(F.col("embedding").alias("vector"), "vec_id", "label")
    t = VectorTable.create(spark, f"{shared_dir(spark)}/table-{uuid.uuid4().hex}", DIM, metadata="vec_id long, label int")
    t.insert_rows(e)
    t.commit()
    t.delete_rows(t.rows([Filter("label", "eq", 3)]).select("id"))
    t.commit()
    t.insert_rows(e.where("label = 3").withColumn("vec_id", F.col("vec_id") + 1_000_000))
    t.commit()
    t.compact()
    return t


_TABLE = "WITH r AS (SELECT vec_id, label FROM embeddings WHERE label IS DISTINCT FROM 3 UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE label = 3)"


@query(_TABLE + " SELECT vec_id, label FROM r WHERE label >= 2")
def store_scan(spark, d):
    return VectorTable.open(spark, _table(spark, d).path).scan([Filter("label", "gte", 2)]).select("vec_id", "label")


@query("SELECT label, count(*) AS n FROM embeddings WHERE label <> 3 GROUP BY label")
def store_time_travel(spark, d):
    """Version 2, opened after the compaction."""
    return VectorTable.open(spark, _table(spark, d).path, version=2).rows().where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def store_as_of(spark, d):
    """Version 3 as of the last log number before the deletes."""
    t = _table(spark, d)
    return VectorTable.open(spark, t.path, version=3).rows(as_of=VectorTable.open(spark, t.path, version=1).manifest["max_lsn"]).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id = 7 AND label IS DISTINCT FROM 3 UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id = 7 AND label = 3")
def store_get(spark, d):
    t = _table(spark, d)
    found = t.scan([Filter("vec_id", "in", [7, 1_000_007])]).select("id").collect()  # at most one row
    return spark.createDataFrame([(r["vec_id"], r["label"]) for r in (t.get(x["id"]) for x in found)], "vec_id long, label int")


@query(_knn_sql(L2SQL, "ASC", "label IS NOT NULL AND label <> 3"))
def store_search(spark, d):
    return _table(spark, d).search(_vector(spark, d), K, [Filter("label", "ne", 3)], ["vec_id"]).select("vec_id", "score", "rank")


@query(_knn_sql(L2SQL, "ASC", "label IS NOT NULL AND label <> 3"))
def store_search_codes(spark, d):
    """The best 100 by the 8-bit codes that compaction stored, scored again with their vectors."""
    t = _table(spark, d)
    t.compact(partitions=16)
    return t.search(_vector(spark, d), K, [Filter("label", "ne", 3)], ["vec_id"], refine=10).select("vec_id", "score", "rank")


@query()
def store_search_recall(spark, d):
    """Recall@10 over the vec_ids divisible by 100 of searches that read half of the stored partitions, and codes first."""
    e, t = _emb(spark, d), _table(spark, d)
    t.compact(partitions=16)
    rows = t.rows().select("vec_id", "vector")
    asked = rows.where("vec_id % 100 = 0")
    truth = search.knn_batch(rows, asked, K, DIM, V.L2, "vec_id", "vector")
    found = None
    for r in asked.orderBy("vec_id").collect():  # a hundredth of the rows of a check table
        part = t.search(list(r["vector"]), K, (), ["vec_id"], nprobes=8, refine=8).select(F.lit(r["vec_id"]).alias("query_id"), F.col("vec_id").alias("id"))
        found = part if found is None else found.unionByName(part)
    return search.recall(found, truth, K).agg(F.avg("recall").alias("recall"))


@query("SELECT * FROM (VALUES (3), (4)) v(version)")
def store_vacuum(spark, d):
    """Versions left by a policy of the latest and one more."""
    t = _table(spark, d)
    t.vacuum(policies.Retention(versions=1))
    return spark.createDataFrame([(v,) for v in VectorTable.version_numbers(spark, t.path)], "version int")


# additions: event time ------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_tumbling_window(spark, d):
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = ingest.window_counts(e, "ts", ["event_type"], "1 hour", value="value")
    return w.select(F.col("window_start").cast("timestamp_ntz"), F.col("window_end").cast("timestamp_ntz"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM l) SELECT min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, user_id, count(*) AS n FROM s WHERE user_id IS NOT NULL GROUP BY user_id, g")
def ext_session_window(spark, d):
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).where("user_id IS NOT NULL")
    s = ingest.sessions(e, "ts", ["user_id"], "30 minutes")
    return s.select(F.col("session_start").cast("timestamp_ntz"), F.col("session_end").cast("timestamp_ntz"), "user_id", "n")
