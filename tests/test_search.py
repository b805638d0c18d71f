import numpy as np
import pytest
from pyspark.sql import functions as F

from vektorium.functions import vector as V
from vektorium.operators import fusion, ivf, lexical, quantize, search, stats, versions
from vektorium.operators.filters import Filter

VECS = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, [0.0, 0.0, 1.0, 0.0]), (4, [0.0, 0.0, 0.0, 1.0]), (5, [0.5, 0.5, 0.0, 0.0])]


@pytest.fixture(scope="module")
def basis(spark):
    return spark.createDataFrame(VECS, "id long, vector array<float>")


def ids(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


def test_l2_order(basis):
    assert ids(search.knn(basis, [1.0, 0.1, 0.0, 0.0], 3)) == [1, 5, 2]


def test_cosine_and_dot(basis):
    assert ids(search.knn(basis, [2.0, 0.1, 0.0, 0.0], 2, V.COSINE)) == [1, 5]
    assert ids(search.knn(basis, [0.0, 0.0, 3.0, 1.0], 2, V.DOT)) == [3, 4]


def test_ties_go_to_the_lower_id(basis):
    assert ids(search.knn(basis, [0.0, 0.0, 0.0, 0.0], 5))[0] == 5 and ids(search.knn(basis, [0.0, 0.0, 0.0, 0.0], 5))[1:] == [1, 2, 3, 4]


def test_bad_arguments(basis):
    with pytest.raises(ValueError):
        search.knn(basis, [1.0, 0, 0, 0], 0)
    with pytest.raises(ValueError):
        search.knn(basis, [0.0, 0, 0, 0], 1, V.COSINE)


def test_invalid_rows_never_match(spark):
    rows = [(1, None), (2, []), (3, [1.0]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, [None, 0.0]), (7, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    assert ids(search.knn(df, [0.0, 0.0], 10)) == [7]
    q = spark.createDataFrame([(0, [0.0, 0.0]), (1, None)], "qid long, v array<float>")
    assert [(r.query_id, r.id) for r in search.knn_batch(df, q, 3, 2).collect()] == [(0, 7)]


def test_empty(spark, basis):
    empty = basis.limit(0)
    assert search.knn(empty, [1.0, 0, 0, 0], 3).count() == 0
    assert search.knn_batch(empty, basis, 3, 4).count() == 0
    assert search.knn_batch(basis, empty, 3, 4).count() == 0


def test_clashing_extra_columns(basis):
    df = basis.withColumn("score", F.lit("mine")).withColumn("rank", F.lit(9))
    assert ids(search.knn(df, [1.0, 0.1, 0, 0], 2)) == [1, 5]


@pytest.mark.parametrize("metric", [V.L2, V.COSINE, V.DOT])
def test_batch_equals_single(spark, metric):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").repartition(3)
    got = search.knn_batch(df, df.where("id < 5"), 7, 8, metric).collect()
    for q in range(5):
        want = [(r["id"], round(r["score"], 6)) for r in search.knn(df, x[q].tolist(), 7, metric).orderBy("rank").collect()]
        assert [(r["id"], round(r["score"], 6)) for r in sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])] == want


def test_threshold_comes_after_the_top(basis):
    top = search.knn_threshold(basis, [1.0, 0.1, 0.0, 0.0], 0.5, 1)
    assert [r["id"] for r in top.collect()] == [1]
    assert search.knn_threshold(basis, [1.0, 0.1, 0.0, 0.0], 0.5, 5).count() == 2


def test_top_k_plan(basis):
    from vektorium.plans.explain import physical

    assert "TakeOrderedAndProject" in physical(search.knn(basis, [1.0, 0, 0, 0], 3).drop("rank"))


def test_recall(spark):
    a = spark.createDataFrame([(0, 1), (0, 2), (1, 5)], "query_id long, id long")
    b = spark.createDataFrame([(0, 2), (0, 3), (1, 5), (1, 6)], "query_id long, id long")
    assert {r.query_id: r.recall for r in search.recall(a, b, 2).collect()} == {0: 0.5, 1: 0.5}


DOCS = [(1, "the quick brown fox"), (2, "jumped over the lazy dog"), (3, "quick brown dogs"), (4, "fox and dog"), (5, None), (6, "")]


def test_bm25(spark):
    df = spark.createDataFrame(DOCS, "id long, text string")
    assert {r.id for r in lexical.bm25(df, "fox", 10, "id", "text").collect()} == {1, 4}
    twice, once = lexical.bm25(df, "fox fox", 1, "id", "text").first(), lexical.bm25(df, "fox", 1, "id", "text").first()
    assert twice.score == pytest.approx(2 * once.score)
    assert lexical.bm25(df, "", 3, "id", "text").count() == 0
    assert lexical.bm25(df, "unseen", 3, "id", "text").count() == 0
    assert lexical.bm25(df.limit(0), "fox", 3, "id", "text").count() == 0
    assert lexical.postings(df, "id", "text").where("term = 'quick'").count() == 2


def test_bm25_unicode_and_numbers(spark):
    df = spark.createDataFrame([(1, "Héllo wörld 你好"), (2, "HÉLLO test"), (3, "42 -- x")], "id long, text string")
    assert {r.id for r in lexical.bm25(df, "héllo", 10, "id", "text").collect()} == {1, 2}
    assert [r.id for r in lexical.bm25(df, "42", 10, "id", "text").collect()] == [3]


def test_rrf(spark):
    v = spark.createDataFrame([(1, [0.1, 0.1], "apple fruit"), (2, [10.0, 10.0], "banana fruit"), (3, [10.0, 10.1], "apple pie")], "id long, vector array<float>, text string")
    top = fusion.hybrid(v, v, [0.0, 0.0], "banana", 10).orderBy("rank").collect()
    assert top[0]["id"] == 2 and top[0]["score"] == pytest.approx(1 / 62 + 1 / 61)
    only = fusion.hybrid(v, v, [0.0, 0.0], "banana", 10, filters=[Filter("id", "eq", 1)]).collect()
    assert {r["id"] for r in only} == {1, 2}


def test_hamming_and_signs(spark):
    df = spark.createDataFrame([([1.0] * 64 + [-1.0] * 6, [-1.0] + [1.0] * 63 + [1.0] * 6)], "a array<float>, b array<float>")
    a, b = V.sign_words(F.col("a"), dim=70), V.sign_words(F.col("b"), dim=70)
    assert df.select(V.hamming(a, b)).first()[0] == 7


def test_normalize_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    assert [r[0] for r in df.select(V.normalize(F.col("v"))).collect()] == [None, [0.6, 0.8]]


def test_scalar_quantizers_round_trip(spark):
    r = np.random.default_rng(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(60, 7)).astype(np.float32))], "id long, v array<float>")
    e = quantize.with_ranges(df, "v", 7)
    lo, hi = F.col("lo"), F.col("hi")
    for back, levels in ((quantize.sq8_decode(quantize.sq8_encode(F.col("v"), lo, hi), lo, hi), 255), (quantize.int4_decode(quantize.int4_encode(F.col("v"), lo, hi), lo, hi), 15)):
        for row in e.select("v", "lo", "hi", back.alias("b")).collect():
            step = (np.array(row.hi) - np.array(row.lo)) / levels
            assert (np.abs(np.array(row.b) - np.array(row.v)) <= step / 2 + 1e-6).all()


@pytest.mark.parametrize("rotate", [False, True])
def test_product_quantizer(spark, rotate):
    r = np.random.default_rng(2)
    x = (r.normal(size=(10, 16))[r.integers(0, 10, 400)] + 0.1 * r.normal(size=(400, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    pq = quantize.train_pq(df, "vector", 16, 4, 32, rotate)
    assert ((pq.decode(pq.encode(x.astype(float))) - x) ** 2).sum(1).mean() < 0.3 * ((x - x.mean(0)) ** 2).sum(1).mean()
    hits = 0
    for q in range(10):
        want = set(np.argsort(((x - x[q]) ** 2).sum(1))[:5].tolist())
        hits += len(want & {r_["id"] for r_ in quantize.pq_search(df, pq, x[q].tolist(), 5, 10, "id", "vector", 16).collect()})
    assert hits >= 45


def test_kmeans_and_probe(spark):
    pts = [(i, [float(i % 2 * 10), float(i) / 100]) for i in range(20)]
    df = spark.createDataFrame(pts, "id long, vector array<float>")
    cents = ivf.fit(df, "vector", 2, 2, 3)
    assert {round(c.centroid[0]) for c in cents.collect()} == {0, 10}
    out = ivf.search(ivf.assign(df, cents, "vector", 2), cents, [10.0, 0.0], 3)
    assert [r["id"] for r in out.orderBy("rank").collect()] == [1, 3, 5]


def test_statistics_edges(spark):
    df = spark.createDataFrame([(1, 1.0), (1, float("nan")), (1, 3.0), (2, None), (3, 5.0)], "s long, x double")
    got = {r.s: r for r in stats.numeric(df, "s", ["x"]).collect()}
    assert (got[1].n, got[1].min, got[1].max, got[1].has_nan, got[1].variance) == (2, 1.0, 3.0, True, 1.0)
    assert 2 not in got and got[3].variance == 0.0
    assert stats.histogram(df, "s", "x").agg(F.sum("n")).first()[0] == 2
    assert stats.numeric(df.limit(0), "s", ["x"]).count() == 0
    assert {r.s: r.entropy for r in stats.entropy(spark.createDataFrame([(1, 5), (1, 5), (2, 9)], "s long, n long"), "s", bins=None).collect()} == {1: 1.0, 2: 0.0}


def test_pruning_never_loses_rows():
    num, cat = {"x": (1.0, 5.0)}, {"c": {"a", "b"}}
    fields = ["x", "c"]
    may = lambda f: stats.may_match(num, cat, fields, f)
    assert may(Filter("x", "eq", 3)) and not may(Filter("x", "eq", 9)) and not may(Filter("x", "gt", 5)) and may(Filter("x", "ne", 3))
    assert may(Filter("c", "eq", "a")) and not may(Filter("c", "in", ["z", "y"])) and not may(Filter("zzz", "ne", 1)) and may(Filter("c", "ne", 5))


def test_latest_and_tombstones(spark):
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "del"), (2, 1, "a"), (2, 1, "a"), (None, 5, "a")], "id long, lsn long, op string")
    assert {(r.id, r.lsn) for r in versions.latest(log, "id", ["lsn"]).collect()} == {(1, 2), (2, 1)}
    assert [r.id for r in versions.visible(log, "id", ["lsn"], F.col("op") == "del").collect()] == [2]
    assert [r.id for r in versions.visible(log, "id", ["lsn"], F.col("op") == "del", F.col("lsn") < 2).orderBy("id").collect()] == [1, 2]
    assert versions.only_one(log.select("id"), log.select("id").limit(0)).count() == 3
