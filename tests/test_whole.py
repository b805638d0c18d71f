import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vektorium.operators import quantize, search
from vektorium.sources.tables import read

LARGE = "/root/testdata/sf0.1"


def test_rabitq_exact_loses_nothing(spark):
    e = read(spark, LARGE, "embeddings")
    truth = search.knn_batch(e, e.where("vec_id % 100 = 0").select("vec_id", "embedding"), 10, 64, id_col="vec_id", vec_col="embedding")
    want = {r.query_id: set(r.ids) for r in truth.groupBy("query_id").agg(F.collect_set("id").alias("ids")).collect()}
    vectors = {r.vec_id: list(r.embedding) for r in e.where("vec_id % 100 = 0").collect()}
    for q in sorted(want)[:4]:
        assert {r.vec_id for r in quantize.rabitq_search(e, vectors[q], 10, 10, "vec_id", "embedding").collect()} == want[q]
    assert {r.vec_id for r in entry.queries()["rabitq_search"](spark, LARGE).collect()} == want[0]


def test_sign_bound_prunes_only_what_is_farther(spark):
    r = np.random.default_rng(4)
    x = (r.normal(size=(400, 70)) * r.uniform(0.1, 9, (400, 1))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    q = x[7].astype(float)
    from vektorium.functions import vector as V

    got = np.array([(b.lb, b.d) for b in df.select(quantize.sign_bound(V.sign_words(F.col("v"), dim=70), V.norm(F.col("v")), q.tolist()).alias("lb"), V.squared_l2(F.col("v"), V.literal(q)).alias("d")).collect()])
    assert (got[:, 0] <= got[:, 1] + 1e-9 * (q @ q + (x * x).sum(1))).all()
    assert (got[:, 0] > np.sort(got[:, 1])[9]).any()
    want = np.argsort(((x - q) ** 2).sum(1))[:10].tolist()
    assert [b.id for b in quantize.rabitq_search(df, q.tolist(), 10, 1, "id", "v").orderBy("rank").collect()] == want


def test_fitted_partitions_reach_their_recall(spark):
    got = entry.queries()["ivf_recall"](spark, LARGE).first()
    assert got.partitions == 45 and got.probes < got.partitions and got.recall >= 0.9


@pytest.mark.parametrize("name", ["recall_at_k", "knn_filtered_multi"])
def test_no_id_prefix(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{LARGE}/embeddings.parquet')")
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = sorted(map(tuple, cur.fetchall()))
    got = sorted(map(tuple, entry.queries()[name](spark, LARGE).select(*cols).collect()))
    assert got == want and len(got) == (20 if name == "recall_at_k" else 10)
    assert max(r[cols.index("query_id" if "query_id" in cols else "vec_id")] for r in got) > 400
    if name == "recall_at_k":
        print("mean recall", sum(r[1] for r in got) / len(got))


