import time

import pytest
from pyspark.sql import functions as F

from vektorium.operators import policies
from vektorium.operators.filters import Filter
from vektorium.sources import store
from vektorium.sources.store import VectorTable
from vektorium.streaming import ingest


@pytest.fixture
def table(spark, tmp_path):
    return VectorTable.create(spark, str(tmp_path / "t"), 2, metadata="tag string, n int", declared={"n": "int"})


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_life_of_a_record(spark, table):
    a = table.insert([1.0, 0.0], {"tag": "x", "n": 1}, b"p")
    b, c = table.insert_many([[0.0, 1.0], [5.0, 5.0]], [{"tag": "y"}, {}])
    assert (a, b, c) == (1, 2, 3) and ids(table.search([1.0, 0.0], 2)) == [1, 2]
    table.delete(b, 99)
    assert ids(table.scan()) == [1, 3]
    v = table.commit()
    assert v == 1 and table.commit() == 1
    again = VectorTable.open(spark, table.path)
    assert bytes(again.get(1)["payload"]) == b"p" and again.get(1)["tag"] == "x"
    with pytest.raises(store.NotFound):
        again.get(2)
    assert ids(again.scan([Filter("n", "eq", 1)])) == [1]
    assert again.insert([0.0, 0.0]) == 4
    again.close()
    with pytest.raises(store.Closed):
        again.commit()
    assert ids(VectorTable.open(spark, table.path).scan()) == [1, 3]


def test_refused_inserts(table):
    for bad in ([1.0], [1.0, float("nan")], [1.0, float("inf")]):
        with pytest.raises(store.InvalidArgument):
            table.insert(bad)
    with pytest.raises(store.InvalidArgument):
        table.insert([1.0, 2.0], {"unknown": 1})
    with pytest.raises(store.InvalidArgument):
        table.search([1.0], 3)
    assert table.insert_many([]) == [] and table.search([1.0, 0.0], 3).count() == 0


def test_deferred_rows_wait_for_commit(table):
    table.insert_many([[1.0, 1.0]], searchable=False)
    assert table.search([1.0, 1.0], 1).count() == 0 and ids(table.scan()) == [1]
    table.commit()
    assert ids(table.search([1.0, 1.0], 1)) == [1]


def test_time_travel_compaction_vacuum(spark, table):
    for k in range(3):
        table.insert_many([[float(k), float(i)] for i in range(4)], [{"n": k}] * 4)
        table.commit()
        if k == 0:
            t1 = time.time()
            time.sleep(0.05)
    table.delete(1)
    table.commit()
    assert len(ids(VectorTable.open(spark, table.path, version=1).scan())) == 4
    old = VectorTable.open(spark, table.path, timestamp=t1)
    assert len(ids(old.scan())) == 4
    with pytest.raises(store.ReadOnly):
        old.insert([0.0, 0.0])
    with pytest.raises(store.NotFound):
        VectorTable.open(spark, table.path, timestamp=1.0)
    table.compact(policy=policies.tiered(3))
    assert table.stats()["segments"] == 1 and len(ids(table.scan())) == 11 and table.stats()["rows"] == 11
    assert len(ids(VectorTable.open(spark, table.path, version=2).scan())) == 8
    assert table.vacuum(policies.Retention()) == []
    assert table.vacuum(policies.Retention(versions=1))
    with pytest.raises(store.NotFound):
        VectorTable.open(spark, table.path, timestamp=t1)
    assert len(ids(VectorTable.open(spark, table.path).scan())) == 11
    assert table.segments().count() == 1


def test_two_writers(spark, table):
    other = VectorTable.open(spark, table.path)
    table.insert([1.0, 1.0])
    other.insert([2.0, 2.0])
    table.commit()
    with pytest.raises(store.Conflict):
        other.commit(attempts=1)


def test_segments_are_skipped(spark, table):
    for k in (1, 50):
        table.insert([1.0, 1.0], {"n": k})
        table.commit()
    assert len(table.rows([Filter("n", "gt", 10)]).inputFiles()) < len(table.rows().inputFiles())
    assert ids(table.rows([Filter("n", "gt", 10)])) == [2]


def test_searches(spark, table):
    table.insert_many([[0.1, 0.1], [10.0, 10.0], [10.0, 10.1]], [{"tag": "apple fruit"}, {"tag": "banana fruit"}, {"tag": "apple pie"}])
    assert [r["id"] for r in table.search_hybrid([0.0, 0.0], "banana", 3, "tag").orderBy("rank").collect()][0] == 2
    assert ids(table.search_threshold([0.0, 0.0], 1.0, 3)) == [1]
    q = spark.createDataFrame([(7, [10.0, 10.0])], "q long, v array<float>")
    assert [r["id"] for r in table.search_batch(q, 2).orderBy("rank").collect()] == [2, 3]
    assert table.search([0.0, 0.0], 1, columns=["tag"]).columns == ["id", "tag", "score", "rank"]


def test_policies():
    MB = policies.MB
    segs = [policies.Segment(i, 5 * MB) for i in (4, 2, 3, 1)]
    assert policies.size_tiered()(segs) == policies.Merge((1, 2, 3, 4), 1)
    assert policies.size_tiered()([policies.Segment(i, 900 * MB) for i in range(4)]).segments == (0, 1)
    assert policies.leveled()([policies.Segment(1, 200 * MB, 1), policies.Segment(2, 5 * MB, 1)]) == policies.Merge((1,), 2)
    assert policies.tiered()([]) is None and policies.leveled()(segs[:3]) is None
    assert policies.Retention(versions=1).keep([(1, 0), (2, 5), (3, 9)], 10) == {2, 3}
    assert policies.Retention(seconds=6).keep([(1, 0), (2, 5), (3, 9)], 10) == {2, 3}


def test_stream_into_a_table(spark, table, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([([1.0, 0.0], "a", 1), ([0.0, 1.0], "b", 2)], "vector array<float>, tag string, n int").write.parquet(src)
    stream = spark.readStream.schema("vector array<float>, tag string, n int").parquet(src)
    ingest.to_table(stream, table, str(tmp_path / "ck")).awaitTermination()
    assert ids(VectorTable.open(spark, table.path).scan()) == [1, 2]
    spark.createDataFrame([([1.0, 1.0], "c", 3)], "vector array<float>, tag string, n int").write.mode("append").parquet(src)
    ingest.to_table(spark.readStream.schema("vector array<float>, tag string, n int").parquet(src), table, str(tmp_path / "ck")).awaitTermination()
    assert ids(VectorTable.open(spark, table.path).scan()) == [1, 2, 3]


def test_stream_windows(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    got = ingest.run_to_memory(ingest.window_counts(stream, "ts", ["event_type"], "1 hour"), "w1", "complete")
    assert got.agg(F.sum("n")).first()[0] == e.count()
    once = ingest.run_to_memory(ingest.once(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), "ts", ["event_id"], "100 days"), "w2")
    assert once.count() == e.select("event_id").distinct().count()


def test_bounds_of_large_whole_numbers(spark, tmp_path):
    t = VectorTable.create(spark, str(tmp_path / "big"), 1, metadata="n long, x double")
    big = 9007199254740993
    t.insert_many([[0.0], [1.0]], [{"n": big, "x": float("nan")}, {"n": big, "x": float("inf")}])
    t.commit()
    for op in ("eq", "gte", "lte"):
        assert ids(t.scan([Filter("n", op, big)])) == [1, 2]
    assert ids(t.scan([Filter("n", "gt", big - 1)])) == [1, 2] and ids(t.scan([Filter("n", "gt", big)])) == []
    assert ids(t.scan([Filter("x", "gt", 5.0)])) == [2]


def test_a_commit_that_comes_second_is_repeated(spark, table):
    table.insert_many([[1.0, 0.0]])
    table.commit()
    a, b = VectorTable.open(spark, table.path), VectorTable.open(spark, table.path)
    assert a.insert([2.0, 0.0], {"tag": "a"}) == 2 and b.insert([3.0, 0.0], {"tag": "b"}) == 2
    b.insert([4.0, 0.0], {"tag": "gone"})
    b.delete(3)
    assert a.commit() == 2 and b.commit() == 3 and b.commit() == 3
    now = VectorTable.open(spark, table.path)
    assert sorted((r.id, r.tag) for r in now.scan().collect()) == [(1, None), (2, "a"), (3, "b")]
    assert now.insert([0.0, 0.0]) == 5
    c, d = VectorTable.open(spark, table.path), VectorTable.open(spark, table.path)
    c.delete(1)
    d.delete(1)
    c.commit()
    with pytest.raises(store.Conflict):
        d.commit(attempts=1)


def test_as_of_a_log_number(spark, table):
    table.insert_many([[1.0, 0.0], [2.0, 0.0]])
    table.delete(1)
    table.commit()
    table.insert([3.0, 0.0])
    assert [ids(table.rows(as_of=n)) for n in range(5)] == [[], [1], [1, 2], [2], [2, 3]]


def test_batches_flushes_and_figures(spark, table):
    seen = []
    t = VectorTable.open(spark, table.path, flush_rows=3, observer=lambda event, facts: seen.append((event, facts.get("rows"))))
    b = store.WriteBatch()
    b.add_insert([1.0, 0.0], {"tag": "x"})
    b.add_insert([2.0, 0.0])
    b.add_delete(7)
    assert len(b) == 3 and t.apply(b) == [1, 2] and len(b) == 0
    assert t.manifest["version"] == 0
    t.insert([3.0, 0.0])
    assert t.manifest["version"] == 1 and seen == [("commit", 3)]
    assert [r.id for r in t.search_iter([0.0, 0.0], 2)] == [1, 2]
    stray = t._segment(t.rows(), 99, 0)["path"]
    assert t.orphans() == [] and [x.rsplit("/", 1)[1] for x in t.orphans(older_than=-5)] == [stray.rsplit("/", 1)[1]] and ids(t.scan()) == [1, 2, 3]


def test_compaction_lowers_the_number_of_files(spark, table):
    for i in range(3):
        table.insert_rows(spark.range(40).selectExpr("array(cast(id as float), 0f) AS vector", "cast(id as int) AS n").repartition(4))
        table.commit()
    table.compact()
    assert len(table.rows().inputFiles()) == 1 and table.stats()["rows"] == 120


def test_stored_partitions_and_codes(spark, tmp_path):
    import numpy as np

    r = np.random.default_rng(3)
    x = (r.normal(size=(12, 16))[r.integers(0, 12, 900)] + 0.2 * r.normal(size=(900, 16))).astype(np.float32)
    t = VectorTable.create(spark, str(tmp_path / "p"), 16, metadata="n long")
    t.insert_rows(spark.createDataFrame([(v.tolist(), i) for i, v in enumerate(x)], "vector array<float>, n long"))
    t.commit()
    t.delete_rows(t.rows([Filter("n", "gte", 800)]).select("id"))
    t.commit()
    t.compact(partitions=12)
    t.insert(x[5].tolist(), {"n": 5000})
    got = {}
    for q in (5, 77, 300):
        s = ((x[:800] - x[q]) ** 2).sum(1)
        exact = [r_.n for r_ in t.search(x[q].tolist(), 5, columns=["n"]).orderBy("rank").collect()]
        for kw in ({"nprobes": 3}, {"refine": 8}, {"nprobes": 3, "refine": 8}):
            found = t.search(x[q].tolist(), 5, columns=["n"], **kw).orderBy("rank").collect()
            got.setdefault(str(kw), []).append(len({r_.n for r_ in found} & set(exact)) / 5)
            assert all(r_.score == pytest.approx(s[r_.n] if r_.n < 5000 else s[5], abs=1e-5) for r_ in found)
    assert min(np.mean(v) for v in got.values()) >= 0.9
    assert len(ids(t.scan())) == 801 and ids(t.scan([Filter("n", "eq", 7)])) == [t.scan([Filter("n", "eq", 7)]).first().id]
    plan = t._candidates(x[5].tolist(), 5, (), 3, None)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cluster" in plan
    assert t.search(x[5].tolist(), 3, [Filter("n", "lt", 0)], nprobes=2, refine=4).count() == 0
    again = VectorTable.open(spark, t.path)
    again.compact()  # back to plain rows
    assert again.stats()["rows"] == 800 and again.get(1)["n"] is not None
