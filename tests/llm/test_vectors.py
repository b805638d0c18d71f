import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vektorium.llm import grouping, neighbours, postings, vectors
from vektorium.sources.tables import stored

DIM = 16


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def live_of(spark, x, ids=None, dim=DIM):
    ops = [(i, "insert", int(k), v.tolist()) for i, (k, v) in enumerate(zip(ids if ids is not None else range(len(x)), x))]
    return stored(vectors.live_records(spark.createDataFrame(ops, "lsn long, op_type string, id long, vector array<float>").repartition(4), dim))


def indexed(live, list_size=64):
    lists = postings.build(live, DIM, list_size)
    return lists, stored(postings.index(vectors.copy_classes(live), lists, dim=DIM))


def test_live_records(spark):
    v, w = [1.0] * DIM, [2.0] + [0.0] * (DIM - 1)
    bad = [[1.0] * (DIM - 1), [], None, [0.0] * DIM, [float("nan")] * DIM, [float("inf")] + [1.0] * (DIM - 1), [None] * DIM]
    ops = [(1, "insert", 1, v), (2, "insert", 1, w), (2, "insert", 1, w), (3, "insert", 2, v), (4, "delete", 2, None), (5, "delete", 99, None), (7, "insert", 4, v), (6, "delete", 4, None)]
    ops += [(10 + i, "insert", 1, b) for i, b in enumerate(bad)] + [(None, "insert", 5, v), (30, "insert", None, v), (31, None, 6, v), (32, "insert", 7, [1e-38] + [0.0] * (DIM - 1)), (33, "insert", 8, [1e38] * DIM)]
    df = spark.createDataFrame(ops, "lsn long, op_type string, id long, vector array<float>").withColumn("code", F.lit("clash"))
    got = {r.id: np.frombuffer(bytes(r.code), np.float16).astype(float) for r in vectors.live_records(df, DIM).collect()}
    assert sorted(got) == [1, 4, 7, 8]
    assert got[1][0] == 1 and np.allclose(got[8], 0.25)
    assert vectors.live_records(df.limit(0), DIM).count() == 0


def test_codes_are_close():
    x = np.random.default_rng(0).normal(size=(200, 64)) * 1e5
    c = vectors.encode(x).astype(np.float32)
    assert np.abs(c @ c.T - unit(x) @ unit(x).T).max() < 5e-4


def exact_near(x, ids, k):
    s = unit(x) @ unit(x).T
    np.fill_diagonal(s, -9)
    return s, np.argsort(-s, axis=1, kind="stable")[:, :k]


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, DIM))
    x = (centres[rng.integers(0, 40, 1500)] + 0.25 * rng.normal(size=(1500, DIM))).astype(np.float32)
    live = live_of(spark, x)
    lists, index = indexed(live)
    s, near = exact_near(x, range(1500), 5)
    got = {}
    for r in neighbours.all_neighbours(live, index, 5, dim=DIM).collect():
        got.setdefault(r.id_a, set()).add(r.id_b)
    assert set(map(len, got.values())) == {5} and len(got) == 1500
    assert np.mean([len(got[i] & set(near[i].tolist())) / 5 for i in range(1500)]) >= 0.9


def test_recall_over_more_than_64_lists(spark):
    """Half of the 64-dimensional rows belong to no cluster; every row asks."""
    rng = np.random.default_rng(15)
    centres = rng.normal(size=(150, 64))
    x = np.concatenate([centres[rng.integers(0, 150, 2500)] + 0.5 * rng.normal(size=(2500, 64)), rng.normal(size=(2500, 64))]).astype(np.float32)
    live = live_of(spark, x, dim=64)
    lists = postings.build(live, 64, 50)
    assert len(lists.centroids) > 64
    index = stored(postings.wide_index(vectors.copy_classes(live), lists))
    _, near = exact_near(x, range(5000), 5)
    got = {}
    for r in neighbours.all_neighbours(live, index, 5).collect():
        got.setdefault(r.id_a, set()).add(r.id_b)
    recall = [len(got[i] & set(near[i].tolist())) / 5 for i in range(5000)]
    assert np.mean(recall) >= 0.95 and np.mean(recall[2500:]) >= 0.9


def test_a_third_are_copies(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, DIM)).astype(np.float32)
    x[:300] = x[0] * rng.uniform(0.5, 2, size=(300, 1)).round(1)
    x[300:303] = x[300]
    live = live_of(spark, x)
    _, index = indexed(live)
    assert index.agg(F.sum("n"), F.count("*")).first()[:2] == (900, index.select("rep").distinct().count()) and index.count() < 640
    got = {}
    for r in neighbours.all_neighbours(live, index, 5, 0.97, DIM).collect():
        got.setdefault(r.id_a, set()).add(r.id_b)
    assert all(len(got[i]) == 5 for i in range(300)) and got[300] >= {301, 302} and got[0] == {1, 2, 3, 4, 5} and got[3] == {0, 1, 2, 4, 5}


def test_long_lists_are_cut_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MAX_ROWS", 40)
    monkeypatch.setattr(neighbours, "MAX_VISITORS", 30)
    x = np.random.default_rng(7).normal(size=(400, DIM)).astype(np.float32)
    live = live_of(spark, x)
    _, index = indexed(live, 200)
    cut = {(r.id_a, r.id_b) for r in neighbours.all_neighbours(live, index, 3, dim=DIM).collect()}
    monkeypatch.undo()
    assert cut == {(r.id_a, r.id_b) for r in neighbours.all_neighbours(live, index, 3, dim=DIM).collect()}


def test_centroid_graph_finds_the_nearest():
    rng = np.random.default_rng(8)
    c = unit(rng.normal(size=(50, 32)))[rng.integers(0, 50, 600)] + 0.1 * rng.normal(size=(600, 32))
    lists = postings.Lists.over(unit(c).astype(np.float32))
    x = unit(c[rng.integers(0, 600, 500)] + 0.05 * rng.normal(size=(500, 32))).astype(np.float32)
    near, _ = lists.nearest(x, 5)
    assert (near[:, 0] == (x @ lists.centroids.T).argmax(1)).mean() > 0.9
    copies = postings.fit_centroids(np.tile(c[:1], (500, 1)).astype(np.float32), 10)
    assert len(copies) == 1


def test_neighbour_descent():
    rng = np.random.default_rng(9)
    x = unit(rng.normal(size=(30, 32))[rng.integers(0, 30, 600)] + 0.15 * rng.normal(size=(600, 32))).astype(np.float32)
    ids, sims = grouping.neighbour_descent(x, 8)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    want = np.argsort(-s, axis=1)[:, :8]
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(ids, want)]) > 0.9
    assert (ids != np.arange(600)[:, None]).all() and all(len(set(r)) == 8 for r in ids.tolist())
    for n in (1, 2, 3):
        grouping.neighbour_descent(x[:n], 8)


def test_modularity_merges():
    a, b = np.array([0, 1, 0, 3, 4, 3, 2]), np.array([1, 2, 2, 4, 5, 5, 3])
    w = np.array([1, 1, 1, 1, 1, 1, 0.1])
    label = grouping.merge_communities(6, a, b, w, w.sum())
    assert len(set(label[:3])) == 1 and len(set(label[3:])) == 1 and label[0] != label[3]
    assert grouping.merge_communities(3, a[:0], b[:0], w[:0], 1.0).tolist() == [0, 1, 2]


def groups_of(spark, x, list_size):
    live = live_of(spark, x)
    lists, index = indexed(live, list_size)
    found = grouping.groups(live, index, lists, dim=DIM)
    return grouping.members_of(found, live, index)


def test_groups_with_one_of_a_third_of_all_rows(spark):
    rng = np.random.default_rng(10)
    centres = np.linalg.qr(rng.normal(size=(DIM, DIM)))[0]
    sizes = [700, 60, 12, 5, 4, 1, 1]
    x, want, at = [], {}, 0
    for c, n in zip(centres, sizes):
        x.append(unit(c + 0.08 * rng.normal(size=(n, DIM))))
        if n >= 5:
            want |= {i: at for i in range(at, at + n)}
        at += n
    x.append(np.repeat(-centres[7:8], 6, axis=0))  # six copies are a group
    want |= {i: at for i in range(at, at + 6)}
    m = groups_of(spark, np.concatenate(x).astype(np.float32), 64)
    assert {r.id: r.group_id for r in m.collect()} == want
    top = {r.group_id: r for r in grouping.typical(m, live_of(spark, np.concatenate(x).astype(np.float32)), 3, DIM).collect()}
    assert top[0]["size"] == 700 and len(top[0]["typical_ids"]) == 3 
    y = unit(np.concatenate(x)[:700])
    assert top[0]["typical_ids"] == np.argsort(-np.round((y @ y.T).sum(1) - 1, 3), kind="stable")[:3].tolist()


def test_cut_lists_and_hot_classes_give_the_same_groups(spark, monkeypatch):
    rng = np.random.default_rng(12)
    centres = np.linalg.qr(rng.normal(size=(DIM, DIM)))[0]
    x = np.concatenate([unit(c + 0.08 * rng.normal(size=(n, DIM))) for c, n in zip(centres, [400, 90, 30])] + [np.repeat(centres[5:6], 40, axis=0)]).astype(np.float32)
    want = {r.id: r.group_id for r in groups_of(spark, x, 64).collect()}
    assert len(want) == 560 and len(set(want.values())) == 4
    monkeypatch.setattr(grouping, "MAX_ROWS", 25)
    monkeypatch.setattr(vectors, "HOT", 35)
    assert {r.id: r.group_id for r in groups_of(spark, x, 64).collect()} == want
    monkeypatch.setattr(grouping, "PASSES", 1)
    with pytest.raises(RuntimeError):
        groups_of(spark, x, 64)


def test_many_communities_of_one_group_give_few_edges():
    rng = np.random.default_rng(13)
    c = np.eye(32)[0]
    x = unit(c + 0.05 * rng.normal(size=(6000, 32))).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(6000, np.int32)), pa.array(np.zeros(6000, np.int32)), pa.array(np.arange(6000)), pa.array(np.ones(6000, np.int64)), vectors.codes_to_array(x.astype(np.float16))], names=["list", "part", "comm", "n", "mean"])
    pairs = sum(len(b) for b in grouping._near_means(iter([batch]), 32))
    assert pairs == 5999
    tie = grouping.representatives(np.concatenate([x[:100], -x[:50], np.eye(32, dtype=np.float32)[5:9]]), 0.72, 16)
    assert len(set(tie.tolist())) == 6


def test_no_groups(spark):
    x = np.eye(DIM, dtype=np.float32)
    assert groups_of(spark, x, 8).count() == 0


def test_empty_log(spark):
    ops = spark.createDataFrame([], "lsn long, op_type string, id long, vector array<float>")
    live = stored(vectors.live_records(ops, DIM))
    lists, index = indexed(live)
    assert neighbours.all_neighbours(live, index, 5, dim=DIM).count() == 0
    assert grouping.members_of(grouping.groups(live, index, lists, dim=DIM), live, index).count() == 0


@pytest.mark.parametrize("n", [1, 3])
def test_few_records(spark, n):
    live = live_of(spark, np.random.default_rng(n).normal(size=(n, DIM)).astype(np.float32))
    lists, index = indexed(live)
    assert neighbours.all_neighbours(live, index, 5, dim=DIM).count() == n * (n - 1)
