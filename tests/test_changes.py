import random

import pytest

from vektorium.operators import changes

ROW = "g long, v long, k long, a long, b string, c double, d long"


def brute(rows, versions):
    out = set()
    held = {}
    for g, v, k, a, b, c, d in rows:
        if None in (g, v, k):
            continue
        key, new = (g, v, k), (d if d is not None else -1, (a, b, "nan" if c != c else c))
        if key not in held or held[key][0] < new[0]:
            held[key] = new
    by = {}
    for g, v in set(versions):
        if g is not None and v is not None:
            by.setdefault(g, []).append(v)
    for g, vs in by.items():
        vs.sort()
        for p, n in zip(vs, vs[1:]):
            old = {k: x[1] for (gg, v, k), x in held.items() if (gg, v) == (g, p)}
            new = {k: x[1] for (gg, v, k), x in held.items() if (gg, v) == (g, n)}
            out |= {(g, n, k, "added") for k in new.keys() - old.keys()} | {(g, n, k, "removed") for k in old.keys() - new.keys()} | {(g, n, k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]}
    return out


ARGS = ("g", "v", ["k"], ["a", "b", "c"], "d")


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    versions = [(r.choice([1, 2, None]), r.choice([1, 2, 3, 5, 4096, 4097, 9000, None])) for _ in range(30)]
    rows = []
    for i in range(400):
        g, v = r.choice([x for x in versions if None not in x] + [(7, 7)])
        rows.append((g, v, r.choice([1, 2, 3, 4, None]), r.choice([1, None]), r.choice(["x", None]), r.choice([1.0, float("nan"), None]), i if r.random() < 0.95 else None))
    got = changes.consecutive_changes(spark.createDataFrame(rows, ROW), spark.createDataFrame(versions, "g long, v long"), *ARGS)
    assert {tuple(x) for x in got.collect()} == brute(rows, versions) and got.count() == len(brute(rows, versions))


def test_empty_and_extra_columns(spark):
    rows = spark.createDataFrame([(1, 1, 1, 1, "x", 1.0, 1)], ROW)
    versions = spark.createDataFrame([(1, 1), (1, 2)], "g long, v long")
    clash = rows.selectExpr("*", "'z' AS change_type", "9 AS ord", "9 AS h")
    got = changes.consecutive_changes(clash, versions.selectExpr("*", "0 AS prev_version"), *ARGS).collect()
    assert [tuple(r) for r in got] == [(1, 2, 1, "removed")]
    assert changes.consecutive_changes(rows.limit(0), versions, *ARGS).count() == 0
    assert changes.consecutive_changes(rows, versions.limit(0), *ARGS).count() == 0


def test_null_and_value_keep_their_places(spark):
    rows = spark.createDataFrame([(1, 1, 1, None, "x", None, 1), (1, 2, 1, 1, None, None, 1), (1, 3, 1, 1, None, -0.0, 1), (1, 4, 1, 1, None, 0.0, 1)], ROW)
    got = changes.consecutive_changes(rows, rows.select("g", "v"), *ARGS)
    assert sorted(tuple(r)[1] for r in got.collect()) == [2, 3]


def test_values_of_changes(spark):
    rows = spark.createDataFrame([(1, 1, 1, 5, "x", 1.0, 1), (1, 2, 1, 6, "x", 1.0, 1), (1, 2, 1, 7, "x", 1.0, 2)], ROW)
    versions = rows.select("g", "v")
    found = changes.consecutive_changes(rows, versions, *ARGS)
    r = changes.with_values(found, rows, versions, *ARGS).first()
    assert (r.old.a, r.new.a) == (5, 7)


def test_index_of_the_last_snapshot(spark, tmp_path):
    ix = changes.SnapshotIndex(spark, str(tmp_path / "ix"), ["k"], ["a"], buckets=4)
    s1 = spark.createDataFrame([(1, 1), (2, 2), (2, 2), (None, 3)], "k long, a long")
    s2 = spark.createDataFrame([(2, 9), (3, None)], "k long, a long")
    assert {tuple(r) for r in ix.apply(s1).collect()} == {(1, "added"), (2, "added")}
    got = {r.k: (r.change_type, r.old and r.old.a, r.new and r.new.a) for r in ix.apply(s2, old=s1).collect()}
    assert got == {1: ("removed", 1, None), 2: ("changed", 2, 9), 3: ("added", None, None)}
    assert {tuple(r) for r in ix.apply(s2.limit(0)).collect()} == {(2, "removed"), (3, "removed")}
    assert ix.generation() == 3
    ix.drop_before(3)
    assert ix.generation() == 3


def test_the_old_index_is_not_shuffled(spark, tmp_path):
    ix = changes.SnapshotIndex(spark, str(tmp_path / "ix"), ["k"], ["a"], buckets=4)
    ix.apply(spark.range(50).selectExpr("id AS k", "id AS a"))
    out = ix.apply(spark.range(25, 75).selectExpr("id AS k", "id % 30 AS a"))
    assert out.groupBy("change_type").count().count() == 3
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", [3, 4])
def test_history_in_deliveries(spark, tmp_path, seed):
    r = random.Random(seed)
    versions = [(g, v) for g in (1, 2, 3) for v in (1, 2, 3, 5, 4096, 4097, 9000) if r.random() < 0.8]
    rows = []
    for i in range(300):
        g, v = r.choice(versions)
        if (g, v) != versions[-1] and v != 3:  # some versions are empty
            rows.append((g, v, r.choice([1, 2, 3, 4, None]), r.choice([1, None]), r.choice(["x", None]), r.choice([1.0, float("nan"), None]), i))
    df, vs = spark.createDataFrame(rows, ROW), spark.createDataFrame(versions, "g long, v long")
    ix = changes.SnapshotIndex(spark, str(tmp_path / "ix"), ["k"], ["a", "b", "c"], buckets=4)
    narrow = changes.history_entries(df, *ARGS)
    got = []
    for upto in (2, 3, 3, 5000, 10000):  # one delivery twice
        got += [tuple(x) for x in ix.apply_history(narrow, vs.where(f"v <= {upto}"), "g", "v").collect()]
    assert sorted(got) == sorted(brute(rows, versions))
