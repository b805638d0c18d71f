import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vektorium.llm import frequent, percentiles


def test_frequent_against_exact(spark):
    r = random.Random(3)
    rows = []
    for g, n in (("a", 6000), ("b", 900)):
        for _ in range(n):
            x = r.random()
            rows.append((g, "hot" if x < 1 / 3 else "" if x < 0.36 else f"v{int(r.paretovariate(0.6))}" if x < 0.98 else None))
    df = spark.createDataFrame(rows, "g string, v string").repartition(5)
    for share in (0.01, 0.05):
        got = {(x.grp, x.value): (x.n_exact, x.est) for x in frequent.frequent_values(df, "g", "v", share).collect()}
        want = {}
        for g in "ab":
            c = Counter(v for gg, v in rows if gg == g and v is not None)
            n = sum(c.values())
            want |= {(g, v): k for v, k in c.items() if k >= share * n}
        assert {k: v[0] for k, v in got.items()} == want
        assert all(est >= exact for exact, est in got.values())


def test_frequent_edges(spark):
    empty = spark.createDataFrame([], "g string, v string, bits string, total string")
    assert frequent.frequent_values(empty, "g", "v", 0.01).count() == 0
    odd = spark.createDataFrame([("a", None), (None, "x"), ("a", "é" * 10_000), ("a", "é" * 10_000)], "g string, v string")
    assert [(x.grp, len(x.value), x.n_exact) for x in frequent.frequent_values(odd, "g", "v", 0.5).collect()] == [("a", 10_000, 2)]


def test_sketches_add(spark):
    df = spark.createDataFrame([("a", f"v{i % 7}") for i in range(300)], "g string, v string")
    whole = frequent.group_sketch(df, "g", "v", 3, 64)
    parts = frequent.merge_sketches(frequent.group_sketch(df.where("v < 'v3'"), "g", "v", 3, 64).unionByName(frequent.group_sketch(df.where("v >= 'v3'"), "g", "v", 3, 64)))
    key = lambda d: sorted((r["row"], r["bucket"], r["total"], tuple(r["bits"])) for r in d.collect())
    assert key(whole) == key(parts)


def test_sketch_of_one_partition():
    b = pa.RecordBatch.from_arrays([pa.array(["a", "a", "b"]), pa.array([5, 5, -7])], names=["g", "f"])
    t = pa.Table.from_batches(frequent.sketch_partition(iter([b]), 2, 8))
    assert sum(t["total"].to_pylist()) == 6


def test_latest_rows(spark):
    df = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, None, "only"), (None, 1, "x")], "k long, t long, v string")
    assert {(r.k, r.v) for r in frequent.latest_rows(df, ["k"], ["t", "v"]).collect()} == {(1, "new"), (2, "only")}


@pytest.mark.parametrize("accuracy", [0.01, 0.05])
def test_percentiles_within_the_bound(spark, accuracy):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.lognormal(2, 3, 3000), -rng.lognormal(0, 2, 2000), np.zeros(200), [1e300, -1e300, 1e-13]])
    df = spark.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(x)] + [(0, float("nan")), (1, float("inf")), (2, None)], "g long, v double").repartition(4)
    qs = (0.0, 0.01, 0.5, 0.9, 0.99, 1.0)
    sk = percentiles.sketch(df, ["g"], "v", accuracy)
    for keys, groups in ((["g"], [(g, x[np.arange(len(x)) % 3 == g]) for g in range(3)]), ([], [(None, x)])):
        s = sk if keys else percentiles.combine(sk.withColumn("all", F.lit(1)), ["all"])
        rows = {(r["g"] if keys else None): r for r in percentiles.quantiles(s, keys or ["all"], qs, accuracy).collect()}
        for g, v in groups:
            v = np.sort(v)
            assert rows[g]["n"] == len(v)
            for q in qs:
                want, got = v[math.floor(q * (len(v) - 1))], rows[g][f"q{q * 100:g}"]
                assert abs(got - want) <= accuracy * abs(want) * (1 + 1e-9) + 1e-12, (q, want, got)


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None)], "g long, v double")
    assert percentiles.quantiles(percentiles.sketch(df, ["g"], "v"), ["g"], [0.5]).count() == 0
    assert percentiles.sketch(df.limit(0).withColumn("n", F.lit(1)), ["g"], "v").count() == 0


def test_number_texts(spark):
    from vektorium.llm.value_queries import number_of

    texts = ["1", " 1", "+1", "1.5e2", ".5", "5.", "--", "n/a", "", "1d", "NaN", "Infinity", "0x10", "1 2", None]
    df = spark.createDataFrame([("s", None, None, t) for t in texts] + [("i", 7, None, None), ("f", None, 2.5, None), ("null", 1, 1.0, "1"), (None, 1, 1.0, "1")], "k string, i long, f double, s_val string")
    got = [r[0] for r in df.select(number_of(F.col("k"), F.col("i"), F.col("f"), F.col("s_val"))).collect()]
    assert got == [1, 1, 1, 150, 0.5, 5] + [None] * 9 + [7, 2.5, None, None]
