import numpy as np
import pyarrow as pa

import __spark_entry__ as entry
from vektorium.llm import leaks, mixing, vectors
from vektorium.sources.tables import read

LARGE = "/root/testdata/sf0.1"


def test_neighbours_without_a_threshold(spark):
    """Both queries reach 0.9 of the true 5 nearest; the list join had 0.83 of them."""
    live = vectors.live_records(read(spark, LARGE, "batch_ops")).toPandas().sort_values("id")
    ids, x = live.id.to_numpy(), np.stack([np.frombuffer(bytes(c), np.float16) for c in live.code]).astype(np.float32)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    fifth = dict(zip(ids.tolist(), np.sort(s, 1)[:, -5]))
    row = {i: k for k, i in enumerate(ids.tolist())}
    for name, asked in (("p5_queries", [i for i in ids.tolist() if i % 100 == 0]), ("p5_neighbours", ids.tolist())):
        got = entry.queries()[name](spark, LARGE).toPandas()
        assert set(got.id_a) <= set(asked) and not (got.id_a == got.id_b).any() and not got.duplicated(["id_a", "id_b"]).any()
        true = sum(s[row[a], row[b]] >= fifth[a] - 1e-6 for a, b in zip(got.id_a.tolist(), got.id_b.tolist()))
        print(name, true / (5 * len(asked)), len(got))
        assert got.groupby("id_a").size().max() == 5 and true >= 0.9 * 5 * len(asked)


def test_a_small_source_does_not_shrink_the_mixture(spark, tmp_path):
    docs = [(i, ("big", "Large")[i % 2], "some words to count here " * 40) for i in range(200)] + [(900, "tiny", "a few words only")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("big", 0.6, 4), ("large", 0.3, 4), ("tiny", 0.1, 4)], "source string, target_weight double, max_repeats int").write.parquet(f"{tmp_path}/mixture_targets.parquet")
    got = {r.source: r for r in entry.queries()["p7_shares"](spark, str(tmp_path)).collect()}
    have, drawn = (sum(r[c] for r in got.values()) for c in ("available_tokens", "n_tokens"))
    assert drawn >= 0.98 * have and max(r.passes for r in got.values()) <= 4
    assert got["tiny"].passes == 4 and got["big"].n_tokens > got["large"].n_tokens


def test_the_exponent_is_bisected():
    available, targets = {"a": 1000, "b": 1000, "c": 10}, {"a": (0.6, 2), "b": (0.3, 2), "c": (0.1, 4)}
    total = mixing.whole_total(available, targets)
    plan = mixing.plan(available, targets, total)
    assert total == 2010 and abs(sum(b.budget for b in plan.values()) - total) < 1e-3
    assert abs(plan["c"].budget - 40) < 1e-3 and 0.5 < plan["a"].weight < 0.6
    assert mixing.whole_total({}, targets) is None and mixing.whole_total({"a": 10, "b": 10}, {"a": (0.5, 3), "b": (0.5, 3)}) == 60


def _reparameterised(items, docs):
    held = leaks.build_items(items)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs)), pa.int64()), pa.array(docs)], names=["doc_id", "text"])
    return {(i, d) for x in leaks.find_reparameterised(iter([batch]), held) for i, d in zip(x["item_id"].to_pylist(), x["doc_id"].to_pylist())}


def test_reparameterised_with_fillers_of_other_lengths():
    text = "first we take the list of all {a} rows and sort it by the time of each call then for {b} we keep at most {n} of them and add what is left to the sum"
    others = [(i, None, text.format(a=f"alpha{i}", b=f"beta{i}", n=i)) for i in range(2, 6)]
    items = [(1, None, text.format(a="ledger", b="walrus", n="3")), *others]
    docs = [
        "zz yy xx " + text.format(a="a.b", b="c.d.e", n="3.5"),
        text.format(a="one", b="two", n="9"),
        text.format(a="twin", b="twin", n="9"),  # no common word, as those are literal
        "take the list of all pear rows and sort it by the time of each call",
        "nothing of the kind stands here " * 9,
    ]
    assert {d for i, d in _reparameterised(items, docs) if i == 1} == {0, 1, 3}


def test_chains_are_ordered():
    r = np.random.default_rng(6)
    for _ in range(60):
        pts = np.unique(np.stack([r.integers(0, 60, 40), r.integers(0, 60, 40)], 1), axis=0)
        pts = pts[np.lexsort((pts[:, 0], pts[:, 0] - pts[:, 1]))]
        got = leaks._chains(pts[:, 0], pts[:, 1])
        for n, runs in got:
            assert n >= leaks.COARSE_HITS
            for (_, _, s1, p1), (s0, p0, _, _) in zip(runs, runs[1:]):
                assert 1 <= s0 - s1 - leaks.COARSE <= 2 * leaks.COARSE and 1 <= p0 - p1 - leaks.COARSE <= 2 * leaks.COARSE
