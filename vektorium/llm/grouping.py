"""Groups of mutually similar records: a neighbour graph by neighbour descent, then community detection.

1. *Graph.* Within each posting list (overlapping, balanced lists; see ``postings``; a list of more than
   ``MAX_ROWS`` rows is cut by a hash of the rows) the k nearest neighbours of every row are found by
   neighbour descent: from random neighbours, each round compares a row with its neighbours' neighbours
   and with rows that point at it, until hardly any list changes. Edges below ``EDGE`` are dropped.
2. *Communities.* In each list, communities are merged while modularity gains: every community picks
   the neighbour whose merger gains most, mutual picks and chains merge, weights are summed, and so
   on. Modularity is that of the whole graph (its total weight is estimated from the number of rows),
   so a list is no unit of its own.
3. *Across lists.* The contracted graph has one node a community (its summed vector and its rows), far
   fewer than rows, and is merged in the same way with DataFrame joins. Its quality is the constant Potts
   form of modularity, which unlike the degree null model has no resolution limit and so doesn't split a group that
   holds a large part of all rows: the weight between two communities is the sum of all similarities
   between their rows, that is, the dot product of their summed vectors, and a merger gains that weight less
   ``GAMMA`` for each pair of rows. Mergers are tried along edges of the neighbour graph, along rows that lie in
   several lists, and between a community and the representatives of the lists near its mean: of a
   list's communities, taken by size, each is a representative unless one of those before it already
   gains by a merger, to which it is then tied. So m communities of one group give m edges. This is done anew in each
   pass over the contracted graph, until nothing gains.
4. *Check.* Rows whose mean similarity to the rest of their group is below ``similarity`` leave it;
   groups of fewer than ``least`` records are none.

A group is described by its size and its members of highest internal weighted degree, the sum of a member's
similarities to all others in the group (equal degrees by id). Copies count as so many members. An empty
log has no groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType

from vektorium.llm.neighbours import grouped
from vektorium.llm.postings import Lists
from vektorium.llm.vectors import DIM, array_to_codes, class_members, codes_to_array, join_classes
from vektorium.sources.tables import drop_stored, stored

K, ROUNDS, EDGE, GAMMA = 8, 8, 0.7, 0.72
MAX_ROWS = 8192
#: Each pass at least halves the communities that can still merge; more passes than this are an error.
PASSES = 60


def neighbour_descent(x: np.ndarray, k: int = K, rounds: int = ROUNDS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Approximate ``k`` nearest (by cosine) of each unit row: ids (n, k) and similarities."""
    n = len(x)
    k = min(k, n - 1)
    if k < 1:
        return np.zeros((n, 0), np.int64), np.zeros((n, 0), np.float32)
    rng = np.random.default_rng(seed)
    rows = np.arange(n)
    ids = (rows[:, None] + 1 + np.argsort(rng.random((n, min(n - 1, 2 * k))), axis=1)[:, :k] + rng.integers(0, n - 1, n)[:, None]) % n
    ids = np.where(ids == rows[:, None], (ids + 1) % n, ids)
    sims = np.einsum("nkd,nd->nk", x[ids], x)
    fresh = np.ones((n, k), bool)
    for _ in range(rounds):
        # rows that point here, some of them
        back = np.repeat(rows[:, None], k, axis=1)
        order = rng.permutation(n * k)
        back[ids.ravel()[order], order % k] = (order // k).astype(np.int64)
        near = np.concatenate([ids[:, : k // 2 + 1], back[:, : k // 2]], 1)
        cand = np.concatenate([ids[near].reshape(n, -1), back], 1)
        cand.sort(axis=1)
        skip = np.zeros(cand.shape, bool)
        skip[:, 1:] = cand[:, 1:] == cand[:, :-1]
        skip |= cand == rows[:, None]
        cs = np.empty(cand.shape, np.float32)
        for lo in range(0, n, 512):
            cs[lo : lo + 512] = np.matmul(x[cand[lo : lo + 512]], x[lo : lo + 512, :, None])[:, :, 0]
        cs[skip] = -9
        for j in range(k):
            cs[cand == ids[:, j : j + 1]] = -9
        both, bs = np.concatenate([ids, cand], 1), np.concatenate([sims, cs], 1)
        top = np.argpartition(-bs, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(bs, top, 1), axis=1, kind="stable")
        top = np.take_along_axis(top, order, 1)
        fresh = top >= k
        ids, sims = np.take_along_axis(both, top, 1), np.take_along_axis(bs, top, 1)
        if fresh.mean() < 0.01:
            break
    return ids, sims


def merge_communities(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, total: float) -> np.ndarray:
    """Labels 0..c-1 of n nodes, merged along the edges (each once) while modularity gains; ``total`` is the whole graph's edge weight."""
    label = np.arange(n)
    degree = np.bincount(a, w, n) + np.bincount(b, w, n)
    while True:
        c = label.max() + 1 if n else 0
        la, lb = label[a], label[b]
        cross = la != lb
        if not cross.any():
            return label
        lo, hi = np.minimum(la, lb)[cross], np.maximum(la, lb)[cross]
        key, inv = np.unique(lo * c + hi, return_inverse=True)
        weight = np.bincount(inv, w[cross])
        mass = np.bincount(label, degree, c)
        u, v = key // c, key % c
        gain = weight - mass[u] * mass[v] / (2 * total)
        good = gain > 0
        if not good.any():
            return label
        u, v, gain, key = u[good], v[good], gain[good], key[good]
        fro, to, g, e = np.concatenate([u, v]), np.concatenate([v, u]), np.tile(gain, 2), np.tile(key, 2)
        order = np.lexsort((e, -g, fro))
        first = order[np.flatnonzero(np.diff(fro[order], prepend=-1))]
        parent = np.arange(c)
        parent[fro[first]] = to[first]
        mutual = (parent[parent] == np.arange(c)) & (np.arange(c) < parent)
        parent[mutual] = np.flatnonzero(mutual)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        label = np.unique(parent, return_inverse=True)[1][label]


LOCAL = "kind int, comm long, other long, rep long, weight double, n long, vec binary"
#: Bits of a community's name for its number within a part of a list, and for the part.
IN_PART, PART = 24, 20


def _list_communities(batches: Iterator[pa.RecordBatch], per_row: float, rows: int, dim: int) -> Iterator[pa.RecordBatch]:
    """(list, part, rep, n, code) sorted by list and part. Kind 0: a row in a community with its degree there; 1: a
    community with its rows and summed vector; 2: an edge between two communities."""
    total = max(1.0, per_row * rows)
    for t in grouped(batches, 2):
        place = (int(t.column(0)[0].as_py()) << PART) + int(t.column(1)[0].as_py())
        rep, n = t.column(2).to_numpy(), t.column(3).to_numpy()
        x = array_to_codes(t.column(4).combine_chunks(), dim)
        if len(x) == 1:
            ids, sims = np.zeros((1, 0), np.int64), np.zeros((1, 0), np.float32)
        else:
            ids, sims = neighbour_descent(x)
        a = np.repeat(np.arange(len(x)), ids.shape[1])
        b, w = ids.ravel(), sims.ravel().astype(np.float64)
        keep = w >= EDGE
        a, b, w = a[keep], b[keep], w[keep]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        _, once = np.unique(lo * len(x) + hi, return_index=True)
        lo, hi, w = lo[once], hi[once], w[once]
        label = merge_communities(len(x), lo, hi, w, total)
        c = label.max() + 1
        degree = np.bincount(lo, w, len(x)) + np.bincount(hi, w, len(x))
        # rows without an edge matter only if they are copies of enough records
        used = np.flatnonzero((degree > 0) | (n > 1))
        if not len(used):
            continue
        name = (np.int64(place) << IN_PART) + np.arange(c)
        live = np.unique(label[used])
        vec = np.zeros((c, dim), np.float32)
        np.add.at(vec, label, x * n[:, None].astype(np.float32))
        count, mass = np.bincount(label, n, c).astype(np.int64), np.bincount(label, degree, c)
        cross = label[lo] != label[hi]
        k0, k1, k2 = len(used), len(live), int(cross.sum())
        size = 4 * dim
        vecs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), k1, [None, pa.py_buffer(np.ascontiguousarray(vec[live]).tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array([0, 1, 2], np.int32), [k0, k1, k2])),
                pa.array(np.concatenate([name[label[used]], name[live], name[label[lo[cross]]]])),
                pa.concat_arrays([pa.nulls(k0 + k1, pa.int64()), pa.array(name[label[hi[cross]]], pa.int64())]),
                pa.concat_arrays([pa.array(rep[used], pa.int64()), pa.nulls(k1 + k2, pa.int64())]),
                pa.array(np.concatenate([degree[used], mass[live], w[cross]])),
                pa.concat_arrays([pa.array(n[used], pa.int64()), pa.array(count[live], pa.int64()), pa.nulls(k2, pa.int64())]),
                pa.concat_arrays([pa.nulls(k0, pa.binary()), vecs, pa.nulls(k2, pa.binary())]),
            ],
            names=["kind", "comm", "other", "rep", "weight", "n", "vec"],
        )


@F.pandas_udf(DoubleType())
def _dot(a, b):
    """Dot products of float32 vectors held as bytes."""
    import pandas as pd

    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = (np.frombuffer(b"".join(v), np.float32).reshape(len(v), -1).astype(np.float64) for v in (a, b))
    return pd.Series((x * y).sum(1))


@F.pandas_udf(DoubleType())
def _dot_code(code, b):
    """Dot products of half-precision codes with float32 vectors held as bytes."""
    import pandas as pd

    if not len(code):
        return pd.Series([], dtype="float64")
    x = np.frombuffer(b"".join(code), np.float16).reshape(len(code), -1).astype(np.float64)
    return pd.Series((x * np.frombuffer(b"".join(b), np.float32).reshape(len(b), -1)).sum(1))


SUMS = "comm long, n long, vec binary"


def _sums(comm: list, n: list, vec: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(comm, pa.int64()), pa.array(n, pa.int64()), pa.array(vec, pa.binary())], names=["comm", "n", "vec"])


def _partial_sums(batches: Iterator[pa.RecordBatch], dim: int, codes: bool) -> Iterator[pa.RecordBatch]:
    """(comm, n, vector) rows of a partition -> sums by comm, so a community of any size is summed before the shuffle.

    The vector is a row's half-precision code, which counts n times, or an already summed float32 one.
    """
    sums: dict[int, np.ndarray] = {}
    counts: dict[int, int] = {}
    for b in batches:
        if not len(b):
            continue
        comm, n = b.column(0).to_numpy(), b.column(1).to_numpy()
        x = array_to_codes(b.column(2), dim) * n[:, None].astype(np.float32) if codes else np.frombuffer(b"".join(b.column(2).to_pylist()), np.float32).reshape(len(b), -1)
        order = np.argsort(comm, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], np.diff(comm[order]) != 0]))
        vec, num = np.add.reduceat(x[order], cut, axis=0), np.add.reduceat(n[order], cut)
        for r, v, c in zip(comm[order][cut].tolist(), vec, num.tolist()):
            sums[r] = sums[r] + v if r in sums else v
            counts[r] = counts.get(r, 0) + c
        if len(sums) > 50_000:
            yield _sums(list(sums), list(counts.values()), [v.tobytes() for v in sums.values()])
            sums, counts = {}, {}
    yield _sums(list(sums), list(counts.values()), [v.tobytes() for v in sums.values()])


def _final_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(comm, n, vec) sorted by comm -> summed, one row a community."""
    for t in grouped(batches, 1):
        vec = sum(np.frombuffer(v, np.float32) for v in t.column(2).to_pylist())
        yield _sums([t.column(0)[0].as_py()], [int(np.sum(t.column(1).to_numpy()))], [vec.astype(np.float32).tobytes()])


def summed(rows: DataFrame, dim: int, codes: bool = False) -> DataFrame:
    """``comm, n, vec``: one row a community, of (comm, n, vector) rows; summed in each partition before the shuffle."""
    part = rows.mapInArrow(lambda it: _partial_sums(it, dim, codes), SUMS)
    return part.repartition("comm").sortWithinPartitions("comm").mapInArrow(_final_sums, SUMS)


def _mean_lists(batches: Iterator[pa.RecordBatch], lists: Lists) -> Iterator[pa.RecordBatch]:
    """(comm, n, vec) -> the lists near each community's mean: (list, comm, n, mean)."""
    for b in batches:
        if not len(b):
            continue
        x = np.frombuffer(b"".join(b.column(2).to_pylist()), np.float32).reshape(len(b), -1) / b.column(1).to_numpy()[:, None].astype(np.float32)
        near, sims = lists.nearest(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9), 3)
        r, c = np.nonzero(sims > -2)
        yield pa.RecordBatch.from_arrays([pa.array(near[r, c].astype(np.int32)), b.column(0).take(pa.array(r)), b.column(1).take(pa.array(r)), codes_to_array(x[r].astype(np.float16))], names=["list", "comm", "n", "mean"])


def representatives(x: np.ndarray, least: float, block: int = 512) -> np.ndarray:
    """For each row the row it is tied to: itself if it is a representative, else the most similar one before it that reaches ``least``."""
    tie, reps = np.arange(len(x)), np.zeros(0, np.int64)
    for lo in range(0, len(x), block):
        rows = np.arange(lo, min(lo + block, len(x)))
        if len(reps):
            s = x[rows] @ x[reps].T
            best = s.argmax(1)
            near = s[np.arange(len(rows)), best] >= least
            tie[rows[near]] = reps[best[near]]
            rows = rows[~near]
        if len(rows):
            s, new = x[rows] @ x[rows].T, []
            for i in range(len(rows)):
                like = s[i, new]
                if len(new) and like.max() >= least:
                    tie[rows[i]] = rows[new[int(like.argmax())]]
                else:
                    new.append(i)
            reps = np.concatenate([reps, rows[new]])
    return tie


def _near_means(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """(list, part, comm, n, mean) sorted by list and part -> each community with the representative it is tied to."""
    for t in grouped(batches, 2):
        comm, n = t.column(2).to_numpy(), t.column(3).to_numpy()
        order = np.lexsort((comm, -n))
        comm, x = comm[order], array_to_codes(t.column(4).combine_chunks(), dim)[order]
        tie = representatives(x, GAMMA)
        tied = np.flatnonzero(tie != np.arange(len(tie)))
        yield pa.RecordBatch.from_arrays([pa.array(comm[tied], pa.int64()), pa.array(comm[tie[tied]], pa.int64())], names=["comm", "other"])


def in_parts(rows: DataFrame, by: str, most: int) -> DataFrame:
    """``rows`` (with ``list``) and the ``part`` of the list each falls in, by a hash of ``by``; a part has about ``most`` rows."""
    n = rows.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias("_parts"))  # at most MAX_LISTS rows
    return rows.join(F.broadcast(n), "list").withColumn("part", F.pmod(F.xxhash64(by), F.col("_parts")).cast("int")).drop("_parts")


def _edges(pairs: DataFrame) -> DataFrame:
    """Distinct communities that are tied, each pair once."""
    return pairs.where("comm != other").select(F.least("comm", "other").alias("comm"), F.greatest("comm", "other").alias("other")).distinct()


def _roots(picks: DataFrame) -> DataFrame:
    """``comm, root`` by pointer doubling over ``comm -> parent`` (a forest whose roots point at themselves)."""
    at, last = picks, None
    while True:
        nxt = stored(at.join(at.select(F.col("comm").alias("parent"), F.col("parent").alias("up")), "parent", "left").select("comm", F.coalesce("up", "parent").alias("parent"), (F.col("up") != F.col("parent")).alias("moved")), "roots")
        if last is not None:
            drop_stored(last)
        at, last = nxt.select("comm", "parent"), nxt
        if nxt.where("moved").isEmpty():
            return at.withColumnRenamed("parent", "root")


def merge_across(nodes: DataFrame, edges: DataFrame, lists: Lists, dim: int = DIM) -> DataFrame:
    """``comm, root`` for the communities that merge with others (those that are not named stay themselves).

    ``nodes``: comm, n, vec. ``edges``: comm, other, of the neighbour graph. In every pass each community picks the
    one whose merger gains most, among those it is tied to by an edge or through a representative; picks
    merge, and vectors and edges are summed by what they merged into.
    """
    named = None
    held = nodes.sparkSession.sparkContext.broadcast(lists)
    for _ in range(PASSES):
        means = nodes.mapInArrow(lambda it: _mean_lists(it, held.value), "list int, comm long, n long, mean binary")
        means = in_parts(means, "comm", MAX_ROWS).select("list", "part", "comm", "n", "mean").repartition("list", "part").sortWithinPartitions("list", "part")
        tied = _edges(edges.unionByName(means.mapInArrow(lambda it: _near_means(it, dim), "comm long, other long")))
        a = nodes.select("comm", F.col("n").alias("na"), F.col("vec").alias("va"))
        b = nodes.select(F.col("comm").alias("other"), F.col("n").alias("nb"), F.col("vec").alias("vb"))
        gain = tied.join(a, "comm").join(b, "other").select("comm", "other", (_dot("va", "vb") - F.lit(GAMMA) * F.col("na") * F.col("nb")).alias("gain")).where("gain > 0")
        both = gain.select("comm", "other", "gain", F.least("comm", "other").alias("lo"), F.greatest("comm", "other").alias("hi"))
        both = both.select(F.explode(F.array(F.struct("comm", "other", "gain", "lo", "hi"), F.struct(F.col("other").alias("comm"), F.col("comm").alias("other"), "gain", "lo", "hi"))).alias("x")).select("x.*")
        pick = stored(both.groupBy("comm").agg(F.max_by("other", F.struct("gain", -F.col("lo"), -F.col("hi"))).alias("parent")), "picks")
        if pick.isEmpty():
            return named if named is not None else nodes.select("comm", F.col("comm").alias("root")).limit(0)
        mutual = pick.join(pick.select(F.col("comm").alias("parent"), F.col("parent").alias("up")), "parent").select("comm", F.when((F.col("up") == F.col("comm")) & (F.col("comm") < F.col("parent")), F.col("comm")).otherwise(F.col("parent")).alias("parent"))
        root = _roots(mutual)
        to = lambda df, c: df.join(root.withColumnRenamed("comm", c), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
        before = [pick, nodes, edges] + ([named] if named is not None else [])
        if named is not None:
            moved = named.withColumnRenamed("root", "via").join(root.withColumnRenamed("comm", "via"), "via", "left").select("comm", F.coalesce("root", "via").alias("root"))
            named = stored(moved.unionByName(root.join(moved, "comm", "left_anti")), "named")
        else:
            named = stored(root, "named")
        nodes = stored(summed(to(nodes, "comm").select("comm", "n", "vec"), dim), "nodes")
        edges = stored(_edges(to(to(edges, "comm"), "other")), "edges")
        for old in [*before, root]:
            drop_stored(old)
    raise RuntimeError(f"communities still merge after {PASSES} passes")


def groups(live: DataFrame, index: DataFrame, lists: Lists, least: int = 5, similarity: float = 0.74, dim: int = DIM) -> DataFrame:
    """``rep, n, root, size``: the copy classes that belong to a group of at least ``least`` records."""
    rows = index.count()
    by_list = in_parts(index.select(F.explode("lists").alias("list"), "rep", "n", "code"), "rep", MAX_ROWS)
    by_list = by_list.select("list", "part", "rep", "n", "code").repartition("list", "part").sortWithinPartitions("list", "part")
    local = stored(by_list.mapInArrow(lambda it: _list_communities(it, K * 0.8 * 0.8, rows, dim), LOCAL), "communities")
    inside = local.where("kind = 0").select("rep", "comm", "weight", "n")
    nodes = stored(local.where("kind = 1").select("comm", "n", "vec"), "nodes")
    # a row in several communities ties them; a chain of ties is enough
    ties = inside.select("comm", F.lead("comm").over(W.partitionBy("rep").orderBy("comm")).alias("other")).where("other IS NOT NULL")
    edges = stored(_edges(ties.unionByName(local.where("kind = 2").select("comm", "other"))), "edges")
    root = merge_across(nodes, edges, lists, dim)
    placed = inside.join(root, "comm", "left").select("rep", "n", F.coalesce("root", "comm").alias("root"), "weight")
    # lists overlap: a row goes where most of its weight lies
    placed = placed.groupBy("rep", "root").agg(F.sum("weight").alias("s"), F.first("n").alias("n"))
    placed = stored(placed.groupBy("rep").agg(F.max_by(F.struct("root", "n"), F.struct("s", "root")).alias("x")).select("rep", "x.*"), "placed")
    return _checked(placed, index, least, similarity, dim)


def _checked(placed: DataFrame, index: DataFrame, least: int, similarity: float, dim: int) -> DataFrame:
    """Drop rows that are not similar to the rest of their group, then groups that are too small."""
    rows = placed.join(index.select("rep", "code"), "rep")
    sums = stored(summed(rows.select("root", "n", "code"), dim, codes=True).where(F.col("n") >= least).select(F.col("comm").alias("root"), F.col("n").alias("size"), "vec"), "sums")
    rest = (_dot_code("code", "vec") - 1) / F.greatest(F.col("size") - 1, F.lit(1))
    kept = stored(join_classes(rows, sums, ["root"], "size").withColumn("rest", rest).where(F.col("rest") >= similarity).select("rep", "n", "root"), "kept")
    size = kept.groupBy("root").agg(F.sum("n").alias("size")).where(F.col("size") >= least)
    return join_classes(kept, size, ["root"], "size")


def members_of(found: DataFrame, live: DataFrame, index: DataFrame) -> DataFrame:
    """``id, group_id, size`` of every record in a group; ``group_id`` is the least id in it."""
    name = found.groupBy("root", "size").agg(F.min("rep").alias("group_id"))  # a class is named by its least id
    rows = join_classes(found.drop("size"), name, ["root"], "size").select("rep", "n", "group_id", "size")
    single = rows.where("n = 1").select(F.col("rep").alias("id"), "group_id", "size")
    copies = join_classes(class_members(live, index).select("rep", "id"), rows.where("n > 1"), ["rep"]).select("id", "group_id", "size")
    return single.unionByName(copies)


def typical(members: DataFrame, live: DataFrame, m: int, dim: int = DIM) -> DataFrame:
    """``group_id, size, typical_ids``: the ``m`` members of highest internal weighted degree, most typical first."""
    rows = members.join(live.select("id", "code"), "id")
    sums = stored(summed(rows.select("group_id", F.lit(1).cast("long").alias("n"), "code"), dim, codes=True).select(F.col("comm").alias("group_id"), F.col("n").alias("_size"), "vec"), "sums")
    degree = F.round(_dot_code("code", "vec") - 1, 3)  # rounded, so that the order of summation doesn't decide
    rows = join_classes(rows, sums, ["group_id"], "_size").select("group_id", "size", "id", degree.alias("degree"))
    top = rows.withColumn("_r", F.row_number().over(W.partitionBy("group_id").orderBy(F.col("degree").desc(), "id"))).where(F.col("_r") <= m)
    return top.groupBy("group_id", "size").agg(F.sort_array(F.collect_list(F.struct("_r", "id"))).alias("t")).select("group_id", "size", F.transform("t", lambda x: x["id"]).alias("typical_ids"))
