"""The most similar vectors of every vector, from balanced posting lists.

``all_neighbours`` joins the indexed rows with themselves: a row meets, in each list that a search for
it visits, the rows that are kept there. Lists that follow each other lie near each other, so ``SHARD`` of
them are handled together: a row travels once to each shard it has to do with, however many lists of it
that are, and comes back with its best of the whole shard. A shard is a grid of tasks: what it keeps is cut
by a hash into parts of about ``MAX_ROWS`` rows, its visitors into parts of ``MAX_VISITORS``, and every part
of the one meets every part of the other, so tasks stay bounded and nothing is left out.

Copies (equal codes) are one row inside and are expanded at the end: the nearest of a copy are the
other copies, by id, then the members of the nearest classes. Similarities are cosines of
half-precision unit vectors (error below 0.0005). Equal similarities rank by class id. With fewer than
``k`` other records all of them come out; an empty log gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from vektorium.llm.vectors import DIM, array_to_codes, class_members, join_classes

SHARD, MAX_ROWS, MAX_VISITORS = 64, 65_536, 65_536
PAIR = "a long, b long, sim float"


def _best(q: np.ndarray, d: np.ndarray, qid: np.ndarray, did: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The up to ``k`` best of ``d`` for each of ``q`` with at least ``least``, never the row itself."""
    out_a, out_b, out_s = [], [], []
    for lo in range(0, len(q), 1024):
        s = q[lo : lo + 1024] @ d.T
        s[qid[lo : lo + 1024, None] == did[None, :]] = -9
        if least > -1:
            r, c = np.nonzero(s >= least)
            order = np.lexsort((did[c], -s[r, c], r))
            r, c = r[order], c[order]
            first = np.searchsorted(r, r)
            keep = np.arange(len(r)) - first < k
            r, c = r[keep], c[keep]
        else:
            m = min(k, len(d))
            c = np.argpartition(-s, m - 1, axis=1)[:, :m]
            r = np.repeat(np.arange(len(c)), m)
            c = c.ravel()
            keep = s[r, c] > -2
            r, c = r[keep], c[keep]
        out_a.append(qid[lo + r])
        out_b.append(did[c])
        out_s.append(s[r, c])
    cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    return cat(out_a, np.int64), cat(out_b, np.int64), cat(out_s, np.float32)


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal leading ``keys`` columns of sorted batches, one table a run."""
    held: list[pa.RecordBatch] = []
    current = None
    for b in batches:
        if not len(b):
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(len(b), bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(b)]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(c[lo] for c in cols)
            if current is not None and key != current:
                yield pa.Table.from_batches(held)
                held = []
            current = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _pairs(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float32())], names=["a", "b", "sim"])


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every entry of a list column, by value."""
    column = column.combine_chunks()
    off = column.offsets.to_numpy()
    value = column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
    row = np.repeat(np.arange(len(column)), np.diff(off))
    order = np.argsort(value, kind="stable")
    return row[order], value[order]


def _top(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` of each ``a``, each pair once."""
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    again = np.lexsort((-s, b, a))
    once = np.ones(len(a), bool)
    once[again[1:]] = (a[again[1:]] != a[again[:-1]]) | (b[again[1:]] != b[again[:-1]])
    a, b, s = a[once], b[once], s[once]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], b[keep], s[keep]


def _join_shards(batches: Iterator[pa.RecordBatch], k: int, least: float, dim: int) -> Iterator[pa.RecordBatch]:
    """(shard, cell, rep, code, kept, seen) sorted by shard and cell: the lists of the shard that keep a row, and those it visits."""
    for t in grouped(batches, 2):
        rep, code = t.column(2).to_numpy(), array_to_codes(t.column(3).combine_chunks(), dim)
        (kept, in_list), (visitor, visited) = _flat(t.column(4)), _flat(t.column(5))
        found = []
        for lst in np.intersect1d(in_list, visited).tolist():
            d, q = kept[slice(*np.searchsorted(in_list, [lst, lst + 1]))], visitor[slice(*np.searchsorted(visited, [lst, lst + 1]))]
            found.append(_best(code[q], code[d], rep[q], rep[d], k, least))
        if found:
            yield _pairs(*_top(*(np.concatenate(c) for c in zip(*found)), k))


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each ``a`` over all lists, each pair once."""
    p = pairs.repartition("a").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    return p.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy(F.col("sim").desc(), "b"))).where(F.col("rank") <= k)


def class_neighbours(index: DataFrame, k: int, least: float = -2.0, dim: int = DIM) -> DataFrame:
    """``a, b, sim, rank`` between classes: the ``k`` nearest classes of each class that reach ``least``."""
    shard_of = lambda xs: F.array_distinct(F.transform(xs, lambda x: F.floor(x / SHARD).cast("int")))
    here = lambda xs: F.filter(xs, lambda x: F.floor(x / SHARD).cast("int") == F.col("shard"))
    sides = index.select(F.explode(F.concat(F.transform(shard_of("lists"), lambda x: F.struct(x.alias("shard"), F.lit(1).alias("k"), F.lit(0).alias("v"))), F.transform(shard_of("visits"), lambda x: F.struct(x.alias("shard"), F.lit(0).alias("k"), F.lit(1).alias("v"))))).alias("x"))
    parts = lambda c, most: F.greatest(F.lit(1), F.ceil(F.sum(c) / most)).cast("int")
    grid = sides.groupBy("x.shard").agg(parts("x.k", MAX_ROWS).alias("kp"), parts("x.v", MAX_VISITORS).alias("vp"))  # at most MAX_LISTS / SHARD rows
    rows = index.select("rep", "code", "lists", "visits", F.explode(shard_of(F.concat("lists", "visits"))).alias("shard"))
    rows = rows.select("shard", "rep", "code", here("lists").alias("kept"), here("visits").alias("seen")).join(F.broadcast(grid), "shard")
    mine = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "rep"), n).cast("int")
    none = F.array().cast("array<int>")
    cell = lambda c: F.struct(c.alias("cell"), F.when(F.floor(c / F.col("vp")) == mine(F.col("kp"), 1), F.col("kept")).otherwise(none).alias("kept"), F.when(c % F.col("vp") == mine(F.col("vp"), 2), F.col("seen")).otherwise(none).alias("seen"))
    cells = F.filter(F.transform(F.sequence(F.lit(0), F.col("kp") * F.col("vp") - 1), cell), lambda x: (F.size(x["kept"]) > 0) | (F.size(x["seen"]) > 0))
    rows = rows.select("shard", "rep", "code", F.explode(cells).alias("c")).select("shard", F.col("c.cell").alias("cell"), "rep", "code", F.col("c.kept").alias("kept"), F.col("c.seen").alias("seen"))
    rows = rows.repartition("shard", "cell").sortWithinPartitions("shard", "cell")
    return _nearest(rows.mapInArrow(lambda it: _join_shards(it, k, least, dim), PAIR), k)


def expand(near: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """``id_a, id_b, sim`` between records, ``k`` for each, from class neighbours and the members of copy classes.

    Of a class at most ``k + 1`` members, the least ids, are ever named as somebody's neighbours.
    """
    heads = members.withColumn("_r", F.row_number().over(W.partitionBy("rep").orderBy("id"))).where(F.col("_r") <= k + 1)
    heads = heads.groupBy("rep", "n").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    # the slots that copies take come first
    own = join_classes(members.drop("n"), heads, ["rep"]).select(F.col("id").alias("id_a"), F.explode(F.slice(F.array_except("ids", F.array("id")), 1, k)).alias("id_b"), F.lit(1.0).cast("float").alias("sim"))
    h = heads.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("ids").alias("ids_b"))
    to = near.join(h, "b", "left").withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("ids_b", F.coalesce("ids_b", F.array("b")))
    before = F.coalesce(F.sum("nb").over(W.partitionBy("a").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    to = to.withColumn("_before", before)
    g = heads.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("ids").alias("ids_a"))
    to = to.join(g, "a", "left").withColumn("_room", F.lit(k) - F.coalesce(F.col("na") - 1, F.lit(0)) - F.col("_before")).where("_room > 0")
    to = to.select(F.explode(F.coalesce("ids_a", F.array("a"))).alias("id_a"), F.expr("slice(ids_b, 1, cast(_room as int))").alias("_b"), "sim")
    return own.unionByName(to.select("id_a", F.explode("_b").alias("id_b"), "sim"))


def all_neighbours(live: DataFrame, index: DataFrame, k: int, least: float = -2.0, dim: int = DIM) -> DataFrame:
    """``id_a, id_b, sim``: for every live record its ``k`` nearest among those of at least ``least``."""
    return expand(class_neighbours(index, k, least, dim), class_members(live, index), k)
