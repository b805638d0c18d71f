"""Balanced posting lists over unit vectors.

Centroids are fitted on the driver to a bounded sample (``SAMPLE_PER_LIST`` rows a list, at most
``MAX_SAMPLE``; a documented parameter) by splitting the sample again and again until no part is
larger than its share, so lists follow density and stay even. Every row is then indexed: it goes
to its nearest list and, if it lies at a boundary, to further lists whose centroid is at most
``1 + replicate`` times as far, unless that centroid is nearer to one already chosen than to the row.
Centroids are found by best-first search in an in-memory neighbour graph of the centroids, entered
through hubs, so the cost a row hardly grows with the number of lists. At most ``MAX_LISTS`` centroids
exist (4 MB), so broadcasting them is safe at any size of the data; beyond ``LIST * MAX_LISTS`` rows (4.2
million) lists grow with the data, and the work with its square over ``MAX_LISTS``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vektorium.llm.vectors import DIM, array_to_codes

LIST, SAMPLE_PER_LIST, MAX_LISTS, MAX_SAMPLE = 256, 24, 16_384, 262_144


def _split(x: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Labels of a k-means split of unit vectors."""
    c = x[rng.choice(len(x), parts, replace=False)]
    label = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        label = (x @ c.T).argmax(1)
        for j in range(parts):
            m = label == j
            if m.any():
                v = x[m].sum(0)
                c[j] = v / max(np.linalg.norm(v), 1e-9)
            else:
                c[j] = x[rng.integers(len(x))]
    return label


def fit_centroids(sample: np.ndarray, lists: int, seed: int = 5) -> np.ndarray:
    """Centroids of at most ``lists`` balanced parts of the sample (equal rows count once)."""
    x = np.unique(sample, axis=0)
    if not len(x):
        return np.zeros((1, sample.shape[1]), np.float32)
    rng = np.random.default_rng(seed)
    share = max(1, math.ceil(len(x) / lists))
    todo, out = [np.arange(len(x))], []
    while todo:
        part = todo.pop()
        if len(part) <= share:
            v = x[part].sum(0)
            out.append(v / max(np.linalg.norm(v), 1e-9))
            continue
        k = min(16, math.ceil(len(part) / share), len(part))
        label = _split(x[part], k, rng)
        pieces = [part[label == j] for j in range(k)]
        if max(map(len, pieces)) == len(part):  # can't be split by direction
            half = len(part) // 2
            pieces = [part[:half], part[half:]]
        todo += [p for p in pieces if len(p)]
    return np.array(out, np.float32)


@dataclass
class Lists:
    """Centroids with their neighbour graph."""

    centroids: np.ndarray
    graph: np.ndarray
    hubs: np.ndarray

    @classmethod
    def over(cls, centroids: np.ndarray, degree: int = 12) -> Lists:
        n = len(centroids)
        graph = np.zeros((n, min(degree, max(1, n - 1))), np.int32)
        for lo in range(0, n, 1024):
            s = centroids[lo : lo + 1024] @ centroids.T
            s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -9
            graph[lo : lo + 1024] = np.argpartition(-s, min(graph.shape[1] - 1, n - 1), axis=1)[:, : graph.shape[1]]
        rng = np.random.default_rng(n)
        return cls(centroids, graph, np.sort(rng.choice(n, min(n, max(16, 4 * math.isqrt(n))), replace=False)))

    def nearest(self, x: np.ndarray, m: int, beam: int = 10, hops: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ``m`` nearest centroids of each unit vector and their cosines, by search in the graph (places left empty have -9)."""
        n = len(self.centroids)
        m = min(m, n)
        m, width = min(m, beam), min(beam, len(self.hubs))
        s = x @ self.centroids[self.hubs].T
        at = np.argpartition(-s, width - 1, axis=1)[:, :width]
        best, sims = self.hubs[at].astype(np.int32), np.take_along_axis(s, at, 1)
        fresh = best[:, :6]
        for _ in range(hops):
            cand = self.graph[fresh].reshape(len(x), -1)
            cs = np.empty(cand.shape, np.float32)
            for lo in range(0, len(x), 512):
                cs[lo : lo + 512] = np.matmul(self.centroids[cand[lo : lo + 512]], x[lo : lo + 512, :, None])[:, :, 0]
            ids, ss = np.concatenate([best, cand], 1), np.concatenate([sims, cs], 1)
            order = np.argsort(ids, axis=1, kind="stable")
            ids, ss = np.take_along_axis(ids, order, 1), np.take_along_axis(ss, order, 1)
            ss[:, 1:][ids[:, 1:] == ids[:, :-1]] = -9
            held = min(beam, n)
            top = np.argpartition(-ss, min(held, ss.shape[1]) - 1, axis=1)[:, :held]
            new, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(ss, top, 1)
            order = np.argsort(-sims, axis=1, kind="stable")
            new, sims = np.take_along_axis(new, order, 1), np.take_along_axis(sims, order, 1)
            if (new[:, :m] == best[:, :m]).all():
                best = new
                break
            best, fresh = new, new[:, :4]
        return best[:, :m], sims[:, :m]

    def assign(self, near: np.ndarray, sims: np.ndarray, replicate: float, most: int, prune: bool) -> np.ndarray:
        """Lists of each row (n, most) out of its nearest ones, -1 where there is none; the first is the nearest."""
        d = np.sqrt(np.maximum(2 - 2 * sims, 0))
        out = np.full((len(near), most), -1, np.int32)
        out[:, 0] = near[:, 0]
        count = np.ones(len(near), np.int64)
        for j in range(1, near.shape[1]):
            ok = (d[:, j] <= (1 + replicate) * d[:, 0]) & (count < most)
            if prune:
                for i in range(most):
                    has = ok & (out[:, i] >= 0)
                    if has.any():
                        r = np.flatnonzero(has)
                        between = (self.centroids[out[r, i]] * self.centroids[near[r, j]]).sum(1)
                        ok[r[between > sims[r, j]]] = False
            r = np.flatnonzero(ok)
            out[r, count[r]] = near[r, j]
            count[r] += 1
        return out


def _route_wide(batches: Iterator[pa.RecordBatch], lists: Lists, replicate: float, most: int, visits: int, dim: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, asks = array_to_codes(b.column(2), dim), b.column(3).to_numpy(zero_copy_only=False).astype(bool)
        kept = np.concatenate([np.zeros((0, most), np.int32), *(lists.assign(*lists.nearest(x[lo : lo + 4096], 2 * most), replicate, most, True) for lo in range(0, len(x), 4096))])
        m = min(visits, len(lists.centroids))
        seen = np.full((len(x), m), -1, np.int32)
        rows = np.flatnonzero(asks)
        for lo in range(0, len(rows), 1024):
            r = rows[lo : lo + 1024]
            seen[r] = np.argpartition(-(x[r] @ lists.centroids.T), m - 1, axis=1)[:, :m]
        cols = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((a >= 0).sum(1))]).astype(np.int32)), pa.array(a[a >= 0].astype(np.int32))) for a in (kept, seen)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], names=["rep", "n", "code", "lists", "visits"])


def _route(batches: Iterator[pa.RecordBatch], lists: Lists, replicate: float, most: int, search: float, visits: int, dim: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = array_to_codes(b.column(2), dim)
        parts = [lists.nearest(x[lo : lo + 4096], max(2 * most, visits)) for lo in range(0, len(x), 4096)]
        cols = []
        for ratio, top, prune in ((replicate, most, True), (search, visits, False)):
            a = np.concatenate([lists.assign(*p, ratio, top, prune) for p in parts]) if parts else np.zeros((0, 1), np.int32)
            real = a >= 0
            cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(real.sum(1))]).astype(np.int32)), pa.array(a[real])))
        yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "lists", "visits"])


def build(live: DataFrame, dim: int = DIM, list_size: int = LIST) -> Lists:
    """Fit the lists to a bounded sample of the stored live records."""
    n = live.count()
    lists = int(min(MAX_LISTS, max(1, round(n / list_size))))
    want = min(MAX_SAMPLE, lists * SAMPLE_PER_LIST)
    rows = live.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(math.ceil((1 << 20) * min(1.0, 1.1 * want / max(n, 1))))).select("code").limit(MAX_SAMPLE)
    codes = rows.toArrow().column(0).combine_chunks()
    return Lists.over(fit_centroids(array_to_codes(codes, dim), lists))


def index(classes: DataFrame, lists: Lists, replicate: float = 0.12, most: int = 3, search: float = 0.12, visits: int = 5, dim: int = DIM) -> DataFrame:
    """``rep, n, code, lists, visits``: where each row is kept, and which lists a search for it visits."""
    held = classes.sparkSession.sparkContext.broadcast(lists)
    return classes.select("rep", "n", "code").mapInArrow(lambda it: _route(it, held.value, replicate, most, search, visits, dim), "rep long, n long, code binary, lists array<int>, visits array<int>")


def wide_index(classes: DataFrame, lists: Lists, asked: DataFrame | None = None, replicate: float = 0.2, most: int = 5, share: float = 1 / 10, least: int = 20, dim: int = DIM) -> DataFrame:
    """As ``index``, for searches without a threshold: each class visits the nearest ``share`` of all lists, at least ``least``.

    The visits are found by comparison with every centroid, and their number grows with the lists, as a fixed number would
    lose ever more. ``asked``: ``code`` of the records that search; without it all do.
    """
    held = classes.sparkSession.sparkContext.broadcast(lists)
    rows = classes.select("rep", "n", "code", F.lit(True).alias("asks")) if asked is None else classes.join(asked.select("code").distinct().withColumn("_asks", F.lit(True)), "code", "left").select("rep", "n", "code", F.coalesce("_asks", F.lit(False)).alias("asks"))
    visits = max(least, math.ceil(share * len(lists.centroids)))
    return rows.mapInArrow(lambda it: _route_wide(it, held.value, replicate, most, visits, dim), "rep long, n long, code binary, lists array<int>, visits array<int>")
