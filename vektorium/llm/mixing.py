"""Mixing sources to target weights, measured in tokens, by temperature.

Weights are powers of what the sources have. ``plan`` moves between natural shares and targets,
``w(t) ~ share ** (1 - t) * target ** t`` over the sources that have tokens, and bisects the exponent t
to the largest in [0, 1] at which no source needs more than ``max_repeats`` passes over its documents
for the stated total. (A bare exponent on the shares can't meet ten given targets with one number.)
``plan_by_entropy`` is that bare exponent, ``w(t) ~ share ** t``: t is bisected until the weights have a
target entropy, and raised towards 1 as far as the repetition limits ask for. ``whole_total`` states a
total: what the listed sources have together, or more if the targets can be met exactly with more.

Weights are realised as budgeted block permutations: a source of A tokens and a budget of B is drawn
in floor(B / A) whole blocks, each a permutation of all its documents by a seeded hash, and a prefix
of one more permutation. The prefix is cut with two-level sums (over ``BUCKETS`` hash ranges, then
inside the one range the cut falls in), so no task holds a source, and what is joined back is one row
a source. The document the cut falls into is taken if half of it fits, so a source misses its budget
by at most half a document.

Documents of null, unlisted or unnamed sources, and texts of no tokens (null, empty), are not drawn;
a listed source without documents gets nothing and its weight goes to the others in proportion.
Spellings of a source that differ in case, surrounding blanks or hyphens are one source, in documents
and in targets: weights of one source's targets are summed, the largest repetition limit holds; a null
weight or limit is 0, a target without a source is left out. No documents or targets: no rows.
More than ``MAX_SOURCES`` targets are an error.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from vektorium.llm.hashing import range_hashes

#: Hash ranges of a permutation (the top 12 bits of the hash).
BUCKETS = 4096
MAX_SOURCES = 100_000
CHUNK = 1 << 22

#: Distinct stretches a worker remembers before it starts afresh.
REMEMBERED = 1 << 20

#: 0 not ASCII or an apostrophe, 1 white space, 2 letters, 3 digits, 4 other.
_CLASS = np.zeros(256, np.uint8)
_CLASS[:128] = 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[65:91] = _CLASS[97:123] = 2
_CLASS[48:58] = 3
_CLASS[39] = 0


class TokenCounter:
    """Counts tokens of a byte-level BPE whose pieces are runs of one kind of character.

    The tokenizer's pattern never puts white space behind other characters in one piece, nor letters,
    digits and other characters together, save for what follows an apostrophe. A text thus falls into
    independent stretches (white space and the run after it; nothing is cut beside an apostrophe or a
    character beyond ASCII); each distinct stretch is tokenised once a worker and remembered by its
    hash. Texts with white space beyond ASCII go to the tokenizer whole.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.hashes, self.counts = np.zeros(1, np.uint64), np.zeros(1, np.int64)

    def _of_stretches(self, raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        h = range_hashes(raw, first, last)
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        new = np.flatnonzero(self.hashes[k] != h)
        if len(new):
            hs, where = np.unique(h[new], return_index=True)
            data = raw.tobytes()
            ns = np.array([len(self.encode(data[first[i] : last[i]].decode("utf-8", "replace"))) for i in new[where].tolist()], np.int64)
            self.hashes, order = np.unique(np.concatenate([self.hashes, hs]), return_index=True)
            self.counts = np.concatenate([self.counts, ns])[order]
            k = np.searchsorted(self.hashes, h)
        n = self.counts[k]
        if len(self.hashes) > REMEMBERED:
            self.hashes, self.counts = self.hashes[:1], self.counts[:1]
        return n

    def count(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens of each text ``raw[off[i]:off[i + 1]]``."""
        n = len(off) - 1
        out = np.zeros(n, np.int64)
        if not len(raw):
            return out
        nxt = np.append(raw[1:], np.uint8(0))
        odd = ((raw == 0xC2) & ((nxt == 0x85) | (nxt == 0xA0))) | ((raw == 0xE1) & (nxt == 0x9A)) | ((raw == 0xE2) & ((nxt == 0x80) | (nxt == 0x81))) | ((raw == 0xE3) & (nxt == 0x80)) | ((raw >= 0x1C) & (raw <= 0x1F))
        odd_docs = np.zeros(n, bool)
        odd_docs[np.searchsorted(off, np.flatnonzero(odd), side="right") - 1] = True
        kind = _CLASS[raw]
        begins = np.ones(len(raw), bool)
        was, now = kind[:-1], kind[1:]
        begins[1:] = (now != was) & (was != 1) & ((now == 1) | ((was != 0) & (now != 0)))
        begins[off[:-1][off[:-1] < len(raw)]] = True
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(raw))
        doc = np.searchsorted(off, first, side="right") - 1
        use = ~odd_docs[doc]
        if use.any():
            np.add.at(out, doc[use], self._of_stretches(raw, first[use], last[use]))
        for d in np.flatnonzero(odd_docs).tolist():
            out[d] = len(self.encode(raw[off[d] : off[d + 1]].tobytes().decode("utf-8", "replace")))
        return out


_COUNTERS: dict[tuple[str, str], TokenCounter] = {}


def default_tokenizer() -> tuple[str, str]:
    """Path and pattern of the public byte-level BPE of 50,256 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _count_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    counter = _COUNTERS.get((path, pattern)) or _COUNTERS.setdefault((path, pattern), TokenCounter(path, pattern))
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        text = pc.fill_null(text.cast(pa.large_string()), "")
        off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
        counts, lo = np.zeros(len(text), np.int64), 0
        while lo < len(text):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK, side="right")) - 1)
            counts[lo:hi] = counter.count(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            lo = hi
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts)], names=[*batch.schema.names[:-1], "n_tokens"])


def with_tokens(df: DataFrame, keys: list[str], text: str, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """``*keys, n_tokens``: the number of tokens of ``text`` (0 for null)."""
    path, pattern = tokenizer or default_tokenizer()
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", n_tokens long"
    return df.select(*keys, text).mapInArrow(lambda it: _count_batches(it, path, pattern), schema)


def source_name(source: Column) -> Column:
    """One spelling for a source: case, surrounding blanks and hyphens don't count."""
    return F.regexp_replace(F.lower(F.trim(source)), "-", "_")


@dataclass(frozen=True)
class Budget:
    """What is drawn of one source."""

    available: int
    target: float
    weight: float
    budget: float
    max_repeats: int
    exponent: float = 1.0

    @property
    def blocks(self) -> int:
        return min(self.max_repeats, int(self.budget / self.available + 1e-9)) if self.available else 0

    @property
    def rest(self) -> float:
        return max(0.0, self.budget - self.blocks * self.available) if self.blocks < self.max_repeats else 0.0


def plan(available: Mapping[str, int], targets: Mapping[str, tuple[float, int]], total: float | None = None) -> dict[str, Budget]:
    """Budgets in tokens by source (see the module's text)."""
    live = {s: a for s, a in available.items() if a > 0 and targets.get(s, (0, 0))[0] > 0 and targets[s][1] > 0}
    if not live:
        return {s: Budget(0, w, 0.0, 0.0, r) for s, (w, r) in targets.items()}
    goal = sum(targets[s][0] for s in live)
    q = {s: targets[s][0] / goal for s in live}
    have = sum(live.values())
    p = {s: a / have for s, a in live.items()}
    caps = {s: live[s] * targets[s][1] for s in live}
    if total is None:
        total = min(caps[s] / q[s] for s in live)
    total = min(total, sum(caps.values()))

    def weights(t: float) -> dict[str, float]:
        w = {s: math.exp((1 - t) * math.log(p[s]) + t * math.log(q[s])) for s in live}
        z = sum(w.values())
        return {s: x / z for s, x in w.items()}

    fits = lambda t: all(x * total <= caps[s] * (1 + 1e-9) for s, x in weights(t).items())
    t = 1.0 if fits(1.0) or not fits(0.0) else _bisect(fits, 0.0, 1.0)
    w = weights(t)
    return _budgets(live, targets, w, caps, q, total, t)


def _bisect(fits: Callable[[float], bool], good: float, bad: float) -> float:
    """The exponent nearest to ``bad`` that still fits."""
    for _ in range(60):
        mid = (good + bad) / 2
        good, bad = (mid, bad) if fits(mid) else (good, mid)
    return good


def _budgets(live: Mapping[str, int], targets: Mapping[str, tuple[float, int]], w: Mapping[str, float], caps: Mapping[str, int], q: Mapping[str, float], total: float, exponent: float) -> dict[str, Budget]:
    """Budgets for weights ``w``; what the limits leave over goes to sources with room, by their share of ``q``."""
    budget = {s: min(caps[s], w[s] * total) for s in live}
    for _ in range(100):
        left = total - sum(budget.values())
        room = {s: caps[s] - budget[s] for s in live if caps[s] - budget[s] > 1e-6}
        if left <= 1e-6 * total or not room:
            break
        z = sum(q[s] for s in room)
        for s, r in room.items():
            budget[s] += min(r, left * q[s] / z)
    return {s: Budget(live.get(s, 0), t, budget.get(s, 0.0) / total, budget.get(s, 0.0), r, exponent) for s, (t, r) in targets.items()}


def whole_total(available: Mapping[str, int], targets: Mapping[str, tuple[float, int]]) -> float | None:
    """What the listed sources have together, or the largest total at which the targets hold exactly if that is more.

    So a small source with a large target never shrinks the mixture: the exponent gives way instead. None without sources.
    """
    live = {s: a for s, a in available.items() if a > 0 and targets.get(s, (0, 0))[0] > 0 and targets[s][1] > 0}
    goal = sum(targets[s][0] for s in live)
    return max(float(sum(live.values())), min(a * targets[s][1] * goal / targets[s][0] for s, a in live.items())) if live else None


def bits(weights: Mapping[str, float]) -> float:
    """Entropy in bits of weights that needn't sum to 1."""
    z = sum(weights.values())
    return -sum(x / z * math.log2(x / z) for x in weights.values() if x > 0) if z > 0 else 0.0


def entropy_weights(available: Mapping[str, int], entropy: float) -> tuple[dict[str, float], float]:
    """Weights ``share ** t`` with t in [0, 64] bisected so that their entropy is ``entropy`` bits, and t.

    More bits than there are sources for give equal weights (t = 0).
    """
    live = {s: a for s, a in available.items() if a > 0}
    t = _bisect(lambda t: bits(_powers_of(live, t)) >= entropy, 0.0, 64.0)
    return _powers_of(live, t), t


def _powers_of(live: Mapping[str, int], t: float) -> dict[str, float]:
    most = max(live.values(), default=1)
    w = {s: (a / most) ** t for s, a in live.items()}
    z = sum(w.values())
    return {s: x / z for s, x in w.items()}


def plan_by_entropy(available: Mapping[str, int], targets: Mapping[str, tuple[float, int]], entropy: float, total: float | None = None) -> dict[str, Budget]:
    """Budgets with weights ``share ** t``: t meets ``entropy`` bits, or is the nearest to it that the repetition limits allow.

    ``total`` is what the listed sources have unless given; t = 1 asks for one pass over each of them then.
    """
    live = {s: a for s, a in available.items() if a > 0 and targets.get(s, (0, 0))[1] > 0}
    if not live:
        return {s: Budget(0, w, 0.0, 0.0, r) for s, (w, r) in targets.items()}
    caps = {s: live[s] * targets[s][1] for s in live}
    total = min(float(sum(live.values())) if total is None else total, sum(caps.values()))
    w, t = entropy_weights(live, entropy)
    fits = lambda t: all(x * total <= caps[s] * (1 + 1e-9) for s, x in _powers_of(live, t).items())
    if not fits(t) and fits(1.0):
        t = _bisect(fits, 1.0, t)
        w = _powers_of(live, t)
    return _budgets(live, targets, w, caps, w, total, t)


def wanted_of(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Weight and repetition limit by source, of (source, target_weight, max_repeats) rows."""
    t = targets.where("source IS NOT NULL").groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_weight").alias("w"), F.max("max_repeats").alias("r"))
    rows = t.orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return {r["source"]: (max(0.0, float(r["w"] or 0.0)), max(0, int(r["r"] or 0))) for r in rows}


def available_tokens(sized: DataFrame, wanted: Mapping[str, tuple[float, int]]) -> dict[str, int]:
    """Tokens by listed source; one row a listed source reaches the driver."""
    if not wanted:
        return {}
    listed = sized.sparkSession.createDataFrame([(s,) for s in wanted], "source string")  # at most MAX_SOURCES rows
    rows = sized.join(F.broadcast(listed), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    return {r["source"]: int(r["n"] or 0) for r in rows}


def draw(sized: DataFrame, budgets: Mapping[str, Budget], seed: int = 7) -> DataFrame:
    """The mixture: ``source, doc_id, block, mix_key, n_tokens``, one row a copy drawn.

    ``sized`` has ``source, doc_id, n_tokens``. Sorting by ``mix_key`` gives a stream in which every
    source is spread evenly and no block of a source begins before the last one ended.
    """
    spark = sized.sparkSession
    rows = [(s, b.blocks, float(b.rest), float(b.budget / b.available)) for s, b in budgets.items() if b.available and b.budget > 0]
    wanted = spark.createDataFrame(rows, "source string, blocks int, rest double, passes double")
    docs = sized.where((F.col("n_tokens") > 0) & F.col("doc_id").isNotNull()).join(F.broadcast(wanted), "source")  # one row a source
    order = F.xxhash64(F.lit(seed), "doc_id", F.col("blocks") + 1)
    docs = docs.select("*", order.alias("_h"), F.shiftrightunsigned(order, 52).cast("int").alias("_hb"))
    # the hash range each source's last block ends in, and the tokens before it: one row a source, none if it takes all
    ranges = docs.groupBy("source", "rest", "_hb").agg(F.sum("n_tokens").alias("_sum"))
    ranges = ranges.withColumn("_to", F.sum("_sum").over(W.partitionBy("source").orderBy("_hb").rowsBetween(W.unboundedPreceding, 0)))
    ends = ranges.where(F.col("_to") > F.col("rest")).groupBy("source").agg(F.min(F.struct("_hb", (F.col("_to") - F.col("_sum")).alias("_before"))).alias("_end"))
    docs = docs.join(F.broadcast(ends), "source", "left").select("*", F.coalesce("_end._hb", F.lit(BUCKETS)).alias("_last"), F.col("_end._before").alias("_before"))
    whole, cut = F.col("_hb") < F.col("_last"), F.col("_hb") == F.col("_last")
    cols = ["source", "doc_id", "n_tokens", "blocks", "passes"]
    inside = docs.where(cut).withColumn("_c", F.col("_before") + F.sum("n_tokens").over(W.partitionBy("source").orderBy("_h", "doc_id").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens") / 2)
    inside = inside.select(*cols, (F.col("blocks") + (F.col("_c") <= F.col("rest")).cast("int")).alias("copies"))
    rest = docs.where(~cut).select(*cols, (F.col("blocks") + whole.cast("int")).alias("copies"))
    copies = rest.unionByName(inside).where("copies > 0").select(*cols, F.explode(F.sequence(F.lit(1), "copies")).alias("block"))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "block"), 11) / F.lit(float(1 << 53))
    return copies.select("source", "doc_id", "block", ((F.col("block") - 1 + place * F.least(F.lit(1.0), F.col("passes") - F.col("block") + 1)) / F.col("passes")).alias("mix_key"), "n_tokens")
