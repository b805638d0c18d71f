"""Evaluation passages inside training documents, by template canonicalisation.

Words are the longest runs of ASCII letters, digits and underscores, whatever their case. Every word
is canonicalised: numbers become the placeholder ``NUM``, units of measure after a number ``UNIT``. In the
coarse template names become ``NAME`` as well: all words that are neither in a fixed list (``COMMON``) nor in
at least 1 in ``RARE`` of all documents of the corpus (and ``FLOOR`` documents). So whether a passage is found never
depends on what other items there are, or how they are taken in blocks.

*Fine templates* find passages that stand in a document whole, in part or edited. Windows of two
canonical words are hashed on both sides and joined; the items' table is broadcast (it is bounded by
``MAX_ITEM_WORDS``, larger sets are taken in blocks) and documents are read once, without a shuffle.
Two words are the longest window that loses nothing: of 26 words kept in order from 30, within 40 of
the document, at most 4 item words and 14 document words interrupt, so at least 7 pairs stay adjacent
on both sides. A document is checked against a passage only where 7 joined windows fall within 40
words. The check on the slots is exact: 12 successive equal words, or a longest common subsequence of
at least 85 in 100 of 30 words of the item within 40 words of the document.

*Coarse templates* find re-parameterised tasks: windows of ``COARSE`` words with at least
``COARSE_LITERALS`` literal ones must be equal as templates, and the slots must be consistent over
all joined windows of the passage: one document name for each item name and the other way round, and
one document number for each item number (different item numbers may become equal).

Nulls and empty texts hold nothing. Items without a passage of 12 words can't be found. Repeated items or
documents give the same pairs once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from vektorium.llm.hashing import mix, powers

RUN, SPAN, WITHIN, SHARE = 12, 30, 40, 0.85
NEEDED = math.ceil(SPAN * SHARE)
SEEDS = 7
DRIFT = (SPAN - NEEDED) + (WITHIN - NEEDED)
COARSE, COARSE_LITERALS = 8, 4
RARE, FLOOR = 4000, 2
#: Of the words that are frequent enough, so many of the most frequent are literal (8 MB of hashes on the driver and in the broadcast).
MAX_VOCABULARY = 1 << 20
#: Joined windows that 12 successive words of an item give.
COARSE_HITS = RUN - COARSE + 1
MAX_ITEM_WORDS = 2_000_000
#: Bytes hashed at a time; longer texts are cut at a byte between two words.
CHUNK = 1 << 22
#: Words checked at a time; a longer region is taken in parts that overlap by ``WITHIN``.
REGION = 2048
#: Words of English and of programming languages that are no names.
COMMON = (
    "a about after all also an and any are as at be been before between both but by can could did do does down each either else every few first for from had has have he her his how i if in into is it its just "
    "last less let many may more most must next no none nor not now of off on once one only or other our out over own per same she should so some such than that the their them then there these they this those "
    "through to too two under until up use used using was we were what when where which while who whose why will with within without would you your zero "
    "assert async await bool break case catch char class const continue def default elif end enum except false final finally float fn func function given if import int interface lambda list "
    "long new nil null none pass print private public raise return returns select self set static str string struct super switch this throw true try type val var void yield"
).split()
UNITS = ("ns", "us", "ms", "s", "sec", "secs", "second", "seconds", "min", "minutes", "hours", "days", "b", "kb", "mb", "gb", "tb", "kib", "mib", "gib", "bytes", "px", "pt", "em", "mm", "cm", "m", "km", "g", "kg", "percent", "hz", "khz", "mhz", "ghz")

_LOWER = np.zeros(256, np.uint64)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789_":
    _LOWER[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _LOWER[_c] = _c + 32
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True

def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of UTF-8 bytes: each word's 64-bit hash, its first byte, and whether it is a number."""
    if len(raw) > CHUNK:
        cut = CHUNK
        while cut and _LOWER[raw[cut]]:
            cut -= 1
        if cut:
            a, b = words_of(raw[:cut]), words_of(raw[cut:])
            return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1] + cut]), np.concatenate([a[2], b[2]])
    n = len(raw)
    up, down = powers(n)
    low = _LOWER[raw]
    inside = low != 0
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    first, last = edge[::2], edge[1::2]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(low * up[:n], out=total[1:])
    h = mix((total[last] - total[first]) * down[first])
    digits = np.zeros(n + 1, np.int32)
    np.cumsum(_DIGIT[raw], out=digits[1:])
    return h, first, digits[last] - digits[first] == last - first


def words_in(text: str) -> tuple[np.ndarray, np.ndarray]:
    h, _, number = words_of(np.frombuffer(text.encode(), np.uint8))
    return h, number


_UNIT_HASHES = np.sort(np.concatenate([words_in(u)[0] for u in UNITS]))
_COMMON_HASHES = np.unique(np.concatenate([words_in(w)[0] for w in COMMON]))
_NUM, _UNIT, _NAME = np.uint64(0x4E554D), np.uint64(0x554E4954), np.uint64(0x4E414D45)


def _member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def canonical(h: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Words with numbers and units as typed placeholders; a unit counts only after a number."""
    after = np.concatenate([[False], number[:-1]]) if len(number) else number
    unit = np.zeros(len(h), bool)
    at = np.flatnonzero(after)
    unit[at] = _member(h[at], _UNIT_HASHES)
    return np.where(number, _NUM, np.where(unit, _UNIT, h))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x94D049BB133111EB))
    x ^= x >> np.uint64(31)
    return x * np.uint64(0xD6E8FEB86659FD93)


class _Table:
    """Hash -> entries (passage, position), with a bitmap in front that most lookups end at."""

    def __init__(self, keys: np.ndarray, passage: np.ndarray, position: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.passage, self.position = passage[order].astype(np.int32), position[order].astype(np.int32)
        self.keys, self.starts = np.unique(keys[order], return_index=True)
        self.starts = np.append(self.starts, len(keys))
        self.bits = 20
        self.front = np.zeros(1 << self.bits, bool)
        self.front[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``x`` are keys: their indices into ``x`` and into ``keys``."""
        maybe = np.flatnonzero(self.front[(x >> np.uint64(64 - self.bits)).astype(np.int64)])
        if not len(self.keys) or not len(maybe):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.keys, x[maybe]), len(self.keys) - 1)
        hit = self.keys[k] == x[maybe]
        return maybe[hit], k[hit]

    def entries(self, maybe: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index into what was looked up, passage and position of every match."""
        n = self.starts[k + 1] - self.starts[k]
        src = np.repeat(maybe, n)
        off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        e = np.repeat(self.starts[k], n) + off
        return src, self.passage[e].astype(np.int64), self.position[e].astype(np.int64)


@dataclass
class Items:
    """The items of one block, as they are broadcast."""

    ids: list[int]
    item_of: np.ndarray
    words: list[np.ndarray]
    numbers: list[np.ndarray]
    fine: _Table
    coarse: _Table
    held: _Table
    vocabulary: np.ndarray


def passages_of(prompt: str | None, solution: str | None) -> list[str]:
    """The prompt without its first line, and the solution."""
    out = []
    if prompt and "\n" in prompt:
        out.append(prompt.split("\n", 1)[1])
    if solution:
        out.append(solution)
    return out


def _coarse_windows(canon: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``COARSE`` words with names replaced, and where it has enough literals."""
    known = _member(canon, vocabulary)
    t = np.where(known | (canon == _NUM) | (canon == _UNIT), canon, _NAME)
    n = len(t) - COARSE + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h = t[:n].copy()
    for k in range(1, COARSE):
        h = _pair(h, t[k : n + k])
    c = np.concatenate([[0], np.cumsum(known)])
    return h, (c[COARSE:] - c[:-COARSE])[:n] >= COARSE_LITERALS


def build_items(rows: list[tuple[int, str | None, str | None]], vocabulary: np.ndarray = _COMMON_HASHES) -> Items:
    """The table of template windows of (item_id, prompt, solution) rows; ``vocabulary``: hashes of the literal words, ascending."""
    ids, item_of, words, numbers = [], [], [], []
    for i, prompt, solution in rows:
        if i is None:
            continue
        for p in passages_of(prompt, solution):
            h, number = words_in(p)
            if len(h) >= RUN:
                item_of.append(len(ids))
                words.append(h)
                numbers.append(number)
        ids.append(i)
    z = [np.zeros(0, np.uint64)]
    fk, fp, fq, ck, cp, cq, hk = list(z), [], [], list(z), [], [], list(z)
    for k, (h, number) in enumerate(zip(words, numbers)):
        c = canonical(h, number)
        fk.append(_pair(c[:-1], c[1:]))
        fp.append(np.full(len(c) - 1, k))
        fq.append(np.arange(len(c) - 1))
        hk.append(_pair(np.unique(h), np.uint64(k)))
        x, ok = _coarse_windows(c, vocabulary)
        ck.append(x[ok])
        cp.append(np.full(ok.sum(), k))
        cq.append(np.flatnonzero(ok))
    cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    return Items(ids, np.array(item_of, np.int64), words, numbers, _Table(cat(fk), cat(fp), cat(fq)), _Table(cat(ck), cat(cp), cat(cq)), _Table(cat(hk), np.zeros(len(cat(hk))), np.zeros(len(cat(hk)))), vocabulary)


def _parts(words: np.ndarray) -> list[np.ndarray]:
    """Parts of at most ``REGION`` words; whatever lies within ``WITHIN`` words lies in one of them."""
    return [words[lo : lo + REGION] for lo in range(0, max(1, len(words) - WITHIN), REGION - WITHIN)]


def holds_run(doc: np.ndarray, passage: np.ndarray, run: int = RUN) -> bool:
    """Whether ``run`` successive words of the passage stand in the document."""
    if len(doc) < run or len(passage) < run:
        return False
    if len(doc) > REGION or len(passage) > REGION:
        return any(holds_run(d, p, run) for d in _parts(doc) for p in _parts(passage))
    eq = doc[:, None] == passage[None, :]
    have, r = 1, eq
    while have < run:
        step = min(have, run - have)
        r = r[: r.shape[0] - step, : r.shape[1] - step] & r[step:, step:]
        have += step
    return bool(r.any())


def holds_edited(doc: np.ndarray, passage: np.ndarray) -> bool:
    """Whether ``NEEDED`` of some ``SPAN`` words stand in order within ``WITHIN`` words of the document."""
    n, m = len(doc), len(passage)
    if m < SPAN or n < NEEDED:
        return False
    if n > REGION or m > REGION:
        return any(holds_edited(d, p) for d in _parts(doc) for p in _parts(passage))
    eq = np.zeros((n + WITHIN, m), bool)
    eq[:n] = doc[:, None] == passage[None, :]
    starts = np.arange(m - SPAN + 1)
    # an item window can only do with enough of its words anywhere near; a document window likewise
    c = np.concatenate([[0], np.cumsum(eq.any(0))])
    starts = starts[c[starts + SPAN] - c[starts] >= NEEDED]
    d = np.concatenate([[0], np.cumsum(eq.any(1))])
    at = np.arange(max(1, n - NEEDED + 1))
    at = at[d[np.minimum(at + WITHIN, n)] - d[at] >= NEEDED]
    if not len(starts) or not len(at):
        return False
    masks = np.zeros((n + WITHIN, len(starts)), np.uint32)
    for b in range(SPAN):
        masks |= eq[:, starts + b].astype(np.uint32) << np.uint32(b)
    full = np.uint32((1 << SPAN) - 1)
    for lo in range(0, len(at), 256):
        a = at[lo : lo + 256]
        v = np.full((len(a), len(starts)), full, np.uint32)
        for t in range(WITHIN):
            u = v & masks[a + t]
            v = ((v + u) | (v - u)) & full
        if (np.bitwise_count(~v & full) >= NEEDED).any():
            return True
    return False


def _regions(doc: np.ndarray, passage: np.ndarray, at: np.ndarray, position: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, passage, first, last word) where ``SEEDS`` joined windows fall within ``WITHIN`` words.

    Between kept words at most ``SPAN - NEEDED`` item words and ``WITHIN - NEEDED`` document words are
    skipped, so the seeds' diagonals lie within ``DRIFT`` of each other: two overlapping grids of
    twice that width have them in one cell.
    """
    spans = []
    for shift in (0, DRIFT):
        cell = (at - position + shift) // (2 * DRIFT)
        order = np.lexsort((at, cell, passage, doc))
        d, p, c, g = doc[order], passage[order], cell[order], at[order]
        if len(g) < SEEDS:
            continue
        keep = np.ones(len(g), bool)
        keep[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1]) | (p[1:] != p[:-1]) | (d[1:] != d[:-1])
        d, p, c, g = d[keep], p[keep], c[keep], g[keep]
        k = len(g) - SEEDS + 1
        if k <= 0:
            continue
        j = SEEDS - 1
        dense = np.flatnonzero((d[:k] == d[j:]) & (p[:k] == p[j:]) & (c[:k] == c[j:]) & (g[j:] - g[:k] < WITHIN - 1))
        spans += zip(d[dense].tolist(), p[dense].tolist(), g[dense].tolist(), g[dense + j].tolist())
    out: list[tuple[int, int, int, int]] = []
    for d, p, lo, hi in sorted(spans):
        if out and out[-1][:2] == (d, p) and lo <= out[-1][3] + WITHIN:
            out[-1] = (d, p, out[-1][2], max(hi, out[-1][3]))
        else:
            out.append((d, p, lo, hi))
    return out


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The batch's text bytes and offsets (nulls are empty)."""
    text = batch.column(1)
    text = text.cast(pa.large_string()) if not pa.types.is_large_string(text.type) else text
    if text.null_count:
        text = pc.fill_null(text, "")
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``CHUNK`` bytes of text (a longer text is a piece of its own)."""
    for batch in batches:
        _, off = _texts(batch)
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def _batch_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, number flag and document of every word; a word never spans two documents."""
    raw, off = _texts(batch)
    if len(batch) == 0 or len(raw) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64)
    # a separator byte after each document
    spaced = np.zeros(len(raw) + len(off) - 1, np.uint8)
    spaced[np.arange(len(raw)) + np.repeat(np.arange(len(off) - 1), np.diff(off))] = raw
    starts = off[:-1] + np.arange(len(off) - 1)
    h, first, number = words_of(spaced)
    return h, number, np.searchsorted(starts, first, side="right") - 1


def _crowded(at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which of the ascending word indices have ``SEEDS`` of them, themselves included, within ``WITHIN`` words of a document."""
    j = SEEDS - 1
    k = max(0, len(at) - j)
    start = np.flatnonzero((at[j:] - at[:k] < WITHIN - 1) & (doc[at[j:]] == doc[at[:k]])) if k else np.zeros(0, np.int64)
    cover = np.zeros(len(at) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + SEEDS, -1)
    return np.cumsum(cover)[:-1] > 0


def _with_enough_words(h: np.ndarray, items: Items, passage: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which regions hold ``RUN`` successive words, or ``NEEDED`` within ``WITHIN``, that the passage has at all."""
    n = hi - lo
    start = np.concatenate([[0], np.cumsum(n + WITHIN)])  # each region is followed by WITHIN words that match nothing
    ours = np.arange(n.sum()) + np.repeat(np.arange(len(n)) * WITHIN, n)
    key = _pair(h[ours + np.repeat(lo - start[:-1], n)], np.repeat(passage, n).astype(np.uint64))
    member = np.zeros(start[-1] + WITHIN + 1, np.int32)
    found, _ = items.held.find(key)
    member[ours[found] + 1] = 1
    c = np.cumsum(member)
    m = start[-1]
    good = (c[RUN : m + RUN] - c[:m] == RUN) | (c[WITHIN : m + WITHIN] - c[:m] >= NEEDED)
    return np.logical_or.reduceat(good, start[:-1])


def find_leaks(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    """(item_id, doc_id) of every batch of (doc_id, text)."""
    for batch in _slices(batches):
        h, number, doc = _batch_words(batch)
        found: set[tuple[int, int]] = set()
        regions: list[tuple[int, int, int, int]] = []
        if len(h) > 1:
            c = canonical(h, number)
            at, k = items.fine.find(_pair(c[:-1], c[1:]))
            same = doc[at] == doc[at + 1]
            at, k = at[same], k[same]
            near = _crowded(at, doc)
            src, passage, position = items.fine.entries(at[near], k[near])
            regions = _regions(doc[src], passage, src, position)
        if regions:
            d, p, lo, hi = np.array(regions, np.int64).T
            lo = np.maximum(lo - WITHIN, np.searchsorted(doc, d))
            hi = np.minimum(hi + WITHIN + 1, np.searchsorted(doc, d, "right"))
            for r in np.flatnonzero(_with_enough_words(h, items, p, lo, hi)).tolist():
                key, words, theirs = (int(items.item_of[p[r]]), int(d[r])), h[lo[r] : hi[r]], items.words[p[r]]
                if key not in found and (holds_run(words, theirs) or holds_edited(words, theirs)):
                    found.add(key)
        docs = batch.column(0).to_pylist()
        pairs = [(items.ids[i], docs[d]) for i, d in sorted(found)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in pairs], pa.int64()), pa.array([x[1] for x in pairs], pa.int64())], names=["item_id", "doc_id"])


def _chains(src: np.ndarray, position: np.ndarray) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
    """Chains of at least ``COARSE_HITS`` joined windows of one document and passage, sorted by diagonal and word.

    A run has one diagonal and no gap above ``WITHIN`` words. Runs follow each other if at most ``2 * COARSE`` words of
    either side lie between their windows, as fillers of other lengths move the diagonal. Each is ``(windows, runs)``, a
    run being (first word, first position, last word, last position) of its windows; a run on its own is a chain too.
    """
    cut = np.flatnonzero((np.diff(src - position, prepend=-(1 << 60)) != 0) | (np.diff(src, prepend=-(1 << 60)) > WITHIN))
    end = np.append(cut[1:], len(src))
    o = np.lexsort((position[cut], src[cut]))
    s0, p0, s1, p1, n = src[cut][o], position[cut][o], src[end - 1][o], position[end - 1][o], (end - cut)[o]
    best, back, tail = n.copy(), np.full(len(n), -1), np.ones(len(n), bool)
    for i in range(len(n)):
        ds, dp = s0[i] - s1[:i] - COARSE, p0[i] - p1[:i] - COARSE
        ok = np.flatnonzero((ds >= 1) & (dp >= 1) & (ds <= 2 * COARSE) & (dp <= 2 * COARSE))
        if len(ok):
            back[i] = ok[best[ok].argmax()]
            best[i] += best[back[i]]
            tail[back[i]] = False
    out = []
    for i in range(len(n)):
        if n[i] >= COARSE_HITS and (back[i] >= 0 or not tail[i]):
            out.append((int(n[i]), [(int(s0[i]), int(p0[i]), int(s1[i]), int(p1[i]))]))
        if tail[i] and best[i] >= COARSE_HITS:
            runs, j = [], i
            while j >= 0:
                runs.append((int(s0[j]), int(p0[j]), int(s1[j]), int(p1[j])))
                j = int(back[j])
            out.append((int(best[i]), runs[::-1]))
    return out


def _chain_slots(runs: list[tuple[int, int, int, int]], h: np.ndarray, number: np.ndarray, theirs: np.ndarray, numbers: np.ndarray, vocabulary: np.ndarray) -> set[tuple[tuple, tuple]] | None:
    """The slots along a chain as (item words, document words); None if there are none or they are not filled consistently."""
    slots: set[tuple[tuple, tuple]] = set()
    named: set[tuple[tuple, tuple]] = set()
    for k, (s0, p0, s1, p1) in enumerate(runs):
        a, b, is_number = theirs[p0 : p1 + COARSE], h[s0 : s1 + COARSE], numbers[p0 : p1 + COARSE]
        slot = ~_member(a, vocabulary) | is_number
        name = slot & ~is_number
        slots |= {((x,), (y,)) for x, y in zip(a[slot].tolist(), b[slot].tolist())}
        named |= {((x,), (y,)) for x, y in zip(a[name].tolist(), b[name].tolist())}
        if k + 1 < len(runs):  # what lies between is one slot, without the words at its ends that are equal
            a, b = theirs[p1 + COARSE : runs[k + 1][1]], h[s1 + COARSE : runs[k + 1][0]]
            is_number = numbers[p1 + COARSE : runs[k + 1][1]]
            while min(len(a), len(b)) > 1 and a[0] == b[0]:
                a, b, is_number = a[1:], b[1:], is_number[1:]
            while min(len(a), len(b)) > 1 and a[-1] == b[-1]:
                a, b, is_number = a[:-1], b[:-1], is_number[:-1]
            pair = (tuple(a.tolist()), tuple(b.tolist()))
            slots.add(pair)
            if not is_number.any():
                named.add(pair)
    if not slots or len({x for x, _ in slots}) < len(slots) or len({y for _, y in named}) < len(named):
        return None
    return slots


def find_reparameterised(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    """(item_id, doc_id, n_windows, n_slots, n_changed): passages whose template stands there with consistent other slots."""
    for batch in _slices(batches):
        h, number, doc = _batch_words(batch)
        rows = []
        if len(h) >= COARSE:
            c = canonical(h, number)
            x, ok = _coarse_windows(c, items.vocabulary)
            idx = np.flatnonzero(ok)
            idx = idx[doc[idx] == doc[idx + COARSE - 1]]
            src, passage, position = items.coarse.entries(*items.coarse.find(x[idx]))
            src = idx[src]
            order = np.lexsort((src, src - position, passage, doc[src]))
            src, passage, position = src[order], passage[order], position[order]
            cut = np.flatnonzero(np.diff(doc[src], prepend=-1) | np.diff(passage, prepend=-1))
            for lo, hi in zip(cut, np.append(cut[1:], len(src))):
                if hi - lo < COARSE_HITS:
                    continue
                p = int(passage[lo])
                for n, runs in _chains(src[lo:hi], position[lo:hi]):
                    slots = _chain_slots(runs, h, number, items.words[p], items.numbers[p], items.vocabulary)
                    if slots is not None:
                        rows.append((items.ids[int(items.item_of[p])], batch.column(0)[int(doc[src[lo]])].as_py(), n, len(slots), sum(x != y for x, y in slots)))
        cols = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(v), pa.int64()) for v in cols], names=["item_id", "doc_id", "n_windows", "n_slots", "n_changed"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (word, documents): in how many documents of a piece each word is."""
    for batch in _slices(batches):
        h, _, doc = _batch_words(batch)
        _, once = np.unique(_pair(h, doc.astype(np.uint64)), return_index=True)
        word, n = np.unique(h[once], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])


def corpus_vocabulary(docs: DataFrame) -> np.ndarray:
    """Hashes of the literal words: the fixed list and what enough of all documents have."""
    least = max(FLOOR, math.ceil(docs.count() / RARE))
    counts = docs.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    rows = counts.orderBy(F.col("n").desc(), "word").limit(MAX_VOCABULARY).select("word").toArrow().column(0).to_numpy()
    return np.union1d(_COMMON_HASHES, rows.astype(np.int64).view(np.uint64))


def _item_blocks(items: DataFrame, item_id: str, prompt: str, solution: str, vocabulary: np.ndarray = _COMMON_HASHES) -> Iterator[Items]:
    """Items in blocks of at most ``MAX_ITEM_WORDS`` words, one block on the driver at a time."""
    block, size = [], 0
    for r in items.select(F.col(item_id).cast("long"), prompt, solution).orderBy(item_id).toLocalIterator():
        n = len(r[1] or "") // 2 + len(r[2] or "") // 2
        if block and size + n > MAX_ITEM_WORDS:
            yield build_items(block, vocabulary)
            block, size = [], 0
        block.append(tuple(r))
        size += n
    yield build_items(block, vocabulary)


def _over_blocks(documents: DataFrame, blocks: Iterator[Items], find, schema: str) -> DataFrame:
    out = None
    for items in blocks:
        held = documents.sparkSession.sparkContext.broadcast(items)
        part = documents.mapInArrow(lambda it, held=held: find(it, held.value), schema)
        out = part if out is None else out.unionByName(part)
    return out


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", prompt: str = "prompt", solution: str = "solution") -> DataFrame:
    """``item_id, doc_id``: the documents that hold a passage of an item, each pair once."""
    docs = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _over_blocks(docs, _item_blocks(items, item_id, prompt, solution), find_leaks, "item_id long, doc_id long").distinct()


def reparameterised(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", prompt: str = "prompt", solution: str = "solution") -> DataFrame:
    """``item_id, doc_id, n_windows, n_slots, n_changed``: documents with an item's template, slots filled consistently."""
    docs = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = _over_blocks(docs, _item_blocks(items, item_id, prompt, solution, corpus_vocabulary(docs)), find_reparameterised, "item_id long, doc_id long, n_windows long, n_slots long, n_changed long")
    return rows.groupBy("item_id", "doc_id").agg(F.max_by(F.struct("n_windows", "n_slots", "n_changed"), F.struct("n_windows", "n_slots", "n_changed")).alias("x")).select("item_id", "doc_id", "x.*")
