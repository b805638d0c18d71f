"""Personal information in free text: found by a character-level BiLSTM-CRF, replaced by placeholders.

Every character of every text is scored. A text is read in lines (without the blanks before them), a
line in windows of at most ``WINDOW`` characters that overlap by ``OVERLAP``. A small BiLSTM scores all
windows; where its score reaches a threshold, learned so that it passes 99.85 % of made-up lines that
hold something, the large BiLSTM scores the line's window with the windows beside it. Where windows
overlap, label scores are averaged with weights that fall towards the windows' ends, and each
stretch is decoded by the CRF once over its whole length, so an instance at a window's edge is seen
whole. Equal windows, and equal stretches, of a piece of ``CHUNK`` characters are scored once. Nothing
is looked up and no span is rejected afterwards; blanks and quotes at a span's ends are cut off.

``find`` returns the spans, ``redact`` the texts with ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``,
``[ADDRESS]`` and ``[NAME]`` in their place and every other character unchanged.

Null and empty texts hold nothing; a null text stays null. Broken UTF-8 is read as U+FFFD. Rows with a
null id are left out; rows that are repeated are repeated in the result of ``redact`` and once in ``find``'s.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vektorium.llm.hashing import range_hashes
from vektorium.llm.pii_model import N_LABELS, Net, Tagger, ids_of, spans_of

MODEL = Path(__file__).with_name("pii_model.npz")
WINDOW, OVERLAP = 320, 120
#: Windows scored at a time by the small and the large net, and characters of text taken at a time.
SCAN_AT_ONCE, AT_ONCE, CHUNK = 4096, 2048, 1 << 22


def _cuts(n: int) -> list[tuple[int, int]]:
    if n <= WINDOW:
        return [(0, n)]
    step = WINDOW - OVERLAP
    return [(k, min(k + WINDOW, n)) for k in range(0, n - OVERLAP, step)]


def windows_of(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last character and line of every window, of lines without their leading blanks."""
    n = len(code)
    blank = (code == 32) | (code == 9)
    end = np.append(np.flatnonzero((code == 10) | (code == 13)), n)
    begin = np.append(0, end[:-1] + 1)
    solid = np.append(np.flatnonzero(~blank), n)  # line ends are solid, so no line runs into the next
    begin = np.minimum(solid[np.searchsorted(solid, begin)], end)
    some = begin < end
    begin, end = begin[some], end[some]
    line = np.arange(len(begin))
    long = np.flatnonzero(end - begin > WINDOW)
    if not len(long):
        return begin, end, line
    parts = [(begin[i] + a, begin[i] + b, i) for i in long.tolist() for a, b in _cuts(int(end[i] - begin[i]))]
    a, b, k = np.array(parts).T
    short = np.flatnonzero(end - begin <= WINDOW)
    first, last, line = np.concatenate([begin[short], a]), np.concatenate([end[short], b]), np.concatenate([line[short], k])
    order = np.argsort(first, kind="stable")
    return first[order], last[order], line[order]


def peaks(scan: Net, ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The small net's highest score in each window; equal windows are scored once."""
    _, rep, where = np.unique(range_hashes(ids, first, last), return_index=True, return_inverse=True)
    a, n = first[rep], (last - first)[rep]
    out, order = np.empty(len(rep), np.float32), np.argsort(-n, kind="stable")
    padded = np.append(ids, np.int16(0))
    for lo in range(0, len(order), SCAN_AT_ONCE):
        part = order[lo : lo + SCAN_AT_ONCE]
        lengths = n[part]
        step = np.arange(lengths[0])[:, None]
        x = padded[np.where(step < lengths, a[part] + step, len(ids))]
        s = scan.score(x, lengths)[:, 0]
        s[np.arange(len(s))[:, None] * scan.stride >= lengths] = -99
        out[part] = s.max(0)
    return out[where]


def stretches(tagger: Tagger, code: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of what the large net reads: windows that pass, with the windows beside them in their lines."""
    first, last, line = windows_of(code)
    if not len(first):
        return first, last
    passed = peaks(tagger.scan, ids, first, last) >= tagger.threshold
    same = line[1:] == line[:-1]
    wide = passed.copy()
    wide[1:] |= passed[:-1] & same
    wide[:-1] |= passed[1:] & same
    at = np.flatnonzero(wide)
    if not len(at):
        return first[:0], last[:0]
    new = np.ones(len(at), bool)
    new[1:] = (line[at[1:]] != line[at[:-1]]) | (np.diff(at) > 1)
    head = np.flatnonzero(new)
    return first[at[head]], last[at[np.append(head[1:], len(at)) - 1]]


def _weight(n: int) -> np.ndarray:
    """Falls towards a window's ends, where the tagger has seen one side only."""
    k = np.arange(n)
    return np.minimum(np.minimum(k, n - 1 - k) + 1, OVERLAP // 2).astype(np.float32)[:, None]


def tag_lines(tag: Net, lines: list[str], of: list[np.ndarray]) -> list[list[tuple[int, int, str]]]:
    """Spans (first, last, type) of each line, given with its characters' ids; equal lines are tagged once."""
    distinct: dict[str, int] = {}
    ids = []
    for s, x in zip(lines, of):
        if distinct.setdefault(s, len(ids)) == len(ids):
            ids.append(x)
    parts = [(i, a, b) for i, x in enumerate(ids) for a, b in _cuts(len(x))]
    parts.sort(key=lambda p: p[1] - p[2])
    long = {i: (np.zeros((len(ids[i]), N_LABELS), np.float32), np.zeros((len(ids[i]), 1), np.float32)) for i in {p[0] for p in parts} if len(ids[i]) > WINDOW}
    spans: list[list[tuple[int, int, str]]] = [[] for _ in ids]
    for lo in range(0, len(parts), AT_ONCE):
        part = parts[lo : lo + AT_ONCE]
        lengths = np.array([b - a for _, a, b in part])
        x = np.zeros((lengths.max(), len(part)), np.int64)
        for j, (i, a, b) in enumerate(part):
            x[: b - a, j] = ids[i][a:b]
        scores = tag.score(x, lengths)
        short = [j for j, p in enumerate(part) if p[0] not in long]
        if short:
            y = tag.decode(np.take(scores, short, axis=2) if len(short) < len(part) else scores, lengths[short])
            for j, k in enumerate(short):
                spans[part[k][0]] = spans_of(y[: lengths[k], j].tolist())
        for j, (i, a, b) in enumerate(part):
            if i in long:
                w = _weight(b - a)
                long[i][0][a:b] += scores[: b - a, :, j] * w
                long[i][1][a:b] += w
    joined = sorted(long, key=lambda i: -len(ids[i]))
    for lo in range(0, len(joined), 64):
        part = joined[lo : lo + 64]
        lengths = np.array([len(ids[i]) for i in part])
        scores = np.zeros((lengths.max(), N_LABELS, len(part)), np.float32)
        for j, i in enumerate(part):
            scores[: lengths[j], :, j] = long[i][0] / long[i][1]
        y = tag.decode(scores, lengths)
        for j, i in enumerate(part):
            spans[i] = spans_of(y[: lengths[j], j].tolist())
    return [spans[distinct[s]] for s in lines]


def _trim(line: str, a: int, b: int) -> tuple[int, int]:
    """A span without blanks, quotes and separators at its ends."""
    while a < b and line[a] in " \t,;:\"'<>=":
        a += 1
    while a < b and line[b - 1] in " \t,;:\"'<>=":
        b -= 1
    return a, b


def spans_in(tagger: Tagger, texts: list[str]) -> list[tuple[int, int, int, str]]:
    """(text, first, last, type) of every instance, in order; places are those of characters."""
    whole = "\n".join(texts)
    start = np.cumsum([0, *(len(t) + 1 for t in texts)])
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = ids_of(code)
    first, last = (x.tolist() for x in stretches(tagger, code, ids))
    lines, of = [whole[a:b] for a, b in zip(first, last)], [ids[a:b] for a, b in zip(first, last)]
    doc = (np.searchsorted(start, first, side="right") - 1).tolist()
    out = []
    for d, at, line, spans in zip(doc, first, lines, tag_lines(tagger.tag, lines, of)):
        for x, y, kind in spans:
            a, b = _trim(line, x, y)
            if a < b:
                out.append((d, at - int(start[d]) + a, at - int(start[d]) + b, kind))
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Batches in pieces of about ``CHUNK`` bytes (a longer text is a piece of its own), with their texts."""
    for batch in batches:
        raw = batch.column(1).cast(pa.large_binary())
        off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK, side="right")) - 1)
            yield batch.slice(lo, hi - lo), [None if t is None else t.decode("utf-8", "replace") for t in raw.slice(lo, hi - lo).to_pylist()]
            lo = hi


def _find(batches: Iterator[pa.RecordBatch], tagger: Tagger) -> Iterator[pa.RecordBatch]:
    for batch, texts in _pieces(batches):
        ids, full = batch.column(0).to_pylist(), [t or "" for t in texts]
        rows = dict.fromkeys((ids[d], kind, full[d][a:b]) for d, a, b, kind in spans_in(tagger, full))
        cols = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), pa.int64()), pa.array(list(cols[1]), pa.string()), pa.array(list(cols[2]), pa.string())], names=["doc_id", "pii_type", "pii_value"])


def _redact(batches: Iterator[pa.RecordBatch], tagger: Tagger) -> Iterator[pa.RecordBatch]:
    for batch, texts in _pieces(batches):
        counts, by = [0] * len(texts), {}
        for d, a, b, kind in spans_in(tagger, [t or "" for t in texts]):
            by.setdefault(d, []).append((a, b, kind))
        for d, spans in by.items():
            body, at, out = texts[d], 0, []
            for a, b, kind in spans:
                out += [body[at:a], f"[{kind.upper()}]"]
                at = b
            texts[d], counts[d] = "".join([*out, body[at:]]), len(spans)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["doc_id", "text", "n_replaced"])


def _over(documents: DataFrame, doc_id: str, text: str, do, schema: str, model: Path) -> DataFrame:
    held = documents.sparkSession.sparkContext.broadcast(Tagger.load(model))  # about 0.2 MB, whatever the data
    docs = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(lambda it: do(it, held.value), schema)


def find(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Path = MODEL) -> DataFrame:
    """``doc_id, pii_type, pii_value``: each distinct value of a document once (``doc_id`` is unique)."""
    return _over(documents, doc_id, text, _find, "doc_id long, pii_type string, pii_value string", model)


def redact(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Path = MODEL) -> DataFrame:
    """``doc_id, text, n_replaced``: one row a document, whether or not anything was replaced."""
    return _over(documents, doc_id, text, _redact, "doc_id long, text string, n_replaced int", model)
