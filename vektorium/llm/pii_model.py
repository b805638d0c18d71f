"""A character-level bidirectional LSTM, with a CRF over BIO labels on top, in numpy only.

``Net`` holds the weights of one network: an embedding of characters, an LSTM each way and a linear
layer. ``Tagger`` is two of them: ``scan``, a small one with one output a character (is it part of an
instance?), and ``tag``, the large one whose outputs are the scores of BIO labels that the CRF decodes.
``Trainer`` fits a net by back-propagation through time, with the CRF's forward-backward sums or a
logistic loss, and Adam.

A net may read ``stride`` characters a step; the small one does, as it needn't place an instance's ends.
Inference keeps the batch in the last axis, so that every step is one matrix product over
(state, embedding, 1) and a few passes over contiguous rows; a sigmoid is a tanh at half its argument.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

TYPES = ("email", "phone", "id_number", "address", "name")
LABELS = ("O", *(f"{p}-{t}" for t in TYPES for p in "BI"))
N_LABELS = len(LABELS)

#: Character ids: 0 padding, 1-95 printable ASCII, then tab/line ends, other controls, and kinds of characters beyond ASCII.
TAB, CONTROL, UPPER, LOWER, OTHER, DIGIT, SPACE, BROKEN = range(96, 104)
N_CHARS = 104
_ASCII = np.array([TAB if c in (9, 10, 13) else CONTROL if c < 32 or c == 127 else c - 31 for c in range(128)], np.int16)


def _kind(c: int) -> int:
    ch = chr(c)
    return UPPER if ch.isupper() else LOWER if ch.isalpha() else DIGIT if ch.isdigit() else SPACE if ch.isspace() else BROKEN if c == 0xFFFD else OTHER


def ids_of(code: np.ndarray) -> np.ndarray:
    """Character ids of code points."""
    low = code < 128
    ids = _ASCII[np.where(low, code, 0)]
    beyond = np.flatnonzero(~low)
    if len(beyond):
        values, where = np.unique(code[beyond], return_inverse=True)
        ids[beyond] = np.array([_kind(int(c)) for c in values], np.int16)[where]
    return ids


def char_ids(text: str) -> np.ndarray:
    """The ids of a text's characters."""
    return ids_of(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))


def _allowed() -> np.ndarray:
    """Log transition mask: I-x follows only B-x or I-x."""
    m = np.zeros((N_LABELS, N_LABELS), np.float32)
    for j, to in enumerate(LABELS):
        if to[0] == "I":
            for i, fro in enumerate(LABELS):
                if fro[1:] != to[1:]:
                    m[i, j] = -1e4
    return m


ALLOWED = _allowed()
START = np.array([-1e4 if x[0] == "I" else 0.0 for x in LABELS], np.float32)


class Net:
    """Weights and scores of one bidirectional LSTM."""

    NAMES = ("E", "Xf", "bf", "Uf", "Xb", "bb", "Ub", "Wo", "bo", "A")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.ascontiguousarray(weights[k], np.float32) for k in self.NAMES}
        self.hidden, self.width, self.outputs = self.w["Uf"].shape[0], self.w["E"].shape[1], self.w["Wo"].shape[1]
        self.stride = self.w["Xf"].shape[0] // self.width

    @classmethod
    def fresh(cls, hidden: int, width: int, outputs: int, seed: int, stride: int = 1) -> Net:
        r = np.random.default_rng(seed)
        n = lambda *s, scale: r.normal(0, scale, s).astype(np.float32)
        h4 = 4 * hidden
        w = {"E": n(N_CHARS, width, scale=1.0), "Wo": n(2 * hidden, outputs, scale=0.1), "bo": np.zeros(outputs, np.float32), "A": np.zeros((outputs, outputs), np.float32)}
        for way in "fb":
            w |= {f"X{way}": n(stride * width, h4, scale=0.3 * (stride * width) ** -0.5), f"U{way}": n(hidden, h4, scale=hidden**-0.5), f"b{way}": np.zeros(h4, np.float32)}
            w[f"b{way}"][hidden : 2 * hidden] = 1.0  # forget gates start open
        return cls(w)

    def _steps(self, ids: np.ndarray) -> np.ndarray:
        """Ids (T, B) as steps of ``stride`` characters (S, stride, B), padded with 0."""
        t, b = ids.shape
        more = -t % self.stride
        return np.concatenate([ids, np.zeros((more, b), ids.dtype)]).reshape(-1, self.stride, b) if more else ids.reshape(-1, self.stride, b)

    def _run(self, steps: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """Hidden states (S, B, H) of one direction over steps (S, stride, B), and what the way back needs; padding keeps the state at zero."""
        t, _, b = steps.shape
        hid, wid = self.hidden, self.width
        scale = np.full(4 * hid, 0.5, np.float32)
        scale[2 * hid : 3 * hid] = 1.0
        x = self.w[f"X{way}"]
        tables, rec = [self.w["E"] @ (x[j * wid : (j + 1) * wid] * scale) for j in range(self.stride)], self.w[f"U{way}"] * scale
        tables[0] = tables[0] + self.w[f"b{way}"] * scale
        h, c = np.zeros((b, hid), np.float32), np.zeros((b, hid), np.float32)
        out, cache = np.zeros((t, b, hid), np.float32), []
        real = (steps[:, 0] > 0).astype(np.float32)[:, :, None]
        for k in range(t):
            z = h @ rec
            for j, table in enumerate(tables):
                z += table[steps[k, j]]
            np.tanh(z, out=z)
            g = z[:, 2 * hid : 3 * hid].copy()
            z *= np.float32(0.5)
            z += np.float32(0.5)
            i, f, o = z[:, :hid], z[:, hid : 2 * hid], z[:, 3 * hid :]
            nc = (f * c + i * g) * real[k]
            th = np.tanh(nc)
            cache.append((h, c, i, f, g, o, th))
            c = nc
            h = out[k]
            np.multiply(th, o, out=h)
        return out, cache

    def emissions(self, ids: np.ndarray):
        """Outputs (S, B, L) of windows (T, B), padded with 0 at the end, with what training needs."""
        steps = self._steps(ids)
        f, cf = self._run(steps, "f")
        r, cb = self._run(steps[::-1], "b")
        r = r[::-1]
        hid = self.hidden
        return f @ self.w["Wo"][:hid] + r @ self.w["Wo"][hid:] + self.w["bo"], f, r, cf, cb

    def score(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Outputs (S, L, B) for windows (T, B) sorted by length, longest first: a step takes only those that reach it."""
        steps = self._steps(ids)
        t, stride, b = steps.shape
        hid, wid, n_out = self.hidden, self.width * stride, self.outputs
        live = np.searchsorted(-lengths, -np.arange(0, t * stride, stride), side="left")
        scale = np.full((4 * hid, 1), 0.5, np.float32)
        scale[2 * hid : 3 * hid] = 1.0
        s = np.empty((t, n_out, b), np.float32)
        s[:] = self.w["bo"][:, None]
        half = np.float32(0.5)
        embed = np.ascontiguousarray(self.w["E"].T)
        z_all, p_all, e_all = np.empty((4 * hid, b), np.float32), np.empty((n_out, b), np.float32), np.empty((self.width, b), np.float32)
        for way, part, order in (("f", self.w["Wo"][:hid], range(t)), ("b", self.w["Wo"][hid:], range(t - 1, -1, -1))):
            mat = np.ascontiguousarray(np.concatenate([self.w[f"U{way}"], self.w[f"X{way}"], self.w[f"b{way}"][None]]).T * scale)
            wo = np.ascontiguousarray(part.T)
            state, c_all = np.zeros((hid + wid + 1, b), np.float32), np.zeros((hid, b), np.float32)
            state[-1] = 1
            for k in order:
                n = live[k]
                z, p, e, c, h = z_all[:, :n], p_all[:, :n], e_all[:, :n], c_all[:, :n], state[:hid, :n]
                for j in range(stride):
                    np.take(embed, steps[k, j, :n], axis=1, out=e, mode="clip")
                    state[hid + j * self.width : hid + (j + 1) * self.width, :n] = e
                np.matmul(mat, state[:, :n], out=z)
                np.tanh(z, out=z)
                g = z[2 * hid : 3 * hid]
                for gate in (z[: 2 * hid], z[3 * hid :]):
                    gate *= half
                    gate += half
                c *= z[hid : 2 * hid]
                g *= z[:hid]
                c += g
                np.tanh(c, out=h)
                h *= z[3 * hid :]
                np.matmul(wo, h, out=p)
                s[k, :, :n] += p
        return s

    @property
    def transitions(self) -> np.ndarray:
        return self.w["A"] + ALLOWED

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best label sequences (T, B) of scores (T, L, B) by Viterbi, windows sorted by length, longest first; 0 behind an end."""
        t, n, b = scores.shape
        live = np.searchsorted(-lengths, -np.arange(t + 1), side="left")
        a = self.transitions
        best = np.empty((t, n, b), np.float32)
        best[0] = START[:, None] + scores[0]
        # O and B-x may follow every label, I-x only B-x and I-x (labels are O, B-x, I-x, B-y, I-y, ...)
        starts = np.array([0, *range(1, n, 2)])
        into = np.ascontiguousarray(a[:, starts])[:, :, None]
        go, stay = a[np.arange(1, n, 2), np.arange(2, n, 2)][:, None], a[np.arange(2, n, 2), np.arange(2, n, 2)][:, None]
        for k in range(1, t):
            m = live[k]
            was, now = best[k - 1, :, :m], best[k, :, :m]
            top = was[0] + into[0]
            for i in range(1, n):
                np.maximum(top, was[i] + into[i], out=top)
            now[starts] = top
            now[2::2] = np.maximum(was[1::2] + go, was[2::2] + stay)
            now += scores[k, :, :m]
        out = np.zeros((t, b), np.int8)
        cur = np.zeros(b, np.int64)
        for k in range(t - 1, -1, -1):
            m, on = live[k], live[k + 1]
            cur[:on] = (best[k, :, :on] + a[:, cur[:on]]).argmax(0)
            cur[on:m] = best[k, :, on:m].argmax(0)
            out[k, :m] = cur[:m]
        return out


class Tagger:
    """The small net that reads everything, the large one that labels, and the small one's threshold."""

    def __init__(self, scan: Net, tag: Net, threshold: float):
        self.scan, self.tag, self.threshold = scan, tag, threshold

    @classmethod
    def load(cls, path) -> Tagger:
        with np.load(path) as z:
            part = lambda p: Net({k: z[f"{p}_{k}"] for k in Net.NAMES})
            return cls(part("scan"), part("tag"), float(z["threshold"]))

    def save(self, path) -> None:
        np.savez_compressed(path, threshold=np.float32(self.threshold), **{f"{p}_{k}": v.astype(np.float16) for p, net in (("scan", self.scan), ("tag", self.tag)) for k, v in net.w.items()})


def spans_of(labels: Sequence[int]) -> list[tuple[int, int, str]]:
    """(first, last, type) of each labelled stretch."""
    out, start, kind = [], -1, ""
    for i, x in enumerate([*labels, 0]):
        lab = LABELS[x]
        if start >= 0 and (lab[0] != "I" or lab[2:] != kind):
            out.append((start, i, kind))
            start = -1
        if lab[0] == "B":
            start, kind = i, lab[2:]
    return out


def labels_of(n: int, spans: Sequence[tuple[int, int, str]]) -> np.ndarray:
    y = np.zeros(n, np.int8)
    for a, b, kind in spans:
        y[a:b] = LABELS.index(f"I-{kind}")
        y[a] = LABELS.index(f"B-{kind}")
    return y


class Trainer:
    """Adam on the CRF's negative log likelihood, or, for a net of one output, on the logistic loss."""

    def __init__(self, net: Net, rate: float = 4e-3):
        self.t, self.rate, self.step = net, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.w.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.w.items()}

    def _logistic(self, s: np.ndarray, y: np.ndarray, lengths: np.ndarray, weight: float = 3.0) -> tuple[float, np.ndarray]:
        """Mean loss and its gradient; characters of an instance count ``weight`` times."""
        live = (np.arange(len(s))[:, None] < lengths).astype(np.float32)
        z, target = s[:, :, 0], (y > 0).astype(np.float32)
        w = live * (1 + (weight - 1) * target)
        p = 0.5 + 0.5 * np.tanh(0.5 * z)
        loss = (w * (np.logaddexp(0, z) - target * z)).sum()
        return float(loss / lengths.sum()), ((p - target) * w / lengths.sum())[:, :, None].astype(np.float32)

    def _crf(self, s: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean loss, and its gradient by scores and transitions."""
        t, b, n = s.shape
        a = self.t.transitions.astype(np.float64)
        s = s.astype(np.float64)
        live = np.arange(t)[:, None] < lengths
        expa = np.exp(a)
        alpha, beta = np.empty((t, b, n)), np.zeros((t, b, n))
        alpha[0] = START + s[0]
        for k in range(1, t):
            m = alpha[k - 1].max(1, keepdims=True)
            nxt = np.log(np.maximum(np.exp(alpha[k - 1] - m) @ expa, 1e-300)) + m + s[k]
            alpha[k] = np.where(live[k][:, None], nxt, alpha[k - 1])
        m = alpha[-1].max(1, keepdims=True)
        z = (np.log(np.exp(alpha[-1] - m).sum(1, keepdims=True)) + m)[:, 0]
        for k in range(t - 2, -1, -1):
            q = beta[k + 1] + s[k + 1]
            m = q.max(1, keepdims=True)
            nxt = np.log(np.maximum(np.exp(q - m) @ expa.T, 1e-300)) + m
            beta[k] = np.where(live[k + 1][:, None], nxt, 0.0)
        gs = np.exp(alpha + beta - z[None, :, None]) * live[:, :, None]
        # expected transitions of all steps in one product
        x, q = alpha[:-1][live[1:]], (beta[1:] + s[1:])[live[1:]]
        mx = x.max(1, keepdims=True)
        ga = (np.exp(x - mx).T @ np.exp(q + mx - np.broadcast_to(z, (t - 1, b))[live[1:]][:, None])) * expa
        rows, cols = np.nonzero(live)
        gold = np.bincount(cols, s[rows, cols, y[rows, cols]], b) + START[y[0]]
        np.subtract.at(gs, (rows, cols, y[rows, cols]), 1.0)
        fro, to = y[:-1][live[1:]], y[1:][live[1:]]
        gold += np.bincount(np.nonzero(live[1:])[1], a[fro, to], b)
        np.subtract.at(ga, (fro, to), 1.0)
        total = lengths.sum()
        return float((z - gold).sum() / total), (gs / total).astype(np.float32), (ga / total).astype(np.float32)

    def _back(self, steps: np.ndarray, cache: list, dh_all: np.ndarray, way: str) -> dict[str, np.ndarray]:
        t, _, b = steps.shape
        hid, wid, w = self.t.hidden, self.t.width, self.t.w
        rec_t = np.ascontiguousarray(w[f"U{way}"].T)
        dz_all, h_all = np.empty((t, b, 4 * hid), np.float32), np.empty((t, b, hid), np.float32)
        dh, dc = np.zeros((b, hid), np.float32), np.zeros((b, hid), np.float32)
        real = (steps[:, 0] > 0).astype(np.float32)[:, :, None]
        for k in range(t - 1, -1, -1):
            h0, c0, i, f, g, o, th = cache[k]
            dh = dh + dh_all[k]
            dct = (dc + dh * o * (1 - th * th)) * real[k]
            dz = dz_all[k]
            dz[:, :hid] = dct * g * i * (1 - i)
            dz[:, hid : 2 * hid] = dct * c0 * f * (1 - f)
            dz[:, 2 * hid : 3 * hid] = dct * i * (1 - g * g)
            dz[:, 3 * hid :] = dh * th * o * (1 - o) * real[k]
            h_all[k] = h0
            dh = dz @ rec_t
            dc = dct * f
        flat = dz_all.reshape(-1, 4 * hid)
        x, grad_x, grad_e = w[f"X{way}"], [], np.zeros_like(w["E"])
        for j in range(self.t.stride):
            seen = steps[:, j].ravel()
            order = np.argsort(seen, kind="stable")
            first = np.flatnonzero(np.diff(seen[order], prepend=-1))
            table = np.zeros((N_CHARS, 4 * hid), np.float32)  # the gradient by the input of each character
            table[seen[order][first]] = np.add.reduceat(flat[order], first, axis=0)
            grad_x.append(w["E"].T @ table)
            grad_e += table @ x[j * wid : (j + 1) * wid].T
        return {f"U{way}": h_all.reshape(-1, hid).T @ flat, f"X{way}": np.concatenate(grad_x), f"b{way}": flat.sum(0), "E": grad_e}

    def fit(self, ids: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> float:
        """One step on windows (T, B); the loss a character."""
        s, f, r, cf, cb = self.t.emissions(ids)
        steps = self.t._steps(ids)
        if self.t.stride > 1:  # a step is part of an instance if one of its characters is
            y, lengths = self.t._steps(y).max(1), -(-lengths // self.t.stride)
        ga = np.zeros_like(self.t.w["A"])
        if self.t.outputs == 1:
            loss, gs = self._logistic(s, y, lengths)
        else:
            loss, gs, ga = self._crf(s, y, lengths)
        hid, w = self.t.hidden, self.t.w
        flat = gs.reshape(-1, self.t.outputs)
        both = np.concatenate([f, r], 2).reshape(-1, 2 * hid)
        dh = gs @ w["Wo"].T
        g = {"Wo": both.T @ flat, "bo": flat.sum(0), "A": ga}
        forth, back = self._back(steps, cf, dh[:, :, :hid], "f"), self._back(steps[::-1], cb, dh[::-1, :, hid:], "b")
        g |= forth | back | {"E": forth["E"] + back["E"]}
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        clip = min(1.0, 1.0 / (norm + 1e-9))
        self.step += 1
        for k, x in g.items():
            x = x * clip
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.01 * (x * x - self.v[k])
            w[k] -= self.rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.99**self.step)) + 1e-8)
        return loss
