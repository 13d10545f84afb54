"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, state across windows.

A word's probability is that of its class times that within the class. Classes are runs of the words by falling
frequency and hold equal shares of the sum of the frequencies' roots, which gives frequent words small classes and the
least work for a token. Biases start at the unigram frequencies, so an untrained model is the unigram model.
"""

from __future__ import annotations

import heapq

import numpy as np

NAMES = ("embed", "wx", "bx", "u", "wc", "wo")

#: Logits stay within this, so that their exponentials and sums fit single precision.
LARGEST = 70.0


def _runs(x: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values (below top), where each begins in the sorted order, and that order."""
    order = np.argsort(x.astype(np.uint16) if top <= 1 << 16 else x, kind="stable")
    by = x[order]
    starts = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
    return by[starts], starts, order


def _softmax(h1: np.ndarray, w: np.ndarray, at: np.ndarray, clipped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of logits h1 @ w: log probability of column at of each row, the exponentials, and their sums."""
    s = h1 @ w
    if clipped:
        np.clip(s, -LARGEST, LARGEST, out=s)
    own = s[np.arange(len(at)), at]
    np.exp(s, out=s)
    total = s @ np.ones(s.shape[1], s.dtype)
    return own - np.log(total), s, total


class Gru:
    def __init__(self, counts: np.ndarray, hidden: int = 24, seed: int = 5):
        """counts: of each word number; none may be below 1."""
        v, h = len(counts), hidden
        order = np.argsort(-counts, kind="stable")
        share = counts[order] / counts.sum()
        root = np.cumsum(np.sqrt(share))
        wanted = max(2, round(0.6 * v**0.5))
        step = np.minimum(wanted - 1, ((root - np.sqrt(share) / 2) / root[-1] * wanted).astype(int))
        self.cls = np.concatenate([[0], np.cumsum(step[1:] != step[:-1])]).astype(np.int32)  # of each slot, by falling count
        self.edges = np.concatenate([np.flatnonzero(np.diff(self.cls, prepend=-1)), [v]])
        self.slot = np.empty(v, np.int32)
        self.slot[order] = np.arange(v, dtype=np.int32)
        self.classes, self.hidden, self.words = len(self.edges) - 1, h, v
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        mass = np.add.reduceat(share, self.edges[:-1])
        wc, wo = np.zeros((h + 1, self.classes), np.float32), np.zeros((v, h + 1), np.float32)  # the last of h + 1 is the bias
        wc[h], wo[:, h] = np.log(mass), np.log(share / mass[self.cls])
        self.p = {"embed": draw(v, h), "wx": draw(h, 3 * h) * 3, "bx": np.zeros(3 * h, np.float32), "u": draw(h, 3 * h) * 2, "wc": wc, "wo": wo}

    def pack(self) -> bytes:
        return np.concatenate([self.p[k].ravel() for k in NAMES]).astype(np.float32).tobytes()

    def unpack(self, flat: np.ndarray) -> "Gru":
        at = 0
        for k in NAMES:
            n = self.p[k].size
            self.p[k] = flat[at : at + n].astype(np.float32).reshape(self.p[k].shape)
            at += n
        self.__dict__.pop("_table", None)
        return self

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """x: the input's sums for candidate, update and reset gate. New state, and what backpropagation needs."""
        n = self.hidden
        s = h @ self.p["u"]
        zr = s[:, : 2 * n] + x[:, n:]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r, u = zr[:, :n], zr[:, n:], s[:, 2 * n :]
        c = r * u
        c += x[:, :n]
        np.tanh(c, out=c)
        out = h - c
        out *= z
        out += c
        return out, z, r, u, c

    def outputs(self, h: np.ndarray, y: np.ndarray, grad: bool = False):
        """Natural log probability of each target y after state h; with grad, also the gradients of their negated sum."""
        n, wc, wo = self.hidden, self.p["wc"], self.p["wo"]
        slot = self.slot[y]
        order = np.argsort(slot.astype(np.uint16) if self.words <= 1 << 16 else slot, kind="stable")
        slot = slot[order]
        cls = self.cls[slot]
        h1 = np.ones((len(h), n + 1), h.dtype)
        h1[:, :n] = h[order]
        clipped = max(np.abs(wc).sum(0).max(), np.abs(wo).sum(1).max()) > LARGEST  # states are within 1
        log, s, total = _softmax(h1, wc, cls, clipped)
        if grad:
            # less the total at the target, all by the total: the narrow factors are divided, not the logits
            s[np.arange(len(cls)), cls] -= total
            g = {"wc": (h1 / total[:, None]).T @ s, "wo": np.zeros(wo.shape, h.dtype)}
            dh = s @ wc[:n].T
            dh /= total[:, None]
        ends = np.searchsorted(cls, np.arange(self.classes + 1))
        for c in np.flatnonzero((np.diff(ends) > 0) & (np.diff(self.edges) > 1)):
            a, b, low, high = ends[c], ends[c + 1], self.edges[c], self.edges[c + 1]
            k = slot[a:b] - low
            part, s, total = _softmax(h1[a:b], wo[low:high].T, k, clipped)
            log[a:b] += part
            if grad:
                s[np.arange(len(k)), k] -= total
                np.matmul(s.T, h1[a:b] / total[:, None], out=g["wo"][low:high])
                back = s @ wo[low:high, :n]
                back /= total[:, None]
                dh[a:b] += back
        out = np.empty_like(log)
        out[order] = log
        if not grad:
            return out
        back = np.empty_like(dh)
        back[order] = dh
        return out, g, back

    def gradients(self, x_id: np.ndarray, y_id: np.ndarray, h: np.ndarray, end: int) -> tuple[dict, np.ndarray]:
        """Gradients of the negated log probability of targets y_id (steps x lanes) after inputs x_id, from states h on, and
        the last states. A state is forgotten before an input end. Of embed: (words, rows)."""
        p, n, (steps, lanes) = self.p, self.hidden, x_id.shape
        kind = p["u"].dtype
        e = p["embed"][x_id.ravel()]
        x = (e @ p["wx"] + p["bx"]).reshape(steps, lanes, 3 * n)
        before, states = np.empty((steps, lanes, n), kind), np.empty((steps, lanes, n), kind)
        z, r, u, c = np.empty((4, steps, lanes, n), kind)
        cut = [np.flatnonzero(x_id[t] == end) for t in range(steps)]
        for t in range(steps):
            before[t] = h
            before[t][cut[t]] = 0
            h, z[t], r[t], u[t], c[t] = self.step(x[t], before[t])
            states[t] = h
        _, g, dh_out = self.outputs(states.reshape(-1, n), y_id.ravel(), grad=True)
        dh_out = dh_out.reshape(steps, lanes, n)
        # factors of the state's gradient: to the candidate, to the update gate; of the candidate's: to the reset gate
        by_c = 1 - c * c
        by_c -= z * by_c
        by_z = (before - c) * z
        by_z -= z * by_z
        u *= r
        u -= r * u
        d = np.empty((steps, lanes, 4 * n), kind)  # candidate, update, reset, and candidate by way of u
        dh, into = np.zeros((lanes, n), kind), np.ascontiguousarray(p["u"].T)
        for t in range(steps - 1, -1, -1):
            dh += dh_out[t]
            at = d[t]
            dc = np.multiply(dh, by_c[t], out=at[:, :n])
            np.multiply(dh, by_z[t], out=at[:, n : 2 * n])
            np.multiply(dc, u[t], out=at[:, 2 * n : 3 * n])
            np.multiply(dc, r[t], out=at[:, 3 * n :])
            dh *= z[t]
            dh += at[:, n:] @ into
            dh[cut[t]] = 0
        flat = d.reshape(-1, 4 * n)
        dx = flat[:, : 3 * n]
        ids, starts, order = _runs(x_id.ravel(), self.words)
        return {
            "wx": e.T @ dx, "bx": np.ones(len(dx), kind) @ dx, "u": before.reshape(-1, n).T @ flat[:, n:], **g,
            "embed": (ids, np.add.reduceat((dx @ p["wx"].T)[order], starts)),
        }, h

    def train(self, stream: np.ndarray, end: int, lanes: int = 512, window: int = 16, rate: float = 0.1, clip: float = 5.0, warm: int = 8) -> int:
        """One pass over a stream of documents, each closed by end: lanes side by side, windows of steps, Adagrad whose
        rate rises over the first warm windows, so that a short stream moves the model little. Its sums of squares go
        on in the next call. The last lane is filled with ends; short streams have fewer lanes."""
        if not len(stream):
            return 0
        lanes = max(1, min(lanes, len(stream) // window))
        per = -(-len(stream) // lanes)
        body = np.concatenate([stream, np.full(lanes * per - len(stream), end, stream.dtype)]).reshape(lanes, per).T
        inputs = np.concatenate([np.full((1, lanes), end, body.dtype), body[:-1]])
        h = np.zeros((lanes, self.hidden), np.float32)
        if not hasattr(self, "_squares"):
            self._squares, self._windows = {k: np.full(v.shape, 1e-6, np.float32) for k, v in self.p.items()}, 0
        for a in range(0, per, window):
            grads, h = self.gradients(inputs[a : a + window], body[a : a + window], h, end)
            scale, pace = np.float32(1 / lanes), np.float32(rate * min(1.0, (self._windows + 1) / warm))
            for k, v in grads.items():
                at, v = v if k == "embed" else (slice(None), v)
                v *= scale
                np.clip(v, -clip, clip, out=v)
                squares = self._squares[k][at]
                squares += v * v
                if k == "embed":
                    self._squares[k][at] = squares
                v *= pace
                v /= np.sqrt(squares)
                self.p[k][at] -= v
            self._windows += 1
        self.__dict__.pop("_table", None)
        return len(stream)

    def score(self, docs: list[np.ndarray], end: int, lanes: int = 512, window: int = 64) -> np.ndarray:
        """Natural log probability of each document (word numbers, the last is end). State runs through a document
        across windows and is reset at its start; documents are laid end to end over lanes by length. Lanes fall away
        as they end, so memory is in proportion to the tokens, however unlike the lengths are."""
        if not docs:
            return np.zeros(0)
        if not hasattr(self, "_table"):
            self._table = self.p["embed"] @ self.p["wx"] + self.p["bx"]
        lanes = max(1, min(lanes, len(docs)))
        heap, held = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
        for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
            load, k = heapq.heappop(heap)
            held[k].append(i)
            heapq.heappush(heap, (load + len(docs[i]), k))
        held = [held[k] for _, k in sorted(heap, reverse=True)]  # the longest lanes first
        loads = np.array([sum(len(docs[i]) for i in ids) for ids in held])
        begins = np.concatenate([[0], np.cumsum(loads)])
        flat = np.concatenate([docs[i] for ids in held for i in ids])
        log = np.empty(len(flat), np.float32)
        h = np.zeros((lanes, self.hidden), np.float32)
        last = np.full(lanes, end, flat.dtype)
        waiting, tokens = [], 0  # windows of few lanes are put together before their outputs, whose work begins at a class

        def said() -> None:
            at, states, y = (np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*waiting))
            log[at] = self.outputs(states, y)
            waiting.clear()

        for a in range(0, int(loads[0]), window):
            live = int(np.searchsorted(-loads, -a, side="left"))
            at = begins[:live] + a + np.arange(min(window, int(loads[0]) - a))[:, None]
            there = at < begins[1 : live + 1]
            y = np.where(there, flat[np.minimum(at, len(flat) - 1)], end)
            x = np.concatenate([last[None, :live], y[:-1]])
            h, last = h[:live], y[-1]
            states = np.empty((len(y), live, self.hidden), np.float32)
            begun = x == end
            resets = begun.any(1).tolist()
            few = self._table[x] if live * 8 <= lanes else None  # at once where a step is little work
            for t in range(len(y)):
                if resets[t]:
                    h[begun[t]] = 0
                h = states[t] = self.step(self._table[x[t]] if few is None else few[t], h)[0]
            n = int(there.sum())
            if waiting and tokens + n > window * lanes:
                said()
                tokens = 0
            waiting.append((at[there], states[there], y[there]))
            tokens += n
        said()
        order = [i for ids in held for i in ids]
        starts = np.cumsum([0, *(len(docs[i]) for i in order[:-1])])
        out = np.empty(len(docs))
        out[order] = np.add.reduceat(log.astype(np.float64), starts)
        return out
