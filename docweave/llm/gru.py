"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, carried state."""

from __future__ import annotations

import heapq

import numpy as np

#: Hidden units, output classes (the last is for all other words), input rows for other words, steps of a training window, training lanes, step size.
HIDDEN, CLASSES, OTHERS, WINDOW, LANES, RATE = 16, 32, 128, 16, 512, 0.08


class Vocabulary:
    """The model's words in order of frequency, and their classes of about equal square-root mass.

    hashes, counts: words by falling count. A word of the model has its place as id; others share one output
    class and OTHERS input rows; one more input row stands for a text's beginning."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.n = len(hashes)
        mass = np.cumsum(np.sqrt(counts.astype(np.float64)))
        self.cls = np.append(np.minimum((mass - mass[0]) / max(mass[-1], 1e-9) * (CLASSES - 1), CLASSES - 2).astype(np.int64), CLASSES - 1) if self.n else np.array([CLASSES - 1])
        self.edges = np.searchsorted(self.cls, np.arange(CLASSES + 1))  # words of class k are edges[k]:edges[k + 1]
        self.begin = self.n + OTHERS
        self.rows = self.n + OTHERS + 1

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output ids (n: another word) and input rows."""
        at = np.minimum(np.searchsorted(self.sorted, h), max(self.n - 1, 0))
        known = self.sorted[at] == h if self.n else np.zeros(len(h), bool)
        out = np.where(known, self.order[at] if self.n else 0, self.n)
        return out, np.where(known, out, self.n + (h % np.uint64(OTHERS)).astype(np.int64))


def _spread(rows: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and the sums of their gradients."""
    order = np.argsort(rows, kind="stable")
    sorted_ = rows[order]
    first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    return sorted_[first], np.add.reduceat(grad[order], first)


class Model:
    NAMES = ("inp", "rec", "mid", "cls", "cls_b", "out", "out_b")

    def __init__(self, words: Vocabulary, seed: int = 3):
        rng, h = np.random.default_rng(seed), HIDDEN
        normal = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.words = words
        self.inp, self.rec, self.mid = normal(words.rows, 3 * h), normal(h, 2 * h), normal(h, h)
        self.cls, self.cls_b = normal(h, CLASSES), np.zeros(CLASSES, np.float32)
        self.out, self.out_b = normal(words.n + 1, h), np.zeros(words.n + 1, np.float32)
        self.inp[:, :h] -= 1  # at first, keep most of the state
        self.past = {k: np.full_like(getattr(self, k), 1e-4) for k in self.NAMES}

    def packed(self) -> bytes:
        return b"".join(getattr(self, k).tobytes() for k in self.NAMES)

    def load(self, packed: bytes) -> Model:
        at = 0
        for k in self.NAMES:
            a = getattr(self, k)
            setattr(self, k, np.frombuffer(packed, np.float32, a.size, at).reshape(a.shape).copy())
            at += 4 * a.size
        return self

    def gates(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Update and reset gates, candidate, next state."""
        g = x[:, : 2 * HIDDEN] + h @ self.rec
        np.negative(g, out=g)
        np.exp(g, out=g)
        g += 1
        np.reciprocal(g, out=g)
        z, r = g[:, :HIDDEN], g[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN :] + (r * h) @ self.mid)
        return z, r, c, h + z * (c - h)

    def _classes(self, h: np.ndarray) -> np.ndarray:
        logit = h @ self.cls + self.cls_b
        logit -= logit.max(1, keepdims=True)
        np.exp(logit, out=logit)
        logit /= logit.sum(1, keepdims=True)
        return logit

    def _groups(self, target: np.ndarray):
        """(first word, end, rows) of each class with several words that there is."""
        k = self.words.cls[target]
        order = np.argsort(k, kind="stable")
        edge = np.searchsorted(k[order], np.arange(CLASSES + 1))
        for c in range(CLASSES - 1):
            a, b = self.words.edges[c], self.words.edges[c + 1]
            if edge[c] < edge[c + 1] and b - a > 1:
                yield a, b, order[edge[c] : edge[c + 1]]

    def _within(self, h: np.ndarray, a: int, b: int) -> np.ndarray:
        logit = h @ self.out[a:b].T + self.out_b[a:b]
        logit -= logit.max(1, keepdims=True)
        np.exp(logit, out=logit)
        logit /= logit.sum(1, keepdims=True)
        return logit

    def log10(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log10 of each target's probability after the state; for another word, that of its class."""
        n = np.arange(len(target))
        out = np.log10(np.maximum(self._classes(h)[n, self.words.cls[target]], 1e-30)).astype(np.float64)
        for a, b, rows in self._groups(target):
            out[rows] += np.log10(np.maximum(self._within(h[rows], a, b)[np.arange(len(rows)), target[rows] - a], 1e-30))
        return out

    def _move(self, name: str, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        """A step against the gradient, shorter where gradients have been large."""
        value, past = getattr(self, name), self.past[name]
        at = slice(None) if rows is None else rows
        past[at] += grad * grad
        value[at] -= RATE * grad / np.sqrt(past[at])

    def train(self, inp: np.ndarray, target: np.ndarray, begins: np.ndarray) -> None:
        """One pass over texts set end to end: input rows, target ids, and where texts begin. The stream is cut into lanes that advance together; the first ones have a token more where the lanes don't divide it, which is a window of its own."""
        lanes = max(1, min(LANES, len(target) // WINDOW))
        steps, more = divmod(len(target), lanes)
        start = np.arange(lanes) * steps + np.minimum(np.arange(lanes), more)
        h = np.zeros((lanes, HIDDEN), np.float32)
        for t in range(0, steps, WINDOW):
            at = start + np.arange(t, min(t + WINDOW, steps))[:, None]
            h = self._window(inp[at], target[at], begins[at], h)
        if more:
            at = start[None, :more] + steps
            self._window(inp[at], target[at], begins[at], h[:more], lanes)

    def _window(self, inp: np.ndarray, target: np.ndarray, begins: np.ndarray, h: np.ndarray, of: int | None = None) -> np.ndarray:
        """A step over the lanes' next tokens, and their states after it; each token weighs as one of `of` lanes."""
        steps, lanes = inp.shape
        x = self.inp[inp]
        kept = []
        states = np.empty((steps, lanes, HIDDEN), np.float32)
        for t in range(steps):
            h = h * ~begins[t][:, None]
            z, r, c, new = self.gates(x[t], h)
            kept.append((h, z, r, c))
            states[t] = h = new
        # outputs
        flat, goal = states.reshape(-1, HIDDEN), target.ravel()
        d_cls = self._classes(flat)
        d_cls[np.arange(len(goal)), self.words.cls[goal]] -= 1
        d_flat = d_cls @ self.cls.T
        d_out, d_out_b = np.zeros_like(self.out), np.zeros_like(self.out_b)
        for a, b, rows in self._groups(goal):
            d = self._within(flat[rows], a, b)
            d[np.arange(len(rows)), goal[rows] - a] -= 1
            d_out[a:b], d_out_b[a:b] = d.T @ flat[rows], d.sum(0)
            d_flat[rows] += d @ self.out[a:b]
        scale = np.float32(1 / (of or lanes))
        # back through the window
        d_states, d_h = d_flat.reshape(states.shape), np.zeros((lanes, HIDDEN), np.float32)
        d_x, d_rec, d_mid = np.empty_like(x), np.zeros_like(self.rec), np.zeros_like(self.mid)
        for t in range(steps - 1, -1, -1):
            before, z, r, c = kept[t]
            d_new = d_states[t] + d_h
            d_c = d_new * z * (1 - c * c)
            d_gated = d_c @ self.mid.T
            d_g = np.hstack([d_new * (c - before) * z * (1 - z), d_gated * before * r * (1 - r)])
            d_x[t, :, : 2 * HIDDEN], d_x[t, :, 2 * HIDDEN :] = d_g, d_c
            d_mid += (r * before).T @ d_c
            d_rec += before.T @ d_g
            d_h = (d_new * (1 - z) + d_gated * r + d_g @ self.rec.T) * ~begins[t][:, None]
        rows, d_inp = _spread(inp.ravel(), d_x.reshape(-1, 3 * HIDDEN))
        self._move("inp", d_inp * scale, rows)
        for name, grad in (("rec", d_rec), ("mid", d_mid), ("cls", flat.T @ d_cls), ("cls_b", d_cls.sum(0)), ("out", d_out), ("out_b", d_out_b)):
            self._move(name, grad * scale)
        return h

    def score(self, inp: np.ndarray, target: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of every token; texts begin at `first`. Whole texts are dealt to lanes, and a text's state goes on to its end."""
        n = len(target)
        if not n:
            return np.zeros(0)
        length = np.diff(np.append(first, n))
        lanes = int(np.clip(n // length.max(), 8, 512))
        loads, texts = [(0, i) for i in range(lanes)], [[] for _ in range(lanes)]
        for k in np.argsort(-length, kind="stable"):
            load, i = heapq.heappop(loads)
            texts[i].append(k)
            heapq.heappush(loads, (load + int(length[k]), i))
        load = np.zeros(lanes, np.int64)
        for x, i in loads:
            load[i] = x
        order = np.argsort(-load, kind="stable")
        load = load[order]
        place = np.zeros((int(load[0]), lanes), np.int64)
        for column, i in enumerate(order):
            if texts[i]:
                place[: load[column], column] = np.concatenate([np.arange(first[k], first[k] + length[k]) for k in texts[i]])
        active = np.searchsorted(-load, -np.arange(load[0]), "left")
        begins = np.zeros(n, bool)
        begins[first] = True
        states, h = np.empty((n, HIDDEN), np.float32), np.zeros((lanes, HIDDEN), np.float32)
        for t, a in enumerate(active):
            now = place[t, :a]
            h = self.gates(self.inp[inp[now]], h[:a] * ~begins[now][:, None])[3]
            states[now] = h
        return np.concatenate([self.log10(states[i : i + 32768], target[i : i + 32768]) for i in range(0, n, 32768)])


def mean(packed: list[bytes], weight: list[float]) -> bytes:
    """Weighted mean of packed parameters."""
    total = np.zeros(len(packed[0]) // 4)
    for p, w in zip(packed, weight, strict=True):
        total += w * np.frombuffer(p, np.float32)
    return (total / sum(weight)).astype(np.float32).tobytes()
