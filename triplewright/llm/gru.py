"""A gated recurrent language model with class-factored output, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np

END, UNKNOWN = 0, 1
#: Updates of a pass, at least, before documents are taken more at a time.
STEPS = 256


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def lanes(docs: Iterable[np.ndarray], streams: int, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], list[int]]]:
    """Whole documents side by side, each in its own order: a lane takes the next one when its document has ended.

    Gives (tokens, numbers, stay, ended): a row per step and a column per lane, with -1 after the last document
    of a lane; the number of each token's document; which columns of the last window are the lanes of this one;
    and the documents that end in it.
    """
    waiting = enumerate(docs)
    held: list[list] = [[-1, np.zeros(0, dtype=np.int64), 0] for _ in range(streams)]
    while held:
        y, k = np.full((len(held), steps), -1), np.full((len(held), steps), -1)
        stay, ended, width = [], [], 0
        for lane, (number, doc, at) in enumerate(held):
            filled = 0
            while filled < steps:
                if at == len(doc):
                    number, doc = next(waiting, (-1, doc))
                    if number < 0:
                        break
                    at = 0
                take = min(len(doc) - at, steps - filled)
                row = len(stay)
                y[row, filled : filled + take] = doc[at : at + take]
                k[row, filled : filled + take] = number
                filled, at = filled + take, at + take
                if at == len(doc):
                    ended.append(number)
            if filled:
                held[len(stay)] = [number, doc, at]
                stay.append(lane)
                width = max(width, filled)
        del held[len(stay) :]
        if stay:
            yield y[: len(stay), :width].T, k[: len(stay), :width].T, stay, ended


class Gru:
    """Predicts each token from all before it.

    Token i is word ``i % per_class`` of class ``i // per_class``; its probability is that of the
    class times that of the word within the class. Ids go by falling count. The input layer is a
    table with the three gates' inputs for each token.
    """

    def __init__(self, counts: np.ndarray, hidden: int, per_class: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        tokens = -(-len(counts) // per_class) * per_class
        classes = tokens // per_class
        share = np.full(tokens, 1e-9)
        share[: len(counts)] = (counts + 1) / (counts.sum() + len(counts))
        share = share.reshape(classes, per_class)
        scale = 1 / np.sqrt(hidden)
        self.hidden, self.per_class = hidden, per_class
        self.p = {
            "input": rng.normal(0, 0.3, (tokens, 3 * hidden)),
            "state": rng.normal(0, scale, (hidden, 3 * hidden)),
            "class_w": rng.normal(0, 0.01, (hidden, classes)),
            "class_b": np.log(share.sum(axis=1)),
            "word_w": rng.normal(0, 0.01, (classes, per_class, hidden)),
            "word_b": np.log(share / share.sum(axis=1, keepdims=True)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def dump(self) -> bytes:
        return b"".join(v.tobytes() for v in self.p.values())

    def load(self, data: bytes) -> Gru:
        at = 0
        for k, v in self.p.items():
            self.p[k] = np.frombuffer(data, dtype=np.float32, count=v.size, offset=at).reshape(v.shape).copy()
            at += 4 * v.size
        return self

    def step(self, a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state from columns of the input table and the last state, and what going back needs.

        A state has a row per unit and a column per document, so that each gate lies in one piece.
        """
        n = self.hidden
        u = self.state_t @ h
        un = u[2 * n :]
        gates = _sigmoid(a[: 2 * n] + u[: 2 * n])
        z, r = gates[:n], gates[n:]
        c = r * un
        c += a[2 * n :]
        np.tanh(c, out=c)
        out = h - c
        out *= z
        out += c
        return out, z, r, un, c

    def _run(self, y: np.ndarray, h: np.ndarray, x: np.ndarray) -> tuple:
        """States after each input of a window: the last token of the one before, then all but its own last.

        The end of a document is the first input of the next one, whose state is zero.
        """
        self.state_t = np.ascontiguousarray(self.p["state"].T)
        inputs = np.concatenate([x[None], np.where(y >= 0, y, END)])
        table = np.ascontiguousarray(self.p["input"][inputs[:-1]].transpose(0, 2, 1))
        old, ends = (inputs[:-1] != END).astype(h.dtype), (inputs[:-1] == END).any(axis=1).tolist()
        states = np.empty((len(y) + 1, *h.shape), dtype=h.dtype)
        before, tape = np.empty_like(states[:-1]), []
        states[0] = h
        for t in range(len(y)):
            np.multiply(states[t], old[t] if ends[t] else 1, out=before[t])
            states[t + 1], *rest = self.step(table[t], before[t])
            tape.append(rest)
        return inputs, old, ends, before, states, tape

    @staticmethod
    def _at(states: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """The states at some places of a window, a column each."""
        return np.ascontiguousarray(states.transpose(0, 2, 1)[inside].T)

    def _by_class(self, y: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order of tokens by class, and (class, first, stop) of the classes that occur."""
        cls = (y // self.per_class).astype(np.int16)
        order = np.argsort(cls, kind="stable")
        edges = np.searchsorted(cls[order], np.arange(self.p["class_b"].size + 1)).tolist()
        return order, [(c, i, j) for c, (i, j) in enumerate(pairwise(edges)) if i < j]

    @staticmethod
    def _softmax(logit: np.ndarray) -> np.ndarray:
        np.exp(logit, out=logit)
        logit /= logit.sum(axis=0)
        return logit

    def _classes(self, h: np.ndarray) -> np.ndarray:
        return self._softmax(self.p["class_w"].T @ h + self.p["class_b"][:, None])

    def _words(self, c: int, h: np.ndarray) -> np.ndarray:
        return self._softmax(self.p["word_w"][c] @ h + self.p["word_b"][c][:, None])

    def log_probs(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The natural logarithm of the probability of each y after its state, a column of h."""
        order, groups = self._by_class(y)
        h, y = h[:, order], y[order]
        rows, cls, word = np.arange(len(y)), y // self.per_class, y % self.per_class
        p = self._classes(h)[cls, rows]
        for c, i, j in groups:
            p[i:j] *= self._words(c, h[:, i:j])[word[i:j], rows[: j - i]]
        out = np.empty(len(y))
        out[order] = np.log(np.maximum(p, np.finfo(p.dtype).tiny))
        return out

    def score(self, docs: Iterable[np.ndarray], window: int = 32, streams: int = 256) -> Iterator[tuple[int, float]]:
        """The number and natural log-likelihood of each token sequence, as they end; a state is carried from window to window."""
        total: dict[int, float] = {}
        h, x = np.zeros((self.hidden, streams), dtype=self.p["state"].dtype), np.full(streams, END)
        for y, k, stay, ended in lanes(docs, streams, window):
            inputs, _, _, _, states, _ = self._run(y, h[:, stay], x[stay])
            h, x, inside = states[-1], inputs[-1], y >= 0
            some, place = np.unique(k[inside], return_inverse=True)
            sums = np.bincount(place, weights=self.log_probs(self._at(states[1:], inside), y[inside]), minlength=len(some))
            for number, value in zip(some.tolist(), sums.tolist(), strict=True):
                total[number] = total.get(number, 0.0) + value
            for number in ended:
                yield number, total.pop(number)

    def train(self, docs: list[np.ndarray], window: int = 16, streams: int = 256, rate: float = 0.02) -> int:
        """Truncated backpropagation over documents side by side, with Adam; how many tokens were used.

        The rate falls to zero over the pass. Few tokens go through fewer streams, so that there are
        about STEPS updates where the documents allow it.
        """
        total = sum(map(len, docs))
        streams = min(streams, max(16, total // (window * STEPS)))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        h, x = np.zeros((self.hidden, streams), dtype=self.p["state"].dtype), np.full(streams, END)
        used = 0
        for count, (y, _, stay, _) in enumerate(lanes(docs, streams, window), 1):
            grads, h, x = self._window(y, h[:, stay], x[stay])
            step = rate * (1 - used / total)
            used += int((y >= 0).sum())
            for k, g in grads.items():
                np.clip(g, -1, 1, out=g)
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                self.p[k] -= step / (1 - 0.9**count) * m[k] / (np.sqrt(s[k] * (1 / (1 - 0.99**count))) + 1e-6)
        return used

    def _window(self, y: np.ndarray, h: np.ndarray, x: np.ndarray):
        """Gradients of one window's mean loss, and the state and tokens it ends with."""
        n, p, (steps, live) = self.hidden, self.p, y.shape
        grads = {k: np.zeros_like(v) for k, v in p.items() if k in ("input", "word_w", "word_b")}
        inputs, old, ends, before, states, tape = self._run(y, h, x)
        inside = y >= 0
        flat = y[inside]
        order, groups = self._by_class(flat)
        hs, ys = self._at(states[1:], inside)[:, order], flat[order]
        scale = np.float32(1 / max(len(ys), 1))
        rows, cls, word = np.arange(len(ys)), ys // self.per_class, ys % self.per_class
        q = self._classes(hs)
        q[cls, rows] -= 1
        q *= scale
        grads["class_w"], grads["class_b"] = hs @ q.T, q.sum(axis=1)
        back = p["class_w"] @ q
        for c, i, j in groups:
            v = self._words(c, hs[:, i:j])
            v[word[i:j], rows[: j - i]] -= 1
            v *= scale
            grads["word_w"][c], grads["word_b"][c] = v @ hs[:, i:j].T, v.sum(axis=1)
            back[:, i:j] += p["word_w"][c].T @ v
        out = np.zeros((steps * live, n), dtype=h.dtype)
        out[np.flatnonzero(inside)[order]] = back.T
        out = np.ascontiguousarray(out.reshape(steps, live, n).transpose(0, 2, 1))
        carry = np.zeros((n, live), dtype=h.dtype)
        grads["state"] = np.zeros_like(p["state"])
        back_u, back_a = np.empty((3 * n, live), dtype=h.dtype), np.empty((steps, 3 * n, live), dtype=h.dtype)
        for t in reversed(range(steps)):
            z, r, un, c = tape[t]
            d, da = out[t], back_a[t]
            d += carry
            dz = d * z
            dc = np.subtract(d, dz, out=da[2 * n :])
            dc *= 1 - c * c
            du = np.multiply(before[t] - c, dz, out=da[:n])
            du *= 1 - z
            back_u[2 * n :] = dc
            back_u[2 * n :] *= r
            dr = np.multiply(back_u[2 * n :], un, out=da[n : 2 * n])
            dr *= 1 - r
            back_u[: 2 * n] = da[: 2 * n]
            carry = p["state"] @ back_u
            carry += dz
            if ends[t]:
                carry *= old[t]
            grads["state"] += before[t] @ back_u.T
        flat = inputs[:-1].ravel().astype(np.int32 if len(p["input"]) > 1 << 15 else np.int16)
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.diff(flat[order], prepend=-1))
        rows = back_a.transpose(0, 2, 1).reshape(-1, 3 * n)[order]
        grads["input"][flat[order][first]] = np.add.reduceat(rows, first, axis=0)
        return {k: grads[k] for k in p}, states[-1], inputs[-1]
