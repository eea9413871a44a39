"""A bidirectional gated recurrent network over bytes, in numpy, trained by backpropagation through time.

Texts are read in windows of WINDOW bytes, each from a zero state in both directions; every byte gets class
probabilities, whatever the length of the text.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW = 64


@dataclass(frozen=True)
class Gru:
    """Training parameters; ``per_language`` bounds the documents, ``windows`` the windows of each that are learned from."""
    hidden: int = 16
    batch: int = 256
    steps: int = 220
    rate: float = 0.02
    per_language: int = 600
    windows: int = 12


Model = dict[str, np.ndarray]  # e (2, 256, 3h), u (2, h, 3h), b (2, 3h), w (2, h, c), d (c)


def new_model(hidden: int, classes: int) -> Model:
    rng = np.random.default_rng(11)
    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)
    return {"e": normal(2, 256, 3 * hidden, scale=0.4), "u": normal(2, hidden, 3 * hidden, scale=hidden ** -0.5),
            "b": np.zeros((2, 3 * hidden), np.float32), "w": normal(2, hidden, classes, scale=0.3),
            "d": np.zeros(classes, np.float32)}


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def _both_ways(windows: np.ndarray) -> np.ndarray:
    """Time-major bytes of both reading directions: (t, 2, n)."""
    return np.ascontiguousarray(np.stack([windows.T, windows.T[::-1]], axis=1))


def forward(m: Model, windows: np.ndarray):
    """Hidden states (t, 2, n, h) of full windows and what the backward pass needs."""
    t, n, h = windows.shape[1], len(windows), m["u"].shape[1]
    x = _both_ways(windows)
    states = np.zeros((t + 1, 2, n, h), np.float32)
    gates = np.empty((t, 2, n, 3 * h), np.float32)
    pulls = np.empty((t, 2, n, h), np.float32)
    for k in range(t):
        g, s = gates[k], states[k]
        for way in (0, 1):
            np.take(m["e"][way], x[k, way], axis=0, out=g[way])
        a = s @ m["u"]
        pulls[k] = a[..., 2 * h:]
        zr = g[..., :2 * h]
        zr += a[..., :2 * h] + m["b"][:, None, :2 * h]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        c = g[..., 2 * h:]
        c += zr[..., h:] * pulls[k] + m["b"][:, None, 2 * h:]
        np.tanh(c, out=c)
        states[k + 1] = c + zr[..., :h] * (s - c)
    return x, states, gates, pulls


def _aligned(states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward states of each position in reading order."""
    return states[1:, 0], states[1:, 1][::-1]


def loss_and_gradient(m: Model, windows: np.ndarray, labels: np.ndarray) -> tuple[float, Model]:
    x, states, gates, pulls = forward(m, windows)
    t, n, h = windows.shape[1], len(windows), m["u"].shape[1]
    ahead, back = _aligned(states)
    p = _softmax(ahead @ m["w"][0] + back @ m["w"][1] + m["d"])
    loss = -np.log(p[:, np.arange(n), labels] + 1e-9).mean()
    p[:, np.arange(n), labels] -= 1
    p /= t * n
    flat = p.reshape(t * n, -1)
    grad = {k: np.zeros_like(v) for k, v in m.items()}
    grad["d"] = flat.sum(0)
    grad["w"][0] = ahead.reshape(t * n, h).T @ flat
    grad["w"][1] = back.reshape(t * n, h).T @ flat
    from_labels = np.stack([p @ m["w"][0].T, (p @ m["w"][1].T)[::-1]], axis=1)
    carried = np.zeros((2, n, h), np.float32)
    steps = np.empty((t, 2, n, 3 * h), np.float32)
    for k in range(t - 1, -1, -1):
        z, r, c = gates[k, ..., :h], gates[k, ..., h:2 * h], gates[k, ..., 2 * h:]
        d = carried + from_labels[k]
        dc = d * (1 - z) * (1 - c * c)
        dz = d * (states[k] - c) * z * (1 - z)
        dr = dc * pulls[k] * r * (1 - r)
        steps[k] = np.concatenate([dz, dr, dc], axis=-1)
        da = np.concatenate([dz, dr, dc * r], axis=-1)
        grad["u"] += states[k].transpose(0, 2, 1) @ da
        carried = d * z + da @ m["u"].transpose(0, 2, 1)
    grad["b"] = steps.sum(axis=(0, 2))
    for way in (0, 1):
        np.add.at(grad["e"][way], x[:, way].ravel(), steps[:, way].reshape(t * n, 3 * h))
    return float(loss), grad


def train(windows: np.ndarray, labels: np.ndarray, classes: int, p: Gru) -> Model:
    """Adam over shuffled batches of full windows."""
    m = new_model(p.hidden, classes)
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    rng = np.random.default_rng(5)
    for step in range(1, p.steps + 1):
        pick = rng.integers(0, len(windows), p.batch)
        _, grad = loss_and_gradient(m, windows[pick], labels[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = p.rate * (1 - step / (p.steps + 1)) * min(1.0, 1.0 / (norm + 1e-9))
        for k, g in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            m[k] -= (rate * (first[k] / (1 - 0.9 ** step))
                     / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return m


class Reader:
    """Position probabilities with a trained model, on many windows at once.

    Gates and classes are arrays of their own, so that every step works on contiguous memory.
    """

    def __init__(self, m: Model, batch: int = 2048):
        h = m["u"].shape[1]
        self.h, self.batch, self.d = h, batch, m["d"]
        parts = [slice(0, h), slice(h, 2 * h), slice(2 * h, 3 * h)]
        # the first two gates as tanh of half the argument
        self.e = [[np.ascontiguousarray((m["e"][w][:, p] + m["b"][w][p]) * f) for p, f in zip(parts, (0.5, 0.5, 1))]
                  for w in (0, 1)]
        self.u = [[np.ascontiguousarray(m["u"][w][:, p] * np.float32(f)) for p, f in zip(parts, (0.5, 0.5, 1))]
                  for w in (0, 1)]
        self.w = [np.ascontiguousarray(m["w"][w].T) for w in (0, 1)]

    def window_probabilities(self, windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sum of the class probabilities of each window's first ``sizes`` bytes; the rest is padding."""
        out = np.empty((len(windows), len(self.d)), np.float32)
        full = sizes == windows.shape[1]
        for rows in (np.flatnonzero(full), np.flatnonzero(~full)):
            for i in range(0, len(rows), self.batch):
                part = rows[i:i + self.batch]
                out[part] = self._run(windows[part], None if full[part[0]] else sizes[part])
        return out

    def _run(self, windows: np.ndarray, sizes: np.ndarray | None) -> np.ndarray:
        n, t = windows.shape
        logits = np.empty((t, len(self.d), n), np.float32)
        inside = None if sizes is None else (np.arange(t)[:, None] < sizes).astype(np.float32)
        columns = np.ascontiguousarray(windows.T)
        z, r, c, pull, s, more = (np.empty((n, self.h), np.float32) for _ in range(6))
        label = np.empty((len(self.d), n), np.float32)
        for way in (0, 1):
            (ez, er, ec), (uz, ur, uc) = self.e[way], self.u[way]
            s[:] = 0
            for k in (range(t) if way == 0 else range(t - 1, -1, -1)):
                x = columns[k]
                for e, u, gate in ((ez, uz, z), (er, ur, r)):
                    np.take(e, x, axis=0, out=gate, mode="clip")
                    np.matmul(s, u, out=more)
                    gate += more
                    np.tanh(gate, out=gate)
                    gate *= 0.5
                    gate += 0.5
                np.take(ec, x, axis=0, out=c, mode="clip")
                np.matmul(s, uc, out=pull)
                pull *= r
                c += pull
                np.tanh(c, out=c)
                s -= c
                s *= z
                s += c
                if inside is not None:
                    s *= inside[k][:, None]  # reading from the right, padding leaves the state at zero
                if way == 0:
                    np.matmul(self.w[0], s.T, out=logits[k])
                else:
                    np.matmul(self.w[1], s.T, out=label)
                    logits[k] += label
        logits += self.d[:, None]
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        if inside is not None:
            logits *= inside[:, None, :]
        return logits.sum(axis=0).T


def cut_windows(data: bytes, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text and how many bytes each holds; the last one is padded."""
    n = -(-len(data) // size)
    padded = np.zeros(n * size, np.uint8)
    padded[:len(data)] = np.frombuffer(data, np.uint8)
    sizes = np.full(n, size)
    if n:
        sizes[-1] = len(data) - (n - 1) * size
    return padded.reshape(n, size), sizes
