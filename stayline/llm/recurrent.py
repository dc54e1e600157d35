"""Recurrent layers in NumPy: states run over time with features in rows and sequences in columns.

A layer holds `x`, one row of gate inputs for each symbol, and `u`, the weights of the state before.
Training runs by backpropagation through time; `grads` are of the same shapes as the weights.
"""

from __future__ import annotations

import numpy as np


def sigmoid(a: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-a))


class Gated:
    """GRU: z keeps the old state, r opens it to the new one."""

    gates = 3

    def __init__(self, symbols: int, hidden: int, rng: np.random.Generator):
        self.hidden = hidden
        self.x = rng.normal(0, 0.3, (symbols, self.gates * hidden)).astype(np.float32)
        self.u = rng.normal(0, hidden**-0.5, (self.gates * hidden, hidden)).astype(np.float32)

    def run(self, x: np.ndarray, on: np.ndarray | None = None) -> np.ndarray:
        """States (time, hidden, sequences) of symbols x (time, sequences); off positions reset the state."""
        hidden, n = self.hidden, x.shape[1]
        table = np.ascontiguousarray(self.x.T)
        out = np.empty((len(x), hidden, n), np.float32)
        h = np.zeros((hidden, n), np.float32)
        g = np.empty((3 * hidden, n), np.float32)
        with np.errstate(over="ignore"):
            for t, symbols in enumerate(x):
                np.take(table, symbols, axis=1, out=g, mode="clip")
                before = self.u @ h
                zr, new = g[: 2 * hidden], before[2 * hidden :]
                zr += before[: 2 * hidden]
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                new *= zr[hidden:]
                new += g[2 * hidden :]
                np.tanh(new, out=new)
                h -= new
                h *= zr[:hidden]
                h += new
                if on is not None:
                    h *= on[t]
                out[t] = h
        return out

    def learn(self, x: np.ndarray, on: np.ndarray):
        """States, and a function from their gradients to those of `x` and `u`."""
        k, steps = self.hidden, []
        h = np.zeros((k, x.shape[1]), np.float32)
        out = []
        for t, symbols in enumerate(x):
            a, before = self.x.T[:, symbols], self.u @ h
            z, r = sigmoid(a[:k] + before[:k]), sigmoid(a[k : 2 * k] + before[k : 2 * k])
            new = np.tanh(a[2 * k :] + r * before[2 * k :])
            steps.append((h, z, r, new, before[2 * k :]))
            h = (new + z * (h - new)) * on[t]
            out.append(h)

        def backward(d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            dx, du, dh = np.zeros_like(self.x), np.zeros_like(self.u), np.zeros_like(out[0])
            for t in range(len(x) - 1, -1, -1):
                h, z, r, new, before = steps[t]
                dh = (dh + d_out[t]) * on[t]
                d_new = dh * (1 - z) * (1 - new**2)
                d_z, d_r = dh * (h - new) * z * (1 - z), d_new * before * r * (1 - r)
                d_state = np.concatenate([d_z, d_r, d_new * r])
                add_rows(dx, x[t], np.concatenate([d_z, d_r, d_new]))
                du += d_state @ h.T
                dh = dh * z + self.u.T @ d_state
            return dx, du

        return np.stack(out), backward


class LongShort(Gated):
    """LSTM: input, forget and output gates around a cell."""

    gates = 4

    def run(self, x: np.ndarray, on: np.ndarray | None = None) -> np.ndarray:
        return self.learn(x, np.ones_like(x, np.float32) if on is None else on)[0]

    def learn(self, x: np.ndarray, on: np.ndarray):
        k, steps, out = self.hidden, [], []
        h = np.zeros((k, x.shape[1]), np.float32)
        c = h
        for t, symbols in enumerate(x):
            a = self.x.T[:, symbols] + self.u @ h
            i, f, o, g = sigmoid(a[:k]), sigmoid(a[k : 2 * k] + 1), sigmoid(a[2 * k : 3 * k]), np.tanh(a[3 * k :])
            old, c = c, (f * c + i * g) * on[t]
            squashed = np.tanh(c)
            steps.append((h, old, squashed, i, f, o, g))
            h = o * squashed * on[t]
            out.append(h)

        def backward(d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            dx, du = np.zeros_like(self.x), np.zeros_like(self.u)
            dh, dc = np.zeros_like(out[0]), np.zeros_like(out[0])
            for t in range(len(x) - 1, -1, -1):
                h, old, squashed, i, f, o, g = steps[t]
                dh = (dh + d_out[t]) * on[t]
                dc = (dc + dh * o * (1 - squashed**2)) * on[t]
                d_a = np.concatenate(
                    [dc * g * i * (1 - i), dc * old * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)]
                )
                add_rows(dx, x[t], d_a)
                du += d_a @ h.T
                dh, dc = self.u.T @ d_a, dc * f
            return dx, du

        return np.stack(out), backward


def add_rows(table: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
    np.add.at(table, rows, columns.T)


class Both:
    """A layer in either direction; its states stand one above the other."""

    def __init__(self, layer: type[Gated], symbols: int, hidden: int, rng: np.random.Generator):
        self.ahead, self.back = layer(symbols, hidden, rng), layer(symbols, hidden, rng)

    def run(self, x: np.ndarray, on: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        flipped = None if on is None else on[::-1]
        return self.ahead.run(x, on), self.back.run(x[::-1], flipped)[::-1]

    def learn(self, x: np.ndarray, on: np.ndarray):
        ahead, ahead_back = self.ahead.learn(x, on)
        back, back_back = self.back.learn(x[::-1], on[::-1])
        k = ahead.shape[1]

        def backward(d: np.ndarray) -> list[np.ndarray]:
            return [*ahead_back(d[:, :k]), *back_back(d[::-1, k:])]

        return np.concatenate([ahead, back[::-1]], axis=1), backward

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.x, self.ahead.u, self.back.x, self.back.u]


class Adam:
    """Steps of Adam on weights that are changed in place."""

    def __init__(self, weights: list[np.ndarray], rate: float):
        self.weights, self.rate, self.t = weights, rate, 0
        self.mean = [np.zeros_like(w) for w in weights]
        self.square = [np.zeros_like(w) for w in weights]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads)))
        scale = min(1.0, 5.0 / (norm + 1e-12))
        for w, g, m, s in zip(self.weights, grads, self.mean, self.square):
            g = g * scale
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.99**self.t)) + 1e-8)


def softmax(a: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(a - a.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)
