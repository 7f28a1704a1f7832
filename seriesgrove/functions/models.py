"""Small regressors in numpy: MLP, CNN and LSTM, their training, and a learning-rate schedule.

A model predicts a leaf's nearest-neighbour distance from a query. Gradients are
written out by hand; the forward pass of each kind is what inference uses.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class ModelSetting:
    """A name such as mlp_2_64: kind, layers, width."""

    kind: str = "mlp"
    layers: int = 2
    width: int = 0
    precision: str = "f"

    @staticmethod
    def parse(text: str) -> ModelSetting:
        found = re.fullmatch(r"(?:v\d+_)?(mlp|cnn|rnn)(?:_(\d+))?(?:_(\d+))?(?:_([fd]))?", text)
        if not found:
            raise ValueError(f"not a model setting: {text!r}")
        return ModelSetting(found[1], int(found[2] or 2), int(found[3] or 0), found[4] or "f")


@dataclass(frozen=True)
class Training:
    epochs: int = 100
    rate: float = 0.01
    batch: int = 0
    share: float = 0.9
    slope: float = 0.1
    clip: float = 0.0
    factor: float = 0.1
    patience: int = 10
    least_rate: float = 1e-7
    threshold: float = 1e-4
    stop_after: int = 40
    channels: int = 8
    kernel: int = 5
    hidden: int = 16
    seed: int = 1
    remove_square: bool = False


def leaky(x: np.ndarray, slope: float) -> np.ndarray:
    return np.where(x > 0, x, slope * x)


def uniform(rng: np.random.Generator, inputs: int, *shape: int) -> np.ndarray:
    return rng.uniform(-1, 1, shape) / np.sqrt(inputs)


class Mlp:
    """length -> width -> 1."""

    def __init__(self, length: int, t: Training, width: int = 0):
        self.length, self.t, self.width = length, t, width or length

    def start(self, rng: np.random.Generator) -> Weights:
        return {"w1": uniform(rng, self.length, self.length, self.width), "b1": uniform(rng, self.length, self.width), "w2": uniform(rng, self.width, self.width, 1), "b2": uniform(rng, self.width, 1)}

    def forward(self, p: Weights, x: np.ndarray) -> np.ndarray:
        return (leaky(x @ p["w1"] + p["b1"], self.t.slope) @ p["w2"] + p["b2"])[:, 0]

    def gradient(self, p: Weights, x: np.ndarray, y: np.ndarray) -> Weights:
        z = x @ p["w1"] + p["b1"]
        h = leaky(z, self.t.slope)
        d = (2 * (h @ p["w2"] + p["b2"] - y[:, None])) / len(y)
        dz = d @ p["w2"].T * np.where(z > 0, 1.0, self.t.slope)
        return {"w1": x.T @ dz, "b1": dz.sum(0), "w2": h.T @ d, "b2": d.sum(0)}


class Cnn:
    """Two convolutions with activations, the mean over places, one linear layer."""

    def __init__(self, length: int, t: Training, width: int = 0):
        self.length, self.t, self.c, self.k = length, t, width or t.channels, min(t.kernel, max(1, length // 2))

    def start(self, rng: np.random.Generator) -> Weights:
        c, k = self.c, self.k
        return {"w1": uniform(rng, k, k, c), "b1": uniform(rng, k, c), "w2": uniform(rng, k * c, k * c, c), "b2": uniform(rng, k * c, c), "w3": uniform(rng, c, c, 1), "b3": uniform(rng, c, 1)}

    def _parts(self, p: Weights, x: np.ndarray):
        v1 = np.lib.stride_tricks.sliding_window_view(x, self.k, axis=1)
        z1 = v1 @ p["w1"] + p["b1"]
        h1 = leaky(z1, self.t.slope)
        v2 = np.lib.stride_tricks.sliding_window_view(h1, self.k, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, self.k * self.c)
        z2 = (v2 @ p["w2"] + p["b2"]).mean(axis=1)
        return v1, z1, v2, z2, leaky(z2, self.t.slope)

    def forward(self, p: Weights, x: np.ndarray) -> np.ndarray:
        return (self._parts(p, x)[4] @ p["w3"] + p["b3"])[:, 0]

    def gradient(self, p: Weights, x: np.ndarray, y: np.ndarray) -> Weights:
        v1, z1, v2, z2, h2 = self._parts(p, x)
        d = 2 * (h2 @ p["w3"] + p["b3"] - y[:, None]) / len(y)
        dz2 = d @ p["w3"].T * np.where(z2 > 0, 1.0, self.t.slope) / v2.shape[1]
        every = np.broadcast_to(dz2[:, None, :], (len(x), v2.shape[1], self.c))
        dv2 = (every @ p["w2"].T).reshape(len(x), v2.shape[1], self.k, self.c)
        dh1 = np.zeros_like(z1)
        for i in range(self.k):
            dh1[:, i : i + v2.shape[1]] += dv2[:, :, i]
        dz1 = dh1 * np.where(z1 > 0, 1.0, self.t.slope)
        return {"w1": np.einsum("nlk,nlc->kc", v1, dz1), "b1": dz1.sum((0, 1)), "w2": np.einsum("nlk,nlc->kc", v2, every), "b2": every.sum((0, 1)), "w3": h2.T @ d, "b3": d.sum(0)}


class Rnn:
    """An LSTM over the values, activation, one linear layer on the last state."""

    def __init__(self, length: int, t: Training, width: int = 0):
        self.length, self.t, self.h = length, t, width or t.hidden

    def start(self, rng: np.random.Generator) -> Weights:
        h = self.h
        return {"wx": uniform(rng, h, 1, 4 * h), "wh": uniform(rng, h, h, 4 * h), "b": uniform(rng, h, 4 * h), "w": uniform(rng, h, h, 1), "b2": uniform(rng, h, 1)}

    def _run(self, p: Weights, x: np.ndarray):
        n, h = len(x), self.h
        state, cell, steps = np.zeros((n, h)), np.zeros((n, h)), []
        for t in range(self.length):
            z = x[:, t : t + 1] @ p["wx"] + state @ p["wh"] + p["b"]
            i, f, o = (1 / (1 + np.exp(-z[:, a * h : (a + 1) * h])) for a in range(3))
            g = np.tanh(z[:, 3 * h :])
            before = state, cell
            cell = f * cell + i * g
            state = o * np.tanh(cell)
            steps.append((before, i, f, o, g, cell))
        return state, steps

    def forward(self, p: Weights, x: np.ndarray) -> np.ndarray:
        return (leaky(self._run(p, x)[0], self.t.slope) @ p["w"] + p["b2"])[:, 0]

    def gradient(self, p: Weights, x: np.ndarray, y: np.ndarray) -> Weights:
        state, steps = self._run(p, x)
        a = leaky(state, self.t.slope)
        d = 2 * (a @ p["w"] + p["b2"] - y[:, None]) / len(y)
        out = {k: np.zeros_like(v) for k, v in p.items()}
        out["w"], out["b2"] = a.T @ d, d.sum(0)
        dh, dc = d @ p["w"].T * np.where(state > 0, 1.0, self.t.slope), np.zeros_like(state)
        for t in reversed(range(self.length)):
            (h0, c0), i, f, o, g, c = steps[t]
            tc = np.tanh(c)
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            out["wx"] += x[:, t : t + 1].T @ dz
            out["wh"] += h0.T @ dz
            out["b"] += dz.sum(0)
            dh, dc = dz @ p["wh"].T, dc * f
        return out


KINDS = {"mlp": Mlp, "cnn": Cnn, "rnn": Rnn}


def make(setting: ModelSetting | str, length: int, t: Training = Training()):
    """A model of a setting; unknown kinds are refused."""
    setting = ModelSetting.parse(setting) if isinstance(setting, str) else setting
    return KINDS[setting.kind](length, t, setting.width)


def memory_mb(p: Weights) -> float:
    """Twice the parameters' bytes, in MB."""
    return 2 * sum(v.size * 4 for v in p.values()) / 1e6


@dataclass
class Plateau:
    """Lowers the rate when the loss has not fallen for `patience` epochs; tells when to stop."""

    t: Training
    rate: float = 0.0
    best: float = float("inf")
    bad: int = 0
    idle: int = 0

    def step(self, loss: float) -> bool:
        """True if training should stop."""
        if loss < self.best * (1 - self.t.threshold):
            self.best, self.bad, self.idle = loss, 0, 0
            return False
        self.bad, self.idle = self.bad + 1, self.idle + 1
        if self.bad > self.t.patience:
            self.rate, self.bad = max(self.rate * self.t.factor, self.t.least_rate), 0
        return self.idle > self.t.stop_after


@dataclass
class Trained:
    weights: Weights
    loss: float
    history: list[float] = field(default_factory=list)


def train(model, x: np.ndarray, y: np.ndarray, t: Training = Training(), adam: bool | None = None) -> Trained:
    """Minimises squared error; the best weights on validation rows after half the epochs are kept. Equal input and seed, equal weights."""
    rng = np.random.default_rng(t.seed)
    p = model.start(rng)
    y = np.sqrt(np.maximum(y, 0)) if t.remove_square else y
    cut = max(1, int(len(x) * t.share)) if len(x) > 1 else len(x)
    tx, ty, vx, vy = x[:cut], y[:cut], x[cut:], y[cut:]
    if not len(vx):
        vx, vy = tx, ty
    adam = isinstance(model, Cnn) if adam is None else adam
    m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
    plan = Plateau(t, t.rate)
    best, kept, history, step = float("inf"), {k: w.copy() for k, w in p.items()}, [], 0
    size = t.batch or len(tx)
    for epoch in range(t.epochs):
        order = rng.permutation(len(tx))
        for lo in range(0, len(tx), size):
            rows = order[lo : lo + size]
            g = model.gradient(p, tx[rows], ty[rows])
            if t.clip:
                norm = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
                g = {k: w * min(1.0, t.clip / (norm + 1e-6)) for k, w in g.items()}
            step += 1
            for k in p:
                if adam:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    p[k] = p[k] - plan.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                else:
                    p[k] = p[k] - plan.rate * g[k]
        loss = float(((model.forward(p, vx) - vy) ** 2).mean())
        history.append(loss)
        if epoch >= t.epochs // 2:
            if loss < best:
                best, kept = loss, {k: w.copy() for k, w in p.items()}
            if plan.step(loss):
                break
    return Trained(kept, best, history)


def flat(p: Weights) -> tuple[list[str], list[list[int]], list[float]]:
    """Names, shapes and values, to be stored in columns."""
    return list(p), [list(v.shape) for v in p.values()], np.concatenate([v.ravel() for v in p.values()]).tolist()


def unflat(names: list[str], shapes: list[list[int]], values: list[float]) -> Weights:
    out, at = {}, 0
    for name, shape in zip(names, shapes, strict=True):
        n = int(np.prod(shape))
        out[name] = np.array(values[at : at + n]).reshape(shape)
        at += n
    return out


@dataclass
class Navigator:
    """Two sigmoid layers that give each leaf a probability for a query; trained on shares of nearest neighbours by squared error."""

    length: int
    leaves: list[int]
    width: int = 500
    weights: Weights = field(default_factory=dict)

    def _layers(self, x: np.ndarray):
        one = 1 / (1 + np.exp(-(x @ self.weights["w1"] + self.weights["b1"])))
        two = 1 / (1 + np.exp(-(one @ self.weights["w2"] + self.weights["b2"])))
        return one, two, 1 / (1 + np.exp(-(two @ self.weights["w3"] + self.weights["b3"])))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 100, rate: float = 0.5, seed: int = 1) -> list[float]:
        """x: queries; y: shares, a column for each leaf. Returns the loss by epoch."""
        rng = np.random.default_rng(seed)
        sizes = [self.length, self.width, self.width, len(self.leaves)]
        self.weights = {}
        for i in range(3):
            self.weights |= {f"w{i + 1}": uniform(rng, sizes[i], sizes[i], sizes[i + 1]), f"b{i + 1}": uniform(rng, sizes[i], sizes[i + 1])}
        losses = []
        for _ in range(epochs):
            one, two, out = self._layers(x)
            losses.append(float(((out - y) ** 2).mean()))
            d = 2 * (out - y) * out * (1 - out) / len(x)
            grads = {"w3": two.T @ d, "b3": d.sum(0)}
            d = d @ self.weights["w3"].T * two * (1 - two)
            grads |= {"w2": one.T @ d, "b2": d.sum(0)}
            d = d @ self.weights["w2"].T * one * (1 - one)
            grads |= {"w1": x.T @ d, "b1": d.sum(0)}
            for k, g in grads.items():
                self.weights[k] = self.weights[k] - rate * g
        return losses

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._layers(x)[2]
