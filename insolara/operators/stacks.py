"""Many networks of one depth as three-dimensional arrays, trained side by side on the same rows.

Networks of unlike widths are padded to the widest; what is padded has zero weights, gets no gradient and
stays zero, so every network is trained exactly as it would be alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np

# Adam decay rates and guard.
ADAM_FIRST, ADAM_SECOND, ADAM_GUARD = 0.9, 0.999, 1e-8

ACTIVATIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "identity": lambda z: z,
    "logistic": lambda z: 0.5 * (1.0 + np.tanh(0.5 * z)),
    "tanh": np.tanh,
    "relu": lambda z: np.maximum(z, 0.0),
}

# Slope of each activation as a function of its output.
SLOPES: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "identity": np.ones_like,
    "logistic": lambda a: a * (1.0 - a),
    "tanh": lambda a: 1.0 - a * a,
    "relu": lambda a: (a > 0).astype(float),
}

Block = tuple[int, np.ndarray, np.ndarray]  # number, x, y


class Stack:
    """Networks with their solver's memory; every list holds one entry per layer's weights and biases in turn."""

    def __init__(self, sizes: Sequence[Sequence[int]], activation: str, solver: str, flats: np.ndarray | Sequence[np.ndarray],
                 firsts: Sequence[np.ndarray], seconds: Sequence[np.ndarray]):
        self.sizes, self.activation, self.solver = [list(s) for s in sizes], activation, solver
        self.widths = np.max(self.sizes, axis=0)
        self.masks = self._padded([np.ones(len(f)) for f in flats])
        self.values, self.first, self.second = (self._padded(v) for v in (flats, firsts, seconds))

    def __len__(self) -> int:
        return len(self.sizes)

    def _padded(self, flats: Sequence[np.ndarray]) -> list[np.ndarray]:
        out = []
        for fan_in, fan_out in zip(self.widths[:-1], self.widths[1:]):
            out += [np.zeros((len(self.sizes), fan_in, fan_out)), np.zeros((len(self.sizes), 1, fan_out))]
        for n, (sizes, flat) in enumerate(zip(self.sizes, flats)):
            at = 0
            for layer, (a, b) in enumerate(zip(sizes[:-1], sizes[1:])):
                out[2 * layer][n, :a, :b] = flat[at:at + a * b].reshape(a, b)
                out[2 * layer + 1][n, 0, :b] = flat[at + a * b:at + (a + 1) * b]
                at += (a + 1) * b
        return out

    def flats(self, padded: list[np.ndarray]) -> list[np.ndarray]:
        """The vectors of the single networks, in the order of their layers."""
        return [np.concatenate([part for layer, (a, b) in enumerate(zip(sizes[:-1], sizes[1:])) for part in
                                (padded[2 * layer][n, :a, :b].ravel(), padded[2 * layer + 1][n, 0, :b])])
                for n, sizes in enumerate(self.sizes)]

    def keep(self, which: np.ndarray) -> None:
        self.sizes = [self.sizes[i] for i in which]
        for name in ("masks", "values", "first", "second"):
            setattr(self, name, [v[which] for v in getattr(self, name)])

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Sums of squared errors and of the gradient of half of them; ``x`` is (rows, d) for all or (n, rows, d)."""
        act, slope, outs = ACTIVATIONS[self.activation], SLOPES[self.activation], [x]
        layers = len(self.widths) - 1
        for layer in range(layers):
            z = outs[-1] @ self.values[2 * layer] + self.values[2 * layer + 1]
            outs.append(act(z) if layer < layers - 1 else z)
        delta = outs[-1] - y[..., None]
        sse = (delta ** 2).sum(axis=(1, 2))
        grads: list[np.ndarray] = [None] * (2 * layers)
        for layer in range(layers - 1, -1, -1):
            grads[2 * layer] = (outs[layer].swapaxes(-1, -2) @ delta) * self.masks[2 * layer]
            grads[2 * layer + 1] = delta.sum(axis=1, keepdims=True) * self.masks[2 * layer + 1]
            if layer:
                delta = (delta @ self.values[2 * layer].swapaxes(-1, -2)) * slope(outs[layer])
        return sse, grads

    def penalty(self) -> np.ndarray:
        """Sum of squared weights, without biases."""
        return sum((w ** 2).sum(axis=(1, 2)) for w in self.values[::2])

    def step(self, grads: list[np.ndarray], rows: int, rate: np.ndarray, alpha: np.ndarray, momentum: np.ndarray,
             steps: np.ndarray) -> None:
        """One step of the solver; the settings are (n, 1, 1), ``steps`` counts Adam's steps including this one."""
        adam = rate * np.sqrt(1 - ADAM_SECOND ** steps) / (1 - ADAM_FIRST ** steps) if self.solver == "adam" else None
        for i, grad in enumerate(grads):
            grad = ((grad + alpha * self.values[i]) if i % 2 == 0 else grad) / rows
            if self.solver == "adam":
                self.first[i] = ADAM_FIRST * self.first[i] + (1 - ADAM_FIRST) * grad
                self.second[i] = ADAM_SECOND * self.second[i] + (1 - ADAM_SECOND) * grad * grad
                self.values[i] = self.values[i] - adam * self.first[i] / (np.sqrt(self.second[i]) + ADAM_GUARD)
            elif self.solver == "sgd":
                self.first[i] = momentum * self.first[i] - rate * grad
                self.values[i] = self.values[i] + self.first[i]
            else:
                raise ValueError("solver must be adam or sgd")


def batches_of(blocks: Sequence[Block], size: int, shard: int, seeds: Sequence[int], epochs: Sequence[int]
               ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Mini-batches of an epoch: each block in an order drawn from (seed, epoch, shard, block).

    Networks that share seed and epoch share the batch; else every network has its own.
    """
    draws = list(zip(seeds, epochs))
    for number, x, y in blocks:
        orders = {d: np.random.default_rng([*d, shard, number]).permutation(len(y)) for d in dict.fromkeys(draws)}
        order = orders[draws[0]] if len(orders) == 1 else np.stack([orders[d] for d in draws])
        for at in range(0, len(y), size):
            pick = order[..., at:at + size]
            yield x[pick], y[pick]
