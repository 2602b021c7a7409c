"""Feed-forward regression networks trained over partitions.

Rows are dealt to shards of bounded size by a hash of their values, each shard to a partition of its own. A
shard trains the current weights of its networks by mini-batches for one round of epochs and hands them
back; Spark averages them, weighted by rows. With ``batch_size=None`` tasks return plain gradient sums
instead and the driver takes one step. Many networks (a sweep, a grid, restarts) share each pass: those of
one depth form a stack of arrays, and where there are more cores than shards, the stacks are split into
groups beside each other. Rows may carry a key, with networks of its own that see no other rows. Only
weights travel; results depend on data, seed and number of shards, not on partitions or cores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import groupby
from math import ceil
from operator import and_, itemgetter

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insolara.functions.nulls import drop_incomplete, finite
from insolara.functions.timecol import TRAINING_BLOCKS, training_block
from insolara.operators.partials import Batches, matrix, partial_rows, summed, vector
from insolara.operators.stacks import ACTIVATIONS, ADAM_FIRST, ADAM_GUARD, ADAM_SECOND, SLOPES, Stack, batches_of
from insolara.operators.stats import Scaler, minmax_scale, scaler_fit, scalers_by

# Fixed value: the weight penalty.
ALPHA = 1e-4

@dataclass
class Network:
    """Layer sizes (input first, output last), hidden activation, weights and biases; linear output."""

    sizes: list[int]
    activation: str
    weights: list[np.ndarray]
    biases: list[np.ndarray]

    @classmethod
    def create(cls, n_input: int, hidden: Sequence[int], activation: str = "relu", seed: int = 0) -> "Network":
        """Uniform start scaled by the layer widths."""
        if activation not in ACTIVATIONS:
            raise ValueError(f"activation must be one of {sorted(ACTIVATIONS)}")
        sizes = [int(n_input), *[int(h) for h in hidden], 1]
        rng = np.random.default_rng(seed)
        spread = 2.0 if activation == "logistic" else 6.0
        weights, biases = [], []
        for fan_in, fan_out in zip(sizes[:-1], sizes[1:]):
            edge = np.sqrt(spread / (fan_in + fan_out))
            weights.append(rng.uniform(-edge, edge, (fan_in, fan_out)))
            biases.append(rng.uniform(-edge, edge, fan_out))
        return cls(sizes, activation, weights, biases)

    @classmethod
    def from_flat(cls, sizes: Sequence[int], activation: str, flat: Sequence[float]) -> "Network":
        values = np.asarray(flat, dtype=float)
        weights, biases, at = [], [], 0
        for fan_in, fan_out in zip(sizes[:-1], sizes[1:]):
            weights.append(values[at:at + fan_in * fan_out].reshape(fan_in, fan_out))
            at += fan_in * fan_out
            biases.append(values[at:at + fan_out])
            at += fan_out
        if at != len(values):
            raise ValueError("number of weights does not fit the layer sizes")
        return cls(list(sizes), activation, weights, biases)

    def flat(self) -> np.ndarray:
        return np.concatenate([np.concatenate([w.ravel(), b]) for w, b in zip(self.weights, self.biases)])

    def layers(self, x: np.ndarray) -> list[np.ndarray]:
        act = ACTIVATIONS[self.activation]
        out = [x]
        for i, (w, b) in enumerate(zip(self.weights, self.biases)):
            z = out[-1] @ w + b
            out.append(act(z) if i < len(self.weights) - 1 else z)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.layers(x)[-1][:, 0]

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of squared errors and the summed gradient of half of it, without penalty."""
        outs = self.layers(x)
        delta = outs[-1] - y[:, None]
        sse = float((delta ** 2).sum())
        slope = SLOPES[self.activation]
        parts: list[np.ndarray] = []
        for i in range(len(self.weights) - 1, -1, -1):
            parts.append(np.concatenate([(outs[i].T @ delta).ravel(), delta.sum(axis=0)]))
            if i:
                delta = (delta @ self.weights[i].T) * slope(outs[i])
        return sse, np.concatenate(parts[::-1])

    def mask(self) -> np.ndarray:
        """1 where the flat vector holds a weight, 0 where it holds a bias."""
        return np.concatenate([np.concatenate([np.ones(w.size), np.zeros(b.size)])
                               for w, b in zip(self.weights, self.biases)])


@dataclass(frozen=True)
class Training:
    """Settings of one training run; ``max_iter`` and ``patience`` count epochs."""

    solver: str = "adam"
    learning_rate: float = 0.001
    schedule: str = "constant"
    power_t: float = 0.5
    momentum: float = 0.9
    alpha: float = ALPHA
    batch_size: int | None = 200
    max_iter: int = 200
    tol: float = 1e-4
    patience: int = 10
    seed: int = 0


@dataclass
class _State:
    """Weights with the solver's memory, as vectors that can be averaged."""

    w: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: float = 0.0
    samples: float = 0.0

    @classmethod
    def fresh(cls, w: np.ndarray) -> "_State":
        return cls(w.copy(), np.zeros_like(w), np.zeros_like(w))

    def copy(self) -> "_State":
        return _State(self.w.copy(), self.first.copy(), self.second.copy(), self.steps, self.samples)

    def vector(self) -> np.ndarray:
        return np.concatenate([self.w, self.first, self.second, [self.steps]])

    @classmethod
    def from_vector(cls, v: np.ndarray, samples: float) -> "_State":
        n = (len(v) - 1) // 3
        return cls(v[:n], v[n:2 * n], v[2 * n:3 * n], float(v[-1]), samples)

    def step(self, grad: np.ndarray, how: Training) -> None:
        if how.solver == "adam":
            self.steps += 1
            self.first = ADAM_FIRST * self.first + (1 - ADAM_FIRST) * grad
            self.second = ADAM_SECOND * self.second + (1 - ADAM_SECOND) * grad * grad
            rate = how.learning_rate * np.sqrt(1 - ADAM_SECOND ** self.steps) / (1 - ADAM_FIRST ** self.steps)
            self.w = self.w - rate * self.first / (np.sqrt(self.second) + ADAM_GUARD)
        elif how.solver == "sgd":
            rate = how.learning_rate
            if how.schedule == "invscaling":
                rate /= (self.samples + 1) ** how.power_t
            self.first = how.momentum * self.first - rate * grad
            self.w = self.w + self.first
        else:
            raise ValueError("solver must be adam or sgd")


@dataclass
class Fit:
    """A trained network with its loss per epoch and its scores on the training rows."""

    network: Network
    losses: list[float] = field(default_factory=list)
    score: dict[str, float] = field(default_factory=dict)

    @property
    def r2(self) -> float:
        return self.score["r2"]

    @property
    def epochs(self) -> int:
        return len(self.losses)


def training_rows(df: DataFrame, x: Sequence[str], y: str) -> DataFrame:
    """Complete rows as ``x array<double>, y double``."""
    rows = drop_incomplete(df.select(*dict.fromkeys([*x, y])))
    return rows.select(F.array(*[F.col(c).cast("double") for c in x]).alias("x"), F.col(y).cast("double").alias("y"))


# Rows of a shard, rows of a block inside which mini-batches are drawn, and shards whose weights the driver adds up itself.
SHARD_ROWS = 1 << 14
BLOCK = 10_000
DIRECT = 16
SYNC = 100  # epochs of a round where every network's rows are one shard
AVERAGED = 10  # epochs between averages where some have several


@dataclass
class _Task:
    """A network in training: its key, its group among those of the key, and how far it is."""

    key: int
    group: int
    fit: "Fit"
    plan: Training
    state: _State
    best: float = np.inf
    stale: int = 0

    @property
    def signature(self) -> tuple:
        how = self.plan
        return len(self.fit.network.sizes), self.fit.network.activation, how.solver, how.batch_size

    def told(self, loss: float) -> bool:
        """Takes note of an epoch's loss; False where training ends."""
        if not np.isfinite(loss):
            raise FloatingPointError(f"loss is {loss} in epoch {len(self.fit.losses) + 1}")
        self.fit.losses.append(float(loss))
        self.stale = self.stale + 1 if loss > self.best - self.plan.tol else 0
        self.best = min(self.best, loss)
        return self.stale <= self.plan.patience and len(self.fit.losses) < self.plan.max_iter


@dataclass
class _Dealt:
    """Rows of all shards and groups, each in a partition of its own, with what the units mean."""

    rows: DataFrame
    width: int
    units: list[tuple[int, int, int]]  # key, shard, group
    shards: dict[int, int]
    groups: dict[int, int]
    counts: dict[int, int]


def _deal(rows: DataFrame, width: int, wanted: dict[int, int], shards: int | None, cache: bool) -> _Dealt:
    """Rows (key, x, y) dealt to units; ``wanted`` counts the networks of each key (few keys, as they are listed here).

    The shard of a row follows from a hash of its values, and a shard's order from the same hash, so files,
    partitions and cores do not matter. A shard holds about SHARD_ROWS rows unless ``shards`` says how many
    there are. Groups repeat the rows of a shard, at most once per core.
    """
    counts = {r["key"]: r["count"] for r in rows.groupBy("key").count().collect() if r["key"] in wanted}
    if not counts:
        raise ValueError("no complete training rows")
    parts = {k: shards or ceil(n / SHARD_ROWS) for k, n in counts.items()}
    spare = ceil(rows.sparkSession.sparkContext.defaultParallelism / sum(parts.values()))
    groups = {k: max(1, min(wanted[k], spare)) for k in counts}
    units = [(k, s, g) for k in sorted(counts) for s in range(parts[k]) for g in range(groups[k])]
    first = {k: units.index((k, 0, 0)) for k in counts}

    def by_key(values: dict[int, int]):
        made = F.lit(None).cast("int")
        for k, v in values.items():
            made = F.when(F.col("key") == k, F.lit(v)).otherwise(made)
        return made

    mark = F.xxhash64("x", "y")
    shard = F.pmod("mark", by_key(parts)).cast("int")
    unit = by_key(first) + shard * by_key(groups)
    dealt = (rows.where(F.col("key").isin(list(counts))).withColumn("mark", mark)
             .select("x", "y", "mark", F.explode(F.sequence(unit, unit + by_key(groups) - 1)).alias("shard"))
             .repartitionById(len(units), "shard").sortWithinPartitions("shard", "mark", "x", "y").select("shard", "x", "y"))
    return _Dealt(dealt.persist(StorageLevel.MEMORY_AND_DISK) if cache else dealt, width, units, parts, groups, counts)


def _blocks(batches: Batches, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(shard, number, x, y): blocks of BLOCK rows, the last of a shard shorter, however batches are cut."""
    shard, number, xs, ys, held = None, 0, [], [], 0
    for batch in batches:
        marks, x, y = vector(batch, "shard"), matrix(batch, "x", width), vector(batch, "y")
        at = 0
        while at < len(marks):
            if marks[at] != shard:
                if held:
                    yield int(shard), number, np.concatenate(xs), np.concatenate(ys)
                shard, number, xs, ys, held = marks[at], 0, [], [], 0
            end = min(at + BLOCK - held, int(np.searchsorted(marks, shard, side="right")))
            xs.append(x[at:end])
            ys.append(y[at:end])
            held, at = held + end - at, end
            if held == BLOCK:
                yield int(shard), number, np.concatenate(xs), np.concatenate(ys)
                number, xs, ys, held = number + 1, [], [], 0
    if held:
        yield int(shard), number, np.concatenate(xs), np.concatenate(ys)


def _round(dealt: _Dealt, tasks: dict[int, _Task], epochs: int) -> dict[int, np.ndarray]:
    """One pass: per network (rows * state, rows, errors and penalties * rows per epoch, epochs * rows).

    Networks of full batches give (gradient, rows, errors, penalty * rows, rows). Where a network's rows are one
    shard, the task ends its training by its own losses.
    """
    units, width, shards, rows_of = dealt.units, dealt.width, dealt.shards, dealt.counts
    sent = {i: (t.key, t.group, t.signature, t.fit.network.sizes, t.plan, t.state, t.best, t.stale, len(t.fit.losses))
            for i, t in tasks.items()}

    def task(batches: Batches) -> Iterator[tuple[int, np.ndarray]]:
        for unit, own in groupby(_blocks(batches, width), key=itemgetter(0)):
            key, shard, group = units[unit]
            blocks = [b[1:] for b in own]
            stacks: dict[tuple, list[int]] = {}
            for i, s in sent.items():
                if s[:2] == (key, group):
                    stacks.setdefault(s[2], []).append(i)
            for (_, activation, solver, size), members in stacks.items():
                states = [sent[i][5] for i in members]
                stack = Stack([sent[i][3] for i in members], activation, solver, [s.w for s in states],
                              [s.first for s in states], [s.second for s in states])
                if size is None:
                    yield from full(stack, members, blocks)
                else:
                    yield from trained(stack, members, blocks, size, shard, shards[key] == 1, rows_of[key])

    def full(stack: Stack, members: list[int], blocks: list) -> Iterator[tuple[int, np.ndarray]]:
        seen, pen = sum(len(y) for _, _, y in blocks), stack.penalty()
        made = [stack.gradient(x, y) for _, x, y in blocks]
        sse = sum(m[0] for m in made)
        grads = stack.flats([sum(layer) for layer in zip(*(m[1] for m in made))])
        for n, i in enumerate(members):
            yield i, np.concatenate([grads[n], [seen, sse[n], pen[n] * seen, seen]])

    def trained(stack: Stack, members: list[int], blocks: list, size: int, shard: int, alone: bool, total: int):
        seen = sum(len(y) for _, _, y in blocks)
        plans = [sent[i][4] for i in members]
        best, stale, done = (np.array([sent[i][k] for i in members], float) for k in (6, 7, 8))
        start = done.copy()
        steps, samples = (np.array([getattr(sent[i][5], k) for i in members], float) for k in ("steps", "samples"))
        left = np.arange(len(members))
        told = np.zeros((len(members), 2, epochs))
        out: dict[int, np.ndarray] = {}

        def column(name: str) -> np.ndarray:
            return np.array([getattr(plans[i], name) for i in left], float)[:, None, None]

        def hand_over(which: np.ndarray) -> None:
            parts = zip(stack.flats(stack.values), stack.flats(stack.first), stack.flats(stack.second))
            for n, vectors in enumerate(parts):
                if which[n]:
                    i = left[n]
                    out[members[i]] = np.concatenate([*(v * seen for v in vectors), [steps[i] * seen, seen], *told[i],
                                                      [(done[i] - start[i]) * seen]])

        for epoch in range(epochs):
            rate, alpha, momentum = column("learning_rate"), column("alpha"), column("momentum")
            falls = np.array([plans[i].schedule == "invscaling" for i in left])[:, None, None]
            rate = np.where(falls, rate / (samples[left][:, None, None] + 1) ** column("power_t"), rate)
            pen, sse = stack.penalty(), np.zeros(len(left))
            for x, y in batches_of(blocks, size, shard, [plans[i].seed for i in left], done[left].astype(int).tolist()):
                miss, grads = stack.gradient(x, y)
                steps[left] += 1
                stack.step(grads, y.shape[-1], rate, alpha, momentum, steps[left][:, None, None])
                sse += miss
            told[left, 0, epoch], told[left, 1, epoch] = sse, pen * seen
            done[left] += 1
            samples[left] += total
            ended = done[left] >= np.array([plans[i].max_iter for i in left])
            if alone:
                loss = 0.5 * (sse + alpha[:, 0, 0] * pen) / seen
                stale[left] = np.where(loss > best[left] - column("tol")[:, 0, 0], stale[left] + 1, 0)
                best[left] = np.minimum(best[left], loss)
                ended |= (stale[left] > column("patience")[:, 0, 0]) | ~np.isfinite(loss)
            if ended.any():
                hand_over(ended)
                stack.keep(np.flatnonzero(~ended))
                left = left[~ended]
                if not len(left):
                    break
        if len(left):
            hand_over(np.ones(len(left), bool))
        yield from out.items()

    return summed(dealt.rows, task, max(shards.values()) <= DIRECT)


Retry = Callable[[int, "Fit"], tuple[Network, Training] | None]


def train_keyed(rows: DataFrame, width: int, jobs: Sequence[tuple[int, Network, Training]], cache: bool = True,
                shards: int | None = None, sync: int | None = None, retry: Retry | None = None) -> list[list[Fit]]:
    """Train networks (key, start, settings) on rows (key, x, y) of their key, in one loop for all keys.

    A round is ``sync`` epochs, after which the weights of a key's shards are averaged; AVERAGED by default,
    SYNC where every key has one shard (which changes nothing but the number of jobs), 1 for full batches.
    A network of several shards can go on for some epochs of the round in which its losses end its training.
    A network whose training ends is scored; ``retry`` may then name another start, which takes its place in
    the next round. Returns all fits of each job, the last one last.
    """
    wanted: dict[int, int] = {}
    for key, *_ in jobs:
        wanted[key] = wanted.get(key, 0) + 1
    dealt = _deal(rows, width, wanted, shards, cache)
    # networks of like widths share a group
    numbers = {key: {i: n for n, i in enumerate(sorted((i for i, j in enumerate(jobs) if j[0] == key),
                                                       key=lambda i: (len(jobs[i][1].sizes), jobs[i][1].sizes)))}
               for key in wanted}
    try:
        fits: list[list[Fit]] = [[] for _ in jobs]
        active: dict[int, _Task] = {}

        def begin(i: int, network: Network, plan: Training) -> None:
            key = jobs[i][0]
            if key in dealt.counts:
                fits[i].append(Fit(network))
                group = numbers[key][i] * dealt.groups[key] // wanted[key]
                active[i] = _Task(key, group, fits[i][-1], plan, _State.fresh(network.flat()))

        def close(ended: dict[int, _Task]) -> None:
            for i, score in _unit_scores(dealt, ended).items():
                ended[i].fit.score = score
                again = retry(i, ended[i].fit) if retry else None
                if again:
                    begin(i, *again)

        for i, (_, network, plan) in enumerate(jobs):
            begin(i, network, plan)
        unused = {i: active.pop(i) for i in [i for i, t in active.items() if t.plan.max_iter <= 0]}
        if unused:
            close(unused)
        while active:
            single = all(dealt.shards[t.key] == 1 for t in active.values())
            epochs = sync or (SYNC if single else AVERAGED)
            epochs = epochs if all(t.plan.batch_size for t in active.values()) else 1
            made = _round(dealt, active, epochs)
            ended = {}
            for i, t in list(active.items()):
                if not _learned(t, made[i], epochs, dealt.counts[t.key]):
                    ended[i] = active.pop(i)
            if ended:
                close(ended)
        return fits
    finally:
        if cache:
            dealt.rows.unpersist()


def _learned(t: _Task, part: np.ndarray, epochs: int, n: int) -> bool:
    """Puts a round's result into ``t``; False where its training ends."""
    net, how, size = t.fit.network, t.plan, len(t.state.w)
    if how.batch_size is None:
        sse, pen = part[size + 1], part[size + 2] / n
        t.state.step((part[:size] + how.alpha * net.mask() * t.state.w) / n, how)
        t.state.samples += n
        going = t.told(0.5 * (sse + how.alpha * pen) / n)
    else:
        vector, told, done = part[:3 * size + 1] / n, part[3 * size + 2:-1].reshape(2, epochs), round(part[-1] / n)
        t.state = _State.from_vector(vector, t.state.samples + n * done)
        going = True
        for sse, pen in told[:, :done].T:
            going = t.told(0.5 * (sse + how.alpha * pen / n) / n) and going
    t.fit.network = Network.from_flat(net.sizes, net.activation, t.state.w)
    return going


def train_networks(df: DataFrame, x: Sequence[str], y: str, networks: Sequence[Network],
                   plans: Sequence[Training], cache: bool = True, shards: int | None = None) -> list[Fit]:
    """Train all networks together; each stops on its own settings, the passes are shared.

    A loss that is not finite (a learning rate too large) is an error.
    """
    rows = training_rows(df, x, y).select(F.lit(0).alias("key"), "x", "y")
    made = train_keyed(rows, len(x), [(0, n, p) for n, p in zip(networks, plans)], cache, shards)
    return [fits[-1] for fits in made]


def _unit_scores(dealt: _Dealt, tasks: dict[int, _Task]) -> dict[int, dict[str, float]]:
    """Scores of networks on the rows of their key, which their own group reads."""
    units, width = dealt.units, dealt.width
    nets = {i: (t.key, t.group, t.fit.network) for i, t in tasks.items()}

    def task(batches: Batches) -> Iterator[tuple[int, np.ndarray]]:
        for unit, own in groupby(_blocks(batches, width), key=itemgetter(0)):
            key, _, group = units[unit]
            blocks = [b[2:] for b in own]
            for i, (k, g, net) in nets.items():
                if (k, g) == (key, group):
                    miss = [net.predict(x) - y for x, y in blocks]
                    yield i, np.array([sum((m ** 2).sum() for m in miss), sum(np.abs(m).sum() for m in miss)])
            if group == 0:  # once per row: what the scores of the key are measured by
                count = sum(len(y) for _, y in blocks)
                mean = sum(y.sum() for _, y in blocks) / count
                spread = sum(((y - mean) ** 2).sum() for _, y in blocks)
                low, high = min(y.min() for _, y in blocks), max(y.max() for _, y in blocks)
                yield -1, np.array([key, count, mean, spread, low, high])

    parts = partial_rows(dealt.rows, task).collect()
    sums: dict[int, np.ndarray] = {}
    of_key: dict[int, list[np.ndarray]] = {}
    for r in parts:
        part = np.array(r["part"])
        if r["key"] < 0:
            of_key.setdefault(int(part[0]), []).append(part[1:])
        else:
            sums[r["key"]] = sums.get(r["key"], 0.0) + part
    out = {}
    for i, (key, _, _) in nets.items():
        count, mean, spread, low, high = np.array(of_key[key]).T
        n, middle = int(count.sum()), float(count @ mean / count.sum())
        out[i] = _score(n, float(spread.sum() + count @ (mean - middle) ** 2) / n, float(high.max() - low.min()), *sums[i])
    return out


def _score(n: int, variance: float, spread: float, sse: float, sae: float) -> dict[str, float]:
    sse, sae = float(sse), float(sae)
    mae, rmse = sae / n, float(np.sqrt(sse / n))
    return {"n": n, "sse": sse, "mae": mae, "rmse": rmse, "r2": 1 - sse / (n * variance) if variance else float("nan"),
            "nmae": mae / spread * 100 if spread else float("nan"), "nrmse": rmse / spread * 100 if spread else float("nan")}


def _scores(rows: DataFrame, width: int, networks: Sequence[Network]) -> list[dict[str, float]]:
    """R2, MAE, RMSE and range-normalised forms of many networks in one pass."""
    stats = rows.agg(F.count("y"), F.var_pop("y"), F.max("y") - F.min("y")).first()
    n, variance, spread = int(stats[0]), stats[1], stats[2]
    if not n:
        raise ValueError("no complete rows to score")

    def task(batches: Batches) -> Iterator[tuple[int, np.ndarray]]:
        acc = np.zeros((len(networks), 2))
        for batch in batches:
            x, y = matrix(batch, "x", width), vector(batch, "y")
            for i, net in enumerate(networks):
                miss = net.predict(x) - y
                acc[i] += (miss ** 2).sum(), np.abs(miss).sum()
        for i in range(len(networks)):
            yield i, acc[i]

    made = summed(rows, task)
    return [_score(n, variance, spread, *made[i]) for i in range(len(networks))]


def score_networks(df: DataFrame, x: Sequence[str], y: str, networks: Sequence[Network]) -> list[dict[str, float]]:
    return _scores(training_rows(df, x, y), len(x), networks)


@dataclass
class Trained:
    """A network with the scaler its inputs need."""

    network: Network
    scaler: Scaler
    r2: float
    losses: list[float]


# Settings of a plain training run.
TRAIN_PLAN = Training(tol=1e-5, patience=200)


def mlp_train(df: DataFrame, x: Sequence[str], y: str, n_layers: int, n_neurons: int, max_iter: int = 200,
              plan: Training = TRAIN_PLAN, activation: str = "relu") -> Trained:
    """Scale the inputs, train ``n_layers`` of ``n_neurons`` and score on the training rows."""
    rows = drop_incomplete(df, [*x, y])
    scaler = scaler_fit(rows, x)
    start = Network.create(len(x), [n_neurons] * n_layers, activation, plan.seed)
    fit = train_networks(scaler.transform(rows), x, y, [start], [replace(plan, max_iter=max_iter)])[0]
    return Trained(fit.network, scaler, fit.r2, fit.losses)


def mlp_train_seasonal(df: DataFrame, x: Sequence[str], y: str, n_layers: int, n_neurons: int, max_iter: int = 2000,
                       target: float = 0.8, attempts: int = 5, dt: str = "dt", plan: Training = TRAIN_PLAN,
                       activation: str = "relu") -> dict[str, Trained]:
    """One model per block of months; new seeds until the target R2, at most ``attempts`` times.

    All blocks are trained in the same loop, each on its own rows with its own scaler, attempt and stop;
    one grouped aggregate gives all scalers. The best attempt of a block is kept, the earlier one on a tie.
    """
    names = list(TRAINING_BLOCKS)
    key = F.coalesce(*[F.when(F.col("block") == name, F.lit(i)) for i, name in enumerate(names)])
    rows = drop_incomplete(df.select(*dict.fromkeys([*x, y, dt])), [*x, y]).withColumn("block", training_block(F.col(dt)))
    rows = rows.where(F.col("block").isNotNull()).withColumn("key", key)
    found = scalers_by(rows, "key", x)

    def scaled(c: str):
        value = F.col(c).cast("double")
        return F.coalesce(*[F.when(F.col("key") == k, (value - F.lit(s.mean(c))) / F.lit(s.scale(c))) for k, s in found.items()])

    if not found:
        return {}
    ready = rows.select("key", F.array(*[scaled(c) for c in x]).alias("x"), F.col(y).cast("double").alias("y"))
    keys, tries = sorted(found), dict.fromkeys(found, 1)
    plan = replace(plan, max_iter=max_iter)

    def start(seed: int) -> tuple[Network, Training]:
        return Network.create(len(x), [n_neurons] * n_layers, activation, seed), replace(plan, seed=seed)

    def retry(job: int, fit: Fit) -> tuple[Network, Training] | None:
        k = keys[job]
        if fit.r2 >= target or tries[k] >= attempts:
            return None
        tries[k] += 1
        return start(plan.seed + tries[k] - 1)

    made = train_keyed(ready, len(x), [(k, *start(plan.seed)) for k in keys], retry=retry)
    out = {}
    for k, fits in zip(keys, made):
        best = max(fits, key=lambda f: f.r2)
        out[names[k]] = Trained(best.network, found[k], best.r2, best.losses)
    return out


def mlp_predict(df: DataFrame, network: Network, x: Sequence[str], scaler: Scaler | None = None,
                name: str = "prediction") -> DataFrame:
    """Predictions beside the rows, for a network of any size; NULL where an input is missing or not finite."""
    scale = dict(zip(scaler.columns, zip(scaler.means, scaler.scales))) if scaler else {}
    raw = {c: F.col(c).cast("double") for c in x}
    inputs = [(v - F.lit(scale[c][0])) / F.lit(scale[c][1]) if c in scale else v for c, v in raw.items()]
    whole = reduce(and_, (F.coalesce(finite(v), F.lit(False)) for v in raw.values()))
    width = len(x)

    @F.arrow_udf("double")
    def run(block: pa.Array) -> pa.Array:
        out = np.zeros(len(block))
        known = block.is_valid().to_numpy(zero_copy_only=False)
        if known.any():
            flat = block.drop_null().flatten().to_numpy(zero_copy_only=False)
            out[known] = network.predict(flat.reshape(-1, width))
        return pa.array(out, pa.float64(), mask=~known)

    return df.withColumn(name, run(F.when(whole, F.array(*inputs))))


def _curves(df: DataFrame, labels: Sequence[str], fits: Sequence[Fit]) -> DataFrame:
    rows = [(label, epoch, float(loss), float(fit.r2), fit.epochs)
            for label, fit in zip(labels, fits) for epoch, loss in enumerate(fit.losses, start=1)]
    return df.sparkSession.createDataFrame(rows, "label string, epoch int, loss double, r2 double, epochs int")


def _sweep(df: DataFrame, x: Sequence[str], y: str, settings: Sequence[tuple[str, Sequence[int], str, Training]],
           scale: bool) -> DataFrame:
    rows = drop_incomplete(df.select(*x, y))
    rows = minmax_scale(rows, [*x, y]) if scale else rows
    nets = [Network.create(len(x), hidden, act, plan.seed) for _, hidden, act, plan in settings]
    fits = train_networks(rows, x, y, nets, [plan for *_, plan in settings])
    return _curves(df, [label for label, *_ in settings], fits)


def mlp_sweep_activation(df: DataFrame, x: Sequence[str], y: str, max_iter: int = 100, seed: int = 0) -> DataFrame:
    """Loss per epoch for each activation, two layers of ten, on 0-1 scaled data."""
    plan = Training(learning_rate=0.01, max_iter=max_iter, patience=max_iter, seed=seed)
    return _sweep(df, x, y, [(a, (10, 10), a, plan) for a in ("identity", "logistic", "tanh", "relu")], True)


def mlp_sweep_layers(df: DataFrame, x: Sequence[str], y: str, max_iter: int = 100, seed: int = 0) -> DataFrame:
    """Loss per epoch for one, two and three layers of ten logistic units, on 0-1 scaled data."""
    plan = Training(learning_rate=0.01, max_iter=max_iter, patience=max_iter, seed=seed)
    shapes = [(10,), (10, 10), (10, 10, 10)]
    return _sweep(df, x, y, [(f"{len(s)} layers", s, "logistic", plan) for s in shapes], True)


def mlp_sweep_solver(df: DataFrame, x: Sequence[str], y: str, max_iter: int = 5000, patience: int = 1000,
                     scale: bool = False, seed: int = 0) -> DataFrame:
    """Loss per epoch for four forms of SGD and Adam, two layers of twenty logistic units."""
    base = Training(solver="sgd", learning_rate=0.05, max_iter=max_iter, patience=patience, seed=seed)
    plans = [replace(base, momentum=m, schedule=s) for m in (0.0, base.momentum) for s in ("constant", "invscaling")]
    plans.append(replace(base, solver="adam"))
    return _sweep(df, x, y, [(_label(p), (20, 20), "logistic", p) for p in plans], scale)


def _label(plan: Training) -> str:
    if plan.solver == "adam":
        return "adam"
    return f"{plan.solver}, {plan.schedule}, momentum {plan.momentum:g}"


def grid_parameter_count(n_input: int, n1: int, n2: int) -> int:
    """The count used in the BIC grid (not the true number of weights)."""
    return n_input + 2 * (n1 + n2) + 2


def true_parameter_count(n_input: int, hidden: Sequence[int]) -> int:
    sizes = [n_input, *hidden, 1]
    return sum((a + 1) * b for a, b in zip(sizes[:-1], sizes[1:]))


def mlp_bic_grid(df: DataFrame, x: Sequence[str], y: str, neurons: Sequence[int] = tuple(range(2, 20)),
                 max_iter: int = 1000, seed: int = 0, true_params: bool = False) -> DataFrame:
    """BIC and its distance to the best for every pair of layer widths; all fits share each pass."""
    pairs = [(a, b) for a in neurons for b in neurons]
    plan = Training(learning_rate=0.01, tol=1e-3, patience=100, max_iter=max_iter, seed=seed)
    nets = [Network.create(len(x), pair, "tanh", seed) for pair in pairs]
    fits = train_networks(df, x, y, nets, [plan] * len(pairs))
    made = []
    for (a, b), fit in zip(pairs, fits):
        score = fit.score
        p = true_parameter_count(len(x), (a, b)) if true_params else grid_parameter_count(len(x), a, b)
        made.append((a, b, p, float(score["n"] * np.log(score["sse"] / score["n"]) + p * np.log(score["n"])),
                     float(fit.r2)))
    least = min(m[3] for m in made)
    return df.sparkSession.createDataFrame(
        [(*m[:4], m[3] - least, m[4]) for m in made],
        "n1 int, n2 int, p int, bic double, delta double, r2 double")


def mlp_best_of(train: DataFrame, valid: DataFrame, x: Sequence[str], y: str, n: int, max_iter: int = 5000,
                seed: int = 0) -> tuple[Network, DataFrame]:
    """Train ``n`` starts together, keep the one with the least validation nMAE; all runs are reported."""
    plan = Training(learning_rate=0.1, tol=1e-3, patience=500, max_iter=max_iter)
    plans = [replace(plan, seed=seed + i) for i in range(n)]
    fits = train_networks(train, x, y, [Network.create(len(x), (6, 4), "tanh", p.seed) for p in plans], plans)
    scored = score_networks(valid, x, y, [f.network for f in fits])
    best = int(np.argmin([s["nmae"] for s in scored]))
    rows = [(i, float(f.r2), float(s["nmae"]), float(s["nrmse"]), i == best)
            for i, (f, s) in enumerate(zip(fits, scored))]
    report = train.sparkSession.createDataFrame(
        rows, "run int, train_r2 double, nmae double, nrmse double, best boolean")
    return fits[best].network, report
