"""Gaussian mixtures (diagonal, spherical, full) fitted by EM over partitions.

Each iteration is one Spark job: tasks turn their rows into sufficient
statistics (weights, sums, squared sums per component) and Spark adds them up.
The parameters, a few hundred numbers, live on the driver, so the lineage does
not grow with the iterations and a lost executor costs only its own tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insolara.functions.nulls import finite
from insolara.operators.partials import Batches, matrix, summed
from insolara.operators.reshape import DAYTIME, profile_vector

# Variance floor and gain limit that end an EM run.
VARIANCE_FLOOR = 1e-6
GAIN_LIMIT = 1e-3
KINDS = ("diag", "spherical", "full")


@dataclass
class Mixture:
    """Weights (k), means (k, d) and variances: (k, d), or (k, d, d) for ``full``."""

    kind: str
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    loglik: float = float("nan")
    history: list[float] = field(default_factory=list)
    rows: int = 0

    @property
    def k(self) -> int:
        return len(self.weights)

    @property
    def width(self) -> int:
        return self.means.shape[1]

    def parameter_count(self) -> int:
        k, d = self.k, self.width
        spread = {"diag": k * d, "spherical": k, "full": k * d * (d + 1) // 2}[self.kind]
        return spread + k * d + k - 1

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """log(weight * density), one column per component."""
        out = np.empty((len(x), self.k))
        for j in range(self.k):
            gap = x - self.means[j]
            if self.kind == "full":
                factor = np.linalg.cholesky(self.variances[j])
                scaled = np.linalg.solve(factor, gap.T)
                log_det = 2.0 * np.log(np.diag(factor)).sum()
                quad = (scaled ** 2).sum(axis=0)
            else:
                log_det = np.log(self.variances[j]).sum()
                quad = (gap ** 2 / self.variances[j]).sum(axis=1)
            out[:, j] = np.log(self.weights[j]) - 0.5 * (x.shape[1] * math.log(2 * math.pi) + log_det + quad)
        return out

    def ordered(self) -> "Mixture":
        """Components sorted by their first mean, so labels do not depend on the start."""
        order = np.lexsort(self.means.T[::-1])
        return Mixture(self.kind, self.weights[order], self.means[order], self.variances[order],
                       self.loglik, self.history, self.rows)


def _log_sum(values: np.ndarray) -> np.ndarray:
    top = values.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(values - top).sum(axis=1, keepdims=True)))[:, 0]


def vectors(df: DataFrame, column: str, width: int) -> DataFrame:
    """Complete vectors as ``x``; rows with a missing or non-finite entry are left out."""
    return df.withColumn("x", whole_vector(F.col(column), width)).where(F.col("x").isNotNull())


def _stat_size(kind: str, width: int) -> int:
    return 1 + width + (width * width if kind == "full" else width)


def _pack(kind: str, resp: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Per component: sum of weights, of weighted rows and of weighted squares."""
    out = np.empty((resp.shape[1], _stat_size(kind, x.shape[1])))
    out[:, 0] = resp.sum(axis=0)
    out[:, 1:1 + x.shape[1]] = resp.T @ x
    if kind == "full":
        for j in range(resp.shape[1]):
            out[j, 1 + x.shape[1]:] = ((x * resp[:, j:j + 1]).T @ x).ravel()
    else:
        out[:, 1 + x.shape[1]:] = resp.T @ (x * x)
    return out


def _maximise(kind: str, stats: np.ndarray, shift: np.ndarray) -> Mixture:
    """New parameters from summed statistics of rows shifted by ``shift``."""
    k, width = len(stats), len(shift)
    mass = np.maximum(stats[:, 0], 10 * np.finfo(float).eps)
    means = stats[:, 1:1 + width] / mass[:, None]
    if kind == "full":
        second = stats[:, 1 + width:].reshape(k, width, width) / mass[:, None, None]
        spread = second - np.einsum("ki,kj->kij", means, means) + VARIANCE_FLOOR * np.eye(width)
    else:
        spread = np.maximum(stats[:, 1 + width:] / mass[:, None] - means ** 2, 0.0) + VARIANCE_FLOOR
        if kind == "spherical":
            spread = np.repeat(spread.mean(axis=1, keepdims=True), width, axis=1)
    return Mixture(kind, mass / mass.sum(), means + shift, spread)


def em_pass(rows: DataFrame, models: Sequence[Mixture], shift: np.ndarray) -> list[tuple[Mixture, float, int]]:
    """One E and M step for several mixtures in a single pass.

    Returns each update with the mean log-likelihood before it and the number of rows.
    """
    width = models[0].width

    def task(batches: Batches) -> Iterator[tuple[int, np.ndarray]]:
        sums = [np.zeros((m.k, _stat_size(m.kind, width))) for m in models]
        tail = np.zeros((len(models), 2))
        for batch in batches:
            x = matrix(batch, "x", width)
            for i, model in enumerate(models):
                logs = model.log_density(x)
                norm = _log_sum(logs)
                sums[i] += _pack(model.kind, np.exp(logs - norm[:, None]), x - shift)
                tail[i] += norm.sum(), len(x)
        for i in range(len(models)):
            yield i, np.concatenate([sums[i].ravel(), tail[i]])

    totals = summed(rows.select("x"), task)
    out = []
    for i, model in enumerate(models):
        part = totals[i]
        update = _maximise(model.kind, part[:-2].reshape(model.k, -1), shift)
        out.append((update, float(part[-2] / part[-1]), int(part[-1])))
    return out


def center(rows: DataFrame, width: int) -> np.ndarray:
    """Column means; sums of squares are taken around them to keep their digits."""
    def task(batches: Batches) -> Iterator[tuple[int, np.ndarray]]:
        acc = np.zeros(width + 1)
        for batch in batches:
            x = matrix(batch, "x", width)
            acc[0] += len(x)
            acc[1:] += x.sum(axis=0)
        yield 0, acc

    total = summed(rows.select("x"), task)[0]
    if total[0] == 0:
        raise ValueError("no complete vectors")
    return total[1:] / total[0]


def start_bands(rows: DataFrame, width: int, k: int, kind: str, shift: np.ndarray) -> Mixture:
    """Deterministic start: rows fall into k equal bands of their mean value; empty bands borrow the overall spread."""
    level = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / width
    low, high = rows.agg(F.min(level), F.max(level)).first()
    low, high = float(low), float(high)
    step = (high - low) / k or 1.0

    def task(batches: Batches) -> Iterator[tuple[int, np.ndarray]]:
        acc = np.zeros((k, _stat_size(kind, width)))
        for batch in batches:
            x = matrix(batch, "x", width)
            band = np.clip(((x.sum(axis=1) / width - low) / step).astype(int), 0, k - 1)
            acc += _pack(kind, np.eye(k)[band], x - shift)
        yield 0, acc.ravel()

    stats = summed(rows.select("x"), task)[0].reshape(k, -1)
    return _from_start(kind, stats, shift)


# Rounds in which candidate centres are drawn, candidates of a round per wanted cluster, and the move that counts as rest.
SEED_ROUNDS, OVERSAMPLING, REST = 5, 2, 1e-4


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre and squared distance to it."""
    gaps = (x ** 2).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers ** 2).sum(axis=1)
    near = gaps.argmin(axis=1)
    return near, np.maximum(gaps[np.arange(len(x)), near], 0.0)


def candidate_centers(rows: DataFrame, width: int, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates for centres and how many rows are nearest to each (k-means||); one pass per round, whatever ``most``.

    A round draws OVERSAMPLING * ``most`` rows, each with a chance in proportion to its squared distance from
    the candidates so far: the rows with the least -ln(u) / distance, where u is a hash of the row's values.
    """
    marked = rows.select("x", F.xxhash64("x", F.lit(seed)).alias("mark"))
    first = marked.orderBy("mark", "x").limit(1).collect()
    if not first:
        raise ValueError("no complete vectors")
    centers, size = np.array([first[0]["x"]]), OVERSAMPLING * most
    for number in range(SEED_ROUNDS):
        so_far = centers

        def draw(batches: Batches) -> Batches:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for batch in batches:
                x, mark = matrix(batch, "x", width), batch.column("mark").to_numpy()
                gap = _nearest(x, so_far)[1]
                chance = np.array([np.random.default_rng([int(m) & (1 << 64) - 1, number]).random() for m in mark[gap > 0]])
                held.append((-np.log1p(-chance) / gap[gap > 0], x[gap > 0]))
                keys, kept = (np.concatenate(part) for part in zip(*held))
                best = np.argsort(keys, kind="stable")[:size]
                held = [(keys[best], kept[best])]
            if held and len(held[0][0]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held[0][0]), pa.array(list(held[0][1]), pa.list_(pa.float64()))], names=["chance", "x"])

        drawn = marked.mapInArrow(draw, "chance double, x array<double>").orderBy("chance", "x").limit(size).collect()
        if not drawn:
            break
        centers = np.unique(np.concatenate([centers, np.array([r["x"] for r in drawn])]), axis=0)

    def weigh(batches: Batches) -> Iterator[tuple[int, np.ndarray]]:
        acc = np.zeros(len(centers))
        for batch in batches:
            acc += np.bincount(_nearest(matrix(batch, "x", width), centers)[0], minlength=len(centers))
        yield 0, acc

    return centers, summed(rows.select("x"), weigh)[0]


def _spread_centers(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ and a few rounds of k-means on weighted candidates, of which there are few."""
    rng = np.random.default_rng([seed, k])
    centers = points[[rng.choice(len(points), p=weights / weights.sum())]]
    while len(centers) < k:
        pull = weights * _nearest(points, centers)[1]
        share = pull / pull.sum() if pull.sum() > 0 else weights / weights.sum()
        centers = np.concatenate([centers, points[[rng.choice(len(points), p=share)]]])
    for _ in range(30):
        near = _nearest(points, centers)[0]
        mass = np.bincount(near, weights, k)
        sums = np.stack([np.bincount(near, weights * c, k) for c in points.T], axis=1)
        centers = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-300)[:, None], centers)
    return centers


def start_kmeans(rows: DataFrame, width: int, counts: Sequence[int], kind: str, shift: np.ndarray, seed: int,
                 max_iter: int = 100) -> list[Mixture]:
    """Starts from k-means for several cluster counts: candidates, and every round of k-means, are one pass for all counts.

    A set of centres ends when it rests or after ``max_iter`` rounds.
    """
    points, weights = candidate_centers(rows, width, max(counts), seed)
    sets = [_spread_centers(points - shift, weights, k, seed) for k in counts]
    moving, stats = list(range(len(sets))), [np.empty(0)] * len(sets)
    for number in range(max_iter + 1):
        now = [(i, sets[i]) for i in moving]

        def task(batches: Batches) -> Iterator[tuple[int, np.ndarray]]:
            acc = [np.zeros((len(c), _stat_size(kind, width))) for _, c in now]
            for batch in batches:
                x = matrix(batch, "x", width) - shift
                for part, (_, centers) in zip(acc, now):
                    part += _pack(kind, np.eye(len(centers))[_nearest(x, centers)[0]], x)
            for part, (i, _) in zip(acc, now):
                yield i, part.ravel()

        made, going = summed(rows.select("x"), task), []
        for i in moving:
            stats[i] = made[i].reshape(len(sets[i]), -1)
            mass = stats[i][:, :1]
            moved = np.where(mass > 0, stats[i][:, 1:1 + width] / np.maximum(mass, 1e-300), sets[i])
            if number < max_iter and ((moved - sets[i]) ** 2).sum() > REST ** 2 * max(1.0, (moved ** 2).sum()):
                going.append(i)
                sets[i] = moved
        moving = going
        if not moving:
            break
    return [_from_start(kind, s, shift) for s in stats]


def _from_start(kind: str, stats: np.ndarray, shift: np.ndarray) -> Mixture:
    total = stats.sum(axis=0, keepdims=True)
    empty = stats[:, 0] == 0
    filled = np.where(empty[:, None], total / total[0, 0], stats)
    return _maximise(kind, filled, shift)


def gmm_fit(df: DataFrame, column: str, width: int, k: int, max_iter: int = 100, kind: str = "diag",
            start: str | Mixture = "kmeans", seed: int = 0, gain: float = GAIN_LIMIT) -> Mixture:
    """Fit a mixture to an array column."""
    return gmm_fit_many(df, column, width, [k], max_iter, kind, start, seed, gain)[0]


def gmm_fit_many(df: DataFrame, column: str, width: int, counts: Sequence[int], max_iter: int = 100,
                 kind: str = "diag", start: str | Mixture = "kmeans", seed: int = 0,
                 gain: float = GAIN_LIMIT) -> list[Mixture]:
    """Fit several cluster counts together: every iteration reads the rows once for all of them."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    rows = vectors(df, column, width).select("x").persist()
    try:
        shift = center(rows, width)
        if isinstance(start, Mixture):
            models = [start for _ in counts]
        elif start == "bands":
            models = [start_bands(rows, width, k, kind, shift) for k in counts]
        else:
            models = start_kmeans(rows, width, counts, kind, shift, seed, max(1, max_iter))
        histories: list[list[float]] = [[] for _ in models]
        active = list(range(len(models)))
        for _ in range(max_iter):
            updates = em_pass(rows, [models[i] for i in active], shift)
            going = []
            for i, (update, loglik, _) in zip(active, updates):
                settled = len(histories[i]) > 0 and loglik - histories[i][-1] < gain
                histories[i].append(loglik)
                models[i] = update
                if not settled:
                    going.append(i)
            active = going
            if not active:
                break
        finals = em_pass(rows, models, shift)
        for model, history, (_, loglik, n) in zip(models, histories, finals):
            model.loglik, model.rows = loglik, n
            model.history = [*history, loglik]
        return [m.ordered() for m in models]
    finally:
        rows.unpersist()


def whole_vector(column: Column, width: int) -> Column:
    """The vector if it has ``width`` finite entries, else NULL; the rule of :func:`vectors`."""
    x = column.cast("array<double>")
    return F.when((F.size(x) == width) & F.forall(x, lambda v: F.coalesce(finite(v), F.lit(False))), x)


def gmm_predict(df: DataFrame, column: str, model: Mixture, name: str = "cluster") -> DataFrame:
    """Most likely cluster (from 0) of every row, for any kind and width of model.

    Vectors of another length or with a missing or non-finite entry get NULL.
    """
    width = model.width

    @F.arrow_udf("int")
    def label(x: pa.Array) -> pa.Array:
        out = np.zeros(len(x), np.int32)
        known = x.is_valid().to_numpy(zero_copy_only=False)
        if known.any():
            flat = x.drop_null().flatten().to_numpy(zero_copy_only=False)
            out[known] = model.log_density(flat.reshape(-1, width)).argmax(axis=1)
        return pa.array(out, pa.int32(), mask=~known)

    return df.withColumn(name, label(whole_vector(F.col(column), width)))


def gmm_bic(df: DataFrame, column: str, width: int, counts: Sequence[int] = tuple(range(1, 13)),
            kind: str = "spherical", max_iter: int = 100, start: str = "kmeans", seed: int = 0) -> DataFrame:
    """BIC per number of clusters: -2 log L + p ln n."""
    models = gmm_fit_many(df, column, width, counts, max_iter, kind, start, seed)
    rows = [(int(m.k), int(m.parameter_count()), float(m.loglik * m.rows),
             float(-2.0 * m.loglik * m.rows + m.parameter_count() * math.log(m.rows))) for m in models]
    return df.sparkSession.createDataFrame(rows, "k int, params int, loglik double, bic double")


def mixture_rows(spark, model: Mixture) -> DataFrame:
    """Parameters as rows ``cluster, weight, dim, mean, variance`` (the diagonal for ``full``)."""
    rows = []
    for j in range(model.k):
        spread = np.diag(model.variances[j]) if model.kind == "full" else model.variances[j]
        rows += [(j, float(model.weights[j]), d, float(model.means[j, d]), float(spread[d]))
                 for d in range(model.width)]
    return spark.createDataFrame(rows, "cluster int, weight double, dim int, mean double, variance double")


def cluster_counts(labelled: DataFrame, column: str = "cluster") -> DataFrame:
    return labelled.groupBy(column).agg(F.count("*").alias("n"))


def fit_profiles(df: DataFrame, key: str, value: str, k: int = 2, kind: str = "diag", max_iter: int = 100,
                 hours: Sequence[int] = DAYTIME, dt: str = "dt", start: str = "kmeans",
                 seed: int = 0) -> tuple[DataFrame, Mixture]:
    """Hourly profiles per key, a mixture over them and the label of every complete profile."""
    profiles = profile_vector(df, key, value, dt, hours)
    whole = profiles.where("complete")
    model = gmm_fit(whole, "profile", len(hours), k, max_iter, kind, start, seed)
    return gmm_predict(whole, "profile", model), model


def cluster_profile_means(labelled: DataFrame, hours: Sequence[int] = DAYTIME) -> DataFrame:
    """Mean member profile per cluster and hour: ``cluster, hour, mean, members``."""
    made = labelled.groupBy("cluster").agg(
        F.array(*[F.avg(F.col("profile")[i]) for i in range(len(hours))]).alias("_p"), F.count("*").alias("members"))
    names = F.array(*[F.lit(h) for h in hours])
    return (made.select("cluster", "members", F.posexplode("_p").alias("_i", "mean"))
            .select("cluster", F.get(names, F.col("_i")).alias("hour"), "mean", "members"))


def profile_plane(labelled: DataFrame, key: str, hours: Sequence[int] = DAYTIME, x_hour: int = 14,
                  y_hour: int = 10) -> DataFrame:
    """Two hours of each profile with its cluster."""
    at = list(hours)
    return labelled.select(key, F.col("profile")[at.index(x_hour)].alias("x"),
                           F.col("profile")[at.index(y_hour)].alias("y"), "cluster")
