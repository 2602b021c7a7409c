"""Masked pseudo-likelihood of documents under a small bidirectional network.

Every word is predicted from the two words on either side of it, itself masked. Frequent words of the
corpus have tokens of their own, all others share hashed ones. The network adds a linear map of the
four neighbours' embeddings, squashes it, and predicts the token in two steps: its frequency class,
then its place in that class. A document's score is the sum of the log-probabilities of its tokens.

Training passes over all documents once: in each round, tasks start from the same weights, each learns
from its own documents of that round, and the weights are averaged by tokens seen, piece by piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insolara.llm.common import SPACE, prepare, stored, text_of

Batches = Iterator[pa.RecordBatch]

CLASSES = 64
PLACES = 64
OWN = CLASSES * PLACES // 2
PAD = CLASSES * PLACES
REACH = 2
WIDTH, HIDDEN = 16, 32
BATCH = 8192
PIECE = 4096
TRAINERS = 64

# Fixed order of the weights in one flat vector: name and shape.
SHAPES = (("embed", (PAD + 1, WIDTH)), ("mix", (2 * REACH * WIDTH, HIDDEN)), ("shift", (HIDDEN,)),
          ("classes", (HIDDEN, CLASSES)), ("class_bias", (CLASSES,)), ("places", (CLASSES, PLACES, HIDDEN)),
          ("place_bias", (CLASSES, PLACES)))
SIZE = sum(int(np.prod(s)) for _, s in SHAPES)


class Vocabulary(dict):
    """Token of a word in bytes: its rank among the frequent ones, else a hashed place behind them."""

    def __missing__(self, word: bytes) -> int:
        return OWN + zlib.crc32(word) % (PAD - OWN)

    def tokens(self, text: str) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, text.encode("utf-8").split()), np.int64)


def vocabulary(docs: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The frequent words and the unigram log-probability of every token, counted over all texts."""
    lowered = F.lower(text_of())
    words = docs.select(F.explode_outer(F.split(F.trim(lowered, F.lit(" \t\n\x0b\x0c\r")), SPACE)).alias("w"))
    each = stored(words.filter("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    # how many words occur how often: gives the total, and the least count of a frequent word before any word is sorted
    spread = sorted(map(tuple, each.groupBy("n").agg(F.count(F.lit(1))).collect()), reverse=True)
    total, reached = sum(n * k for n, k in spread), accumulate(k for _, k in spread)
    least = next((n for (n, _), k in zip(spread, reached) if k >= OWN), 0)
    top = each.filter(F.col("n") >= least).orderBy(F.desc("n"), "w").limit(OWN)
    found = [(r["w"].encode("utf-8"), r["n"]) for r in top.collect()]
    counts = np.ones(PAD)
    counts[:len(found)] += [n for _, n in found]
    counts[OWN:] += (total - sum(n for _, n in found)) / (PAD - OWN)
    return Vocabulary((w, i) for i, (w, _) in enumerate(found)), np.log(counts / counts.sum())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The weights by name, as views of the flat vector."""
    out, at = {}, 0
    for name, shape in SHAPES:
        size = int(np.prod(shape))
        out[name] = flat[at:at + size].reshape(shape)
        at += size
    return out


def start_weights(unigrams: np.ndarray, seed: int) -> np.ndarray:
    """Small random weights whose biases alone predict the unigrams."""
    flat = np.random.default_rng(seed).normal(0, 0.1, SIZE).astype(np.float32)
    w = views(flat)
    logs = unigrams.reshape(CLASSES, PLACES)
    by_class = np.logaddexp.reduce(logs, axis=1)
    w["class_bias"][:], w["place_bias"][:], w["shift"][:] = by_class, logs - by_class[:, None], 0
    w["embed"][PAD] = 0
    return flat


@dataclass
class Windows:
    """All tokens of some documents with their neighbours, documents apart by padding."""

    stream: np.ndarray
    places: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Windows:
        pad = np.full(REACH, PAD, np.int64)
        stream = np.concatenate([pad, *(x for d in docs for x in (d, pad))])
        sizes = np.array([len(d) for d in docs], np.int64)
        starts = REACH + np.concatenate(([0], np.cumsum(sizes + REACH)[:-1])) if len(docs) else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(docs)), sizes)
        first = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(docs) else starts
        return cls(stream, starts[owner] + np.arange(len(owner)) - first[owner], owner)

    def around(self, places: np.ndarray) -> np.ndarray:
        steps = np.array([s for s in range(-REACH, REACH + 1) if s])
        return self.stream.take(places[:, None] + steps)


def _log_chances(z: np.ndarray, at: np.ndarray, slope: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-softmax of each row at its column ``at``; with ``slope``, the softmax less one at that column. Uses up ``z``."""
    rows = np.arange(len(z))
    z -= z[rows, z.argmax(axis=1)][:, None]  # sooner than max() for short rows
    chosen = z[rows, at]
    np.exp(z, out=z)
    total = z.sum(axis=1)
    if slope:
        z /= total[:, None]
        z[rows, at] -= 1
    return chosen - np.log(total), z if slope else None


def _by_key(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts small keys, and where each new one begins."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")  # a radix sort for short integers
    ordered = keys[order]
    return order, np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))


def forward(w: dict[str, np.ndarray], near: np.ndarray, token: np.ndarray, grad: dict[str, np.ndarray] | None = None
            ) -> np.ndarray:
    """Log-probability of each ``token`` given its neighbours; with ``grad``, that of the mean loss too."""
    n, learns = len(token), grad is not None
    # rows by class, so that the places of a class are one slice
    order, first = _by_key(token // PLACES)
    near, token = near.take(order, axis=0), token[order]
    kind, place = token // PLACES, token % PLACES
    x = w["embed"].take(near, axis=0).reshape(n, -1)
    h = x @ w["mix"]
    h += w["shift"]
    np.tanh(h, out=h)
    logs, dz = _log_chances(h @ w["classes"] + w["class_bias"], kind, learns)
    if learns:
        dz /= n
        grad["classes"][:], grad["class_bias"][:] = h.T @ dz, dz.sum(axis=0)
        grad["places"][:], grad["place_bias"][:] = 0, 0
        back = dz @ w["classes"].T
    slices = list(zip(kind[first].tolist(), first.tolist(), [*first[1:].tolist(), n]))
    # only the products go class by class, what follows them is done for all rows at once
    z = np.empty((n, PLACES), h.dtype)
    for c, start, end in slices:
        np.matmul(h[start:end], w["places"][c].T, out=z[start:end])
        z[start:end] += w["place_bias"][c]
    inner, dz = _log_chances(z, place, learns)
    logs += inner
    if learns:
        dz /= n
        for c, start, end in slices:
            own = dz[start:end]
            grad["places"][c], grad["place_bias"][c] = own.T @ h[start:end], own.sum(axis=0)
            back[start:end] += own @ w["places"][c]
        back *= 1 - h * h
        grad["mix"][:], grad["shift"][:] = x.T @ back, back.sum(axis=0)
        dx = (back @ w["mix"].T).reshape(-1, WIDTH)
        cells = near.reshape(-1, 1) * WIDTH + np.arange(WIDTH)
        grad["embed"][:] = np.bincount(cells.ravel(), dx.ravel(), minlength=(PAD + 1) * WIDTH).reshape(-1, WIDTH)
        grad["embed"][PAD] = 0
    out = np.empty_like(logs)
    out[order] = logs
    return out


def learn_windows(flat: np.ndarray, memory: np.ndarray, windows: Windows, rate: float, rng: np.random.Generator) -> None:
    """Adagrad steps over all windows in random order; changes ``flat`` and ``memory``."""
    gradient, step = np.zeros(SIZE, np.float32), np.empty(SIZE, np.float32)
    w, grad = views(flat), views(gradient)
    for at in np.array_split(rng.permutation(len(windows.places)), max(1, len(windows.places) // BATCH)):
        if len(at):
            places = windows.places[at]
            forward(w, windows.around(places), windows.stream[places], grad)
            memory += np.multiply(gradient, gradient, out=step)
            gradient *= rate
            gradient /= np.sqrt(memory, out=step)
            flat -= gradient


def document_scores(flat: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
    """Sum of the log-probabilities of each document's tokens; 0 for none."""
    windows, w = Windows.of(docs), views(flat)
    logs = np.zeros(len(windows.places))
    for at in range(0, len(logs), BATCH):
        places = windows.places[at:at + BATCH]
        logs[at:at + BATCH] = forward(w, windows.around(places), windows.stream[places])
    return np.bincount(windows.owner, weights=logs, minlength=len(docs))


@dataclass
class Model:
    words: Vocabulary
    weights: np.ndarray


def train(docs: DataFrame, rounds: int = 3, rate: float = 0.1, seed: int = 17, trainers: int | None = None) -> Model:
    """Learns from every document of ``docs(doc_id, text)`` once; an empty table gives the starting weights.

    At most ``trainers`` tasks learn in a round (as many as the cluster has cores, TRAINERS at least), so
    that the weights they send do not grow with the table; they are summed in pieces by many tasks, and
    one sum of the model's size reaches the driver.
    """
    spark = docs.sparkSession
    trainers = trainers or max(TRAINERS, spark.sparkContext.defaultParallelism)
    words, unigrams = vocabulary(docs)
    shared, flat = spark.sparkContext.broadcast(words), start_weights(unigrams, seed)
    share = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), F.lit(rounds))
    rows = docs.select(share.alias("share"), F.lower(text_of()).alias("text"))
    for number in range(rounds):
        sent = spark.sparkContext.broadcast(flat)

        def learn(batches: Batches, number: int = number, sent=sent) -> Batches:
            known = shared.value
            own, memory = sent.value.copy(), np.full(SIZE, 1e-4, np.float32)
            rng = np.random.default_rng((seed, number, TaskContext.get().partitionId()))
            seen = 0
            for batch in batches:
                windows = Windows.of([known.tokens(t.as_py()) for t in batch.column(0)])
                seen += len(windows.places)
                learn_windows(own, memory, windows, rate, rng)
            if seen:
                pieces = [own[i:i + PIECE] * np.float32(seen) for i in range(0, SIZE, PIECE)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(pieces)), pa.int32()), pa.array([float(seen)] * len(pieces)),
                     pa.array([p.tobytes() for p in pieces], pa.binary())], names=["piece", "seen", "part"])

        def add(key: tuple, found: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(p.as_py(), np.float32).astype(np.float64) for p in found.column("part")], axis=0)
            mean = (total / np.sum(found.column("seen").to_numpy())).astype(np.float32)
            return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([mean.tobytes()], pa.binary())})

        parts = rows.filter(F.col("share") == number).select("text").coalesce(trainers).mapInArrow(
            learn, "piece int, seen double, part binary")
        means = parts.groupBy("piece").applyInArrow(add, "piece int, part binary").collect()
        if means:
            flat = np.concatenate([np.frombuffer(r["part"], np.float32) for r in sorted(means, key=lambda r: r["piece"])])
    return Model(words, flat)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob) per row of ``docs(doc_id, text)``.

    NULL and empty texts have no tokens, log_prob 0 and a NULL mean. Repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a model of fixed size

    def run(batches: Batches) -> Batches:
        known = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                texts = [known.words.tokens(t.as_py()) for t in batch.column(1)[start:start + 500]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[start:start + 500], pa.array([len(t) for t in texts], pa.int64()),
                     pa.array(document_scores(known.weights, texts))], names=["doc_id", "n_tokens", "log_prob"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(text_of()).alias("text"))
    found = rows.mapInArrow(run, "doc_id long, n_tokens long, log_prob double")
    return found.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def pseudo_likelihood(docs: DataFrame, **settings) -> DataFrame:
    """Trains on ``docs`` and scores each of its rows; see :func:`train` and :func:`score`."""
    prepare(docs.sparkSession)
    return score(docs, train(docs, **settings))
