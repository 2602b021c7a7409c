"""Language identification by the nearest of several centroids per language.

A text becomes counts of hashed 1- to 3-grams of its lower-cased letters, damped, weighted by inverse
document frequency and normalised. Spherical k-means finds some centroids for each language; the
closest one by cosine names the language. A text whose cosine to all centroids is below a stated share of
the median cosine of the learned texts is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insolara.llm.common import prepare, stored, text_of
from insolara.operators.partials import summed

Batches = Iterator[pa.RecordBatch]

DIMS = 1 << 12
CHUNK = 1 << 18
UNSEEN = 1e-4

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams of letters, words apart by one blank; None without a letter."""
    letter, total = _is_letter(), np.zeros(DIMS, np.int64)
    found, before = False, np.array([32, 32], np.uint32)
    for at in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[at:at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letter[codes]
        found |= bool(is_letter.any())
        codes = np.concatenate((before, np.where(is_letter, codes, np.uint32(32))))
        blank = codes == 32
        keep = ~(blank[1:] & blank[:-1])
        keep[0] = True  # the two codes of the piece before stay
        codes = np.concatenate((codes[:1], codes[1:][keep]))
        one = codes * np.uint32(2654435761)
        two = one[1:] ^ (codes[:-1] * np.uint32(2246822519))
        three = two[1:] ^ (codes[:-2] * np.uint32(3266489917))
        for grams in (one[2:][codes[2:] != 32], two[1:], three):  # a blank alone tells nothing
            mixed = (grams ^ (grams >> np.uint32(15))) * np.uint32(2246822519)
            total += np.bincount(mixed >> np.uint32(20), minlength=DIMS)
        before = codes[-2:]
    return total if found else None


def gram_weights(seen: np.ndarray, n: float) -> np.ndarray:
    """Inverse document frequencies of grams seen in so many of ``n`` texts; never seen weighs alike for any ``n``."""
    return np.log1p(max(n, 1.0) / (seen + UNSEEN * max(n, 1.0))).astype(np.float32)


@dataclass
class Model:
    """Weights of the grams, unit centroids, the language of each, and the cosine below which texts are rejected."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    least: float

    def vector(self, counts: np.ndarray) -> np.ndarray:
        values = np.sqrt(counts, dtype=np.float32) * self.idf
        return values / max(float(np.linalg.norm(values)), 1e-12)

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Nearest language, its cosine, and whether the text is too far from it."""
        counts = gram_counts(text)
        if counts is None or not self.langs:
            return "und", 0.0, True
        near = self.centroids @ self.vector(counts)
        best = int(near.argmax())
        score = min(1.0, max(0.0, float(near[best])))
        return self.langs[best], score, score < self.least


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """At most ``k`` unit centroids; starts from rows far from those chosen before, drops empty clusters."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(rows)))]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int((rows @ rows[chosen].T).max(axis=1).argmin()))
    centres = rows[chosen]
    for _ in range(rounds):
        nearest = (rows @ centres.T).argmax(axis=1)
        sums = np.stack([rows[nearest == j].sum(axis=0) for j in range(len(centres)) if (nearest == j).any()])
        new = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        if new.shape == centres.shape and np.allclose(new, centres, atol=1e-6):
            break
        centres = new
    return centres


def held_out() -> Column:
    """crc32 of the decimal doc_id leaves remainder 2 by 4; false without doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, per_language: int = 3, sample_rows: int = 3000, rounds: int = 20, share: float = 0.125,
          seed: int = 11) -> Model:
    """Learns from ``docs(doc_id, text, lang)`` outside the held-out quarter, where lang is not NULL.

    Gram weights count all these documents. Centroids are fitted on about ``sample_rows`` of them at
    most, evenly over languages, chosen by a hash of doc_id; that is the documented bound of the fit.
    Texts without letters teach nothing; no labelled text at all gives a model that rejects everything.
    """
    rows = docs.filter(~held_out() & F.col("lang").isNotNull()).select(
        F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text"), F.col("lang").cast("string").alias("lang"))

    def seen(batches: Batches):
        total = np.zeros(DIMS + 1)
        for batch in batches:
            for text in batch.column(0):
                counts = gram_counts(text.as_py())
                if counts is not None:
                    total[:DIMS] += counts > 0
                    total[DIMS] += 1
        yield 0, total

    sums = summed(rows.select("text"), seen).get(0, np.zeros(DIMS + 1))
    idf = gram_weights(sums[:DIMS], sums[DIMS])
    langs = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    each = max(1, sample_rows // max(1, len(langs)))
    model = Model(idf, np.zeros((0, DIMS), np.float32), [], 0.0)
    if not langs:
        return model
    part = F.create_map(*(F.lit(x) for lang, n in langs.items() for x in (lang, min(1.0, each / n))))[F.col("lang")]
    order = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(1 << 32)) / float(1 << 32)

    def vectors(batches: Batches) -> Batches:
        for batch in batches:
            kept, out = [], []
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
                counts = gram_counts(text)
                if counts is not None:
                    kept.append(lang)
                    out.append(model.vector(counts).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(out, pa.binary())],
                                             names=["lang", "vector"])

    sample = rows.filter(order < part).select("text", "lang").mapInArrow(vectors, "lang string, vector binary")
    by_lang: dict[str, list[bytes]] = {}
    for lang, vector in sample.collect():
        by_lang.setdefault(lang, []).append(bytes(vector))
    centroids, own = [], []
    for lang in sorted(by_lang):
        matrix = np.stack([np.frombuffer(v, np.float16) for v in sorted(by_lang[lang])]).astype(np.float32)
        found = spherical_kmeans(matrix, per_language, rounds, seed)
        own.append((matrix @ found.T).max(axis=1))
        centroids.append(found)
        model.langs.extend([lang] * len(found))
    if centroids:
        model.centroids, model.least = np.concatenate(centroids).astype(np.float32), share * float(np.median(np.concatenate(own)))
    return model


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``__lang``, ``__score`` and ``__rejected``; reads the text only.

    NULL text, and text without a letter, is ``und`` with score 0 and rejected.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # languages x centroids x grams, whatever the data
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)), text_of().alias("__text"))

    def run(batches: Batches) -> Batches:
        known = shared.value
        for batch in batches:
            found = [known.predict(t.as_py()) for t in batch.column(len(names))]
            langs, scores, rejected = (list(x) for x in zip(*found)) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(rejected, pa.bool_())], names=[*names, "__lang", "__score", "__rejected"])

    schema = plain.drop("__text").schema.add("__lang", "string").add("__score", "double").add("__rejected", "boolean")
    return plain.mapInArrow(run, schema).select(
        *(F.col(n).alias(c) for c, n in zip(docs.columns, names)), "__lang", "__score", "__rejected")


def languages(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) per row of ``docs(doc_id, text, lang)``.

    ``lang_pred`` is the nearest learned language also where the text is rejected for its distance,
    ``und`` where it is NULL or has no letter. Repeated rows stay; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    model = learn(docs, **settings)
    marked = classify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"),
                      model)
    return marked.select("doc_id", "held_out", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"),
                         F.col("__rejected").alias("rejected"))


def known_languages(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns as they came."""
    prepare(docs.sparkSession)
    return classify(docs, learn(docs, **settings)).filter(~F.col("__rejected")).select(*(f"`{c}`" for c in docs.columns))
