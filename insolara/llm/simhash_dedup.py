"""Near-duplicate groups from SimHash fingerprints of word shingles.

Fingerprints are cut into blocks. Two of them that differ in at most ``radius`` bits agree on at
least ``blocks - radius`` blocks, so a join on every choice of that many blocks brings each close
pair together once at least; the Hamming distance is then verified. A join group is handled as a
run of sorted rows that yields a spanning forest of its verified links, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insolara.llm.common import prepare, shuffle_parts, stored, text_of
from insolara.llm.components import connected_components

Batches = Iterator[pa.RecordBatch]

SEED = 42
CHUNK = 1 << 16


def fingerprint(text: str, words: int = 4) -> int:
    """SimHash of the word shingles of one text (0 without words)."""
    terms = text.encode("utf-8").lower().split()
    if not terms:
        return 0
    joined = b" ".join(terms)
    ends = np.cumsum(np.fromiter(map(len, terms), np.int64, len(terms)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(terms) > words:
        starts, ends = starts[: len(terms) - words + 1], ends[words - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at:at + CHUNK].tolist(), ends[at:at + CHUNK].tolist())
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(votes * 2 > len(starts), bitorder="little")
    return int(set_bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) per document, fp as a signed 64-bit integer; NULL text counts as empty."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def block_masks(mask: int, blocks: int, radius: int) -> list[int]:
    """Masks over the bits outside ``mask``: every choice of blocks that a close pair may share."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = np.array_split(np.array(free), min(blocks, len(free)))
    parts = [sum(1 << int(i) for i in cut) for cut in cuts]
    return [mask | sum(chosen) for chosen in combinations(parts, len(parts) - radius)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def spanning_forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join the fingerprints within ``radius`` of each other, directly or in steps."""
    left, nodes, roots = np.arange(len(fps)), [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            near = np.bitwise_count(fps[left] ^ fps[front.pop()]) <= radius
            if near.any():
                found, left = left[near], left[~near]
                front.extend(found.tolist())
                nodes.append(found)
                roots.append(np.full(len(found), root))
    empty = np.empty(0, np.int64)
    nodes, roots = (np.concatenate(x) if x else empty for x in (nodes, roots))
    return fps[nodes], fps[roots]


def _link_runs(radius: int, group_rows: int):
    """Reads (mask, shared, fp) sorted by all three; yields links and the rows of too large groups."""

    def rows(a, b, mask):
        a, b = np.asarray(a, np.uint64).view(np.int64), np.asarray(b, np.uint64).view(np.int64)
        masks = pa.nulls(len(a), pa.int64()) if mask is None else pa.array(np.full(len(a), mask, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), masks], names=["a", "b", "mask"])

    def solve(mask, shared, fps):
        """Links of whole groups, the pairs of two all at once."""
        starts = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (shared[1:] != shared[:-1]))))
        sizes = np.diff(np.append(starts, len(mask)))
        two = starts[sizes == 2]
        close = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
        found = [(fps[close], fps[close + 1])]
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            found.append(spanning_forest(fps[start:start + size], radius))
        return tuple(np.concatenate(x) for x in zip(*found))

    def run(batches: Batches) -> Batches:
        held = [np.empty(0, np.int64)] * 3
        large = None  # the group whose rows are passed on, being larger than group_rows
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if large is not None:
                same = (new[0] == large[0]) & (new[1] == large[1])
                if same.any():
                    yield rows(new[2][same], new[2][same], large[0])
                    new = [x[~same] for x in new]
                if same.all():
                    continue
                large = None
            held = [np.concatenate(x) for x in zip(held, new)]
            if not len(held[0]):
                continue
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            at = len(last) - int(last.sum())
            if at:
                a, b = solve(held[0][:at], held[1][:at], held[2][:at].view(np.uint64))
                yield rows(a, b, None)
                held = [x[at:] for x in held]
            if len(held[0]) > group_rows:
                large = (held[0][0], held[1][0])
                yield rows(held[2], held[2], large[0])
                held = [x[:0] for x in held]
        if len(held[0]):
            a, b = solve(held[0], held[1], held[2].view(np.uint64))
            yield rows(a, b, None)

    return run


def fingerprint_links(distinct: DataFrame, radius: int = 4, blocks: int = 7, group_rows: int = 32_768) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that join all within ``radius`` bits.

    The links form, within every join group, a spanning forest of the close pairs: two fingerprints
    are joined by a path of links exactly if they are joined by a path of close pairs. A group above
    ``group_rows`` is joined again on blocks of its remaining bits; with ``radius`` bits or fewer left
    it could hold 2^radius rows only, so this ends.
    """
    spark = distinct.sparkSession
    found = None
    todo = distinct.select(F.lit(0).cast("long").alias("mask"), "fp")
    while True:
        def keys(batches: Batches) -> Batches:
            for batch in batches:
                mask, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
                for base in np.unique(mask):
                    fps = fp[mask == base]
                    for wide in block_masks(int(base) % (1 << 64), blocks, radius):
                        wide = np.int64(_signed(wide))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(fps), wide)), pa.array(fps & wide), pa.array(fps)],
                            names=["mask", "shared", "fp"])

        keyed = todo.mapInArrow(keys, "mask long, shared long, fp long")
        if found is not None:  # different ways may lead to one mask
            keyed = keyed.distinct()
        sorted_rows = keyed.repartition(shuffle_parts(spark), "mask", "shared").sortWithinPartitions(
            "mask", "shared", "fp")
        step = stored(sorted_rows.mapInArrow(_link_runs(radius, group_rows), "a long, b long, mask long"), "near")
        links = step.filter("mask IS NULL").select("a", "b")
        found = links if found is None else found.union(links)
        todo = step.filter("mask IS NOT NULL").select("mask", F.col("a").alias("fp"))
        if todo.isEmpty():
            return found.distinct()


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, blocks: int = 7,
                    group_rows: int = 32_768) -> DataFrame:
    """(doc_id, fp, component_id) per document of ``docs(doc_id, text)``.

    ``component_id`` is the least doc_id among the documents that links of ``radius`` bits or fewer
    reach, the document itself included. NULL and empty texts have fingerprint zero and are linked
    like any other; a row without doc_id keeps its group but is never its least id; repeated rows
    are returned as often as they come. Only (doc_id, fp) is shuffled, never a text.
    """
    prepare(docs.sparkSession)
    marked = stored(fingerprints(docs, words), "fingerprints")
    least = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(fingerprint_links(least.select("fp"), radius, blocks, group_rows))
    placed = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = stored(placed, "placed")
    heads = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(placed.join(heads, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp")


def keep_one(docs: DataFrame, **settings: int) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the least document of their group.

    A row without doc_id stays (nothing names it); of repeated rows with the least id all stay.
    """
    groups = near_duplicates(docs, **settings)
    gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
