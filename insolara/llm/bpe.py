"""Byte-level BPE by longest matches and backtracking.

The vocabulary's byte strings, read as Latin-1, form an automaton that finds the longest token at
every position of a piece in one scan. The encoder takes the longest token, falls back to the next
shorter one where it does not fit its left neighbour, and steps back where none fits. Two tokens fit
exactly if merging their joined bytes by rank gives just these two, which is worked out from the
merges at their border and remembered per pair. A sequence whose neighbours all fit is the one that
rank-by-rank merging makes, and as no position is entered again once it has failed, the work is
linear in the length of the piece.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain, islice, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insolara.llm.common import prepare, text_of

Batches = Iterator[pa.RecordBatch]

MEMO = 3 << 16
SHIFT = 20
LONG_PIECE = 64
BLOCK = 1 << 16
LOT = 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken vocabulary file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def by_rank(ranks: dict[bytes, int]) -> list[bytes]:
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


class Memo(dict):
    """What ``make`` gives for a key, kept for the MEMO latest keys and those of the MEMO before that are in use."""

    def __init__(self, make, keep=lambda key: True):
        self.make, self.keep, self.old = make, keep, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if self.keep(key):
            self._room()
            self[key] = value
        return value

    def _room(self) -> None:
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()

    def recall(self, keys: set) -> set:
        """Makes room, takes what is kept for ``keys`` into the latest generation, returns the keys that lack a value.

        Values added to the dictionary itself stay until the next call.
        """
        self._room()
        lacking, old = keys - self.keys(), self.old
        if old:
            held = lacking & old.keys()
            self.update(zip(held, map(old.__getitem__, held)))
            lacking -= held
        return lacking


def text_parts() -> re.Pattern:
    """Matches white space with all that follows up to the next white space."""
    space = "".join(c for c in map(chr, range(0x10000)) if regex.fullmatch(r"\s", c))
    return re.compile(f"[{space}]*[^{space}]+|[{space}]+")


class ByteBPE:
    """Encoder of one rank table; ``pattern`` cuts texts into pieces.

    A piece may begin with white space but must not go on to white space after anything else, so that
    a text can be cut into white space and what follows it first. Most of these parts are words seen
    before, whose ids are remembered.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.tokens = ranks, by_rank(ranks)
        self.cut = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.sizes = [len(t) for t in self.tokens]
        self.shorter = [self._prefix(t) for t in self.tokens]
        self.parts = text_parts()
        self.edges = Memo(self._edge)
        self.fits = Memo(self._fits)
        self.pieces = Memo(lambda piece: self.encode_piece(piece.encode("utf-8")), lambda piece: len(piece) <= LONG_PIECE)
        self.known = Memo(self._encode_part, lambda part: len(part) <= LONG_PIECE)

    def _prefix(self, token: bytes) -> int:
        return next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), -1)

    def _halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts whose merge makes a token of several bytes."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [self.ranks.get(a + b, len(self.tokens)) for a, b in pairwise(parts)]
            at = found.index(min(found))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def _edge(self, key: tuple[int, int]) -> list[tuple[bytes, int]]:
        """What stands at a token's first (0) or last (1) byte while it is merged, and the rank that ends it."""
        rank, side = key
        token, ends = self.tokens[rank], len(self.tokens)
        out = [(token, ends)]
        while len(token) > 1:
            ends, token = self.ranks[token], self._halves(token)[side]
            out.append((token, ends))
        return out

    def _fits(self, pair: int) -> bool:
        """No merge across the border comes before the merges that make the two tokens.

        Of equal ranks the merge further left comes first.
        """
        get, none = self.ranks.get, len(self.tokens)
        starts = self.edges[pair & (1 << SHIFT) - 1, 0]
        for left, left_ends in self.edges[pair >> SHIFT, 1]:
            for right, right_ends in starts:
                rank = get(left + right, none)
                if rank < left_ends and rank <= right_ends and rank < none:
                    return False
        return True

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        letters, sizes, fits = piece.decode("latin-1"), self.sizes, self.fits
        longest = self.automaton.iter_long
        out: list[int] = []
        at, last, size, failed = 0, -1, len(piece), None
        ahead = longest(letters)  # the longest token at each place, read one by one
        while at < size:
            token = next(ahead)[1]
            end = at + sizes[token]
            if (last >= 0 and not fits[last << SHIFT | token]) or (failed and failed[end]):
                failed = failed or bytearray(size + 1)
                while failed[end] or (last >= 0 and not fits[last << SHIFT | token]):
                    token = self.shorter[token]
                    while token < 0:  # no token fits here: step back
                        failed[at] = 1
                        token = out.pop()
                        at -= sizes[token]
                        last = out[-1] if out else -1
                    end = at + sizes[token]
                ahead = longest(letters, end)
            out.append(token)
            at, last = end, token
        return out

    def _encode_part(self, part: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, self.cut.findall(part))))

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text, without special tokens."""
        known = self.known.__getitem__
        if len(text) <= BLOCK:
            return np.fromiter(chain.from_iterable(map(known, self.parts.findall(text))), np.int32)
        found, blocks = (m.group() for m in self.parts.finditer(text)), []
        while block := list(islice(found, BLOCK)):
            blocks.append(np.fromiter(chain.from_iterable(map(known, block)), np.int32))
        return np.concatenate(blocks)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """:meth:`encode` of several texts, whose new words are worked out first."""
        cut = [self.parts.findall(t) for t in texts]
        for part in self.known.recall(set().union(*cut)):
            if len(part) <= LONG_PIECE:
                self.known[part] = self._encode_part(part)
        get = self.known.__getitem__
        return [np.fromiter(chain.from_iterable(map(get, parts)), np.int32) for parts in cut]


@contextmanager
def paused_gc() -> Iterator[None]:
    """No search for cycles meanwhile: encoders make none, and their memos are large to go through."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def lots(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """The (id, text) rows of a batch in lots of about LOT characters."""
    names, texts, size = [], [], 0
    for name, text in zip(batch.column(0), batch.column(1)):
        names.append(name.as_py())
        texts.append(text.as_py())
        size += len(texts[-1])
        if size >= LOT:
            yield names, texts
            names, texts, size = [], [], 0
    if names:
        yield names, texts


_made: dict[str, ByteBPE] = {}  # one encoder per worker process


def encode(docs: DataFrame, path: str, pattern: str, into: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, ids array<int>), each piece that ``pattern`` matches on its own.

    With ``decoded`` the ids are decoded again as they pass, into a binary column of that name, by the worker
    that holds the vocabulary already.
    NULL text counts as empty and gives no ids; repeated rows stay, a NULL doc_id stays NULL.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast((read_ranks(path), pattern))  # a vocabulary, whatever the data
    name = hashlib.sha256(repr(shared.value).encode()).hexdigest()

    def run(batches: Batches) -> Batches:
        if name not in _made:
            _made.clear()
            _made[name] = ByteBPE(*shared.value)
        coder = _made[name]
        for batch in batches:
            for names, texts in lots(batch):
                # a lot of one long text is encoded in blocks of its words
                with paused_gc():
                    found = coder.encode_many(texts) if len(texts) > 1 else [coder.encode(texts[0])]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                columns = {"doc_id": pa.array(names, pa.int64()),
                           into: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))}
                if decoded:
                    token = coder.tokens.__getitem__
                    columns[decoded] = pa.array([b"".join(map(token, x.tolist())) for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {into} array<int>" + (f", {decoded} binary" if decoded else ""))


def decode(encoded: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """(doc_id, ids) -> (doc_id, ids, decoded binary); NULL ids count as none."""
    shared = encoded.sparkSession.sparkContext.broadcast(by_rank(read_ranks(path)))

    def run(batches: Batches) -> Batches:
        token = shared.value.__getitem__
        for batch in batches:
            column = batch.column(1)
            texts = pa.array([b"".join(map(token, column[i].values.to_numpy().tolist())) if column[i].is_valid else b""
                              for i in range(batch.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=["doc_id", ids, into])

    return encoded.select("doc_id", ids).mapInArrow(run, f"doc_id long, {ids} array<int>, {into} binary")


def digests(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes again and sums up both; ``ids`` too if asked."""
    both = encode(docs, path, pattern, decoded="decoded")
    found = both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"), "ids")
    return found if keep_ids else found.drop("ids")
