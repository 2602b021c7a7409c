"""Alignment of the tokens of two tokenizers, by merging the token ends of many texts in lockstep.

Both tokenizers cut the same bytes, so a text has two ascending lists of byte offsets at which tokens
end. One state vector holds a pointer into either list for every text of a batch. A step links the two
tokens that all pointers stand at, and moves each pointer whose token ends first (both where they end
together, which is a cut); texts that are done leave the vector. A long text takes part as several
lanes that begin at common ends, so the number of steps follows the lane, not the longest text.

What the corpus says about an id pair needs all links. Batches keep their distinct pairs with counts,
and each link as a number into them; Spark adds up the counts per pair and sends them back to the
batches in which the pair occurs, so links are never shuffled one by one.

Texts that are NULL, empty, or not reproduced byte by byte by either tokenizer have no tokens. Repeated
rows stay and count like any other; doc_id may be NULL; other columns are left out; an empty table
gives an empty result. Texts of any length are aligned whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insolara.llm.bpe import LONG_PIECE, Memo, lots, paused_gc
from insolara.llm.common import prepare, stored, text_of

Batches = Iterator[pa.RecordBatch]

TOKENS = 5 << 18  # tokens (of both kinds) of a batch; one text may have more
LANE = 256  # tokens of the first kind after which a lane ends at the next common end

_DOCS = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
         ("n_links", pa.int64()), ("groups_sha256", pa.string())]
_CHUNK = ("chunk long, docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,"
          "groups_sha256:string{more}>>, pairs array<long>, counts array<long>, links binary")


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies use for each byte, and that byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevelCoder:
    """A byte-level BPE of the tokenizers library, without special tokens.

    Where ids are the ranks of the merges and nothing but the usual pattern cuts a text, the ids are those
    of a rank table, which tiktoken works out several times as fast (tested on every character).
    """

    def __init__(self, definition: str, pattern: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        self.library = Tokenizer.from_str(definition)
        self.library.encode_special_tokens = True
        spec = json.loads(definition)
        vocabulary, letters = self.library.get_vocab(with_added_tokens=True), byte_letters()
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.tokens[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.ranked = None
        if self._is_ranked(spec):
            import tiktoken

            ranks = {self.tokens[i]: i for i in spec["model"]["vocab"].values() if self.tokens[i] not in _added(spec)}
            self.ranked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.library = None

    @staticmethod
    def _is_ranked(spec: dict) -> bool:
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        plain = not spec["normalizer"] and cut.get("type") == "ByteLevel" and cut.get("use_regex") \
            and not cut.get("add_prefix_space") and not model.get("ignore_merges") and not model.get("dropout")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        return bool(plain) and all(model["vocab"].get("".join(m)) == 256 + i for i, m in enumerate(merges))

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.ranked:
            return [self.ranked.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


def _added(spec: dict) -> set[bytes]:
    return {a["content"].encode() for a in spec.get("added_tokens") or []}


class PieceCoder:
    """A sentencepiece model that puts a blank before each text; tokens are bytes of the blank and the text."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.tokens = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode()
                       for i, p in enumerate(pieces)]
        probe = "a  bﬁ\tc "
        self.blank = [self.library.piece_to_id("▁")]  # the library gives nothing for an empty text
        self.cuts_at_blanks = self.bytes_of(self.blank) == b" " and not any(re.search("[^▁]▁", p) for p in pieces) \
            and self.bytes_of(self.library.encode(probe)) == f" {probe}".encode()

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Of texts that begin with the blank that the model adds."""
        found = self.library.encode([t[1:] for t in texts], num_threads=1)
        return [self.blank if t == " " else ids for t, ids in zip(texts, found)]


class BothCoders:
    """Ids of both tokenizers for texts, by the words seen lately.

    A word begins with a blank that follows something other than white space. No token of either kind
    goes over that border, so the ids of a text are those of its words. A model whose pieces do (or that
    changes blanks) gets whole texts.
    """

    def __init__(self, definition: str, pattern: str, model: bytes):
        self.a, self.b = ByteLevelCoder(definition, pattern), PieceCoder(model)
        space = "".join(c for c in map(chr, range(0x10000)) if regex.fullmatch(r"\s", c))
        no_blank = space.replace(" ", "")
        words = re.compile(f"[{space}]*[^{space}]+(?:[{no_blank}][{space}]*[^{space}]*)*|[{space}]+")
        self.parts = words.findall if self.b.cuts_at_blanks else lambda text: [text]
        self.known = Memo(lambda part: self._learn([part])[0], lambda part: len(part) <= LONG_PIECE)
        self.number = list(range(max(len(self.a.tokens), len(self.b.tokens)))).__getitem__  # remembered ids share their numbers

    def _learn(self, parts: list[str]) -> list[tuple[tuple[int, ...], tuple[int, ...], bool]]:
        """The ids of both kinds, and whether both make up the part's bytes."""
        out, token, piece = [], self.a.tokens.__getitem__, self.b.tokens.__getitem__
        for part, a, b in zip(parts, self.a.encode(parts), self.b.encode(parts)):
            data = part.encode()
            same = b"".join(map(token, a)) == data and b"".join(map(piece, b)) == data
            out.append((tuple(map(self.number, a)), tuple(map(self.number, b)), same))
        return out

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        cut = [self.parts(" " + t) if t else [] for t in texts]
        new = [p for p in self.known.recall(set().union(*cut)) if len(p) <= LONG_PIECE]
        self.known.update(zip(new, self._learn(new)))
        none, out = np.empty(0, np.int32), []
        for parts in cut:
            found = list(map(self.known.__getitem__, parts))
            if not all(f[2] for f in found):
                found = []
            out.append(tuple(np.fromiter(chain.from_iterable(f[k] for f in found), np.int32) if found else none
                             for k in (0, 1)))
        return out


def _ends(sizes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes[tokens], dtype=np.int64)


def lanes(a_ends: np.ndarray, b_ends: np.ndarray, a_starts: np.ndarray, b_starts: np.ndarray
          ) -> tuple[np.ndarray, np.ndarray]:
    """First token of each lane, of either kind: where texts begin, and common ends about LANE tokens apart."""
    if not len(a_ends):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    tries = np.arange(LANE - 1, len(a_ends) - 1, LANE)
    found = np.searchsorted(b_ends, a_ends[tries])
    common = b_ends[found] == a_ends[tries]
    a_from = np.concatenate([a_starts, tries[common] + 1])
    b_from = np.concatenate([b_starts, found[common] + 1])
    a_from, first = np.unique(a_from, return_index=True)
    return a_from, b_from[first]


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_from: np.ndarray, b_from: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j) of all links and of all cuts; lanes begin at ``a_from``/``b_from`` and end where the next begins.

    Every step takes one link from each lane that is still at work.
    """
    i, j = a_from.copy(), b_from.copy()
    stop = np.append(a_from[1:], len(a_ends))
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(i):
        links_a.append(i)
        links_b.append(j)
        at_a, at_b = a_ends[i], b_ends[j]
        both = at_a == at_b
        cuts_a.append(i[both])
        cuts_b.append(j[both])
        i, j = i + (at_a <= at_b), j + (at_b <= at_a)
        going = i < stop
        if not going.all():
            i, j, stop = i[going], j[going], stop[going]
    if not links_a:
        none = np.empty(0, np.int64)
        return none, none, none, none
    return tuple(map(np.concatenate, (links_a, links_b, cuts_a, cuts_b)))


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0..n-1, each with room for one sign behind them, and their number."""
    text = np.arange(n).astype(f"S{len(str(n))}")
    width = text.dtype.itemsize
    grid = np.zeros((n, width + 1), np.uint8)
    grid[:, :width] = text.view(np.uint8).reshape(n, width)
    return grid, np.char.str_len(text).astype(np.int64)


class Aligner:
    """Aligns batches of texts whose ids are known."""

    def __init__(self, a_tokens: list[bytes], b_tokens: list[bytes]):
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in ts], np.int64) for ts in (a_tokens, b_tokens))
        self.n_b = len(b_tokens)
        self.grid, self.lengths = _digits(max(len(a_tokens), len(b_tokens)))

    def align(self, found: list[tuple[np.ndarray, np.ndarray]]) -> dict:
        """Per text the numbers of tokens, groups and links and the groups' text; the pair of each link in text order."""
        counts = [np.array([len(x[k]) for x in found], np.int64) for k in (0, 1)]
        a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        a_ends, b_ends = _ends(self.a_sizes, a), _ends(self.b_sizes, b)
        whole = counts[0] > 0
        a_first, b_first = (np.cumsum(c) - c for c in counts)
        i, j, cut_a, cut_b = lockstep(a_ends, b_ends, *lanes(a_ends, b_ends, a_first[whole], b_first[whole]))
        a_cut, b_cut = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_cut[cut_a], b_cut[cut_b] = 1, 1
        cuts_at = np.concatenate([[0], np.cumsum(a_cut)])  # groups that end before each token of the first kind
        # each step moves one pointer, or both at a cut, which gives every link its place in the text
        pairs = np.empty(len(i), np.int64)
        pairs[i + j - cuts_at[i]] = a[i].astype(np.int64) * self.n_b + b[j]
        a_last, b_last = a_first + counts[0], b_first + counts[1]
        groups = cuts_at[a_last] - cuts_at[a_first]
        text, ends = self._groups(a, b, a_cut, b_cut, a_last + b_last)
        return {"n_a": counts[0], "n_b": counts[1], "n_groups": groups, "n_links": counts[0] + counts[1] - groups,
                "pairs": pairs, "text": text, "ends": ends}

    def _groups(self, a, b, a_cut, b_cut, last) -> tuple[memoryview, np.ndarray]:
        """All groups as ``a1,a2|b1;...`` and the end of each text's part."""
        n = len(a) + len(b)
        a_size = np.flatnonzero(a_cut) + 1  # tokens of each kind up to each group's end
        b_size = np.flatnonzero(b_cut) + 1
        a_group, b_group = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        tokens, signs = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        at_a = np.arange(len(a)) + np.concatenate([[0], b_size])[a_group]
        at_b = np.arange(len(b)) + a_size[b_group]
        tokens[at_a], tokens[at_b] = a, b
        signs[at_a[a_cut == 1]], signs[at_b[b_cut == 1]] = ord("|"), ord(";")
        sizes = self.lengths[tokens]
        grid = self.grid[tokens]
        grid[np.arange(n), sizes] = signs
        sums = np.concatenate([[0], np.cumsum(sizes + 1)])
        return memoryview(grid[grid > 0].tobytes()), sums[last]


class _Chunk:
    """Texts gathered until they hold TOKENS tokens, and their row."""

    def __init__(self, aligner: Aligner, keep_groups: bool):
        self.aligner, self.keep_groups, self.number = aligner, keep_groups, 0
        self.names, self.found, self.held = [], [], 0

    def add(self, names: list, found: list) -> Iterator[pa.RecordBatch]:
        for name, ids in zip(names, found):
            self.names.append(name)
            self.found.append(ids)
            self.held += len(ids[0]) + len(ids[1])
            if self.held >= TOKENS:
                yield self.row()

    def row(self) -> pa.RecordBatch:
        made = self.aligner.align(self.found)
        pairs, links, counts = np.unique(made["pairs"], return_inverse=True, return_counts=True)
        texts, at = [], 0
        for end in made["ends"].tolist():
            texts.append(made["text"][at:max(at, end - 1)])  # without the last group's sign
            at = end
        digests = [hashlib.sha256(t).hexdigest() if len(t) else "" for t in texts]
        columns = [pa.array(self.names, pa.int64()), *(pa.array(made[k]) for k in ("n_a", "n_b", "n_groups", "n_links")),
                   pa.array(digests, pa.string())]
        names = [n for n, _ in _DOCS]
        if self.keep_groups:
            columns.append(pa.array([str(t, "ascii") for t in texts], pa.string()))
            names.append("groups")
        docs = pa.StructArray.from_arrays(columns, names=names)
        number = (TaskContext.get().partitionId() << 32) + self.number
        packed = zstandard.ZstdCompressor(level=1).compress(links.astype("<i4").tobytes())
        whole = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                 for x in (docs, pa.array(pairs), pa.array(counts.astype(np.int64)))]
        self.number += 1
        self.names, self.found, self.held = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array([number]), *whole, pa.array([packed], pa.binary())],
                                          names=["chunk", "docs", "pairs", "counts", "links"])


_made: dict[str, tuple[BothCoders, Aligner]] = {}  # one pair of vocabularies per worker process


def aligned_chunks(docs: DataFrame, definition: str, pattern: str, model: str, keep_groups: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` in batches of about TOKENS tokens, one row each, written to the shared folder.

    ``docs`` has one entry per text; ``pairs`` and ``counts`` are the batch's distinct id pairs
    (id of A times the size of B's vocabulary plus id of B) and how many of its links hold them; ``links``
    (32-bit integers, zstandard) names the pair of each link in the order of the texts. The tokenizers are
    files read on the driver: a tokenizers definition (A) with the ``pattern`` that cuts its texts, and a
    sentencepiece model (B). With ``keep_groups`` each entry also holds its groups as text.
    """
    spark = docs.sparkSession
    prepare(spark)
    with open(definition, encoding="utf-8") as a, open(model, "rb") as b:
        shared = spark.sparkContext.broadcast((a.read(), pattern, b.read()))  # vocabularies, whatever the data
    name = hashlib.sha256(repr(shared.value).encode()).hexdigest()

    def run(batches: Batches) -> Batches:
        if name not in _made:
            _made.clear()
            coders = BothCoders(*shared.value)
            _made[name] = coders, Aligner(coders.a.tokens, coders.b.tokens)
        coders, aligner = _made[name]
        chunk = _Chunk(aligner, keep_groups)
        for batch in batches:
            for names, texts in lots(batch):
                with paused_gc():
                    found = coders.encode(texts)
                yield from chunk.add(names, found)
        if chunk.names:
            yield chunk.row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    schema = _CHUNK.format(more=",groups:string" if keep_groups else "")
    return stored(rows.mapInArrow(run, schema), "aligned")


def pair_counts(chunks: DataFrame, n_b: int) -> DataFrame:
    """(pair, a_id, b_id, links, best): links of the corpus per id pair, and whether no pair of that B id has more."""
    pairs = _pairs_of(chunks).groupBy("pair").agg(F.sum("n").alias("links"))
    counted = stored(pairs.withColumns({"a_id": F.expr(f"pair div {n_b}"), "b_id": F.expr(f"pair % {n_b}")}), "pairs")
    most = counted.groupBy("b_id").agg(F.max("links").alias("most"))
    return counted.join(most, "b_id").select("pair", "a_id", "b_id", "links", (F.col("links") == F.col("most")).alias("best"))


def _pairs_of(chunks: DataFrame) -> DataFrame:
    pairs = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "counts")).alias("pos", "x"))
    return pairs.select("chunk", "pos", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))


def _sums(batches: Batches) -> Batches:
    """Per text of each chunk: links of best pairs, and the counts of its links' pairs added up."""
    for batch in batches:
        for at in range(batch.num_rows):
            docs = batch.column(0)[at].values
            known = batch.column(2)[at].values
            packed = batch.column(1)[at].as_py()
            links = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<i4")
            value = np.zeros(len(known), np.int64)
            value[known.field(0).to_numpy()] = known.field(1).to_numpy()
            of = value[links]  # a best pair's count is negative
            ends = np.cumsum([0, *docs.field("n_links").to_numpy()])
            per_text = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in ((of < 0).astype(np.int64), np.abs(of))]
            fields = [docs.type.field(i).name for i in range(docs.type.num_fields)]
            yield pa.RecordBatch.from_arrays([*(docs.field(f) for f in fields), *map(pa.array, per_text)],
                                             names=[*fields, "n_best", "count_sum"])


def alignment(docs: DataFrame, definition: str, pattern: str, model: str, keep_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum), one row per row of ``docs``.

    ``n_best`` counts the links whose pair is the commonest of its B id in the corpus (ties included),
    ``count_sum`` adds up how many links of the corpus hold each link's pair. ``keep_groups`` adds the
    groups themselves, as ``a1,a2|b1;a3|b2,b3``.
    """
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size()
    chunks = aligned_chunks(docs, definition, pattern, model, keep_groups)
    value = F.when(F.col("best"), -F.col("links")).otherwise(F.col("links"))
    valued = pair_counts(chunks, n_b).select("pair", value.alias("value"))
    told = (_pairs_of(chunks).select("chunk", "pos", "pair").join(valued, "pair")
            .groupBy("chunk").agg(F.collect_list(F.struct("pos", "value")).alias("known")))  # of one batch, so bounded
    none = F.array().cast("array<struct<pos:int,value:long>>")
    rows = chunks.select("chunk", "docs", "links").join(told, "chunk", "left")
    schema = ", ".join([*(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in _DOCS),
                        *(["groups string"] if keep_groups else []), "n_best long", "count_sum long"])
    return rows.select("docs", "links", F.coalesce("known", none).alias("known")).mapInArrow(_sums, schema)
