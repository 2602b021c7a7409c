"""Token-id files whose blocks are stored plane by plane.

A file holds the ids of consecutive documents. Ids are gathered into blocks of fixed size; a block is
transposed into its four byte planes (or its 32 bit planes), each plane is compressed with zstandard,
and an index at the end of the file names place and size of every plane. High planes of small ids are
all zero and shrink to a few bytes.

    magic | planes of block 0 | planes of block 1 | ... | index (zstandard) | its size, 8 bytes | magic

A task writes the file of its partition under a name of its own attempt and returns a row about it.
Only files named by those rows count, so a repeated or lost task leaves no trace in the result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insolara.llm.bpe import LONG_PIECE, lots, paused_gc
from insolara.llm.common import prepare, shuffle_parts, stored, text_of

Batches = Iterator[pa.RecordBatch]

# The file format.
MAGIC = b"IDPLANE1"
BLOCK = 1 << 16
LEVEL = 3

LINES = 4096
KNOWN = 1 << 19
# what may stand as a line of its own: no white space but one blank in front
LINE = re.compile(r" ?\S+").fullmatch

# Kinds of bytes: white space, punctuation, letters and digits; beyond ASCII and control characters have none.
BLANK, MARK, ALNUM = 1, 2, 3
KINDS = np.zeros(256, np.uint8)
KINDS[[c for c in range(128) if chr(c) in " \t\n\x0b\x0c\r"]] = BLANK
KINDS[[c for c in range(33, 127)]] = MARK
KINDS[[c for c in range(128) if chr(c).isalnum()]] = ALNUM
WIDE_BLANKS = np.array([c for c in range(0x80, 0x10000) if chr(c).isspace()])
# First bytes of two that make a letter whatever the second is, but for the signs of product and quotient,
# and of characters that are never white space.
LETTERS, SOLID = np.zeros(256, bool), np.zeros(256, bool)
LETTERS[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = True
SOLID[[*range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True


def to_planes(values: np.ndarray, bits: bool = False) -> list[bytes]:
    """The byte planes of an unsigned array, or its bit planes, lowest first."""
    width = values.dtype.itemsize
    grid = values.astype(values.dtype.newbyteorder("<")).view(np.uint8).reshape(-1, width)
    if not bits:
        return [np.ascontiguousarray(grid[:, i]).tobytes() for i in range(width)]
    spread = np.unpackbits(grid, axis=1, bitorder="little")
    return [np.packbits(spread[:, i], bitorder="little").tobytes() for i in range(8 * width)]


def from_planes(planes: list[bytes], n: int, dtype: type, bits: bool = False) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    if bits:
        spread = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], 1)
        grid = np.packbits(spread, axis=1, bitorder="little")
    else:
        grid = np.stack([np.frombuffer(p, np.uint8) for p in planes], 1)
    return np.ascontiguousarray(grid.reshape(n, width)).view(np.dtype(dtype).newbyteorder("<")).ravel()


class IdWriter:
    """Writes one file; holds one block of ids and one of document entries at a time."""

    def __init__(self, stream, bits: bool = False, block: int = BLOCK):
        self.stream, self.bits, self.block = stream, bits, block
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.at, self.chunks, self.ids, self.held = 0, [], [], 0
        self.docs: list[tuple[int, int, int]] = []
        self.n_docs = self.n_ids = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> int:
        self.stream.write(data)
        self.at += len(data)
        return len(data)

    def _chunk(self, kind: str, values: np.ndarray) -> None:
        at = self.at
        sizes = [self._put(self.packer.compress(p)) for p in to_planes(values, self.bits)]
        self.chunks.append([kind, at, len(values), sizes])

    def _flush_ids(self, least: int) -> None:
        if self.held and self.held >= least:
            ids = np.concatenate(self.ids)
            whole = len(ids) - len(ids) % self.block if least > 1 else len(ids)
            for i in range(0, whole, self.block):
                self._chunk("ids", ids[i:min(i + self.block, whole)])
            self.ids, self.held = [ids[whole:]], len(ids) - whole

    def _flush_docs(self) -> None:
        if self.docs:
            known, names, sizes = (np.array(x, np.uint64) for x in zip(*self.docs))
            for kind, values in (("known", known.astype(np.uint8)), ("doc", names), ("size", sizes)):
                self._chunk(kind, values)
            self.docs = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id is not None, (doc_id or 0) % (1 << 64), len(ids)))
        self.ids.append(np.asarray(ids, np.uint32))
        self.held += len(ids)
        self.n_docs, self.n_ids = self.n_docs + 1, self.n_ids + len(ids)
        self._flush_ids(self.block)
        if len(self.docs) >= self.block:
            self._flush_docs()

    def close(self) -> None:
        self._flush_ids(1)
        self._flush_docs()
        index = self.packer.compress(json.dumps({"bits": self.bits, "chunks": self.chunks}).encode())
        self._put(index)
        self._put(struct.pack("<Q", len(index)) + MAGIC)


class IdReader:
    """Reads a file of :class:`IdWriter`, one block at a time; ``stream`` can seek."""

    def __init__(self, stream):
        self.stream, self.unpacker = stream, zstandard.ZstdDecompressor()
        tail = self._get(stream.size() - 16, 16)
        if tail[8:] != MAGIC or self._get(0, 8) != MAGIC:
            raise ValueError("not a token-id file, or cut off")
        size = struct.unpack("<Q", tail[:8])[0]
        index = json.loads(self.unpacker.decompress(self._get(stream.size() - 16 - size, size)))
        self.bits, self.chunks = index["bits"], index["chunks"]

    def _get(self, at: int, size: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(size)

    def _values(self, kind: str, dtype: type) -> Iterator[np.ndarray]:
        for _, at, n, sizes in (c for c in self.chunks if c[0] == kind):
            planes, data = [], memoryview(self._get(at, sum(sizes)))
            for size in sizes:
                planes.append(self.unpacker.decompress(data[:size]))
                data = data[size:]
            yield from_planes(planes, n, dtype, self.bits)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in the order of the file."""
        blocks, held = self._values("ids", np.uint32), np.empty(0, np.uint32)
        entries = zip(self._values("known", np.uint8), self._values("doc", np.uint64), self._values("size", np.uint64))
        for known, names, sizes in entries:
            for has, name, size in zip(known.tolist(), names.view(np.int64).tolist(), sizes.tolist()):
                parts, left = [], size
                while left > len(held):
                    parts.append(held)
                    left -= len(held)
                    held = next(blocks)
                parts.append(held[:left])
                held = held[left:]
                yield name if has else None, np.concatenate(parts)


def part_starts(data: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where the parts of joined UTF-8 texts begin; ``docs`` are the places where texts begin.

    A part begins with each text, before white space that follows anything else, behind a single line
    break (or tab), and before punctuation that follows a letter or digit. The vocabulary's pattern has
    a border at each of these places and looks at nothing before it, nor beyond the part, to find the
    next. Where bytes alone leave a doubt (control characters, wide blanks), there is no cut.
    """
    begins = np.zeros(len(data) + 1, bool)
    kinds = KINDS.take(data)
    blank, mark, solid = kinds == BLANK, kinds == MARK, kinds >= MARK
    begins[1:-1] = blank[1:] & solid[:-1]
    begins[1:-1] |= mark[1:] & (kinds[:-1] == ALNUM)
    wide = np.flatnonzero((blank | mark)[1:] & (data[:-1] >= 0x80))  # last bytes of characters beyond ASCII
    last, one, two = data[wide].astype(np.int64), data[wide - 1].astype(np.int64), data[wide - 2].astype(np.int64)
    code = np.where(one >= 0xC0, (one & 31) << 6 | last & 63, (two & 15) << 12 | (one & 63) << 6 | last & 63)
    letter = LETTERS[one] & (code != 0xD7) & (code != 0xF7)
    begins[wide + 1] = np.where(blank[wide + 1], ~np.isin(code, WIDE_BLANKS), letter)
    begins[docs] = True
    # a line break with a border before it and no white space after it
    breaks = np.flatnonzero(begins[:-2] & blank[:-1] & (data[:-1] != 32) & (solid[1:] | SOLID[data[1:]]))
    begins[breaks + 1] = True
    return np.flatnonzero(begins[:-1])


class LibraryCoder:
    """Encodes whole texts with the tokenizers library.

    The vocabulary's pattern cuts texts before anything else, so texts are cut into parts at borders of
    the pattern (:func:`part_starts`) and each distinct part of a lot is encoded once. Parts not met lately go
    to the library as the lines of one text; a line break between two of them is a token of its own, at
    which the ids are parted again. The ids of known parts are kept, as bytes.
    Added tokens (``<|endoftext|>``) come before all cuts, so a text that holds one goes to the library whole.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        added = [a["content"] for a in json.loads(definition).get("added_tokens") or [] if a["content"]]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self.known, self.old = {}, {}
        self.line = self._whole("\n")

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _lines(self, words: list[str]) -> list[bytes]:
        ids = self._whole("\n".join(words))
        ends, packed = 4 * np.flatnonzero(ids == self.line[0]), ids.tobytes()
        return [packed[a:b] for a, b in zip([0, *(ends + 4).tolist()], [*ends.tolist(), len(packed)])]

    def _learn(self, parts: list[bytes]) -> list[bytes]:
        """The ids of parts: as lines, where a part can be one."""
        texts = [p.decode("utf-8") for p in parts]
        fits = [LINE(t) is not None for t in texts] if len(self.line) == 1 else [False] * len(texts)
        plain = list(compress(texts, fits))
        lines = chain.from_iterable(self._lines(plain[at:at + LINES]) for at in range(0, len(plain), LINES))
        return [next(lines) if fit else self._whole(t).tobytes() for t, fit in zip(texts, fits)]

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        """The ids of distinct parts, those met lately from memory: the KNOWN latest and the generation before that is in use."""
        if len(self.known) >= KNOWN:
            self.known, self.old = {}, self.known
        found = list(map(self.known.get, parts))
        lacking = [p for p, x in zip(parts, found) if x is None]
        held = list(map(self.old.get, lacking))
        learnt = iter(self._learn([p for p, x in zip(lacking, held) if x is None]))
        held = [next(learnt) if x is None else x for x in held]
        self.known.update(zip(lacking, held))
        for part in lacking:
            if len(part) > LONG_PIECE:
                del self.known[part]
        rest = iter(held)
        return [next(rest) if x is None else x for x in found]

    def encode(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        whole = {i for i, t in enumerate(texts) if self.added(t)}
        packed = [b"" if i in whole else t.encode("utf-8") for i, t in enumerate(texts)]
        data, at = b"".join(packed), np.cumsum([0, *map(len, packed)])
        starts = part_starts(np.frombuffer(data, np.uint8), at) if data else np.empty(0, np.int64)
        places = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        parts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, places, pa.py_buffer(data)]).dictionary_encode()
        ids = self._ids(parts.dictionary.to_numpy(zero_copy_only=False).tolist())  # sooner than to_pylist()
        pool, which = np.frombuffer(b"".join(ids), np.uint32), parts.indices.to_numpy()
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = (np.cumsum(sizes) - sizes)[which]
        sizes = sizes[which]
        ends = np.cumsum(sizes)
        flat = pool[np.repeat(first - ends + sizes, sizes) + np.arange(sizes.sum())]
        stops = np.concatenate(([0], ends))[np.searchsorted(starts, at[1:])]
        found = np.split(np.insert(flat, stops, end_id), stops[:-1] + np.arange(1, len(stops)))
        return [np.append(self._whole(texts[i]), np.uint32(end_id)) if i in whole else x for i, x in enumerate(found)]


_made: dict[str, LibraryCoder] = {}  # one encoder per worker process


def write_ids(docs: DataFrame, folder: str, definition: str, end_id: int = 2, bits: bool = False) -> DataFrame:
    """Encodes ``docs(doc_id, text)`` in ascending doc_id order into files below ``folder``.

    Returns (part, path, n_docs, n_ids), one row per file; the files in order of ``part`` hold all ids.
    ``definition`` is the path of a tokenizers file, ``end_id`` follows each document. NULL text counts
    as empty (its document is the end id alone), rows without doc_id come last, repeated rows stay.
    """
    spark = docs.sparkSession
    prepare(spark)
    with open(definition, encoding="utf-8") as text:
        shared = spark.sparkContext.broadcast(text.read())  # a vocabulary, whatever the data
    name = hashlib.sha256(shared.value.encode()).hexdigest()

    def run(batches: Batches) -> Batches:
        if name not in _made:
            _made.clear()
            _made[name] = LibraryCoder(shared.value)
        coder = _made[name]
        task = TaskContext.get()
        store, at = fs.FileSystem.from_uri(folder)
        writer = path = stream = None
        for batch in batches:
            for names, texts in lots(batch):
                if writer is None:
                    store.create_dir(at, recursive=True)
                    path = f"{at}/ids-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
                    stream = store.open_output_stream(path)
                    writer = IdWriter(stream, bits)
                with paused_gc():
                    found = coder.encode(texts, end_id)
                for doc_id, ids in zip(names, found):
                    writer.add(doc_id, ids)
        if writer:
            writer.close()
            stream.close()
            row = {"part": task.partitionId(), "path": path.removeprefix(at + "/"), "n_docs": writer.n_docs,
                   "n_ids": writer.n_ids}
            yield pa.RecordBatch.from_pylist([row], pa.schema(
                [("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = F.col("doc_id").asc_nulls_last()
    dealt = rows.repartitionByRange(shuffle_parts(spark), order).sortWithinPartitions(order)
    return stored(dealt.mapInArrow(run, "part int, path string, n_docs long, n_ids long"), "id-files")


def read_ids(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files that :func:`write_ids` named.

    ``start`` counts the ids of all documents before it; ``ids`` are little-endian 32-bit integers.
    The list of files, one row per partition of the writer, passes the driver; ids never do.
    """
    spark = files.sparkSession
    bases, base = [], 0
    for part, path, n in sorted(tuple(r) for r in files.select("part", "path", "n_ids").collect()):
        bases.append((part, path, base))
        base += n

    def run(batches: Batches) -> Batches:
        store, at = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                start, held, size = row["base"], ([], [], []), 0
                with store.open_input_file(f"{at}/{row['path']}") as stream:
                    for name, ids in IdReader(stream).documents():
                        for column, value in zip(held, (name, start, ids.astype("<u4").tobytes())):
                            column.append(value)
                        start, size = start + len(ids), size + len(ids)
                        if size >= 1 << 21:
                            yield _batch(held)
                            held, size = ([], [], []), 0
                if held[0]:
                    yield _batch(held)

    def _batch(held) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, (pa.int64(), pa.int64(), pa.binary()))],
                                          names=["doc_id", "start", "ids"])

    listed = spark.createDataFrame(bases, "part int, path string, base long")
    return listed.repartition(max(1, len(bases))).mapInArrow(run, "doc_id long, start long, ids binary")
