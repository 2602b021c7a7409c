"""Nearest neighbours by inner product over cross-polytope hash tables.

A pseudo-rotation (random signs and a fast Hadamard transform, three times) turns a vector's direction;
the signed axis it comes nearest to is its hash, one of 2 x dimensions. A table's cell joins as many
hashes as the table's size asks for. Every vector stands in one cell per table; a query looks into several
cells of each, those whose axes it comes next nearest to first, and every vector found there is ranked by
its exact inner product.

How many cells a query looks into is fitted: for a bounded sample of queries the true neighbours among all
rows are found once, and the least number of cells per table is taken at which the wanted share of them is
met. Where long hashes would need too many cells, shorter ones are used; a single hash can always reach
every row. Queries that find fewer rows than asked for search all cells of one table.

Vectors of unlike length are kept apart by bands of half a power of two of their length, and queries look
into every band. Equal vectors are one entry of the tables, with their smallest ids; a cell with many
entries (or many queries) is dealt out as blocks.

Rows take part if they have an id and a vector of the commonest size (the smaller of equally common ones)
that is not zero and holds neither NULL nor non-finite components. Repeated rows count once. Ties go to
the smaller id. Other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insolara.llm.common import prepare, stored

Batches = Iterator[pa.RecordBatch]

TABLES = 3
SAMPLE = 256  # queries whose true neighbours the number of cells is fitted to
RECALL = 0.965  # share of them to be met
CELL = 256  # entries that a cell should have on average, at least
PROBES = 1024  # most cells per table of hashes longer than one
BLOCK = 8192  # entries or queries of a block
SMALL = 50_000  # rows of a table that is broadcast
TURNS = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, by halves."""
    n, half = x.shape[1], 1
    while half < n:
        pairs = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


@dataclass(frozen=True)
class Polytope:
    """``tables`` hash tables of ``hashes`` cross-polytope hashes each, for vectors of ``dim`` components."""

    dim: int
    tables: int
    hashes: int
    seed: int = 0

    @property
    def width(self) -> int:
        return 1 << max(1, (self.dim - 1).bit_length())

    @property
    def cells(self) -> int:
        return (2 * self.width) ** self.hashes

    def turned(self, x: np.ndarray, table: int, number: int) -> np.ndarray:
        wide = np.zeros((len(x), self.width))
        wide[:, :self.dim] = x / np.abs(x).max(axis=1, keepdims=True)
        wide /= np.linalg.norm(wide, axis=1, keepdims=True)
        signs = np.random.default_rng([self.seed, table, number]).choice([-1.0, 1.0], (TURNS, self.width))
        for row in signs:
            wide = hadamard(wide * row)
        return wide

    def cell(self, x: np.ndarray, table: int) -> np.ndarray:
        """Axis numbers of all hashes as one number: axis i, or width + i where it points the other way."""
        out = np.zeros(len(x), np.int64)
        for number in range(self.hashes):
            y = self.turned(x, table, number)
            axis = np.abs(y).argmax(axis=1)
            out = out * (2 * self.width) + axis + self.width * (y[np.arange(len(y)), axis] < 0)
        return out

    def probes(self, x: np.ndarray, table: int, count: int) -> np.ndarray:
        """The ``count`` cells to look into first: least sum of squared distances to the nearest axes."""
        loss = codes = None
        for number in range(self.hashes):
            y = self.turned(x, table, number)
            more = (np.abs(y).max(axis=1, keepdims=True) - np.concatenate([y, -y], axis=1)) ** 2
            order = np.argsort(more, axis=1, kind="stable")[:, :count]
            more = np.take_along_axis(more, order, axis=1)
            if loss is None:
                loss, codes = more, order
                continue
            loss = (loss[:, :, None] + more[:, None, :]).reshape(len(x), -1)
            codes = (codes[:, :, None] * (2 * self.width) + order[:, None, :]).reshape(len(x), -1)
            best = np.argsort(loss, axis=1, kind="stable")[:, :count]
            loss, codes = np.take_along_axis(loss, best, axis=1), np.take_along_axis(codes, best, axis=1)
        return codes


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    """Vectors kept as bytes, in double precision."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1).astype(np.float64)


def _bands(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(axis=1)
    return np.rint(2 * (np.log2(most) + np.log2(np.linalg.norm(x / most[:, None], axis=1)))).astype(np.int64)


def clean_vectors(rows: DataFrame, vector: str) -> tuple[DataFrame, str] | None:
    """Distinct (vec_id, vec) of the rows that take part, and the type of the bytes; None if there are none."""
    single = isinstance(rows.schema[vector].dataType.elementType, T.FloatType)
    dtype, kind = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("v")).filter(
        "vec_id IS NOT NULL AND size(v) > 0")
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return None
    dim = common["n"]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            whole = np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1)
            x = np.ascontiguousarray(flat[whole] + 0.0, dtype)  # one zero, not two
            vecs = pa.Array.from_buffers(pa.binary(dim * x.itemsize), len(x), [None, pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(whole)), vecs.cast(pa.binary())],
                                             names=["vec_id", "vec"])

    return rows.filter(F.size("v") == dim).mapInArrow(run, "vec_id long, vec binary").distinct(), dtype


def _top(scores: np.ndarray, q: np.ndarray, v: np.ndarray, first: np.ndarray, keep: int):
    """(query, entry, score) of each query's ``keep`` best entries, best first, ties to the smaller first id.

    Products of matrices round by their shape; those near the last place are worked out again row by row.
    """
    if scores.shape[1] > keep:
        last = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1]
        row, col = np.nonzero(scores >= (last - 1e-9 * np.abs(last))[:, None])
    else:
        row, col = np.divmod(np.arange(scores.size), scores.shape[1])
    exact = (q[row] * v[col]).sum(axis=1)
    order = np.lexsort((first[col], -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < keep
    return row[best], col[best], exact[best]


def _found_batch(asked: np.ndarray, row, col, exact, entry, first) -> pa.RecordBatch:
    ends = np.searchsorted(row, np.arange(len(asked) + 1)).astype(np.int32)
    struct = pa.StructArray.from_arrays([pa.array(-exact), pa.array(first[col]), pa.array(entry[col])],
                                        names=["less", "first", "entry"])
    return pa.RecordBatch.from_arrays([pa.array(asked), pa.ListArray.from_arrays(pa.array(ends), struct)],
                                      names=["asked", "found"])


_FOUND = "asked long, found array<struct<less:double,first:long,entry:long>>"


def _search_cells(keep: int, dtype: str):
    """Rows sorted by (cell, block, turn, kind): entries of a block (kind 0), then the queries that look into it."""

    def run(batches: Batches) -> Batches:
        at, parts, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy() for c in ("cell", "block", "share", "kind")])
            starts = np.append(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1, batch.num_rows)
            begin = 0
            for end in starts.tolist():
                *here, kind = marks[:, begin].tolist()
                piece = batch.slice(begin, end - begin)
                begin = end
                if here != at:
                    at, parts, index = here, [], None
                if kind == 0:
                    parts.append(piece)
                elif parts:
                    if index is None:
                        index = (_matrix(pa.chunked_array([p.column("vec") for p in parts]).combine_chunks(), dtype),
                                 *(np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("entry", "first")))
                    v, entry, first = index
                    for k in range(0, piece.num_rows, 1024):
                        some = piece.slice(k, 1024)
                        q = _matrix(some.column("vec"), dtype)
                        yield _found_batch(some.column("entry").to_numpy(), *_top(q @ v.T, q, v, first, keep), entry, first)

    return run


def _merged(keep: int):
    """Rows sorted by query: its lists of several cells in one, without repeats, the best ``keep``."""

    def best(rows: pa.Table) -> pa.RecordBatch:
        lists = rows.column("found").combine_chunks()
        found = lists.flatten()
        less, first, entry = (found.field(n).to_numpy() for n in ("less", "first", "entry"))
        asked = np.repeat(rows.column("asked").to_numpy(), pc.list_value_length(lists).to_numpy())
        order = np.lexsort((entry, first, less, asked))
        columns = [x[order] for x in (asked, less, first, entry)]
        new = np.ones(len(order), bool)  # an entry has one score, so that repeats are neighbours
        new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[3][1:] != columns[3][:-1])
        asked, less, first, entry = (x[new] for x in columns)
        top = np.arange(len(asked)) - np.searchsorted(asked, asked) < keep
        asked, less, first, entry = (x[top] for x in (asked, less, first, entry))
        names, starts = np.unique(asked, return_index=True)
        ends = np.append(starts, len(asked)).astype(np.int32)
        struct = pa.StructArray.from_arrays([pa.array(x) for x in (less, first, entry)], names=["less", "first", "entry"])
        return pa.RecordBatch.from_arrays([pa.array(names), pa.ListArray.from_arrays(pa.array(ends), struct)],
                                          names=["asked", "found"])

    def run(batches: Batches) -> Batches:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= BLOCK:
                rows = pa.Table.from_batches(held)
                whole = pc.index(rows.column("asked"), rows.column("asked")[-1]).as_py()
                if whole:
                    yield best(rows.slice(0, whole))
                held, n = rows.slice(whole).to_batches(), rows.num_rows - whole
        if held:
            yield best(pa.Table.from_batches(held))

    return run


def _few(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast only if it has few rows."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _looked_into(entries: DataFrame, how: Polytope, probes: int, bands: list[int], keep: int, dtype: str) -> DataFrame:
    """(asked, found) of the entries that are asked for: the best ``keep`` of all cells they look into."""
    low, span = min(bands), how.tables * how.cells

    def code(batches: Batches) -> Batches:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                x = _matrix(some.column("vec"), dtype)
                band, wanted = _bands(x) - low, some.column("asked").to_numpy(zero_copy_only=False)
                cells = np.stack([band * span + t * how.cells + how.cell(x, t) for t in range(how.tables)], axis=1)
                looks = np.concatenate([t * how.cells + how.probes(x[wanted], t, probes) for t in range(how.tables)], axis=1)
                looks = np.concatenate([(b - low) * span + looks for b in bands], axis=1)
                sizes = np.where(wanted, looks.shape[1], 0)
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(s)]).astype(np.int32)),
                                                  pa.array(x.ravel()))
                         for s, x in ((np.full(len(x), how.tables), cells), (sizes, looks))]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("entry", "first", "vec")), *lists],
                                                 names=["entry", "first", "vec", "cells", "looks"])

    coded = stored(entries.select("entry", "first", "vec", "asked").mapInArrow(
        code, "entry long, first long, vec binary, cells array<long>, looks array<long>"), "coded")
    sizes = coded.select(F.explode("cells").alias("cell"), F.lit(1).alias("n"), F.lit(0).alias("m")).unionAll(
        coded.select(F.explode("looks").alias("cell"), F.lit(0).alias("n"), F.lit(1).alias("m")))
    parts = [F.ceil(F.sum(c) / BLOCK).cast("int") for c in ("n", "m")]
    large = _few(stored(sizes.groupBy("cell").agg(parts[0].alias("blocks"), parts[1].alias("shares"))
                        .filter("blocks > 1 OR shares > 1"), "large"))

    def dealt(kind: int, cells: str, own: str, others: str) -> DataFrame:
        """Each row in one of its own parts, beside every part of the other kind."""
        place = ("block", "share") if kind == 0 else ("share", "block")
        rows = coded.select(F.explode(cells).alias("cell"), F.lit(kind).alias("kind"), "entry", "first", "vec")
        own, others = (F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) for c in (own, others))
        return rows.join(large, "cell", "left").select(
            "cell", F.pmod(F.xxhash64("entry"), own).cast("int").alias(place[0]),
            F.explode(F.sequence(F.lit(0), others - 1)).alias(place[1]), "kind", "entry", "first", "vec")

    columns = ["cell", "block", "share", "kind", "entry", "first", "vec"]
    both = dealt(0, "cells", "blocks", "shares").select(columns).unionByName(
        dealt(1, "looks", "shares", "blocks").select(columns))
    found = both.repartition(*columns[:3]).sortWithinPartitions(*columns[:4]).mapInArrow(_search_cells(keep, dtype), _FOUND)
    return stored(found.repartition("asked").sortWithinPartitions("asked").mapInArrow(_merged(keep), _FOUND), "found")


def true_neighbours(entries: DataFrame, queries: np.ndarray, own: np.ndarray, keep: int, dtype: str) -> DataFrame:
    """(number, less, first, vec): the exact ``keep`` nearest entries of a bounded set of queries, without themselves."""

    def run(batches: Batches) -> Batches:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            v, first, entry = _matrix(batch.column("vec"), dtype), batch.column("first").to_numpy(), batch.column("entry").to_numpy()
            scores = queries @ v.T
            scores[own[:, None] == entry[None, :]] = -np.inf
            row, col, exact = _top(scores, queries, v, first, keep)
            real = own[row] != entry[col]
            row, col, exact = row[real], col[real], exact[real]
            new = pa.table({"number": row, "less": -exact, "first": first[col],
                            "vec": batch.column("vec").take(pa.array(col)).cast(pa.binary())})
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows > 4 * keep * len(queries):
                held = _best_rows(held, keep)
        if held is not None:
            yield from _best_rows(held, keep).combine_chunks().to_batches()

    rows = entries.select("entry", "first", "vec").mapInArrow(run, "number long, less double, first long, vec binary")
    rank = F.row_number().over(Window.partitionBy("number").orderBy("less", "first"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= keep)


def _best_rows(rows: pa.Table, keep: int) -> pa.Table:
    rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in ("number", "less", "first")]))
    number = rows.column("number").to_numpy()
    return rows.filter(pa.array(np.arange(len(number)) - np.searchsorted(number, number) < keep))


def fitted(entries: DataFrame, dim: int, n: int, dtype: str, keep: int, tables: int = TABLES, recall: float = RECALL
           ) -> tuple[Polytope, int, float]:
    """Hash tables for ``n`` entries, the cells per table and band to look into, and the share of true neighbours met.

    Fitted on SAMPLE queries at most, chosen by a hash; all entries are looked at.
    """
    sample = entries.filter("asked").orderBy(F.xxhash64("vec"), "entry").select("entry", "vec").limit(SAMPLE).collect()
    queries = np.frombuffer(b"".join(bytes(r["vec"]) for r in sample), dtype).reshape(-1, dim).astype(np.float64)
    true = true_neighbours(entries, queries, np.array([r["entry"] for r in sample]), keep, dtype).collect()
    number = np.array([r["number"] for r in true], np.int64)
    near = np.frombuffer(b"".join(bytes(r["vec"]) for r in true), dtype).reshape(-1, dim).astype(np.float64)
    axes = Polytope(dim, tables, 1).cells
    for hashes in range(max(1, int(np.log(max(n, 2) / CELL) / np.log(axes))), 0, -1):
        how = Polytope(dim, tables, hashes)
        most = axes if hashes == 1 else PROBES
        if not len(near):
            return how, most, 1.0
        ranks = np.full(len(near), most)
        for t in range(tables):
            looks = np.concatenate([how.probes(queries[k:k + 16], t, most) for k in range(0, len(queries), 16)])
            met = looks[number] == how.cell(near, t)[:, None]
            ranks = np.minimum(ranks, np.where(met.any(axis=1), met.argmax(axis=1), most))
        probes = int(np.sort(ranks)[int(np.ceil(recall * len(ranks))) - 1]) + 1
        if probes <= most:
            return how, probes, float((ranks < probes).mean())
    raise AssertionError("a single hash reaches every entry")


def neighbours(rows: DataFrame, vector: str = "embedding", k: int = 20, every: int = 20, tables: int = TABLES,
               recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found of every row whose id ``every`` divides."""
    spark = rows.sparkSession
    prepare(spark)
    empty = "query_id long, rank int, vec_id long, score double"
    cleaned = clean_vectors(rows, vector)
    if cleaned is None:
        return spark.createDataFrame([], empty)
    vectors, dtype = cleaned
    vectors, keep = stored(vectors, "vectors"), k + 1
    order = Window.partitionBy("vec").orderBy("vec_id")
    few = vectors.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= keep)
    grouped = few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = stored(grouped.select(F.monotonically_increasing_id().alias("entry"), F.col("ids")[0].alias("first"), "ids", "vec"),
                     "entries")
    queries = vectors.filter(F.col("vec_id") % every == 0)
    asked = stored(queries.join(entries.select("vec", "entry"), "vec").select(F.col("vec_id").alias("query_id"), "entry"), "asked")
    wanted = asked.select("entry").distinct().withColumn("asked", F.lit(True))
    entries_asked = stored(entries.join(wanted, "entry", "left").select(
        "entry", "first", "vec", F.coalesce("asked", F.lit(False)).alias("asked")), "entries-asked")
    one = entries_asked.select("vec").first()
    if one is None:
        return spark.createDataFrame([], empty)
    n, dim = entries_asked.count(), len(one["vec"]) // np.dtype(dtype).itemsize

    def bands(batches: Batches) -> Batches:
        seen = set()
        for batch in batches:
            if batch.num_rows:
                seen |= set(_bands(_matrix(batch.column(0), dtype)).tolist())
        yield pa.RecordBatch.from_pydict({"band": pa.array(sorted(seen), pa.int64())})

    # at most one number per half power of two that a double can have
    all_bands = sorted(r[0] for r in entries_asked.select("vec").mapInArrow(bands, "band long").distinct().collect())
    how, probes, _ = fitted(entries_asked, dim, n, dtype, k, tables, recall)
    found = _looked_into(entries_asked, how, probes, all_bands, keep, dtype)
    enough = found.filter(F.size("found") >= min(keep, n))
    short = stored(wanted.select("entry").join(enough.select(F.col("asked").alias("entry")), "entry", "left_anti")
                   .withColumn("asked", F.lit(True)), "short")
    if not short.isEmpty():
        again = entries_asked.drop("asked").join(short, "entry", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
        whole = Polytope(dim, 1, 1)
        found = enough.unionByName(_looked_into(again, whole, whole.cells, all_bands, keep, dtype))
    # equal vectors share a place; their ids take part one by one
    singles = found.select("asked", F.explode("found").alias("x")).select("asked", "x.less", "x.first", "x.entry")
    several = _few(stored(entries.filter(F.size("ids") > 1).select("entry", "ids"), "several"))
    ids = F.explode(F.coalesce("ids", F.array("first")))
    listed = (singles.join(several, "entry", "left").select("asked", "less", ids.alias("vec_id"))
              .groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("less", "vec_id"))).alias("near")))
    told = asked.join(_few(stored(listed, "listed")), F.col("entry") == F.col("asked"))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = told.select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"),
                      (-F.col("x.less")).alias("score"))
