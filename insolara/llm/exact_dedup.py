"""Exact duplicates by sorting content.

Spark samples splitters, range-partitions the rows by them and sorts each partition, spilling to
disk where needed. The order is that of the normalised text's first characters, then of a SHA-256
that stands for the rest (a sampled splitter must not carry a whole long text to the driver), then
of doc_id. Equal texts are then neighbours, and each row is compared in full with the one before it.
As the splitters hold the id too, a text that fills a third of the table spreads over many
partitions; its pieces are tied together by comparing the last text of a partition with the first
of the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insolara.llm.common import SPACE, prepare, shuffle_parts, stored, text_of

Batches = Iterator[pa.RecordBatch]

HEAD = 32

_ADDED = [("__part", "int"), ("__run", "long"), ("__first", "boolean"), ("__head", "long"), ("__from", "string"),
          ("__to", "string")]
_ARROW = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def _mark_runs(carried: int):
    """Numbers the runs of equal keys in a sorted partition.

    A data row gets its run, whether it starts it, and the id the run starts with. One more row per
    partition holds the first and the last text and the number and head of the last run.
    """

    def run(batches: Batches) -> Batches:
        part = TaskContext.get().partitionId()
        first = last = head = None
        number, schema = -1, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            carry, (key, ids) = [batch.column(i) for i in range(carried)], [batch.column(carried + i) for i in (0, 1)]
            schema = [c.type for c in carry]
            starts = np.ones(n, bool)
            starts[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
            starts[0] = last is None or key[0].as_py() != last
            if first is None:
                first = key[0].as_py()
            runs = number + np.cumsum(starts)
            at = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
            heads = ids.take(pa.array(np.maximum(at, 0)))
            if at[0] < 0:
                heads = pc.if_else(pa.array(at < 0), pa.scalar(head, pa.int64()), heads)
            last, head, number = key[n - 1].as_py(), heads[n - 1].as_py(), int(runs[-1])
            none = pa.nulls(n, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*carry, pa.array(np.full(n, part, np.int32)), pa.array(runs), pa.array(starts), heads, none, none],
                names=[*(f"c{i}" for i in range(carried)), *(c for c, _ in _ADDED)])
        if schema:
            edge = [part, number, None, head, first, last]
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(1, t) for t in schema), *(pa.array([v], _ARROW[k]) for v, (_, k) in zip(edge, _ADDED))],
                names=[*(f"c{i}" for i in range(carried)), *(c for c, _ in _ADDED)])

    return run


def _continued(edges: DataFrame) -> list[tuple[int, int, int, int | None]]:
    """(part, home part, home run, head) for each partition whose first run goes on from an earlier one.

    One row per partition comes to the driver, without its texts.
    """
    texts = edges.select("__part", "__run", "__head", "__from", "__to")
    parts = [r[0] for r in texts.select("__part").orderBy("__part").collect()]
    after = dict(zip(parts, parts[1:]))
    if not after:
        return []
    follows = F.create_map(*(F.lit(x) for pair in after.items() for x in pair))[F.col("__part")]
    before = texts.select(follows.alias("__next"), F.col("__to").alias("__before")).filter("__next IS NOT NULL")
    same = texts.join(before, (F.col("__part") == F.col("__next")) & (F.col("__from") == F.col("__before")), "left")
    found = same.select("__part", "__run", "__head", F.col("__next").isNotNull().alias("goes_on")).collect()
    out, home = [], None
    for part, run, head, goes_on in sorted(found, key=lambda r: r[0]):
        if goes_on:
            out.append((part, *home))
        if not (goes_on and run == 0):
            home = (part, run, head)
    return out


def grouped(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every row with ``__doc``, ``__sha``, ``__group``, ``__head`` (id that stays) and ``__stays``.

    Equal means identical after each run of ASCII white space became one space; NULL is empty. The
    least doc_id of a group heads it; rows without doc_id come last, and only if all lack one the
    head is NULL. Of repeated rows exactly one stays.
    """
    spark = docs.sparkSession
    prepare(spark)
    names = [f"c{i}" for i in range(len(columns))]
    whole = "text" in columns  # the text itself travels then, and its key is made again behind the shuffle

    def key(column: str) -> Column:
        return F.regexp_replace(text_of(column), SPACE, " ")

    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(columns, names)),
                        F.col("doc_id").cast("long").alias("__id"),
                        F.col("text").alias("__text") if whole else key("text").alias("__key"))
    of_text = key("__text") if whole else F.col("__key")
    order = [F.substring(of_text, 1, HEAD), F.sha2(of_text, 256)]
    dealt = plain.repartitionByRange(shuffle_parts(spark), *order, F.col("__id").asc_nulls_last())
    keyed = dealt.withColumn("__key", of_text).withColumns({"__head": F.substring("__key", 1, HEAD),
                                                           "__sha": F.sha2("__key", 256)})
    rows = keyed.sortWithinPartitions("__head", "__sha", F.col("__id").asc_nulls_last()).select(
        *names, F.col("__id").alias("__doc"), "__sha", "__key", "__id")
    kept = rows.columns[:-2]
    schema = T.StructType([T.StructField(f"c{i}", rows.schema[c].dataType) for i, c in enumerate(kept)]
                          + [T.StructField(c, {"int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(),
                                               "string": T.StringType()}[k]) for c, k in _ADDED])
    marked = stored(rows.mapInArrow(_mark_runs(len(kept)), schema), "runs")
    moved = _continued(marked.filter("__first IS NULL"))
    data = marked.filter("__first IS NOT NULL").withColumns({
        "__stays": F.col("__first"), "__group": F.shiftleft(F.col("__part").cast("long"), 40) + F.col("__run")})
    if moved:
        # at most one entry per partition
        homes = F.broadcast(spark.createDataFrame(
            [(p, 0, (hp << 40) + hr, h) for p, hp, hr, h in moved],
            "__part int, __run long, __home long, __home_head long"))
        data = data.join(homes, ["__part", "__run"], "left")
        away = F.col("__home").isNotNull()
        data = data.withColumns({"__stays": F.col("__stays") & ~away, "__group": F.coalesce("__home", "__group"),
                                 "__head": F.when(away, F.col("__home_head")).otherwise(F.col("__head"))})
    final = {f"c{i}": c for i, c in enumerate(kept)}
    back = dict(zip(names, columns))
    return data.select(*(F.col(c).alias(back.get(n, n)) for c, n in final.items()), "__group", "__head", "__stays")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs(doc_id, text)``.

    See :func:`grouped` for equality, NULLs and ties; ``text_sha256`` is of the normalised text.
    Sizes of groups of one are not stored, so the size table holds repeated texts only.
    """
    rows = stored(grouped(docs, []), "members")
    sizes = stored(rows.groupBy("__group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    return rows.join(sizes, "__group", "left").select(
        F.col("__doc").alias("doc_id"), F.col("__head").alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("__stays").alias("kept"),
        F.col("__sha").alias("text_sha256"))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they came."""
    columns = docs.columns
    return grouped(docs, columns).filter("__stays").select(*(f"`{c}`" for c in columns))
