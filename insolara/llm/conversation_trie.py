"""The prefix trie of conversations, peeled from its deepest turns.

A node is a sequence of first turns. Every conversation carries the keys of its own prefixes (each key
digests the one before it and the next turn), so cutting off the last turn is taking the key before. The
trie is found and summed up in the same pass: from the greatest depth down, the nodes of a level are the
conversations that end there together with the nodes of the level below after their last turn is cut
off, grouped by key. What a node needs from its subtree arrives with its children.

Equal conversations are merged first. Levels are peeled in shards: a shard is the subtree below a node,
cut at the first node whose subtree holds at most SHARD turns besides one conversation, so no popular
first turn is one task's work. A shard's top hands its sums to its parent; the sums per parent, added up
by Spark, are the rows of the next round, which peels the crown above the shards in the same way, until
what is left is small.

Rows without conv_id belong to no conversation. Turns are ordered by turn (NULL first), then role and
text, so ties and repeated rows have one order; NULL role and text are empty. A base conversation that is
not in the table has no turns. Other columns are left out; an empty table has no nodes. Of one
conversation a task holds 24 bytes per turn, never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from insolara.llm.common import prepare, stored

Batches = Iterator[pa.RecordBatch]

# The rule by which conversations are rebuilt.
FAMILY, LONGEST_HEAD = 5, 8

KEY = 16
SHARD = 1 << 11
SINGLE = 1 << 14  # turns that one task peels whole
TURNS = 1 << 18  # turns of the shards that are peeled side by side
ID_BITS = 12  # conversation ids of a range that is joined to one text
SMALL = 50_000  # rows of a table that is broadcast

_NODES = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, bytes): place from 1, digest of role and text, size of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                role.alias("role"), text.alias("text")).filter("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), digest.alias("turn"),
                       F.octet_length("text").cast("long").alias("bytes"))


def rebuilt_turns(placed: DataFrame) -> DataFrame:
    """(conv_id, part, pos, turn, bytes): the base's first turns, then the own turns behind as many; one row without a turn each."""
    share = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(LONGEST_HEAD + 1)).cast("int")
    convs = placed.filter("pos = 1").select("conv_id", share.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    heads = placed.filter(F.col("pos") <= LONGEST_HEAD).withColumnRenamed("conv_id", "base")
    given = heads.join(convs, "base").filter("pos <= h").select("conv_id", F.lit(1).alias("part"), "pos", "turn", "bytes")
    own = placed.filter(F.col("pos") > share).select("conv_id", F.lit(2).alias("part"), "pos", "turn", "bytes")
    marks = convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("turn"),
                         F.lit(0).cast("long").alias("bytes"))
    return given.unionByName(own).unionByName(marks)


def _chained(batches: Batches) -> Batches:
    """Rows of conversations in order -> one row each with the keys of all its prefixes."""
    conv, keys, sizes, done = None, [], [], []

    def batch() -> pa.RecordBatch:
        names, paths, bytes_ = zip(*done)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), pa.array([len(p) // KEY for p in paths], pa.int32()), pa.array(paths, pa.binary()),
             pa.array(bytes_, pa.binary())], names=["conv_id", "depth", "path", "sizes"])

    def close() -> None:
        done.append((conv, b"".join(keys), np.array(sizes, "<i8").tobytes()))

    held = 0
    for rows in batches:
        for name, turn, size in zip(*(rows.column(c).to_pylist() for c in ("conv_id", "turn", "bytes"))):
            if name != conv:
                if conv is not None:
                    close()
                conv, keys, sizes = name, [], []
            if turn is not None:
                keys.append(hashlib.blake2b((keys[-1] if keys else b"") + turn, digest_size=KEY).digest())
                sizes.append(size)
                held += 1
        if held >= TURNS and done:
            yield batch()
            done, held = [], 0
    if conv is not None:
        close()
        yield batch()


def prefix_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, path, sizes) of every rebuilt conversation: keys of its prefixes, bytes of its texts."""
    placed = stored(placed_turns(conversations), "turns")
    rows = rebuilt_turns(placed).repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos")
    return stored(rows.mapInArrow(_chained, "conv_id long, depth int, path binary, sizes binary"), "paths")


def _last_key() -> Column:
    return F.expr(f"substring(path, {KEY} * (depth - 1) + 1, {KEY})")


def ends(paths: DataFrame) -> DataFrame:
    """(key, ends_sha256) of nodes at which conversations end. Ids are joined by ranges, then hashed in order as a stream."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    key = F.when(F.col("depth") > 0, _last_key()).otherwise(F.lit(b""))
    ranges = (paths.select(key.alias("key"), "conv_id").groupBy("key", F.shiftright("conv_id", ID_BITS).alias("range"))
              .agg(ids.alias("ids")))

    def run(batches: Batches) -> Batches:
        key, sha, keys, digests = None, None, [], []
        for rows in batches:
            for name, text in zip(rows.column("key").to_pylist(), rows.column("ids").to_pylist()):
                if name == key:
                    sha.update(b"," + text.encode())
                    continue
                if key is not None:
                    keys.append(key)
                    digests.append(sha.hexdigest())
                key, sha = name, hashlib.sha256(text.encode())
            if len(keys) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests)], names=["key", "ends_sha256"])
                keys, digests = [], []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([*keys, key], pa.binary()), pa.array([*digests, sha.hexdigest()])],
                                             names=["key", "ends_sha256"])

    return ranges.repartition("key").sortWithinPartitions("key", "range").mapInArrow(run, "key binary, ends_sha256 string")


def peel_levels(depth: np.ndarray, cut: np.ndarray, codes: np.ndarray, sizes: np.ndarray, own: dict[str, np.ndarray]) -> dict:
    """All nodes of a batch of shards, deepest first.

    Row r ends at ``depth[r]`` and brings its sums ``own``; ``codes`` and ``sizes`` hold key number and
    bytes of every turn, row after row. Rows of a shard share their key at depth ``cut``, the shard's top.
    Returns arrays: row (one that passes the node), depth, parent (number of the node, -1 for tops), sums.
    """
    starts = np.cumsum(depth) - depth
    by_depth = np.argsort(-depth, kind="stable")
    falling = -depth[by_depth]
    none = np.empty(0, np.int64)
    names = ("n", "low", "kids", "leaves", "saved")
    out = {k: [] for k in ("row", "depth", *names)}
    parents, number, above = [], 0, none
    nodes = {k: none for k in ("row", *names)}
    for d in range(int(depth.max()), int(cut.min()) - 1, -1):
        ended = by_depth[np.searchsorted(falling, -d, "left"):np.searchsorted(falling, -d, "right")]
        stays = cut[nodes["row"]] <= d  # tops of shards go no further
        merged = {k: np.concatenate([nodes[k][stays], own[k][ended]]) for k in names}
        merged["kids"][:stays.sum()] = 1
        row = np.concatenate([nodes["row"][stays], ended])
        code = codes[starts[row] + d - 1] if d else np.zeros(len(row), np.int64)
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.diff(code[order], prepend=-1)) if len(row) else none
        group = np.empty(len(row), np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(row))))
        if len(above):
            parent = np.full(len(above), -1, np.int64)
            parent[stays] = number + group[:stays.sum()]
            parents.append(parent)
        if len(row):
            nodes = {k: np.add.reduceat(merged[k][order], first) for k in ("n", "kids", "leaves", "saved")}
            nodes["low"] = np.minimum.reduceat(merged["low"][order], first)
            nodes["row"] = row[order][first]
            nodes["leaves"] = np.where(nodes["kids"] == 0, 1, nodes["leaves"])
            if d:
                nodes["saved"] += (nodes["n"] - 1) * sizes[starts[nodes["row"]] + d - 1]
        else:
            nodes = {k: none for k in ("row", *names)}
        above = np.arange(number, number + len(nodes["row"]))
        number += len(above)
        for k in ("row", *names):
            out[k].append(nodes[k])
        out["depth"].append(np.full(len(above), d))
    parents.append(np.full(len(above), -1, np.int64))
    return {k: np.concatenate(v) for k, v in out.items()} | {"parent": np.concatenate(parents)}


def _peel_table(rows: pa.Table) -> pa.RecordBatch:
    depth, cut, *sums = (rows.column(c).to_numpy().astype(np.int64)
                         for c in ("depth", "cut", "n", "low", "kids", "leaves", "saved"))
    paths, sizes = (rows.column(c).to_pylist() for c in ("path", "sizes"))
    keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEY), int(depth.sum()), [None, pa.py_buffer(b"".join(paths))])
    codes = keys.dictionary_encode().indices.to_numpy().astype(np.int64)
    found = peel_levels(depth, cut, codes, np.frombuffer(b"".join(sizes), "<i8"),
                        dict(zip(("n", "low", "kids", "leaves", "saved"), sums)))
    row, at, parent = found["row"], found["depth"], found["parent"]
    place = np.where(at > 0, (np.cumsum(depth) - depth)[row] + at - 1, 0)
    key = keys.take(pa.array(place)).cast(pa.binary()) if len(keys) else pa.array([b""] * len(row), pa.binary())
    key = pc.if_else(pa.array(at > 0), key, pa.scalar(b"", pa.binary()))
    top = (parent < 0) & (at > 0)
    up = [(paths[r][:KEY * (d - 1)], sizes[r][:8 * (d - 1)]) if t else (None, None)
          for r, d, t in zip(row.tolist(), at.tolist(), top.tolist())]
    columns = [key, pa.array(at), pa.array(found["low"]), pa.array(found["low"][np.maximum(parent, 0)], mask=parent < 0),
               *(pa.array(found[k]) for k in ("n", "kids", "leaves", "saved")), *(pa.array(x, pa.binary()) for x in zip(*up))]
    return pa.RecordBatch.from_arrays(columns, names=["key", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children",
                                                      "n_leaves", "saved_tokens", "up", "up_sizes"])


def _peel_shards(batches: Batches) -> Batches:
    """Whole shards, about TURNS turns at a time; rows come sorted by shard."""
    held, turns = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            turns += pc.sum(batch.column("depth")).as_py()
        if turns >= TURNS:
            rows = pa.concat_tables(held)
            whole = pc.index(rows.column("shard"), rows.column("shard")[-1]).as_py()
            if whole:
                yield _peel_table(rows.slice(0, whole))
                rows = rows.slice(whole)
            held, turns = [rows], pc.sum(rows.column("depth")).as_py()
    if held:
        yield _peel_table(pa.concat_tables(held))


def _looked_up(df: DataFrame, few: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join with a stored table, which is broadcast only if it has few rows."""
    return df.join(F.broadcast(few) if few.limit(SMALL + 1).count() <= SMALL else few, on, how)


def _peeled(rows: DataFrame) -> DataFrame:
    """Nodes (key and _NODES) of rows (depth, path, sizes, n, low, kids, leaves, saved), one per path."""
    total = rows.agg(F.sum(F.col("depth") + 1)).first()[0] or 0
    schema = f"key binary, {_NODES}, up binary, up_sizes binary"
    if total <= SINGLE:
        last = rows.withColumns({"cut": F.lit(0), "shard": F.lit(b"")}).coalesce(1)
        return stored(last.mapInArrow(_peel_shards, schema), "crown").drop("up", "up_sizes")
    turns = rows.filter("depth > 0").select("low", "depth", "path", F.explode(F.sequence(F.lit(1), "depth")).alias("d"))
    turns = turns.select("low", "depth", "d", F.expr(f"substring(path, {KEY} * (d - 1) + 1, {KEY})").alias("key"))
    left = F.col("depth").cast("long") - F.col("d") + 1
    heavy = stored(turns.groupBy("key").agg((F.sum(left) - F.max(left)).alias("turns")).filter(F.col("turns") > SHARD)
                   .select("key"), "heavy")
    heavy_part = _looked_up(turns, heavy, "key").groupBy("low", "depth").agg(F.max("d").alias("above"))
    cut = F.coalesce(F.col("above"), F.lit(0)) + 1
    marked = stored(rows.join(heavy_part, ["low", "depth"], "left").withColumn("cut", cut).drop("above"), "cut")
    shard = F.expr(f"substring(path, {KEY} * (cut - 1) + 1, {KEY})")
    sharded = marked.filter("depth >= cut").withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard")
    made = stored(sharded.mapInArrow(_peel_shards, schema), "peeled")
    sums = ["n", "kids", "leaves", "saved"]
    tops = made.filter("up IS NOT NULL").select(
        (F.col("depth") - 1).cast("int").alias("depth"), F.col("up").alias("path"), F.col("up_sizes").alias("sizes"),
        F.col("n_convs").alias("n"), F.col("conv_id").alias("low"), F.lit(1).cast("long").alias("kids"),
        F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    crown = (marked.filter("depth < cut").select(tops.columns).unionByName(tops).groupBy("depth", "path", "sizes")
             .agg(*(F.sum(c).alias(c) for c in sums), F.min("low").alias("low")))
    above = _peeled(stored(crown, "crown-rows"))
    parents = above.select(F.col("key").alias("up_key"), F.col("conv_id").alias("up_conv"))
    up_key = F.when(F.length("up") > 0, F.expr(f"substring(up, length(up) - {KEY - 1}, {KEY})")).otherwise(F.lit(b""))
    told = _looked_up(made.filter("up IS NOT NULL").withColumn("up_key", up_key), parents, "up_key")
    told = told.withColumn("parent_conv_id", F.col("up_conv")).select(above.columns)
    return made.filter("up IS NULL").select(above.columns).unionByName(told).unionByName(above)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row per node.

    ``conv_id`` is the smallest member of the node, ``parent_conv_id`` that of its parent (NULL for the root).
    """
    prepare(conversations.sparkSession)
    paths = prefix_paths(conversations)
    zero = F.lit(0).cast("long")
    rows = (paths.groupBy("depth", "path", "sizes").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"))
            .withColumns({"kids": zero, "leaves": zero, "saved": zero}))
    nodes = _peeled(stored(rows, "sequences"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return (nodes.join(ends(paths), "key", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", none).alias("ends_sha256")))
