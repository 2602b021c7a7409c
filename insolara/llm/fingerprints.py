"""SimHash document fingerprints in DataFrame expressions, and their search.

The terms of a text are its pairs of neighbouring words (and the last word alone), lower-cased. Each
term weighs as much as it has characters, since long words are rare; its 64-bit hash votes with that
weight, for or against every bit. Two votes are summed in each 64-bit number, so that one ordinary
hash aggregate with 32 sums counts them all inside generated code.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from insolara.llm.common import SPACE, prepare, shuffle_parts, text_of

LANES = 0x0000_0001_0000_0001
LOW = 0xFFFF_FFFF
BUCKETS_PER_PART = 4

# The characters that part words, for trimming.
BLANKS = " \t\n\x0b\x0c\r"


def vote(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, fp): the fingerprint of ``text`` for each value of ``keys``; without words it is 0.

    Shuffles nothing if ``rows`` are already distributed by some of the keys.
    """
    words = F.split(F.trim(F.lower(F.col(text)), F.lit(BLANKS)), SPACE)
    # no array is empty; the outer form, since the plain one would add a filter that builds them once more
    pairs = rows.select(*keys, words.alias("__w")).select(*keys, F.explode_outer(F.arrays_zip(
        F.col("__w").alias("a"), F.slice("__w", F.lit(2), F.size("__w")).alias("b"))).alias("__p"))
    term = pairs.select(*keys, F.xxhash64("__p.a", "__p.b").alias("__h"),
                        (F.length("__p.a") + F.coalesce(F.length("__p.b"), F.lit(0))).cast("long").alias("__weight"))
    sums = [F.sum(F.shiftrightunsigned("__h", i).bitwiseAND(F.lit(LANES)) * F.col("__weight")).alias(f"__s{i}")
            for i in range(32)]
    summed = term.groupBy(*keys).agg(F.sum("__weight").alias("__all"), *sums)

    def bit(count: Column, place: int) -> Column:
        value = (1 << place) - (1 << 64) if place == 63 else 1 << place
        return F.when(count * 2 > F.col("__all"), F.lit(value)).otherwise(F.lit(0))

    fp = F.lit(0).cast("long")
    for i in range(32):
        fp = fp.bitwiseOR(bit(F.col(f"__s{i}").bitwiseAND(F.lit(LOW)), i))
        fp = fp.bitwiseOR(bit(F.shiftrightunsigned(f"__s{i}", 32), i + 32))
    return summed.select(*keys, fp.alias("fp"))


def hexadecimal(column: str) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def likeness(a: str, b: str) -> Column:
    """Share of equal bits of two fingerprints, 0 to 1."""
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)


def _place(number: Column, splits: list[int]) -> Column:
    """How many of the sorted ``splits`` are not above ``number``, by a search in two steps."""
    if not splits:
        return F.lit(0)
    step = max(1, int(len(splits) ** 0.5))
    coarse = F.array(*(F.lit(s).cast("long") for s in splits[::step]))
    fine = F.array(*(F.lit(s).cast("long") for s in splits))
    block = F.size(F.filter(coarse, lambda s: s <= number)) - 1
    inside = F.size(F.filter(F.slice(fine, block * step + 1, F.lit(step)), lambda s: s <= number))
    return F.when(block < 0, F.lit(0)).otherwise(block * step + inside)


def with_next(docs: DataFrame) -> DataFrame:
    """Ranges of doc_id, each with the first document of the next range at its end.

    (bucket, rank, look, doc_id, text, next): ``next`` is the text of the following document, after the
    last one that of the first. Rows with ``look`` are such guests of their bucket. Rows without doc_id
    come last; they and rows with one doc_id follow by the hash of their text, then the text. Only
    range bounds and first ids, a few per partition, reach the driver; a text is shuffled once.
    """
    number, text = F.col("doc_id").cast("long"), text_of()
    base = docs.select(number.alias("doc_id"), text.alias("text"))
    count = BUCKETS_PER_PART * shuffle_parts(docs.sparkSession)
    shares = [i / count for i in range(1, count)]
    found = base.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] or []
    splits = sorted(set(found))
    lacking = len(splits) + 1  # the bucket of rows without doc_id
    bucket = F.when(F.col("doc_id").isNull(), F.lit(lacking)).otherwise(_place(F.col("doc_id"), splits))
    tie = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    firsts = base.filter("doc_id IS NOT NULL").groupBy(bucket.alias("b")).agg(F.min("doc_id")).collect()
    least = base.filter("doc_id IS NULL").agg(F.min(F.xxhash64("text"))).first()[0]
    used = sorted((b, first) for b, first in firsts)
    if least is not None:
        used.append((lacking, least))
    guests = [(*used[i], used[i - 1][0]) for i in range(len(used))]  # the first bucket's also ends the last one
    own, by_tie = [g for g in guests if g[0] != lacking], [g for g in guests if g[0] == lacking]
    goes = F.lit(None).cast("int")
    if own:
        homes = F.create_map(*(F.lit(x) for _, first, to in own for x in (first, to)))
        goes = F.get(F.map_values(F.map_filter(homes, lambda k, v: k == F.col("doc_id"))), F.lit(0))
        goes = F.when(F.col("doc_id").isin([first for _, first, _ in own]), goes)
    if by_tie:
        goes = F.when(F.col("doc_id").isNull() & (tie == F.lit(by_tie[0][1])), F.lit(by_tie[0][2])).otherwise(goes)
    at = F.array(F.struct(bucket.alias("bucket"), F.lit(False).alias("look")),
                 F.struct(goes.alias("bucket"), F.lit(True).alias("look")))
    placed = base.select("doc_id", "text", F.explode(at).alias("at")).select("at.*", "doc_id", "text").filter(
        "bucket IS NOT NULL")
    order = Window.partitionBy("bucket").orderBy("look", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "text")
    return placed.select("bucket", F.row_number().over(order).alias("rank"), "look", "doc_id", "text",
                         F.lead("text").over(order).alias("next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) per row of ``docs(doc_id, text)``; NULL text counts as empty and has fingerprint 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"),
                       F.monotonically_increasing_id().alias("__row"))
    return vote(rows, ["__row", "doc_id"], "text").select("doc_id", "fp")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of the text whose last half is replaced by the start of the next one.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row of
    ``docs(doc_id, text)``; halves and lengths are code points. See :func:`with_next` for the order.
    """
    prepare(docs.sparkSession)
    rows = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    both = rows.select("bucket", "rank", "look", "doc_id", n.cast("long").alias("n_chars"), "text",
                       edited.alias("edited")).withColumn("edited_sha256", F.sha2("edited", 256))
    facts = ["bucket", "rank", "look", "doc_id", "n_chars", "edited_sha256"]
    sides = both.select(*facts, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("text").alias("body")),
        F.struct(F.lit(1).alias("side"), F.col("edited").alias("body")))).alias("s")).select(*facts, "s.side", "s.body")
    marked = vote(sides, [*facts, "side"], "body")
    joined = marked.groupBy(*facts).agg(F.max(F.when(F.col("side") == 0, F.col("fp"))).alias("own"),
                                        F.max(F.when(F.col("side") == 1, F.col("fp"))).alias("other"))
    following = joined.withColumn("after", F.lead("own").over(Window.partitionBy("bucket").orderBy("rank")))
    return following.filter(~F.col("look")).select(
        "doc_id", "n_chars", "edited_sha256", hexadecimal("own").alias("fingerprint"),
        hexadecimal("other").alias("edited_fingerprint"), likeness("own", "other").alias("near_edited"),
        likeness("own", "after").alias("near_next"))


def search(known: DataFrame, asked: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(query, found, distance): all fingerprints ``fp`` of ``known`` within ``radius`` bits of each ``fp`` of ``asked``.

    Block tables: for every choice of ``blocks - radius`` blocks, a copy of the fingerprints permuted so
    that these blocks lead, and joined on that head with the queries; a pair within the radius agrees on
    at least one choice. Works on distinct fingerprints; documents are attached by joining on ``fp``.
    """
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]
    tables = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(
        F.lit(m - (1 << 64) if m >> 63 else m)).alias("head")) for i, m in enumerate(masks)))

    def heads(df: DataFrame, name: str) -> DataFrame:
        return df.select("fp").distinct().select(F.col("fp").alias(name), F.explode(tables).alias("x")).select(name, "x.*")

    near = heads(asked, "query").join(heads(known, "found"), ["t", "head"]).withColumn(
        "distance", F.bit_count(F.col("query").bitwiseXOR(F.col("found"))))
    return near.filter(F.col("distance") <= radius).select("query", "found", "distance").distinct()
