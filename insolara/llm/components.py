"""Connected components of a link table, as a chain of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insolara.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; root is the least node it can reach.

    Links point from the larger to the smaller node. A node with several targets keeps the least
    one, and its other targets are linked to that one instead; this ends in a forest, whose paths
    are then halved until each node points at its root. Rows are grouped by the larger node, of
    which star-shaped links hold few, so a popular target is never one group. Self links, repeated
    links and links with a NULL end are ignored; without links the result is empty.
    """
    a, b = F.col("a"), F.col("b")
    pairs = links.filter(a != b).select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent")).distinct()
    pairs = stored(pairs, "links")
    while True:
        least = pairs.groupBy("child").agg(F.min("parent").alias("least"), F.count(F.lit(1)).alias("n"))
        many = stored(least.filter("n > 1").select("child", "least"), "links")
        if many.isEmpty():
            break
        moved = pairs.join(many, "child", "left")
        tied = moved.filter(F.col("least").isNotNull() & (F.col("parent") != F.col("least")))
        kept = moved.filter(F.col("least").isNull() | (F.col("parent") == F.col("least")))
        pairs = stored(kept.select("child", "parent").union(
            tied.select(F.col("parent").alias("child"), F.col("least").alias("parent"))).distinct(), "links")
    while True:
        above = pairs.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
        jumped = stored(pairs.join(above, "parent", "left"), "links")
        pairs = jumped.select("child", F.coalesce("above", "parent").alias("parent"))
        if jumped.filter("above IS NOT NULL").isEmpty():
            return pairs.select(F.col("child").alias("node"), F.col("parent").alias("root"))
