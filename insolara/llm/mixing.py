"""Mixing overlapping sources to target weights by a minimum-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). The flow sends
token capacity from patterns to the quotas of their sources; the r-th repetition of a pattern costs
r - 1 per token, so that documents repeat as evenly as the quotas allow. A pattern's flow then
becomes whole copies of all its documents and one more copy of some, chosen in the order of a seeded
hash: counts per hash range narrow down to the place where the rest of the flow ends. Only tables
of the size of patterns and hash ranges reach the driver.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insolara.llm.common import WORD, prepare, stored, text_of

BITS = 4
LAST = 1000
TAIL = 64


def fill_targets(sizes: dict, weights: dict, total: float, most: float = 3.0) -> dict:
    """Shares of ``total`` by weight; none above ``most`` times its size, the excess shared anew by weight."""
    targets, left = {}, float(total)
    open_ = {s for s in sizes if weights[s] > 0}
    while open_:
        unit = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if unit * weights[s] > most * sizes[s]}
        if not full:
            targets |= {s: unit * weights[s] for s in open_}
            break
        for s in full:
            targets[s] = float(most * sizes[s])
            left -= targets[s]
        open_ -= full
    return {s: targets.get(s, 0.0) for s in sizes}


def route(patterns: dict[tuple, int], quotas: dict, most: int = 3) -> dict[tuple, dict]:
    """Tokens that each pattern gives to each of its sources: the cheapest of the largest flows.

    ``patterns`` maps the sources of a pattern to its tokens. Successive shortest paths.
    """
    nodes = {"from": 0, "to": 1}
    for p in patterns:
        nodes["p", p] = len(nodes)
    for s in quotas:
        nodes["s", s] = len(nodes)
    out: list[list[int]] = [[] for _ in nodes]
    ends, room, cost = [], [], []

    def arc(a: int, b: int, capacity: int, price: int) -> int:
        for x, y, c, k in ((a, b, capacity, price), (b, a, 0, -price)):
            out[x].append(len(ends))
            ends.append(y)
            room.append(c)
            cost.append(k)
        return len(ends) - 2

    given = {}
    for p, tokens in patterns.items():
        for copy in range(most):
            arc(0, nodes["p", p], tokens, copy)
        for s in p:
            given[p, s] = arc(nodes["p", p], nodes["s", s], most * tokens, 0)
    for s, quota in quotas.items():
        arc(nodes["s", s], 1, quota, 0)
    while True:
        far, by = {0: 0}, {}
        queue, waiting = deque([0]), {0}
        while queue:
            x = queue.popleft()
            waiting.discard(x)
            for e in out[x]:
                if room[e] and far[x] + cost[e] < far.get(ends[e], 1 << 62):
                    far[ends[e]], by[ends[e]] = far[x] + cost[e], e
                    if ends[e] not in waiting:
                        queue.append(ends[e])
                        waiting.add(ends[e])
        if 1 not in far:
            break
        path, x = [], 1
        while x:
            path.append(by[x])
            x = ends[by[x] ^ 1]
        step = min(room[e] for e in path)
        for e in path:
            room[e] -= step
            room[e ^ 1] += step
    flows: dict[tuple, dict] = {p: {} for p in patterns}
    for (p, s), e in given.items():
        flows[p][s] = room[e ^ 1]
    return flows


@dataclass
class Mix:
    """What a mix takes: per pattern its whole copies, the hash below which one more is taken, and odd picks."""

    sizes: dict
    targets: dict
    copies: dict = field(default_factory=dict)
    below: dict = field(default_factory=dict)
    picks: list = field(default_factory=list)


def seeded(seed: int) -> Column:
    """A hash of doc_id in [0, 2^62); rows that share a doc_id share it."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), 2)


def _fill(held: list[tuple[int, int]], left: int) -> list[int]:
    """Hashes of the (hash, size) entries to take: the first that fit, then of the last TAIL ones the fullest set."""
    chosen = []
    for u, size in held[:-TAIL]:
        if 0 < size <= left:
            left -= size
            chosen.append(u)
    tail = [(u, size) for u, size in held[-TAIL:] if 0 < size <= left]
    reach, within = [1], (1 << left + 1) - 1  # bit n: some of the entries so far make n
    for _, size in tail:
        reach.append((reach[-1] | reach[-1] << size) & within)
    at = reach[-1].bit_length() - 1
    for (u, size), before in zip(reversed(tail), reversed(reach[:-1])):
        if not before >> at & 1:
            at -= size
            chosen.append(u)
    return chosen


def _ends(rows: DataFrame, wanted: dict, counts: dict, key: Callable[[tuple], str]) -> tuple[dict, list]:
    """For each pattern the hash up to which its documents fill ``wanted`` tokens, and picks beyond it.

    ``rows(pattern, u, size)`` holds ``counts`` rows of each pattern. Each round splits the range where a pattern's sum passes its wanted
    tokens into 2^BITS parts and sums those, until the range holds LAST documents or fewer, or one hash.
    These are then taken by :func:`_fill`.
    """
    low, width, left = {p: 0 for p in wanted}, 62, dict(wanted)
    picks, todo = [], set(wanted)

    def narrowed(patterns: set) -> DataFrame:
        state = [(key(p), low[p]) for p in patterns]
        frame = F.broadcast(rows.sparkSession.createDataFrame(state, "pattern string, low long"))
        span = 1 << width
        return rows.join(frame, "pattern").filter((F.col("u") >= F.col("low")) & (F.col("u") - F.col("low") < span))

    names = {key(p): p for p in wanted}
    counts = dict(counts)
    while todo:
        small = {p for p in todo if counts[p] <= LAST}
        if small or width == 0:
            found: dict = {}
            if small:
                for name, u, size in narrowed(small).groupBy("pattern", "u").agg(F.sum("size")).collect():
                    found.setdefault(names[name], []).append((u, size))
            for p, held in found.items():
                picks.extend((p, u) for u in _fill(sorted(held), left[p]))
            todo -= small if width else todo
            if not todo:
                break
        step = min(BITS, width)
        part = F.shiftright(F.col("u") - F.col("low"), width - step)
        sums: dict = {}
        for name, k, size, n in narrowed(todo).groupBy("pattern", part.alias("k")).agg(
                F.sum("size"), F.count(F.lit(1))).collect():
            sums.setdefault(names[name], {})[k] = (size, n)
        width -= step
        for p in list(todo):
            for k in sorted(sums.get(p, {})):
                size, n = sums[p][k]
                if size > left[p]:
                    low[p] += k << width
                    counts[p] = n
                    break
                left[p] -= size
            else:  # all of it fits
                low[p], counts[p] = 1 << 62, 0
                todo.discard(p)
    return low, picks


def plan_mix(rows: DataFrame, weights: Callable[[list], dict], most: int = 3) -> Mix:
    """The mix of ``rows(sources, pattern, size, u)`` whose targets share all sizes by ``weights(sources)``.

    ``sources`` is the sorted array of a document's sources, ``pattern`` its text form. The patterns
    and their sums come to the driver: their number is that of the source combinations in use.
    """
    found = rows.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("size"),
                                         F.count(F.lit(1)).alias("n")).collect()
    patterns = {tuple(r["sources"]): r["size"] for r in found}
    names = {tuple(r["sources"]): r["pattern"] for r in found}
    sizes: dict = {}
    for p, size in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    mix = Mix(sizes, fill_targets(sizes, weights(order), sum(patterns.values()), most))
    flows = route(patterns, {s: round(mix.targets[s]) for s in order}, most)
    wanted = {}
    for p, size in patterns.items():
        flow = sum(flows[p].values())
        mix.copies[p], rest = divmod(flow, size) if size else (0, 0)
        if rest:
            wanted[p] = rest
    counts = {tuple(r["sources"]): r["n"] for r in found}
    below, picks = _ends(rows, wanted, counts, names.__getitem__)
    mix.copies = {names[p]: c for p, c in mix.copies.items()}
    mix.below = {names[p]: u for p, u in below.items()}
    mix.picks = [(names[p], u) for p, u in picks]
    return mix


def with_copies(rows: DataFrame, mix: Mix) -> DataFrame:
    """``rows`` with ``copies``, how often the mix takes each; reads ``pattern`` and ``u``, shuffles nothing.

    The joined tables have a row per pattern and at most LAST picks each.
    """
    spark = rows.sparkSession
    state = [(p, c, mix.below.get(p, 0)) for p, c in mix.copies.items()]
    by_pattern = F.broadcast(spark.createDataFrame(state, "pattern string, whole long, below long"))
    picked = F.broadcast(spark.createDataFrame([(p, u, 1) for p, u in mix.picks], "pattern string, u long, pick int"))
    more = (F.col("u") < F.col("below")) | F.col("pick").isNotNull()
    joined = rows.join(by_pattern, "pattern", "left").join(picked, ["pattern", "u"], "left")
    return joined.withColumn("copies", F.col("whole") + F.when(more, 1).otherwise(0)).drop("whole", "below", "pick")


def repeating_weights(sources: list) -> dict:
    """1, 2, 3, 1, 2, 3, ... in the order given."""
    return {s: i % 3 + 1 for i, s in enumerate(sources)}


def _measured(docs: DataFrame, seed: int) -> DataFrame:
    source = F.col("source").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.array(source).alias("sources"),
        _pattern(source).alias("pattern"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        seeded(seed).alias("u"))


def _pattern(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("-"))


def mix_sources(docs: DataFrame, seed: int = 7, most: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row of ``docs(doc_id, text, source)``.

    Sizes are words. Sources in code point order, NULL last, weigh 1, 2, 3, 1, ...; targets share all
    words by weight up to ``most`` times a source's size. Rows that share a doc_id (or lack one) within
    a source are taken together. An empty table gives no rows; a text without words is never taken.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = stored(_measured(docs, seed), "sizes")
    mix = plan_mix(rows, repeating_weights, most)
    state = [("-" if s is None else f"s{s}", size, mix.targets[s]) for s, size in mix.sizes.items()]
    facts = F.broadcast(spark.createDataFrame(state, "pattern string, source_size long, target double"))
    return with_copies(rows, mix).join(facts, "pattern", "left").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 7, most: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns as they came, each as often as the mix takes it (0 to ``most`` times)."""
    prepare(docs.sparkSession)
    mix = plan_mix(stored(_measured(docs, seed), "sizes"), repeating_weights, most)
    packed = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), seeded(seed).alias("u"),
                         _pattern(F.col("source").cast("string")).alias("pattern"))
    counted = with_copies(packed, mix).filter("copies > 0")
    return counted.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
