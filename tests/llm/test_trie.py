"""The prefix trie against a brute-force version in plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from insolara.llm import conversation_trie
from insolara.llm.queries import QUERIES, SQL

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += kids[path] == 0
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1].encode()) if path else 0
    out = []
    for path, convs in members.items():
        ended = ",".join(str(c) for c in sorted(convs) if built[c] == path)
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), kids[path], leaves[path],
                    saved[path], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=repr)


def invented(seed, convs=400):
    """Conversations that share first turns, copies of whole ones, long chains and a shared long beginning."""
    rng, rows = random.Random(seed), []
    chain = [("user", f"deep {i}") for i in range(60)]
    for c in range(0, 3 * convs, 3):
        kind = rng.random()
        if kind < 0.3:
            path = [("user", "hello")] * rng.randint(1, 4)
        elif kind < 0.45:
            path = chain[:rng.randint(40, 60)] + [("user", str(rng.randrange(3)))]
        else:
            path = [(rng.choice(["user", "assistant", None]), rng.choice(["", None, "é", "long text " * 20, "b"]))
                    for _ in range(rng.randint(1, 9))]
        rows += [(c + rng.randrange(2), t, *turn) for t, turn in enumerate(path)]
    return rows


def got(df):
    return sorted(map(tuple, conversation_trie.prefix_trie(df).select(COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("shard, single, turns", [(1 << 11, 1 << 14, 1 << 18), (40, 100, 200), (3, 5, 10)])
def test_against_brute_force(spark, monkeypatch, shard, single, turns):
    for name, value in (("SHARD", shard), ("SINGLE", single), ("TURNS", turns)):
        monkeypatch.setattr(conversation_trie, name, value)
    rows = invented(shard)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_id_ranges_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "ID_BITS", 3)
    rows = [(c, 0, "user", "same") for c in [*range(-20, 400, 7), 10 ** 12, 10 ** 12 + 1]]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_query_equals_brute_force_and_sql(spark, sf_dir):
    path = f"{sf_dir}/conversations.parquet"
    rows = [tuple(r) for r in spark.read.parquet(path).select("conv_id", "turn", "role", "text").collect()]
    want = brute(rows)
    made = QUERIES["op12_conversation_trie"](spark, sf_dir)
    assert sorted(map(tuple, made.select(COLUMNS).collect()), key=repr) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({SQL['op12_conversation_trie']})").fetchall(), key=repr) == want


def test_odd_and_empty_tables(spark):
    long_text = "word " * 100_000
    rows = [(None, 0, "user", "nobody's"), (1, None, "user", "a"), (1, None, "user", "a"), (1, 0, None, None), (1, 0, "b", "x"),
            (1, 0, "a", "y"), (5, 3, "user", long_text), (6, 3, "user", long_text), (7, 3, "user", ""), (-3, 0, "", "a"),
            (4, 1, "user", "x"), (4, 1, "user", "x"), (9, None, None, None)]
    wide = spark.createDataFrame([(*r, 1, 2, "p", 3) for r in rows], SCHEMA + ", depth int, pos int, path string, `a.b` int")
    negative = [(c, *r) for c, *r in rows if c is None or c >= 0]
    assert got(wide.filter("conv_id IS NULL OR conv_id >= 0")) == brute(negative)
    assert len(got(wide)) > 0
    assert got(wide.limit(0)) == [] and got(wide.filter("conv_id IS NULL")) == []
