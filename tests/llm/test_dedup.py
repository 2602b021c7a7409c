"""Exact and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from insolara.llm import simhash_dedup
from insolara.llm.components import connected_components
from insolara.llm.exact_dedup import distinct_texts, exact_duplicates
from insolara.llm.queries import QUERIES, SQL
from tests.llm.conftest import frame
from tests.oracle import compare, connect

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def brute_exact(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(SPACES.sub(" ", text or ""), []).append(doc_id)
    return {k: (min((i for i in v if i is not None), default=None), len(v)) for k, v in groups.items()}


def check_exact(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    groups = brute_exact(rows)
    got = exact_duplicates(df).collect()
    assert len(got) == len(rows)
    want = sorted(((i, *groups[SPACES.sub(" ", t or "")], hashlib.sha256(SPACES.sub(" ", t or "").encode()).hexdigest())
                   for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_equals_brute_force(documents, odd, nothing):
    check_exact(documents)
    check_exact(odd)
    assert exact_duplicates(nothing).count() == 0


def test_exact_query_equals_sql(spark, sf_dir):
    assert compare(QUERIES["op8_exact_dedup"](spark, sf_dir), connect(sf_dir), SQL["op8_exact_dedup"]) is None


def test_group_over_many_partitions(spark):
    """A text that fills half the table starts and ends inside partitions and fills some."""
    rows = [(i, "the hot text" if i % 2 else f"text {i % 300} of {i % 7}") for i in range(4000)]
    check_exact(frame(spark, rows).repartition(5))


def test_distinct_texts_keeps_columns(odd):
    kept = distinct_texts(odd)
    assert kept.schema == odd.schema
    rows = kept.collect()
    keys = [SPACES.sub(" ", r["text"] or "") for r in rows]
    assert len(set(keys)) == len(keys) == 8
    assert {r["doc_id"] for r in rows if r["text"] and r["text"].startswith("Same")} == {-5}


def brute_fingerprint(text):
    words = [w for w in SPACES.split("".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= 4) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(fps))]


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_near_equals_brute_force(request, which):
    df = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    want = list(zip([i for i, _ in rows], fps, brute_components(fps, [i for i, _ in rows])))
    got = [(r[0], r[1] % (1 << 64), r[2]) for r in simhash_dedup.near_duplicates(df).select("doc_id", "fp", "component_id").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_near_of_empty_table(nothing):
    assert simhash_dedup.near_duplicates(nothing).count() == 0
    assert simhash_dedup.keep_one(nothing).count() == 0


def test_links_with_small_groups_reach_the_same_components(spark):
    """Groups above the bound are joined again on further blocks; chains and a dense cluster stay whole."""
    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(300)}
    centre = rng.getrandbits(64)
    fps |= {centre ^ sum(1 << b for b in rng.sample(range(20, 40), rng.randint(1, 6))) for _ in range(400)}
    chain = rng.getrandbits(64)
    for _ in range(30):
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
        fps.add(chain)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    want = brute_components(fps, list(range(len(fps))))
    for bound in (40, 32_768):
        links = simhash_dedup.fingerprint_links(frame(spark, signed, "fp long"), group_rows=bound)
        roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
        label = [roots.get(s[0], s[0]) for s in signed]
        assert len(set(label)) == len(set(want))
        assert len(set(zip(label, want))) == len(set(want))


def test_keep_one_takes_effect(documents):
    kept = simhash_dedup.keep_one(documents)
    assert kept.schema == documents.schema
    heads = simhash_dedup.near_duplicates(documents).select("component_id").distinct().count()
    assert kept.count() == heads < documents.count()


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3), (130, 300), (300, 299)]
    got = {r["node"]: r["root"] for r in connected_components(frame(spark, links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 51))
    assert all(got[i] == 100 for i in [*range(101, 140), 299, 300])
    assert connected_components(frame(spark, [], "a long, b long")).count() == 0
