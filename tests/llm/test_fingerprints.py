"""Native fingerprints, their search, and the neighbours in doc_id order."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from insolara.llm import fingerprints
from insolara.llm.queries import QUERIES
from tests.llm.conftest import frame


def brute_votes(spark, texts):
    """Terms and votes in Python; the hashes of the terms by one Spark expression."""
    terms = []
    for number, text in enumerate(texts):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
        terms += [(number, a, b) for a, b in zip(words, [*words[1:], None])]
    hashed = frame(spark, terms, "n long, a string, b string").select("n", "a", "b", F.xxhash64("a", "b")).collect()
    votes = {}
    for number, a, b, h in hashed:
        count = votes.setdefault(number, [0] * 64)
        for bit in range(64):
            count[bit] += (1 if h >> bit & 1 else -1) * (len(a) + len(b or ""))
    return [sum(1 << bit for bit in range(64) if votes[n][bit] > 0) if n in votes else 0 for n in range(len(texts))]


def check_edited(spark, df):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()),
                  key=lambda r: (r[0] is None, r[0] or 0))
    named = [r for r in rows if r[0] is not None]
    got = fingerprints.edited_fingerprints(df).collect()
    assert len(got) == len(rows)
    fps = dict(zip([t for _, t in rows], brute_votes(spark, [t for _, t in rows])))
    found = {r["doc_id"]: r for r in got}
    for (doc_id, text), (_, after) in zip(named, named[1:] + rows[len(named):len(named) + 1] or named[:1]):
        if doc_id == named[-1][0] and len(rows) > len(named):
            continue  # the order of rows without doc_id is a hash
        half, r = len(text) // 2, found[doc_id]
        edited = text[:len(text) - half] + after[:half]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert int(r["fingerprint"], 16) == fps[text]
        own, other = int(r["fingerprint"], 16), int(r["edited_fingerprint"], 16)
        assert r["near_edited"] == 1 - (own ^ other).bit_count() / 64
        assert r["near_next"] == 1 - (own ^ fps[after]).bit_count() / 64


def test_edited_equals_brute_force(spark, documents):
    check_edited(spark, documents)


def test_last_document_is_followed_by_the_first(spark, documents, texts):
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(documents).collect()}
    last, first = max(texts), min(texts)
    half = len(texts[last]) // 2
    edited = texts[last][:len(texts[last]) - half] + texts[first][:half]
    assert got[last]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_odd_tables(spark, odd, nothing):
    got = fingerprints.edited_fingerprints(odd).collect()
    assert len(got) == odd.count()
    assert {r["fingerprint"] for r in got if r["doc_id"] in (3, 4, 5)} == {"0" * 16}
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (1, 2, -5)}) == 1
    assert fingerprints.edited_fingerprints(nothing).count() == 0
    one = frame(spark, [(1, "just the one text")])
    row = fingerprints.edited_fingerprints(one).first()
    assert row["near_next"] == 1.0


def test_query_has_a_row_per_document(spark, sf_dir, texts):
    got = QUERIES["op7_document_fingerprints"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    assert sum(r["near_edited"] > r["near_next"] for r in got) > 0.9 * len(got)


def test_no_python_in_the_plan(documents, capsys):
    fingerprints.edited_fingerprints(documents).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_search_finds_all_within_the_radius(spark):
    rng = random.Random(6)
    known = [rng.getrandbits(64) for _ in range(400)]
    known += [k ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for k in known[:200]]
    asked = known[::7] + [0]
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in known]
    ask = [(f - (1 << 64) if f >> 63 else f,) for f in asked]
    got = {(q % (1 << 64), f % (1 << 64), d) for q, f, d in fingerprints.search(
        frame(spark, signed, "fp long"), frame(spark, ask, "fp long")).collect()}
    assert got == {(q, f, (q ^ f).bit_count()) for q in asked for f in known if (q ^ f).bit_count() <= 3}
