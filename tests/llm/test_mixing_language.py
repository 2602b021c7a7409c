"""Source mixing and language ID."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import pytest

from insolara.llm import language_id, mixing
from insolara.llm.queries import QUERIES
from tests.llm.conftest import frame

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """Shares by weight 1, 2, 3, ..., refilled until none is above three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        unit = left / max(1e-9, sum(weights[s] for s in order if s not in capped))
        above = {s for s in order if s not in capped and unit * weights[s] > 3 * sizes[s] + 1e-9}
        if not above:
            return {s: 3.0 * sizes[s] if s in capped else unit * weights[s] for s in order}
        capped |= above


def check_mix(df):
    rows = {}
    sizes, held = defaultdict(int), defaultdict(list)
    for r in df.select("doc_id", "source", "text").collect():
        n = len(WORDS.findall(r["text"] or ""))
        rows.setdefault(r["doc_id"], []).append((r["source"], n))
        sizes[r["source"]] += n
        held[r["source"]].append(n)
    targets = brute_targets(sizes)
    got = mixing.mix_sources(df).collect()
    assert len(got) == sum(map(len, rows.values()))
    taken = defaultdict(int)
    for r in got:
        options = [(s, n) for s, n in rows[r["doc_id"]] if n == r["size"] and sizes[s] == r["source_size"]]
        assert options
        assert r["taken"] % r["size"] == 0 if r["size"] else r["taken"] == 0
        assert r["taken"] <= 3 * r["size"]
        assert any(r["target"] == pytest.approx(targets[s]) for s, _ in options)
        taken[options[0][0]] += r["taken"]
    return taken, targets, held


def test_mix_of_documents(documents):
    taken, targets, held = check_mix(documents)
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 0.02 * target


def test_mix_agrees_with_itself(documents):
    def take(df):
        return sorted(map(tuple, mixing.mix_sources(df).select("doc_id", "taken").collect()))

    assert take(documents) == take(documents.repartition(7))


def test_mix_of_odd_tables(odd, nothing):
    check_mix(odd)
    assert mixing.mix_sources(nothing).count() == 0
    assert mixing.mixed_documents(nothing).count() == 0


def test_targets_stop_at_three_times(spark):
    df = frame(spark, [(i, "w " * 5, "big" if i else "a") for i in range(100)], "doc_id long, text string, source string")
    taken, targets, _ = check_mix(df)
    assert targets == {"a": pytest.approx(15), "big": pytest.approx(485)} and taken == {"a": 15, "big": 485}
    tiny = mixing.fill_targets({"a": 1, "b": 1, "c": 98}, {"a": 1, "b": 2, "c": 3}, 100)
    assert tiny == {"a": 3, "b": 3, "c": 94}


def test_mixed_documents_repeat(documents):
    counts = {r["doc_id"]: r["count"] for r in mixing.mixed_documents(documents).groupBy("doc_id").count().collect()}
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_sources(documents).collect() if r["taken"]}
    assert counts == want and max(want.values()) > 1
    assert mixing.mixed_documents(documents).schema == documents.schema


def test_flow_of_overlapping_sources():
    """The largest flow, and the cheapest: repetition only where no fresh tokens are left."""
    flows = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 5}, {"a": 18, "b": 7})
    assert flows[("a",)]["a"] + flows[("a", "b")]["a"] == 18
    assert flows[("b",)]["b"] + flows[("a", "b")]["b"] == 7
    assert all(sum(f.values()) <= n for f, n in zip(flows.values(), (10, 10, 5)))  # 25 of 25 fresh tokens, none repeated
    more = mixing.route({("a",): 10, ("a", "b"): 10}, {"a": 30, "b": 20})
    assert sum(sum(f.values()) for f in more.values()) == 50
    assert sum(more[("a",)].values()) in range(20, 31) and sum(more[("a", "b")].values()) in range(20, 31)


def test_narrowing_over_many_documents(spark):
    """More documents than are taken at once: the rest of a target ends within a document or so."""
    df = spark.range(30_000).selectExpr("id doc_id", "repeat('w ', cast(1 + id % 9 as int)) text",
                                        "if(id % 3 = 0, 'x', if(id % 3 = 1, 'y', 'z')) source")
    got = mixing.mix_sources(df).groupBy("target").agg({"taken": "sum"}).collect()
    assert len(got) == 3 and all(abs(r["target"] - r["sum(taken)"]) <= 2 for r in got)


def test_held_out_accuracy(spark, sf_dir, documents):
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in documents.select("doc_id", "lang", "text").collect()}
    got = QUERIES["op9_language_id"](spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == set(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]][0] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got) and not any(r["rejected"] for r in got)


def test_language_of_odd_tables(odd, nothing):
    got = language_id.languages(odd).collect()
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["lang_pred"], r["score"], r["rejected"]))
    assert len(got) == odd.count()
    assert by[3] == by[4] == by[5] == {("und", 0.0, True)}
    assert language_id.languages(nothing).count() == 0
    kept = language_id.known_languages(odd)
    assert kept.schema == odd.schema and {3, 4, 5}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_far_text_is_rejected(documents):
    model = language_id.learn(documents)
    assert model.predict("ελληνικά κείμενα που δεν μοιάζουν με τίποτα γνωστό")[2]
    assert model.predict("12 34 %%%")[0] == "und"


def test_pieces_of_a_long_text_count_alike(monkeypatch):
    text = "Ab, cd é  ef-gh " * 40
    whole = language_id.gram_counts(text)
    monkeypatch.setattr(language_id, "CHUNK", 7)
    assert (language_id.gram_counts(text) == whole).all()
