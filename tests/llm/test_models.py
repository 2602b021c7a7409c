"""LM scores, secret scans and the pipeline."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from insolara.llm import exact_dedup, lm_score, secret_scan, simhash_dedup
from insolara.llm.queries import QUERIES
from tests.llm.conftest import frame


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    flat = rng.normal(0, 0.3, lm_score.SIZE).astype(np.float64)
    near, token = rng.integers(0, lm_score.PAD, (40, 4)), rng.integers(0, lm_score.PAD, 40)
    gradient = np.zeros(lm_score.SIZE)
    lm_score.forward(lm_score.views(flat), near, token, lm_score.views(gradient))
    for at in rng.choice(np.flatnonzero(gradient), 40):
        step = np.zeros(lm_score.SIZE)
        step[at] = 1e-5
        up, down = (-lm_score.forward(lm_score.views(flat + s * step), near, token).mean() for s in (1, -1))
        assert gradient[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


def test_probabilities_sum_to_one():
    flat = lm_score.start_weights(np.log(np.full(lm_score.PAD, 1 / lm_score.PAD)), 1)
    near = np.tile(np.array([[3, 9, lm_score.PAD, 70]]), (lm_score.PAD, 1))
    logs = lm_score.forward(lm_score.views(flat), near, np.arange(lm_score.PAD))
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_rows_of_all_classes_are_normalised_together(monkeypatch):
    """Two calls for all rows, however many classes they have, and the chances of a plain computation."""
    calls, plain = [], lm_score._log_chances
    monkeypatch.setattr(lm_score, "_log_chances", lambda *a: calls.append(len(a[0])) or plain(*a))
    rng = np.random.default_rng(6)
    w = lm_score.views(rng.normal(0, 0.3, lm_score.SIZE))
    near, token = rng.integers(0, lm_score.PAD, (500, 4)), rng.integers(0, lm_score.PAD, 500)
    logs = lm_score.forward(w, near, token)
    assert calls == [500, 500]
    for i in range(0, 500, 25):
        h, (c, place) = np.tanh(w["embed"][near[i]].ravel() @ w["mix"] + w["shift"]), divmod(token[i], lm_score.PLACES)
        a, b = h @ w["classes"] + w["class_bias"], w["places"][c] @ h + w["place_bias"][c]
        assert logs[i] == pytest.approx(a[c] - np.log(np.exp(a).sum()) + b[place] - np.log(np.exp(b).sum()))


def test_words_are_counted_once_for_ranks_and_total(spark):
    df = frame(spark, [(1, " a b\tA\n"), (2, None), (3, "b c a"), (4, "")])
    words, unigrams = lm_score.vocabulary(df)
    assert dict(words) == {b"a": 0, b"b": 1, b"c": 2}
    counts = np.ones(lm_score.PAD)
    counts[:3] += [3, 2, 1]
    assert unigrams == pytest.approx(np.log(counts / counts.sum()))


def test_frequent_words_of_equal_counts_go_by_name(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "OWN", 2)
    words, unigrams = lm_score.vocabulary(frame(spark, [(1, "c b d a a"), (2, "a b c")]))
    assert dict(words) == {b"a": 0, b"b": 1}
    counts = np.ones(lm_score.PAD)
    counts[:2] += [3, 2]
    counts[2:] += 3 / (lm_score.PAD - 2)
    assert unigrams == pytest.approx(np.log(counts / counts.sum()))


def test_windows_see_both_sides_of_their_own_document():
    found = lm_score.Windows.of([np.array([1, 2, 3]), np.array([], np.int64), np.array([4])])
    pad = lm_score.PAD
    assert found.around(found.places).tolist() == [[pad, pad, 2, 3], [pad, 1, 3, pad], [1, 2, pad, pad], [pad] * 4]
    assert found.owner.tolist() == [0, 0, 0, 2]


def test_scores_beat_unigrams_and_order_of_words_counts(documents, texts):
    model = lm_score.train(documents, rounds=2)
    words, unigrams = lm_score.vocabulary(documents)
    good = [t for t in texts.values() if len(t.split()) > 100][:80]
    tokens = [words.tokens(t.lower()) for t in good]
    scores = lm_score.document_scores(model.weights, tokens)
    assert scores.sum() > sum(unigrams[t].sum() for t in tokens)
    rng = np.random.default_rng(2)
    mixed = lm_score.document_scores(model.weights, [rng.permutation(t) for t in tokens])
    assert (scores > mixed).mean() > 0.6


def test_lm_query_scores_every_document(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in QUERIES["op6_lm_scoring"](spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    assert all(r["n_tokens"] == len(texts[d].encode().split()) and r["log_prob"] <= 0 for d, r in got.items())


def test_lm_of_odd_tables(odd, nothing):
    got = lm_score.pseudo_likelihood(odd).collect()
    assert len(got) == odd.count()
    assert all(r["log_prob"] == 0 and r["mean_log_prob"] is None for r in got if r["doc_id"] in (3, 4, 5))
    assert lm_score.pseudo_likelihood(nothing).count() == 0


def test_secrets_equal_those_planted(spark, sf_dir, documents):
    planted = [(100_000 + i, f"the words before token = \"{i:040x}\" and after") for i in range(11, 20)]
    planted += [(200_000 + i, f"some prose AKIA{'ABCDEFGH2345JKLM'[i:]}{'Q' * i} goes on") for i in range(5)]
    planted += [(300_000 + i, f"open password={(7919 ** (i + 4)) % 16 ** 18:018x} thing") for i in range(8)]
    clean = [(400_000, "averyveryverylongwordwithoutanysecret card 4123412341234123 mail some.body.far.away@example.com"),
             (400_001, "http://example.com/a/very/long/path/to/some/page.html")]
    df = documents.select("doc_id", "text").union(frame(spark, planted + clean))
    got = {(r["doc_id"], r["secret"]) for r in secret_scan.scan(df).collect()}
    want = set()
    for doc_id, text in df.collect():
        for m in re.finditer(r'token = "([0-9a-f]{40})"|password=([0-9a-f]{18})|(AKIA[0-9A-Z]{16})', text or ""):
            want.add((doc_id, next(x for x in m.groups() if x)))
    assert len(want) >= 22 and got == want


def test_secret_features_equal_plain_ones(spark):
    df = frame(spark, [(1, 'x key: "aB3dEf7h+/kLm-No" y'), (2, "see http://host.example.com/aaaaaaaaaaaaaaaaaaaa now")])
    rows = {r["doc_id"]: r for r in secret_scan.with_features(secret_scan.candidates(df), ["ef", "no"]).collect()}
    one, two = rows[1], rows[2]
    core = "aB3dEf7h+/kLm-No"
    assert one["core"] == core and one["word_no"] == 2 and one["length"] == 16
    assert one["digits"] == 2 / 16 and one["uppers"] == 4 / 16 and one["marks"] == 3 / 16 and one["hex_only"] == 0
    assert one["distinct"] == len(set(core)) / 16 and one["covered"] == pytest.approx(4 / 16)
    assert one["assigned"] == one["announced"] == one["quoted"] == one["prefixed"] == 1 and one["is_path"] == 0
    assert two["is_path"] == 1 and two["announced"] == 0


def test_scans_of_odd_tables(odd, nothing):
    assert secret_scan.scan(odd).count() == 0
    assert secret_scan.scan(nothing).count() == 0


def test_scan_has_no_python_in_the_plan(documents, capsys):
    secret_scan.scan(documents).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_pipeline_stages(spark, sf_dir, documents):
    """Each stage against what its operator says about the rows before it."""
    rows, docs = [], documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == documents.columns, name
        rows.append((docs, after))
        docs = after.persist()
    (before, known), (_, distinct), (_, alone), (_, mixed) = rows
    assert known.count() == before.filter(F.col("text").rlike(r"\p{L}")).count()
    assert {r[0] for r in distinct.select("doc_id").collect()} == {
        r["doc_id"] for r in exact_dedup.exact_duplicates(known).filter("kept").collect()}
    assert {r[0] for r in alone.select("doc_id").collect()} == {
        r["component_id"] for r in simhash_dedup.near_duplicates(distinct).collect()}
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in mixed.select("doc_id").collect())
    assert all(r["n_tokens"] > 0 for r in got)


def test_pipeline_of_odd_and_empty_tables(spark, odd, nothing, tmp_path):
    """Rows without letters go, one of equal texts stays, whole long texts come through, clashing columns do no harm."""
    for name, docs in (("odd", odd), ("none", nothing)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path / "odd")).select("doc_id", "n_tokens").collect()
    kept = {r["doc_id"] for r in rows}
    assert kept <= {-5, 1, 2, 6, 7, 8, 9, None} and not kept & {1, 2, 3, 4, 5}  # -5 holds the text of 1 and 2
    assert all(r["n_tokens"] > 0 for r in rows)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
