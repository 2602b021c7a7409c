"""Nearest neighbours against brute force: recall, order and scores."""

from __future__ import annotations

import numpy as np
import pytest

from insolara.llm import cross_polytope
from insolara.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>"


def truth(ids, x, k=20):
    out = {}
    for i, v in zip(ids, x):
        if i % 20 == 0:
            others = [(-float((v * w).sum()), j) for j, w in zip(ids, x) if j != i]
            out[i] = [(j, -s) for s, j in sorted(others)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return sum(len({j for j, _ in got[i]} & {j for j, _ in w}) for i, w in want.items()) / sum(map(len, want.values()))


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], SCHEMA)


def test_rotations_keep_length_and_hashes_reach_every_cell():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 48))
    how = cross_polytope.Polytope(48, 2, 1)
    assert how.width == 64 and np.allclose(np.linalg.norm(how.turned(x, 0, 0), axis=1), 1)
    assert np.array_equal(how.cell(x, 1), how.probes(x, 1, 1)[:, 0])
    assert (np.sort(how.probes(x, 0, how.cells), axis=1) == np.arange(how.cells)).all()
    two = cross_polytope.Polytope(16, 1, 2)
    looks = two.probes(x[:20, :16], 0, 200)
    assert np.array_equal(looks[:, 0], two.cell(x[:20, :16], 0)) and all(len(set(r)) == 200 for r in looks.tolist())
    assert np.array_equal(how.cell(x * 7.5, 0), how.cell(x, 0))


def test_query_recall_order_and_scores(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows])
    got, want = found(QUERIES["op13_nearest_neighbours"](spark, sf_dir)), truth(ids, x)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    of = dict(zip(ids, x))
    for i, near in got.items():
        assert near == sorted(near, key=lambda p: (-p[1], p[0]))
        assert all(s == pytest.approx(float(of[i] @ of[j]), abs=1e-12) for j, s in near)


def test_lengths_that_differ_and_long_hashes(spark, monkeypatch):
    """Inner product, not angle, decides; two hashes per table; blocks of a few rows."""
    monkeypatch.setattr(cross_polytope, "CELL", 4)
    monkeypatch.setattr(cross_polytope, "BLOCK", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    x = centres[rng.integers(0, 12, 1500)] + 0.1 * rng.normal(size=(1500, 8))
    x *= np.exp(rng.normal(size=1500))[:, None]
    ids = rng.permutation(1500)
    entries = table(spark, ids, x)
    got, want = found(cross_polytope.neighbours(entries)), truth(ids.tolist(), x)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9


def test_equal_vectors_are_exact(spark):
    """A third of all rows share one vector; ties go to the smaller ids, and a query never finds itself."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6))
    x[:120], x[150:160] = x[0], -x[0]
    ids = list(range(300))
    got, want = found(cross_polytope.neighbours(table(spark, ids, x))), truth(ids, x)
    for i in range(0, 120, 20):
        assert [j for j, _ in got[i]] == [j for j, _ in want[i]]
    assert recall(got, want) >= 0.9


def test_odd_rows_and_small_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]),
            (5, [1.0, inf]), (6, [1.0, None]), (None, [1.0, 1.0]), (40, None), (60, []), (7, [1.0, 2.0, 3.0]), (8, [-0.0, 2.0]),
            (80, [1e200, 1e-200])]
    wide = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA + ", rank int, entry int, `a.b` string")
    got = found(cross_polytope.neighbours(wide))
    ids, x = [0, 20, 1, 8, 80], np.array([[1.0, 0.0], [0.0, 2.0], [3.0, 1.0], [0.0, 2.0], [1e200, 1e-200]])
    assert got == truth(ids, x)  # fewer than 20 candidates: all of them, exactly
    assert cross_polytope.neighbours(wide.limit(0)).count() == 0
    assert cross_polytope.neighbours(wide.filter("vec_id IN (2, 3)")).count() == 0
    assert cross_polytope.neighbours(wide.filter("vec_id IN (0, 3)")).count() == 0
    assert cross_polytope.neighbours(wide.filter("vec_id IN (1, 8)")).count() == 0
