from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs in every column, empty and white texts, copies, a repeated row, long and non-Latin texts, clashing names."""
    words = random.Random(4)
    long_text = " ".join("".join(words.choices("abcdefghij", k=6)) for _ in range(30_000))
    rows = [(1, "Same text  here", "en", "b"), (2, "Same\ttext here", "en", "a"), (3, None, None, None), (4, "", "en", "a"),
            (5, " \n ", None, "b"), (None, "no id at all", "en", None), (6, long_text, "en", "a"), (6, long_text, "en", "a"),
            (7, "日本語のテキスト ελληνικά", "xx", "c"), (8, "one", "en", "a"), (9, long_text + " more", "en", "b"),
            (None, None, "en", "a"), (-5, "Same text here", "en", "c")]
    schema = "doc_id long, text string, lang string, source string, fp string, __id int, rank string, u long, pattern int, `a.b` int"
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3, 4) for r in rows], schema)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
