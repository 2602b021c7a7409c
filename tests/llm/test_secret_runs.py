"""Several candidates of one word, values behind long names, and short values."""

from __future__ import annotations

from insolara.llm import secret_scan
from tests.llm.conftest import frame

AWS = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
ONE, TWO = "9f8e7d6c5b4a39281706f5e4d3c2b1a0", "Zx81kQ02mN93bV74cR65tY56"
SHORT = ["password=hunter2xyz", "password: hunter2xyz", "password = 'hunter2xyz'", "db_passwd=hunter2xyz.",
         "password =hunter2xyz", '{"user":"me","password":"hunter2xyz"}']


def found(spark, texts):
    rows = secret_scan.candidates(frame(spark, list(enumerate(texts)))).collect()
    return [[r["core"] for r in sorted(rows, key=lambda r: (r["word_no"], r["place"])) if r["doc_id"] == i] for i in range(len(texts))]


def test_every_run_of_a_word_is_a_candidate(spark):
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    got = found(spark, [f"AWS_SECRET_ACCESS_KEY={AWS}", f'{{"api_key":"{ONE}","token":"{TWO}"}}', jwt,
                        f"http://h.example.com/a-long-path-before-it/x?token={ONE}", "token=c2VjcmV0IHZhbHVlIQ== end",
                        f"{ONE},{ONE}"])
    assert AWS in got[0] and got[1] == [ONE, TWO] and got[2] == jwt.split(".") and got[3][-1] == ONE
    assert got[4] == ["c2VjcmV0IHZhbHVlIQ=="] and got[5] == [ONE, ONE]


def test_short_values_behind_an_announcing_assignment(spark):
    assert found(spark, SHORT) == [["hunter2xyz"]] * len(SHORT)
    assert found(spark, ["the hunter2xyz went", "time: 10:30 ratio=5", "see http://a.example/b"]) == [[], [], []]


def test_scan_returns_them(spark, documents):
    asked = [f"AWS_SECRET_ACCESS_KEY={AWS}", f'{{"api_key":"{ONE}","token":"{TWO}"}}', *SHORT]
    planted = frame(spark, [(900_000 + i, t) for i, t in enumerate(asked)])
    got = {}
    for r in secret_scan.scan(documents.select("doc_id", "text").union(planted)).filter("doc_id >= 900000").collect():
        got.setdefault(r["doc_id"] - 900_000, set()).add(r["secret"])
    assert got == {0: {AWS}, 1: {ONE, TWO}} | {i + 2: {"hunter2xyz"} for i in range(len(SHORT))}
