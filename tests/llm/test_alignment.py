"""Token alignment against a brute-force version in plain Python."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from tokenizers import Tokenizer

from insolara.llm import token_align
from insolara.llm.queries import QUERIES

FILES = (public.path("byte_bpe_50k.json"), public.PATTERN, public.path("piece_bpe_32k.model"))
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(FILES[0])
    found.encode_special_tokens = True
    return found


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=FILES[2])


@pytest.fixture(scope="module")
def coders():
    with open(FILES[0], encoding="utf-8") as a, open(FILES[2], "rb") as b:
        return token_align.BothCoders(a.read(), FILES[1], b.read())


HARD = ["", " ", "   ", "a", "\n\n a\t b\r\n  c", "x \n y", "a\t  b", ";\r\n b;\r", "don't we'll I'M", "\x1c a\x1cb \u0085y z  q",
        "日本語 🙂🙂 é", "<|endoftext|> <s> </s> <unk>", "x▁y", "a\x00b  \x00", "ﬁ Å é", "x" * 900, "= " * 500 + "ab" * 300,
        "　 b  c", " trailing  ", "'s 't's", "1234567890 " * 30]


def brute(rows, library, pieces):
    letters = token_align.byte_letters()
    bytes_a = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
               for t, i in library.get_vocab().items()}

    def bytes_b(i):
        piece = pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()

    out, counts, links = [], Counter(), []
    for doc_id, text in rows:
        text = text or ""
        a = library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        if any(b"".join(map(f, ids)) != (" " + text).encode() for f, ids in ((bytes_a.get, a), (bytes_b, b))):
            a = b = []
        spans = []
        for ids, f in ((a, bytes_a.get), (b, bytes_b)):
            at = np.cumsum([0, *(len(f(i)) for i in ids)]).tolist()
            spans.append(list(zip(at, at[1:])))
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, mine, low = [], [], 0
        for end in common if a else []:
            inside = [[k for k, (s, e) in enumerate(span) if low <= s and e <= end] for span in spans]
            groups.append("|".join(",".join(str(ids[k]) for k in part) for ids, part in zip((a, b), inside)))
            mine += [(a[i], b[j]) for i in inside[0] for j in inside[1]
                     if spans[0][i][0] < spans[1][j][1] and spans[1][j][0] < spans[0][i][1]]
            low = end
        counts.update(mine)
        links.append(mine)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append([doc_id, len(a), len(b), len(groups), len(mine), digest])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(((d, na, nb, ng, nl, sum(counts[x] == best[x[1]] for x in mine), sum(counts[x] for x in mine), digest)
                   for (d, na, nb, ng, nl, digest), mine in zip(out, links)), key=repr)


def test_words_equal_whole_texts(coders, library, pieces, texts):
    assert coders.b.cuts_at_blanks and coders.a.ranked
    some = [*HARD, *list(texts.values())[:100]]
    for text, (a, b) in zip(some, coders.encode(some)):
        if len(a):
            assert a.tolist() == library.encode(" " + text, add_special_tokens=False).ids
            assert b.tolist() == pieces.encode(text)
        elif text:
            assert b"".join(coders.b.tokens[i] for i in pieces.encode(text)) != (" " + text).encode()


def test_ranks_give_the_ids_of_the_library_for_every_character(coders, library):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 20_000):
        text = "".join(f" a{chr(c)}{chr(c)} {chr(c)}1{chr(c)}!" for c in points[k:k + 20_000])
        assert coders.a.encode([text])[0] == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("lane", [1, 3, 256])
def test_lockstep_against_all_pairs(monkeypatch, lane):
    monkeypatch.setattr(token_align, "LANE", lane)
    rng = np.random.default_rng(lane)
    for _ in range(30):
        a_ends, b_ends, a_first, b_first, base = [], [], [], [], 0
        for _ in range(rng.integers(1, 6)):
            size = int(rng.integers(1, 60))
            a_first.append(len(a_ends))
            b_first.append(len(b_ends))
            for ends in (a_ends, b_ends):
                ends += [base + x for x in sorted({*rng.integers(1, size + 1, rng.integers(1, 40)).tolist(), size})]
            base += size
        a, b = np.array(a_ends), np.array(b_ends)
        i, j, cut_a, cut_b = token_align.lockstep(a, b, *token_align.lanes(a, b, np.array(a_first), np.array(b_first)))
        starts = [np.concatenate([[0], x[:-1]]) for x in (a, b)]
        want = {(p, q) for p in range(len(a)) for q in range(len(b)) if starts[0][p] < b[q] and starts[1][q] < a[p]}
        assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want
        assert sorted(a[cut_a].tolist()) == sorted(b[cut_b].tolist()) == sorted(set(a_ends) & set(b_ends))


def test_query_equals_brute_force(spark, sf_dir, texts, library, pieces):
    got = sorted(map(tuple, QUERIES["op11_token_alignment"](spark, sf_dir).select(COLUMNS).collect()), key=repr)
    assert got == brute(texts.items(), library, pieces)


def test_small_batches_odd_and_empty_tables(spark, odd, nothing, library, pieces, monkeypatch):
    hard = spark.createDataFrame([(100 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string").repartition(3)
    both = odd.filter("doc_id IS NULL OR doc_id NOT IN (6, 9)").select("doc_id", "text", "`a.b`").unionByName(
        hard, allowMissingColumns=True)
    monkeypatch.setattr(token_align, "TOKENS", 300)
    got = sorted(map(tuple, token_align.alignment(both, *FILES).select(COLUMNS).collect()), key=repr)
    assert got == brute([(r["doc_id"], r["text"]) for r in both.collect()], library, pieces)
    assert token_align.alignment(nothing, *FILES).count() == 0


def test_long_and_repeated_texts(odd, library, pieces):
    rows = odd.filter("doc_id IN (6, 9)")
    got = token_align.alignment(rows, *FILES, keep_groups=True).collect()
    assert len(got) == 3 and all(r["n_a"] == len(library.encode(" " + t["text"], add_special_tokens=False).ids)
                                 for r, t in zip(sorted(got, key=lambda r: r["doc_id"]), rows.orderBy("doc_id").collect()))
    for r in got:
        assert hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"]
        assert r["groups"].count("|") == r["n_groups"] and r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"]
