"""BPE against tiktoken, id files against the tokenizers library, planes and files as round trips."""

from __future__ import annotations

import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from tokenizers import Tokenizer

from insolara.llm import bpe, ids_output
from insolara.llm.queries import QUERIES
from insolara.session import scratch_path

RANKS = bpe.read_ranks(public.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def ours():
    return bpe.ByteBPE(RANKS, public.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


HARD = ["", " ", "   ", "\n\n a\t b\r\n  c", "aaaaaaaaaaaaaaaaaaaaaaa", "don't we'll I'M", "\x1c a\x1cb \u0085y z", "日本語 🙂🙂",
        "<|endoftext|>", "x" * 3000, "=" * 500 + "ab" * 700, "é" * 99, "a 　 b", " \n", "1234567890" * 30, "'s 't's"]


def test_bpe_equals_tiktoken(ours, theirs, texts):
    rng = random.Random(2)
    noise = ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FF), 10, 32])) for _ in range(200)) for _ in range(80)]
    for text in [*HARD, *noise, *list(texts.values())[:150]]:
        assert ours.encode(text).tolist() == theirs.encode_ordinary(text)


def test_fitting_pairs_are_those_that_merging_keeps(ours):
    """The rule at the border against merging the joined bytes by rank."""
    rng = random.Random(3)
    alphabet = [t for t in RANKS if t.isalpha() and len(t) <= 5]

    def merged(data):
        parts = [bytes([b]) for b in data]
        while True:
            found = [RANKS.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            if not found or min(found) == 1 << 30:
                return parts
            at = found.index(min(found))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    for _ in range(3000):
        a, b = rng.choice(alphabet), rng.choice(alphabet)
        assert ours.fits[RANKS[a] << bpe.SHIFT | RANKS[b]] == (merged(a + b) == [a, b])


def test_memo_of_two_generations(monkeypatch, theirs, texts):
    monkeypatch.setattr(bpe, "MEMO", 50)
    small = bpe.ByteBPE(RANKS, public.PATTERN)
    for text in list(texts.values())[:20]:
        assert small.encode(text).tolist() == theirs.encode_ordinary(text)
    assert len(small.known) <= 50 and len(small.known.old) <= 50


def test_op1_digests(spark, sf_dir, texts, theirs):
    got = {r["doc_id"]: r for r in QUERIES["op1_byte_bpe"](spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids, r = theirs.encode_ordinary(text), got[doc_id]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_of_odd_tables(odd, nothing, theirs):
    path = public.path("byte_bpe_50k.tiktoken")
    back = bpe.decode(bpe.encode(odd, path, public.PATTERN), path).collect()
    want = [(r["doc_id"], (r["text"] or "").encode()) for r in odd.select("doc_id", "text").collect()]
    assert sorted(((r["doc_id"], bytes(r["decoded"])) for r in back), key=repr) == sorted(want, key=repr)
    assert bpe.digests(nothing, path, public.PATTERN).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(1)
    for dtype in (np.uint8, np.uint32, np.uint64):
        for n in (0, 1, 7, 8, 1000):
            values = rng.integers(0, np.iinfo(dtype).max, n, dtype)
            back = ids_output.from_planes(ids_output.to_planes(values, bits), n, dtype, bits) if n else values
            assert np.array_equal(back, values)


class _Buffer(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("bits", [False, True])
def test_file_round_trip(bits):
    rng = np.random.default_rng(5)
    docs = [(int(i), rng.integers(0, 50_000, size).astype(np.uint32)) for i, size in
            enumerate([0, 1, 99, 100, 101, 0, 1000, 3, 250])] + [(None, np.array([7], np.uint32)), (-4, np.empty(0, np.uint32))]
    out = _Buffer()
    writer = ids_output.IdWriter(out, bits, block=100)
    for name, ids in docs:
        writer.add(name, ids)
    writer.close()
    back = list(ids_output.IdReader(out).documents())
    assert [b[0] for b in back] == [d[0] for d in docs]
    assert all(np.array_equal(b[1], d[1]) for b, d in zip(back, docs))
    with pytest.raises(ValueError):
        ids_output.IdReader(_Buffer(out.getvalue()[:-3]))


def test_words_as_lines_equal_whole_texts(texts):
    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        coder = ids_output.LibraryCoder(f.read())
    some = [*HARD, *list(texts.values())[:120]]
    want = [e.ids + [2] for e in Tokenizer.from_file(public.path("byte_bpe_50k.json")).encode_batch(some, add_special_tokens=False)]
    assert [x.tolist() for x in coder.encode(some, 2)] == want


def coder():
    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return ids_output.LibraryCoder(f.read())


def test_the_library_meets_stems_and_tails_once(monkeypatch):
    """Words joined by punctuation are cut at it: 40 stems and 40 tails make 1,600 words, on one line or many."""
    ours, sent = coder(), []
    whole = ours._whole
    monkeypatch.setattr(ours, "_whole", lambda text: sent.append(len(text)) or whole(text))
    stems = [f"stem{a}{b}" for a in "abcde" for b in "klmnopqr"]
    text = "\n".join(f"x {a}.{b}" for a in stems for b in stems)
    want = Tokenizer.from_file(public.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert ours.encode([text], 2)[0].tolist() == [*want, 2]
    assert sum(sent) < 1000 and len(text) > 20_000


def test_parts_of_any_characters_equal_whole_texts(monkeypatch):
    """Borders between all kinds of characters, with a memory that overflows."""
    monkeypatch.setattr(ids_output, "KNOWN", 20)
    rng, ours = random.Random(11), coder()
    blanks = [c for c in map(chr, range(0x10000)) if c.isspace()]
    kinds = [[chr(c) for c in range(128)], blanks, [chr(c) for c in range(0x80, 0x800)], list("aé×÷я日🙂1²"), list(" \n\t.,'_"),
             ["'s", "'ll", "\r\n", "  ", "\n\n", ". ", ".\n"]]
    some = []
    for i in range(1500):
        pools = rng.sample(kinds, rng.randint(1, 3))
        some.append("".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 60))) + "<|endoftext|>" * (i % 90 == 0))
    want = Tokenizer.from_file(public.path("byte_bpe_50k.json")).encode_batch(some, add_special_tokens=False)
    for at in range(0, len(some), 100):
        assert [x.tolist() for x in ours.encode(some[at:at + 100], 2)] == [e.ids + [2] for e in want[at:at + 100]]
    assert len(ours.known) < 20 + 100 * 60 and len(ours.old) < 20 + 100 * 60


def test_op4_reads_back_what_the_library_encodes(spark, sf_dir, texts, library):
    got = {r["doc_id"]: r for r in QUERIES["op4_token_id_output"](spark, sf_dir).collect()}
    start = 0
    for doc_id in sorted(texts):
        ids = library.encode(texts[doc_id], add_special_tokens=False).ids + [2]
        assert (got[doc_id]["start"], got[doc_id]["n_tokens"]) == (start, len(ids))
        assert got[doc_id]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_files_of_odd_tables(spark, odd, nothing, library):
    folder = scratch_path(spark, "odd-ids")
    files = ids_output.write_ids(odd, folder, public.path("byte_bpe_50k.json"), bits=True)
    back = ids_output.read_ids(files, folder).orderBy("start").collect()
    rows = odd.select("doc_id", "text").collect()
    assert [r["doc_id"] for r in back] == [-5, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9, None, None]
    want = sorted((library.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in rows))
    assert sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in back) == want
    none = ids_output.write_ids(nothing, folder, public.path("byte_bpe_50k.json"))
    assert ids_output.read_ids(none, folder).count() == 0
