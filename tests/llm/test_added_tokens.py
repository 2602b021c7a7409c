"""Added tokens inside texts, against the library as its file configures it."""

from __future__ import annotations

import public_tokenizers as public
from tokenizers import Tokenizer

from insolara.llm import ids_output
from insolara.session import scratch_path
from tests.llm.conftest import frame

END = "<|endoftext|>"
TEXTS = [END, f"a  {END}  b", f"word{END}word, {END}.", f"\n\n{END}\n x\t{END}{END}", "plain text, as ever", "<|endoftext|", "",
         f"Then{END.upper()} and {END[:5]} {END[5:]}"]


def test_added_tokens_keep_their_id(spark):
    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = [library.encode(t, add_special_tokens=False).ids + [2] for t in TEXTS]
    assert library.token_to_id(END) in want[0]
    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        assert [x.tolist() for x in ids_output.LibraryCoder(f.read()).encode(TEXTS, 2)] == want
    folder = scratch_path(spark, "added")
    files = ids_output.write_ids(frame(spark, list(enumerate(TEXTS))), folder, public.path("byte_bpe_50k.json"))
    back = {r["doc_id"]: r for r in ids_output.read_ids(files, folder).collect()}
    start = 0
    for i, ids in enumerate(want):
        assert back[i]["start"] == start and len(back[i]["ids"]) == 4 * len(ids)
        start += len(ids)
