"""Added tokens such as '<|endoftext|>' inside texts, against the library on the whole text."""

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowlens.llm.packing import pack
from flowlens.llm.token_binary import read_token_file, write_token_file
from flowlens.llm.tokens import WordTokens

PATHS = [public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")]
TEXTS = ["a cat <|endoftext|> dog", "<|endoftext|>", "<|startoftext|>A\n<|endoftext|><|endoftext|> 's", "<|EndOfText|> plain", "no such token", "", None]
CODERS = [(WordTokens(p), Tokenizer.from_file(p)) for p in PATHS]


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "|>", "<|EndOfText|>", "endoftext", " ", "\n", "  ", "aB", "'s", "e", "́", "Σ", "9", "日", ".", ","]), max_size=10))
def test_added_tokens_equal_the_library(parts):
    text = "".join(parts)
    for coder, library in CODERS:
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_files_and_sequences(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    write_token_file(docs, str(tmp_path / "f"), PATHS[0])
    got = {r.doc_id: r.ids for r in read_token_file(spark, str(tmp_path / "f"), with_ids=True).collect()}
    assert got == {i: [*ids_of(PATHS[0], t), 1] for i, t in enumerate(TEXTS)}
    assert got[0] == [320, 2368, 49407, 1929, 1]
    rows = sorted(pack(docs, PATHS[1], with_ids=True).collect(), key=lambda r: (r.doc_id, r.start))
    for doc, text in enumerate(TEXTS):
        assert [x for r in rows if r.doc_id == doc for x in r.ids] == [*ids_of(PATHS[1], text), 1]
