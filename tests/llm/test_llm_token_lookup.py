"""Words looked up without the signs behind them, against the library on whole texts."""

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowlens.llm.tokens import WordTokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY, CODER = Tokenizer.from_file(PATH), WordTokens(PATH, 5)
PARTS = ["ab", "Été", "ß中", "Σ", "x1", "12", "'s", "don't", "'", ".", ",", "***", "-", "´", "́", " ", "  ", "\n", "\n\n", "\t", " ", " "]


def ids(texts):
    return [np.array(g.ids, "<u4").tobytes() for g in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_letters_are_asked_for_once_whatever_signs_follow():
    coder, asked = WordTokens(PATH, 100), []
    ask = coder._ask_words
    coder._ask_words = lambda stems, blank: asked.extend(stems) or ask(stems, blank)
    texts = ["so qalpha, qbeta. qalpha", "so qalpha*** qbeta## qalpha?! qbeta,,", "so qbeta) qalpha\nqgamma. qalpha;"]
    assert [coder.encode(t) for t in texts] == ids(texts)
    assert sorted(w for w in asked if w.startswith("q")) == ["qalpha", "qbeta", "qgamma"]


def test_odd_spaces_empty_texts_and_nothing():
    for texts in ([], [""], ["  a"], ["a\t", "b\n\nc"], ["", " ", "\n", "a"], ["a b\nc.", "a  b", "\nx", "y z. w"]):
        assert CODER.encode_all(texts) == ids(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), max_size=6))
def test_ids_are_the_librarys(texts):
    assert CODER.encode_all(texts) == ids(texts)
