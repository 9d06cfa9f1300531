"""Toxicity of texts without blanks, beyond the first characters of a word."""

import random

import numpy as np

from flowlens.llm.toxicity import PIECE, Scorer, train, words_of


def test_long_words_are_read_to_their_end():
    for n in (64, 65, 96, 97, 1000, PIECE + 100):
        text = "".join(random.Random(n).choices("abcdefghij", k=n))
        pieces, reach = [w for part in words_of(text) for w in part], 0
        assert all(len(p) <= 64 for p in pieces)
        for p in pieces:
            at = text.index(p, max(0, reach - 64)) if reach else 0
            assert text.startswith(p, at) and at <= reach
            reach = max(reach, at + len(p))
        assert reach == n
    assert [*words_of("A b" + "." * 90 + " c")] == [["a", "b", "c"]]


def test_a_toxic_passage_late_in_a_text_without_blanks():
    rng = random.Random(2)

    def plain(n):
        return ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 7))) for _ in range(n)]

    texts, toxic = [], []
    for i in range(300):
        words = plain(rng.randint(5, 60))
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "scum", "moron"])
        texts.append(("_" if i % 2 else " ").join(words))
        toxic.append(int(i % 3 == 0))
    scorer = Scorer(train(texts, np.array(toxic), 1 / 3))
    heads = ["_".join(plain(40)) for _ in range(20)]
    clean, bad = (scorer.scores([h + tail for h in heads]) for tail in ("_lane_burol_dica", "_idiot_scum_moron"))
    assert (bad > clean).all() and bad.mean() > clean.mean() + 0.2
