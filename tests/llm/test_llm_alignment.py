"""Token alignment against the libraries on whole texts and plain loops over their ends."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowlens.llm import alignment
from flowlens.llm.alignment import Chunk, TokenPair, align_tokens, byte_alphabet, shared_cuts

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
A.encode_special_tokens = True
NAMES = {i: n for n, i in A.get_vocab().items()}
PAIR = TokenPair(*PATHS)
ODD = [
    None, "", " ", "  ", "a ", " a", "a  b", "\n", "a\n", "\na", "a\n\nb", "a \nb", "a\n b", "tab\tx y", "x\x1c y", "▁a b",
    "a▁ b", "<|endoftext|> a", "<s> x</s>", "é́ ﬁ　x", "日本語のテキスト です", "🙂🙂 x", "x\r\ny", "====----===", "a" * 500,
    "don't we'll 's", "1234567 89", "...,,,. .", "foo. bar, baz.\nqux,", "﻿x", "same text here.", "same text here.",
]


def plain(text):
    """Groups of (A ids, B ids), or none where bytes differ."""
    if not text:
        return []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    alphabet = byte_alphabet()
    bytes_a = [bytes(alphabet[c] for c in NAMES[i]) for i in a]
    bytes_b = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    whole = (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return []
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
    groups = defaultdict(lambda: ([], []))
    cuts = np.array(sorted(set(ends_a.tolist()) & set(ends_b.tolist())))
    for side, (ids, ends) in enumerate(((a, ends_a), (b, ends_b))):
        for i, end in zip(ids, ends):
            groups[int(np.searchsorted(cuts, end))][side].append(i)
    return [groups[k] for k in sorted(groups)]


def written(groups):
    return ";".join("|".join(",".join(map(str, x)) for x in g) for g in groups)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", "word", " ", "  ", "\n", "\t", ".", ",", "é", "日", "▁", "🙂", "'s", "19", "\xa0", "$$", "İ", "<|endoftext|>", "\x00"]), max_size=40))
def test_groups_equal_plain_loops(parts):
    text = "".join(parts)
    assert Chunk(PAIR, [text, "x", text]).written() == [written(plain(t)) for t in (text, "x", text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=80), st.lists(st.integers(1, 4), min_size=1, max_size=80))
def test_cuts_of_any_ends(a, b):
    total = max(sum(a), sum(b)) + 1
    ends_a, ends_b = np.cumsum([*a, total - sum(a)]), np.cumsum([*b, total - sum(b)])
    groups = shared_cuts(ends_a, ends_b, np.array([[0, len(ends_a), 0, len(ends_b)]]))
    shared = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    assert ends_a[groups[:, 1] - 1].tolist() == ends_b[groups[:, 3] - 1].tolist() == shared
    assert groups[0, 0] == groups[0, 2] == 0 and (groups[1:, [0, 2]] == groups[:-1, [1, 3]]).all()


def test_long_group_is_counted_before_it_is_paired():
    a, b = np.array([5, 6] * 500), np.array([7] * 1500)
    groups = np.array([[0, 1000, 0, 1500]])
    doc, code, times = alignment.linked(a, b, groups, np.array([3]), 100)
    assert (doc.tolist(), code.tolist(), times.tolist()) == ([3, 3], [507, 607], [750_000, 750_000])


def test_rows_equal_plain_counts(spark):
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choice(["river", "Über", "mill.", "naïve,", "日本", "x\ny"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    rows = [(i, t, "clash", 0) for i, t in enumerate(texts)] + [(40, texts[40], "", 0), (None, "no id", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk string, count int")
    result, links = align_tokens(docs.repartition(3), *PATHS, with_groups=True, chunk_size=500)
    groups = [plain(t) for _, t, *_ in rows]
    per_doc = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = Counter(p for found in per_doc for p in found)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    want = []
    for (doc, *_), g, found in zip(rows, groups, per_doc):
        text = written(g)
        want.append((
            doc, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(found.values()), text,
            hashlib.sha256(text.encode()).hexdigest() if text else "",
            sum(n for p, n in found.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in found.items()),
        ))
    assert sorted(map(tuple, result.collect()), key=repr) == sorted(want, key=repr)
    assert {(r.a, r.b): (r["count"], r.best) for r in links.collect()} == {p: (n, n == best[p[0]]) for p, n in count.items()}
    empty, none = align_tokens(docs.limit(0), *PATHS)
    assert empty.count() == none.count() == 0


def test_very_long_text(spark):
    text = " ".join(f"w{i % 977}{'é' * (i % 3)}" for i in range(120_000))
    docs = spark.createDataFrame([(1, text), (2, "w1 w2")], "doc_id long, text string")
    rows = {r.doc_id: r for r in align_tokens(docs, *PATHS)[0].collect()}
    assert rows[1].groups_sha256 == hashlib.sha256(written(plain(text)).encode()).hexdigest()
