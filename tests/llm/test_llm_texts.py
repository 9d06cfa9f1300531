"""Operators on whole texts against brute force, round trips and held-out accuracy."""

import itertools
import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowlens.llm import packing, suffix_dedup, tokens
from flowlens.llm.html_extract import Weights, best_region, extract_main_text, fit_weights, main_text
from flowlens.llm.packing import choose_cuts, pack, split_tail
from flowlens.llm.piece_sampling import Pieces, decode_pieces, sample_pieces, sample_texts
from flowlens.llm.quality import fit_quality, score_quality
from flowlens.llm.suffix_dedup import remove_repeats
from flowlens.llm.token_binary import decode_ids, encode_ids, read_token_file, write_token_file
from flowlens.llm.tokens import WordTokens
from flowlens.llm.toxicity import fit_toxicity, fresh_weights, gradients, score_toxicity, train, Network, STAT_BUCKETS

WORDS, BYTES, MODEL = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [None, "", " ", "\n", "a  b", " lead", "trail ", "x\n\ny", "tab\tnbsp end", "İstanbul ΣΑΣ é", "it'S don't 12345 ###!!", "<|endoftext|>", "日本語 😀", "x" * 3000, "é" * 60]


def text_rows(spark, texts):
    rows = [(i, t, None, None, None, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string")


def whole(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB'sé́Σ.,!\n\t   9İ日"))))
def test_tokens_equal_the_whole_text(text):
    for path in (WORDS, BYTES):
        coder = CODERS.setdefault(path, (WordTokens(path), whole(path)))
        assert np.frombuffer(coder[0].encode(text), "<u4").tolist() == coder[1](text)


CODERS: dict = {}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=300))
def test_simple8b_round_trip(ids):
    array = np.array(ids, np.uint64)
    assert decode_ids(*encode_ids(array), len(ids)).tolist() == ids


def test_token_file(spark, tmp_path):
    docs = text_rows(spark, ODD).repartition(4)
    write_token_file(docs, str(tmp_path / "f"), WORDS)
    encode, start = whole(WORDS), 0
    for row in sorted(read_token_file(spark, str(tmp_path / "f"), with_ids=True).collect(), key=lambda r: r.doc_id):
        ids = np.array([*encode(ODD[row.doc_id]), 1], "<u4")
        assert (row.start, row.n_tokens, row.ids_crc32, row.ids) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
        start += len(ids)
    write_token_file(docs.limit(0), str(tmp_path / "e"), WORDS)
    assert read_token_file(spark, str(tmp_path / "e")).count() == 0


def test_packing(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "beta.", "gamma", "Delta."]) for _ in range(rng.randint(0, 900))) for _ in range(40)] + ODD
    encode = whole(BYTES)
    rows = pack(text_rows(spark, texts).repartition(3), BYTES, size=128, with_ids=True).collect()
    for doc, text in enumerate(texts):
        pieces = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        ids = [*encode(text), 1]
        assert [x for r in pieces for x in r.ids] == ids
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in pieces)
    padding = total = 0
    for number in {r.sequence_id for r in rows}:
        mine, at = sorted((r for r in rows if r.sequence_id == number), key=lambda r: r.offset), 0
        assert [r.doc_id for r in mine] == sorted(r.doc_id for r in mine)
        for r in mine:
            assert r.offset == at
            at += r.length
        assert at <= 128
        total += at
        padding += 0 if at & (at - 1) == 0 else 128 - at
    assert padding < 0.03 * total
    assert pack(text_rows(spark, ODD).limit(0), BYTES).count() == 0


def test_cuts_cost_no_more_than_any_other_choice():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n, size = int(rng.integers(5, 40)), 8
        documents = np.unique(np.append(rng.integers(1, n + 1, 4), n))
        sentences = np.unique(rng.integers(1, n + 1, 5))
        cuts = choose_cuts(n, documents, sentences, size)
        assert cuts[-1] == n and all(0 < b - a <= size for a, b in zip([0, *cuts], cuts))

        def cost(at):
            return 0.0 if at in documents else 1.0 if at in sentences else 2.0

        best = [0.0] + [math.inf] * n
        for j in range(1, n + 1):
            best[j] = min(best[i] + size - (j - i) for i in range(max(0, j - size), j)) + cost(j)
        got = sum(cost(b) + size - (b - a) for a, b in zip([0, *cuts], cuts))
        assert got <= best[n] + size  # the positions tried are a subset of all
    assert sum(split_tail(1300)) == 1300 and all(x & (x - 1) == 0 for x in split_tail(1300))


def test_cuts_are_the_cheapest_of_all():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n, size = int(rng.integers(1, 160)), int(rng.integers(1, 24))
        documents = np.unique(np.append(rng.integers(1, n + 1, int(rng.integers(0, 12))), n))
        sentences = np.unique(rng.integers(1, n + 1, int(rng.integers(0, 20))))
        paid = [0 if j in documents else 1 if j in sentences else 2 for j in range(n + 1)]
        best = [0] + [math.inf] * n
        for j in range(1, n + 1):
            best[j] = min(best[i] + size - (j - i) for i in range(max(0, j - size), j)) + paid[j]
        for more in (False, True):
            cuts = choose_cuts(n, documents, sentences, size, more)
            assert all(0 < b - a <= size for a, b in zip([0, *cuts], cuts))
            assert sum(paid[b] + size - (b - a) for a, b in zip([0, *cuts], cuts)) == best[cuts[-1]]
            assert n - size < cuts[-1] <= n if more else cuts[-1] == n
            if more and n > size:
                assert best[cuts[-1]] == min(best[n - size + 1 :])


def test_packing_goes_on_from_one_segment_to_the_next(monkeypatch):
    monkeypatch.setattr(packing, "SEGMENT_IDS", 3000)
    monkeypatch.setattr("pyspark.TaskContext.get", staticmethod(lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta.", "gamma"]) for _ in range(rng.choice([3, 40, 900]))) for _ in range(60)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "text": texts})
    out = pa.Table.from_batches(list(packing._packer(BYTES, 256, 1, (".",), True)(iter([batch])))).to_pylist()
    encode, filled = whole(BYTES), Counter()
    for doc, text in enumerate(texts):
        assert [x for r in out if r["doc_id"] == doc for x in r["ids"]] == [*encode(text), 1]
    for r in out:
        assert r["offset"] == filled[r["sequence_id"]]
        filled[r["sequence_id"]] += r["length"]
    full = [n for n in filled.values() if n & (n - 1)]
    assert max(filled.values()) == 256 and sum(256 - n for n in full) < 0.01 * sum(filled.values())


def test_words_that_come_again_stay_known():
    coder, asked = WordTokens(WORDS, 50), []
    learn = coder._learn
    coder._learn = lambda words, *more: asked.extend(words) or learn(words, *more)
    new, encode = (f"word{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(600)), whole(WORDS)
    for _ in range(20):
        text = " ".join(["often", "alpha", *itertools.islice(new, 30)])
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == encode(text)
        assert len(coder.plain) + len(coder.plain.before) < 200
    assert asked.count("often") == 1 and asked.count("wordaax") == 1


def test_packing_keeps_few_words(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 50)
    monkeypatch.setattr("pyspark.TaskContext.get", staticmethod(lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(tokens, "TOGETHER", 100)
    texts = [" ".join(f"new{chr(97 + i)}{chr(97 + j)}" for j in range(26)) for i in range(26)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(26)), "text": texts})
    out = pa.Table.from_batches(list(packing._packer(BYTES, 64, 1, (".",), True)(iter([batch])))).to_pylist()
    encode = whole(BYTES)
    assert [x for r in out for x in r["ids"]] == [x for t in texts for x in [*encode(t), 1]]
    spaced = tokens.tokens(BYTES, 50).spaced
    assert 0 < len(spaced) + len(spaced.before) < 200


def test_runs_of_many_texts_take_little_memory():
    letters = np.random.default_rng(1).integers(97, 123, 14_000_000, np.uint8).tobytes()
    texts = [letters[i : i + 2800].decode() for i in range(0, len(letters), 2800)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    tracemalloc.start()
    try:
        entries = sum(b.num_rows for b in suffix_dedup._entries(50, 12)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert entries and peak < 120e6


def brute_repeats(rows, length):
    seen, out = {}, {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if seen.setdefault(raw[i : i + length], doc) < doc:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[doc] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"))
    return out


@pytest.mark.parametrize("length", [50, 20])
def test_repeats_against_all_windows(spark, length):
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcdé \n") for _ in range(rng.choice([19, 20, 49, 50, 51, 90, 400]))) for _ in range(12)]
    texts = ["".join(rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice("xyz") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 8))) for _ in range(70)]
    texts += [None, "", "z" * 200, "z" * 120, "ab" * 100, texts[3], texts[3]]
    rows = list(enumerate(texts))
    want = brute_repeats(rows, length)
    got = remove_repeats(text_rows(spark, texts).repartition(6), length, with_text=True).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(rows)
    assert sum(v[1] for v in want.values()) > 1000
    assert remove_repeats(text_rows(spark, texts).limit(0)).count() == 0
    signed = [(-1, "n" * 60 + "same text"), (2, "n" * 60 + "same text"), (None, "n" * 60), (None, None), (2**62, "n" * 60)]
    found = {}
    for r in remove_repeats(spark.createDataFrame(signed, "doc_id long, text string"), length, with_text=True).collect():
        found.setdefault(r.doc_id, []).append((r.n_removed, r.n_bytes, hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256))
    assert found[-1] == [(0, 69, True)] and found[2][0][0] > 0 and found[2**62][0][0] == (60 if length <= 60 else 0)
    assert sorted(found[None]) == [(0, 0, True), (0, 60, True)]
    with pytest.raises(ValueError):
        remove_repeats(text_rows(spark, texts), 10)


def test_sampling_follows_the_weights():
    pieces, n = Pieces(MODEL, 1.0), 20_000
    names = {b.decode(): i for i, b in enumerate(pieces.bytes) if i in set(pieces.ids.tolist())}

    def ways(text):
        if not text:
            yield ()
        for j in range(1, len(text) + 1):
            if text[:j] in names:
                for rest in ways(text[j:]):
                    yield (names[text[:j]], *rest)

    weight = {w: math.exp(sum(pieces.weight[i] for i in w)) for w in ways(" thing")}
    total = sum(weight.values())
    drawn = Counter(tuple(x.tolist()) for x in sample_texts(["thing"] * n, np.arange(n), pieces, 5))
    assert set(drawn) <= set(weight) and len(weight) > 5
    for way, w in weight.items():
        assert abs(drawn[way] / n - w / total) < 0.02


def test_pieces_round_trip_and_repeat(spark):
    texts = [*ODD, "▁ is ▁a mark", "the cat sat on the mat. " * 200]
    docs = text_rows(spark, texts)
    one = decode_pieces(sample_pieces(docs, MODEL), MODEL).collect()
    two = {r.doc_id: r.ids for r in sample_pieces(docs.repartition(5), MODEL).collect()}
    assert all(r.decoded == (texts[r.doc_id] or "") and r.ids == two[r.doc_id] for r in one) and len(one) == len(texts)
    other = {r.doc_id: r.ids for r in sample_pieces(docs, MODEL, seed=18).collect()}
    assert other[len(texts) - 1] != two[len(texts) - 1]
    assert decode_pieces(sample_pieces(docs.limit(0), MODEL), MODEL).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a>b">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; tail</h1><p>One <b>bo</b>ld&nbsp;word.<p>Two<br>lines<!-- no <p> --><div class="ad">Buy</div><p>Three 3 &lt; 4</p>
<form>Mail <input></form><section id="comments"><p>First!</p></section></article><aside>Side</aside><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    want = "Head & tail One bold word. Two lines Three 3 < 4"
    assert main_text(PAGE, Weights()) == want
    plain = PAGE.replace("<article>", '<div id="content">').replace("</article>", "</div>")
    assert main_text(plain, Weights()) == want
    assert main_text(PAGE[: PAGE.index("3 &lt;")] + "four five six <b", Weights()) == "Head & tail One bold word. Two lines Three four five six"
    assert main_text("", Weights()) == main_text("<p></p>", Weights()) == main_text("<nav>a b</nav>", Weights()) == ""
    rows = [(i, "u", PAGE) for i in range(20)] + [(20, None, None), (21, "u", ""), (22, "u", plain), (22, "u", plain)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = extract_main_text(pages, fit_weights(pages)).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == sorted((i, want if i not in (20, 21) else "", len(want) if i not in (20, 21) else 0) for i, *_ in rows)
    assert extract_main_text(pages.limit(0), fit_weights(pages.limit(0))).count() == 0


def test_best_region_is_the_largest_sum():
    rng = np.random.default_rng(3)
    for _ in range(50):
        scores = rng.normal(-0.2, 1, rng.integers(0, 15)).tolist()
        a, b = best_region(scores)
        best = max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
        assert abs(sum(scores[a:b]) - best) < 1e-9


def test_network_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    network = Network(rng.normal(size=STAT_BUCKETS).astype(np.float32), fresh_weights(2))
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    words = [f"w{i}" for i in range(9)]
    rows, inside = rng.integers(0, 9, (5, 6)), rng.random((5, 6)) < 0.8
    inside[:, 0] = True

    def weigh(logits):
        return float((logits**2).sum()), 2 * logits

    _, grads = gradients(network, words, rows, inside, weigh)
    for name in ("fW", "fU", "bU", "bc", "attend", "out", "bias"):
        spot = np.unravel_index(int(rng.integers(0, grads[name].size)), grads[name].shape)
        old, ends = network.weights[name][spot], []
        for step in (1e-2, -1e-2):
            network.weights[name][spot] = old + step
            ends.append(gradients(network, words, rows, inside, weigh)[0])
        network.weights[name][spot] = old
        assert abs((ends[0] - ends[1]) / 2e-2 - grads[name][spot]) < 2e-2 * max(1.0, abs(grads[name][spot]))


def labelled(spark, n=500):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 120))]
        toxic, poor = int(i % 4 == 0), int(i % 5 == 1)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "scum", "moron"]) + rng.choice(["", ".", ","])
        if poor:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), "en", f"src{i % 3}", 10 * i, 0.5))
        if i % 7:
            labels.append((i, 1 - poor, toxic))
    docs += [(n, None, None, None, None, None), (n + 1, "", "en", "s", 0, 0.1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score double"),
        spark.createDataFrame([*labels, (None, None, None), (3, None, 0)], "doc_id long, quality int, toxic int"),
    )


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    rows = {r.doc_id: r for r in score_toxicity(docs, fit_toxicity(docs, labels)).collect()}
    assert len(rows) == 502 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    held = [r for i, r in rows.items() if i < 500 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out for r in held)
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.8  # 0.75 without any learning
    assert rows[500].predicted == rows[501].predicted == 0 and rows[500].score == rows[501].score < 0.5
    none = score_toxicity(docs.limit(0), fit_toxicity(docs.limit(0), labels.limit(0)))
    assert none.count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    rows = {r.doc_id: r for r in score_quality(docs, fit_quality(docs, labels)).collect()}
    held = [r for i, r in rows.items() if i < 500 and r.held_out]
    assert len(rows) == 502 and np.mean([r.predicted == (r.doc_id % 5 != 1) for r in held]) > 0.95
    assert score_quality(docs.limit(0), fit_quality(docs.limit(0), labels.limit(0))).count() == 0


def test_learning_quality_takes_little_of_the_drivers_memory(spark):
    docs = [(i, ("poor!! " if i % 2 else "good ") * 9, "en", "s", 50) for i in range(4000)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.range(2000).select(F.col("id").alias("doc_id"), (1 - F.col("id") % 2).cast("int").alias("quality"))
    tracemalloc.start()
    try:
        model = fit_quality(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.text.weights.any() and peak < 50e6


def test_learning_toxicity_takes_little_of_the_drivers_memory():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join([*(words[i] for i in rng.integers(0, 5000, 5000)), *["idiot"] * (n % 2)]) for n in range(200)]
    tracemalloc.start()
    try:
        network = train(texts, np.arange(200) % 2, 0.5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert network.stats.any() and peak < 60e6
