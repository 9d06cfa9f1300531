"""Every stage of the pipeline by itself: its decisions, odd rows, and the columns it returns."""

import random
import zlib

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

KINDS = "doc_id long, text string, lang string, source string, n_chars long, score double, hash long, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r)), 0.5, 1, "clash") for r in rows], KINDS).repartition(3)


def words(rng, n, letters="abcdefghijklmnop"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture
def corpus(spark, tmp_path):
    """400 documents of which a quarter are toxic and a fifth poor, with labels for most."""
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(400):
        toxic, poor = i % 4 == 0, i % 5 == 1
        text = words(rng, 40) + (" you vile idiot scum" if toxic else "") + "."
        docs.append((i, text.upper().replace(" ", "!! ") if poor else text.capitalize(), "en", f"src{i % 3}", len(text)))
        if i % 7:
            labels.append((i, int(not poor), int(toxic)))
    docs += [(400, None), (401, "", None, None, 0), (None, words(rng, 30), "en", "src1", 9), docs[2], docs[2]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return frame(spark, docs), str(tmp_path)


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_classifiers_drop_what_they_reject(spark, corpus, name):
    docs, folder = corpus
    kept = dict(cp.STAGES)[name](spark, docs, folder)
    assert kept.columns == list(cp.COLUMNS)
    ids = [r.doc_id for r in kept.collect()]
    bad = {i for i in range(400) if (i % 4 == 0 if name == "toxicity" else i % 5 == 1)}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(i in ids) == (i not in bad) for i in held]) > 0.85
    assert len(set(ids) & set(range(400))) > 250
    assert ids.count(2) in (0, 3) and (name == "quality" or (400 in ids and 401 in ids))


def test_near_duplicates_keep_the_smallest_of_a_group(spark):
    rng = random.Random(5)
    a, b = words(rng, 60), words(rng, 60)
    near = a.split()
    near[30] = "other"
    rows = [(9, a, "en", "s", 1), (4, a, "fr", "t", 2), (7, " ".join(near)), (12, b), (12, b, "en", "z", 5), (13, words(rng, 60))]
    rows += [(20, ""), (21, ""), (22, None), (None, a), (None, a), (-3, b + " and more")]
    kept = cp.near_duplicates(spark, frame(spark, rows), "")
    assert kept.columns == list(cp.COLUMNS)
    found = sorted((str(r.doc_id), r.lang) for r in kept.collect())
    assert found == sorted([("4", "fr"), ("-3", None), ("13", None), ("20", None), ("21", None), ("22", None), ("None", None), ("None", None)])
    assert cp.near_duplicates(spark, frame(spark, [(12, b, "en", "z", 5), (12, b)]), "").collect()[0].lang is None
    assert cp.near_duplicates(spark, frame(spark, rows).limit(0), "").count() == 0


def test_repeats_are_cut_from_later_documents(spark):
    rng = random.Random(6)
    passage, lead = "p" + words(rng, 30), words(rng, 10, "qrst")
    rows = [(5, f"{lead} {passage}", "en", "s", 3), (2, passage, "fr", "t", 1), (8, None, "de"), (None, passage, "x"), (9, passage), (9, passage, "a")]
    found = {}
    for r in cp.repeats(spark, frame(spark, rows), "").collect():
        assert r.n_chars == len(r.text)
        found.setdefault(r.doc_id, []).append((r.text, r.lang, r.source))
    assert found[2] == [(passage, "fr", "t")] and found[5] == [(lead + " ", "en", "s")]
    assert found[8] == [("", "de", None)] and found[None] == [(passage, "x", None)]
    assert found[9] == [("", None, None)] * 2
    assert cp.repeats(spark, frame(spark, rows).limit(0), "").columns == list(cp.COLUMNS)


def test_packing_holds_every_id_once(spark):
    rng = random.Random(7)
    rows = [(i, words(rng, rng.randint(0, 700))) for i in range(30)] + [(40, None), (41, ""), (None, "no id")]
    pieces = cp.packing(spark, frame(spark, rows), "").collect()
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    for doc, text in rows[:-1]:
        ids = np.array([*encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start)
        assert [p.start for p in mine] == np.cumsum([0, *[p.length for p in mine]])[:-1].tolist()
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in mine)
        assert sum(p.length for p in mine) == len(ids)
    assert cp.packing(spark, frame(spark, rows).limit(0), "").count() == 0


def test_packing_cuts_where_it_costs_least(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.choice([5, 300, 900])).replace(" a", ". a")) for i in range(50)]
    pieces = sorted(cp.packing(spark, frame(spark, rows), "").collect(), key=lambda p: (p.doc_id, p.start))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enders = [tokenizer.encode(x).ids for x in (".", "!", "?", ".\n", "!!")]
    for part in {p.sequence_id >> 40 for p in pieces}:
        docs = sorted({p.doc_id for p in pieces if p.sequence_id >> 40 == part})
        paid, size = [0], 2048
        for d in docs:
            paid += [1 if [i] in enders else 2 for i in tokenizer.encode(rows[d][1], add_special_tokens=False).ids] + [0]
        best = np.zeros(len(paid))
        for j in range(1, len(paid)):
            low = max(0, j - size)
            best[j] = (best[low:j] + np.arange(low, j)).min() + size - j + paid[j]
        filled = {}
        for p in pieces:
            if p.sequence_id >> 40 == part:
                filled[p.sequence_id] = filled.get(p.sequence_id, 0) + p.length
        ends = [0, *np.cumsum([filled[s] for s in sorted(filled)]).tolist()]
        n = len(paid) - 1
        assert ends[-1] == n
        before = np.cumsum([0, *[paid[b] + size - (b - a) for a, b in zip(ends, ends[1:])]])
        # the last sequence may have been split in powers of two
        assert min(cost + size - (n - a) for a, cost in zip(ends, before) if 0 < n - a <= size) == best[n]


def test_stages_of_the_contract():
    assert [name for name, _ in cp.STAGES] == ["toxicity", "quality", "near_duplicates", "repeats", "packing"]
