"""Quality: co-training of a text-content and a page-metadata classifier."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import leave_nothing_kept, matrix
from flowlens.llm.toxicity import calibrate

PAIR_BUCKETS = 512
SHAPES = 12
TEXT_WIDTH = PAIR_BUCKETS + SHAPES
LANGS, SOURCES, LENGTHS = 16, 64, 24
PAGE_WIDTH = LANGS + SOURCES + LENGTHS + 1
PIECE = 1 << 20
#: Byte classes, fixed: 0 other, 1 lower case, 2 upper case, 3 digit, 4 white space, 5 sign, 6 beyond ASCII.
CLASSES = np.zeros(256, np.uint8)
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58] = 1, 2, 3
CLASSES[[9, 10, 11, 12, 13, 32]] = 4
CLASSES[[c for c in range(33, 127) if not chr(c).isalnum()]] = 5
CLASSES[128:] = 6


def text_view(text: str) -> np.ndarray:
    """What a text itself shows: frequencies of byte pairs, shares of kinds of characters, repetition.

    A very long text is counted a stretch at a time; repetition is the mean over stretches.
    """
    pairs, kinds = np.zeros(PAIR_BUCKETS), np.zeros(7)
    words = distinct = length = lines = stretches = 0
    repeated = 0.0
    for begin in range(0, max(len(text), 1), PIECE):
        part = text[begin : begin + PIECE]
        raw = np.frombuffer(part.encode(), np.uint8)
        if len(raw) > 1:
            codes = (raw[:-1].astype(np.uint32) * np.uint32(2654435761) + raw[1:] * np.uint32(40503)) >> np.uint32(16)
            pairs += np.bincount(codes % PAIR_BUCKETS, minlength=PAIR_BUCKETS)
        kinds += np.bincount(CLASSES[raw], minlength=7)
        split = part.split()
        rows = part.split("\n")
        words, lines = words + len(split), lines + len(rows)
        distinct += len(set(split))
        length += sum(map(len, split))
        repeated += 1 - len(set(rows)) / len(rows)
        stretches += 1
    total = max(1.0, kinds.sum())
    shapes = [
        *(kinds / total),
        np.log1p(words) / 10,
        min(4.0, length / max(1, words) / 8),
        distinct / max(1, words),
        repeated / stretches,
        min(2.0, words / max(1, lines) / 50),
    ]
    return np.concatenate((np.sqrt(pairs / max(1.0, pairs.sum())) * 3, shapes)).astype(np.float32)


def page_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """What the page's metadata show: language, source and stated length, hashed to a fixed width."""
    out = np.zeros(PAGE_WIDTH, np.float32)
    out[zlib.crc32((lang or "").encode()) % LANGS] = 1
    out[LANGS + zlib.crc32((source or "").encode()) % SOURCES] = 1
    size = max(0, n_chars or 0)
    out[LANGS + SOURCES + min(LENGTHS - 1, size.bit_length())] = 1
    out[-1] = np.log1p(size) / 10
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Linear:
    """A logistic classifier with a calibration of its own."""

    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 250, decay: float = 1e-3) -> Linear:
    """Weighted logistic regression by gradient steps with momentum estimates."""
    weight = weight / weight.sum()
    beta, m, v = np.zeros(x.shape[1] + 1), 0.0, 0.0
    for step in range(1, steps + 1):
        d = weight * (_sigmoid(x @ beta[:-1] + beta[-1]) - y)
        g = np.append(x.T @ d + decay * beta[:-1], d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        beta = beta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Linear(beta[:-1].astype(np.float32), float(beta[-1]))


@dataclass
class CoTrained:
    """Both classifiers and the weights that combine their calibrated logits."""

    text: Linear
    page: Linear
    combine: np.ndarray
    rounds: list[tuple[int, int]]


def co_train(
    text: np.ndarray, page: np.ndarray, label: np.ndarray, prior: float,
    rounds: int = 4, per_round: int = 100, sure: float = 0.95, seed: int = 3,
) -> CoTrained:
    """Co-training on rows of both views; ``label`` is -1 where unknown, ``prior`` the share of label 1.

    Three quarters of the labelled rows teach, the others calibrate. In each round each
    classifier hands the other the unlabelled rows that it is surest of, at most ``per_round``
    of a class and none below ``sure``. In the end each view is calibrated and a logistic fit
    of both calibrated logits gives the score.
    """
    rng = np.random.default_rng(seed)
    told = np.nonzero(label >= 0)[0]
    teach = told[rng.random(len(told)) < 0.75]
    if len(set(label[teach].tolist())) < 2:
        teach = told
    held = np.setdiff1d(told, teach)
    held = held if len(set(label[held].tolist())) == 2 else told
    views = {"text": text, "page": page}
    given = {name: dict(zip(teach.tolist(), label[teach].tolist())) for name in views}
    pool = set(np.nonzero(label < 0)[0].tolist())

    def spread(y: np.ndarray) -> np.ndarray:
        share = max(1e-6, y.mean())
        return np.where(y == 1, prior / share, (1 - prior) / max(1e-6, 1 - share))

    def fitted(name: str) -> Linear:
        rows = np.array(list(given[name]))
        y = np.array([given[name][i] for i in rows], float)
        model = fit_linear(views[name][rows], y, spread(y))
        y = label[held].astype(float)
        model.slope, model.shift = calibrate(model.raw(views[name][held]).astype(float), y, spread(y))
        return model

    models, log = {name: fitted(name) for name in views}, []
    for _ in range(rounds):
        waiting = np.array(sorted(pool), np.int64)
        if not len(waiting):
            break
        handed = []
        for name, other in (("text", "page"), ("page", "text")):
            p = _sigmoid(models[name].logit(views[name][waiting]))
            order = np.argsort(-p, kind="stable")
            good = [i for i in order[:per_round] if p[i] >= sure]
            bad = [i for i in order[::-1][:per_round] if p[i] <= 1 - sure]
            given[other].update((int(waiting[i]), 1) for i in good)
            given[other].update((int(waiting[i]), 0) for i in bad)
            handed.append({int(waiting[i]) for i in (*good, *bad)})
        pool -= handed[0] | handed[1]
        log.append((len(handed[0]), len(handed[1])))
        models = {name: fitted(name) for name in views}
    both = np.stack([models[n].logit(views[n][held]) for n in ("text", "page")], axis=1)
    y = label[held].astype(float)
    last = fit_linear(both, y, spread(y), steps=600, decay=1e-4)
    return CoTrained(models["text"], models["page"], np.append(last.weights, last.bias).astype(float), log)


VIEWS = "doc_id long, text_view array<float>, page_view array<float>"


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The views of a batch, a few rows at a time."""
    for begin in range(0, batch.num_rows, 512):
        part = batch.slice(begin, 512)
        texts = np.stack([text_view(t.as_py() or "") for t in part.column("text")])
        meta = zip(*(part.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
        yield part, texts, np.stack([page_view(*m) for m in meta])


def _view(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts, pages in _rows(batch):
            columns = [part.column("doc_id"), pa.array(list(texts), pa.list_(pa.float32())), pa.array(list(pages), pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_view", "page_view"])


def _score(model: CoTrained, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave_nothing_kept()
        for batch in batches:
            for part, texts, pages in _rows(batch):
                text, page = model.text.logit(texts).astype(float), model.page.logit(pages).astype(float)
                score = _sigmoid(model.combine[0] * text + model.combine[1] * page + model.combine[2])
                columns = [*(part.column(c) for c in carry), pa.array(_sigmoid(text)), pa.array(_sigmoid(page)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, [*carry, "text_score", "page_score", "score"])

    return run


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 2000, unlabelled: int = 4000) -> CoTrained:
    """Learn from labelled rows whose crc32(doc_id as text) mod 5 is not 0, and from unlabelled rows.

    The sample is bounded: at most ``per_class`` labelled rows of each class and ``unlabelled``
    rows without a label, by hash of their id. Views are made by tasks; the driver gets the
    views of the sample alone, as Arrow columns: 2.5 KB a row. Rows would be numbers one by one,
    20 KB each here and as much again in the JVM.
    """
    told = labels.where("quality is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    told = told.select("doc_id", F.col("quality").cast("int").alias("label")).dropDuplicates(["doc_id"])
    counts = dict(tuple(r) for r in told.groupBy("label").count().collect())
    known = [told.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    rest = docs.select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(-1).alias("label"))
    rest = rest.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled)
    chosen = known[0].union(known[1]).union(rest)
    rows = docs.select(*COLUMNS).join(F.broadcast(chosen), "doc_id")
    views = rows.select(*COLUMNS).mapInArrow(_view, VIEWS)
    sample = views.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).toArrow()
    order = np.argsort(sample.column("doc_id").to_numpy(), kind="stable")
    label = sample.column("label").to_numpy().astype(np.int64)[order]
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(set(label[label >= 0].tolist())) < 2:  # nothing to tell apart: all get the share of label 1
        flat = np.log((prior + 1e-6) / (1 - prior + 1e-6)) if counts else 30.0
        return CoTrained(
            Linear(np.zeros(TEXT_WIDTH, np.float32)), Linear(np.zeros(PAGE_WIDTH, np.float32)),
            np.array([0.0, 0.0, flat]), [],
        )
    text, page = (matrix(sample.column(c), np.float32)[order] for c in ("text_view", "page_view"))
    del sample
    return co_train(text, page, label, prior)


def score_quality(docs: DataFrame, model: CoTrained, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` (of documents), ``held_out``, both calibrated views, ``score`` and ``predicted`` for all rows.

    Whole texts are looked at. Nulls in any column count as empty text, unknown language or
    source, length 0. Repeated rows are scored each; an empty table gives an empty result;
    further columns are not looked at.
    """
    rows = docs.select(*COLUMNS)
    kept = list(dict.fromkeys([*carry, "doc_id"]))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    kinds += ", text_score double, page_score double, score double"
    scored = rows.mapInArrow(_score(model, kept), kinds)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    predicted = (F.col("score") >= 0.5).cast("int")
    return scored.select(*carry, held.alias("held_out"), "text_score", "page_score", "score", predicted.alias("predicted"))
