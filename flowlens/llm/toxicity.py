"""Toxicity: a bidirectional gated recurrent network with attention, over all overlapping windows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import leave_nothing_kept, prefix_hash, range_hash

SIDES = ".,;:!?\"'()[]{}|#$%&*-_/<>«»¿¡"
WINDOW, STRIDE = 32, 16
HIDDEN, EMBED = 8, 4
STAT_BUCKETS, WORD_BUCKETS, GRAM_BUCKETS = 1 << 18, 1 << 12, 1 << 14
GRAMS = (3, 4, 5)
PIECE = 1 << 20
MOST_WORDS = 400_000
#: Longer words are read in pieces of so many characters, each a step of the windows; neighbours share so many.
LONGEST, SHARED = 64, 32


def words_of(text: str) -> Iterator[list[str]]:
    """The lower-cased words of a text, long ones in pieces, a bounded stretch of it at a time."""
    begin = 0
    while len(text) - begin > PIECE:
        cut = max(text.rfind(" ", begin, begin + PIECE), text.rfind("\n", begin, begin + PIECE))
        if cut > begin:
            yield _in_pieces(text[begin:cut].lower().split())
            begin = cut
        else:
            yield _in_pieces(text[begin : begin + PIECE].lower().split())
            begin += PIECE - SHARED
    yield _in_pieces(text[begin:].lower().split())


def _in_pieces(words: list[str]) -> list[str]:
    """Words without the signs around them that are longer than ``LONGEST`` as overlapping pieces, others as they are."""
    if max(map(len, words), default=0) <= LONGEST:
        return words
    out = []
    for word in words:
        bare = word if len(word) <= LONGEST else word.strip(SIDES)
        last = len(bare) - LONGEST
        if last <= 0:
            out.append(bare)
        else:
            out.extend([bare[min(at, last) : min(at, last) + LONGEST] for at in range(0, last + LONGEST - SHARED, LONGEST - SHARED)])
    return out


def word_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words without the signs around them, of their character n-grams, and where each word's n-grams begin."""
    raw = [(" " + w.strip(SIDES) + " ").encode() for w in words]
    sizes = np.array([len(r) for r in raw], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    sums = prefix_hash(np.frombuffer(b"".join(raw), np.uint8))
    whole = range_hash(sums, starts[:-1], starts[1:])
    counts = np.stack([np.maximum(sizes - g + 1, 0) for g in GRAMS])
    first = np.concatenate(([0], np.cumsum(counts.sum(0))))
    grams = np.empty(first[-1], np.uint64)
    offset = first[:-1].copy()
    for g, n in zip(GRAMS, counts):
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(starts[:-1], n) + inner
        grams[np.repeat(offset, n) + inner] = range_hash(sums, at, at + g) + np.uint64(g)
        offset = offset + n
    return whole, grams, first


@dataclass
class Network:
    """Weights and the tables of inputs; ``slope`` and ``shift`` calibrate the largest window's logit.

    ``prior``, the share of label 1, is the score of a text without words.
    """

    stats: np.ndarray
    weights: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    prior: float = 0.0

    def inputs(self, words: list[str], grads: bool = False):
        """The input vectors of distinct words: class statistics and learned embeddings of word and characters."""
        whole, grams, first = word_hashes(words)
        sizes = np.diff(first)
        some = sizes > 0
        out = np.zeros((len(words), 4 + 2 * EMBED), np.float32)
        stat = self.stats[(whole % STAT_BUCKETS).astype(np.int64)]
        out[:, 0], out[:, 1] = stat, stat != 0
        gram_stat = self.stats[(grams % STAT_BUCKETS).astype(np.int64)]
        word_rows = (whole % WORD_BUCKETS).astype(np.int64)
        gram_rows = (grams % GRAM_BUCKETS).astype(np.int64)
        out[:, 4 : 4 + EMBED] = self.weights["word"][word_rows]
        if some.any():
            at = first[:-1][some]
            out[some, 2] = np.add.reduceat(gram_stat, at) / sizes[some]
            out[some, 3] = np.maximum.reduceat(gram_stat, at)
            pooled = np.add.reduceat(self.weights["gram"][gram_rows], at, axis=0)
            out[some, 4 + EMBED :] = pooled / sizes[some, None]
        out[[not x for x in words]] = 0  # the empty word stands for padding
        return (out, word_rows, gram_rows, sizes) if grads else out


def fresh_weights(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    width = 4 + 2 * EMBED
    made = {"word": rng.normal(0, 0.05, (WORD_BUCKETS, EMBED)), "gram": rng.normal(0, 0.05, (GRAM_BUCKETS, EMBED))}
    for side in "fb":
        made[side + "W"] = rng.normal(0, 0.3, (width, 3 * HIDDEN))
        made[side + "U"] = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
        made[side + "c"] = np.zeros(3 * HIDDEN)
    made["attend"] = rng.normal(0, 0.3, 2 * HIDDEN)
    made["out"] = rng.normal(0, 0.3, 2 * HIDDEN)
    made["bias"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in made.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _gru(given, inside: np.ndarray, u: np.ndarray, order, keep: bool = False):
    """States of a gated recurrent layer; ``given(t)`` has the projected inputs of step t, ``inside`` (n, steps) marks words."""
    n, steps = inside.shape
    full = inside.all(axis=0)
    h = np.zeros((n, HIDDEN), np.float32)
    states, cache = np.empty((steps, n, HIDDEN), np.float32), []
    for t in order:
        x, g = given(t), h @ u
        gates = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        fresh = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        following = fresh + z * (h - fresh)
        if not full[t]:
            following = np.where(inside[:, t, None], following, h)
        if keep:
            cache.append((t, h, z, r, fresh, g[:, 2 * HIDDEN :]))
        h = states[t] = following
    return states, cache


def _pool(states: np.ndarray, inside: np.ndarray, w: dict):
    energy = np.where(inside.T, states @ w["attend"], np.float32(-1e9))
    energy = np.exp(energy - energy.max(axis=0))
    share = energy / energy.sum(axis=0)
    context = (share[:, :, None] * states).sum(axis=0)
    return context @ w["out"] + w["bias"][0], share, context


def window_logits(network: Network, table: list[np.ndarray], rows: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Logits of windows, given the projected inputs of words and the windows' word numbers.

    The same layers as in training, laid out by unit instead of by window, which keeps every
    step in contiguous memory, and pooled step by step, so that no states are stored.
    """
    w, (n, steps) = network.weights, rows.shape
    columns, live = np.ascontiguousarray(rows.T), np.ascontiguousarray(inside.T)
    full = live.all(axis=1)
    energy, value = np.zeros((steps, n), np.float32), np.zeros((steps, n), np.float32)
    gates, x = np.empty((3 * HIDDEN, n), np.float32), np.empty((n, 3 * HIDDEN), np.float32)
    two = 2 * HIDDEN
    for side, part, order in (("f", 0, range(steps)), ("b", 1, range(steps - 1, -1, -1))):
        projected, u = table[part], np.ascontiguousarray(w[side + "U"].T)
        mine = slice(part * HIDDEN, (part + 1) * HIDDEN)
        readers = np.stack((w["attend"][mine], w["out"][mine]))
        h = np.zeros((HIDDEN, n), np.float32)
        for t in order:
            np.take(projected, columns[t], axis=0, out=x, mode="clip")
            given = x.T
            np.matmul(u, h, out=gates)
            both = gates[:two]
            both += given[:two]
            np.negative(both, out=both)
            np.exp(both, out=both)
            both += 1
            np.reciprocal(both, out=both)
            fresh = gates[two:]
            fresh *= gates[HIDDEN:two]
            fresh += given[two:]
            np.tanh(fresh, out=fresh)
            following = h - fresh
            following *= gates[:HIDDEN]
            following += fresh
            h = following if full[t] else np.where(live[t], following, h)
            read = readers @ h
            energy[t] += read[0]
            value[t] += read[1]
    energy[~live] = -1e9
    energy -= energy.max(axis=0)
    np.exp(energy, out=energy)
    return (energy * value).sum(axis=0) / energy.sum(axis=0) + w["bias"][0]


def gradients(network: Network, words: list[str], rows: np.ndarray, inside: np.ndarray, weigh) -> tuple[float, dict]:
    """Loss and gradients over windows; ``weigh(logits)`` gives the loss and its derivative by logit."""
    w = network.weights
    x, word_rows, gram_rows, sizes = network.inputs(words, grads=True)
    steps, states, caches = rows.shape[1], [], []
    for side, order in (("f", range(rows.shape[1])), ("b", range(rows.shape[1] - 1, -1, -1))):
        projected = x @ w[side + "W"] + w[side + "c"]
        got, cache = _gru(lambda t, p=projected: p[rows[:, t]], inside, w[side + "U"], order, keep=True)
        states.append(got)
        caches.append(cache)
    both = np.concatenate(states, axis=2)
    logits, share, context = _pool(both, inside, w)
    loss, d = weigh(logits)
    grads = {"out": context.T @ d, "bias": d.sum(keepdims=True)}
    d_context = d[:, None] * w["out"]
    d_share = (both * d_context).sum(axis=2)
    d_energy = share * (d_share - (share * d_share).sum(axis=0))
    grads["attend"] = (d_energy[:, :, None] * both).sum(axis=(0, 1))
    d_states = share[:, :, None] * d_context + d_energy[:, :, None] * w["attend"]
    d_x = np.zeros_like(x)
    for part, side in enumerate("fb"):
        u, w_in = w[side + "U"], w[side + "W"]
        d_h, d_u = np.zeros((len(rows), HIDDEN), np.float32), np.zeros_like(u)
        d_projected = np.zeros((len(words), 3 * HIDDEN), np.float32)
        for t, h, z, r, fresh, g in reversed(caches[part]):
            d_h = d_h + d_states[t, :, part * HIDDEN : (part + 1) * HIDDEN]
            live = inside[:, t, None]
            d_new = np.where(live, d_h, 0)
            d_fresh = d_new * (1 - z) * (1 - fresh * fresh)
            d_z = d_new * (h - fresh) * z * (1 - z)
            d_r = d_fresh * g * r * (1 - r)
            d_gates = np.concatenate((d_z, d_r, d_fresh), axis=1)
            d_inner = np.concatenate((d_z, d_r, d_fresh * r), axis=1)
            d_u += h.T @ d_inner
            d_h = np.where(live, d_new * z + d_inner @ u.T, d_h)
            np.add.at(d_projected, rows[:, t], d_gates)
        grads[side + "U"], grads[side + "c"] = d_u, d_projected.sum(axis=0)
        grads[side + "W"] = x.T @ d_projected
        d_x += d_projected @ w_in.T
    d_x[[not x for x in words]] = 0
    grads["word"], grads["gram"] = np.zeros_like(w["word"]), np.zeros_like(w["gram"])
    np.add.at(grads["word"], word_rows, d_x[:, 4 : 4 + EMBED])
    some = np.maximum(sizes, 1)
    np.add.at(grads["gram"], gram_rows, np.repeat(d_x[:, 4 + EMBED :] / some[:, None], sizes, axis=0))
    return loss, grads


def window_starts(n: int) -> np.ndarray:
    """Where the overlapping windows of ``n`` words begin; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - WINDOW + STRIDE, STRIDE)
    return np.minimum(starts, n - WINDOW)


def _windows(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = starts[:, None] + np.arange(WINDOW)
    inside = at < len(ids)
    return np.where(inside, ids[np.minimum(at, len(ids) - 1)] if len(ids) else 0, 0), inside


class Scorer:
    """Scores texts; keeps the projected inputs of the words that it has met, within bounds."""

    def __init__(self, network: Network) -> None:
        self.network = network
        self.known: dict[str, int] = {}
        self.tables: list[np.ndarray] = []
        self.pending: set[str] = set()
        self._forget()

    def _forget(self) -> None:
        self.known, width = {}, 3 * HIDDEN
        self.tables = [np.zeros((1 << 16, width), np.float32) for _ in range(2)]
        self.learn({""})  # number 0 is padding, whatever words follow

    def learn(self, words: set[str]) -> None:
        """Project the inputs of words not met before."""
        known, w = self.known, self.network.weights
        fresh = [x for x in words if x not in known]
        for begin in range(0, len(fresh), 1 << 15):
            part = fresh[begin : begin + (1 << 15)]
            x, n = self.network.inputs(part), len(known)
            while n + len(part) > len(self.tables[0]):
                self.tables = [np.concatenate((t, np.zeros_like(t))) for t in self.tables]
            for table, side in zip(self.tables, "fb"):
                table[n : n + len(part)] = x @ w[side + "W"] + w[side + "c"]
            known.update(zip(part, range(n, n + len(part))))

    def largest_logits(self, texts: list[str]) -> np.ndarray:
        """The largest window logit of each text."""
        if len(self.known) > MOST_WORDS:
            self._forget()
        split = [[w for part in words_of(text) for w in part] for text in texts]
        for words in split:
            self.pending.update(words)
        self.learn(self.pending)
        self.pending.clear()
        rows, inside, owner = [], [], []
        for number, words in enumerate(split):
            ids = np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))
            starts = window_starts(len(ids))
            r, i = _windows(ids, starts)
            rows.append(r)
            inside.append(i)
            owner.append(np.full(len(starts), number))
        rows, inside, owner = np.concatenate(rows), np.concatenate(inside), np.concatenate(owner)
        inside[:, 0] = True  # a text without words is one window of padding
        out = np.full(len(texts), -np.inf)
        partial = ~inside.all(axis=1)
        for group in (np.nonzero(~partial)[0], np.nonzero(partial)[0]):
            for begin in range(0, len(group), 4096):
                part = group[begin : begin + 4096]
                logits = window_logits(self.network, self.tables, rows[part], inside[part])
                np.maximum.at(out, owner[part], logits)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        found = _sigmoid(self.network.slope * self.largest_logits(texts) + self.network.shift)
        wordless = [not any(map(len, words_of(t))) if t[:64].isspace() or not t else False for t in texts]
        return np.where(wordless, self.network.prior, found)


def _statistics(docs: Iterable[set[str]], toxic: np.ndarray) -> np.ndarray:
    """Shrunk log-odds of each hashed word and character n-gram by how many documents of each class hold it."""
    counts = np.zeros((2, STAT_BUCKETS), np.float32)
    for words, label in zip(docs, toxic):
        whole, grams, _ = word_hashes(list(words))
        counts[int(label)][np.unique(np.concatenate((whole, grams)) % STAT_BUCKETS).astype(np.int64)] += 1
    share = (counts + 2) / (np.bincount(toxic.astype(int), minlength=2)[:, None] + 4)
    odds = np.log(share[1]) - np.log(share[0])
    return np.where(counts.sum(0) >= 5, odds, 0).astype(np.float32)


def calibrate(logits: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic fit in one variable, by Newton steps."""
    x = np.stack((logits, np.ones_like(logits)), axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(np.clip(x @ beta, -30, 30))
        gradient = x.T @ (weight * (p - labels)) + 1e-3 * beta
        curvature = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        beta = beta - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return float(max(beta[0], 1e-3)), float(beta[1])


def train(texts: list[str], toxic: np.ndarray, prior: float, seed: int = 5, epochs: int = 4) -> Network:
    """Fit the network on labelled texts; ``prior`` is the share of label 1 among all labelled rows.

    A text counts through its strongest window. Four fifths of the texts give statistics and
    weights, the others the calibration. Texts are split one at a time; of their words only
    those of the windows to learn from stay, each different one once.
    """
    rng = np.random.default_rng(seed)
    fit = rng.random(len(texts)) < 0.8
    numbers = np.nonzero(fit)[0]
    stats = _statistics(({w for part in words_of(texts[i]) for w in part} for i in numbers), toxic[numbers])
    network = Network(stats, fresh_weights(seed))
    chosen, spots, held_words = [], [], {}
    for i in numbers:  # windows to learn from: the strongest by the inputs, and some others
        words = [w for part in words_of(texts[i]) for w in part]
        names = list(dict.fromkeys(words))
        place = {w: n for n, w in enumerate(names)}
        ids = np.array([place[w] for w in words], np.int64)
        starts = window_starts(len(words))
        strength = network.inputs(names)[:, [0, 3]].max(axis=1) if names else np.zeros(1)
        rows, inside = _windows(ids, starts)
        best = np.argsort(-np.where(inside, strength[rows], -9).max(axis=1), kind="stable")[:3]
        for s in np.unique(np.concatenate((best, rng.integers(0, len(starts), 2)))):
            chosen.append([held_words.setdefault(w, w) for w in words[starts[s] : starts[s] + WINDOW]])
            spots.append(i)
    spots = np.array(spots)
    by_text = {i: np.nonzero(spots == i)[0] for i in numbers} if len(numbers) < 200 else _grouped(spots)
    first, second, step = {}, {}, 0
    parts = max(1, len(numbers) // (96 if len(numbers) >= 1500 else 24))
    epochs = max(epochs, -(-96 // parts))  # few texts take more rounds
    for epoch in range(epochs):
        rate = 0.02 / (1 + 4 * epoch / epochs)
        for part in np.array_split(rng.permutation(numbers), parts):
            at = np.concatenate([by_text[i] for i in part])
            owner = np.repeat(np.arange(len(part)), [len(by_text[i]) for i in part])
            label = toxic[part].astype(np.float32)
            names = ["", *sorted({w for i in at for w in chosen[i]})]  # number 0 is padding
            place = {w: n for n, w in enumerate(names)}
            rows, inside = np.zeros((len(at), WINDOW), np.int64), np.zeros((len(at), WINDOW), bool)
            for n, i in enumerate(at):
                found = [place[w] for w in chosen[i]]
                rows[n, : len(found)], inside[n, : len(found)] = found, True
            inside[:, 0] = True

            def weigh(logits, owner=owner, label=label):
                order = np.lexsort((-logits, owner))
                top = order[np.unique(owner[order], return_index=True)[1]]
                p = _sigmoid(logits)
                d = np.where(label[owner] == 0, p / 3, 0)
                d[top] = p[top] - label
                own = p[top]
                loss = -np.mean(label * np.log(own + 1e-9) + (1 - label) * np.log(1 - own + 1e-9))
                return loss, (d / len(label)).astype(np.float32)

            _, grads = gradients(network, names, rows, inside, weigh)
            step += 1
            for name, grad in grads.items():
                first[name] = 0.9 * first.get(name, 0) + 0.1 * grad
                second[name] = 0.99 * second.get(name, 0) + 0.01 * grad * grad
                change = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)
                network.weights[name] = (network.weights[name] - rate * change).astype(np.float32)
    held = np.nonzero(~fit)[0] if len(numbers) < len(texts) else numbers
    scorer = Scorer(network)
    logits = np.concatenate([scorer.largest_logits([texts[i] for i in part]) for part in np.array_split(held, max(1, len(held) // 200))])
    labels = toxic[held].astype(float)
    share = max(labels.mean(), 1e-6)
    weight = np.where(labels == 1, prior / share, (1 - prior) / max(1 - share, 1e-6))
    network.slope, network.shift = calibrate(logits.astype(float), labels, weight)
    network.prior = prior
    return network


def _grouped(spots: np.ndarray) -> dict[int, np.ndarray]:
    order = np.argsort(spots, kind="stable")
    values, begins = np.unique(spots[order], return_index=True)
    return dict(zip(values.tolist(), np.split(order, begins[1:])))


def _score(network: Network, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave_nothing_kept()
        scorer = Scorer(network)
        for batch in batches:
            texts, out, begin, size = batch.column("text"), [], 0, 0
            part: list[str] = []
            for text in texts:
                part.append(text.as_py() or "")
                size += len(part[-1])
                if size > PIECE // 2:
                    out.append(scorer.scores(part))
                    part, size = [], 0
            if part:
                out.append(scorer.scores(part))
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(scores)], [*carry, "score"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 1500, longest: int = 30_000, seed: int = 5) -> Network:
    """Learn from labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    The sample is bounded: of each class at most ``per_class`` texts, by hash of their id, and
    none of more than ``longest`` characters. Texts are the only input.
    """
    told = labels.where("toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    told = told.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    counts = dict(tuple(r) for r in told.groupBy("toxic").count().collect())
    parts = [told.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class + per_class // 4) for k in (0, 1)]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= longest)
    sample = texts.join(F.broadcast(parts[0].union(parts[1])), "doc_id").collect()
    sample.sort(key=lambda r: (r.doc_id, r.text))
    kept, seen = [], {0: 0, 1: 0}
    for row in sample:
        if seen[row.toxic] < per_class:
            seen[row.toxic] += 1
            kept.append(row)
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    toxic = np.array([r.toxic for r in kept], np.int64)
    if len(set(toxic.tolist())) < 2:  # nothing to tell apart: every text gets the share of label 1
        network = Network(np.zeros(STAT_BUCKETS, np.float32), fresh_weights(seed), 0.0)
        network.shift, network.prior = float(np.log((prior + 1e-6) / (1 - prior + 1e-6))), prior
        return network
    return train([r.text for r in kept], toxic, prior, seed)


def score_toxicity(docs: DataFrame, network: Network, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry``, ``held_out``, ``score`` and ``predicted`` for every whole text.

    A document's score is that of its strongest window of 32 words; windows overlap by half and
    cover the whole text. A word of more than 64 characters, as in text without blanks, is read in
    overlapping pieces of 64, so windows slide over all of it. A null text counts as empty; a text without words gets the
    share of label 1 as its score, whatever stands beside it. Repeated rows are scored each; an empty table gives an empty result; other
    columns are not looked at.
    """
    rows = docs.select(*dict.fromkeys([*carry, "doc_id", "text"]))
    kept = list(dict.fromkeys([*carry, "doc_id"]))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    scored = rows.mapInArrow(_score(network, kept), f"{kinds}, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select(*carry, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
