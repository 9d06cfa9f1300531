"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and decoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import kept_in_worker, mixed, prefix_hash, range_hash

#: Stands for the model's mark of a word's start, so that the same character in a text stays itself.
START = 0x110000
MARK = "▁"
TOGETHER = 1 << 22
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The pieces of a model as a lattice needs them: by hash, with a log weight each.

    A piece of rank r (by its score) weighs as r + 2 to the power of minus ``sharpness``; pieces
    that the model itself never makes are left out. Bytes stand in for characters without a piece.
    """

    def __init__(self, path: str, sharpness: float) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        scores = np.array([model.get_score(i) for i in range(len(names))])
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(len(names))]
        self.bytes = [b""] * len(names)
        self.byte_ids = np.zeros(256, np.int64)
        hashes, ids, sizes = [], [], []
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.bytes[i] = bytes([int(name[3:5], 16)])
                self.byte_ids[int(name[3:5], 16)] = i
            elif not special[i]:
                self.bytes[i] = name.replace(MARK, " ").encode()
                if (scores[i] > -1e8 or len(name) == 1) and MARK not in name[1:]:
                    codes = np.array([START if c == MARK else ord(c) for c in name])
                    hashes.append(range_hash(prefix_hash(codes), np.array([0]), np.array([len(codes)]))[0])
                    ids.append(i)
                    sizes.append(len(codes))
        order = np.argsort(np.array(hashes))
        self.hashes, self.ids = np.array(hashes, np.uint64)[order], np.array(ids)[order]
        rank = np.empty(len(names))
        rank[np.argsort(-scores, kind="stable")] = np.arange(len(names))
        self.weight = -sharpness * np.log(rank + 2)
        self.weight[self.byte_ids] = -sharpness * np.log(len(names) + 2.0)
        self.byte_weight = -sharpness * np.log(len(names) + 2.0)
        self.longest = max(sizes)
        # where the hashes with the same first 22 bits begin, which are hardly ever more than one
        top = (self.hashes >> np.uint64(42)).astype(np.int64)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[top] = True
        self.first = np.zeros(1 << 22, np.uint16 if len(top) < 1 << 16 else np.int32)
        self.first[top[::-1]] = np.arange(len(top))[::-1]
        self.depth = int(np.bincount(np.unique(top, return_inverse=True)[1]).max())
        self.hashes = np.append(self.hashes, np.zeros(self.depth, np.uint64))

    def edges(self, codes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All edges of the lattices of words in a row: begin, end, piece and log weight.

        ``room`` is how many characters of its word follow each position. A character without
        a piece gets an edge of its bytes: the byte's piece, or for several bytes -1 minus its code.
        """
        sums, spots = prefix_hash(codes), np.arange(len(codes))
        begin, end, piece = [], [], []
        for size in range(1, self.longest + 1):
            at = spots[room >= size]
            if not len(at):
                break
            value = range_hash(sums, at, at + size)
            top = (value >> np.uint64(42)).astype(np.int64)
            likely = np.nonzero(self.maybe[top])[0]
            place, wanted = self.first[top[likely]].astype(np.int64), value[likely]
            for more in range(1, self.depth):
                place += self.hashes[place] < wanted
            right = np.nonzero(self.hashes[place] == wanted)[0]
            found = at[likely[right]]
            begin.append(found)
            end.append(found + size)
            piece.append(self.ids[place[right]])
            if size == 1:
                known = np.zeros(len(codes), bool)
                known[found] = True
                other = spots[~known]
                begin.append(other)
                end.append(other + 1)
                code = codes[other].astype(np.int64)
                piece.append(np.where(code < 0x80, self.byte_ids[code & 0x7F], -1 - code))
        begin, end, piece = np.concatenate(begin), np.concatenate(end), np.concatenate(piece)
        byte_edges = piece < 0
        weight = self.weight[np.maximum(piece, 0)]
        if byte_edges.any():
            code = -1 - piece[byte_edges]
            weight[byte_edges] = self.byte_weight * (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        return begin, end, piece, weight


class Lattice:
    """The lattices of distinct words, filtered forward: each position's ways in, with their shares."""

    def __init__(self, words: list[str], pieces: Pieces) -> None:
        sizes = np.array([len(w) for w in words], np.int64) + 1
        self.start = np.cumsum(sizes) - sizes
        codes = np.empty(int(sizes.sum()), np.uint32)
        text = np.ones(len(codes), bool)
        text[self.start] = False
        codes[self.start] = START
        codes[text] = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        self.stop = self.start + sizes
        room = np.repeat(self.stop, sizes) - np.arange(len(codes))
        begin, end, piece, weight = pieces.edges(codes, room)
        # a word's end and the next word's start are one number, so ends are told by their last character
        last = end - 1
        step = last - np.repeat(self.start, sizes)[last]
        order = np.argsort(step * len(codes) + last, kind="stable")
        begin, last, piece, weight, step = begin[order], last[order], piece[order], weight[order], step[order]
        first_of_word = np.zeros(len(codes), bool)
        first_of_word[self.start] = True
        alpha, share = np.zeros(len(codes)), np.empty(len(begin))  # by last character: log weight of all ways there
        levels = np.concatenate(([0], np.nonzero(np.diff(step))[0] + 1, [len(step)]))
        for a, b in zip(levels, levels[1:]):
            before = np.where(first_of_word[begin[a:b]], 0.0, alpha[begin[a:b] - 1])
            total = before + weight[a:b]
            new = np.concatenate(([0], np.nonzero(np.diff(last[a:b]))[0] + 1))
            counts = np.diff(np.append(new, b - a))
            top = np.repeat(np.maximum.reduceat(total, new), counts)
            mass = np.exp(total - top)
            summed = np.repeat(np.add.reduceat(mass, new), counts)
            alpha[last[a:b]] = top + np.log(summed)
            share[a:b] = mass / summed
        order = np.argsort(last, kind="stable")
        self.begin, self.piece, last, share = begin[order], piece[order], last[order], share[order]
        new = np.nonzero(np.diff(last, prepend=-1))[0]
        running = np.cumsum(share)
        within = running - np.repeat(running[new] - share[new], np.diff(np.append(new, len(last))))
        within[np.append(new[1:], len(last)) - 1] = 1.0
        self.ladder = last + within

    def sample(self, word: np.ndarray, chance) -> tuple[np.ndarray, np.ndarray]:
        """Sample a way through the lattice of each occurrence of a word, backward from its end.

        ``chance(occurrences, step)`` gives a number in [0, 1) each. Returns the pieces of all
        occurrences in order and how many each one has.
        """
        active, node = np.arange(len(word)), self.stop[word]
        taken, step = [], 0
        counts = np.zeros(len(word), np.int64)
        while len(active):
            # smaller than the ladder's end of this character, which is its number plus one
            way = np.searchsorted(self.ladder, node - 1 + np.minimum(chance(active, step), 1 - 1e-6), "right")
            taken.append((active, self.piece[way]))
            counts[active] += 1
            node = self.begin[way]
            more = node > self.start[word[active]]
            active, node, step = active[more], node[more], step + 1
        out, ends = np.empty(int(counts.sum()), np.int64), np.cumsum(counts)
        for number, (who, piece) in enumerate(taken):
            out[ends[who] - 1 - number] = piece
        return out, counts


def sample_texts(texts: list[str], keys: np.ndarray, pieces: Pieces, seed: int) -> list[np.ndarray]:
    """The sampled ids of each text; the numbers drawn depend on ``seed``, the text's key and the place alone."""
    split = [t.split(" ") if t else [] for t in texts]
    number: dict[str, int] = {}
    for words in split:
        number.update(dict.fromkeys(words, 0))
    names = list(number)
    if not names:
        return [np.zeros(0, np.int32) for _ in texts]
    number = dict(zip(names, range(len(names))))
    sizes = np.array([len(w) for w in split])
    word = np.fromiter((number[w] for words in split for w in words), np.int64, int(sizes.sum()))
    place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    base = mixed(mixed(keys.view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))[np.repeat(np.arange(len(texts)), sizes)] + place.astype(np.uint64) * GOLDEN)
    order = np.argsort(word, kind="stable")  # occurrences of one word together, which keeps its lattice near
    base, back = base[order], np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))

    def chance(which: np.ndarray, step: int) -> np.ndarray:
        drawn = mixed(base[which] + np.uint64((step + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
        return (drawn >> np.uint64(11)).astype(np.float64) / float(1 << 53)

    found, counts = Lattice(names, pieces).sample(word[order], chance)
    starts = np.cumsum(counts) - counts
    counts, starts = counts[back], starts[back]
    inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    ids = found[np.repeat(starts, counts) + inner]
    cuts = np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], np.cumsum(sizes)))]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        part = ids[a:b]
        if len(part) and part.min() < 0:
            parts = [pieces.byte_ids[np.frombuffer(chr(-1 - i).encode(), np.uint8)] if i < 0 else [i] for i in part.tolist()]
            part = np.concatenate(parts)
        out.append(part.astype(np.int32))
    return out


def pieces_of(path: str, sharpness: float) -> Pieces:
    """The pieces of a model file, loaded once per worker."""
    return kept_in_worker(("pieces", path, sharpness), lambda: Pieces(path, sharpness))


def piece_bytes(path: str) -> list[bytes]:
    """What each piece of a model file stands for, which is all that decoding needs."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
        else b"" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        else model.id_to_piece(i).replace(MARK, " ").encode()
        for i in range(model.get_piece_size())
    ]


def _decoded(ids: np.ndarray, table: list[bytes]) -> str:
    return b"".join(map(table.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


def _encoder(path: str, sharpness: float, seed: int, decode: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path, sharpness)

        def made(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            ids = sample_texts(texts, part.column("key").to_numpy(), pieces, seed)
            sizes = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(ids)))
            columns, names = [*part.columns[1:], listed], [*part.schema.names[1:], "ids"]
            if decode:
                columns.append(pa.array([_decoded(x, pieces.bytes) for x in ids], pa.string()))
                names.append("decoded")
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            begin, texts, held = 0, [], 0
            for number, text in enumerate(batch.column("text"), 1):
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held > TOGETHER or number == batch.num_rows:
                    yield made(batch.slice(begin, number - begin), texts)
                    begin, texts, held = number, [], 0

    return run


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept_in_worker(("piece bytes", path), lambda: piece_bytes(path))
        for batch in batches:
            texts = [_decoded(ids.values.to_numpy(), table) if ids.is_valid else "" for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return run


def sample_pieces(
    docs: DataFrame, model: str, key: Column | None = None, sharpness: float = 1.0, seed: int = 17, decode: bool = False
) -> DataFrame:
    """``doc_id``, ``text`` and a sampled segmentation ``ids`` of every whole text.

    Forward filtering sums the weights of all ways to each position of a word, backward
    sampling draws pieces from the end in proportion, so every segmentation comes up as its
    weight says. Words are parted at blanks, which no piece spans, so a text's lattice is that
    of its words; each distinct word of some texts is filtered once. Draws depend on ``seed``,
    the row's ``key`` (default doc_id) and the place in the text, not on partitions or order.

    A null or empty text has no ids. Rows of equal key and text get equal ids. A null key counts
    as one of its own. An empty table gives an empty result; other columns are not looked at.
    ``decode`` adds what :func:`decode_pieces` gives, from the same worker.
    """
    mark = F.xxhash64(F.col("doc_id") if key is None else key).alias("key")
    kinds = "doc_id long, text string, ids array<int>" + (", decoded string" if decode else "")
    return docs.select(mark, F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _encoder(model, sharpness, seed, decode), kinds
    )


def decode_pieces(rows: DataFrame, model: str) -> DataFrame:
    """Add ``decoded``, the text of ``ids``: exactly the text that was encoded (null or no ids: empty)."""
    kinds = f"{', '.join(f'`{n}` {k}' for n, k in rows.dtypes)}, decoded string"
    return rows.mapInArrow(_decoder(model), kinds)
