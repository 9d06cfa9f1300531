"""Packing token sequences: cuts by dynamic programming, documents in order."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowlens.llm.tokens import END, encoded, tokens

#: What a cut costs, in tokens of padding: inside a document at a sentence's end, and anywhere else.
SENTENCE_CUT, FREE_CUT = 1.0, 2.0
#: About so many ids are packed at once.
SEGMENT_IDS = 1 << 20
#: The ids of so many new words are kept, and of as many before them: next to a heap grown by other stages.
KEPT_WORDS = 200_000


def choose_cuts(n: int, documents: np.ndarray, sentences: np.ndarray, size: int, more: bool = False) -> list[int]:
    """The ends of the sequences of ``n`` ids in a row that cost least.

    ``documents`` and ``sentences`` are positions at which a document or a sentence ends. Cost
    is the padding of every sequence to ``size`` plus the penalty of every cut inside a
    document. With f(j) the least cost of the ids before j, f(j) = penalty(j) + size - j +
    min(f(i) + i) over the i within ``size`` before j. Every position is tried as a cut.
    ``size`` positions are worked out together: of the i before them the minimum is one running
    backwards; the i among themselves are looked at, too, where one of them may be less.

    If ``more`` ids follow, the last end is the one of the last ``size`` positions before which
    the ids cost least, and what lies behind it is left for later.
    """
    if n <= size:
        return [n] if n else []
    price = np.full(n + 1, size + FREE_CUT)
    price[sentences] = size + SENTENCE_CUT
    price[documents] = size
    value = np.zeros(n + 1)  # f(i) + i
    least = value[:size]
    for low in range(0, n, size):
        if low:
            least = np.minimum.accumulate(value[low : low - size : -1])[::-1]
        high = min(low + size, n)
        here, before = price[low + 1 : high + 1], least[: high - low]
        mine = before + here
        while mine.min() < before[-1]:  # a sequence that begins and ends here
            inner = np.minimum.accumulate(mine[:-1])
            again = here + np.concatenate((before[:1], np.minimum(before[1:], inner)))
            if np.array_equal(again, mine):
                break
            mine = again
        value[low + 1 : high + 1] = mine
    cuts, at = [], n
    if more:
        at -= int((value - np.arange(n + 1))[: n - size : -1].argmin())
    while at:
        cuts.append(at)
        window = value[max(0, at - size) : at]
        at -= 1 + int(window[::-1].argmin())
    cuts.reverse()
    return cuts


def split_tail(length: int) -> list[int]:
    """A last sequence that is far from full, in powers of two, which take no padding."""
    return [1 << bit for bit in range(length.bit_length() - 1, -1, -1) if length >> bit & 1]


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
_NAMES = [x.split()[0] for x in PIECES.split(", ")]


def _packer(path: str, size: int, end: int, enders: tuple[str, ...], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = tokens(path, KEPT_WORDS)
        closing = np.frombuffer(b"".join(coder.encode(x) for x in enders), "<u4")
        tail = np.array([end], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        docs, pieces, before, held = [], [], [], 0

        def flush(last: bool):
            """Pack what is held; ids behind the last sequence wait unless ``last``."""
            nonlocal sequence, docs, pieces, before, held
            ids = np.frombuffer(b"".join(pieces), "<u4")
            sizes = np.array([len(p) // 4 for p in pieces], np.int64)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            cuts = choose_cuts(len(ids), ends, np.nonzero(np.isin(ids, closing, kind="table"))[0] + 1, size, not last)
            if last and cuts:
                rest = cuts[-1] - (cuts[-2] if len(cuts) > 1 else 0)
                if size - rest > size // 64:
                    whole = cuts[-2] if len(cuts) > 1 else 0
                    cuts = cuts[:-1] + (whole + np.cumsum(split_tail(rest))).tolist()
            stop = cuts[-1] if cuts else 0
            opens = np.array([0, *cuts[:-1]], np.int64)
            marks = np.unique(np.concatenate((starts[starts < stop], opens)))
            lengths = np.diff(np.concatenate((marks, [stop])))
            owner = np.searchsorted(starts, marks, "right") - 1
            packed = np.searchsorted(opens, marks, "right") - 1
            begin = np.array(before, np.int64)
            totals = np.array([t for _, t in docs], np.int64)
            crc = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(marks, lengths)]
            columns = [
                pa.array([docs[i][0] for i in owner], pa.int64()),
                pa.array(marks - starts[owner] + begin[owner]),
                pa.array(lengths),
                pa.array(crc, pa.int64()),
                pa.array(totals[owner]),
                pa.array(sequence + packed),
                pa.array(marks - opens[packed]),
            ]
            names = list(_NAMES)
            if with_ids:
                columns.append(pa.array([ids[a : a + n].astype(np.int64) for a, n in zip(marks, lengths)], pa.list_(pa.int64())))
                names.append("ids")
            sequence += len(cuts)
            keep = int(np.searchsorted(ends, stop, "right"))
            docs, kept = docs[keep:], pieces[keep:]
            before = begin[keep:].tolist()
            if docs:
                gone = stop - int(starts[keep])
                if gone > 0:
                    kept[0], before[0] = kept[0][4 * gone :], before[0] + gone
            pieces = kept
            held = sum(len(p) // 4 for p in pieces)
            return pa.RecordBatch.from_arrays(columns, names)

        for doc, piece in encoded(batches, coder.encode_all):
            docs.append((doc, len(piece) // 4 + 1))
            pieces.append(piece + tail)
            before.append(0)
            held += docs[-1][1]
            if held >= max(SEGMENT_IDS, 2 * size):
                yield flush(False)
        if docs:
            yield flush(True)

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    size: int = 2048,
    end: int = END,
    enders: tuple[str, ...] = (".", "!", "?", ".\n", "!!", "."),
    with_ids: bool = False,
) -> DataFrame:
    """Pack all documents, in ascending doc_id order, into sequences of at most ``size`` ids.

    Returns one row per piece: doc_id, start (ids of its document before it), length,
    ids_crc32, doc_tokens, sequence_id and offset (its place in the sequence), and the ids
    themselves with ``with_ids``. A document's ids are those of its whole text and ``end``;
    each id lies in exactly one piece. Cuts are chosen by ``choose_cuts`` over about a million
    ids at a time, every position tried; the ids behind the last sequence of these, fewer than
    ``size``, are packed with those that follow. The last sequence of a range of documents is split in powers of two, which
    need no padding, if it is far from full.

    A null text counts as empty and yields the end id alone. Rows of equal doc_id are packed
    one after another. An empty table gives an empty result; other columns are not looked at.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    kinds = PIECES + (", ids array<long>" if with_ids else "")
    return ordered.mapInArrow(_packer(tokenizer, size, end, enders, with_ids), kinds)
