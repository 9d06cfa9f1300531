"""Suffix-array deduplication: repeated windows by a radix sort of suffixes down to the threshold.

The windows of ``length`` bytes are the suffixes cut at the threshold; a window is a duplicate
if a smaller document holds an equal one. They are ordered by most significant digit first, and
only groups that still hold several documents go on to the next digit:

1. The first digit of a window is its *minimizer*, the smallest of its 16-byte grams by hash.
   Neighbouring windows with one minimizer form a run, which is handled as one string.
2. The second digit is the whole run: runs of equal bytes are equal in all their windows.
3. Only minimizers that have several different runs go to the last digit, the windows themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.durable import Scratch
from flowlens.llm.common import boundaries, complete_groups, leave_nothing_kept, mixed, prefix_hash, range_hash, text_batches

GRAM = 16
#: Bytes of text and entries that a worker looks at together; each takes some 100 bytes of memory there.
SLICE, ENTRIES = 1 << 19, 1 << 19
BUCKET_BYTES = 1 << 23
#: Grams are compared by the upper 24 bits of their hash, then by place, the leftmost first.
LOW = np.uint64((1 << 40) - 1)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """out[j] = min(values[j : j + width]), for the positions that have so many values."""
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


class Runs:
    """The runs of windows of some documents: ``doc`` (its number), ``gram`` (the minimizer's hash),
    ``begin`` and ``end`` of the run's bytes, ``offset`` of the minimizer in it, ``number`` within the document."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, length: int) -> None:
        self.sums = prefix_hash(raw)
        n, width = len(raw), length - GRAM + 1
        empty = np.zeros(0, np.int64)
        self.doc = self.begin = self.end = self.offset = self.number = empty
        self.gram = np.zeros(0, np.uint64)
        if n < length:
            return
        at = np.arange(n - GRAM + 1)
        hashes = range_hash(self.sums, at, at + GRAM)
        least = _sliding_min((hashes & ~LOW) | at.astype(np.uint64), width)
        place = (least & LOW).astype(np.int64)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        starts = np.arange(len(place))
        whole = owner[: len(place)] == owner[length - 1 : length - 1 + len(place)]
        starts, place = starts[whole], place[whole]
        if not len(starts):
            return
        new = np.ones(len(starts), bool)
        new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.nonzero(new)[0]
        last = np.append(first[1:], len(starts)) - 1
        self.begin, self.end = starts[first], starts[last] + length
        self.offset = place[first] - self.begin
        self.gram, self.doc = hashes[place[first]], owner[self.begin]
        self.number = np.arange(len(first)) - np.searchsorted(self.doc, self.doc)

    def digest(self) -> np.ndarray:
        """A hash of each run's bytes and of where its minimizer is."""
        return mixed(range_hash(self.sums, self.begin, self.end) + self.offset.astype(np.uint64))


def slices(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Documents in slices of bounded size: first, last, bytes and offsets of a slice. A very long document is one slice."""
    begin = 0
    while begin < len(offsets) - 1:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + SLICE, "right")) - 1)
        yield begin, end, raw[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end


def _pack(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of unsigned integers, so many bytes each, one after another behind their length."""
    parts = [np.array([len(columns[0][0])], "<u8").tobytes()]
    for values, size in columns:
        parts.append(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes())
    return b"".join(parts)


def _unpack(blob: bytes, *sizes: int) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob, "<u8", 1)[0]), 8, []
    for size in sizes:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :size] = np.frombuffer(blob, np.uint8, n * size, at).reshape(n, size)
        out.append(wide.view("<u8").ravel())
        at += n * size
    return out


#: Bytes of an entry's minimizer, run digest, document id and run number.
ENTRY = (5, 6, 8, 4)
#: Kinds of rows in a bucket: runs known to be duplicates, runs to look at, results by window, texts.
KNOWN, ASKED, WINDOWS, TEXT = 0, 1, 2, 3
BLOBS = "bucket long, kind int, blob binary"


def _bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _split(buckets: np.ndarray, kind: int, sizes: tuple[int, ...], *columns: np.ndarray) -> pa.RecordBatch:
    """One row per bucket with its part of the columns."""
    order = np.argsort(buckets, kind="stable")
    names, first = np.unique(buckets[order], return_index=True)
    cuts = np.append(first, len(order))
    blobs = []
    for a, b in zip(cuts, cuts[1:]):
        mine = order[a:b]
        blobs.append(_pack(*((c[mine], s) for c, s in zip(columns, sizes))))
    kinds = np.full(len(names), kind, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(kinds), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])


def _classes(gram, digest, doc) -> tuple[np.ndarray, np.ndarray]:
    """Order of entries by minimizer, run and document, and for each its class's smallest document."""
    order = np.lexsort((doc.view(np.int64), digest, gram))
    gram, digest, doc = gram[order], digest[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (digest[1:] != digest[:-1])
    return order, doc[np.nonzero(new)[0]][np.cumsum(new) - 1]


def _entries(length: int, buckets: int):
    """The runs of all documents by minimizer. Of equal runs that a task meets, only those of
    the smallest document go on; the others are duplicates already and go to their documents."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        gram, digest, doc, number = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order, smallest = _classes(gram, digest, doc)
        gram, digest, doc, number = gram[order], digest[order], doc[order], number[order]
        known = doc != smallest
        if known.any():
            yield _split(buckets + _bucket_of(doc[known], buckets), KNOWN, (8, 4), doc[known], number[known])
        spot = (gram >> np.uint64(40)) % np.uint64(buckets)
        rest = ~known
        yield _split(spot[rest].astype(np.int64), ASKED, ENTRY, *(x[rest] for x in (gram, digest, doc, number)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave_nothing_kept()
        held, size = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            raw, offsets = text_batches(batch, "text")
            for begin, end, part, edges in slices(raw, offsets):
                runs = Runs(part, edges, length)
                held.append((runs.gram, runs.digest(), ids[begin:end][runs.doc].view(np.uint64), runs.number))
                size += len(runs.gram)
                if size > ENTRIES:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return run


def _second_digit(buckets: int):
    """Runs equal to a run of a smaller document are duplicates; minimizers with several runs are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in complete_groups(batches, ["bucket"]):
            cuts = [*boundaries(rows, ["bucket"]), rows.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part = rows.slice(a, b - a)
                if part.column("kind")[0].as_py() == KNOWN:
                    names = pa.array(part.column("bucket").to_numpy() - buckets)
                    columns = [names, part.column("kind").combine_chunks(), part.column("blob").combine_chunks()]
                    for batch in pa.Table.from_arrays(columns, names=["bucket", "kind", "blob"]).to_batches():
                        yield batch
                    continue
                found = [_unpack(x.as_py(), *ENTRY) for x in part.column("blob")]
                gram, digest, doc, number = (np.concatenate(x) for x in zip(*found))
                order, smallest = _classes(gram, digest, doc)
                gram, digest, doc, number = gram[order], digest[order], doc[order], number[order]
                known = doc != smallest
                if known.any():
                    yield _split(_bucket_of(doc[known], buckets), KNOWN, (8, 4), doc[known], number[known])
                new = np.ones(len(gram), bool)
                new[1:] = gram[1:] != gram[:-1]
                first = np.nonzero(new)[0]
                several = np.maximum.reduceat(digest, first) != np.minimum.reduceat(digest, first)
                docs = np.maximum.reduceat(doc.view(np.int64), first) != np.minimum.reduceat(doc.view(np.int64), first)
                asked = (several & docs)[np.cumsum(new) - 1] & ~known
                if asked.any():
                    yield _split(_bucket_of(doc[asked], buckets), ASKED, (8, 4), doc[asked], number[asked])

    return run


def _texts(buckets: int):
    """Texts as rows of the buckets of their documents: id and compressed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pressed = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            raw, offsets = text_batches(batch, "text")
            blobs = [
                int(i).to_bytes(8, "little", signed=True) + pressed.compress(raw[a:b].tobytes())
                for i, a, b in zip(ids, offsets, offsets[1:])
            ]
            columns = [pa.array(_bucket_of(ids, buckets)), pa.array(np.full(len(ids), TEXT, np.int32)), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "blob"])

    return run


def _with_texts(batches: Iterator[pa.RecordBatch]):
    """For each bucket the entries of each kind, sorted by document, then the texts in small groups."""
    bucket, told, waiting, size, sorted_by = None, {}, [], 0, True
    for batch in batches:
        for name, kind, blob in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob")):
            if name != bucket:
                if waiting:
                    yield told, waiting
                bucket, told, waiting, size, sorted_by = name, {}, [], 0, False
            if kind != TEXT:
                sizes = (8, 4, 8) if kind == WINDOWS else (8, 4)
                told.setdefault(kind, []).append(_unpack(blob.as_py(), *sizes))
                continue
            if not sorted_by:
                told, sorted_by = {k: _by_document(v) for k, v in told.items()}, True
            held = blob.as_py()
            doc = int.from_bytes(held[:8], "little", signed=True)
            text = zstandard.decompress(held[8:]) if len(held) > 8 else b""
            waiting.append((doc, text))
            size += len(text)
            if size > SLICE:
                yield told, waiting
                waiting, size = [], 0
    if waiting:
        yield told, waiting


def _by_document(parts: list) -> list[np.ndarray]:
    columns = [np.concatenate(x) for x in zip(*parts)]
    columns[0] = columns[0].view(np.int64)
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def _of(told: dict, kind: int, doc: int) -> list[np.ndarray]:
    """The entries of a document."""
    if kind not in told:
        return [np.zeros(0, np.uint64)] * 2
    columns = told[kind]
    a, b = np.searchsorted(columns[0], [doc, doc + 1])
    return [c[a:b] for c in columns[1:]]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(texts), np.uint8)
    return raw, np.concatenate(([0], np.cumsum([len(t) for t in texts])))


def _asked_runs(length: int):
    """The bytes of the runs that were asked for, by minimizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for told, docs in _with_texts(batches):
            docs = [d for d in docs if len(_of(told, ASKED, d[0])[0])]
            for begin, end, raw, edges in slices(*_joined([t for _, t in docs])):
                runs = Runs(raw, edges, length)
                first = np.searchsorted(runs.doc, np.arange(end - begin + 1))
                wanted = [first[i] + np.unique(_of(told, ASKED, docs[begin + i][0])[0]).astype(np.int64) for i in range(end - begin)]
                at = np.concatenate(wanted)
                ids = np.repeat([d for d, _ in docs[begin:end]], [len(w) for w in wanted])
                columns = [
                    pa.array(runs.gram[at].view(np.int64)), pa.array(ids, pa.int64()), pa.array(runs.number[at].astype(np.int32)),
                    pa.array(runs.offset[at].astype(np.int32)),
                    pa.array([raw[a:b].tobytes() for a, b in zip(runs.begin[at], runs.end[at])], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "doc_id", "number", "place", "run"])

    return run


def _last_digit(length: int, buckets: int):
    """The windows of the runs of one minimizer: those that a smaller document holds, as bits of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in complete_groups(batches, ["gram"]):
            doc, number = rows.column("doc_id").to_numpy(), rows.column("number").to_numpy()
            raw, edges = _joined(rows.column("run").to_pylist())
            windows = np.diff(edges) - length + 1
            run_of = np.repeat(np.arange(len(doc)), windows)
            inner = np.arange(len(run_of)) - np.repeat(np.cumsum(windows) - windows, windows)
            at = edges[:-1][run_of] + inner
            # equal windows have their minimizer at the same place, so the hash of bytes and minimizer tells all
            value = range_hash(prefix_hash(raw), at, at + length)
            value = mixed(value ^ mixed(rows.column("gram").to_numpy().view(np.uint64)[run_of]))
            order = np.lexsort((doc[run_of], value))
            value, owner = value[order], doc[run_of][order]
            new = np.ones(len(value), bool)
            new[1:] = value[1:] != value[:-1]
            smallest = owner[np.nonzero(new)[0]][np.cumsum(new) - 1]
            copied = order[owner > smallest]
            if not len(copied):
                continue
            bits = np.zeros(len(doc), np.uint64)
            np.bitwise_or.at(bits, run_of[copied], np.uint64(1) << inner[copied].astype(np.uint64))
            hit = np.nonzero(bits)[0]
            ids = doc[hit].view(np.uint64)
            yield _split(_bucket_of(doc[hit], buckets), WINDOWS, (8, 4, 8), ids, number[hit], bits[hit])

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(length: int, with_text: bool):
    """Each document without the bytes of duplicate windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for told, docs in _with_texts(batches):
            for begin, end, raw, edges in slices(*_joined([t for _, t in docs])):
                mine = docs[begin:end]
                known = [_of(told, KNOWN, d)[0] for d, _ in mine]
                partly = [_of(told, WINDOWS, d) for d, _ in mine]
                change = np.zeros(len(raw) + 1, np.int32)
                if any(len(k) for k in known) or any(len(p[0]) for p in partly):
                    runs = Runs(raw, edges, length)
                    first = np.searchsorted(runs.doc, np.arange(end - begin + 1))
                    at = np.concatenate([first[i] + k.astype(np.int64) for i, k in enumerate(known)])
                    np.add.at(change, runs.begin[at], 1)
                    np.add.at(change, runs.end[at], -1)
                    at = np.concatenate([first[i] + p[0].astype(np.int64) for i, p in enumerate(partly)])
                    bits = np.concatenate([p[1] for p in partly])
                    for bit in range(length):
                        spots = runs.begin[at[(bits >> np.uint64(bit)) & np.uint64(1) > 0]] + bit
                        np.add.at(change, spots, 1)
                        np.add.at(change, spots + length, -1)
                covered = np.cumsum(change[:-1]) > 0
                out = []
                for (doc, text), a, b in zip(mine, edges, edges[1:]):
                    gone = covered[a:b]
                    kept = raw[a:b][~gone].tobytes() if gone.any() else text
                    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    row = (doc, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
                    out.append((*row, kept.decode("utf-8", "ignore")) if with_text else row)
                kinds = [pa.int64()] * 4 + [pa.string()] * 2
                names = [x.split()[0] for x in RESULT.split(", ")] + ["text"]
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return run


def _met(blobs: DataFrame, texts: DataFrame) -> DataFrame:
    """Blobs and texts in the tasks of their buckets, blobs first."""
    return blobs.union(texts).repartition("bucket").sortWithinPartitions("bucket", "kind")


def remove_repeats(docs: DataFrame, length: int = 50, with_text: bool = False) -> DataFrame:
    """Remove every byte that a string of ``length`` bytes covers which also starts in a document of smaller doc_id.

    Returns ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and
    ``kept_sha256`` of the bytes that stay, and with ``with_text`` those bytes as ``text``
    (bytes of a character that was cut apart are left out of it). Exact for all UTF-8 bytes of
    whole texts; overlaps count, strings are judged on the input, matches never cross documents.

    Equal runs that a task meets are merged before the shuffle, so a passage that a third of
    all documents share is one entry per task. What goes to the last digit is one run per
    distinct run. Entries are packed, some 25 bytes a run of 18 windows on average.

    A null text counts as empty. Rows of one doc_id must hold one text; repeated rows do not
    remove each other and come out as often as they went in. Rows with a null doc_id have no
    order: they lose nothing and take nothing from others. Texts under ``length`` bytes stay whole. An empty table gives an empty result.
    ``length`` is from 17 to 79.
    """
    if not GRAM < length < GRAM + 64:
        raise ValueError("length is from 17 to 79")
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    total = given.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES)))
    entries = given.mapInArrow(_entries(length, buckets), BLOBS)
    entries = entries.repartition("bucket").sortWithinPartitions("bucket")
    second = scratch.keep(entries.mapInArrow(_second_digit(buckets), BLOBS))
    texts = given.mapInArrow(_texts(buckets), BLOBS)
    asked = _met(second.where(F.col("kind") == ASKED), texts)
    runs = asked.mapInArrow(_asked_runs(length), "gram long, doc_id long, number int, place int, run binary")
    runs = runs.repartition("gram").sortWithinPartitions("gram")
    last = runs.mapInArrow(_last_digit(length, buckets), BLOBS)
    known = second.where(F.col("kind") == KNOWN).union(last)
    kinds = RESULT + (", text string" if with_text else "")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    unordered = docs.where("doc_id IS NULL").select(
        F.lit(None).cast("bigint").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"),
        F.sha2(text.cast("binary"), 256).alias("kept_sha256"), *([text.alias("text")] if with_text else []),
    )
    return _met(known, texts).mapInArrow(_removed(length, with_text), kinds).unionByName(unordered)
