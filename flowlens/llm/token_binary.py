"""Token ids in a binary format: Simple-8b words in blocks with offsets."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.tokens import END, encoded, tokens

#: Fixed values, the format: by selector, how many ids a 64-bit word holds in its lower 60 bits.
COUNTS = [60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
WIDTHS = [60 // n for n in COUNTS]
#: The selector of a word whose lower 60 bits number a raw value behind the words.
ESCAPE = 15
BLOCK_IDS = 1 << 16
FORMAT = "simple8b-1"


def _bits(ids: np.ndarray) -> np.ndarray:
    """The number of bits of each id, one at least."""
    high = ids >> np.uint64(32)
    out = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    if high.any():
        out = np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], out)
    return np.maximum(out, 1).astype(np.uint8)


def encode_ids(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Unsigned ids of up to 64 bits as (words, escapes), both little-endian 64-bit.

    Each word takes as many of the next ids as fit. An id of more than 60 bits becomes an
    escape word that points to the raw value in the second part.
    """
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return b"", b""
    need = _bits(ids)
    escaped = need > 60
    choice = np.full(n, len(COUNTS) - 1, np.uint8)
    most, held = need, 1  # the bits of the widest of the next ``held`` ids
    for selector in range(len(COUNTS) - 2, -1, -1):
        width, count = WIDTHS[selector], COUNTS[selector]
        if count > n:
            break
        for ahead in range(held, count):
            most = np.maximum(most[:-1], need[ahead:])
        held = count
        fits = most <= width
        if not fits.any():
            break
        choice[: len(fits)][fits] = selector
    steps = np.array(COUNTS, np.uint8)[choice].tobytes()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts)
    selectors = choice[starts].astype(np.uint64)
    words = selectors << np.uint64(60)
    small = np.where(escaped, np.uint64(0), ids) if escaped.any() else ids
    for selector in np.unique(selectors):
        mine = np.nonzero(selectors == selector)[0]
        width = WIDTHS[int(selector)]
        for i in range(COUNTS[int(selector)]):
            words[mine] |= small[starts[mine] + i] << np.uint64(i * width)
    if escaped.any():
        which = escaped[starts]
        words[which] = (np.uint64(ESCAPE) << np.uint64(60)) | np.arange(which.sum(), dtype=np.uint64)
    return words.astype("<u8").tobytes(), ids[escaped].astype("<u8").tobytes()


def decode_ids(words: bytes, escapes: bytes, n: int) -> np.ndarray:
    """The ids of a block, all words of one selector at a time."""
    packed = np.frombuffer(words, "<u8")
    selectors = (packed >> np.uint64(60)).astype(np.int64)
    raw = selectors == ESCAPE
    counts = np.ones(len(packed), np.int64)
    counts[~raw] = np.array(COUNTS)[selectors[~raw]]
    starts = np.cumsum(counts) - counts
    out = np.zeros(n, np.uint64)
    for selector in np.unique(selectors[~raw]):
        mine = np.nonzero(selectors == selector)[0]
        width = np.uint64(WIDTHS[selector])
        mask = np.uint64((1 << int(width)) - 1)
        for i in range(COUNTS[selector]):
            out[starts[mine] + i] = (packed[mine] >> np.uint64(i * int(width))) & mask
    if raw.any():
        where = packed[raw] & np.uint64((1 << 60) - 1)
        out[starts[raw]] = np.frombuffer(escapes, "<u8")[where.astype(np.int64)]
    return out


BLOCKS = (
    "part int, block long, first_id long, doc_ids array<long>, doc_tokens array<long>, "
    "words binary, escapes binary, format string"
)


def _writer(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tail = np.array([end], "<u4").tobytes()
        ids, held, sizes, pieces, block, first = [], 0, [], [], 0, 0

        def flush() -> pa.RecordBatch:
            words, escapes = encode_ids(np.frombuffer(b"".join(pieces), "<u4"))
            columns = [[part], [block], [first], [ids], [sizes], [words], [escapes], [FORMAT]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.string()]
            names = [x.split()[0] for x in BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for doc, piece in encoded(batches, tokens(path).encode_all):
            ids.append(doc)
            sizes.append(len(piece) // 4 + 1)
            pieces.extend((piece, tail))
            held += sizes[-1]
            if held >= BLOCK_IDS:
                yield flush()
                first, block = first + held, block + 1
                ids, held, sizes, pieces = [], 0, [], []
        if ids:
            yield flush()

    return run


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Write the ids of every whole text, each followed by ``end``, in ascending doc_id order.

    ``path`` becomes a folder of part files, any storage that Spark writes to. A row of a part
    is a block: Simple-8b words, escapes, and for each of its documents id and number of ids.
    A block holds whole documents and closes at 65,536 ids; ``part``, ``block`` and
    ``first_id`` (ids of the part before it) find any document without reading other blocks.

    A null text counts as empty and yields the end id alone. Rows of equal doc_id each keep
    their ids; a null doc_id comes first. An empty table gives an empty folder.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    blocks = ordered.mapInArrow(_writer(tokenizer, end), BLOCKS)
    blocks.write.option("compression", "none").parquet(path)


def _reader(starts: dict[int, int], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["doc_tokens"], np.int64)
                ids = decode_ids(row["words"], row["escapes"], int(sizes.sum())).astype("<u4")
                ends = np.cumsum(sizes)
                begin = starts[row["part"]] + row["first_id"]
                cut = [ids[e - s : e] for s, e in zip(sizes, ends)]
                columns = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(begin + ends - sizes),
                    pa.array(sizes),
                    pa.array([zlib.crc32(x.tobytes()) for x in cut], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in cut], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read_token_file(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Read a token file: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids.

    ``start`` counts the ids of all documents before it. One number per part file passes the
    driver: the ids in it.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("part").agg(F.max_by(F.col("first_id") + F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x), "block"))
    starts, total = {}, 0
    for part, n in sorted(tuple(r) for r in totals.collect()):
        starts[part], total = total, total + n
    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return blocks.mapInArrow(_reader(starts, with_ids), kinds)
