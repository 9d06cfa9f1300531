"""N-gram Jaccard join: T-occurrence search with merged short lists and probed long ones.

A document must share at least T shingles with a partner. Ordered from rare to frequent, its
shingles have *short* inverted lists first; a partner must appear in at least one of the first
n - T + 1 of them, whatever the long lists say. So short lists are merged for candidates and
the long ones are only probed, by binary search in the candidate's sorted shingles, until T is
reached or out of reach. ``DivideSkip`` does the same inside a tile of a very large group.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.durable import Scratch
from flowlens.llm.common import complete_groups, boundaries, leave_nothing_kept, prefix_hash, range_hash, text_batches
from flowlens.llm.components import connected_components

#: Bytes and rows that a worker looks at together.
SLICE, ROWS = 1 << 19, 1000
BLOCK = 1000
#: Inverted lists up to this length give pairs, longer ones tiles.
SHORT_LIST = 48
#: A shingle with more than this share of all postings is hot; so there are at most 10,000 hot ones.
HOT_SHARE = 1e-4
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def document_shingles(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document, from UTF-8 bytes and row offsets.

    Words are maximal runs of bytes other than blank and 0x09 to 0x0D, with A-Z lower-cased. A
    shingle is ``width`` words in a row; a document with fewer words is one shingle, one without
    words has none. Hashes have 63 bits, so that they sort alike as signed longs.
    """
    raw = raw.copy()
    upper = (raw >= 65) & (raw <= 90)
    raw[upper] += 32
    out: list[np.ndarray] = []
    begin = 0
    while begin < len(offsets) - 1:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + SLICE, "right")) - 1)
        part = raw[offsets[begin] : offsets[end]]
        edges = offsets[begin : end + 1] - offsets[begin]
        inside = ~IS_SPACE[part]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        limits = edges[(edges > 0) & (edges < len(part))]
        starts[limits] = inside[limits]  # a word never crosses documents
        at = np.nonzero(starts)[0]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        ends[limits - 1] = inside[limits - 1]
        words = range_hash(prefix_hash(part), at, np.nonzero(ends)[0] + 1)
        sums = prefix_hash(words)
        first = np.searchsorted(at, edges)
        n = len(words)
        whole = range_hash(sums, np.arange(max(0, n - width + 1)), np.arange(width, n + 1)) if n >= width else None
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= width:
                out.append(np.unique(whole[a : b - width + 1] >> np.uint64(1)))
            elif b > a:
                one = range_hash(sums, np.array([a]), np.array([b])) + np.uint64((width - (b - a)) * 0x9E3779B97F4A7C15 % (1 << 64))
                out.append(one >> np.uint64(1))
            else:
                out.append(np.zeros(0, np.uint64))
        begin = end
    return out


def least_overlap(n: np.ndarray | int, percent: int):
    """T: the shingles that any partner must share with a document of ``n``."""
    return -(-percent * n // 100)


def slack(n: np.ndarray | int, percent: int):
    """How many shingles of its window a document of ``n`` must at least share with a partner of its size."""
    return 1 + (n - least_overlap(n, percent)) // 2


def _longs(values: list[np.ndarray]) -> pa.Array:
    sizes = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat.view(np.int64)))


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time; what Arrow has set aside in between is given back."""
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            yield batch.slice(begin, ROWS)
        del batch
        pa.default_memory_pool().release_unused()


WINDOWS = "doc_id long, n long, same binary, grams array<long>"


def _windows(width: int, percent: int):
    """Per document: number of shingles, a digest of the set, and the smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave_nothing_kept()
        for batch in _small(batches):
            sets = document_shingles(*text_batches(batch, "text"), width)
            n = np.array([len(s) for s in sets], np.int64)
            take = n - least_overlap(n, percent) + slack(n, percent)
            same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            columns = [batch.column("doc_id"), pa.array(n), pa.array(same, pa.binary())]
            columns.append(_longs([s[: max(0, int(k))] for s, k in zip(sets, take)]))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "same", "grams"])

    return run


def _hot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams, counts = np.unique(batch.column("grams").flatten().to_numpy(), return_counts=True)
        often = counts > max(2, HOT_SHARE * counts.sum())
        yield pa.RecordBatch.from_arrays([pa.array(grams[often]), pa.array(counts[often])], ["gram", "count"])


def hot_shingles(rows: DataFrame, total: int) -> np.ndarray:
    """Shingles that would make a task of their own hot: at most 10,000, in order."""
    counted = rows.select("grams").mapInArrow(_hot_counts, "gram long, count long")
    found = counted.groupBy("gram").agg(F.sum("count").alias("count")).where(F.col("count") > HOT_SHARE * total + 100)
    return np.sort(np.array([r.gram for r in found.orderBy(F.desc("count")).limit(10_000).collect()], np.int64))


def _postings(hot: np.ndarray):
    """One row per shingle of a document, marked if the shingle is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            grams = batch.column("grams")
            flat = grams.flatten()
            owner = np.repeat(batch.column("doc_id").to_numpy(), np.diff(grams.offsets.to_numpy()))
            is_hot = np.isin(flat.to_numpy(), hot)
            yield pa.RecordBatch.from_arrays([pa.array(owner), flat, pa.array(is_hot)], ["doc_id", "gram", "hot"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings sorted by shingle: those of shingles in two documents or more, with that number."""
    for rows in complete_groups(batches, ["gram"]):
        cuts = boundaries(rows, ["gram"])
        sizes = np.diff(np.append(cuts, rows.num_rows))
        count = np.repeat(sizes, sizes)
        kept = rows.filter(pa.array(count > 1))
        columns = [kept.column("doc_id").combine_chunks(), kept.column("gram").combine_chunks(), pa.array(count[count > 1])]
        yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], ["doc_id", "gram", "df"])


def shared_postings(rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """The postings (doc_id, gram, df) of shingles that several documents hold.

    The lists of hot shingles never meet in one task; their df stands as 2^40.
    """
    postings = rows.select("doc_id", "grams").mapInArrow(_postings(hot), "doc_id long, gram long, hot boolean")
    cold = postings.where("not hot").select("doc_id", "gram").repartition("gram").sortWithinPartitions("gram")
    counted = cold.mapInArrow(_frequencies, "doc_id long, gram long, df long")
    if not len(hot):
        return counted
    return counted.union(postings.where("hot").select("doc_id", "gram", F.lit(1 << 40).alias("df")))


def _bit_filter(ids: DataFrame, count: int) -> np.ndarray:
    """Flags of bounded size (at most 32 MB), set at the place of every id and at few others."""
    bits = 1 << min(28, max(16, int(16 * max(1, count)).bit_length()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits)) + 1  # Spark's bitmaps count from 1
    rows = ids.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p"))
    flags = np.zeros((bits // 32768, 4096), np.uint8)
    for row in rows.groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect():
        flags[row.b - 1] = np.frombuffer(row.m, np.uint8)
    return flags.ravel()


def _sets(width: int, flags: np.ndarray):
    """The whole shingle sets of the documents whose place is set in ``flags``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            at = batch.column("place").to_numpy()
            batch = batch.filter(pa.array(flags[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0))
            sets = document_shingles(*text_batches(batch, "text"), width)
            n = pa.array(np.array([len(s) for s in sets], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, _longs(sets)], ["doc_id", "n", "grams"])

    return run


def _prefixes(percent: int):
    """From a document's shared postings: its short lists, the first n - T + 1 shingles from rare to frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in complete_groups(batches, ["doc_id"]):
            cuts = boundaries(rows, ["doc_id"])
            sizes = np.diff(np.append(cuts, rows.num_rows))
            doc, n = rows.column("doc_id").to_numpy(), rows.column("n").to_numpy()
            gram, df = rows.column("gram").to_numpy(), rows.column("df").to_numpy()
            group = np.repeat(np.arange(len(cuts)), sizes)
            order = np.lexsort((gram, df, group))
            own = n[cuts]
            left = own - least_overlap(own, percent) + 1 - (own - sizes)  # shingles of its own come first
            keep = order[np.arange(len(order)) - np.repeat(cuts, sizes) < np.repeat(left, sizes)]
            columns = [pa.array(x[keep]) for x in (doc, n, gram)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "gram"])

    return run


def overlap_reached(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough: binary probes, given up as soon as T is out of reach."""
    if len(a) > len(b):
        a, b = b, a
    total = len(a) + len(b)
    need = -(-percent * total // (100 + percent))
    seen = 0
    for begin in range(0, len(a), 256):
        part = a[begin : begin + 256]
        at = np.searchsorted(b, part)
        seen += int((b[np.minimum(at, len(b) - 1)] == part).sum())
        if seen + len(a) - begin - len(part) < need:
            return False
    return 100 * seen >= percent * (total - seen)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            left, right = batch.column("left"), batch.column("right")
            good = [overlap_reached(a.values.to_numpy(), b.values.to_numpy(), percent) for a, b in zip(left, right)]
            kept = batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
            yield kept

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_verify(percent), "a long, b long")


class DivideSkip:
    """Inverted lists of a block of documents, searched for documents that hold T of a query's shingles."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets])
        grams = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(grams, kind="stable")
        self.owner = owner[order]
        self.grams, self.first = np.unique(grams[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))

    def search(self, query: np.ndarray, percent: int, wanted: np.ndarray) -> np.ndarray:
        """Documents among ``wanted`` similar enough to ``query``."""
        at = np.searchsorted(self.grams, query)
        at = at[(at < len(self.grams))]
        at = at[np.isin(self.grams[at], query)]
        lists = sorted((self.owner[self.first[i] : self.last[i]] for i in at), key=len)
        need = int(least_overlap(len(query), percent))
        if len(lists) < need:
            return np.zeros(0, np.int64)
        longest = len(lists[-1])
        skip = min(need - 1, int(need / (0.01 * np.log2(max(2, longest)) + 1)))
        short, long = lists[: len(lists) - skip], lists[len(lists) - skip :]
        found, seen = self._merged(short)
        enough = (seen >= need - len(long)) & wanted[found]
        found, seen = found[enough], seen[enough]
        for held in long:
            if not len(found):
                break
            spot = np.searchsorted(held, found)
            seen = seen + (held[np.minimum(spot, len(held) - 1)] == found)
        return found[100 * seen >= percent * (len(query) + self.sizes[found] - seen)]

    @staticmethod
    def _merged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Documents of sorted lists in order, and in how many lists each is; few short lists by a heap."""
        if sum(map(len, lists)) > 64:
            return np.unique(np.concatenate(lists), return_counts=True)
        found: list[int] = []
        seen: list[int] = []
        for doc in heapq.merge(*(x.tolist() for x in lists)):
            if found and found[-1] == doc:
                seen[-1] += 1
            else:
                found.append(doc)
                seen.append(1)
        return np.array(found, np.int64), np.array(seen, np.int64)


def _tiles(percent: int):
    keys = ["root", "qb", "ib"]

    def one(rows: pa.Table, out: list) -> None:
        ask = rows.column("ask").to_numpy(zero_copy_only=False)
        ids, parts = rows.column("doc_id").to_numpy(), rows.column("part").to_numpy().copy()
        sets = [x.values.to_numpy() for x in rows.column("grams")]
        stored = np.nonzero(~ask)[0]
        index = DivideSkip([sets[i] for i in stored])
        part = parts[stored].copy()
        for i in np.nonzero(ask)[0]:
            mine = parts[i]
            hits = index.search(sets[i], percent, part != mine)
            for h in hits:
                if part[h] != mine:  # one link joins two components; more of them add nothing
                    out.append((ids[i], ids[stored[h]]))
                    old = part[h]
                    part[part == old] = mine
                    parts[parts == old] = mine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in complete_groups(batches, keys):
            cuts, out = [*boundaries(rows, keys), rows.num_rows], []
            for begin, end in zip(cuts, cuts[1:]):
                one(rows.slice(begin, end - begin), out)
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _in_tiles(groups: DataFrame, sets: DataFrame, part: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links between different components inside very large candidate groups.

    ``groups`` (doc_id, root). Documents outside a group's largest component are its queries,
    all its documents are searched, both in blocks; a tile is a block of each.
    """
    rows = groups.join(part, "doc_id")
    sizes = rows.groupBy("root", "part").count()
    largest = sizes.groupBy("root").agg(F.max(F.struct("count", "part")).alias("m"), F.sum("count").alias("docs"))
    largest = largest.select("root", F.col("m.part").alias("main"), "docs", (F.col("docs") - F.col("m.count")).alias("rest"))
    largest = largest.where("rest > 0")
    blocks = largest.withColumn("nq", F.ceil(F.col("rest") / BLOCK).cast("int")).withColumn("ni", F.ceil(F.col("docs") / BLOCK).cast("int"))
    placed = scratch.keep(rows.join(blocks, "root").join(sets.select("doc_id", "grams"), "doc_id"))
    spot = F.xxhash64("doc_id")
    asks = placed.where("part != main").withColumn("qb", F.pmod(spot, F.col("nq")).cast("int"))
    asks = asks.withColumn("ib", F.explode(F.expr("sequence(0, ni - 1)"))).withColumn("ask", F.lit(True))
    held = placed.withColumn("ib", F.pmod(spot, F.col("ni")).cast("int"))
    held = held.withColumn("qb", F.explode(F.expr("sequence(0, nq - 1)"))).withColumn("ask", F.lit(False))
    columns, keys = ["doc_id", "part", "grams", "ask", "root", "qb", "ib"], ["root", "qb", "ib"]
    tiles = asks.select(*columns).union(held.select(*columns)).repartition(*keys).sortWithinPartitions(*keys)
    return tiles.mapInArrow(_tiles(percent), "a long, b long")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Documents whose sets of word ``width``-grams have a Jaccard similarity of ``percent`` / 100 or more.

    Returns ``doc_id``, ``n_shingles`` (size of the set) and ``component_id``, the smallest
    doc_id reachable over links. Exact: every pair that is similar enough is linked or already
    joined by other links.

    1. Each document's smallest hashes, enough that a similar pair must share many of them;
       documents whose share of them in other documents is too small are done.
    2. Equal sets become one class. The classes' shingles are ordered from rare to frequent;
       the first n - T + 1 are the short lists.
    3. Each short list links its documents with its first one, verified on whole sets. Only
       lists that still hold several components give more: pairs, or tiles for long lists.

    Very frequent shingles, at most 10,000, are known before the shuffle and never meet in one
    task. A null text counts as empty; documents without words have no shingles and link with
    nothing. Repeated rows of one doc_id count as one document each way but come out as often
    as they went in; rows with a null doc_id are dropped. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    windows = scratch.keep(texts.mapInArrow(_windows(width, percent), WINDOWS))
    total = windows.agg(F.sum(F.size("grams"))).first()[0] or 0
    shared = shared_postings(windows, hot_shingles(windows, total))
    seen = shared.groupBy("doc_id").agg(F.count("*").alias("seen"))
    smallest = F.ceil(F.col("n") * percent / 100)
    enough = 1 + F.floor((smallest - F.ceil(smallest * percent / 100)) / 2)
    firsts = windows.where("n > 0").groupBy("n", "same").agg(F.min("doc_id").alias("rep"))
    active = windows.join(seen, "doc_id").where(F.col("seen") >= enough).select("doc_id").distinct()
    active = scratch.keep(active.join(firsts.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"))
    through = _bit_filter(active, active.count())
    place = F.pmod(F.xxhash64("doc_id"), F.lit(8 * len(through))).alias("place")
    near = texts.select("doc_id", "text", place).mapInArrow(_sets(width, through), "doc_id long, n long, grams array<long>")
    sets = scratch.keep(near.join(active, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    total = sets.agg(F.sum("n")).first()[0] or 0
    postings = shared_postings(sets, hot_shingles(sets, total)).join(sets.select("doc_id", "n"), "doc_id")
    postings = postings.repartition("doc_id").sortWithinPartitions("doc_id")
    short = scratch.keep(postings.mapInArrow(_prefixes(percent), "doc_id long, n long, gram long"))

    heads = short.groupBy("gram").agg(F.min(F.struct("n", "doc_id")).alias("head"), F.count("*").alias("df")).where("df > 1")
    fits = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    stars = short.join(heads, "gram").select("doc_id", "n", F.col("head.doc_id").alias("a"), F.col("head.n").alias("m"), "gram")
    pairs = stars.where("doc_id != a").where(fits).select(F.col("doc_id").alias("b"), "a").distinct()
    links = scratch.keep(verified(pairs, sets, percent))
    part = connected_components(links, "a", "b")
    part = scratch.keep(
        sets.select("doc_id").join(part.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", F.coalesce("component", "doc_id").alias("part"))
    )

    spots = short.join(part, "doc_id")
    mixed = spots.groupBy("gram").agg(F.count("*").alias("df"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo != hi")
    open_lists = scratch.keep(spots.join(mixed.select("gram", "df"), "gram").select("gram", "df", "doc_id", "n", "part"))
    few = open_lists.where(F.col("df") <= SHORT_LIST)
    other = few.select("gram", F.col("doc_id").alias("a"), F.col("n").alias("m"), F.col("part").alias("other"))
    pairs = few.join(other, "gram").where("a < doc_id and part != other").where(fits)
    links = links.union(verified(pairs.select("a", F.col("doc_id").alias("b")).distinct(), sets, percent))
    many = open_lists.where(F.col("df") > SHORT_LIST)
    if not many.isEmpty():
        edges = many.join(many.groupBy("gram").agg(F.min("doc_id").alias("a")), "gram").select("a", F.col("doc_id").alias("b"))
        groups = connected_components(edges.distinct(), "a", "b").select(F.col("node").alias("doc_id"), F.col("component").alias("root"))
        links = links.union(_in_tiles(groups, sets, part, percent, scratch))
    parts = connected_components(scratch.keep(links), "a", "b")
    classes = windows.select("doc_id", "n", "same").join(firsts, ["n", "same"], "left")
    out = classes.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
