"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.durable import Scratch
from flowlens.llm.common import boundaries, complete_groups, matrix, usable

BLOCK = 2048


def _hashes(vectors: np.ndarray, extra: np.ndarray, tables: int, functions: int, width: float, seed: int):
    """Projections on normal directions, in widths of a bucket: an array (rows, tables, functions)."""
    dim = vectors.shape[1]
    rng = np.random.default_rng([seed, dim])
    directions = rng.normal(size=(dim + 1, tables * functions))
    shifts = rng.uniform(0, 1, tables * functions)
    spots = (vectors @ directions[:-1] + extra[:, None] * directions[-1]) / width + shifts
    return spots.reshape(len(vectors), tables, functions)


def _keys(cells: np.ndarray) -> np.ndarray:
    """One long for the cell numbers on the last axis."""
    key = np.zeros(cells.shape[:-1], np.int64)
    for i in range(cells.shape[-1]):
        key = key * np.int64(1_000_003) + cells[..., i].astype(np.int64)
    return key


def _listed(values: np.ndarray) -> pa.Array:
    starts = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(starts, pa.array(values.ravel()))


def _hasher(tables: int, functions: int, probes: int, width: float, norm: float, seed: int, query: bool):
    """Adds ``keys``: the bucket of a row per table, or a query's buckets in order of success."""
    moves = np.array(list(itertools.product((0, -1, 1), repeat=functions)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes):
                rows = batch.filter(pa.array(sizes == dim))
                v = matrix(rows.column("v"), np.float64)
                lengths = np.sqrt((v * v).sum(axis=1))
                if query:  # the order of inner products does not depend on the query's length
                    v, extra = v * (norm / lengths)[:, None], np.zeros(len(v))
                else:  # equal lengths make the nearest by distance the largest inner product
                    extra = np.sqrt(np.maximum(norm * norm - lengths * lengths, 0))
                spots = _hashes(v, extra, tables, functions, width * norm, seed)
                cells = np.floor(spots).astype(np.int64)
                if query:
                    inside = spots - cells
                    cost = np.stack([np.zeros_like(inside), (1 - inside) ** 2, inside**2], axis=-1)  # 0, 1, -1
                    total = sum(cost[:, :, i, moves[:, i]] for i in range(functions))
                    best = np.argsort(total, axis=2, kind="stable")[:, :, :probes]
                    cells = cells[:, :, None, :] + moves[best]
                    keys = _keys(cells)
                    tabled = np.repeat(np.arange(tables, dtype=np.int32), keys.shape[2])
                    keys = keys.reshape(len(v), -1)
                else:
                    keys, tabled = _keys(cells), np.arange(tables, dtype=np.int32)
                tabled = np.broadcast_to(tabled, keys.shape)
                columns = [*rows.columns, _listed(keys), _listed(np.ascontiguousarray(tabled))]
                yield pa.RecordBatch.from_arrays(columns, [*rows.schema.names, "keys", "tabled"])

    return run


def _nearest(k: int):
    keys = ["dim", "tab", "key", "rb", "qb"]

    def tile(rows: pa.Table, out: list) -> None:
        asks = rows.column("ask").to_numpy(zero_copy_only=False)
        ids, v = rows.column("id").to_numpy(), matrix(rows.column("v"), np.float64)
        queries, found = np.nonzero(asks)[0], np.nonzero(~asks)[0]
        if not len(queries) or not len(found):
            return
        scores = v[queries] @ v[found].T
        scores[ids[queries][:, None] == ids[found][None, :]] = -np.inf
        least = np.full((len(queries), 1), -np.inf)
        if len(found) > k:
            least = np.partition(scores, len(found) - k, axis=1)[:, [len(found) - k]]
        # the slack keeps equal scores whatever order the sums were made in
        at, hit = np.nonzero((scores >= least - 1e-9 * np.abs(least)) & (scores > -np.inf))
        exact = (v[queries[at]] * v[found[hit]]).sum(axis=1)
        order = np.lexsort((ids[found[hit]], -exact, at))
        at, hit, exact = at[order], hit[order], exact[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        keep = rank < k
        out.append((ids[queries[at[keep]]], ids[found[hit[keep]]], exact[keep]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in complete_groups(batches, keys):
            cuts = [*boundaries(rows, keys), rows.num_rows]
            out: list = []
            for begin, end in zip(cuts, cuts[1:]):
                tile(rows.slice(begin, end - begin), out)
            if out:
                columns = [pa.array(np.concatenate(x)) for x in zip(*out)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "id", "score"])

    return run


def nearest_neighbours(
    rows: DataFrame,
    queries: Column,
    row_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    tables: int = 3,
    functions: int = 4,
    width: float = 1.75,
    probes: int = 40,
    seed: int = 11,
) -> DataFrame:
    """The ``k`` rows of largest inner product with each row that ``queries`` selects.

    Returns ``query_id``, ``rank`` from 1, ``row_id`` and ``score``, the exact inner product in
    double precision; nearest first, ties to the smaller id. A query never finds its own row.

    Vectors are lengthened by one component to the length of the longest, which turns the
    largest inner product into the smallest distance. Every table hashes by ``functions``
    normal projections into cells ``width`` wide. A query visits, in every table, the
    ``probes`` cells around its own that are likeliest to hold a neighbour by their distance
    from its projections. Rows and queries of a bucket meet in tiles of bounded size, so a hot
    bucket is spread over tasks; each tile returns its best ``k`` per query. Every row is
    indexed; nothing is fitted but the length of the longest vector.

    Vectors that are null, empty, zero or hold a null or non-finite component, and rows without
    an id, take no part. Vectors of different length never meet. Equal vectors are ranked by id;
    a repeated id counts once, with the smallest of its vectors. A query whose buckets hold fewer
    different rows than it can have neighbours is compared with all rows instead, in blocks. An empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(rows.sparkSession, "nearest")
    given = rows.select(F.col(row_id).cast("long").alias("id"), F.col(vector).alias("v"), queries.alias("ask"))
    good = given.where(F.col("id").isNotNull() & usable(F.col("v")))
    good = good.groupBy("id").agg(F.min("v").alias("v"), F.max("ask").alias("ask")).withColumn("dim", F.size("v"))
    good = scratch.keep(good)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    norm = float(np.sqrt(good.agg(F.max(square)).first()[0] or 1.0))
    kind = good.schema["v"].dataType.simpleString()
    kinds = f"id long, v {kind}, dim int, keys array<long>, tabled array<int>"

    def buckets(part: DataFrame, query: bool) -> DataFrame:
        hashed = part.select("id", "v", "dim").mapInArrow(
            _hasher(tables, functions, probes, width, norm, seed, query), kinds
        )
        zipped = hashed.select("id", "v", "dim", F.explode(F.arrays_zip("tabled", "keys")).alias("at"))
        return zipped.select("id", "v", "dim", F.col("at.tabled").alias("tab"), F.col("at.keys").alias("key"))

    bucket = ["dim", "tab", "key"]
    stored, asked = buckets(good, False), scratch.keep(buckets(good.where("ask"), True))
    counts = stored.groupBy(*bucket).agg(F.count("*").alias("n"))
    wanted = asked.groupBy(*bucket).agg(F.count("*").alias("m"))
    sizes = counts.join(wanted, bucket).select(
        *bucket, F.ceil(F.col("n") / BLOCK).cast("int").alias("nr"), F.ceil(F.col("m") / BLOCK).cast("int").alias("nq")
    )
    sizes = scratch.keep(sizes)
    left = stored.join(sizes, bucket).withColumn("rb", F.expr("cast(pmod(xxhash64(id), nr) as int)"))
    left = left.withColumn("qb", F.explode(F.expr("sequence(0, nq - 1)"))).withColumn("ask", F.lit(False))
    right = asked.join(sizes, bucket).withColumn("qb", F.expr("cast(pmod(xxhash64(id), nq) as int)"))
    right = right.withColumn("rb", F.explode(F.expr("sequence(0, nr - 1)"))).withColumn("ask", F.lit(True))
    found = scratch.keep(_ranked(left, right, k))
    # queries that found fewer rows than there are (up to k): against all rows of their length
    there = good.groupBy("dim").agg((F.least(F.count("*") - 1, F.lit(k))).alias("need"), F.count("*").alias("n"))
    met = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("met"))
    short = good.where("ask").join(there, "dim").join(met, "id", "left").where("coalesce(met, 0) < need")
    short = scratch.keep(short.select("id", "v", "dim", "n"))
    blocks = short.groupBy("dim").agg(F.first("n").alias("n"), F.count("*").alias("m")).select(
        "dim", F.lit(-1).alias("tab"), F.lit(0).cast("long").alias("key"),
        F.ceil(F.col("n") / BLOCK).cast("int").alias("nr"), F.ceil(F.col("m") / BLOCK).cast("int").alias("nq"),
    )
    if not short.isEmpty():
        left = good.select("id", "v", "dim").join(blocks, "dim")
        left = left.withColumn("rb", F.expr("cast(pmod(xxhash64(id), nr) as int)"))
        left = left.withColumn("qb", F.explode(F.expr("sequence(0, nq - 1)"))).withColumn("ask", F.lit(False))
        right = short.drop("n").join(blocks, "dim").withColumn("qb", F.expr("cast(pmod(xxhash64(id), nq) as int)"))
        right = right.withColumn("rb", F.explode(F.expr("sequence(0, nr - 1)"))).withColumn("ask", F.lit(True))
        again = short.select(F.col("id").alias("query_id"))
        found = found.join(again, "query_id", "left_anti").unionByName(_ranked(left, right, k))
    return found.select("query_id", "rank", F.col("id").alias(row_id), "score")


def _ranked(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of the rows that each query meets in its tiles."""
    keys = ["dim", "tab", "key", "rb", "qb"]
    columns = ["id", "v", "ask", *keys]
    met = rows.select(*columns).union(queries.select(*columns)).repartition(*keys).sortWithinPartitions(*keys)
    best = met.mapInArrow(_nearest(k), "query_id long, id long, score double")
    best = best.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
