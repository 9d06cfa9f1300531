"""Near-duplicate embeddings: sign hashing, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.durable import Scratch
from flowlens.llm.common import boundaries, complete_groups, matrix, usable
from flowlens.llm.components import connected_components

BLOCK = 1024


def plan_tables(per_group: int, threshold: float, missed: float, target: int = 64) -> tuple[int, int]:
    """Bits of a code and number of tables.

    Bits grow with the rows of the largest group so that buckets of unrelated vectors keep to
    about ``target``; tables follow so that a pair right at the threshold is missed with a
    chance of at most ``missed``.
    """
    bits = min(30, max(4, math.ceil(math.log2(max(2, per_group) / target))))
    alike = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(missed) / math.log(1 - alike)))


def _coder(bits: int, tables: int, seed: int):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(bits)).astype(np.int64)
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes):
                rows = batch.filter(pa.array(sizes == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).normal(size=(int(dim), tables * bits))
                signs = matrix(rows.column("v"), np.float64) @ planes[dim] > 0
                codes = (signs.reshape(rows.num_rows, tables, bits) @ weights).astype(np.int32)
                listed = pa.ListArray.from_arrays(
                    np.arange(0, codes.size + 1, tables, dtype=np.int32), pa.array(codes.ravel())
                )
                yield pa.RecordBatch.from_arrays([*rows.columns, listed], [*rows.schema.names, "codes"])

    return code


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the first row that it reaches."""
    label = np.arange(len(linked))
    while True:
        best = np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label))
        following = np.minimum(label, best)
        following = following[following]
        if (following == label).all():
            return label
        label = following


def _pairs(threshold: float):
    keys = ["label", "dim", "pos", "code", "tile_a", "tile_b"]

    def one(rows: pa.Table, out: list) -> None:
        ids, copies = rows.column("rep").to_numpy(), rows.column("copies").to_numpy()
        block, table = rows.column("block").to_numpy(), rows.column("pos")[0].as_py()
        vectors = matrix(rows.column("v"), np.float64)
        vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        vectors /= np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        linked = vectors @ vectors.T >= threshold
        np.fill_diagonal(linked, False)
        first, second = rows.column("tile_a")[0].as_py(), rows.column("tile_b")[0].as_py()
        if first != second:  # pairs within a block belong to the block's own tile
            linked &= block[:, None] != block[None, :]
        left, right = np.nonzero(linked)
        if not len(left):
            return
        # a pair counts in the first table that brings it together
        fresh = np.ones(len(left), bool)
        codes = matrix(rows.column("codes"), np.int32)
        for earlier in range(table):
            at = np.nonzero(fresh)[0]
            if not len(at):
                break
            fresh[at] = codes[left[at], earlier] != codes[right[at], earlier]
        links = np.bincount(left[fresh], weights=copies[right[fresh]].astype(float), minlength=len(ids))
        root = _forest(linked)
        keep = (links > 0) | (root != np.arange(len(ids)))
        out.append((ids[keep], links[keep].astype(np.int64), ids[root[keep]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in complete_groups(batches, keys):
            cuts = [*boundaries(rows, keys), rows.num_rows]
            out: list = []
            for begin, end in zip(cuts, cuts[1:]):
                if end - begin > 1:
                    one(rows.slice(begin, end - begin), out)
            if out:
                columns = [pa.array(np.concatenate(x)) for x in zip(*out)]
                yield pa.RecordBatch.from_arrays(columns, ["rep", "links", "root"])

    return run


def near_duplicate_vectors(
    rows: DataFrame,
    row_id: str = "vec_id",
    vector: str = "embedding",
    group: str = "label",
    threshold: float = 0.93,
    missed: float = 1e-4,
    seed: int = 7,
) -> DataFrame:
    """Links of cosine ``threshold`` and up between vectors of one group, and their components.

    Returns, per row, ``row_id``, ``n_links`` (other vectors linked directly), ``component_id``
    (smallest id reachable) and ``kept`` (the row is its component's smallest id).

    Equal vectors become one class, counted by its copies. Each class gets a sign code per
    table; classes of one group and code meet in a bucket, larger buckets are split into
    blocks, and each pair of blocks is a tile of its own, so that no task holds a whole hot
    bucket. Cosines are exact, in double precision. A pair is counted in the first table that
    brings it together, and tiles return counts and a spanning forest, never pairs. A pair at
    the threshold is missed with a chance of at most ``missed``, closer pairs with less.

    Vectors that are null, empty, zero or hold a null or non-finite component, and rows without
    a group, link with nothing: no links, their own component. Rows with equal vectors link with
    each other. Vectors of different length never link. An empty table gives an empty result;
    other columns are not looked at.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    given = rows.select(F.col(row_id).cast("long").alias("id"), F.col(vector).alias("v"), F.col(group).alias("label"))
    good = given.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    good = good.withColumn("dim", F.size("v"))
    classes = scratch.keep(good.groupBy("label", "dim", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan_tables(largest, threshold, missed)
    kinds = f"{classes.schema.simpleString()[7:-1].replace(':', ' ').replace(',', ', ')}, codes array<int>"
    coded = scratch.keep(classes.mapInArrow(_coder(bits, tables, seed), kinds))
    bucket = ["label", "dim", "pos", "code"]
    spots = coded.select("label", "dim", "rep", "copies", "v", "codes", F.posexplode("codes").alias("pos", "code"))
    sizes = coded.select("label", "dim", F.posexplode("codes").alias("pos", "code")).groupBy(*bucket).count()
    sizes = sizes.where("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    placed = spots.join(sizes, bucket).withColumn("block", F.expr("pmod(xxhash64(rep), blocks)").cast("int"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    placed = placed.withColumn("tile_a", F.least("block", "other")).withColumn("tile_b", F.greatest("block", "other"))
    keys = [*bucket, "tile_a", "tile_b"]
    placed = placed.select("rep", "copies", "v", "codes", "block", *keys).repartition(*keys).sortWithinPartitions(*keys)
    found = scratch.keep(placed.mapInArrow(_pairs(threshold), "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("rep", "root"), "rep", "root")
    known = classes.join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("label"), "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    known = known.withColumn("dim", F.size("v"))
    told = good.join(known, ["label", "dim", "v"]).select("id", "n_links", "component_id")
    bad = given.where(~(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))))
    out = told.union(bad.select("id", F.lit(0).cast("long"), F.col("id")))
    return out.select(
        F.col("id").alias(row_id),
        "n_links",
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
