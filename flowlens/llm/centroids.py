"""Clustering of vectors around centroids, in integers and in Spark's own expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components below this size keep squared distances of a vector within a long.
NARROW = 1 << 27
#: Larger ones are held in decimals; none goes beyond this bound.
WIDE = 1 << 57
LONGEST = (1 << 63) - 1


def integer_vectors(vectors: DataFrame, dims: int, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """Columns ``id`` and ``v``: the vectors of ``dims`` finite components, each as floor(scale * x).

    Components beyond 2^57 after scaling are held at that bound.
    """
    vector = F.col(vector_column)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    floor = F.transform(
        vector,
        lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(WIDE))), F.lit(float(-WIDE)))),
    )
    return vectors.where((F.size(vector) == dims) & F.coalesce(finite, F.lit(False))).select(
        F.col(id_column).alias("id"), floor.alias("v")
    )


def _literal(centroid: Sequence[int], kind: str) -> Column:
    numbers = ", ".join(f"'{x}'" for x in centroid)
    return F.expr(f"CAST(array({numbers}) AS array<{kind}>)")  # folded into one literal


def nearest(vector: Column, centroids: Sequence[Sequence[int]], wide: bool) -> Column:
    """The least (squared distance, cluster) of a vector, as a struct; ties go to the smaller number."""
    kind, total = ("decimal(19,0)", "decimal(38,0)") if wide else ("bigint", "bigint")

    def distance(centroid: Sequence[int]) -> Column:
        squares = F.zip_with(vector, _literal(centroid, kind), lambda x, c: (x - c) * (x - c))
        return F.aggregate(squares, F.lit(0).cast(total), lambda sum_, square: (sum_ + square).cast(total))

    return F.array_min(
        F.array(*[
            F.struct(distance(c).alias("distance"), F.lit(number).alias("cluster"))
            for number, c in enumerate(centroids)
        ])
    )


def cluster_vectors(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    seed: int = 3,
    dims: int = 64,
    scale: int = 1024,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """Cluster the vectors of exactly ``dims`` finite components around ``k`` centroids.

    Returns the vectors (id, cluster, distance, cluster_inertia, inertia, centroid_sha256) and
    the final centroids. Each component is floor(scale * x); the first centroids are the ``k``
    vectors of smallest sha256 of ``<seed>:<id>``. A round assigns every vector to its nearest
    centroid and then sets every centroid that has vectors to floor(sum / count), componentwise.
    One scan of the table makes a round: distances to literal centroids, then partial sums per
    cluster, so ``k`` rows of sums are shuffled per task and ``k`` rows reach the driver. Nothing
    is cached, so a lost executor costs its tasks of the running round only.

    Vectors that are null, of another length or hold null or non-finite components are left out.
    Repeated rows are vectors of their own. With equal hashes the smaller vector comes first, a
    null id comes last. Fewer than ``k`` vectors make fewer centroids; without vectors there are
    no rows. Components of 2^27 and above after scaling are summed in decimals; a distance or
    inertia that no long can hold is null.
    """
    table = integer_vectors(vectors, dims, scale, id_column, vector_column)
    size = table.agg(
        F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("largest"), F.count("*").alias("n")
    ).first()
    # the sums of a column must fit as well
    wide = bool(size["n"]) and (size["largest"] >= NARROW or size["largest"] * size["n"] > LONGEST)
    if wide:
        table = table.select("id", F.transform("v", lambda x: x.cast("decimal(19,0)")).alias("v"))
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    starts = table.select(first.alias("hash"), "v").orderBy(F.asc_nulls_last("hash"), "v").limit(k).collect()
    centroids = [tuple(int(x) for x in row["v"]) for row in starts]
    if not centroids:
        empty = table.select(
            F.col("id").alias(id_column), F.lit(0).alias("cluster"),
            *[F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
            F.lit("").alias("centroid_sha256"),
        )
        return empty.where(F.lit(False)), []
    column = (lambda i: F.col("v")[i].cast("decimal(38,0)")) if wide else (lambda i: F.col("v")[i])
    for _ in range(rounds):
        sums = (
            table.select(nearest(F.col("v"), centroids, wide)["cluster"].alias("cluster"), "v")
            .groupBy("cluster")
            .agg(F.count("*").alias("n"), *[F.sum(column(i)).alias(f"s{i}") for i in range(dims)])
            .collect()
        )
        for row in sums:
            centroids[row["cluster"]] = tuple(int(row[f"s{i}"]) // row["n"] for i in range(dims))
    assigned = table.select("id", nearest(F.col("v"), centroids, wide).alias("near"))
    within = {
        row["cluster"]: int(row["sum"])
        for row in assigned.groupBy(F.col("near.cluster").alias("cluster"))
        .agg(F.sum(F.col("near.distance").cast("decimal(38,0)")).alias("sum"))
        .collect()
    }
    spread = F.array(*[_long(within.get(number, 0)) for number in range(len(centroids))])
    digests = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids])
    distance = F.col("near.distance")
    result = assigned.select(
        F.col("id").alias(id_column),
        F.col("near.cluster").alias("cluster"),
        (F.when(distance <= F.lit(str(LONGEST)).cast("decimal(19,0)"), distance.cast("bigint")) if wide else distance)
        .alias("distance"),
        spread[F.col("near.cluster")].alias("cluster_inertia"),
        _long(sum(within.values())).alias("inertia"),
        digests[F.col("near.cluster")].alias("centroid_sha256"),
    )
    return result, centroids


def _long(value: int) -> Column:
    return F.lit(value if value <= LONGEST else None).cast("bigint")


def clustering_sql(k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024) -> str:
    """The same clustering of ``embeddings`` in DuckDB's SQL, a pair of expressions per round."""
    parts = [
        f"cells AS MATERIALIZED (SELECT r, vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM "
        f"(SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {dims}) AS e, "
        f"range(1, {dims + 1}) AS t(i))",
        f"e AS MATERIALIZED (SELECT r, vec_id, i, CAST(floor({scale} * x) AS BIGINT) AS v FROM cells WHERE r IN "
        "(SELECT r FROM cells GROUP BY r HAVING bool_and(x IS NOT NULL AND isfinite(x))))",
        f"starts AS (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c "
        f"FROM (SELECT DISTINCT r, vec_id FROM e) QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, i, v FROM e JOIN starts USING (r))",
    ]
    for n in range(rounds + 1):
        parts.append(
            f"a{n} AS MATERIALIZED (SELECT r, c, d FROM (SELECT e.r, m.c, sum((e.v - m.v) * (e.v - m.v)) AS d "
            f"FROM e JOIN c{n} AS m ON e.i = m.i GROUP BY e.r, m.c) "
            "QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"
        )
        if n < rounds:
            parts.append(
                f"c{n + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce((s - ((s % n) + n) % n) // n, o.v) AS v "
                f"FROM c{n} AS o LEFT JOIN (SELECT a.c, e.i, CAST(sum(e.v) AS BIGINT) AS s, count(*) AS n "
                f"FROM a{n} AS a JOIN e USING (r) GROUP BY a.c, e.i) AS w ON o.c = w.c AND o.i = w.i)"
            )
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, "
        "CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, "
        f"centroid_sha256 FROM a{rounds} JOIN (SELECT DISTINCT r, vec_id FROM e) USING (r) JOIN "
        f"(SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c) "
        "USING (c)"
    )
