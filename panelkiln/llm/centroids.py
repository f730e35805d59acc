"""Centroid clustering of integer vectors, in Spark's own expressions.

Vectors become integers, floor(1024 x) for each component x. The first centroids are the K vectors whose hashed ids are
smallest. Each round is one pass: `zip_with` and `aggregate` give the squared distance to every centroid, a literal
array in the plan; `array_min` over (distance, number) structs chooses the nearest, the smaller number of equals; sums
by cluster, one column for each component, replace the centroids by the exact floor of their means. What reaches the driver in a round is a row for
each centroid. Nothing is dealt out but these sums, which every task adds up before: a vector that makes up a third of
all rows costs no more than others.

Kept are vectors with exactly `size` components, none null, NaN or infinite; others have no row in the result. Equal
hashed ids (repeated rows, ids that are null, which come last) follow the order of their vectors. With fewer than K kept vectors
there are as many centroids; an empty table has no rows. Integers that don't fit 64 bits raise Spark's overflow error.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkiln.llm.sparkops import table

K, ROUNDS, SIZE, SCALE, SEED = 8, 10, 64, 1024, 3


def integer_vectors(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id and v (array of long) of the vectors that are kept."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.size("embedding") == size).where(F.coalesce(finite, F.lit(False)))
    return kept.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of `seed:vec_id`, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()
    return [list(r.v) for r in rows]


def _literal(centroid: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{x}L' if x >= 0 else f'-{-x}L' for x in centroid)})")


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vectors with near: struct of distance (squared, long) and cluster (int)."""
    def distance(centroid: list[int]) -> Column:
        squares = F.zip_with("v", _literal(centroid), lambda x, y: (x - y) * (x - y))
        return F.aggregate(squares, F.lit(0).cast("long"), lambda total, x: total + x)

    choices = F.array(*(F.struct(distance(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)))
    return vectors.withColumn("near", F.array_min(choices))


def updated(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The exact floors of the clusters' means; an empty cluster keeps its centroid."""
    size = len(centroids[0])
    sums = assigned(vectors, centroids).groupBy(F.col("near.cluster").alias("cluster")).agg(F.count("*").alias("n"), *(F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(size)))
    new = list(centroids)
    for r in sums.collect():
        new[r.cluster] = [r[f"s{i}"] // r.n for i in range(size)]
    return new


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept row of `vectors` (vec_id, embedding).

    The table is read once a round, two columns of it, and once more for the result; other columns are ignored. Stops early when no centroid moves.
    """
    rows = integer_vectors(vectors.select("vec_id", "embedding"), size)
    centroids = first_centroids(rows, k)
    for _ in range(rounds if centroids else 0):
        before, centroids = centroids, updated(rows, centroids)
        if before == centroids:
            break
    near = assigned(rows, centroids or [[0] * size]).select("vec_id", F.col("near.cluster").alias("cluster"), F.col("near.distance").alias("distance"))
    inertias = dict(near.groupBy("cluster").agg(F.sum("distance")).collect())  # a row for each centroid
    by_cluster = F.array(*(F.lit(inertias.get(i, 0)).cast("long") for i in range(max(1, len(centroids)))))
    digests = F.array(*(F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids or [[]]))
    return near.select("vec_id", "cluster", "distance", by_cluster[F.col("cluster")].alias("cluster_inertia"), F.lit(sum(inertias.values())).cast("long").alias("inertia"), digests[F.col("cluster")].alias("centroid_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all embeddings after ten rounds."""
    return clustered(table(spark, sf_dir, "embeddings"))
