"""Clustering of vectors around centroids, in exact integer arithmetic.

Distances are built from Spark's own functions: ``zip_with`` and ``aggregate`` against the
centroids as literal arrays, ``array_min`` over (distance, number) pairs. New centroids are plain
column sums per cluster, so a task sends one row per cluster, however large the cluster is. What
reaches the driver is k centroids per round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SCALE, K, ROUNDS, SIZE, SEED = 256, 40, 5, 64, 2
#: Components beyond this (after scaling) could make a squared distance overflow a long.
LARGEST = 1 << 27


def whole_vectors(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """``vec_id`` and ``v``, the floored integer components, of the vectors that are whole."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    too_large = F.raise_error(F.lit(f"a vector component times {scale} is not under {LARGEST}")).cast("bigint")
    whole = F.transform(
        x,
        lambda e: F.when(
            F.abs(e.cast("double") * scale) < LARGEST, F.floor(e.cast("double") * float(scale)).cast("bigint")
        ).otherwise(too_large),
    )
    # A size or a test of NULL is NULL and drops the row.
    return vectors.where((F.size(x) == size) & finite).select(F.col("vec_id").cast("bigint"), whole.alias("v"))


def first_centroids(whole: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest hash of their id; equal hashes by the vector itself."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    rows = whole.select(F.sha2(named, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return [list(r["v"]) for r in rows]


def literal(vector: list[int]) -> Column:
    """The vector as one array literal, which the planner folds from a text (64 literals cost more)."""
    return F.split(F.lit(",".join(map(str, vector))), ",").cast("array<bigint>")


def nearest(v: Column, centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid; the smaller number wins a tie."""

    def distance(c: Column) -> Column:
        squares = F.zip_with(v, c, lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0).cast("bigint"), lambda s, d: s + d)

    literals = F.array(*[literal(c) for c in centroids])
    return F.array_min(
        F.transform(literals, lambda c, i: F.struct(distance(c).alias("distance"), i.alias("cluster")))
    )


def moved(whole: DataFrame, centroids: list[list[int]], size: int) -> list[list[int]]:
    """Each centroid replaced by the floored mean of its vectors; one without vectors stays."""
    assigned = whole.select("v", nearest(F.col("v"), centroids)["cluster"].alias("cluster"))
    sums = assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), *[F.expr(f"sum(v[{i}]) AS s{i}") for i in range(size)]
    )
    out = list(centroids)
    for r in sums.collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(size)]
    return out


def cluster(
    vectors: DataFrame, *, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED
) -> DataFrame:
    """Every whole vector with its cluster after ``rounds`` of moving the centroids.

    ``vectors`` has ``vec_id`` (integer) and ``embedding`` (array of numbers); other columns are
    ignored. Vectors with another number of components than ``size``, or with a null, NaN or
    infinite one, are left out, as is a null vector. Components become ``floor(scale * x)``;
    one of ``LARGEST`` or more in size stops the job, since its distance has no exact long.

    The centroids start as the ``k`` vectors (all, if there are fewer) with the smallest hash of
    ``seed:vec_id``; a null id is hashed as ``null``. Repeated rows are vectors of their own: if
    they start as equal centroids, the smaller number gets the vectors and the others stay empty.
    An empty table gives an empty result. ``k`` is a parameter with a bound by nature (literals
    of the plan); ``vectors`` may have any size, and nothing of it but ``k`` rows is collected.

    Columns: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid (array),
    centroid_sha256 (of its components, comma-joined).
    """
    spark = vectors.sparkSession
    whole = materialize(whole_vectors(vectors, size, scale), "vectors")
    centroids = first_centroids(whole, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(whole, centroids, size)
    best = nearest(F.col("v"), centroids or [[0] * size])
    placed = whole.select("vec_id", best.alias("best")).select("vec_id", "best.cluster", "best.distance")
    placed = materialize(placed, "clusters")
    sums = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(i, sums.get(i, 0), sum(sums.values()), c) for i, c in enumerate(centroids)]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    said = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    # k rows, which is the bound that lets them be sent to every task.
    joined = placed.join(F.broadcast(known.withColumn("centroid_sha256", F.sha2(said, 256))), "cluster")
    return joined.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"
    )
