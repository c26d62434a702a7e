"""Centroid clustering: integer k-means whose distances and sums are JVM expressions, with the centroids as literals."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscript.llm.common import discard, table, written

#: Fixed values of the query: components, scale of a component, centroids, rounds, what a vector's hash begins with.
WIDTH, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, "3:"
#: Components are held within this, so that a squared distance always fits 64 bits (64 * (2 * 2^27)^2 = 2^62).
BOUND = 1 << 27

Centroids = list[list[int]]


def whole_vectors(vectors: DataFrame, vec: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vectors (vec_id, vec) to vec_id, v: those of exactly `width` finite components, each as floor(scale * x) within +-BOUND."""
    x = F.transform(F.col(vec), lambda e: e.cast("double"))
    usable = (F.size(vec) == width) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    kept = vectors.select("vec_id", F.when(usable, x).alias("x")).where("x is not null")
    held = lambda e: F.greatest(F.lit(float(-BOUND)), F.least(F.lit(float(BOUND)), F.floor(e * scale).cast("double")))
    return kept.select("vec_id", F.transform("x", lambda e: held(e).cast("long")).alias("v"))


def first_centroids(whole: DataFrame, k: int, seed: str = SEED) -> Centroids:
    """The k vectors with the smallest sha256 of seed and vec_id; of equal ids the smaller vector, and a null id last. k rows reach the driver."""
    digest = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    return [r.v for r in whole.select(digest.alias("digest"), "v").orderBy(F.asc_nulls_last("digest"), "v").limit(k).collect()]


def nearest(v: Column, centroids: Centroids) -> Column:
    """struct(distance, number) of the nearest of the literal centroids; the smaller number on ties."""

    def option(number: int, centroid: list[int]) -> Column:
        literal = F.expr(f"array({', '.join(f'{x}L' for x in centroid)})")
        squares = F.zip_with(v, literal, lambda a, b: (a - b) * (a - b))
        return F.struct(F.aggregate(squares, F.lit(0).cast("long"), lambda total, s: total + s).alias("distance"), F.lit(number).alias("number"))

    return F.array_min(F.array(*[option(i, c) for i, c in enumerate(centroids)]))


def moved(whole: DataFrame, centroids: Centroids, width: int) -> Centroids:
    """Each centroid as the floor of its vectors' mean, by one sum a component and cluster; an empty one stays. A row a cluster reaches the driver."""
    placed = whole.select(nearest(F.col("v"), centroids)["number"].alias("cluster"), "v")
    sums = placed.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(width)])
    after = {r.cluster: [r[f"s{i}"] // r.n for i in range(width)] for r in sums.collect()}
    return [after.get(i, c) for i, c in enumerate(centroids)]


def cluster(vectors: DataFrame, vec: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    vectors has vec_id and vec, an array of numbers; other columns are ignored. A null vector, one of another length, and one
    with a null, NaN or infinite component give no row. Components beyond +-BOUND / scale count as that. Repeated rows and
    null ids are vectors like others. With fewer than k vectors there are as many centroids as vectors; without any, no row.
    A sum of distances that doesn't fit 64 bits is null.

    The whole vectors are written once; a round reads them, and brings a row a cluster to the driver.
    """
    whole = written(whole_vectors(vectors, vec, width, scale), "whole")
    centroids = first_centroids(whole, k, seed)
    if not centroids:
        return whole.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        before, centroids = centroids, moved(whole, centroids, width)
        if centroids == before:  # further rounds change nothing
            break
    best = nearest(F.col("v"), centroids)
    placed = written(whole.select("vec_id", best.alias("best")).select("vec_id", F.col("best.number").alias("cluster"), F.col("best.distance").alias("distance")), "placed")
    discard(whole)
    sums = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s")).collect()}
    fits = lambda s: F.lit(s if s < 1 << 63 else None).cast("long")
    inertia = [fits(sums.get(i, 0)) for i in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    own = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    return placed.select("vec_id", "cluster", "distance", own(inertia).alias("cluster_inertia"), fits(sum(sums.values())).alias("inertia"), own([F.lit(d) for d in digests]).alias("centroid_sha256"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def round_sql(r: int) -> str:
    """CTEs that assign every component row to a centroid of round r, and that move the centroids."""
    return f"""
a{r} AS MATERIALIZED (SELECT row, arg_min(number, d * 8 + number)::INT AS cluster, min(d)::BIGINT AS distance FROM (
  SELECT e.row, c.number, sum((e.x - c.x) * (e.x - c.x))::BIGINT AS d FROM e JOIN c{r} c ON c.i = e.i GROUP BY e.row, c.number) GROUP BY row),
c{r + 1} AS MATERIALIZED (SELECT c.number, c.i, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
  SELECT cluster, i, (s - (s % n + n) % n) // n AS x FROM (SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{r} JOIN e USING (row) GROUP BY cluster, i)) m ON m.cluster = c.number AND m.i = c.i)"""


OP11_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}' || vec_id), embedding) AS row, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH}
), e AS MATERIALIZED (
  SELECT row, i, v[i] AS x FROM (SELECT row, v, unnest(range(1, {WIDTH + 1})) AS i FROM kept)
), c0 AS MATERIALIZED (SELECT row - 1 AS number, i, x FROM e WHERE row <= {CENTROIDS}),
{",".join(round_sql(r) for r in range(ROUNDS + 1))},
inertia AS (SELECT cluster, sum(distance)::BIGINT AS s FROM a{ROUNDS} GROUP BY cluster),
digest AS (SELECT number, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{ROUNDS} GROUP BY number)
SELECT vec_id, a.cluster, a.distance, s AS cluster_inertia, (SELECT sum(s) FROM inertia)::BIGINT AS inertia, h AS centroid_sha256
FROM kept JOIN a{ROUNDS} a USING (row) JOIN inertia n ON n.cluster = a.cluster JOIN digest g ON g.number = a.cluster
"""
