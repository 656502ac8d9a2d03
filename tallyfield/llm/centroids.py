"""Centroid clustering of whole-number vectors in column expressions.

A round is one pass over a written table: ``zip_with`` and ``aggregate`` give
the squared distance to each centroid, which stands in the plan as a literal
array, ``array_min`` of (distance, number) chooses, and one grouped
aggregation of a sum a component makes the next centroids. Sums are combined
before the shuffle, so a cluster with most rows is no hot group; what comes to
the driver is a row a centroid.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.session import materialise

CLUSTERS, ROUNDS, SCALE, WIDTH = 8, 10, 1024, 64


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """vec_id and v, floor(scale * component) as longs, of the vectors with exactly ``width`` components, all finite.

    Null vectors and those with null or non-finite components are out. A row
    with a null id stays. Repeated rows stay, each for itself; other columns go.
    """
    c = F.col(vector_col)
    fine = (F.size(c) == width) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.coalesce(c.isNotNull() & fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(c, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))


def first_centroids(vectors: DataFrame, n: int = CLUSTERS, seed: str = "3") -> list[list[int]]:
    """The ``n`` vectors (all, if fewer) of the smallest SHA-256 of ``<seed>:<vec_id>``, in its order.

    Rows of a repeated id are ordered by their components; those with a null id come last.
    """
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["v"]) for r in vectors.orderBy(order.asc_nulls_last(), "v").limit(n).collect()]


def nearest(v: str, centroids: list[list[int]]) -> Column:
    """A struct of distance (squared) and cluster: the nearest centroid, of equally near ones that of the smaller number.

    As one text, because a literal a component would cost a call to the JVM each.
    """

    def distance(c: list[int]) -> str:
        return f"aggregate(zip_with({v}, array({', '.join(f'{x}L' for x in c)}), (a, b) -> (a - b) * (a - b)), 0L, (s, x) -> s + x)"

    return F.expr(f"array_min(array({', '.join(f'struct({distance(c)} AS distance, {i} AS cluster)' for i, c in enumerate(centroids))}))")


def next_centroids(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The floors of the means, component by component, of each centroid's vectors; one without vectors stays."""
    width = len(centroids[0])
    sums = [F.expr(f"sum(v[{i}]) AS s{i}") for i in range(width)]
    rows = vectors.select(nearest("v", centroids)["cluster"].alias("cluster"), "v").groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect()  # a row a centroid
    after = list(centroids)
    for r in rows:
        after[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return after


def cluster(vectors: DataFrame, n: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "3") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for each row of ``whole_vectors``.

    Exact for components below 2^27 (2^17 times the scale), where no sum
    leaves 64 bits. Fewer rows than ``n`` give as many centroids, no rows an
    empty table. Equal centroids share nothing: the smaller number takes all.
    A round that moves no centroid is the last one needed.
    """
    vectors = materialise(vectors, "centroid-vectors")
    centroids = first_centroids(vectors, n, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return vectors.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        after = next_centroids(vectors, centroids)
        if after == centroids:
            break
        centroids = after
    best = vectors.select("vec_id", nearest("v", centroids).alias("best")).select("vec_id", F.col("best.cluster").alias("cluster"), F.col("best.distance").alias("distance"))
    best = materialise(best, "centroid-nearest")
    inertia = {r["cluster"]: r["inertia"] for r in best.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # a row a centroid
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    at = F.col("cluster")
    return best.select(
        "vec_id",
        "cluster",
        "distance",
        F.get(F.array(*[F.lit(inertia.get(i, 0)).cast("long") for i in range(len(centroids))]), at).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        F.get(F.array(*map(F.lit, names)), at).alias("centroid_sha256"),
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def _sql() -> str:
    """The rounds one after the other, as SQL has no loop over whole tables."""
    distance = "CAST(list_sum(list_transform(range(1, 65), lambda i: (f.v[i] - c.v[i]) * (f.v[i] - c.v[i]))) AS BIGINT)"
    parts = [
        """fine AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS INTEGER) AS cluster, v
  FROM (SELECT sha256('3:' || vec_id) AS h, v FROM fine ORDER BY h NULLS LAST, v LIMIT 8))""",
    ]
    for k in range(11):
        parts.append(f"a{k} AS MATERIALIZED (SELECT f.id, min(struct_pack(d := {distance}, c := c.cluster)) AS best FROM fine f CROSS JOIN c{k} c GROUP BY f.id)")
        if k < 10:
            parts.append(f"""m{k} AS (SELECT a.best.c AS cluster, i, sum(f.v[i]) AS s, count(*) AS n FROM a{k} a JOIN fine f USING (id), range(1, 65) t(i) GROUP BY ALL)""")
            parts.append(f"""c{k + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN
  (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM m{k} GROUP BY cluster) m USING (cluster))""")
    return f"""WITH {",".join(parts)}
SELECT f.vec_id, a.best.c AS cluster, a.best.d AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a10 a JOIN fine f USING (id) JOIN c10 c ON c.cluster = a.best.c"""


OP11_SQL = _sql()
