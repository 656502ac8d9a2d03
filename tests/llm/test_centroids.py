import hashlib

import pytest

from tallyfield.llm import centroids, queries
from tests.llm.tables import table
from tests.support import DATA, difference

VECTORS = "vec_id long, embedding array<float>, v string, cluster int"


def brute(rows, n=8, rounds=10):
    """Rows (vec_id, whole components) to rows of the result, by plain loops."""
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:n]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in rows]
        for i in range(len(centres)):
            own = [v for (_, v), k in zip(rows, of) if k == i]
            if own:
                centres[i] = [sum(x) // len(own) for x in zip(*own)]
    best = [nearest(v) for _, v in rows]
    per = {i: sum(d for d, k in best if k == i) for i in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((r[0], k, d, per[k], sum(per.values()), digest[k]) for r, (d, k) in zip(rows, best))


def result(df):
    return sorted((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def test_whole_table_matches_sql(spark):
    assert difference(queries.QUERIES["op11_centroids"](spark, f"{DATA}/sf0.001"), queries.ORACLE_SQL["op11_centroids"], f"{DATA}/sf0.001") == ""


def test_brute_force_with_odd_rows(spark, tmp_path):
    rows = [(i, [((i * 7919 + j * 104729) % 1000 - 500) / 256 + (i % 5) * 3 for j in range(64)]) for i in range(60)]
    rows += [rows[3], rows[3], (4, [0.0] * 64)]  # repeated rows, and an id with another vector
    whole = [(i, [int(1024 * x // 1) for x in v]) for i, v in rows]
    odd = [(100, None), (101, [1.0] * 63), (102, [1.0] * 65), (103, [None] + [1.0] * 63), (104, [float("nan")] * 64), (105, [float("-inf")] * 64), (106, [])]
    sf = table(spark, tmp_path, "embeddings", [(i, v, "x", 9) for i, v in rows + odd], VECTORS)  # extra columns with the operator's names
    got = queries.QUERIES["op11_centroids"](spark, sf)
    assert result(got) == brute(whole)


def test_fewer_rows_than_centroids_and_a_null_id(spark, tmp_path):
    sf = table(spark, tmp_path, "embeddings", [(1, [1.0] * 64, "", 0), (None, [2.0] * 64, "", 0), (2, [1.0] * 64, "", 0)], VECTORS)
    rows = {r["vec_id"]: r for r in queries.QUERIES["op11_centroids"](spark, sf).collect()}
    assert len(rows) == 3 and rows[None]["distance"] == 0 and rows[1]["cluster"] == rows[2]["cluster"]  # equal centroids: the smaller number takes both


def test_empty_table(spark, tmp_path):
    got = queries.QUERIES["op11_centroids"](spark, table(spark, tmp_path, "embeddings", [], VECTORS))
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("sums,n", [([-7, 7], 2), ([-1, 0], 3)])
def test_means_are_floored(spark, sums, n):
    v = spark.createDataFrame([(i, [s if i == 0 else 0 for s in sums]) for i in range(n)], "vec_id long, v array<long>")
    assert centroids.next_centroids(v, [[0, 0]]) == [[s // n for s in sums]]
