import math

import numpy as np

from tallyfield.llm import pivots
from tests.llm.tables import table
from tests.support import DATA, difference

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors, queries, k):
    out = {}
    for q in queries:
        scored = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:k]
        out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


def test_query_matches_sql(spark):
    sf = f"{DATA}/sf0.001"
    assert difference(pivots.op2_topk(spark, sf), pivots.OP2_SQL, sf) == ""


def test_ties_nulls_and_few_candidates(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)], 0) for i in range(150)]
    rows += [(i, rows[3][1], 0) for i in range(160, 220)]  # equal vectors
    bad = [(300, None, 0), (320, [1.0, None], 0), (340, [math.nan, 1.0], 0), (360, [math.inf, 1.0], 0)]
    sf = table(spark, tmp_path, "embeddings", rows + bad, SCHEMA)
    whole = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v, _ in rows}
    want = brute(whole, [i for i in whole if i % 20 == 0], 20)
    got = {}
    for r in sorted(pivots.op2_topk(spark, sf).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got == want


def test_small_blocks_and_unequal_lengths(spark):
    v = spark.createDataFrame([(i, [i % 7 - 3, i % 5, 1][: 1 + i % 3]) for i in range(90)], "vec_id long, v array<long>")
    got = {}
    for r in pivots.top_k(v, v.filter("vec_id < 4"), k=5, n_pivots=4, block=8, query_block=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    vectors = {r["vec_id"]: list(r["v"]) for r in v.collect()}
    assert {q: sorted(x) for q, x in got.items()} == brute(vectors, range(4), 5)


def test_repeated_ids_and_extra_columns(spark, tmp_path):
    rows = [(20, [1.0, 0.0], 0), (20, [0.0, 1.0], 0), (1, [3.0, 0.0], 0), (1, [0.0, 2.0], 0), (2, [5.0, 5.0], 0)]
    sf = table(spark, tmp_path, "embeddings", [(*r, 7, "x") for r in rows], SCHEMA + ", score long, cell string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in pivots.op2_topk(spark, sf).collect())
    # The query of a repeated id is its smallest vector, (0, 1); each row of a repeated id is a candidate.
    assert got == [(20, 1, 2, 64 * 5 * 64), (20, 2, 1, 64 * 2 * 64), (20, 3, 1, 0)]


def test_thresholds_come_in_bound_order(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 400
    x = np.floor(centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16)) * 30).astype(np.int64)
    t = pivots.Table(np.arange(1500), x, int((x**2).sum(1).max()), 16, 8)
    q, ids = x[:200], np.arange(200)
    cq = t.coordinates(t.distances(q, True))
    _, evaluated = pivots.best_in_block(t, 20, ids, q, cq, np.full(200, -np.inf), np.arange(1500), x, t.places)
    scores = (q @ x.T).astype(float)
    scores[ids, ids] = -np.inf
    assert evaluated < 0.5 * scores.size
    assert (t.floors(ids, q, cq, 20) == np.sort(scores, axis=1)[:, -20]).all()


def test_no_usable_vector(spark, tmp_path):
    sf = table(spark, tmp_path, "embeddings", [(0, None, 1), (20, [math.nan], 1)], SCHEMA)
    assert pivots.op2_topk(spark, sf).count() == 0
