import itertools
import zlib

import numpy as np

from tallyfield.llm import crf
from tests.llm.tables import collected, documents, table
from tests.support import DATA


def test_held_out_accuracy(spark):
    sf = f"{DATA}/sf0.01"
    got = collected(crf.op5_quality(spark, sf))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(r["predicted"], labels[i]) for i, r in got.items() if r["held_out"] and labels.get(i) is not None]
    assert sum(p == y for p, y in held) / len(held) >= 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_marginals_match_all_paths():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5):
        e, m = rng.normal(size=n), rng.normal(size=(2, 2))
        field = crf.Field(np.zeros(1), m, 0.0, 0.0)
        weight = {p: np.exp(sum(x * y for x, y in zip(p, e)) + sum(m[a, b] for a, b in zip(p, p[1:]))) for p in itertools.product((0, 1), repeat=n)}
        want = [sum(w for p, w in weight.items() if p[i]) / sum(weight.values()) for i in range(n)]
        got = field.marginals(e, np.array([n]))
        assert np.allclose(got, want) or np.allclose(1 - got, want)


def test_edges(spark, tmp_path):
    sf = documents(spark, tmp_path, [(1, None, "s"), (2, "", None), (3, "word " * 200_000, "s"), (3, "again", "s"), (4, "\n\n \n", "s")])
    table(spark, tmp_path, "labels", [(1, 1, 0), (2, None, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    rows = crf.op5_quality(spark, sf).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)


def test_no_labels_and_no_documents(spark, tmp_path):
    sf = documents(spark, tmp_path, [])
    table(spark, tmp_path, "labels", [], "doc_id long, quality int, toxic int")
    assert crf.op5_quality(spark, sf).count() == 0
