from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyfield.llm import mixing
from tests.llm.tables import collected, documents
from tests.support import DATA, difference


def test_query_matches_sql(spark):
    sf = f"{DATA}/sf0.001"
    assert difference(mixing.op1_mix(spark, sf), mixing.OP1_SQL, sf) == ""


def test_shares_caps_and_edges(spark, tmp_path):
    rows = [(i, "a b c", "big") for i in range(90)] + [(100 + i, "x y", "small") for i in range(5)] + [(200, "q " * 30, None), (201, "", "small"), (202, None, "big"), (203, " z", "small")]
    sf = documents(spark, tmp_path, rows)
    assert difference(mixing.op1_mix(spark, sf), mixing.OP1_SQL, sf) == ""
    got = collected(mixing.op1_mix(spark, sf))
    assert len(got) == len(rows)
    assert got[202]["size"] == 0 and got[202]["taken"] == 0 and got[201]["taken"] == 0 and got[203]["size"] == 1
    assert all(r["taken"] <= 3 * r["size"] for r in got.values())
    assert got[200]["target"] == 90.0 and got[200]["taken"] == 90  # three times its source's size
    total = sum(r["size"] for r in got.values())
    assert abs(sum(r["taken"] for r in got.values()) - total) <= 30


def test_targets_reshare_the_excess(spark):
    sizes = spark.createDataFrame([("aa", 100), ("ab", 1), ("ac", 1000)], "source_key string, source_size long")
    got = {r["source_key"]: r["target"] for r in mixing.source_targets(sizes, (1.0, 2.0, 3.0), 3).collect()}
    assert got["ab"] == 3.0
    assert got["aa"] == pytest.approx(1098 / 4) and got["ac"] == pytest.approx(1098 * 3 / 4)


def test_repeated_rows_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b", "s", 5, "k"), (1, "a b", "s", 6, "k"), (None, "c", "s", 7, "k")], "doc_id long, text string, source string, size int, weight string")
    assert mixing.mix_sources(d).count() == 3
    assert mixing.mixed_documents(d).columns == d.columns


def test_empty_table(spark, tmp_path):
    assert mixing.op1_mix(spark, documents(spark, tmp_path, [])).count() == 0


def test_cut_is_found_in_ranges_of_any_size(spark):
    rows = [(i if i % 9 else 7, "w " * (i % 13), f"s{i % 4}") for i in range(400)]  # one id repeats
    queue = mixing.queue_times(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    whole = mixing.cut_point(queue, 3)
    assert whole is not None and all(mixing.cut_point(queue, 3, most) == whole for most in (1, 20, 10**6))


def test_mixed_documents_are_whole_rows(spark):
    rows = [(i // 2, "w " * (1 + i % 5), "ab"[i % 3 > 1], i) for i in range(60)] + [(None, "x y", None, 99), (3, None, "a", 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, times long")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = Counter(tuple(r) for r in out.collect())
    times = Counter({tuple(r["row"]): r["times"] for r in mixing.mix_sources(docs.withColumn("row", F.struct(*docs.columns)), keep=["row"]).collect() if r["times"]})
    assert got == times and sum(got.values()) > 0
