"""Literal cases of names, parsers, files, sources and the ledger."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyfield.functions import text as T
from tallyfield.operators import features, resolve
from tallyfield.sources import files
from tallyfield.streaming import ledger


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize(("raw", "want"), [("São Paulo FC", "sao paulo"), ("Manchester Utd", "manchester united"), ("Atlético-MG", "atletico mineiro"), ("PSG", "paris saint germain"), ("", None), (None, None), ("FC", "fc")])
def test_names(spark, raw, want):
    assert one(spark, n=T.normalise_name(F.lit(raw).cast("string")))["n"] == want


def test_parsers(spark):
    r = one(spark, flags=T.parse_flags(F.lit("[a, 'b'; c|a]")), none=T.parse_flags(F.lit(None).cast("string")), score=T.parse_score(F.lit("2-1 (1-0)")), bad=T.parse_score(F.lit("x")), price=T.parse_number(F.lit("1,90")), fraction=T.parse_number(F.lit("5/2")), warning=T.add_warning(F.lit("x;y"), "y"))
    assert r["flags"] == ["A", "B", "C"] and r["none"] == []
    assert tuple(r["score"]) == (2, 1, 1, 0) and tuple(r["bad"]) == (None,) * 4
    assert (r["price"], r["fraction"], r["warning"]) == (1.9, 3.5, "x;y")


def test_past_means_never_see_their_own_row(spark):
    rows = [("a", dt.date(2024, 1, d), g) for d, g in ((1, 2), (8, 3), (15, 1))]
    d = features.past_features(spark.createDataFrame(rows, "team string, day date, goals int"), ["team"], ["day"], {"avg3": ("mean", "goals", 3)})
    assert [r["avg3"] for r in d.orderBy("day").collect()] == [None, 2.0, 2.5]


def test_two_sources_become_one_row(spark):
    rows = [("k", "p1", "1", None), ("k", "p2", "2", "x"), ("j", "p2", "3", " ")]
    got = {r["key"]: r for r in resolve.merge_sources(spark.createDataFrame(rows, "key string, source string, id string, venue string"), "key", "source", {"p1": 0, "p2": 1}, ["id", "venue"], ["id"]).collect()}
    assert (got["k"]["id"], got["k"]["venue"], got["k"]["merged_rows"], got["k"]["conflicts"]) == ("1", "x", 2, 1)
    assert got["j"]["venue"] is None


def test_files_of_several_formats(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"Match ID": "1", "odds-goals": 1.9}\n')
    (tmp_path / "b.json").write_text(json.dumps({"matches": [{"match_id": "2"}, {"match_id": "3"}]}))
    (tmp_path / "c.csv").write_text("Match Id,odds goals\n4,2.5\n")
    (tmp_path / "d.txt").write_text("x")
    (tmp_path / "e.csv").write_text("")
    rows, failed = files.union_files(spark, [str(tmp_path / n) for n in ("a.jsonl", "b.json", "c.csv", "d.txt")], {"odds_goals": "goals_odd"})
    got = {r["match_id"]: (r["goals_odd"], r["source_file"]) for r in rows.collect()}
    assert got == {"1": ("1.9", "a.jsonl"), "2": (None, "b.json"), "3": (None, "b.json"), "4": ("2.5", "c.csv")}
    assert len(failed) == 1
    assert {r["path"].rsplit("/", 1)[-1] for r in files.manifest(spark, str(tmp_path), ["csv", "json"]).collect()} == {"b.json", "c.csv"}


def test_fallback_chain_and_snapshots(spark, tmp_path):
    d = spark.createDataFrame([(1, "x"), (2, None)], "id int, s string")
    files.write_table(d, f"{tmp_path}/t.parquet", csv_twin=True)
    assert files.read_first(spark, f"{tmp_path}/t", ["id", "absent"]).columns == ["id"]
    d.write.csv(f"{tmp_path}/u.csv", header=True)
    assert files.read_first(spark, f"{tmp_path}/u").count() == 2
    assert files.read_first(spark, f"{tmp_path}/v", required=False) is None
    with pytest.raises(FileNotFoundError):
        files.read_first(spark, f"{tmp_path}/v")
    files.write_snapshot(d, f"{tmp_path}/s", "a")
    files.write_snapshot(d.limit(1), f"{tmp_path}/s", "b")
    assert spark.read.parquet(f"{tmp_path}/s/latest").count() == 1
    assert {r["id"] for r in files.keep_last(d, spark.createDataFrame([(3, "z")], "id int, s string"), ["id"], 2).collect()} == {2, 3}


def test_captured_rows_are_filled_from_later_ones(spark):
    d = spark.createDataFrame([("a", 1, "", None), ("a", 2, "x", None), ("a", 3, "y", "z")], "id string, n int, p string, q string")
    assert tuple(files.merge_captured(d, "id", "n").first()) == ("a", "x", "z")


SIGNAL = "signal_id string, due date, odd double, stake double"


def test_ledger_settles_once(spark):
    due = dt.date(2026, 1, 2)
    signals = spark.createDataFrame([("s", due, 2.0, 1.0), ("s", due, 2.0, 1.0), ("t", due, 2.0, 1.0), ("u", due, 1.0, 1.0)], SIGNAL)
    won = spark.createDataFrame([("s", True), ("u", True)], "signal_id string, is_win boolean")
    day = lambda n: F.lit(dt.date(2026, 1, n))
    first = ledger.next_version(spark.createDataFrame([], ledger.LEDGER), signals, won, day(1))
    assert {(r["signal_id"], r["status"]) for r in first.collect()} == {("s", "PENDING"), ("t", "PENDING"), ("u", "PENDING")}
    second = {r["signal_id"]: r for r in ledger.next_version(first, signals, won, day(2)).collect()}
    assert (second["s"]["status"], second["s"]["profit"]) == ("SETTLED", 1.0)
    assert second["t"]["status"] == second["u"]["status"] == "PENDING"  # no outcome; a price that can't be
    third = ledger.next_version(spark.createDataFrame(list(second.values()), ledger.LEDGER), signals, won.filter("false"), day(3))
    assert {r["signal_id"]: r["settled_on"] for r in third.collect()}["s"] == due


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    won = spark.createDataFrame([("a", True), ("b", False)], "signal_id string, is_win boolean")
    folder, source = f"{tmp_path}/ledger", f"{tmp_path}/in"
    for name, n in (("a", 1), ("b", 2)):
        spark.createDataFrame([(name, dt.date(2026, 1, 1), 3.0, 1.0)], SIGNAL).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SIGNAL).parquet(source)
        got = ledger.run_stream(spark, stream, won, folder, "2026-02-01")
        assert got.count() == n
    assert {r["signal_id"]: r["profit"] for r in got.collect()} == {"a": 2.0, "b": -1.0}
    assert ledger.run_stream(spark, spark.readStream.schema(SIGNAL).parquet(source), won, folder, "2026-02-01").count() == 2


def test_a_share_counts_as_it_is_written(spark):
    rows = features.ordered_split(spark.range(90).withColumn("g", F.lit(1)), ["g"], ["id"], 0.7)
    assert rows.filter("part = 'train'").count() == 63  # 0.7 * 90 is 62.99999999999999
