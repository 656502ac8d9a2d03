"""What is kept between runs, and optimal stakes."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import portfolio
from tallyfield.sources import incremental
from tallyfield.streaming import sync


def grid_best(values, correlation, most_each, most, parts=5):
    """The best of all stakes on a grid."""
    steps = np.linspace(0, most_each, parts + 1)
    return max(portfolio.growth(np.array(s), values, correlation) for s in itertools.product(steps, repeat=len(values)) if sum(s) <= most + 1e-12)


@pytest.mark.parametrize("seed", range(6))
def test_stakes_are_no_worse_than_a_grid(seed):
    rng = random.Random(seed)
    markets = [rng.choice(["goals", "btts", "corners", "x"]) for _ in range(5)]
    values, c = np.array([rng.choice([0.0, 0.01, 0.04, rng.random() / 5]) for _ in markets]), portfolio.correlation_matrix(markets)
    for most_each, most in ((0.05, 0.15), (1.0, 2.0), (0.4, 5.0)):
        s = portfolio.best_stakes(values, c, most_each, most)
        assert (s >= 0).all() and (s <= most_each + 1e-12).all() and s.sum() <= most + 1e-9
        assert portfolio.growth(s, values, c) >= grid_best(values, c, most_each, most) - 1e-9


def test_shares_of_days(spark):
    rng = random.Random(1)
    rows = [(i, f"d{i % 4}" if i else "lone", rng.choice(["goals", "btts", "shots", None]), rng.choice([None, 0.0, round(rng.random() / 10, 3)]) if i else 0.2) for i in range(200)]
    d = spark.createDataFrame(rows, "i long, day string, market string, share double")
    got = {r["i"]: r for r in portfolio.optimal_shares(d, "day", "i", "market", "share").collect()}
    assert len(got) == 200 and (got[0]["portfolio_share"], got[0]["method"]) == (0.05, "single_kelly")
    for day in ("d1", "d2"):
        own = [r for r in rows if r[1] == day]
        values, c = np.array([r[3] or 0.0 for r in own]), portfolio.correlation_matrix([r[2] or "" for r in own])
        stakes = np.array([got[r[0]]["portfolio_share"] for r in own])
        assert stakes.sum() <= 0.15 + 1e-9 and stakes.max() <= 0.05
        whole = portfolio.best_stakes(values, c, 0.05, 0.15)  # of all candidates at once
        fallback = np.minimum(values, 0.05) * min(1, 0.15 / max(np.minimum(values, 0.05).sum(), 1e-12))
        assert portfolio.growth(stakes, values, c) >= max(portfolio.growth(whole, values, c), portfolio.growth(fallback, values, c)) - 1e-6
    assert portfolio.optimal_shares(d.filter("false"), "day", "i", "market", "share").count() == 0


def test_upsert_twice_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = lambda r: spark.createDataFrame(r, "k int, part string, v string, at int")
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("k", "part", "v", "at").collect())
    incremental.upsert(path, rows([(1, "a", "old", 1), (2, "a", "keep", 1), (3, "b", "far", 1), (1, "a", "older", 0)]), ["k"], "part", ["at"])
    assert read() == [(1, "a", "old", 1), (2, "a", "keep", 1), (3, "b", "far", 1)]
    untouched = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "part=b").iterdir()}
    new = rows([(1, "a", "new", 1), (2, "a", "late", 0), (4, "c", "more", 5)])
    for _ in range(2):
        incremental.upsert(path, new, ["k"], "part", ["at"])
        assert read() == [(1, "a", "new", 1), (2, "a", "keep", 1), (3, "b", "far", 1), (4, "c", "more", 5)]
    assert untouched == {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "part=b").iterdir()}


def test_only_changed_files_are_read(spark, tmp_path):
    root, state = tmp_path / "in" / "deep", f"{tmp_path}/state"
    root.mkdir(parents=True)
    (root / "a.csv").write_text("i,s\n1,x\n2,y\n")
    (root / "b.csv").write_text("i,s\n3,z\n")
    (root / "empty.csv").write_text("")
    run = lambda: incremental.read_changed(spark, str(tmp_path / "in"), "csv", "i int, s string", state)
    rows, found, commit = run()
    assert sorted(r["i"] for r in rows.collect()) == [1, 2, 3] and {r["change"] for r in found.collect()} == {"new"}
    assert run()[0].count() == 3  # not committed: read again
    commit()
    assert run()[0].count() == 0
    (root / "b.csv").write_text("i,s\n3,z\n4,w\n")
    (root / "c.csv").write_text("i,s\n5,v\n")
    (root / "a.csv").unlink()
    rows, found, commit = run()
    assert sorted((r["i"], r["source_path"].rsplit("/", 1)[-1]) for r in rows.collect()) == [(3, "b.csv"), (4, "b.csv"), (5, "c.csv")]
    assert {r["path"].rsplit("/", 1)[-1]: r["change"] for r in found.collect()} == {"a.csv": "gone", "b.csv": "changed", "c.csv": "new"}
    commit()
    rows, found, _ = run()
    assert rows.count() == 0 and {r["change"] for r in found.collect()} == {"same"}
    sums = {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in incremental.checksums(incremental.listing(spark, str(tmp_path / "in"), "csv"), chunk=3).collect()}
    import hashlib

    assert sums == {n: hashlib.sha256((root / n).read_bytes()).hexdigest() for n in ("b.csv", "c.csv")}


def test_missing_root_has_no_files(spark, tmp_path):
    rows, found, commit = incremental.read_changed(spark, f"{tmp_path}/none", "csv", "i int", f"{tmp_path}/state")
    assert rows.count() == 0 and found.count() == 0


def attempts(seed, n=120):
    rng, start = random.Random(seed), dt.datetime(2024, 1, 1)
    return [(rng.choice("abcd") if i % 17 else None, start + dt.timedelta(minutes=i) if i % 23 else None, rng.choice([True, False, False, None]), rng.choice(["e1", "e2", None])) for i in range(n)]


def test_stream_of_attempts_equals_the_batch_across_restarts(spark, tmp_path):
    rows, folder, source = attempts(2), f"{tmp_path}/sync", f"{tmp_path}/in"
    frame = lambda r: spark.createDataFrame(r, sync.ATTEMPT)
    seen = []
    for a, b in ((0, 50), (50, 51), (51, 120)):
        frame(rows[a:b]).coalesce(1).write.mode("append").parquet(source)
        seen += rows[a:b]
        got = sync.run_stream(spark, spark.readStream.schema(sync.ATTEMPT).parquet(source), folder)  # a new query each time
        want = sync.after_attempts(frame(seen))
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    again = sync.run_stream(spark, spark.readStream.schema(sync.ATTEMPT).parquet(source), folder)
    assert sorted(map(tuple, again.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_states_by_hand(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [("a", t(1), False, "x"), ("a", t(2), False, "y"), ("b", t(1), False, "x"), ("b", t(3), True, None), ("c", t(1), True, None), ("c", t(2), False, "z"), ("c", t(3), None, None), (None, t(1), True, None)]
    state = sync.after_attempts(spark.createDataFrame(rows, sync.ATTEMPT))
    got = {r["key"]: (r["status"], r["attempts"], r["retries"], r["last_error"], r["retry_at"]) for r in state.collect()}
    assert got == {"a": ("failed", 2, 2, "y", t(12)), "b": ("processed", 2, 0, None, None), "c": ("failed", 3, 2, None, t(13))}
    assert [r["key"] for r in sync.to_retry(state, t(12)).collect()] == ["a"]
    assert sync.to_retry(state, t(59), most=2).count() == 0
    assert sync.after_attempts(state.sparkSession.createDataFrame([], sync.ATTEMPT)).count() == 0


def test_states_of_a_batch_are_made_once(spark, tmp_path, monkeypatch):
    calls, own = tmp_path / "calls", sync._advance
    calls.mkdir()
    place = str(calls)

    def told(key, batches, state):
        import tempfile

        tempfile.mkstemp(dir=place)
        yield from own(key, batches, state)

    monkeypatch.setattr(sync, "_advance", told)
    spark.createDataFrame(attempts(4), sync.ATTEMPT).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = sync.run_stream(spark, spark.readStream.schema(sync.ATTEMPT).parquet(f"{tmp_path}/in"), f"{tmp_path}/sync")
    assert got.count() == len(list(calls.iterdir())) == 4
