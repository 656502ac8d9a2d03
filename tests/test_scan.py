"""Running values over groups that span many blocks, against plain loops over one group after the other."""

import random

import duckdb
import pandas
import pytest
from pyspark.sql import functions as F

from tallyfield.functions import scan
from tallyfield.operators import trades

ORDER = ["day", "i"]


@pytest.fixture(scope="module")
def rows():
    """One group with most of the rows, small ones, and a null one."""
    rng, out = random.Random(3), []
    for i in range(700):
        g = "big" if i % 10 < 7 else rng.choice(["a", "b", None])
        won = rng.choice([True, False, None])
        out.append((i, g, f"2024-{i // 60 + 1:02d}-{i // 3 % 20 + 1:02d}", won, rng.choice([1.5, 2.0, 3.0]), rng.choice([-1.0, -1.0, 0.5, 1.0]) if i % 50 else None))
    return out


@pytest.fixture
def small(monkeypatch):
    """Blocks of a few rows, so that a group spans many."""
    monkeypatch.setattr(scan.numbered, "__defaults__", (7,))
    monkeypatch.setattr(scan.with_tail, "__defaults__", (7,))


def frame(spark, rows):
    d = spark.createDataFrame(rows, "i int, g string, day string, won boolean, odd double, profit double")
    return d.withColumn("day", F.to_date("day")).withColumn("stake", F.lit(1.0))


def groups(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def test_equity_and_peaks(spark, rows, small):
    d = trades.equity(frame(spark, rows), ["g"], ORDER, start=10.0, marks=["day"], latest=False)
    got = {r["i"]: r for r in d.collect()}
    assert len(got) == len(rows)
    for own in groups(rows).values():
        total, peak, at = 10.0, float("-inf"), None
        for place, r in enumerate(own, 1):
            before, total = total, total + (r[5] or 0.0)
            if total > peak:
                peak, at = total, (place, r[2])
            x = got[r[0]]
            assert (x["bankroll_before"], x["bankroll_after"], x["peak"], x["drawdown"]) == (before, total, peak, total - peak)
            assert (x["peak_place"], str(x["peak_day"])) == at


def test_compounding_ends_with_everything_lost(spark, rows, small):
    lost = [(*r[:3], False if r[0] == 400 else r[3], *r[4:]) for r in rows]
    d = frame(spark, lost).withColumn("share", F.when(F.col("i") == 400, 1.0).otherwise(0.1))
    got = {r["i"]: r for r in trades.kelly_stakes(d, ["g"], ORDER, F.col("won"), "odd", "share").collect()}
    for own in groups(lost).values():
        bank = 100.0
        for r in own:
            share = 1.0 if r[0] == 400 else 0.1
            after = bank * (1 if r[3] is None else 1 + share * (r[4] - 1) if r[3] else 1 - share)
            x = got[r[0]]
            assert (x["stake"], x["bankroll_after"], x["profit"]) == pytest.approx((bank * share, after, after - bank))
            bank = after
    assert any(r["bankroll_after"] == 0 for r in got.values())


def test_longest_runs(spark, rows, small):
    got = {r["g"]: (r["longest_wins"], r["longest_losses"]) for r in trades.longest_runs(frame(spark, rows), ["g"], ORDER, "won").collect()}
    want = {}
    for g, own in groups(rows).items():
        best, run, was = {True: 0, False: 0}, 0, None
        for r in own:
            run = run + 1 if r[3] == was else 1
            was = r[3]
            if was is not None:
                best[was] = max(best[was], run)
        want[g] = (best[True], best[False])
    assert got == want


def test_rolling_windows_reach_into_the_block_before(spark, rows, small):
    known = [(*r[:5], r[5] or 0.0) for r in rows]
    got = {(r["g"], r["window"]): (r["windows"], r["mean_roi"], r["min_roi"], r["max_roi"]) for r in trades.rolling_returns(frame(spark, known), ["g"], ORDER, (3, 7)).collect()}
    for g, own in groups(known).items():
        for n in (3, 7):
            means = [round(sum(r[5] for r in own[k : k + n]) / n, 9) for k in range(len(own) - n + 1)]
            assert got[g, n] == pytest.approx((len(means), round(sum(means) / len(means), 6), round(min(means), 6), round(max(means), 6)), abs=2e-6)


def test_exposure_budget(spark, rows, small):
    d = frame(spark, rows).withColumn("want", F.lit(0.25))
    got = {r["i"]: r["granted"] for r in trades.exposure_budget(d, ["g"], ORDER, "want", 20.1).collect()}
    for own in groups(rows).values():
        left = 20.1
        for r in own:
            assert got[r[0]] == pytest.approx(min(0.25, left), abs=1e-9)
            left -= min(0.25, left)


def episodes(own):
    """(peak place, its day, peak, day of the trough, depth, rows below, day of recovery), one row after the other."""
    total, peak, at, low, out = 0.0, float("-inf"), None, None, []
    for place, r in enumerate(own, 1):
        total += r[5] or 0.0
        if total >= peak:
            if low:
                out.append((*at, *low, r[2]))
            peak, at, low = total, (place, r[2], total), None
        else:
            low = (r[2], total - peak, 1) if low is None else (low[0], low[1], low[2] + 1) if total - peak >= low[1] else (r[2], total - peak, low[2] + 1)
    return out + ([(*at, *low, None)] if low else [])


def test_drawdown_episodes(spark, rows, small):
    d = trades.drawdown_episodes(frame(spark, rows), ["g"], ORDER, "day")
    day = lambda x: None if x is None else str(x)
    got = sorted((repr(r["g"]), r["peak_place"], day(r["peak_on"]), r["peak"], day(r["trough_on"]), r["depth"], r["trades_below"], repr(day(r["recovered_on"]))) for r in d.collect())
    want = sorted((repr(g), *e[:6], repr(e[6])) for g, own in groups(rows).items() for e in episodes(own))
    assert got == want and len(want) > 10


def test_drawdown_report(spark, rows, small):
    d = trades.drawdown_report(frame(spark, rows), ["g"], ORDER, "day", "won")
    got = {r["g"]: (r["max_drawdown"], str(r["worst_period_start"]), str(r["worst_period_end"]), r["recovery_after_worst_drawdown"]) for r in d.collect()}
    for g, own in groups(rows).items():
        curve, total = [], 0.0
        for r in own:
            total += r[5] or 0.0
            curve.append((total, r[2]))
        peaks = [max(c[0] for c in curve[: k + 1]) for k in range(len(curve))]
        falls = [c[0] - p for c, p in zip(curve, peaks)]
        low = falls.index(min(falls))
        start = next(c[1] for c in curve if c[0] == peaks[low])
        again = next((c[1] for c in curve if c[1] > curve[low][1] and c[0] >= peaks[low]), "not_recovered")
        assert got[g] == (falls[low], start, curve[low][1], again)


def test_one_hot_group_lies_in_many_tasks(spark, small):
    d = spark.range(1000).select(F.lit("one").alias("g"), F.col("id").alias("i"), F.lit(1.0).alias("profit"))
    numbered = scan.numbered(d, ["g"], ["i"])
    assert [(r["i"], r["_place"]) for r in numbered.orderBy("i").collect()] == [(i, i + 1) for i in range(1000)]
    assert numbered.groupBy("_block").count().agg(F.max("count")).first()[0] == 7
    windows = trades.equity(d, ["g"], ["i"])._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(g" in windows and all("_block" in w for w in windows.split("windowspecdefinition(")[1:])


def test_empty_table(spark):
    d = frame(spark, [])
    assert trades.equity(d, ["g"], ORDER).count() == 0 and trades.longest_runs(d, ["g"], ORDER, "won").count() == 0 and trades.drawdown_report(d, ["g"], ORDER, "day", "won").count() == 0


def test_a_bankroll_of_nothing_has_no_change_after_it(spark, small):
    rows = [(i, "g", p) for i, p in enumerate([0.1] * 3 + [-0.3] + [0.5, -0.25])]  # 0.1 three times and -0.3 leave 5.6e-17
    d = spark.createDataFrame(rows, "i int, g string, profit double").withColumn("stake", F.lit(1.0))
    row = trades.equity_report(d, ["g"], ["i"], start=0.0).collect()[0]
    changes = [1.0, 0.5, -1.0, -0.5]  # 0.1 to 0.2 to 0.3 to 0, nothing from 0 to 0.5, then to 0.25
    mean = sum(changes) / 4
    assert row["volatility"] == pytest.approx((sum((c - mean) ** 2 for c in changes) / 4) ** 0.5, abs=1e-6)


def test_nested_totals_add_in_the_order_of_the_sql(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.choice([-1.0, 0.37, 0.41, 1.13])) for g, n in (("a", 5000), ("b", 4096), ("c", 17), ("d", 1)) for i in range(n)]
    d = scan.numbered(spark.createDataFrame(rows, "g string, i int, x double"), ["g"], ["i"])
    got = {}
    for r in scan.nested_totals(d, ["g"], F.col("x")).orderBy("g", "_node").collect():
        assert r["_totals"][0] == (got[r["g"]][-1] if r["_node"] else 0.0)
        got.setdefault(r["g"], []).extend(r["_totals"][1:])
    db = duckdb.connect()
    db.execute("CREATE TABLE t (g VARCHAR, i INTEGER, x DOUBLE)")
    for g in "abcd":  # a table of one group: what lies before a group of a table doesn't matter
        db.execute("DELETE FROM t")
        db.register("one", pandas.DataFrame([r for r in rows if r[0] == g], columns=["g", "i", "x"]))
        db.execute("INSERT INTO t SELECT * FROM one")
        assert [r[0] for r in db.execute("SELECT sum(x) OVER (PARTITION BY g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) FROM t ORDER BY i").fetchall()] == got[g]
    assert scan.nested_totals(d.filter("x > 9"), ["g"], F.col("x")).count() == 0


def test_a_bankroll_of_nearly_nothing_without_places(spark):
    rows = [(i, "g", p) for i, p in enumerate(([0.37] * 10 + [-0.1] * 37) * 9 + [0.37] * 10 + [-3.7, 0.5])]
    d = spark.createDataFrame(rows, "i int, g string, profit double")
    db = duckdb.connect()
    db.register("t", pandas.DataFrame(rows, columns=["i", "g", "profit"]))
    sql = "WITH e AS (SELECT i, sum(profit) OVER (PARTITION BY g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a FROM t), c AS (SELECT a / nullif(lag(a) OVER (ORDER BY i), 0) - 1 AS change FROM e) SELECT stddev_pop(change) FROM c"
    wanted = db.execute(sql).fetchone()[0]
    assert wanted > 1e10  # changes from what is left of nothing
    assert trades.equity_report(d, ["g"], ["i"], 0.0, None).first()["volatility"] == pytest.approx(wanted, rel=1e-9)
    assert trades.equity_report(d, ["g"], ["i"], 0.0).first()["volatility"] < 1e3
