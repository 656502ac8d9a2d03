"""As-of joins against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyfield.functions import scan
from tallyfield.operators import learning, markets


@pytest.mark.parametrize("within, rows", [(None, 5), ("3 days", 50_000)])
def test_last_row_no_later(spark, monkeypatch, within, rows):
    monkeypatch.setattr(scan.numbered, "__defaults__", (rows,))
    rng, day = random.Random(4), dt.datetime(2024, 1, 1)
    keys = ["hot"] * 8 + ["b", None]
    when = lambda: day + dt.timedelta(hours=rng.randrange(24 * 20))
    left = [(i, rng.choice(keys + ["gone"]), None if i % 40 == 7 else when()) for i in range(300)]
    right = [(rng.choice(keys), None if i % 30 == 3 else when(), i, rng.choice([1.5, None])) for i in range(200)]
    got = markets.asof_join(spark.createDataFrame(left, "i int, k string, t timestamp"), spark.createDataFrame(right, "k string, at timestamp, seq int, price double"), ["k"], "t", "at", ["seq", "price"], ["seq"], within)
    have = {r["i"]: (r["matched_seq"], r["matched_price"], r["matched_at"]) for r in got.collect()}
    assert len(have) == len(left)
    for i, k, t in left:
        fit = [r for r in right if r[0] == k and t and r[1] and r[1] <= t]
        best = max(fit, key=lambda r: (r[1], r[2]), default=None)
        if best and within and t - best[1] > dt.timedelta(days=3):
            best = None
        assert have[i] == ((best[2], best[3], best[1]) if best else (None, None, None))


def test_empty_sides(spark):
    left = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1))], "i int, k string, t timestamp")
    right = spark.createDataFrame([], "k string, at timestamp, price double")
    assert [r["matched_price"] for r in markets.asof_join(left, right, ["k"], "t", "at", ["price"]).collect()] == [None]
    assert markets.asof_join(left.filter("i > 1"), right, ["k"], "t", "at", ["price"]).count() == 0


@pytest.mark.parametrize("label", [0.0, 1.0])
def test_model_of_one_class_gives_its_probability(spark, label):
    d = spark.createDataFrame([(float(i), label) for i in range(20)], "x double, y double")
    assert {r["probability"] for r in learning.score(learning.train(d, ["x"], "y", trees=2), d).collect()} == {label}


def test_report_of_movements_ahead(spark):
    day = lambda n: dt.date(2024, 1, n)
    odds = [(m, "H", b, day(n), p) for m, b, prices in [(1, 0, (2.0, 1.7)), (1, 1, (2.0, 1.7)), (1, 2, (2.1, 1.8)), (2, 0, (2.0, 1.99)), (3, 0, (2.0, 1.0)), (4, 1, (2.0, 1.0)), (5, 0, (3.0, None))] for n, p in zip((1, 9), prices) if p]
    starts = [(1, dt.datetime(2024, 1, 11)), (2, dt.datetime(2024, 1, 9, 1)), (3, dt.datetime(2024, 1, 20)), (4, dt.datetime(2024, 1, 10)), (5, dt.datetime(2024, 1, 10))]
    d = spark.createDataFrame(odds, "m int, sel string, book int, day date, price double")
    r = markets.movement_report(d, spark.createDataFrame(starts, "m int, starts timestamp"), "m", ["sel"], "book", "day", "price", "starts", F.lit(dt.datetime(2024, 1, 9)), 0)
    got = {x["m"]: (x["hours_to_start"], x["movement_pct"], x["movement_type"], x["steam"], x["direction"], x["modifier"]) for x in r.collect()}
    assert got == {1: (48.0, 15.0, "SHARP_MOVEMENT", True, "DOWN", 0.15), 2: (1.0, 0.5, "PUBLIC_MONEY", False, None, -0.05), 5: (24.0, 0.0, "NEUTRAL", False, None, 0.0)}
