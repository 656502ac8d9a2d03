"""Calibration on folds in time, and versions of models."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from tallyfield.operators import learning, stats
from tallyfield.plans import models as plans
from tallyfield.sources import models
from tallyfield.session import drop_written, materialise
from tests.support import DATA


@pytest.fixture(scope="module")
def rows(spark):
    """Outcomes that follow from x with much noise, so that trees are too sure of themselves."""
    rng = random.Random(8)
    out = []
    for i in range(1500):
        x = rng.gauss(0, 1)
        out.append((i, f"{2019 + i // 300}-03-01", x, rng.gauss(0, 1), float(rng.random() < 0.5 + 0.25 * (x > 0) - 0.25 * (x < -1))))
    return spark.createDataFrame(out, "i int, day string, x double, noise double, y double").withColumn("day", F.to_timestamp("day")).coalesce(2)


def test_calibration_error_falls_on_rows_that_nothing_had_seen(spark, rows):
    folds = materialise(learning.calibrated_folds(rows, ["x", "noise"], "y", "day", kinds=("boosted",), trees=25), "test-folds")
    assert {r["fold"] for r in folds.select("fold").distinct().collect()} == {2021, 2022, 2023} and folds.count() == 900
    error = lambda p: stats.calibration_error(folds, p, "y").first()["ece"]
    assert error("calibrated_boosted") < error("boosted") and folds.filter("ensemble <> calibrated_boosted").count() == 0
    metrics = {(r["fold"], r["model"]): r for r in learning.fold_metrics(folds, ["boosted", "ensemble"], "y").collect()}
    assert len(metrics) == 6 and all(0.5 < r["auc"] < 1 and r["n"] == 300 for r in metrics.values())
    assert sum(metrics[f, "ensemble"]["brier"] for f in (2021, 2022, 2023)) < sum(metrics[f, "boosted"]["brier"] for f in (2021, 2022, 2023))
    assert learning.calibrated_folds(rows.filter("i < 600"), ["x"], "y", "day").count() == 0  # two folds leave none to judge by


def test_versions_of_models(spark, rows, tmp_path):
    root = f"{tmp_path}/models"
    assert models.records(spark, root).count() == 0
    with pytest.raises(LookupError):
        models.score_registered(rows, root, "goals")
    first = learning.train(rows.filter("i < 300"), ["x"], "y", trees=3)
    second = learning.train(rows.filter("i < 900"), ["x"], "y", trees=3)
    curve = learning.calibrate(learning.score(second, rows.filter("i >= 900")), "probability", "y")
    assert models.register(spark, root, "goals", first, "forest", ["x"], "2019", auc=0.6) == 1
    assert models.register(spark, root, "goals", second, "forest", ["x"], "2019-2021", curve=curve) == 2
    assert models.register(spark, root, "shots", first, "forest", ["x"], "2019") == 1
    assert {(r["market"], r["version"], r["calibrated"]) for r in models.latest(spark, root).collect()} == {("goals", 2, True), ("shots", 1, False)}
    p = lambda d: {r["i"]: r["probability"] for r in d.collect()}
    assert p(models.score_registered(rows, root, "goals", 1)) == p(learning.score(first, rows))
    newest = models.score_registered(rows, root, "goals")
    assert p(newest) == p(learning.calibrated(curve, learning.score(second, rows), "probability", "probability")) == p(models.score_registered(rows, root, "goals", 2))
    assert newest.select("model_version").distinct().first()[0] == 2


def test_only_own_tables_are_dropped(spark, tmp_path):
    mine = materialise(spark.range(3), "test-own")
    spark.range(3).write.parquet(f"{tmp_path}/theirs")
    theirs = spark.read.parquet(f"{tmp_path}/theirs")
    drop_written(theirs)
    assert theirs.count() == 3
    drop_written(mine)
    with pytest.raises(Exception):
        mine.count()


def test_rows_to_learn_from_are_written_once_and_not_made_for_each_fit(spark):
    plan = plans._learning_rows(spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Relation" in plan


def test_boosted_models_are_fitted_together_and_returned_in_order(spark):
    meet = threading.Barrier(learning.TOGETHER["boosted"], timeout=60)  # passes only if so many run at once

    def fit(i):
        meet.wait()
        return i

    assert learning.fitted(spark, "boosted", [lambda i=i: fit(i) for i in range(2 * learning.TOGETHER["boosted"])]) == list(range(8))


@pytest.fixture(scope="module")
def repeated(spark):
    """12 different rows, 3,000 in all."""
    rows = [(i, float(i % 3), None if i % 4 == 3 else float(i % 2), float(i % 12 in (0, 1, 4, 9))) for i in range(3000)]
    return spark.createDataFrame(rows, "i int, a double, b double, y double")


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_equal_rows_are_learnt_from_as_one_with_their_number(spark, repeated, kind, monkeypatch):
    written = []
    monkeypatch.setattr(learning, "FEW", 0)
    monkeypatch.setattr(learning, "materialise", lambda d, label: written.append(materialise(d, label)) or written[-1])
    model = learning.train(repeated, ["a", "b"], "y", kind, trees=6)
    assert len(written) == 1 and written[0].count() < 12 and written[0].agg(F.sum("_n")).first()[0] == 3000
    p = {(r["a"], r["b"]): r["probability"] for r in learning.score(model, repeated).select("a", "b", "probability").distinct().collect()}
    assert len(p) == 9
    rate = {(r["a"], r["b"]): r["r"] for r in repeated.groupBy("a", F.coalesce("b", F.lit(0.0)).alias("b")).agg(F.avg("y").alias("r")).collect()}
    if kind == "forest":  # the trees part all six kinds of rows, each over its own bootstrap of hundreds of rows
        assert all(v == pytest.approx(rate[a, b or 0.0], abs=0.06) for (a, b), v in p.items()) and any(v != rate[a, b or 0.0] for (a, b), v in p.items())
        assert sum(w for _, w in learning.importances(model, ["a", "b"])) == pytest.approx(1.0)
    else:
        assert all((v > 0.5) == (rate[a, b or 0.0] > 0.5) for (a, b), v in p.items() if rate[a, b or 0.0] != 0.5)


def test_draws_of_equal_rows_add_up_as_single_ones_do(spark):
    d = spark.range(400).select(learning._draws(F.lit(900.0), F.col("id"), 5).alias("x"))
    got = [v for r in d.collect() for v in r["x"]]
    mean = sum(got) / len(got)
    assert mean == pytest.approx(900, abs=4) and sum((v - mean) ** 2 for v in got) / len(got) == pytest.approx(900, rel=0.15)
    assert [r["x"] for r in d.collect()] == [got[i : i + 5] for i in range(0, 2000, 5)]


def test_metrics_of_counted_rows_are_those_of_all_rows(spark, repeated):
    d = repeated.withColumn("g", F.col("i") % 2).withColumn("p", F.round((F.col("i") % 12) / 13 + F.col("y") / 20, 6))
    counted = d.groupBy("g", "p", "y").agg(F.count("*").alias("n_"))
    assert counted.count() == 12
    near = lambda x: [tuple(round(v, 5) for v in r) for r in x.orderBy("g").collect()]
    assert near(stats.scores(counted, ["g"], "p", "y", count="n_")) == near(stats.scores(d, ["g"], "p", "y"))
    assert near(stats.auc(counted, ["g"], "p", "y", "n_")) == near(stats.auc(d, ["g"], "p", "y"))
