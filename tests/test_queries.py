"""Every registered query of the reference's operators against its SQL, or by its properties."""

import pytest
from pyspark.sql import functions as F

from tallyfield.operators import learning
from tallyfield.plans import registry
from tests.support import DATA, difference

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert difference(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_gives_the_same_rows_again(spark, name):
    first = sorted(map(repr, registry.QUERIES[name](spark, SF).collect()))
    assert first and first == sorted(map(repr, registry.QUERIES[name](spark, SF).collect()))


def test_every_candidate_gets_a_portfolio_share(spark):
    shares = registry.QUERIES["portfolio_kelly_all"](spark, SF)
    assert shares.filter("portfolio_share IS NOT NULL").count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_every_row_is_scored_by_a_model_of_other_times(spark):
    rows = registry.QUERIES["forest_probability"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/events.parquet").count()
    assert all(r["probability"] is not None and r["past_only"] == (r["fold"] > 1) for r in rows)
    assert {r["fold"] for r in rows} == {1, 2, 3, 4, 5}


def test_folds_are_years_or_stretches_of_one_year(spark):
    one = spark.createDataFrame([(i, f"2024-01-{i + 1:02d} 10:00:00") for i in range(20)], "i int, ts string").withColumn("ts", F.to_timestamp("ts"))
    two = one.withColumn("ts", F.when(F.col("i") < 3, F.expr("ts - interval 1 year")).otherwise(F.col("ts")))
    d, folds = learning.time_folds(one, "ts")
    assert folds == [1, 2, 3, 4, 5] and [r["fold"] for r in d.orderBy("i").collect()] == [i // 4 + 1 for i in range(20)]
    d, folds = learning.time_folds(two, "ts")
    assert folds == [2023, 2024] and d.filter("fold = 2023").count() == 3
    target = two.withColumn("x", F.col("i") % 3 * 1.0).withColumn("y", (F.col("i") % 2).cast("double"))
    assert [(r["fold"], r["n"]) for kind in ("forest", "boosted") for r in learning.walk_forward(target, ["x"], "y", "ts", kind, trees=2).collect()] == [(2024, 17)] * 2


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
