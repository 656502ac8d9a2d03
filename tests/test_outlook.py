"""The table of rolling features, regimes, uncertainty and scenarios."""

import random

from pyspark.sql import functions as F

from tallyfield.operators import outlook, specification
from tallyfield.session import spread


def rows(spark, n=60):
    rng = random.Random(3)
    made = [(t, i, rng.choice(["home", "away"]), rng.randint(0, 5), None if rng.random() < 0.2 else rng.randint(0, 15)) for t in "ab" for i in range(n)]
    return spark.createDataFrame(made, "team string, i int, side string, goals_for_ft int, shots_for int")


def test_names_and_what_they_are_made_of():
    spec = specification.rolling_features()
    assert len(spec) == len({f.name for f in spec}) == 13 * 3 + 2 + 6
    assert specification.feature_of("shots_allowed_avg_last_10") == specification.Feature("shots_allowed_avg_last_10", "shots_against", 10)
    assert specification.feature_of("away_corners_avg_last_5").scope == "side:away" and specification.feature_of("goals_for_ft_avg_last_4") is None


def test_features_equal_plain_means_and_pass_the_check(spark):
    built = specification.build(rows(spark), "team", "side", ["i"])
    got = built.orderBy("team", "i").collect()
    for team in "ab":
        own = [r for r in got if r["team"] == team]
        for k, r in enumerate(own):
            past = [x["shots_for"] for x in own[max(0, k - 3) : k] if x["shots_for"] is not None]
            assert r["shots_avg_last_3"] == (sum(past) / len(past) if past else None)
            sides = [x["goals_for_ft"] for x in own[:k] if x["side"] == "home"][-5:]
            assert r["home_goals_avg_last_5"] == (sum(sides) / len(sides) if sides and r["side"] == "home" else None)
    found = specification.check(built, "team", "side", ["i"]).collect()
    assert len(found) == 3 * 2 + 4 and all(r["differing"] == 0 and r["first_filled"] == 0 and r["total_rows"] == 120 for r in found)


def test_check_finds_features_that_see_their_own_or_a_later_row(spark):
    built = specification.build(rows(spark), "team", "side", ["i"])
    leak = {"goals_for_ft_avg_last_3": F.col("goals_for_ft").cast("double"), "shots_avg_last_5": F.coalesce("shots_avg_last_5", F.lit(1.0))}
    found = {r["feature"]: r for r in specification.check(built.withColumns(leak), "team", "side", ["i"]).collect()}
    assert found["goals_for_ft_avg_last_3"]["differing"] > 60 and found["goals_for_ft_avg_last_3"]["first_filled"] == 2
    assert found["shots_avg_last_5"]["first_filled"] == 2 and found["shots_avg_last_5"]["differing"] >= 2 and found["shots_avg_last_3"]["differing"] == 0


def test_no_sources_and_empty_tables(spark):
    d = rows(spark).select("team", "i", "side")
    assert specification.check(specification.build(d, "team", "side", ["i"]), "team", "side", ["i"]).count() == 0
    empty = specification.build(rows(spark).limit(0), "team", "side", ["i"])
    assert {(r["total_rows"], r["filled"]) for r in specification.check(empty, "team", "side", ["i"]).collect()} == {(0, 0)}


def test_regimes_and_uncertainty_at_their_limits(spark):
    cases = [("real_data", 2.1, 44.0, 1, 100, 0, "aggressive", 0.18), ("real_data", 2.1, 45.0, 1, 99, 2, "balanced", 0.35), ("real_data", 0.0, 50.0, 0, 29, 10, "conservative", 0.64), ("real_data", -1.01, 0.0, 0, 100, 0, "defensive", 0.18),
             ("real_data", 3.0, 65.0, 0, 100, 0, "defensive", 0.18), ("real_data", 3.0, 0.0, 2, 100, 0, "defensive", 0.18), ("no_data", 3.0, 0.0, 0, 0, 99, "diagnostic", 0.95), (None, None, None, None, None, None, "diagnostic", 0.84)]
    d = spark.createDataFrame(cases, "state string, ev double, risk double, critical int, n int, alerts int, regime string, u double")
    got = d.select("regime", "u", outlook.regime(F.col("state"), F.col("ev"), F.col("risk"), F.col("critical")), F.round(outlook.uncertainty(F.col("state"), F.col("n"), F.col("alerts")), 9)).collect()
    assert all(r[0] == r[2] and r[1] == r[3] for r in got)


def test_scenarios_of_one_bucket_none_and_many(spark):
    d = spark.createDataFrame([("one", -4.0), ("none", None), ("many", 60.0), ("many", 0.0), ("many", None)], "g string, ev double")
    got = {(r["g"], r["name"]): tuple(r)[2:] for r in outlook.scenarios(d, "ev", ["g"]).collect()}
    assert len(got) == 6
    assert got["one", "defensive"] == (-2.8, None, 5.6, outlook.BASELINE) and got["one", "aggressive"] == (-5.0, None, 10.0, outlook.ADVICE["aggressive"])
    assert got["many", "balanced"] == (30.0, 30.0, 30.0, outlook.BASELINE) and got["many", "defensive"] == (21.0, 16.5, 16.5, outlook.BASELINE)


def test_sorts_are_narrow_and_tables_are_dealt_out_by_rows(spark):
    assert [spread(spark.range(n).withColumn("k", F.col("id") % 50), ["k"], rows=10).rdd.getNumPartitions() for n in (1, 1000)] == [spark.sparkContext.defaultParallelism, 100]
    built = specification.build(rows(spark), "team", "side", ["i"])
    plan = specification.check(built, "team", "side", ["i"])._jdf.queryExecution().optimizedPlan().toString()
    by_side, by_team = plan.rfind("_again_home_goals_avg_last_5"), plan.find("_again_goals_for_ft_avg_last_3")  # a plan's first line is its last step
    assert 0 <= by_team < by_side
