"""Summaries of tables, what comes in from others' files and what goes out."""

import datetime as dt
import glob
import math

import pytest
from pyspark.sql import functions as F

from tallyfield.functions import scan
from tallyfield.operators import decisions, summaries
from tallyfield.session import fresh_path
from tallyfield.sources import intake, outputs


def test_summary_counts_teams_of_both_sides_once(spark):
    rows = [("2024-01-05", "A", "x", "y", 1.0), ("bad", "A", "y", None, None), (None, None, "z", "x", 2.0), ("2024-03-01 20:00:00", "B", None, None, 0.0)]
    d = spark.createDataFrame(rows, "date string, league string, home_team_key string, away_team_key string, goals_std_last_5 double")
    got = summaries.dataset_summary(d, ["home_team_key", "away_team_key", "absent"]).first().asDict()
    assert got == {"total_rows": 4, "total_leagues": 2, "total_teams": 3, "first_date": dt.date(2024, 1, 5), "last_date": dt.date(2024, 3, 1), "columns": 5, "features_count": 3, "advanced_features_count": 3}
    empty = summaries.dataset_summary(d.limit(0).drop("date", "league"), ["home_team_key"]).first()
    assert (empty["total_rows"], empty["total_leagues"], empty["total_teams"], empty["first_date"]) == (0, 0, 0, None)


@pytest.mark.parametrize("n,leagues,level,ready,advice", [(0, 1, "fraca", False, 2), (99, 2, "fraca", False, 3), (100, 1, "média", False, 3), (100, 2, "média", True, 2), (1000, 2, "forte", True, 2)])
def test_health_at_its_limits(spark, n, leagues, level, ready, advice):
    d = spark.range(n).select((F.col("id") % leagues).cast("string").alias("league"), F.lit("t").alias("team_key"), (F.col("id") % 2).cast("string").alias("market"))
    got = summaries.backtest_health(d).first()
    assert (got["total_trades"], got["sample_level"], got["is_ready_for_ml"], len(got["recommendations"])) == (n, level, ready, advice)


def test_drawdown_of_one_curve_over_many_blocks(spark):
    values = [100.0, 90.0, None, 120.0, 60.0, 0.0, 150.0, 149.0] * 6
    d = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)] + [("zero", 0, 0.0), ("zero", 1, -5.0)], "g string, i int, v double")
    out = summaries.percent_drawdown(scan.numbered(d, ["g"], ["i"], rows=5), ["g"], "v")
    peak, want = -math.inf, []
    for v in values:
        peak = peak if v is None else max(peak, v)
        want.append(None if v is None else (v - peak) / peak * 100)
    rows = sorted(out.filter("g = 'g'").collect(), key=lambda r: r["i"])
    assert [r["drawdown_pct"] for r in rows] == want and len({r["_block"] for r in rows}) == 10
    risk = {r["g"]: (r["points"], r["max_drawdown"]) for r in summaries.curve_risk(out, ["g"]).collect()}
    assert risk == {"g": (42, -100.0), "zero": (2, 0.0)}


def test_active_signals_without_status_or_columns(spark):
    d = spark.createDataFrame([("a", "Pending", 1.0), ("b", None, 2.0), ("c", "settled", 3.0)], "signal_id string, status string, stake double")
    assert [tuple(r) for r in summaries.active_signals(d).collect()] == [("a", 1.0)]
    assert summaries.active_signals(d.drop("status")).count() == 0


def test_trade_log_types_and_defaults(spark):
    rows = [("2024-01-05", "true", "1.5", "2", "1.9"), ("soon", "0.0", "x", "", "inf"), (None, None, None, None, None), ("2024-01-06 10:00:00", "No", "-1", "NaN", "2")]
    d = spark.createDataFrame(rows, "date string, is_win string, profit string, stake string, odd string")
    got = [tuple(r) for r in intake.load_trades(d).collect()]
    day = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 6, 10)
    assert [(g[0] and g[0].replace(tzinfo=None), *g[1:]) for g in got] == [(day[0], True, 1.5, 2.0, 1.9), (None, False, 0.0, 1.0, None), (None, False, 0.0, 1.0, None), (day[1], False, -1.0, 1.0, 2.0)]
    bare = intake.load_trades(spark.createDataFrame([(1,)], "id int"))
    assert [tuple(r) for r in bare.select("id", "profit", "stake", "odd").collect()] == [(1, 0.0, 1.0, None)]
    assert intake.load_trades(d.limit(0)).count() == 0


def test_totals_are_derived_only_for_an_empty_column(spark):
    d = spark.createDataFrame([("2", 1, None, "1"), ("x", 3, "bad", "1")], "goals_home_ft string, Goals_A_FT int, total_goals_ft string, shots_h string")
    out, missing = intake.metric_columns(d)
    assert [tuple(r) for r in out.select("goals_home_ft", "goals_away_ft", "total_goals_ft", "shots_home").collect()] == [(2.0, 1.0, 3.0, 1.0), (None, 3.0, None, 1.0)]
    assert "shots_home" not in missing and "corners_home" in missing and "total_goals_ft" not in missing
    kept, _ = intake.metric_columns(d.withColumn("total_goals_ft", F.when(F.col("shots_h") == "1", "9")))
    assert {r["total_goals_ft"] for r in kept.collect()} == {9.0}


def test_matches_that_lack_parts(spark):
    texts = ['{"id":7,"score":{"fullTime":{"home":0,"away":0}}}', '{"score":{"fullTime":{"home":1}}}', "no json", None, '{"homeTeam":null,"score":{"fullTime":{"home":3,"away":1},"halfTime":null}}']
    out = intake.match_columns(spark.createDataFrame(list(enumerate(texts)), "n int, j string"), "j", ["n"])
    got = {r["n"]: (r["match_id"], r["total_goals_ft"], r["btts"], r["over_3_5"], r["result"], r["goals_home_ht"]) for r in out.collect()}
    assert got == {0: ("7", 0, False, False, "D", None), 1: (None, None, None, None, None, None), 2: (None,) * 6, 3: (None,) * 6, 4: (None, 4, True, True, "H", None)}


def test_exported_candidates_survive_their_file(spark):
    rows = [("HIGH_CONFIDENCE_SIMULATION", 'a "b", c\nd', "m", 1.5, 0.6), ("MEDIUM_CONFIDENCE_SIMULATION", None, "é", None, 0.5), ("WATCH_ONLY", "z", "m", 1.0, 0.1), (None, "n", "m", 1.0, 0.1)]
    d = spark.createDataFrame(rows, "simulation_label string, match string, market string, score double, ml_probability double").withColumn("home_team", F.lit("H")).withColumn("away_team", F.lit("A"))
    read = outputs.export_candidates(d, fresh_path(spark, "export"))
    assert {(r["match"], r["market"], r["score"], r["probability"], r["mode"]) for r in read.collect()} == {('a "b", c\nd', "m", 1.5, 0.6, outputs.MODE), ("H vs A", "é", None, 0.5, outputs.MODE)}
    assert outputs.candidates(d.drop("simulation_label")).count() == 4
    assert outputs.candidates(d.limit(0)).count() == 0


def test_parts_have_keys_and_their_own_columns(spark):
    root = fresh_path(spark, "parts").removeprefix("file://")
    d = spark.createDataFrame([(1, "p", 2.0, 5, "x")], "match_id int, provider string, odds_home double, corners_home int, note string")
    paths = outputs.write_parts(d, root)
    assert {k: spark.read.parquet(p).columns for k, p in paths.items()} == {"matches": d.columns, "odds": ["match_id", "provider", "odds_home"], "stats": ["match_id", "provider", "corners_home"]}
    assert glob.glob(f"{root}/*.parquet")


def test_strict_json_at_any_depth(spark):
    d = spark.createDataFrame([(1, [1.5, math.nan], ({"k": math.inf}, [(-math.inf, "t")]), None)], "id int, a array<double>, s struct<m:map<string,double>,l array<struct<x:float,y:string>>>, n double".replace("l array", "l:array"))
    assert d.select(outputs.strict_json(d)).first()[0] == '{"id":1,"a":[1.5,null],"s":{"m":{"k":null},"l":[{"x":null,"y":"t"}]},"n":null}'


def test_research_rule_at_its_limits(spark):
    rows = [(0.54, None, None, 0.6, None), (0.54, "1.75", None, 0.59, "LOW_SAMPLE"), (0.54, "1.80", "9", None, ""), (0.58, "0", "1.0", 0.9, "x"), (None, "3", None, 0.9, None)]
    d = spark.createDataFrame(rows, "p double, a string, b string, quality double, warnings string")
    c = decisions.research_candidate(F.col("p"), ["a", "b"], "quality", "warnings")
    got = [tuple(r) for r in d.select(c["odds"], c["true_ev"], c["recommendation_type"], c["confidence_band"], c["risk_flags"]).collect()]
    medium, watch, good = "MEDIUM_CONFIDENCE_SIMULATION", "WATCH_ONLY", "SIMULATION_CANDIDATE"
    assert got == [(0.0, None, good, watch, ""), (1.75, -0.055, watch, watch, "LOW_DATA_QUALITY | LOW_SAMPLE_SIZE"), (1.8, -0.028, good, watch, "LOW_DATA_QUALITY"), (1.0, None, good, medium, ""), (3.0, -1.0, watch, watch, "")]
