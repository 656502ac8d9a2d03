"""Histories by league, configurations of leagues, bounded stores and factors of the best signals."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tallyfield.operators import outlook
from tallyfield.session import fresh_path
from tallyfield.sources import files, history


def test_history_keeps_finished_matches_in_order_and_by_league(spark):
    rows = [("1", "2024-02-01T10:00:00Z", "A", "FINISHED"), ("2", "2024-01-01", "A", "FINISHED"), ("3", "soon", "B", "FINISHED"), ("4", "2024-01-01", "B", "SCHEDULED"), ("5", "2024-01-02", None, "FINISHED"), ("6", None, "C", None)]
    root = fresh_path(spark, "history-test")
    d = spark.createDataFrame(rows, "match_id string, date string, competition_code string, match_status string")
    got = history.write_history(d, root).collect()
    assert {r["match_id"]: r["date"] for r in got}["3"] is None and {r["match_id"] for r in got} == {"1", "2", "3", "5"}
    league = spark.read.parquet(f"{root}/leagues").filter("competition_code = 'A'")
    assert {r["match_id"] for r in league.collect()} == {"1", "2"}
    assert history.write_history(d.limit(0), fresh_path(spark, "history-none")).count() == 0


def test_league_files_of_all_shapes(spark):
    league = {"slug": "s", "name": "N", "country": "England"}
    texts = [("c/1.json", json.dumps([league, {**league, "slug": "off", "enabled": False}, {"name": "only", "season": "2024", "priority": 3}])), ("c/2.json", json.dumps({"leagues": [{"league_slug": "x", "country": "england"}, {}]})), ("c/3.json", "no json"), ("c/4.json", json.dumps({"other": 1})), ("c/5.json", None), ("c/6.json", "[]")]
    d = spark.createDataFrame(texts, "path string, text string")
    rows, bad = history.league_configs(d, "path", "text")
    got = [(r["league_slug"], r["league_name"], r["country"], r["season"], r["priority"]) for r in rows.orderBy("path", "place").collect()]
    assert got == [("s", "N", "England", "2023+", 1), ("only", "only", "", "2024", 3), ("x", "x", "england", "2023+", 1), ("unknown", "Unknown", "", "2023+", 1)]
    assert {r["warning"] for r in bad.collect()} == {f"invalid_leagues_payload:{i}.json" for i in (3, 4, 5)}
    assert [r["league_slug"] for r in history.league_configs(d, "path", "text", country="ENGLAND")[0].orderBy("path").collect()] == ["s", "x"]
    assert [r["league_slug"] for r in history.league_configs(d, "path", "text", season="2024")[0].collect()] == ["only"]
    assert [r["league_slug"] for r in history.league_configs(d, "path", "text", most=2)[0].collect()] == ["s", "only"]


def test_readiness_of_unknown_states(spark):
    pairs = [("ENGINE_READY", "FUTURE_GAMES_READY", "READY"), ("ENGINE_READY", None, "PARTIAL_READY"), ("ENGINE_MISSING", None, "ENGINE_MISSING"), ("ENGINE_FOUND_OUTPUTS_EMPTY", "FUTURE_GAMES_READY", "ENGINE_OUTPUTS_EMPTY"), (None, "FUTURE_GAMES_READY", "PARTIAL_READY"), ("?", "?", "PARTIAL_READY")]
    d = spark.createDataFrame(pairs, "a string, b string, want string")
    assert d.filter(~history.readiness(F.col("a"), F.col("b")).eqNullSafe(F.col("want"))).count() == 0


def test_completed_columns_keep_values_and_fill_ids(spark):
    d = spark.createDataFrame([("1", 5, "h"), (None, 6, "i"), (None, None, None)], "match_id string, flashscore_match_id int, home_team string")
    out = history.complete_columns(d)
    assert [r["match_id"] for r in out.collect()] == ["1", "6", None] and set(out.columns) == set(history.MATCH_COLUMNS)
    assert history.complete_columns(d.select("home_team"), ["home_team", "x"]).columns == ["home_team", "x"]


def test_bounded_store_keeps_the_last_and_repeats_nothing(spark):
    path = fresh_path(spark, "store-test")
    at = dt.datetime(2024, 1, 5, 10, 0, 0, 123456)
    rows = spark.createDataFrame([(i, at + dt.timedelta(microseconds=i), {"n": i}) for i in range(8)], "i int, t timestamp, m map<string,int>").select("i", "t", F.col("m")["n"].alias("n"))
    assert files.append_bounded(path, rows.filter("i < 5"), ["t"], 4).count() == 4
    for _ in range(2):
        kept = files.append_bounded(path, rows.filter("i >= 4"), ["t"], 6).collect()
        assert {r["i"] for r in kept} == {2, 3, 4, 5, 6, 7}
        assert len(kept) == 6 and {r["t"].microsecond for r in kept} == {123456 + r["i"] for r in kept}


def test_factors_of_ties_gaps_and_absent_columns(spark):
    rows = [("m", 3, 9.0, 0.61, 0.5, None), ("m", 2, 9.0, 0.7, None, 60.0), ("m", 1, None, 0.9, 0.1, 1.0), ("n", 4, None, 0.1, 0.1, 1.0)]
    d = spark.createDataFrame(rows, "g string, id int, score double, ml_probability double, implied_probability double, risk_score double")
    got = [tuple(r) for r in outlook.factor_breakdown(d, ["g"], "score", "id").collect()]
    assert got == [("m", 2, 9.0, "Probabilidade ML", 70.0, "positive"), ("m", 2, 9.0, "Risco operacional", 60.0, "negative")]
    assert outlook.factor_breakdown(d.limit(0), ["g"], "score", "id").count() == 0
