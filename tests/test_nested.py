"""Payloads of any nesting, in the shapes that sources use."""

import json

import pytest
from pyspark.sql import functions as F

from tallyfield.functions import nested, payloads, text


def every(x, path="$"):
    """All values of parsed JSON with their paths."""
    yield path, x
    for k, v in x.items() if isinstance(x, dict) else ((f"[{i}]", v) for i, v in enumerate(x)) if isinstance(x, list) else ():
        yield from every(v, path + (k if isinstance(x, list) else f".{k}"))


def test_nodes_of_deep_and_odd_texts(spark):
    deep = 0
    for i in range(30):
        deep = {"a": [deep, i]} if i % 2 else [deep]
    texts = [json.dumps(deep), '{"x": {}, "y": [], "z": null}', "7", "no json", None, "", '["é", {"a b": true}]']
    d = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    got = sorted((r["id"], r["path"], r["kind"]) for r in nested.nodes(d, ["id"], "j").collect())
    kind = lambda x: "object" if isinstance(x, dict) else "array" if isinstance(x, list) else "value"
    assert got == sorted((i, p, kind(x)) for i in (0, 1, 2, 6) for p, x in every(json.loads(texts[i])))


STATS = [
    ({"Corners": {"home": 1, "away": 2}}, [("Corners", "1", "2")]),
    ({"xG": "1.2 - 0,8"}, [("xG", "1.2", "0,8")]),
    ({"Shots": [3, 4, 5]}, [("Shots", "3", "4")]),
    ([{"name": "a", "homeValue": "9", "awayScore": 8}, {"type": "b", "h": 0, "a": 1}, 5, {"x": 1}], [("a", "9", "8"), ("b", "0", "1"), ("", None, None)]),
    ({"Fouls": "none"}, [("Fouls", None, None)]),
    ([], []),
]


@pytest.mark.parametrize("stats, want", STATS)
def test_statistics_in_any_shape(spark, stats, want):
    d = spark.createDataFrame([(json.dumps(stats),)], "j string").withColumn("v", F.try_parse_json("j"))
    assert [tuple(x) for x in d.select(nested.stats_of("v").alias("s")).first()["s"]] == want


MARKETS = [
    ({"1X2": {"home": 1.5, "draw": 3, "away": 6}}, [("1X2", ["1.5", "3", "6"])]),
    ({"BTTS": {"yes": 1.7, "no": 2}}, [("BTTS", ["1.7", "2"])]),
    ({"Total 2.5": {"over": "1,9", "under": 2}}, [("Total 2.5", ["1,9", "2"])]),
    ({"h2h": [1, "7/2", 3.5]}, [("h2h", ["1", "7/2", "3.5"])]),
    ([{"label": "h2h", "outcomes": [{"odds": 2}, {"decimal": 3}, {"price": "4"}, {"value": 5}, {"none": 1}]}], [("h2h", ["2", "3", "4", "5", None])]),
    ([{"marketName": "m", "odds": {"values": [1, 2]}}, {"type": "n", "yes": 1, "no": 3}, "x"], [("m", ["1", "2"]), ("n", ["1", "3"])]),
    ({"empty": {"values": [], "odds": [1]}, "nothing": {}}, [("empty", ["1"]), ("nothing", [])]),
]


@pytest.mark.parametrize("markets, want", MARKETS)
def test_prices_in_any_shape(spark, markets, want):
    d = spark.createDataFrame([(json.dumps(markets),)], "j string").withColumn("v", F.try_parse_json("j"))
    assert [(x["name"], x["values"]) for x in d.select(nested.markets_of("v").alias("m")).first()["m"]] == want


def test_matches_need_both_teams_and_something_of_a_match(spark):
    texts = ['{"HOME": "a", "AWAY": "b", "Score": "1-0", "home": "c", "away": "d"}', '{"home": "a", "away": "b"}', '{"home": "a", "id": "x123456"}', '{"homeName": "a", "awayName": "", "id": 1}', '{"home": {"participantName": "p"}, "away": {"name": "", "shortName": "q"}, "events": null}']
    d = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    got = {(r["id"], r["home_team"], r["away_team"]) for r in nested.captured_rows(d, ["id"], "j").collect()}
    assert got == {(0, "c", "d"), (4, "p", "q")}


def test_captured_rows_write_no_plain_values_and_no_match_is_read_twice(spark, monkeypatch):
    one = {"home": "a", "away": {"name": "b"}, "id": "abc1234", "stats": {"Corners": "3-4", "xG": [1, "0,5"]}, "odds": [{"name": "h2h", "values": [2, "7/2", {"odds": 4}]}]}
    d = spark.createDataFrame([(1, json.dumps({"x": [one, 5, None, "t"]})), (2, "no json"), (3, "7")], "id int, j string")
    written = []

    def kept(df, label, *rest):
        out = materialise(df, label, *rest)
        written.append((label, out.count() if "value" not in out.columns else out.filter("value IS NOT NULL AND depth > 0").count()))
        return out

    materialise = nested.materialise
    monkeypatch.setattr(nested, "materialise", kept)
    r = nested.captured_rows(d, ["id"], "j")
    got = [(x["path"], x["home_team"], x["away_team"], x["corners_away"], x["xg_away"], x["odds_draw"], x["odds_away"]) for x in r.collect()]
    assert got == [("$.x[0]", "a", "b", 4, 0.5, 4.5, 4.0)]
    assert sum(n for label, n in written if label == "payload-nodes") == 9  # the list, the match and what it holds: seven objects and lists
    assert written[-1] == ("payload-matches", 1)


def test_items_are_sought_once_for_all_their_texts(spark):
    d = spark.createDataFrame([('{"home": "a", "away": "b"}',)], "j string")
    plan = payloads.structured_rows(d, "j", [])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("total shots") <= 2 and plan.count("both teams") <= 2  # a use of each of 19 texts held the search before


@pytest.mark.parametrize("value, want", [("AET", "finished"), ("after Penalties", "finished"), ("HT", "live"), ("2nd half", "live"), ("Abandoned", "postponed"), (" ", "scheduled"), (None, "scheduled"), ("Not started", "not_started")])
def test_status(spark, value, want):
    assert spark.createDataFrame([(value,)], "s string").select(text.parse_status("s")).first()[0] == want


def test_text_rows_with_years_weekdays_and_words_that_are_no_teams(spark):
    lines = ["Sat 03.02.", "18:30", "Real Um", "Dois", "2-1", "04/03/2023", "20:00", "Odds", "Outro", "20:15", "AB", "Cde", "31.02.2024", "21:00", "Águia", "Leão FC", "end", "7:05", "xyz", "XYZ"]
    d = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "")], "id int, t string")
    got = [(str(r["match_date"]), r["kickoff_time"], r["home_team"], r["away_team"], r["score"]["home_ft"]) for r in payloads.text_rows(d, "id", "t", 2024).collect()]
    assert got == [("2024-02-03", "18:30", "Real Um", "Dois", 2), ("2023-03-04", "21:00", "Águia", "Leão FC", None)]
