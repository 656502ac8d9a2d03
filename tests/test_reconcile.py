"""Several sources of the same matches."""

import datetime as dt

from tallyfield.operators import reconcile

D = dt.date
MATCH = "id int, date date, home_team string, away_team string, score string, odd double"


def frame(spark, rows):
    return spark.createDataFrame(rows, MATCH)


def run(spark, primary, api, odds=()):
    others = [reconcile.Source("api", frame(spark, api), ["score"], adds=True), reconcile.Source("odds", frame(spark, list(odds)), ["odd"])]
    out = reconcile.reconcile(reconcile.Source("main", frame(spark, primary)), others, ["score", "odd"])
    return sorted((r["data_source"], r["id"], r["score"], r["odd"], r["filled_from"]) for r in out.collect())


def test_fill_never_overwrites_and_first_by_id_fills(spark):
    primary = [(1, D(2024, 1, 5), "São Paulo FC", "Porto", "", None), (2, D(2024, 1, 5), "Ajax", "PSV", "1-0", 2.0)]
    api = [(7, D(2024, 1, 6), "sao paulo", "PORTO", "3-3", None), (6, D(2024, 1, 4), "Sao Paulo", "Porto", " ", None), (8, D(2024, 1, 5), "Sao Paulo", "Porto", "9-9", None), (9, D(2024, 1, 5), "Ajax", "PSV", "0-0", None)]
    odds = [(1, D(2024, 1, 5), "Ajax", "PSV", None, 9.0), (2, D(2024, 1, 5), "sao paulo", "porto", None, 1.5)]
    assert run(spark, primary, api, odds) == [("main", 1, "3-3", 1.5, ["api", "odds"]), ("main", 2, "1-0", 2.0, [])]


def test_exact_key_before_a_day_off_and_new_matches_join(spark):
    primary = [(1, D(2024, 1, 5), "A", "B", None, None), (2, D(2024, 1, 6), "A", "B", None, None)]
    api = [(1, D(2024, 1, 6), "A", "B", "6-6", None), (2, D(2024, 1, 4), "A", "B", "4-4", None), (3, D(2024, 1, 9), "A", "B", "9-9", None), (4, D(2024, 1, 9), "a", "b fc", None, None)]
    odds = [(1, D(2024, 1, 9), "A", "B", None, 5.0)]  # only the primary's matches are filled
    assert run(spark, primary, api, odds) == [("api", 3, "9-9", None, []), ("main", 1, "4-4", None, ["api"]), ("main", 2, "6-6", None, ["api"])]


def test_duplicates_keep_the_fullest_and_rows_without_a_key_stay(spark):
    primary = [(1, D(2024, 1, 5), "A", "B", None, None), (2, D(2024, 1, 5), "a fc", "B", "1-1", None), (3, None, "A", "B", None, None), (4, D(2024, 1, 5), None, "B", None, None), (5, D(2024, 1, 5), None, "B", None, None)]
    got = run(spark, primary, [])
    assert got == [("main", 2, "1-1", None, []), ("main", 3, None, None, []), ("main", 4, None, None, []), ("main", 5, None, None, [])]
    assert run(spark, [], []) == []


def test_canonical_matches_merge_misspelt_names(spark):
    teams = spark.createDataFrame([("man_utd", "Manchester United"), ("porto", "Porto")], "canonical_id string, canonical_name string")
    leagues = spark.createDataFrame([("cup", "The Cup")], "canonical_id string, canonical_name string")
    rows = [("b", 1, D(2024, 1, 5), "The Cup", "Manchestr United", "Porto", "2-0", None), ("a", 2, D(2024, 1, 5), "The Cup", "Man Utd", "FC Porto", None, 1.5), ("a", 3, D(2024, 1, 5), "The Cup", "Nobody", "Porto", None, None)]
    d = spark.createDataFrame(rows, "source string, id int, date date, league string, home_team string, away_team string, score string, odd double")
    got = {r["home_id"]: r for r in reconcile.canonicalise(d, teams, leagues, ["score", "odd"], {"a": 0, "b": 1}).collect()}
    m = got["man_utd"]
    assert set(got) == {"man_utd", "nobody"} and (m["score"], m["odd"], m["sources"], m["merged_rows"], m["conflicts"], m["needs_review"]) == ("2-0", 1.5, ["a", "b"], 2, 0, False)
    assert got["nobody"]["needs_review"] and got["nobody"]["mapping_confidence"] == 0 and got["nobody"]["quality"] < m["quality"]
