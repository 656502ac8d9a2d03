"""Likeness of names and the cascade from names to entities."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfield.functions import fuzzy
from tallyfield.operators import entities


def subsequence(a, b):
    """The textbook table."""
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
        last = row
    return last[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abé \U0001f600", max_size=80), st.text("abé \U0001f600", max_size=80)), max_size=8))
def test_common_subsequence(pairs):
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    assert fuzzy.common_subsequence(a, b).tolist() == [subsequence(x, y) for x, y in pairs]


def score(a, b):
    x, y = (" ".join(sorted(s.split())) for s in (a, b))
    return 200 * subsequence(x, y) / (len(x) + len(y))


def misspelt(rng, words):
    w = list(rng.choice(words))
    for _ in range(rng.randrange(4)):
        at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
        w[at : at + (kind != 0)] = [] if kind == 1 else [rng.choice("abcdefgh ")]
    return " ".join("".join(w).split())


@pytest.mark.parametrize("least", [82, 90, 100])
def test_all_pairs_that_reach_the_score_are_found(spark, least):
    """Single misspelt words, short ones and some of several words in any order, against brute force over all pairs."""
    rng = random.Random(least)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 13))) for _ in range(60)] + ["ab cd efgh", "efgh ab cd", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "a b", "b a"]
    names = sorted({w for _ in range(500) if (w := misspelt(rng, words))} | {"b a"})
    canon = sorted(set(words))
    d = lambda x: spark.createDataFrame([(v,) for v in [*x, None]], "norm string")
    got = sorted((r["norm"], r["canon"], round(r["score"], 6)) for r in entities.similar_names(d(names), d(canon), least).collect())
    want = sorted((a, b, round(score(a, b), 6)) for a in names for b in canon if a != b and score(a, b) >= least)
    assert got == want and len(want) > 3


def test_hot_grams_are_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(entities, "POSTINGS", 3)
    canon = [f"common name {i:03d}" for i in range(40)]
    d = lambda x: spark.createDataFrame([(v,) for v in x], "norm string")
    got = {(r["norm"], r["canon"]) for r in entities.similar_names(d(["common name 0x7"]), d(canon)).collect()}
    assert got == {("common name 0x7", c) for c in canon if score("common name 0x7", c) >= 82} and len(got) > 20


def test_scores_of_eighty_or_less_are_refused(spark):
    with pytest.raises(ValueError):
        entities.similar_names(spark.createDataFrame([], "norm string"), spark.createDataFrame([], "norm string"), 80)


def resolved(spark, rows):
    canon = spark.createDataFrame([("man_utd", "Manchester United"), ("inter", "Internazionale"), ("porto", "Porto")], "canonical_id string, canonical_name string")
    aliases = spark.createDataFrame([(None, "Inter Milan", "inter"), ("x", "Reds", "man_utd"), ("y", "Reds", "porto")], "provider string, alias string, canonical_id string")
    ids = spark.createDataFrame([("x", "7", "porto"), ("x", None, "inter")], "provider string, provider_id string, canonical_id string")
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, raw_name string, provider string, provider_id string")
    return entities.resolve_entities(d, canon, aliases, ids), canon


def test_steps_of_the_cascade(spark):
    rows = [("Anything", "x", "7"), ("Inter Milan", "z", None), ("Reds", "x", None), ("Reds", "y", "7"), ("Man Utd", "x", "8"), ("Manchestr Unted", "x", None), ("Porta", "x", None), ("Poorto", None, None), ("Águilas", "x", None), (None, "x", None), ("  ", None, None), ("MÁNCHESTER  united", "x", None)]
    d, _ = resolved(spark, rows)
    got = {r["i"]: (r["canonical_id"], r["method"], r["score"], r["band"], r["needs_review"]) for r in d.collect()}
    assert got == {
        0: ("porto", "provider_id", 100.0, "high", False),
        1: ("inter", "alias", 100.0, "high", False),
        2: ("man_utd", "alias", 100.0, "high", False),
        3: ("porto", "alias", 100.0, "high", False),
        4: ("man_utd", "normalized_exact", 100.0, "high", False),
        5: ("man_utd", "fuzzy_auto", 93.75, "high", False),
        6: ("porta", "created", 0.0, "low", True),
        7: ("porto", "fuzzy_review", 90.909, "medium", True),
        8: ("aguilas", "created", 0.0, "low", True),
        9: ("unknown", "created", 0.0, "low", True),
        10: ("unknown", "created", 0.0, "low", True),
        11: ("man_utd", "normalized_exact", 100.0, "high", False),
    }


def test_queue_registry_and_what_the_next_run_knows(spark):
    rows = [("Poorto", "x", None), ("poorto", "x", None), ("Benfica", "x", None), ("Benfica", "y", None), ("Man Utd", "y", None)]
    d, canon = resolved(spark, rows)
    queue = {(r["provider"], r["normalized"], r["reason"]): r["rows"] for r in entities.review_queue(d).collect()}
    assert queue == {("x", "poorto", "score_between"): 2, ("x", "benfica", "no_match"): 1, ("y", "benfica", "no_match"): 1}
    assert {(r["canonical_id"], r["confidence"]) for r in entities.registered(canon, d).collect()} == {("man_utd", 1.0), ("inter", 1.0), ("porto", 1.0), ("benfica", 0.55)}
    learned = entities.learned_aliases(d)
    again = entities.resolve_entities(spark.createDataFrame([(0, "benfica", "x", None)], "i int, raw_name string, provider string, provider_id string"), entities.registered(canon, d).drop("confidence"), learned)
    assert [(r["canonical_id"], r["method"]) for r in again.collect()] == [("benfica", "alias")]


def test_empty_tables(spark):
    d, canon = resolved(spark, [])
    assert d.count() == 0 and entities.registered(canon, d).count() == 3
