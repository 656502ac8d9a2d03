import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyfield.llm import queries, spelling
from tests.llm.tables import documents
from tests.support import DATA, difference


def one_edit(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return len(b) == len(a) + 1 and b[:i] + b[i + 1 :] == a


def brute(rows):
    """Rows (doc_id, text) to the result by plain loops over all pairs of words."""
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def result(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def texts():
    """Words that vary in every way, in chains of growing counts, with ties, and some in which a letter is dropped."""
    rng, rows = random.Random(5), []
    for word in ("spelling", "variant", "grouping", "straße", "élève", "naïveté", "ÀÉÎÕÜß", "banana", "aaaaaa", "x×÷xyz"):
        w = list(word)
        for times, changes in ((700, 0), (90, 1), (12, 1), (6, 3), (5, 1), (5, 1)):
            for _ in range(changes):
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                w[at : at + (kind != 0)] = [] if kind == 1 else [rng.choice("abzéÿA")]
            rows += ["".join(w)] * times
    rng.shuffle(rows)
    return [(i, " ".join(rows[i::40]) + ("." if i % 2 else "\n42")) for i in range(40)]


def test_brute_force_with_edges(spark, tmp_path):
    rows = texts()
    rows += [(100, None), (101, ""), (102, "123 — ñ"), (7, rows[7][1]), (7, rows[7][1])]  # null, empty, no words, repeated rows
    rows += [(200 + i, ("abcdefghij" * 15_000)[: 150_000 - i % 2]) for i in range(12)]  # very long words, near each other
    want = brute(rows)
    assert any(r[1] and r[2] != r[1] for r in want)  # a form of a form
    got = queries.QUERIES["op13_spelling"](spark, documents(spark, tmp_path, [(i, t, "s") for i, t in rows]))
    assert result(got) == want


def test_whole_table_matches_sql(spark):
    sf = f"{DATA}/sf0.001"
    assert difference(queries.QUERIES["op13_spelling"](spark, sf), queries.ORACLE_SQL["op13_spelling"], sf) == ""


def test_null_ids_and_clashing_columns(spark):
    rows = [(None, "hello-world helloo world helloo " * 9), (3, "hellox " * 50)]
    d = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows], "doc_id long, text string, word string, n long, id long")
    assert result(spelling.variants(spelling.vocabulary(d))) == brute(rows)


def test_empty_table(spark, tmp_path):
    got = queries.QUERIES["op13_spelling"](spark, documents(spark, tmp_path, []))
    assert got.count() == 0 and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("symbols", [2, 5, 31])
def test_neighbourhoods_are_whole(symbols):
    rng = random.Random(symbols)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7))) for _ in range(200)]
    reduced = spelling.Reduced(words, symbols)
    own = dict(zip(words, reduced.hashes().tolist()))
    word, key = reduced.neighbours()
    around = {w: set() for w in words}
    for i, k in zip(word.tolist(), key.tolist()):
        around[words[i]].add(k)
    assert all(own[b] in around[a] for a in words for b in words if a == b or one_edit(a, b))


@pytest.mark.parametrize("short", [0, 64])
def test_one_edit(spark, monkeypatch, short):
    monkeypatch.setattr(spelling, "_SHORT", short)
    rng = random.Random(short)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 6))) for _ in range(60)] + ["ab" * 40, "ab" * 39 + "a", "ab" * 39 + "ac", "b" + "ab" * 39, "ba" * 40, "é" * 70, "é" * 71, "e" + "é" * 69, "é" * 69 + "e"]
    d = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    got = {(r["a"], r["b"]) for r in d.filter(spelling.one_edit("a", "b")).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_roots_of_a_long_chain(spark):
    chain = spark.range(1, 40).select(F.format_string("w%02d", "id").alias("word"), F.format_string("w%02d", F.col("id") - 1).alias("form"))
    assert {(r["word"], r["root"]) for r in spelling.roots(chain).collect()} == {(f"w{i:02d}", "w00") for i in range(1, 40)}


def test_no_words_are_sent_to_the_driver_to_be_broadcast(spark):
    words = spark.createDataFrame([(f"word{i:04d}x", i % 9 + 5) for i in range(300)], "word string, n long")
    plans = [spelling.near_words(words, 300), spelling.variants(words)]
    for plan in (p._jdf.queryExecution().executedPlan().toString() for p in plans):
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
