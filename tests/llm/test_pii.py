import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from tallyfield.llm import pii
from tests.llm.tables import collected, documents
from tests.support import DATA

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(d)) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 14 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 10 <= len(digits) <= 15)
            if ok:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def check(got, texts):
    for i, t in texts.items():
        want = base_spans(t or "")
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), (i, line, got[i]["spans"])
        assert [got[i][f"n_{k}"] for k in RULES] == [sum(w[0] == k for w in want) for k in RULES]
        assert {x for x in line.split(",") if x} <= set(got[i]["spans"].split(","))


def test_whole_table(spark):
    sf = f"{DATA}/sf0.001"
    check(collected(pii.op6_pii(spark, sf)), {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})


def test_edges(spark, tmp_path):
    texts = dict(enumerate(["", None, "a@b.c @x.y me@host", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 00255.0.0.1", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111", "+1 (212) 555-0100, +12345 +1 2.3-4(5)6 7 8 9 0 1", "\U0001f600 a@b.cd \U0001f600 +44 20 7946 0958", "x " * 100_000 + "z@y.xx", "١٢٣.1.1.1 9.9.9.9"]))
    check(collected(pii.op6_pii(spark, documents(spark, tmp_path, [(i, t, "s") for i, t in texts.items()]))), texts)


def test_redact_keeps_columns_and_rows(spark):
    d = spark.createDataFrame([(1, "mail a@b.cd now", 15, "x"), (1, "mail a@b.cd now", 15, "x"), (2, None, 0, "y")], "doc_id long, text string, n_chars long, spans string")
    out = pii.redact(d)
    assert out.columns == d.columns
    rows = sorted(out.collect(), key=lambda r: (r["doc_id"], r["text"] or ""))
    assert [r["text"] for r in rows] == ["mail <EMAIL> now", "mail <EMAIL> now", None]
    assert rows[0]["n_chars"] == 16 and [r["spans"] for r in rows] == ["x", "x", "y"]


def test_texts_with_very_many_hits(spark, tmp_path):
    r = random.Random(2)
    kinds = [lambda: f"u{r.randrange(10**6)}@h.org", lambda: f"10.0.{r.randrange(300)}.7", lambda: f"+4420{r.randrange(10**8)}", lambda: f"db_password=k{r.randrange(10**9)}q77x", lambda: "api_key=" + f"m{r.randrange(99)}@x.com", lambda: "plain words, \U0001f600"]
    texts = {1: " ".join(r.choice(kinds)() for _ in range(100_000)), 2: "1.2.3.4" + " 1.2.3.4" * 1023, 3: "a@b.cd"}
    d = documents(spark, tmp_path, [(i, t, "s") for i, t in texts.items()])
    began = time.perf_counter()
    got = collected(pii.op6_pii(spark, d))
    out = collected(pii.redact(spark.read.parquet(f"{d}/documents.parquet")))
    assert time.perf_counter() - began < 60
    check(got, texts)
    for i, t in texts.items():
        spans = [x.split(":") for x in got[i]["spans"].split(",")]
        at, parts = 0, []
        for kind, a, b in ((k, int(a), int(b)) for k, a, b in spans):
            parts += [t[at : max(a, at)], f"<{kind.upper()}>" if a >= at else ""]
            at = max(at, b)
        assert out[i]["text"] == "".join(parts) + t[at:]


def test_spans_that_overlap_others_go(spark):
    r = random.Random(5)
    rows = [([(a, a + r.randrange(1, 9)) for a in r.sample(range(900), n)], [(a, a + r.randrange(1, 9)) for a in r.sample(range(900), m)]) for n, m in ((0, 5), (5, 0), (80, 80), (300, 20), (1, 1))]
    span = "array<struct<start:long,end:long>>"
    got = spark.createDataFrame(rows, f"a {span}, b {span}").select("a", "b", pii._apart(F.col("a"), F.col("b")).alias("c")).collect()
    for x in got:
        want = sorted(tuple(s) for s in x["a"] if not any(o[0] < s[1] and s[0] < o[1] for o in x["b"]))
        assert sorted(tuple(s) for s in x["c"]) == want


def test_reliable_labelers_are_found():
    counts = {("card", (1, 1, 1, 1)): 90, ("card", (-1, -1, -1, -1)): 90, ("card", (1, 1, -1, 1)): 10, ("card", (-1, -1, 1, -1)): 10}
    _, rates, p = pii.reliabilities(counts)
    assert p["card", (1, 1, -1, 1)] > 0.9 > 0.1 > p["card", (-1, -1, 1, -1)]
    assert rates["card", 2][0] < rates["card", 0][0]


def test_named_values_of_long_names_are_proposed(spark):
    texts = ["db_password=hunter2xyz9", "production_database_password=hunter2xyz9", "x" * 100_000 + " a=b"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    got = d.selectExpr(f"regexp_extract_all(text, r'{pii.SECRET.replace(chr(39), chr(92) + 'x27')}', 0) AS hits").collect()
    assert [r["hits"] for r in got] == [[texts[0]], [texts[1]], []]


def test_empty_table(spark, tmp_path):
    assert pii.op6_pii(spark, documents(spark, tmp_path, [])).count() == 0
