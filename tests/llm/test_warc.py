import random

from tallyfield.llm import warc
from tallyfield.session import fresh_path
from tests.llm.tables import table
from tests.support import DATA, difference

SCHEMA = "page_id long, url string, html string"


def test_query_matches_sql(spark):
    sf = f"{DATA}/sf0.001"
    assert difference(warc.op7_warc(spark, sf), warc.OP7_SQL, sf) == ""


def test_edges(spark, tmp_path):
    rows = [(1, "http://a.example/x", "same"), (2, None, "same"), (3, "b", None), (4, "c", ""), (5, "d\r\nX: y", "é\r\n\r\n" * 50_000), (6, "http://a.example/x", "one"), (9, "https://u@www.A.example:81/q?#f", "z"), (10, None, "n"), (11, "http://x..example", "m")]
    sf = table(spark, tmp_path, "pages", rows, SCHEMA)
    assert difference(warc.op7_warc(spark, sf), warc.OP7_SQL, sf) == ""


def test_histories_are_in_global_order(spark):
    rows = [(i, f"http://h{i % 3}.example/{i % 7}", f"t{i % 5}") for i in range(200)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(6).withColumn("ts", warc.capture_time())
    folder = fresh_path(spark, "warc-test")
    merged = warc.merge_indexes(warc.write_archives(pages, folder), 4)
    rows = merged.orderBy("place").collect()
    keys = [(r["url_key"], r["ts"], r["page_id"]) for r in rows]
    assert keys == sorted(keys) and [r["place"] for r in rows] == list(range(1, 201)) and len({r["range"] for r in rows}) == 4
    records = {r["page_id"]: r for r in warc.read_archives(merged, folder).collect()}
    placed = sorted(records.values(), key=lambda r: r["place"])
    assert [(warc.url_key(r["url"]), r["ts"], r["page_id"]) for r in placed] == keys
    assert bytes(records[3]["payload"]) == b"t3" and records[8]["payload"] is None and records[8]["refers_to"] == 3


def test_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "u", "same"), (None, "u", "other"), (2**60 + 1, "u", "same"), (2**60 + 3, "v", "same"), (7, "u", "x"), (7, "u", "y"), (8, "w", "x"), (8, "w", "y"), (8, "w", "z")]
    sf = table(spark, tmp_path, "pages", [(*r, "gone", 1) for r in rows], f"{SCHEMA}, record_type string, place int")
    assert difference(warc.op7_warc(spark, sf).select("page_id", "capture_ts", "history_place"), f"SELECT page_id, capture_ts, history_place FROM ({warc.OP7_SQL})", sf) == ""
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.op7_warc(spark, sf).collect()), key=repr)
    want = [(None, 4, "response", None), (None, 5, "response", None), (2**60 + 1, 4, "response", None), (2**60 + 3, 4, "revisit", 2**60 + 1), (7, 1, "response", None), (7, 1, "response", None), (8, 1, "revisit", 7), (8, 1, "revisit", 7), (8, 1, "response", None)]
    assert got == sorted(want, key=repr)


def test_small_payloads_stay_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "v", "ab"), (3, "w", "abcd"), (4, "x", "abcd")], SCHEMA).withColumn("ts", warc.capture_time())
    folder = fresh_path(spark, "warc-test")
    got = {r["page_id"]: r["record_type"] for r in warc.read_archives(warc.merge_indexes(warc.write_archives(pages, folder, least_bytes=3)), folder).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_loser_tree():
    r = random.Random(2)
    for n in (0, 1, 2, 3, 7, 8):
        runs = [sorted(r.choices(range(50), k=r.randrange(20))) for _ in range(n)]
        assert list(warc.LoserTree(runs)) == sorted(x for run in runs for x in run)


def test_empty_table(spark, tmp_path):
    assert warc.op7_warc(spark, table(spark, tmp_path, "pages", [], SCHEMA)).count() == 0
