"""Queries over what is kept between runs: histories, files read, keys to fetch again; and optimal stakes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions import pricing
from tallyfield.operators import portfolio
from tallyfield.plans.bindings import table
from tallyfield.session import fresh_path
from tallyfield.sources import incremental
from tallyfield.streaming import sync

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


@query("""SELECT o_orderkey, year(o_orderdate) AS year, round((1.5 + o_orderkey % 40 / 10.0) / (CASE WHEN o_orderkey % 3 = 0 THEN 1.4 ELSE 1.6 END + o_orderkey % 40 / 10.0) - 1, 6) AS clv, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS revision
FROM orders WHERE o_orderstatus <> 'P'""")
def clv_history(spark, d):
    """Closing-line values of settled orders, kept by key: a first run, a second with later closing prices of some and all others, and the second once more."""
    o = table(spark, d, "orders").filter("o_orderstatus <> 'P'")
    entry, base = 1.5 + F.col("o_orderkey") % 40 / 10, F.col("o_orderkey") % 40 / 10

    def run(rows, closing, revision):
        clv = F.round(pricing.clv(entry, F.lit(closing) + base), 6)
        return rows.select("o_orderkey", F.year("o_orderdate").alias("year"), clv.alias("clv"), F.lit(revision).alias("revision"))

    path = fresh_path(spark, "clv-history")
    first = run(o.filter("o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0"), 1.6, 1)
    second = run(o.filter("o_orderkey % 3 = 0"), 1.4, 2)
    for rows in (first, second, second):
        kept = incremental.upsert(path, rows, ["o_orderkey"], "year", ["revision"])
    return kept.select("o_orderkey", F.col("year").cast("long").alias("year"), "clv", "revision")


@query("SELECT event_type, count(*) AS first_run, 0 AS second_run, sum(event_id) AS ids FROM events GROUP BY 1")
def changed_files(spark, d):
    """Rows by event type that a first run reads, and those that a second finds, nothing having changed."""
    root, state = f"{d}/events.parquet", fresh_path(spark, "files-read")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table(spark, d, "events").schema)
    first, _, commit = incremental.read_changed(spark, root, "parquet", schema, state)
    commit()
    second, _, _ = incremental.read_changed(spark, root, "parquet", schema, state)
    runs = first.withColumn("_run", F.lit(1)).unionByName(second.withColumn("_run", F.lit(2)))
    count = lambda n: F.sum((F.col("_run") == n).cast("long"))
    return runs.groupBy("event_type").agg(count(1).alias("first_run"), count(2).alias("second_run"), F.sum("event_id").alias("ids"))


_SYNC = """WITH a AS (SELECT CAST(user_id AS VARCHAR) AS key, ts AS t, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN 'e' || event_id END AS error FROM events),
w AS (SELECT key, max(t) FILTER (ok) AS processed_at, count(*) AS attempts, min(t) AS first_at, max(t) AS last_at, arg_max(error, t) FILTER (NOT ok) AS error FROM a GROUP BY 1),
r AS (SELECT w.key, count(*) AS retries FROM a JOIN w USING (key) WHERE NOT ok AND (processed_at IS NULL OR t >= processed_at) GROUP BY 1)
SELECT key, CASE WHEN retries > 0 THEN 'failed' ELSE 'processed' END AS status, attempts, coalesce(retries, 0) AS retries, first_at, last_at, processed_at, CASE WHEN retries > 0 THEN error END AS last_error,
 CASE WHEN retries > 0 THEN last_at + to_minutes(CAST(least(5 * pow(2, retries - 1), 1440) AS BIGINT)) END AS retry_at FROM w LEFT JOIN r USING (key)"""


def _attempts(events):
    return events.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error"))


@query(_SYNC)
def sync_state(spark, d):
    """Users as keys and their errors as failed attempts: what is processed, failed and to be tried again."""
    return sync.after_attempts(_attempts(table(spark, d, "events")))


@query(_SYNC)
def sync_stream(spark, d):
    """The same state, kept by a stream over the files of the events."""
    e = table(spark, d, "events")
    return sync.run_stream(spark, _attempts(spark.readStream.schema(e.schema).parquet(f"{d}/events.parquet*")), fresh_path(spark, "sync"))


@query()
def portfolio_optimised(spark, d):
    """Every candidate's share of the bankroll, the best stakes of each day within limits."""
    e = table(spark, d, "events").select("event_id", F.to_date("ts").alias("day"), "event_type", (0.3 + (F.col("event_id") * 37 % 500) / 1000).alias("p"), F.round(1.3 + (F.col("event_id") % 240) / 100, 2).alias("odd"))
    named = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in {"click": "goals", "view": "btts", "error": "corners", "signup": "shots"}.items()], F.col("event_type"))
    c = e.withColumn("market", named).withColumn("share", pricing.kelly(F.col("p"), F.col("odd")))
    return portfolio.optimal_shares(c, "day", "event_id", "market", "share").select("event_id", "day", "share", "portfolio_share", "method")
