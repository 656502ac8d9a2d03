"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, repeated up to
``max_epochs`` times. The copy of a document at which its source has sent c
tokens finishes at virtual time c / weight. All copies are range-sorted by
finish time and the mix is what comes before the total budget is used up, so
busy sources share by weight, and what a used-up source leaves is shared by
the rest: the same point that water-filling the targets gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.prefix import running_totals, spread_key
from tallyfield.session import materialise

#: What separates words: space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text"):
    """Number of words of a text column, 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """Adds weight and target to rows (source_key, source_size), one a source.

    Sources by key weigh ``weights`` in turn. The budget is the sum of all
    sizes; a target is weight times the level at which min(weight * level,
    max_epochs * size) sums to it. One row a source passes one window.
    """
    by_key, ranked = Window.orderBy("source_key"), Window.orderBy("_fills", "source_key")
    place = (F.row_number().over(by_key) - 1) % len(weights)
    d = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    d = d.withColumn("_cap", F.col("source_size") * max_epochs).withColumn("_fills", F.col("_cap") / F.col("weight"))
    whole = Window.partitionBy()
    d = d.withColumn("_before", F.coalesce(F.sum("_cap").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.withColumn("_busy", F.sum("weight").over(ranked.rowsBetween(0, Window.unboundedFollowing)))
    d = d.withColumn("_level", (F.sum("source_size").over(whole) - F.col("_before")) / F.col("_busy"))
    d = d.withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_fills"), F.col("_level"))).over(whole))
    d = d.withColumn("target", F.least(F.col("weight") * F.col("_level"), F.col("_cap").cast("double")))
    return d.select("source_key", "source_size", "weight", "target")


def queue_times(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = 3, seed: str = "mix", keep: list[str] = ()) -> DataFrame:
    """Every document with its size, its source's figures and ``queued``, the tokens of its source up to and with it."""
    source_key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col("source")))
    base = docs.select("doc_id", *keep, source_key.alias("source_key"), word_count().alias("size"), spread_key("doc_id", seed=seed).alias("shuffle_key"))
    base = materialise(base, "mix-base")
    sources = materialise(source_targets(base.groupBy("source_key").agg(F.sum("size").alias("source_size")), weights, max_epochs), "mix-sources")
    rows = base.count()
    queued = running_totals(base, "source_key", "shuffle_key", ["doc_id"], "size", "queued", rows)
    return materialise(queued.join(sources, "source_key").withColumn("queued", F.col("queued") + F.col("size")), "mix-queue")


def copies(queue: DataFrame, max_epochs: int) -> DataFrame:
    """A row for each copy of a document of a positive size, with its virtual finish time."""
    d = queue.filter("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    return d.withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("queued")) / F.col("weight"))


_ORDER = ["finish", "shuffle_key", "doc_id", "epoch"]


#: Copies that one task adds up in order.
CUT_ROWS = 100_000


def cut_point(queue: DataFrame, max_epochs: int, most: int = CUT_ROWS) -> tuple | None:
    """The last copy, in finish order, with which the mix stays within the budget.

    Copies are range-sorted by finish time. Totals of the ranges (one row a
    range) tell in which one the budget ends; that one is range-sorted again,
    until it holds ``most`` different copies or fewer, which are added up row
    by row. Copies of equal keys are one row by then.
    """
    spark = queue.sparkSession
    budget = queue.agg(F.sum("size")).first()[0] or 0
    rows = copies(queue, max_epochs).select(*_ORDER, F.col("size").alias("total"), "size")
    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    start, last, most_left = 0, None, None
    while most_left is None or most_left > most:
        ranged = materialise(rows.repartitionByRange(tasks, *_ORDER).withColumn("range", F.spark_partition_id()), "mix-ranges")
        totals = ranged.groupBy("range").agg(F.sum("total").alias("sum"), F.count("*").alias("rows"))
        ends = totals.withColumn("end", F.sum("sum").over(Window.orderBy("range")) + start)
        found = ends.filter(F.col("end") > budget).orderBy("range").select("range", "rows", (F.col("end") - F.col("sum")).alias("start")).first()
        if found is None:
            return None
        start, most_left = found["start"], found["rows"]
        before = ranged.filter(F.col("range") < found["range"]).select(F.max(F.struct(*_ORDER)).alias("last")).first()["last"]
        last = before or last  # should the budget end with the range before
        rows = ranged.filter(F.col("range") == found["range"]).groupBy(*_ORDER).agg(F.sum("total").alias("total"), F.min("size").alias("size"))
    sent = rows.withColumn("sent", F.sum("total").over(Window.orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)) - F.col("total") + F.col("size"))
    within = sent.filter(F.col("sent") + start <= budget).select(F.max(F.struct(*_ORDER)).alias("last")).first()["last"] or last
    return tuple(within) if within else (float("-inf"), 0, 0, 0)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = 3, seed: str = "mix", keep: list[str] = ()) -> DataFrame:
    """How often the mix takes each document.

    Returns a row for each row of ``docs``: doc_id, ``keep``, size,
    source_size, weight, target and times (0 to ``max_epochs``).

    Null texts have size 0 and are taken 0 times, as are empty ones. Documents
    without a source form a source of their own, the last. Rows that share a
    doc_id each count; equal copies at the cut go the same way. An empty table
    gives an empty one. Columns beyond doc_id, text and source are ignored.
    """
    queue = queue_times(docs, weights, max_epochs, seed, keep)
    cut = cut_point(queue, max_epochs)
    times = F.lit(0)
    if cut is None:
        times = F.when(F.col("size") > 0, F.lit(max_epochs)).otherwise(0)
    else:
        for e in range(max_epochs):
            one = F.col("size") > 0
            finish = (e * F.col("source_size") + F.col("queued")) / F.col("weight")
            late = _not_after_epoch(cut, finish, e)
            times = times + F.when(one & late, 1).otherwise(0)
    return queue.withColumn("times", times).drop("source_key", "shuffle_key", "queued")


def _not_after_epoch(cut: tuple, finish, epoch: int):
    at, key, doc, last = cut
    doc_id = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    doc = -(2**63) if doc is None else doc
    tied = (F.col("shuffle_key") < F.lit(key)) | ((F.col("shuffle_key") == F.lit(key)) & ((doc_id < F.lit(doc)) | ((doc_id == F.lit(doc)) & F.lit(epoch <= last))))
    return (finish < F.lit(at)) | ((finish == F.lit(at)) & tied)


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it. Columns may have any names beside doc_id, text and source.

    Rows are numbered once; the numbers are mixed, and the texts join them at
    the end, by a shuffle at any size.
    """
    rows = materialise(docs.select(F.struct(*docs.columns).alias("_row"), F.monotonically_increasing_id().alias("_at")), "mix-rows")
    times = mix_sources(rows.select("_at", "_row.doc_id", "_row.text", "_row.source"), weights, max_epochs, seed, keep=["_at"]).filter("times > 0").select("_at", "times")
    return rows.join(times.hint("merge"), "_at").select("_row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("_row.*")


def op1_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mix = mix_sources(docs)
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


#: The same mix in DuckDB: window sums over all rows in one order.
OP1_SQL = r"""
WITH base AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS source_key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix' || chr(1) || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS shuffle_key
  FROM documents),
sizes AS (SELECT source_key, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY 1),
weighed AS (SELECT *, CAST((row_number() OVER (ORDER BY source_key) - 1) % 3 + 1 AS DOUBLE) AS weight FROM sizes),
filled AS (SELECT *, source_size * 3 / weight AS fills FROM weighed),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY fills, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY fills, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM filled),
targets AS (
  SELECT source_key, source_size, weight,
         least(weight * max(CASE WHEN level <= fills THEN level END) OVER (), CAST(source_size * 3 AS DOUBLE)) AS target FROM levels),
queue AS (
  SELECT doc_id, size, shuffle_key, source_size, weight, target,
         sum(size) OVER (PARTITION BY source_key ORDER BY shuffle_key, doc_id ROWS UNBOUNDED PRECEDING) AS queued
  FROM base JOIN targets USING (source_key)),
copies AS (SELECT doc_id, size, shuffle_key, epoch, (epoch * source_size + queued) / weight AS finish FROM queue, range(3) r(epoch) WHERE size > 0),
sent AS (SELECT *, sum(size) OVER (ORDER BY finish, shuffle_key, doc_id, epoch ROWS UNBOUNDED PRECEDING) AS total FROM copies),
taken AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM sent WHERE total <= (SELECT sum(size) FROM base) GROUP BY 1)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM queue LEFT JOIN taken USING (doc_id)
"""
