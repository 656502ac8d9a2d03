"""The ledger of signals: pending until its outcome is known, settled once.

``settle`` is the batch form. ``run_stream`` keeps the same ledger up to date
over a stream of files: each micro-batch joins its signals and outcomes to
what was pending before and writes a version of its own, so a batch that runs
again after a failure gives the same version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfield.sources.files import exists

LEDGER = "signal_id string, due date, odd double, stake double, status string, is_win boolean, profit double, settled_on date"


def select_new(signals: DataFrame, date: str, after, until) -> DataFrame:
    """Signals dated after the high-water mark (null: no mark) and not after ``until``."""
    late = F.lit(True) if after is None else F.col(date) > F.lit(after)
    return signals.filter(late & (F.col(date) <= F.lit(until)))


def first_of_each(signals: DataFrame, order: list[str]) -> DataFrame:
    """One row a signal_id: the first by ``order``."""
    w = Window.partitionBy("signal_id").orderBy(*order)
    return signals.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def settle(signals: DataFrame, outcomes: DataFrame, today: Column) -> DataFrame:
    """The ledger of ``signals`` (signal_id, due, odd, stake) and ``outcomes`` (signal_id, is_win).

    A signal settles if it is due, its outcome is known and its price is above
    1; else it stays pending. A profit is stake * (odd - 1) or -stake.
    """
    known = outcomes.filter("is_win IS NOT NULL").groupBy("signal_id").agg(F.max("is_win").alias("_won"))
    ok = F.coalesce((F.col("due") <= today) & F.col("_won").isNotNull() & (F.col("odd") > 1), F.lit(False))
    profit = F.round(F.when(F.col("_won"), F.col("stake") * (F.col("odd") - 1)).otherwise(-F.col("stake")), 4)
    return signals.join(known, "signal_id", "left").select(
        "signal_id", "due", "odd", "stake", F.when(ok, "SETTLED").otherwise("PENDING").alias("status"),
        F.when(ok, F.col("_won")).alias("is_win"), F.when(ok, profit).alias("profit"), F.when(ok, today).alias("settled_on"),
    )


def next_version(ledger: DataFrame, signals: DataFrame, outcomes: DataFrame, today: Column) -> DataFrame:
    """A cycle: signals not in the ledger join it once, pending ones are tried again, settled ones stay as they are."""
    fresh = first_of_each(signals, ["due", "odd", "stake"]).join(ledger.select("signal_id"), "signal_id", "left_anti")
    tried = ledger.filter("status = 'PENDING'").select("signal_id", "due", "odd", "stake").unionByName(fresh.select("signal_id", "due", "odd", "stake"))
    return ledger.filter("status = 'SETTLED'").unionByName(settle(tried, outcomes, today))


def run_stream(spark: SparkSession, signals: DataFrame, outcomes: DataFrame, folder: str, today) -> DataFrame:
    """Runs the streaming ``signals`` to their end and returns the ledger; ``outcomes`` is a table that may grow between runs.

    ``folder`` is shared storage: versions of the ledger by batch, and the
    stream's checkpoint. The next run goes on from there. ``today`` is a date.
    """
    day = F.lit(today).cast("date")

    def cycle(batch: DataFrame, batch_id: int) -> None:
        before = _version(batch.sparkSession, folder, batch_id - 1)
        next_version(before, batch, outcomes, day).write.mode("overwrite").parquet(f"{folder}/versions/batch={batch_id}")

    started = signals.writeStream.foreachBatch(cycle).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    last = started.lastProgress["batchId"] if started.lastProgress else -1
    return _version(spark, folder, last)


def _version(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """The ledger after a batch: its own version or, if it had no rows, the one before."""
    while batch_id >= 0 and not exists(spark, f"{folder}/versions/batch={batch_id}/_SUCCESS"):
        batch_id -= 1
    return spark.read.schema(LEDGER).parquet(f"{folder}/versions/batch={batch_id}") if batch_id >= 0 else spark.createDataFrame([], LEDGER)


def hourly_counts(events: DataFrame, ts: str, key: str, value: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums by hour and key, batch or stream; a stream drops what is later than ``late``."""
    d = events.withWatermark(ts, late) if events.isStreaming else events
    return d.groupBy(F.window(ts, "1 hour").alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("hour"), key, "n", "total")
