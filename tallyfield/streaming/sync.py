"""State of keys that are fetched again until it works: processed, failed, how often tried, when to try next."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyfield.sources.incremental import upsert
from tallyfield.session import drop_written, materialise
from tallyfield.sources.files import exists

ATTEMPT = "key string, at timestamp, ok boolean, error string"
STATE = "key string, status string, attempts long, retries long, first_at timestamp, last_at timestamp, processed_at timestamp, last_error string, retry_at timestamp"
#: Minutes until the first retry; each further one waits twice as long, up to MOST.
FIRST, MOST = 5, 24 * 60
_KEPT = "attempts long, retries long, first_us long, last_us long, processed_us long, last_error string"


def _moment(us):
    return None if us is None else pd.Timestamp(us, unit="us")


def _row(key: str, attempts: int, retries: int, first, last, processed, error) -> dict:
    wait = min(FIRST * 2 ** min(retries - 1, 30), MOST) if retries else None
    return {
        "key": key, "status": "failed" if retries else "processed", "attempts": attempts, "retries": retries, "first_at": _moment(first), "last_at": _moment(last),
        "processed_at": _moment(processed), "last_error": error, "retry_at": _moment(last + wait * 60_000_000) if retries else None,
    }


def after_attempts(attempts: DataFrame) -> DataFrame:
    """The state of each key after all its attempts (``ATTEMPT``), in one aggregate: the batch form of ``run_stream``.

    A success ends the retries before it; ``retries`` counts the failures
    since. Attempts without a key or time are left out; one whose outcome is
    null failed; of attempts of one key and time the failed one is the later.
    """
    d = attempts.filter("key IS NOT NULL AND at IS NOT NULL").withColumn("ok", F.coalesce("ok", F.lit(False)))
    place = F.struct("at", (~F.col("ok")).cast("int"))
    won = d.groupBy("key").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("processed_at"), F.count("*").alias("attempts"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max_by("error", F.when(~F.col("ok"), place)).alias("_error"))
    lost = d.filter("NOT ok").join(won.select("key", "processed_at"), "key").filter("processed_at IS NULL OR at >= processed_at").groupBy("key").agg(F.count("*").alias("retries"))
    s = won.join(lost, "key", "left").withColumn("retries", F.coalesce("retries", F.lit(0).cast("long")))
    failed = F.col("retries") > 0
    wait = F.least(FIRST * F.pow(F.lit(2.0), F.least(F.col("retries") - 1, F.lit(30))), F.lit(float(MOST)))
    retry = F.timestamp_micros(F.unix_micros("last_at") + (wait * 60_000_000).cast("long"))
    return s.select("key", F.when(failed, "failed").otherwise("processed").alias("status"), "attempts", "retries", "first_at", "last_at", "processed_at", F.when(failed, F.col("_error")).alias("last_error"), F.when(failed, retry).alias("retry_at"))


def _advance(key: tuple, batches, state: GroupState):
    """One key's attempts of a micro-batch, in order of time, on what is known of it."""
    count, retries, first, last, processed, error = state.get if state.exists else (0, 0, None, None, None, None)
    rows = [(us, ok is not True, said) for b in batches for us, ok, said in zip(b["us"].tolist(), b["ok"].tolist(), b["error"].tolist())]
    for us, lost, said in sorted(rows, key=lambda r: r[:2]):
        ok = not lost
        count, first, last = count + 1, us if first is None else min(first, us), us if last is None else max(last, us)
        retries, processed, error = (0, us, None) if ok else (retries + 1, processed, said)
    state.update((count, retries, first, last, processed, error))
    yield pd.DataFrame([_row(key[0], count, retries, first, last, processed, error)])


def run_stream(spark: SparkSession, attempts: DataFrame, folder: str) -> DataFrame:
    """Runs streaming attempts to their end and returns the state of all keys; the next run goes on from there.

    State lives in the stream's checkpoint below ``folder``, which is shared
    storage, and the latest row of each changed key is merged into a table,
    so a batch that runs again after a failure changes nothing. Attempts of a
    key arrive in order of time, batch by batch.
    """
    d = attempts.filter("key IS NOT NULL AND at IS NOT NULL").select("key", F.unix_micros("at").alias("us"), "ok", "error")
    told = d.groupBy("key").applyInPandasWithState(_advance, STATE, _KEPT, "update", GroupStateTimeout.NoTimeout)
    buckets = F.pmod(F.hash("key"), F.lit(16))

    def keep(batch: DataFrame, _: int) -> None:
        told = materialise(batch.withColumn("bucket", buckets), "sync")  # each use of a batch runs its states anew
        if not told.isEmpty():
            upsert(f"{folder}/state", told, ["key"], "bucket", ["attempts"])
        drop_written(told)

    run = told.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    if not exists(spark, f"{folder}/state"):
        return spark.createDataFrame([], STATE)
    return spark.read.parquet(f"{folder}/state").drop("bucket")


def to_retry(state: DataFrame, now, most: int = 5) -> DataFrame:
    """Failed keys whose time has come, those tried ``most`` times or more left out."""
    return state.filter((F.col("status") == "failed") & (F.col("retry_at") <= F.lit(now)) & (F.col("retries") < most))
