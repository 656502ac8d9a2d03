"""Versions of fitted pipelines and of the curves that calibrate them, in shared storage."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.operators import learning
from tallyfield.sources.files import exists

RECORD = "market string, version int, kind string, columns array<string>, trained_on string, auc double, brier double, calibrated boolean"


def records(spark: SparkSession, root: str) -> DataFrame:
    """What is known of all committed versions, a row each."""
    return spark.read.schema(RECORD).parquet(f"{root}/records/*") if exists(spark, f"{root}/records") else spark.createDataFrame([], RECORD)


def register(spark: SparkSession, root: str, market: str, model: PipelineModel, kind: str, columns: list[str], trained_on: str, auc: float | None = None, brier: float | None = None, curve: IsotonicRegressionModel | None = None) -> int:
    """Saves a model, and its curve if it has one, as the market's next version, and returns that.

    The record is written last: a version without one isn't there, and a run
    that failed before takes the same number again.
    """
    last = records(spark, root).filter(F.col("market") == market).agg(F.max("version")).first()[0]
    version = 1 if last is None else last + 1
    folder = f"{root}/models/{market}/version={version}"
    model.write().overwrite().save(f"{folder}/pipeline")
    if curve is not None:
        curve.write().overwrite().save(f"{folder}/curve")
    row = (market, version, kind, columns, trained_on, auc, brier, curve is not None)
    spark.createDataFrame([row], RECORD).coalesce(1).write.mode("overwrite").parquet(f"{root}/records/{market}-{version}")
    return version


def latest(spark: SparkSession, root: str) -> DataFrame:
    """The last version of each market."""
    every = records(spark, root)
    return every.groupBy("market").agg(F.max_by(F.struct(*every.columns), "version").alias("r")).select("r.*")


def score_registered(df: DataFrame, root: str, market: str, version: int | None = None, name: str = "probability") -> DataFrame:
    """Adds the probability by a registered version (None: the last), calibrated if the version has a curve, and model_version."""
    spark = df.sparkSession
    known = records(spark, root).filter(F.col("market") == market)
    row = (known if version is None else known.filter(F.col("version") == version)).orderBy(F.desc("version")).first()
    if row is None:
        raise LookupError(f"no version {version} of {market}")
    folder = f"{root}/models/{market}/version={row['version']}"
    out = learning.score(PipelineModel.load(f"{folder}/pipeline"), df, name)
    if row["calibrated"]:
        out = learning.calibrated(IsotonicRegressionModel.load(f"{folder}/curve"), out, name, name)
    return out.withColumn("model_version", F.lit(row["version"]))
