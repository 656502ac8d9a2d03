"""Session set-up and the shared folder that every operator writes through."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_ROOT = os.path.dirname(os.path.abspath(__file__))


def local_session(app: str = "tallyfield", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per context.

    Workers on other machines don't have the driver's import path, so the
    package travels as a zip through ``addPyFile``. Where the size of Arrow
    batches is left at its default, it is lowered for long texts.
    """
    if spark.conf.get(_BATCH) == "10000":  # Spark's default: thousands of long texts at once in a worker
        spark.conf.set(_BATCH, "1000")
    sc = spark.sparkContext
    if getattr(sc, "_tallyfield_shipped", False):
        return
    fd, path = tempfile.mkstemp(prefix="tallyfield_", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(_ROOT):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tallyfield", os.path.relpath(full, _ROOT)))
    sc.addPyFile(path)
    sc._tallyfield_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all machines share.

    Only where that is unset, as in local tests, a temporary folder is set.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = getattr(sc, "_tallyfield_dir", None)
        if path is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            path = sc._tallyfield_dir = "file://" + tempfile.mkdtemp(prefix="tallyfield_")
            sc.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tallyfield/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, compression: str = "zstd", level: int = 3) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    A lost executor costs the tasks in flight only, and a value that depends
    on where a row happened to sit (a partition number) is fixed from here on.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", compression).option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, keys: list[str], rows: int = 250_000) -> DataFrame:
    """``df`` dealt out by ``keys`` to as many tasks as it has ``rows`` rows, the default parallelism at least.

    What a task sorts or groups by these keys stays in bounds as the table
    grows, unless one key has more rows. Reads the table once more, to count.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *keys)


def drop_written(table: DataFrame) -> None:
    """Delete a table written by ``materialise`` once nothing reads it: what was made of it must be written itself.

    Anything that doesn't lie in the folder of ``fresh_path`` is left alone.
    """
    files = table.inputFiles()
    if not files:
        return
    spark = table.sparkSession
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs.Path
    path, own = hadoop(files[0].rsplit("/", 1)[0]), hadoop(f"{shared_dir(spark)}/tallyfield")
    if path.getParent() is None or path.getParent().toUri().getPath() != own.toUri().getPath():
        return
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
