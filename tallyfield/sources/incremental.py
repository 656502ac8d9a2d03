"""Reading only the files that changed, and merging rows into a partitioned table again and again."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfield.session import materialise
from tallyfield.sources.files import exists

LISTING = "path string, length long, modified timestamp"


def listing(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """path, length and modified of the files below ``root`` that aren't empty; their bytes aren't read."""
    if not exists(spark, root):
        return spark.createDataFrame([], LISTING)
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(root)
    return d.filter("length > 0").select("path", "length", F.col("modificationTime").alias("modified"))


def _versions(spark: SparkSession, state: str) -> list[int]:
    """Finished versions of a manifest, in order."""
    if not exists(spark, state):
        return []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(state)
    names = [f.getPath().getName() for f in folder.getFileSystem(conf).listStatus(folder)]
    found = sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))
    return [v for v in found if exists(spark, f"{state}/version={v}/_SUCCESS")]


def known_files(spark: SparkSession, state: str) -> DataFrame:
    """The files that were read so far."""
    done = _versions(spark, state)
    return spark.read.schema(LISTING).parquet(f"{state}/version={done[-1]}") if done else spark.createDataFrame([], LISTING)


def changes(now: DataFrame, known: DataFrame) -> DataFrame:
    """path and change (new, changed, gone, same) of all files of either listing."""
    before = known.select("path", F.struct("length", "modified").alias("_was"))
    both = now.select("path", F.struct("length", "modified").alias("_is")).join(before, "path", "full")
    kind = F.when(F.col("_was").isNull(), "new").when(F.col("_is").isNull(), "gone").when(F.col("_is") == F.col("_was"), "same").otherwise("changed")
    return both.select("path", kind.alias("change"))


def read_changed(spark: SparkSession, root: str, suffix: str, schema: str, state: str):
    """Rows of the files that are new or changed since the last committed run, with source_path; what changed; and ``commit``.

    ``suffix`` is parquet, csv or json (lines). ``commit()`` writes the
    listing that was read as the next version of the manifest, once the caller
    is done: a run that fails before reads the same files again. Nothing new
    gives no rows. The driver names the changed files to the reader, as it
    does for every read.
    """
    now = materialise(listing(spark, root, suffix), "listing")
    found = materialise(changes(now, known_files(spark, state)), "changes")
    paths = [r["path"] for r in found.filter("change IN ('new', 'changed')").orderBy("path").collect()]
    reader = spark.read.schema(schema)
    if suffix == "csv":
        reader = reader.option("header", "true")
    rows = reader.format(suffix).load(paths).withColumn("source_path", F.col("_metadata.file_path")) if paths else spark.createDataFrame([], f"{schema}, source_path string")

    def commit() -> None:
        done = _versions(spark, state)
        now.write.mode("overwrite").parquet(f"{state}/version={(done[-1] + 1) if done else 0}")

    return rows, found, commit


def checksums(files: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """path and sha256 of each file, read ``chunk`` bytes at a time, so a file of any size fits. For stores that pyarrow reads."""

    def run(batches):
        from pyarrow import fs

        for pdf in batches:
            out = []
            for path in pdf["path"]:
                store, place = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
                digest = hashlib.sha256()
                with store.open_input_stream(place) as f:
                    while part := f.read(chunk):
                        digest.update(part)
                out.append((path, digest.hexdigest()))
            yield pd.DataFrame(out, columns=["path", "sha256"])

    return files.select("path").mapInPandas(run, "path string, sha256 string")


def upsert(table: str, new: DataFrame, keys: list[str], partition: str, order: list[str]) -> DataFrame:
    """Merges rows into the Parquet table at ``table`` by key and returns it: of a key the last row by ``order`` stays, the new one of equals.

    Only partitions that ``new`` touches are read and written again (dynamic
    partition overwrite), so doing it twice changes nothing, and one that
    fails midway can be done again. ``partition`` is a column that follows
    from the key, such as the date a key belongs to.
    """
    spark = new.sparkSession
    merged = new.withColumn("_new", F.lit(1))
    if exists(spark, table):
        touched = new.select(partition).distinct()
        old = spark.read.parquet(table)
        kept = old.join(touched, old[partition].eqNullSafe(touched[partition]), "left_semi").withColumn("_new", F.lit(0))
        merged = kept.unionByName(merged, allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order], F.desc("_new"))
    merged = merged.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_new")
    merged = materialise(merged, "upsert")  # the table can't be read while it is written
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(table)
    return spark.read.parquet(table)
