"""Files in several formats as one DataFrame, manifests, and dated snapshots with a latest one."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.session import drop_written, materialise

#: Fields under which a JSON file may keep its list of records.
LISTS = ["data", "matches", "events", "games"]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reaches."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_first(spark: SparkSession, base: str, columns: list[str] | None = None, required: bool = True) -> DataFrame | None:
    """The table at ``base`` + .parquet, .parquet.csv or .csv, the first that is there; only ``columns`` of it that it has.

    None without any, or FileNotFoundError if it is required.
    """
    for suffix, kind in ((".parquet", "parquet"), (".parquet.csv", "csv"), (".csv", "csv")):
        if exists(spark, base + suffix):
            df = spark.read.parquet(base + suffix) if kind == "parquet" else spark.read.csv(base + suffix, header=True)
            return df.select(*[c for c in columns if c in df.columns]) if columns else df
    if required:
        raise FileNotFoundError(base)
    return None


def write_table(df: DataFrame, path: str, csv_twin: bool = False) -> dict[str, object]:
    """Writes Parquet, and CSV beside it if asked for; returns the paths and columns."""
    df.write.mode("overwrite").parquet(path)
    made: dict[str, object] = {"parquet": path, "columns": df.columns}
    if csv_twin:
        made["csv"] = path.removesuffix(".parquet") + ".csv"
        df.sparkSession.read.parquet(path).write.mode("overwrite").csv(str(made["csv"]), header=True)
    return made


def _records(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.json(path, multiLine=True)
    for name in LISTS:
        if name in df.columns and df.schema[name].dataType.simpleString().startswith("array<struct"):
            return df.select(F.inline(name))
    return df


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """A table from .json (a list, or one under a field of ``LISTS``), .jsonl, .csv or .parquet, with headers made uniform."""
    kind = path.rsplit(".", 1)[-1].lower()
    readers = {"json": lambda: _records(spark, path), "jsonl": lambda: spark.read.json(path), "csv": lambda: spark.read.csv(path, header=True), "parquet": lambda: spark.read.parquet(path)}
    if kind not in readers:
        raise ValueError(f"no reader for {path}")
    return uniform_headers(readers[kind]())


def uniform_headers(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Trimmed lower-case names with underscores, then renamed by ``aliases``; a name that is taken already keeps its first column."""
    out: dict[str, Column] = {}
    for c in df.columns:
        name = "_".join(c.strip().lower().replace("-", " ").split())
        out.setdefault((aliases or {}).get(name, name), F.col(f"`{c}`"))
    return df.select(*[x.alias(n) for n, x in out.items()])


def union_files(spark: SparkSession, paths: list[str], aliases: dict[str, str] | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """Rows of all files, by column name and as text, with source_file; and what failed, by path."""
    whole, failed = None, {}
    for path in paths:
        try:
            df = uniform_headers(read_file(spark, path), aliases)
            df = df.select(*[F.to_json(c).alias(c) if k.startswith(("array", "struct", "map")) else F.col(c).cast("string").alias(c) for c, k in df.dtypes]).withColumn("source_file", F.lit(path.rsplit("/", 1)[-1]))
        except (AnalysisException, ValueError) as e:
            failed[path] = str(e).splitlines()[0][:200]
            continue
        whole = df if whole is None else whole.unionByName(df, allowMissingColumns=True)
    return whole, failed


def manifest(spark: SparkSession, root: str, suffixes: list[str]) -> DataFrame:
    """path, length, modified and sha256 of every file that isn't empty below ``root``, for these suffixes."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(root)
    return d.filter("length > 0").select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def merge_captured(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: each column's first filled value along ``order``."""
    rest = [c for c in rows.columns if c not in (key, order)]
    filled = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    return rows.groupBy(key).agg(*[F.min_by(c, F.when(filled(c), F.col(order))).alias(c) for c in rest])


def write_snapshot(df: DataFrame, root: str, label: str) -> str:
    """A snapshot under ``root``/snapshot=label, and the same rows as ``root``/latest."""
    path = f"{root}/snapshot={label}"
    df.write.mode("overwrite").parquet(path)
    df.sparkSession.read.parquet(path).write.mode("overwrite").parquet(f"{root}/latest")
    return path


def keep_last(history: DataFrame, new: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of a history and what is new to it."""
    return history.unionByName(new, allowMissingColumns=True).orderBy(*[F.col(c).desc() for c in order]).limit(n)


def append_bounded(path: str, new: DataFrame, order: list[str], n: int) -> DataFrame:
    """A store of JSON lines that keeps its last ``n`` rows: writes them, and returns what a reader finds.

    Times keep their microseconds. The rows written come from a table of their
    own, so that a store is not overwritten while it is read; a run that is
    repeated with the same rows leaves the store as it is.
    """
    spark = new.sparkSession
    times = {k: "yyyy-MM-dd'T'HH:mm:ss.SSSSSS" for k in ("timestampNTZFormat", "timestampFormat")}
    read = lambda: spark.read.schema(new.schema).options(**times).json(path)
    held = read() if exists(spark, path) else new.limit(0)
    kept = materialise(keep_last(held.unionByName(new).dropDuplicates(), new.limit(0), order, n), "bounded")
    kept.write.mode("overwrite").options(**times).json(path)
    drop_written(kept)
    return read()
