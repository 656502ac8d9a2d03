"""Files for others: candidates by band, parts of a table, JSON that every reader takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from tallyfield.functions.nulls import blank_to_null
from tallyfield.session import drop_written, materialise

#: The mode that exported rows carry, the bands that go out, and the columns of the parts of a match table.
MODE = "PAPER_TRADING_SIMULATION_ONLY"
BANDS = ["HIGH_CONFIDENCE_SIMULATION", "MEDIUM_CONFIDENCE_SIMULATION"]
KEYS = ["match_id", "flashscore_match_id", "match_identity_key", "provider", "source", "is_demo_data"]
STATS = ["corners_home", "corners_away", "shots_home", "shots_away", "shots_on_target_home", "shots_on_target_away", "xg_home", "xg_away", "goal_minutes_home", "goal_minutes_away"]
EXPORTED = "match string, market string, score double, probability double, risks string, explanation string, mode string"


def candidates(df: DataFrame, bands: list[str] | None = None) -> DataFrame:
    """Candidates of these bands as others read them.

    The band is confidence_band, or simulation_label where that column is
    absent; without either all rows go. A match without a name is named by its
    teams. Of each pair of columns that may hold a value the first that the
    table has is taken, also where it is null.
    """
    first = lambda *names: next((F.col(c) for c in names if c in df.columns), F.lit(None))
    band = next((c for c in ("confidence_band", "simulation_label") if c in df.columns), None)
    chosen = df.filter(F.col(band).isin(BANDS if bands is None else bands)) if band else df
    teams = F.concat(*[x for side, between in (("home_team", " vs "), ("away_team", "")) for x in (F.coalesce(first(side).cast("string"), F.lit("")), F.lit(between))])
    return chosen.select(
        F.coalesce(blank_to_null(first("match")), teams).alias("match"), first("market").cast("string").alias("market"), first("decision_score", "score").try_cast("double").alias("score"),
        first("ensemble_probability", "ml_probability").try_cast("double").alias("probability"), first("risk_flags", "main_risks").cast("string").alias("risks"),
        first("why_selected", "explanation").cast("string").alias("explanation"), F.lit(MODE).alias("mode"),
    )


def export_candidates(df: DataFrame, path: str, bands: list[str] | None = None) -> DataFrame:
    """Writes ``candidates`` as CSV, every field of text quoted, and returns what a reader of the files gets."""
    spark = df.sparkSession
    candidates(df, bands).write.mode("overwrite").options(quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path, header=True)
    return spark.read.schema(EXPORTED).option("escape", '"').option("multiLine", True).csv(path, header=True)


def write_parts(df: DataFrame, root: str) -> dict[str, str]:
    """Writes a match table as matches, odds and stats: the paths by part.

    A part has the keys and its own columns, as far as the table has them;
    odds are those that begin so. The table is computed once.
    """
    whole = materialise(df, "parts")
    columns = {"matches": df.columns, "odds": [c for c in df.columns if c.startswith("odds_") or c in KEYS], "stats": [c for c in df.columns if c in STATS or c in KEYS]}
    paths = {}
    for part, names in columns.items():
        if names:
            paths[part] = f"{root}/{part}.parquet"
            whole.select(*names).write.mode("overwrite").parquet(paths[part])
    drop_written(whole)
    return paths


def finite(x: Column, kind: DataType) -> Column:
    """``x`` with nulls for NaN and infinities, at any depth of arrays, structs and maps."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
    if isinstance(kind, ArrayType):
        return F.transform(x, lambda e: finite(e, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(x, lambda _, v: finite(v, kind.valueType))
    if isinstance(kind, StructType) and kind.fields:
        return F.when(x.isNotNull(), F.struct(*[finite(x[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return x


def strict_json(df: DataFrame) -> Column:
    """A row of ``df`` as JSON text with all its fields: what JSON has no number for is null."""
    return F.to_json(F.struct(*[finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]), {"ignoreNullFields": "false"})
