"""Sources reconciled: identity, duplicates, enrichment, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.nulls import blank_to_null, present
from tallyfield.operators import entities


def nearest_date_join(left: DataFrame, right: DataFrame, key: list[str], left_date: str, right_date: str, columns: list[str], order: list[str], id_col: str, days: int = 1) -> DataFrame:
    """Each left row with the right row of equal keys that is at most ``days`` days away, the nearest, then the earlier, then the first by ``order``.

    Dates lie in buckets of ``days`` + 1, and a left row looks into its own
    and the two beside it, so this is an equi-join with three copies of a row
    however wide the tolerance is; the best of what it meets is found by a
    partial aggregate. ``id_col`` is unique in ``left``.
    """
    bucket = lambda c: F.floor(F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")) / (days + 1))
    asked = left.select(id_col, *[c for c in key if c != id_col], F.to_date(left_date).alias("_day"), F.explode(F.array(*[bucket(left_date) + i for i in (-1, 0, 1)])).alias("_bucket"))
    r = right.select(*key, bucket(right_date).alias("_bucket"), F.to_date(right_date).alias("_date"), *[F.col(c).alias(f"matched_{c}") for c in columns])
    near = asked.join(r, [*key, "_bucket"]).withColumn("_off", F.datediff("_date", "_day")).filter(F.abs("_off") <= days)
    place = F.struct(F.abs("_off"), F.col("_off"), *[F.col(f"matched_{c}") for c in order])
    best = near.groupBy(F.col(id_col).alias("_id")).agg(F.min_by(F.struct(*[f"matched_{c}" for c in columns], "_off"), place).alias("_best"))
    return left.join(best, F.col(id_col) == F.col("_id"), "left").select(*left.columns, *[F.col(f"_best.matched_{c}").alias(f"matched_{c}") for c in columns], F.col("_best._off").alias("days_off"))


def only_new(new: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key isn't known."""
    return new.join(known.select(*key).distinct(), key, "left_anti")


def append_keep_first(known: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Union by name, one row a key, known ones first."""
    both = known.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("_new", *order)
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def most_complete(df: DataFrame, key: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the most cells filled, then the first by ``order``."""
    w = Window.partitionBy(*key).orderBy(F.desc("_filled"), *order)
    d = df.withColumn("_filled", present(columns))
    return d.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").withColumnRenamed("_filled", "filled")


def merge_sources(df: DataFrame, key: str, source: str, priority: dict[str, int], columns: list[str], order: list[str]) -> DataFrame:
    """One row a key: each column from the best source that fills it, the sources, how many rows merged, and in how many columns they disagree."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i in priority.items() for x in i]), F.col(source)), F.lit(len(priority)))
    place = F.struct(rank, *order)
    typed = {c: blank_to_null(c) if df.schema[c].dataType.simpleString() == "string" else F.col(c) for c in columns}
    best = [F.min_by(typed[c], F.when(blank_to_null(c).isNotNull(), place)).alias(c) for c in columns]
    differing = sum((F.coalesce(F.min(blank_to_null(c)) != F.max(blank_to_null(c)), F.lit(False)).cast("int") for c in columns), F.lit(0))  # distinct counts would copy each row once a column
    return df.groupBy(key).agg(*best, F.array_sort(F.collect_set(source)).alias("sources"), F.count("*").alias("merged_rows"), differing.alias("conflicts"))


def identity_confidence(warnings: Column) -> Column:
    return 1 - F.least(F.lit(0.5), 0.12 * warnings)


def kickoff_conflicts(df: DataFrame, key: str, date: str, hour: str, order: list[str], hours: float = 3.0) -> DataFrame:
    """Rows whose date differs from the first row of their key, or whose hour does by more than ``hours``."""
    w = Window.partitionBy(key).orderBy(*order)
    base_date, base_hour = F.first(date).over(w), F.first(hour).over(w)
    return df.withColumn("conflict", F.coalesce((F.col(date) != base_date) | (F.abs(F.col(hour) - base_hour) > hours), F.lit(False)))


def enrich(primary: DataFrame, secondary: DataFrame, key: list[str], policies: dict[str, str], quality: str | None = None, low: float = 0.5) -> DataFrame:
    """Fills columns of ``primary`` from ``secondary`` (a row a key) by policy, and lists what was filled.

    Policies: keep (never), fill (if empty), low (if empty or the row's
    quality is below ``low``).
    """
    other = secondary.select(*key, *[F.col(c).alias(f"_o_{c}") for c in policies])
    d = primary.join(other, key, "left")
    taken = {}
    for c, policy in policies.items():
        empty = blank_to_null(c).isNull()
        want = F.lit(False) if policy == "keep" else empty if policy == "fill" else empty | (F.col(quality) < low)
        taken[c] = F.coalesce(want & blank_to_null(f"_o_{c}").isNotNull(), F.lit(False))
    filled = F.array_compact(F.array(*[F.when(t, F.lit(c)) for c, t in taken.items()]))
    d = d.withColumn("filled", filled)
    return d.withColumns({c: F.when(t, F.col(f"_o_{c}")).otherwise(F.col(c)) for c, t in taken.items()}).drop(*[f"_o_{c}" for c in policies])


def quality_score(entity: Column, identity: Column, complete: Column, agreement: Column, enrichment: Column, duplicate_risk: Column, conflicts: Column) -> Column:
    """0 to 1: weights .22, .18, .24, .14, .12 and .10 for a low duplicate risk, less .08 a conflict."""
    x = 0.22 * entity + 0.18 * identity + 0.24 * complete + 0.14 * agreement + 0.12 * enrichment + 0.10 * (1 - duplicate_risk) - 0.08 * conflicts
    return F.round(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), 6)


def quality_band(score: Column) -> Column:
    return F.when(score >= 0.82, "EXCELLENT").when(score >= 0.62, "GOOD").when(score >= 0.42, "FAIR").otherwise("POOR")


def content_checks(df: DataFrame, date: str, home: str, away: str) -> DataFrame:
    """One row of counts: rows, dates that don't parse, missing teams, teams against themselves."""
    no_team = blank_to_null(home).isNull() | blank_to_null(away).isNull()
    count = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    return df.agg(
        F.count("*").alias("rows"),
        count(F.try_to_timestamp(F.col(date).cast("string")).isNull()).alias("bad_dates"),
        count(no_team).alias("missing_teams"),
        count(blank_to_null(home) == blank_to_null(away)).alias("same_team"),
    )


def fuzzy_entities(names: DataFrame, canon: DataFrame, name: str, canon_name: str, sure: int = 92, maybe: int = 82) -> DataFrame:
    """Distinct names mapped to canonical ones: name, canonical, score and status (exact, fuzzy, review, unresolved).

    Exact after normalising, else the canonical name of the best token-sort
    ratio (``entities.similar_names``: no pair that reaches ``maybe`` is missed).
    """
    rows = names.select(F.col(name).alias("raw_name")).filter("raw_name IS NOT NULL").distinct().withColumn("provider", F.lit(None).cast("string")).withColumn("provider_id", F.lit(None).cast("string"))
    known = canon.select(F.col(canon_name).alias("canonical_id"), F.col(canon_name).alias("canonical_name")).distinct()
    d = entities.resolve_entities(rows, known, sure=sure, review=maybe)
    status = F.when(F.col("method") == "normalized_exact", "exact").when(F.col("method") == "fuzzy_auto", "fuzzy").when(F.col("method") == "fuzzy_review", "review").otherwise("unresolved")
    there = F.col("method") != "created"
    return d.select(F.col("raw_name").alias("name"), F.when(there, F.col("canonical_id")).alias("canonical"), F.when(there, F.round("score", 4)).alias("score"), status.alias("status"))
