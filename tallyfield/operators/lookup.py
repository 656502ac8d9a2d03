"""Lookups that fall back: by one key, else another, with a preference among hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, key: list[str], order: list, columns: list[str]) -> DataFrame:
    """The first row of each key by ``order``, as a struct ``hit`` of ``columns``; kept by an aggregate, so a busy key is combined before the shuffle."""
    names = [f"_o{i}" for i in range(len(order))]
    ranked = df.select(*key, *[o.alias(n) for n, o in zip(names, order)], *columns)
    return ranked.groupBy(*key).agg(F.min_by(F.struct(*columns), F.struct(*names)).alias("hit"))


def prefer_same(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], same: str, order: list, columns: list[str]) -> DataFrame:
    """``left`` with ``columns`` of the first hit: by the first (left, right) pair of keys that has one, rows whose ``same`` column equals the left one's first.

    Joins for each pair and a coalesce, where an "or" in one join would compare all rows with all.
    """
    out = left
    for i, (own, other) in enumerate(keys):
        known = right.filter(F.col(other).isNotNull())
        exact = one_per_key(known, [other, same], order, columns).select(F.col(other).cast("string").alias(f"_k{i}"), F.col(same).alias(f"_s{i}"), F.col("hit").alias(f"_exact{i}"))
        any_ = one_per_key(known, [other], order, columns).select(F.col(other).cast("string").alias(f"_j{i}"), F.col("hit").alias(f"_any{i}"))
        out = out.join(exact, (F.col(own).cast("string") == F.col(f"_k{i}")) & (F.col(same) == F.col(f"_s{i}")), "left").join(any_, F.col(own).cast("string") == F.col(f"_j{i}"), "left")
    hit = F.coalesce(*[F.coalesce(F.col(f"_exact{i}"), F.col(f"_any{i}")) for i in range(len(keys))])
    return out.select(*left.columns, *[hit[c].alias(c) for c in columns])


def left_with_suffix(left: DataFrame, right: DataFrame, key: list[str], suffix: str) -> DataFrame:
    """A left join in which right columns whose names clash get a suffix."""
    renamed = right.select(*key, *[F.col(c).alias(c + suffix if c in left.columns else c) for c in right.columns if c not in key])
    return left.join(renamed, key, "left")


def map_variants(df: DataFrame, column: str, variants: DataFrame, names: str, canonical: str) -> DataFrame:
    """Adds ``canonical`` by whichever list of ``variants.names`` holds the value, case and outer blanks aside; of several the smallest."""
    flat = variants.select(F.explode(names).alias("_v"), canonical).withColumn("_v", F.lower(F.trim("_v"))).groupBy("_v").agg(F.min(canonical).alias(canonical))
    return df.join(flat, F.lower(F.trim(F.col(column))) == F.col("_v"), "left").drop("_v")


def outer_counts(df: DataFrame, columns: list[str], name: str = "value") -> DataFrame:
    """How often each value stands in any of the columns: counts of each side added up, 0 where a side lacks the value."""
    return df.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias(name)).filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))


def first_per(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_at = 1").drop("_at")
