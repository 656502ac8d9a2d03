"""What a table holds: counts, gaps, repeats, spreads and coverage, each in one aggregate over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions import scan
from tallyfield.functions.nulls import present, ratio_or_zero

#: Fixed value: the bucket of nulls.
MISSING = "__MISSING__"


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value and n, nulls as ``MISSING``."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias("value")).agg(F.count("*").alias("n"))


def most_common(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values, ties to the smaller one."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def _long(whole: DataFrame, columns: list[str], fields: list[str]) -> DataFrame:
    """One row with ``<field>__<column>`` columns as a row a column."""
    return whole.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{f}__{c}").alias(f) for f in fields]) for c in columns])))


def missing_ratios(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, missing and ratio of nulls."""
    aggs = [x for c in columns for x in (F.sum(F.col(c).isNull().cast("long")).alias(f"missing__{c}"), F.avg(F.col(c).isNull().cast("double")).alias(f"ratio__{c}"))]
    return _long(df.agg(*aggs), columns, ["missing", "ratio"])


def valid_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows and the percentage of cells that hold a value."""
    return df.agg(F.count("*").alias("rows"), F.round(F.avg(present(columns) / len(columns)) * 100, 4).alias("valid_pct"))


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, missing_pct, n, mean, std (population), least and most."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.round(F.avg(x.isNull().cast("double")) * 100, 4).alias(f"missing_pct__{c}"), F.count(x).alias(f"n__{c}"), F.round(F.avg(x), 6).alias(f"mean__{c}"), F.round(F.stddev_pop(x), 6).alias(f"std__{c}"), F.min(x).alias(f"least__{c}"), F.max(x).alias(f"most__{c}")]
    return _long(df.agg(*aggs), columns, ["missing_pct", "n", "mean", "std", "least", "most"])


def repeats(df: DataFrame, key: list[str], skip_blank: bool = False) -> DataFrame:
    """rows, those whose key occurs more than once (all of them count), and their ratio; ``skip_blank`` leaves keys with an empty part out of the repeats.

    Counts of keys are added up, so a key with a third of all rows is one row by then.
    """
    keys = df.groupBy(*key).agg(F.count("*").alias("_n"))
    again = F.col("_n") > 1
    if skip_blank:
        for c in key:
            again &= F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""
    total, twice = F.sum("_n"), F.coalesce(F.sum(F.when(again, F.col("_n"))), F.lit(0))
    return keys.agg(F.coalesce(total, F.lit(0)).alias("rows"), twice.alias("repeated"), F.round(F.coalesce(twice / total, F.lit(0.0)), 6).alias("ratio"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact distinct values by column: columns are stacked and counted in one pass, not expanded once for each."""
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])))
    return cells.distinct().groupBy("column_name").agg(F.count("value").alias("n"))


def distinct_over(df: DataFrame, columns: list[str], group: list[str] = ()) -> DataFrame:
    """Exact distinct values of several columns together."""
    cells = df.select(*group, F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("value")).filter("value IS NOT NULL").distinct()
    return cells.groupBy(*group).agg(F.count("*").alias("n"))


def date_range(df: DataFrame, date: str, group: list[str] = ()) -> DataFrame:
    return df.groupBy(*group).agg(F.min(F.to_date(date)).alias("first_day"), F.max(F.to_date(date)).alias("last_day"))


def overview(df: DataFrame, group: str, match: str, teams: list[str], date: str) -> DataFrame:
    """Distinct matches, distinct teams over several columns, and the dates of each group."""
    matches = df.groupBy(group, match).agg(F.min(F.to_date(date)).alias("_a"), F.max(F.to_date(date)).alias("_b"))
    matches = matches.groupBy(group).agg(F.count(match).alias("matches"), F.min("_a").alias("first_day"), F.max("_b").alias("last_day"))
    return matches.join(distinct_over(df, teams, [group]).withColumnRenamed("n", "teams"), group, "left").fillna(0, ["teams"])


def coverage(df: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """name, covered rows (any column of the set has a value) and their percentage."""
    names = list(sets)
    aggs = []
    for name, columns in sets.items():
        any_ = (present(columns) > 0).cast("double")
        aggs += [F.coalesce(F.sum(any_).cast("long"), F.lit(0)).alias(f"covered__{name}"), F.round(F.coalesce(F.avg(any_), F.lit(0.0)) * 100, 4).alias(f"pct__{name}")]
    return _long(df.agg(*aggs), names, ["covered", "pct"]).withColumnRenamed("column_name", "name")


def consensus(df: DataFrame, finding: str, agent: str, confidence: str, agents: int) -> DataFrame:
    """For each finding its mean confidence, its agents in order and the share of all ``agents`` that made it."""
    by = df.groupBy(finding, agent).agg(F.sum(confidence).alias("_s"), F.count(confidence).alias("_n"))
    out = by.groupBy(finding).agg(F.round(F.sum("_s") / F.sum("_n"), 6).alias("mean_confidence"), F.array_join(F.sort_array(F.collect_set(agent)), "|").alias("agents"))
    return out.withColumn("agreement", F.round(F.size(F.split("agents", r"\|")) / agents, 6))


def ledger_summary(df: DataFrame, group: list[str], settled: Column, won: Column, profit: str, stake: str, start: float = 100.0) -> DataFrame:
    """Signals, settled and pending ones, win rate, ROI, profit factor (the gains themselves without a loss) and bankroll."""
    p, n = F.when(settled, F.col(profit)), F.sum(settled.cast("long"))
    gains, losses = F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)), F.coalesce(-F.sum(F.when(p < 0, p)), F.lit(0.0))
    total, staked = F.coalesce(F.sum(p), F.lit(0.0)), F.coalesce(F.sum(F.when(settled, F.col(stake))), F.lit(0.0))
    return df.groupBy(*group).agg(
        F.count("*").alias("signals"), n.alias("settled"), (F.count("*") - n).alias("pending"), F.round(ratio_or_zero(F.sum((settled & won).cast("double")), n), 6).alias("win_rate"), F.round(ratio_or_zero(total, staked), 6).alias("roi"),
        F.round(F.when(losses == 0, gains).otherwise(gains / losses), 6).alias("profit_factor"), F.round(total, 6).alias("total_profit"), F.round(total + start, 6).alias("bankroll"),
        F.round(F.coalesce(F.sum(F.when(~settled, F.col(stake))), F.lit(0.0)), 6).alias("exposure"),
    )


#: The columns that an outcome of a market needs.
NEEDED = {"goals": ["total_goals"], "corners": ["corners_for", "corners_against"], "shots": ["shots_for"], "btts": ["goals_for", "goals_against"]}


def outcome_known(market: Column, columns: dict[str, list[str]] = NEEDED) -> Column:
    """Whether all columns that a market's outcome needs are there; other markets need none."""
    out = F.lit(True)
    for name, needed in columns.items():
        out = F.when(F.lower(market) == name, F.forall(F.array(*[F.col(c).isNotNull() for c in needed]), lambda x: x)).otherwise(out)
    return out


def ledger_outcome(strategy: Column, market: Column) -> Column:
    """Whether a ledger's signal won, by rules of its own: lines from the strategy's name, 5 shots, "no" for both-score."""
    name, kind = F.lower(strategy), F.lower(market)
    both = (F.col("goals_for") > 0) & (F.col("goals_against") > 0)
    return (
        F.when(kind == "goals", F.col("total_goals") > F.when(F.contains(name, F.lit("1.5")), 1.5).otherwise(2.5))
        .when(kind == "corners", F.col("corners_for") + F.col("corners_against") > F.when(F.contains(name, F.lit("9.5")), 9.5).otherwise(8.5))
        .when(kind == "shots", F.col("shots_for") >= 5)
        .when(kind == "btts", F.when(F.contains(name, F.lit("no")), ~both).otherwise(both))
        .otherwise(False)
    )


def any_feature(columns: dict[str, list[str]], market: Column) -> Column:
    """Whether any column that a market's rows need is there; markets without a list keep their rows."""
    out = F.lit(True)
    for name, needed in columns.items():
        out = F.when(market == name, present(needed) > 0).otherwise(out)
    return out


def daily_cap(df: DataFrame, day: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each day. Row numbers are limited before the shuffle, so a busy day sends few rows."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(day).orderBy(*order))).filter(F.col("_at") <= most).drop("_at")


def sampled_series(df: DataFrame, group: list[str], order: list[str], points: int = 18) -> DataFrame:
    """Of each group every k-th row in order, k its size over ``points`` but 1 at least, and of those the last ``points``; ``label`` numbers them."""
    d = scan.numbered(df, group, order)
    d = scan.joined(d, d.groupBy(*group).agg(F.count("*").alias("_n")), group).withColumn("_step", F.greatest(F.lit(1), F.floor(F.col("_n") / points)))
    d = d.withColumn("_i", F.col("_place") - 1).filter(F.col("_i") % F.col("_step") == 0)
    first = F.greatest(F.lit(0), F.ceil(F.col("_n") / F.col("_step")) - points)
    d = d.withColumn("_label", F.col("_i") / F.col("_step") - first + 1).filter("_label >= 1")
    return d.withColumn("label", F.concat(F.lit("D"), F.col("_label").cast("long").cast("string"))).drop("_n", "_step", "_i", "_label", "_place", "_block")


def sign_streaks(df: DataFrame, group: list[str], order: list[str], sign: Column) -> DataFrame:
    """current (signed), best_win and worst_loss runs of a group's signs, and how many there are; a 0 ends a run. Groups of any size (``scan``)."""
    d = scan.numbered(df.withColumn("_s", sign).filter("_s IS NOT NULL").select(*group, *[c for c in order if c not in group], "_s"), group, order)
    d = scan.previous(d, group, F.col("_s"), "_was").withColumn("_turn", (~F.col("_s").eqNullSafe(F.col("_was"))).cast("double"))
    runs = scan.running_sum(d, group, F.col("_turn"), "_run").groupBy(*group, "_s", "_run").agg(F.count("*").alias("_n"), F.max("_place").alias("_end"))
    length = F.col("_n") * F.col("_s")
    return runs.groupBy(*group).agg(
        F.max_by(length, "_end").cast("long").alias("current"), F.coalesce(F.max(F.when(F.col("_s") > 0, F.col("_n"))), F.lit(0)).alias("best_win"),
        F.coalesce(F.max(F.when(F.col("_s") < 0, F.col("_n"))), F.lit(0)).alias("worst_loss"), F.sum("_n").alias("sample"),
    )


def feature_columns(df: DataFrame, exclude: list[str], leaks: list[str]) -> list[str]:
    """Numeric columns, each name once, that are neither excluded nor begin like what is known only afterwards."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    names = [f.name for f in df.schema.fields if f.dataType.simpleString().startswith(numeric)]
    return [n for n in dict.fromkeys(names) if n not in exclude and not n.startswith(tuple(leaks))]


def highest_severity(df: DataFrame, group: list[str], severity: str) -> DataFrame:
    """The gravest severity of each group."""
    weight = F.when(F.col(severity) == "HIGH", 3).when(F.col(severity) == "MEDIUM", 2).when(F.col(severity) == "LOW", 1).otherwise(0)
    return df.groupBy(*group).agg(F.max_by(severity, weight).alias("highest"))
