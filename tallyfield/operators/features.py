"""Match rows, team rows and features that look at the past only.

Windows are partitioned by team (or team and side) and ordered by every key
that makes the order total; frames end with the row before. All features of
one partitioning share one sort.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.nulls import safe_divide


def two_sides(matches: DataFrame, home: dict[str, str], away: dict[str, str], keep: list[str]) -> DataFrame:
    """Two rows a match, one from each side: ``home`` and ``away`` map an output name to the column of that side.

    Every name gets a _for and an _against column but key, which becomes
    team_key and opponent_key.
    """

    def row(own: dict[str, str], other: dict[str, str], side: str) -> Column:
        parts = [F.lit(side).alias("side"), F.col(own["key"]).alias("team_key"), F.col(other["key"]).alias("opponent_key")]
        for name in own:
            if name != "key":
                parts += [F.col(own[name]).alias(f"{name}_for"), F.col(other[name]).alias(f"{name}_against")]
        return F.struct(*parts)

    return matches.select(*keep, F.inline(F.array(row(home, away, "home"), row(away, home, "away"))))


def result_of(own: Column, other: Column) -> Column:
    """W, D or L; null without both."""
    return F.when(own > other, "W").when(own == other, "D").when(own < other, "L")


def points_of(result: Column) -> Column:
    """3, 1 and 0; an unknown result is 0."""
    return F.when(result == "W", 3).when(result == "D", 1).otherwise(0)


def past(team: list[str], order: list[str], rows: int | None) -> Window:
    """The ``rows`` rows before (all, if None), never the row itself."""
    return Window.partitionBy(*team).orderBy(*order).rowsBetween(Window.unboundedPreceding if rows is None else -rows, -1)


def past_features(df: DataFrame, team: list[str], order: list[str], spec: dict[str, tuple[str, str, int]]) -> DataFrame:
    """Adds features: ``spec`` maps a name to (statistic, column, rows). Nulls are skipped; null if nothing is left.

    Statistics: mean, sum, std (population), min, max, count.
    """
    make = {"mean": F.avg, "sum": F.sum, "std": F.stddev_pop, "min": F.min, "max": F.max, "count": F.count}
    return df.withColumns({name: make[stat](c).over(past(team, order, rows)) for name, (stat, c, rows) in spec.items()})


def side_mean(df: DataFrame, team: str, side: str, order: list[str], column: str, rows: int) -> DataFrame:
    """home_ and away_ past means of ``column`` over the team's rows of that side; null on rows of the other."""
    value = F.avg(column).over(past([team, side], order, rows))
    return df.withColumns({f"{s}_{column}_avg_last_{rows}": F.when(F.col(side) == s, value) for s in ("home", "away")})


def lagged(df: DataFrame, team: list[str], order: list[str], column: str, name: str, steps: int = 1) -> DataFrame:
    return df.withColumn(name, F.lag(column, steps).over(Window.partitionBy(*team).orderBy(*order)))


def trend(df: DataFrame, team: list[str], order: list[str], column: str, name: str, short: int = 3, long: int = 6) -> DataFrame:
    """Past mean over few rows less that over more."""
    return df.withColumn(name, F.avg(column).over(past(team, order, short)) - F.avg(column).over(past(team, order, long)))


def streak_before(df: DataFrame, team: list[str], order: list[str], hit: Column, name: str) -> DataFrame:
    """How many rows just before this one hit without a break; an unknown row breaks."""
    w = Window.partitionBy(*team).orderBy(*order)
    d = df.withColumn("_n", F.row_number().over(w)).withColumn("_miss", F.when(~F.coalesce(hit, F.lit(False)), F.col("_n")))
    last = F.max("_miss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return d.withColumn(name, (F.col("_n") - 1 - F.coalesce(last, F.lit(0))).cast("int")).drop("_n", "_miss")


def league_past_mean(df: DataFrame, league: str, date: str, columns: list[str]) -> DataFrame:
    """Adds league_<column>: the mean over earlier dates of the league's daily means.

    Rows are reduced to one a league and date before the window, so that rows
    of the same date don't see each other and few rows are sorted.
    """
    daily = df.groupBy(league, date).agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    before = daily.select(league, date, *[F.avg(f"_{c}").over(past([league], [date], None)).alias(f"league_{c}") for c in columns])
    return df.join(before, [league, date], "left")


def relative(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Ratios by name; null where the divisor is 0 or null."""
    return df.withColumns({n: safe_divide(a, b) for n, (a, b) in pairs.items()})


def opponents(df: DataFrame, match: str, team: str, opponent: str, columns: list[str]) -> DataFrame:
    """Adds opponent_<column>, the value on the opponent's row of the same match."""
    other = df.select(F.col(match), F.col(team).alias(opponent), *[F.col(c).alias(f"opponent_{c}") for c in columns])
    return df.join(other, [match, opponent], "left")


def goals_proxy(goals: Column, on_target: Column, relative_shots: Column) -> Column:
    """0.5 goals + 0.3 shots-on-target share + 0.2 relative shots, missing ones 0; 0 is null."""
    x = 0.5 * F.coalesce(goals, F.lit(0.0)) + 0.3 * F.coalesce(on_target, F.lit(0.0)) + 0.2 * F.coalesce(relative_shots, F.lit(0.0))
    return F.when(x != 0, x)


def leaks(df: DataFrame, team: list[str], order: list[str], feature: str, stat: str, column: str, rows: int, tolerance: float = 1e-9) -> DataFrame:
    """One row: how many rows differ from a feature made anew from the past only, and how many first rows aren't null."""
    again = past_features(df, team, order, {"_again": (stat, column, rows)}).withColumn("_first", F.row_number().over(Window.partitionBy(*team).orderBy(*order)) == 1)
    same = F.col(feature).eqNullSafe(F.col("_again")) | F.coalesce(F.abs(F.col(feature) - F.col("_again")) <= tolerance, F.lit(False))
    return again.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum((~same).cast("long")), F.lit(0)).alias("differing"),
        F.coalesce(F.sum((F.col("_first") & F.col(feature).isNotNull()).cast("long")), F.lit(0)).alias("first_not_null"),
    )


def lead_targets(df: DataFrame, team: list[str], order: list[str], column: str, horizon: int) -> DataFrame:
    """Adds target, the value ``horizon`` rows later; rows without one go."""
    return df.withColumn("target", F.lead(column, horizon).over(Window.partitionBy(*team).orderBy(*order))).filter("target IS NOT NULL")


def walk_forward_folds(df: DataFrame, date: str) -> DataFrame:
    """A row for each year but the first: fold year, training rows (all years before) and test rows.

    Rows are counted by year first, so the window is over years.
    """
    years = df.groupBy(F.year(date).alias("year")).agg(F.count("*").alias("test_rows"))
    before = F.sum("test_rows").over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1))
    return years.withColumn("train_rows", before).filter("train_rows IS NOT NULL AND year IS NOT NULL").select("year", "train_rows", "test_rows")


def ordered_split(df: DataFrame, group: list[str], order: list[str], share: float) -> DataFrame:
    """Adds part: train for the first ``share`` of a group's rows, else test. The share counts as it is written: 0.7 of 90 rows are 63."""
    w = Window.partitionBy(*group)
    limit = F.floor(F.lit(Decimal(str(share))) * F.count("*").over(w))
    return df.withColumn("part", F.when(F.row_number().over(w.orderBy(*order)) <= limit, "train").otherwise("test"))
