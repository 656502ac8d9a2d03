"""Exact running totals within groups of any size, without a task per group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the spreading key that ``spread_key`` returns.
KEY_BITS = 60


def spread_key(*cols: Column | str, seed: str = "") -> Column:
    """A long in [0, 2^60), evenly spread, the same in every engine that has MD5."""
    text = F.concat_ws("\u0001", F.lit(seed), *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("\u0002")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def running_totals(df: DataFrame, group: str, key: str, ties: list[str], value: str, out: str, rows: int, per_cell: int = 64, fan: int = 1024) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``group`` that come before, by ``key`` and then ``ties``.

    ``key`` is a long in [0, 2^60), spread evenly (``spread_key``). The key
    range is cut into cells of about ``per_cell`` rows; totals of cells are
    summed over runs of ``fan`` cells, those over runs of ``fan`` runs, and so
    on. No window holds more than about max(per_cell, fan) rows of one group,
    so a group with a third of all rows spreads over all tasks. ``df`` is read
    twice a level: give it a written table. ``group`` must not be null.
    Rows with equal key and ties share one order among themselves, any one.
    """
    bits = max(0, math.ceil(math.log2(max(rows, 1) / per_cell)))
    step = int(math.log2(fan))

    def level(d: DataFrame, b: int, order: list[str]) -> DataFrame:
        cell = f"_cell{b}"
        if cell not in d.columns:
            d = d.withColumn(cell, F.shiftright(F.col(key), KEY_BITS - b) if b else F.lit(0).cast("long"))
        inside = F.coalesce(F.sum(value).over(Window.partitionBy(group, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        if b == 0:
            return d.withColumn(out, inside).drop(cell)
        up = max(0, b - step)
        totals = d.groupBy(group, cell).agg(F.sum(value).alias(value)).withColumn(f"_cell{up}", F.shiftright(cell, b - up) if up else F.lit(0).cast("long"))
        above = climb(totals, b, up).select(group, cell, F.col(out).alias("_above"))
        return d.withColumn("_inside", inside).join(above, [group, cell]).withColumn(out, F.col("_inside") + F.col("_above")).drop("_inside", "_above", cell)

    def climb(totals: DataFrame, b: int, up: int) -> DataFrame:
        """Running totals of cells at ``b`` bits, through those at ``up`` bits."""
        cell, run = f"_cell{b}", f"_cell{up}"
        inside = F.coalesce(F.sum(value).over(Window.partitionBy(group, run).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        if up == 0:
            return totals.withColumn(out, inside)
        nxt = max(0, up - step)
        higher = totals.groupBy(group, run).agg(F.sum(value).alias(value)).withColumn(f"_cell{nxt}", F.shiftright(run, up - nxt) if nxt else F.lit(0).cast("long"))
        above = climb(higher, up, nxt).select(group, run, F.col(out).alias("_above"))
        return totals.withColumn("_inside", inside).join(above, [group, run]).withColumn(out, F.col("_inside") + F.col("_above")).drop("_inside", "_above")

    return level(df, bits, [key, *ties])
