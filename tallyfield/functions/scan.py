"""Running values along groups of any size: blocks of rows by their place in the group, and what one block hands to the next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.session import materialise

#: Rows of a group that one window holds.
ROWS = 50_000

#: Rows, and then sums, that a nested sum adds up at a time.
FAN = 16


def joined(d: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``d`` with the columns of ``other``, which has one row for each key of ``d``."""
    right = other.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return d.join(right, on).drop(*[f"_k_{k}" for k in keys])


def numbered(df: DataFrame, group: list[str], order: list[str], rows: int = ROWS) -> DataFrame:
    """Adds _place, 1, 2, ... along each group's order, and _block, which has ``rows`` rows of one group. A written table.

    The table is range-partitioned by group and order, so a group with most of
    the rows lies in many partitions; rows are counted in each, and the counts
    of the partitions before are added. Only those counts, a row a group and
    partition, pass a window by group alone. Rows that ``order`` doesn't tell
    apart have any one order among themselves, the same from then on.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, "_segment"]
    ranged = materialise(df.repartitionByRange(parts, *group, *order).withColumn("_segment", F.spark_partition_id()), "scan-ranged")
    counts = ranged.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    local = ranged.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    placed = joined(local, counts.select(*keys, before.alias("_before")), keys).withColumn("_place", F.col("_place") + F.col("_before"))
    return materialise(placed.drop("_before", "_segment").withColumn("_block", F.floor((F.col("_place") - 1) / rows)), "scan-numbered")


def inside(group: list[str]):
    """The window of a block up to and with the current row."""
    return Window.partitionBy(*group, "_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)


def with_carry(d: DataFrame, group: list[str], ends: dict[str, Column], carried: dict[str, tuple[Column, str]]) -> DataFrame:
    """Adds to each row what the blocks before its own amount to.

    ``ends`` are aggregates of a block. ``carried`` are taken over them along
    a group's blocks: (expression of the ends, how), how being sum, max or last
    (the block before). Those named earlier may be used by later ones. A first
    block gets null.
    """
    w = Window.partitionBy(*group).orderBy("_block")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = d.groupBy(*group, "_block").agg(*[e.alias(n) for n, e in ends.items()])
    for name, (value, how) in carried.items():
        taken = {"sum": lambda v: F.sum(v).over(past), "max": lambda v: F.max(v).over(past), "last": lambda v: F.lag(v).over(w)}[how](value)
        blocks = blocks.withColumn(name, taken)
    return joined(d, blocks.select(*group, "_block", *carried), [*group, "_block"])


def running_sum(d: DataFrame, group: list[str], value: Column, out: str) -> DataFrame:
    """Adds the sum of ``value`` up to and with each row of a numbered table."""
    d = d.withColumn("_value", value).withColumn("_sum", F.sum("_value").over(inside(group)))
    d = with_carry(d, group, {"_total": F.sum("_value")}, {"_base": (F.col("_total"), "sum")})
    return d.withColumn(out, F.coalesce("_base", F.lit(0.0)) + F.col("_sum")).drop("_value", "_sum", "_base")


def running_peak(d: DataFrame, group: list[str], value: Column, marks: list[str], total: str, peak: str, start: float = 0.0, latest: bool = True) -> DataFrame:
    """Adds ``total``, ``start`` plus the running sum of ``value``, and ``peak``, a struct of the highest total so far: top, place and ``marks`` of its row.

    Of rows with an equal total ``peak`` names the latest, or else the first.
    The state that a block hands on is its sum and its highest prefix, which
    are enough for any start: one pass over the rows.
    """
    turn = F.col("_place") if latest else -F.col("_place")
    d = d.withColumn("_value", value).withColumn("_sum", F.sum("_value").over(inside(group)))
    here = F.struct(F.col("_sum").alias("top"), turn.alias("turn"), F.col("_place").alias("place"), *[F.col(m).alias(m) for m in marks])
    d = d.withColumn("_top", F.max(here).over(inside(group)))
    moved = lambda s, by: F.struct((by + s["top"]).alias("top"), s["turn"].alias("turn"), s["place"].alias("place"), *[s[m].alias(m) for m in marks])
    base = F.lit(start) + F.coalesce("_base", F.lit(0.0))
    d = with_carry(d, group, {"_total": F.sum("_value"), "_best": F.max("_top")}, {"_base": (F.col("_total"), "sum"), "_past": (moved(F.col("_best"), base), "max")})
    d = d.withColumn(total, base + F.col("_sum")).withColumn(peak, F.greatest(F.coalesce("_past", moved(F.col("_top"), base)), moved(F.col("_top"), base)))
    return d.drop("_value", "_sum", "_top", "_base", "_past")


def previous(d: DataFrame, group: list[str], value: Column, out: str) -> DataFrame:
    """Adds ``value`` of the row before in a numbered table; null for the first."""
    own = F.lag("_value").over(Window.partitionBy(*group, "_block").orderBy("_place"))
    d = d.withColumn("_value", value).withColumn("_own", own)
    d = with_carry(d, group, {"_end": F.max_by("_value", "_place")}, {"_before": (F.col("_end"), "last")})
    first = Window.partitionBy(*group, "_block").orderBy("_place")
    return d.withColumn(out, F.when(F.row_number().over(first) == 1, F.col("_before")).otherwise(F.col("_own"))).drop("_value", "_own", "_before")


def nested_totals(d: DataFrame, group: list[str], value: Column) -> DataFrame:
    """A row for each ``FAN`` rows of a numbered table, _node, with _totals: the sum before its first row and then the sum up to and with each of its rows.

    Rows are summed by ``FAN``, then these sums by ``FAN``, and so on; a total
    adds the largest sums that lie before it first. So rounding grows with the
    logarithm of the rows, and the order of additions follows from places
    alone. A task holds ``FAN`` rows of a group at a time, however many it has.
    """
    deep, longest = [], d.agg(F.max("_place")).first()[0] or 0
    items = d.select(*group, (F.col("_place") - 1).alias("_at"), value.alias("_sum"))
    while not deep or longest > 1:
        listed = items.groupBy(*group, F.floor(F.col("_at") / FAN).alias("_node")).agg(F.array_sort(F.collect_list(F.struct("_at", "_sum"))).alias("_items"))
        deep.append(materialise(listed.select(*group, "_node", F.col("_items._sum").alias("_items")), "scan-nested"))
        items = deep[-1].select(*group, F.col("_node").alias("_at"), F.aggregate("_items", F.lit(0.0), lambda a, x: a + x).alias("_sum"))
        longest = -(-longest // FAN)
    out = deep.pop().withColumn("_base", F.lit(0.0)).withColumn("_upto", F.lit(None).cast("double"))  # one node a group
    while True:
        each = F.aggregate("_items", F.array("_base"), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        whole = F.concat(F.slice(each, 1, FAN), F.array("_upto"))  # the end of a full node is a sum of larger ones
        totals = F.when((F.size("_items") == FAN) & F.col("_upto").isNotNull(), whole).otherwise(each)
        out = out.select(*group, "_node", totals.alias("_totals"))
        if not deep:
            return out
        pairs = F.transform(F.sequence(F.lit(1), F.size("_totals") - 1), lambda i: F.struct((F.col("_node") * FAN + i - 1).alias("_node"), F.element_at("_totals", i).alias("_base"), F.element_at("_totals", i + 1).alias("_upto")))
        out = joined(deep.pop(), out.select(*group, F.inline(pairs)), [*group, "_node"])


def last_known(d: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """Adds the latest ``value`` that isn't null, up to and with each row of a numbered table."""
    d = d.withColumn("_known", F.last(value, ignorenulls=True).over(inside(group)))
    at = F.when(F.col(value).isNotNull(), F.col("_place"))
    d = with_carry(d, group, {"_end": F.max(F.when(at.isNotNull(), F.struct(at.alias("_at"), F.col(value).alias("_is"))))}, {"_past": (F.col("_end"), "max")})
    return d.withColumn(out, F.coalesce("_known", "_past._is")).drop("_known", "_past")


def with_tail(d: DataFrame, rows: int, size: int = ROWS) -> DataFrame:
    """A numbered table in which each block also has the ``rows`` rows before it, told by _halo: windows of up to ``rows`` + 1 rows are whole in every block."""
    if rows >= size:
        raise ValueError("a block is no longer than what it hands on")
    late = (F.col("_place") - 1) % size >= size - rows
    copies = F.when(late, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    d = d.withColumn("_step", F.explode(copies))
    return d.withColumn("_block", F.col("_block") + F.col("_step")).withColumn("_halo", F.col("_step") == 1).drop("_step")
