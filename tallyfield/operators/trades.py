"""Signals, simulated bankrolls and what a log of trades amounts to."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions import scan
from tallyfield.functions.nulls import number, ratio_or_zero, safe_divide


@dataclass(frozen=True)
class Strategy:
    """A named rule: thresholds by column (``<column>_max`` is an upper one), and where its price stands."""

    name: str
    market: str
    thresholds: dict[str, float]
    odds: list[str] = field(default_factory=list)
    line: float | None = None


def passes(thresholds: dict[str, float]) -> Column:
    """All columns reach their thresholds; null doesn't."""
    tests = [(F.col(c[:-4]) <= t) if c.endswith("_max") else (F.col(c) >= t) for c, t in thresholds.items()]
    return reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(True))


def strength(thresholds: dict[str, float]) -> Column:
    """Mean of value / threshold over lower thresholds other than 0, to 4 places; 0 without one."""
    parts = [F.col(c).cast("double") / F.lit(float(t)) for c, t in thresholds.items() if not c.endswith("_max") and t]
    if not parts:
        return F.lit(0.0)
    there = F.array_compact(F.array(*parts))
    return F.round(F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, b: a + b) / F.size(there)).otherwise(0.0), 4)


def first_price(names: list[str], least: float) -> Column:
    """The first price that is there, if it is ``least`` or more: a low first one isn't made up for by a later one."""
    found = F.coalesce(*[number(n) for n in names])
    return F.when(found >= least, found)


def signals(df: DataFrame, strategies: list[Strategy], keep: list[str], least_odd: float = 1.01) -> DataFrame:
    """A row for each row and strategy that its thresholds and price let through, in one pass over ``df``."""

    def one(s: Strategy) -> Column:
        odd = first_price(s.odds, least_odd)
        made = F.struct(F.lit(s.name).alias("strategy"), F.lit(s.market).alias("market"), odd.alias("odd"), strength(s.thresholds).alias("strength"))
        return F.when(passes(s.thresholds) & odd.isNotNull(), made)

    return df.select(*keep, F.inline(F.array_compact(F.array(*[one(s) for s in strategies]))))


def equity(trades: DataFrame, group: list[str], order: list[str], profit: str = "profit", start: float = 100.0, marks: list[str] | None = None, latest: bool = True) -> DataFrame:
    """Adds bankroll_before, bankroll_after, peak, drawdown and drawdown_pct along each group's order.

    ``peak_place`` and, for each of ``marks``, ``peak_<mark>`` tell of the row of
    the peak. A group of any size spreads over blocks of rows (``scan``).
    """
    marks, gain = marks or [], F.coalesce(profit, F.lit(0.0))
    d = scan.running_peak(scan.numbered(trades, group, order), group, gain, marks, "bankroll_after", "_peak_row", start, latest)
    d = d.withColumn("bankroll_before", F.col("bankroll_after") - gain).withColumns({"peak": F.col("_peak_row.top"), "peak_place": F.col("_peak_row.place"), **{f"peak_{m}": F.col(f"_peak_row.{m}") for m in marks}})
    return d.drop("_peak_row").withColumn("drawdown", F.col("bankroll_after") - F.col("peak")).withColumn("drawdown_pct", ratio_or_zero("drawdown", "peak"))


def percent_stakes(trades: DataFrame, group: list[str], order: list[str], won: Column, odd: str, share: float, start: float = 100.0) -> DataFrame:
    """Stakes that are a share of the running bankroll, so that a trade multiplies it: 1 + share * (odd - 1) or 1 - share.

    The running product is a sum of logarithms, which needs no fold; a factor
    of 0 (all is lost) ends the bankroll for good. Unknown outcomes leave it
    as it is.
    """
    factor = F.when(won, 1 + F.lit(share) * (F.col(odd) - 1)).when(~won, F.lit(1 - share)).otherwise(1.0)
    return _compound(trades.withColumn("_factor", factor).withColumn("_share", F.lit(share)), group, order, start)


def kelly_stakes(trades: DataFrame, group: list[str], order: list[str], won: Column, odd: str, share: str, start: float = 100.0) -> DataFrame:
    """The same for stakes whose share is a column."""
    s = F.coalesce(F.col(share), F.lit(0.0))
    factor = F.when(won, 1 + s * (F.col(odd) - 1)).when(~won, 1 - s).otherwise(1.0)
    return _compound(trades.withColumn("_factor", factor).withColumn("_share", s), group, order, start)


def _compound(d: DataFrame, group: list[str], order: list[str], start: float) -> DataFrame:
    lost = (F.col("_factor") <= 0).cast("double")
    d = scan.numbered(d, group, order)
    d = scan.running_sum(d, group, F.when(F.col("_factor") > 0, F.ln("_factor")).otherwise(0.0), "_logs")
    d = scan.running_sum(d, group, lost, "_lost")
    d = d.withColumn("bankroll_after", F.when(F.col("_lost") > 0, 0.0).otherwise(F.lit(start) * F.exp("_logs")))
    before = F.when(F.col("_lost") - lost > 0, 0.0).when(lost > 0, F.lit(start) * F.exp("_logs")).otherwise(F.col("bankroll_after") / F.col("_factor"))
    d = d.withColumn("_before", before).withColumn("stake", F.col("_before") * F.col("_share"))
    return d.withColumn("profit", F.col("bankroll_after") - F.col("_before")).drop("_factor", "_share", "_logs", "_lost", "_before", "_place", "_block")


def longest_runs(trades: DataFrame, group: list[str], order: list[str], won: str) -> DataFrame:
    """The longest runs of wins and of losses of each group; unknown outcomes break both.

    A run is told by how often the outcome has changed before it, so its rows
    are counted by a key of their own and no window holds a group.
    """
    d = scan.numbered(trades.select(*group, *order, F.col(won).alias("_w")), group, order)
    changed = scan.previous(d, group, F.col("_w"), "_was").withColumn("_turn", (~F.col("_w").eqNullSafe(F.col("_was"))).cast("double"))
    runs = scan.running_sum(changed, group, F.col("_turn"), "_run").groupBy(*group, "_run", "_w").agg(F.count("*").alias("_n"))
    return runs.groupBy(*group).agg(
        F.coalesce(F.max(F.when(F.col("_w"), F.col("_n"))), F.lit(0)).alias("longest_wins"),
        F.coalesce(F.max(F.when(~F.col("_w"), F.col("_n"))), F.lit(0)).alias("longest_losses"),
    )


def profit_factor(profit: str, on_no_loss: str = "null") -> Column:
    """Gains / losses. Without losses, by ``on_no_loss``: null, zero, gains, or wins (how many)."""
    gains = F.sum(F.when(F.col(profit) > 0, F.col(profit)).otherwise(0.0))
    losses = -F.sum(F.when(F.col(profit) < 0, F.col(profit)).otherwise(0.0))
    other = {"null": F.lit(None).cast("double"), "zero": F.lit(0.0), "gains": gains, "wins": F.sum((F.col(profit) > 0).cast("double"))}[on_no_loss]
    return F.when(losses > 0, gains / losses).otherwise(other)


def sharpe(profit: str) -> Column:
    """Mean / population deviation of profits; null below two or without deviation."""
    return F.when(F.count(profit) >= 2, safe_divide(F.avg(profit), F.stddev_pop(profit)))


def summary(trades: DataFrame, group: list[str], won: str = "is_win", on_no_loss: str = "null") -> DataFrame:
    """Trades, wins, win rate, stake, profit, return, mean profit, profit factor and Sharpe ratio of each group."""
    return trades.groupBy(*group).agg(
        F.count("*").alias("trades"),
        F.coalesce(F.sum(F.col(won).cast("long")), F.lit(0)).alias("wins"),
        F.round(F.avg(F.col(won).cast("double")), 6).alias("win_rate"),
        F.round(F.sum("stake"), 4).alias("total_stake"),
        F.round(F.sum("profit"), 4).alias("total_profit"),
        F.round(ratio_or_zero(F.sum("profit"), F.sum("stake")), 6).alias("roi"),
        F.round(F.avg("profit"), 6).alias("mean_profit"),
        F.round(profit_factor("profit", on_no_loss), 6).alias("profit_factor"),
        F.round(sharpe("profit"), 6).alias("sharpe"),
    )


def worst_drawdowns(trades: DataFrame, group: list[str], order: list[str], profit: str = "profit", start: float = 0.0) -> DataFrame:
    """The deepest fall from a peak of each group's running profit, the highest peak and the last total."""
    d = equity(trades, group, order, profit, start)
    return d.groupBy(*group).agg(F.round(F.min("drawdown"), 6).alias("max_drawdown"), F.round(F.max("peak"), 6).alias("peak"), F.round(F.max_by("bankroll_after", "_place"), 6).alias("final"))


#: Totals that differ by less than this are equal: sums of cents come back to a peak only nearly.
_EQUAL = 1e-9


def drawdown_episodes(trades: DataFrame, group: list[str], order: list[str], date: str, profit: str = "profit", start: float = 0.0) -> DataFrame:
    """Each stretch below a peak: peak and its date, trough (the first lowest row), its date and depth, how many trades lie below, and when the peak was reached again (null: not yet).

    An episode begins at the last row on its peak and ends with the first one
    that reaches it again. Groups of any size; no window holds one.
    """
    d = trades.withColumn("_day", F.col(date)).withColumn("_gain", F.coalesce(profit, F.lit(0.0)))
    d = scan.running_peak(scan.numbered(d.select(*group, *[c for c in order if c not in group], "_day", "_gain"), group, order), group, F.round(F.col("_gain"), 9), ["_day"], "_after", "_peak", start)
    under = F.col("_peak.top") - F.col("_after") > _EQUAL
    # A row that reaches the peak only nearly is on it: the peak's place moves to the last such row.
    d = d.withColumn("_under", under).withColumn("_mark", F.when(~F.col("_under"), F.struct("_place", "_day", "_after")))
    d = scan.last_known(d, group, "_mark", "_from")
    d = scan.previous(d, group, F.when(F.col("_under"), F.col("_from._place")), "_ended")
    below = d.filter("_under").groupBy(*group, F.col("_from._place").alias("_episode")).agg(
        F.first("_from").alias("_from"),
        F.min(F.struct(F.round(F.col("_after") - F.col("_from._after"), 9).alias("depth"), "_place", "_day")).alias("_trough"),
        F.count("*").alias("trades_below"),
    )
    ends = d.filter("NOT _under AND _ended IS NOT NULL").select(*group, F.col("_ended").alias("_episode"), F.col("_day").alias("recovered_on"))
    keys = [*group, "_episode"]
    found = below.join(ends.select(*[F.col(k).alias(f"_e_{k}") for k in keys], "recovered_on"), [F.col(k).eqNullSafe(F.col(f"_e_{k}")) for k in keys], "left")
    return found.select(
        *group,
        F.col("_episode").alias("peak_place"),
        F.col("_from._day").alias("peak_on"),
        F.round("_from._after", 6).alias("peak"),
        F.col("_trough._day").alias("trough_on"),
        F.round("_trough.depth", 6).alias("depth"),
        "trades_below",
        "recovered_on",
    )


def drawdown_report(trades: DataFrame, group: list[str], order: list[str], date: str, won: str, profit: str = "profit", start: float = 0.0) -> DataFrame:
    """The worst drawdown of each group: depth, dates of its peak (the first highest row before) and trough, the longest run of losses, and when a later day reached the peak again ("not_recovered": none did)."""
    d = equity(trades.withColumn("_day", F.to_date(date)), group, order, profit, start, ["_day"], latest=False)
    d = d.withColumn("drawdown", F.round("drawdown", 9))
    worst = d.groupBy(*group).agg(F.min(F.struct("drawdown", "_place", "_day", F.col("peak__day").alias("peak_day"), "peak")).alias("_w"))
    again = scan.joined(d.select(*group, "_day", "_place", "bankroll_after"), worst, group).filter((F.col("_day") > F.col("_w._day")) & (F.col("bankroll_after") >= F.col("_w.peak") - _EQUAL))
    recovered = again.groupBy(*group).agg(F.min_by("_day", "_place").alias("_again"), F.lit(1).alias("_hit"))
    runs = longest_runs(trades, group, order, won)
    keyed = lambda x, cols: x.select(*[F.col(k).alias(f"_g_{k}") for k in group], *cols)
    on = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in group]
    out = worst.join(keyed(runs, ["longest_losses"]), on, "left").drop(*[f"_g_{k}" for k in group]).join(keyed(recovered, ["_again"]), on, "left")
    return out.select(
        *group,
        F.round("_w.drawdown", 6).alias("max_drawdown"),
        F.col("_w.peak_day").alias("worst_period_start"),
        F.col("_w._day").alias("worst_period_end"),
        F.col("longest_losses").alias("max_losing_streak"),
        F.coalesce(F.col("_again").cast("string"), F.lit("not_recovered")).alias("recovery_after_worst_drawdown"),
    )


def rank_strategies(totals: DataFrame) -> DataFrame:
    """Adds score = return + profit factor - |drawdown| / 100 and its rank. One row a strategy passes the window."""
    d = totals.withColumn("score", F.round(F.col("roi") + F.coalesce("profit_factor", F.lit(0.0)) - F.abs("max_drawdown") / 100, 6))
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "strategy", "market")))


#: Closed ranges of prices, with gaps; the last is open.
ODDS_RANGES = [(1.20, 1.49), (1.50, 1.79), (1.80, 2.09), (2.10, 2.49), (2.50, None)]


def odds_range(odd: Column, ranges: list = ODDS_RANGES) -> Column:
    """Label of the range of a price, INVALID if it is null, OUT_OF_RANGE in a gap."""
    out = F.when(odd.isNull(), "INVALID")
    for low, high in ranges:
        out = out.when(odd >= low, f"{low:.2f}+") if high is None else out.when(odd.between(low, high), f"{low:.2f}-{high:.2f}")
    return out.otherwise("OUT_OF_RANGE")


def by_periods(trades: DataFrame, date: str) -> DataFrame:
    """Profit by month, quarter and year, one explode and one aggregate."""
    d = F.col(date)
    periods = F.array(
        F.struct(F.lit("month").alias("period_type"), F.date_format(d, "yyyy-MM").alias("period")),
        F.struct(F.lit("quarter").alias("period_type"), F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string")).alias("period")),
        F.struct(F.lit("year").alias("period_type"), F.year(d).cast("string").alias("period")),
    )
    exploded = trades.select("*", F.inline(periods))
    return exploded.groupBy("period_type", "period").agg(F.count("*").alias("trades"), F.round(F.sum("profit"), 4).alias("total_profit"), F.round(ratio_or_zero(F.sum("profit"), F.sum("stake")), 6).alias("roi"))


def rolling_returns(trades: DataFrame, group: list[str], order: list[str], sizes: tuple[int, ...] = (25, 50, 100)) -> DataFrame:
    """For each window size the distribution of the return over full windows of a group. One sort serves all sizes.

    A block of rows also holds the rows before it that its windows reach.

    Returns are rounded to 9 places, so that sums which cancel count as 0. A
    group without a full window has 0 windows and a share of negative ones of 1.
    """
    w = Window.partitionBy(*group, "_block").orderBy("_place")
    d = scan.with_tail(scan.numbered(trades, group, order), max(sizes) - 1)
    for n in sizes:
        f = w.rowsBetween(-(n - 1), 0)
        full = (F.col("_place") >= n) & ~F.col("_halo")
        d = d.withColumn(f"_r{n}", F.round(F.when(full, safe_divide(F.sum("profit").over(f), F.sum("stake").over(f))), 9))
    d = d.filter(~F.col("_halo"))
    d = d.select(*group, F.inline(F.array(*[F.struct(F.lit(n).alias("window"), F.col(f"_r{n}").alias("_r")) for n in sizes])))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return d.groupBy(*group, "window").agg(
        F.count("_r").alias("windows"),
        zero(F.avg("_r")).alias("mean_roi"),
        zero(F.min("_r")).alias("min_roi"),
        zero(F.max("_r")).alias("max_roi"),
        zero(F.stddev_pop("_r")).alias("std_roi"),
        F.round(F.coalesce(F.avg((F.col("_r") < 0).cast("double")), F.lit(1.0)), 6).alias("negative_share"),
    )


def concentration(totals: DataFrame, group: list[str], value: str) -> DataFrame:
    """The largest absolute value over the sum of absolute values of a group; 0 without any."""
    return totals.groupBy(*group).agg(F.round(ratio_or_zero(F.max(F.abs(value)), F.sum(F.abs(value))), 6).alias("concentration"))


def equity_report(trades: DataFrame, group: list[str], order: list[str], start: float = 100.0, places: int | None = 6) -> DataFrame:
    """First and last bankroll, growth, and the deviation of relative changes of each group.

    Bankrolls are rounded to ``places``, so that one which comes to nothing is
    0 and has no relative change after it. Without ``places`` it is what
    rounding of nested sums (``scan``) left of it, and a change may be huge.
    """
    d = scan.numbered(trades.select(*group, *[c for c in order if c not in group], F.coalesce("profit", F.lit(0.0)).alias("_gain")), group, order)
    held = lambda x: F.lit(start) + x if places is None else F.round(F.lit(start) + x, places)
    d = scan.nested_totals(d, group, F.col("_gain")).withColumn("_held", F.transform("_totals", held))
    change = F.transform(F.sequence(F.lit(2), F.size("_held")), lambda i: F.when((F.col("_node") > 0) | (i > 2), safe_divide(F.element_at("_held", i), F.element_at("_held", i - 1)) - 1))
    first, last = F.min_by("_first", "_node"), F.max_by("_last", "_node")
    d = d.withColumn("_first", F.element_at("_held", 2)).withColumn("_last", F.element_at("_held", -1)).withColumn("_change", F.explode(change))
    return d.groupBy(*group).agg(
        F.round(first, 6).alias("first_bankroll"),
        F.round(last, 6).alias("last_bankroll"),
        F.round(last - first, 6).alias("growth"),
        F.round(F.stddev_pop("_change"), 6).alias("volatility"),
    )


def consistency(score_of: dict[str, Column]) -> Column:
    """0 to 100 from sample, return, profit factor, drawdown, deviation and share of negative windows.

    Keys: trades, least_trades, roi, least_roi, profit_factor, least_factor,
    max_drawdown, drawdown_limit, std_roi, negative_share; the last two may be
    null, and then count 20 each.
    """
    s = score_of
    hold = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0))
    sample = F.when(s["trades"] >= 2 * s["least_trades"], 100.0).when(s["trades"] >= s["least_trades"], 60.0).otherwise(10.0)
    by_roi = F.when(s["roi"] > 0, hold(s["roi"] / s["least_roi"] * 30)).otherwise(0.0)
    by_factor = F.when(s["profit_factor"] > 1, hold(s["profit_factor"] / s["least_factor"] * 30)).otherwise(0.0)
    by_drawdown = hold(100 - F.abs(s["max_drawdown"]) / F.abs(s["drawdown_limit"]) * 100)
    steady = F.coalesce(hold(100 - s["std_roi"] * 100), F.lit(20.0))
    positive = F.coalesce(hold(100 - s["negative_share"] * 100), F.lit(20.0))
    return F.round(0.30 * sample + 0.20 * by_roi + 0.20 * by_factor + 0.15 * by_drawdown + 0.075 * steady + 0.075 * positive, 2)


def exposure_budget(candidates: DataFrame, group: list[str], order: list[str], want: str, cap: float) -> DataFrame:
    """Adds granted: what is left of the group's cap, at most what is wanted, in order."""
    d = scan.running_sum(scan.numbered(candidates, group, order), group, F.coalesce(want, F.lit(0.0)), "_upto")
    before = F.col("_upto") - F.coalesce(want, F.lit(0.0))
    return d.withColumn("granted", F.least(F.lit(cap), F.col("_upto")) - F.least(F.lit(cap), before)).drop("_upto", "_place", "_block")


def bankroll_paths(spark, paths: int, bets: int, p: float, odd: float, share: float, seed: int = 0, ruin: float = 0.1) -> DataFrame:
    """Seeded random paths: path, final (as a multiple of the start) and ruined (fell below ``ruin``, where the path stops).

    Paths are rows and a path is folded within its row, so they spread over
    the cluster without a shuffle. Draws come from a hash of seed, path and
    bet, so reruns and other partitionings agree.
    """

    def step(acc: Column, i: Column) -> Column:
        u = F.pmod(F.xxhash64(F.lit(seed), F.col("path"), i), F.lit(1_000_003)) / 1_000_003.0
        moved = F.when(u < p, acc["x"] * (1 + share * (odd - 1))).otherwise(acc["x"] * (1 - share))
        x = F.when(acc["ruined"], acc["x"]).otherwise(moved)
        return F.struct(x.alias("x"), (acc["ruined"] | (x < ruin)).alias("ruined"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(bets)), F.struct(F.lit(1.0).alias("x"), F.lit(False).alias("ruined")), step)
    return spark.range(paths).select(F.col("id").alias("path")).select("path", F.inline(F.array(end))).withColumnRenamed("x", "final")
