"""Price snapshots: best prices, movement, steam, closing-line joins, portfolio shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions import scan
from tallyfield.functions.nulls import safe_divide
from tallyfield.session import spread


def latest_snapshots(odds: DataFrame, snapshot: str, n: int = 12) -> DataFrame:
    """Rows of the last ``n`` snapshots: their times are reduced to one row each before they are ranked."""
    times = odds.select(snapshot).distinct().orderBy(F.desc(snapshot)).limit(n)
    return odds.join(F.broadcast(times), snapshot, "left_semi")  # n rows


def best_prices(odds: DataFrame, key: list[str], bookmaker: str, price: str, reference=None) -> DataFrame:
    """The best of each bookmaker's highest prices, who has it (the smaller name or id if tied), and its ratio to the reference bookmaker's."""
    per = odds.groupBy(*key, bookmaker).agg(F.max(price).alias("_p"))
    ref = F.max(F.when(F.col(bookmaker) == reference, F.col("_p"))) if reference is not None else F.lit(None).cast("double")
    out = per.groupBy(*key).agg(
        F.max("_p").alias("best_price"),
        F.max(F.struct(F.col("_p"), (-F.col(bookmaker)).alias("_b"))).alias("_top"),
        F.count("*").alias("bookmakers"),
        ref.alias("reference_price"),
    )
    return out.withColumn("best_bookmaker", -F.col("_top._b")).withColumn("ratio", safe_divide("best_price", "reference_price")).drop("_top")


def opening_and_current(odds: DataFrame, key: list[str], snapshot: str, price: str) -> DataFrame:
    """Mean price in each key's first and last snapshot, in one aggregate over (key, snapshot)."""
    per = odds.groupBy(*key, snapshot).agg(F.avg(price).alias("_p"))
    return per.groupBy(*key).agg(F.min_by("_p", snapshot).alias("opening"), F.max_by("_p", snapshot).alias("current"), F.max(snapshot).alias("last_snapshot"))


def movement(opening: Column, current: Column) -> Column:
    """(opening - current) / opening: positive if the price fell; 0 for an opening of 0 or less."""
    return F.when(opening > 0, (opening - current) / opening).otherwise(0.0)


def movement_class(change: Column, hours: Column) -> Column:
    """Kind of movement by its size and the hours to the start."""
    size = F.abs(change)
    return (
        F.when((size > 0.08) & (hours > 24), "SHARP_MOVEMENT")
        .when((size > 0.08) & (hours <= 24), "LATE_SHARP")
        .when((size < 0.03) & (hours < 2), "PUBLIC_MONEY")
        .when(size >= 0.04, "SIGNIFICANT_MOVEMENT")
        .otherwise("NEUTRAL")
    )


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], ties: list[str] | None = None, within: str | None = None) -> DataFrame:
    """Each left row with ``columns`` of the last right row of its keys that is no later; null where there is none, or none ``within`` an interval such as "3 days".

    Both sides are put in one order, by keys and time, right rows first at
    equal times, and the last right row so far is carried along (``scan``):
    no pairs are made, and a key with most of the rows spreads over tasks. Of
    right rows of one time the last by ``ties`` counts. A null key meets null;
    a row without a time comes before all others and so gets nothing. Adds
    ``matched_at`` and ``matched_<column>``.
    """
    ties = ties or []
    when = lambda d, t: d.withColumn("_at", F.col(t).cast("timestamp"))
    known = F.struct(F.col("_at").alias("at"), *[F.col(c).alias(c) for c in columns])
    r = when(right, right_time).filter("_at IS NOT NULL").select(*keys, "_at", F.lit(0).alias("_side"), *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(ties)], known.alias("_known"))
    row = F.struct(*[F.col(c).alias(c) for c in left.columns])
    both = r.unionByName(when(left, left_time).select(*keys, "_at", F.lit(1).alias("_side"), row.alias("_row")), allowMissingColumns=True)
    d = scan.last_known(scan.numbered(both, keys, ["_at", "_side", *[f"_tie{i}" for i in range(len(ties))]]), keys, "_known", "_last").filter("_side = 1")
    fits = F.col("_last.at") <= F.col("_at")
    if within:
        fits = fits & (F.col("_last.at") >= F.col("_at") - F.expr(f"INTERVAL {within}"))
    hit = lambda c: F.when(fits, F.col(f"_last.{c}"))
    return d.select("_row.*", hit("at").alias("matched_at"), *[hit(c).alias(f"matched_{c}") for c in columns])


def movement_modifier(kind: Column, steamed: Column) -> Column:
    """How much a movement adds to or takes from confidence."""
    return F.when(steamed, 0.15).when(kind == "SHARP_MOVEMENT", 0.10).when(kind == "LATE_SHARP", 0.08).when(kind == "PUBLIC_MONEY", -0.05).otherwise(0.0)


def movement_report(odds: DataFrame, matches: DataFrame, match: str, line: list[str], bookmaker: str, snapshot: str, price: str, start: str, now: Column, reference, snapshots: int = 12, hours: float = 72) -> DataFrame:
    """Lines of matches that start within ``hours`` from ``now``: reference prices of the first of the last ``snapshots`` and as they stand now, movement, its class, steam and the modifier of confidence.

    The price of now is the reference bookmaker's last one before ``now`` (an
    as-of join); lines without a first or a last one are left out. ``matches``
    has a row a match with its start.
    """
    recent = latest_snapshots(odds, snapshot, snapshots)
    ahead = matches.withColumn("_now", now.cast("timestamp")).withColumn("hours_to_start", (F.unix_micros(F.col(start).cast("timestamp")) - F.unix_micros("_now")) / 3.6e9)
    ahead = ahead.filter((F.col("hours_to_start") >= 0) & (F.col("hours_to_start") <= hours))
    opening_at = recent.agg(F.min(snapshot).alias("_first"))
    mine = recent.filter(F.col(bookmaker) == reference).groupBy(match, *line, snapshot).agg(F.avg(price).alias("_p"))
    opening = mine.join(F.broadcast(opening_at), F.col(snapshot) == F.col("_first")).select(match, *line, F.col("_p").alias("opening"))  # one row
    lines = opening.join(ahead, match)
    current = asof_join(lines, mine, [match, *line], "_now", snapshot, ["_p"]).filter("matched__p IS NOT NULL").withColumnRenamed("matched__p", "current")
    moved = movement(F.col("opening"), F.col("current"))
    steamed = steam(recent, [match, *line], bookmaker, snapshot, price).select(match, *line, "steam", "direction")
    d = current.withColumn("_m", moved).join(steamed, [match, *line], "left").withColumn("steam", F.coalesce("steam", F.lit(False)))
    d = d.withColumn("movement_type", movement_class(F.col("_m"), F.col("hours_to_start")))
    return d.select(match, *line, F.round("hours_to_start", 1).alias("hours_to_start"), F.round("opening", 3).alias("opening"), F.round("current", 3).alias("current"), (F.round(F.col("_m") * 100, 2) + 0.0).alias("movement_pct"), "movement_type", "steam", "direction", movement_modifier(F.col("movement_type"), F.col("steam")).alias("modifier"))


def movement_summary(report: DataFrame, match: str) -> DataFrame:
    """One row: matches, lines, sharp movements and steam moves of a report."""
    per = report.groupBy(match).agg(F.count("*").alias("n"), F.sum(F.col("movement_type").isin("SHARP_MOVEMENT", "LATE_SHARP").cast("long")).alias("s"), F.sum(F.col("steam").cast("long")).alias("t"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(F.count("*").alias("matches_analyzed"), total("n").alias("total_lines"), total("s").alias("sharp_movements"), total("t").alias("steam_moves"))


def steam(odds: DataFrame, key: list[str], bookmaker: str, snapshot: str, price: str, least: int = 3, share: float = 0.7, step: float = 0.02) -> DataFrame:
    """Whether ``least`` bookmakers and ``share`` of those with a first and a last price moved the same way by more than ``step``.

    Keys are dealt out by numbers of rows (``spread``), so all its groupings
    are of one task's keys and stay in bounds.
    """
    odds = spread(odds.select(*key, bookmaker, snapshot, price), key)
    per = opening_and_current(odds, [*key, bookmaker], snapshot, price).filter("opening > 0 AND current > 0")
    change = movement(F.col("opening"), F.col("current"))
    totals = per.withColumn("_c", change).groupBy(*key).agg(
        F.count("*").alias("bookmakers"),
        F.coalesce(F.sum((F.col("_c") > step).cast("long")), F.lit(0)).alias("down"),
        F.coalesce(F.sum((F.col("_c") < -step).cast("long")), F.lit(0)).alias("up"),
        (F.round(F.avg("_c") * 100, 4) + 0.0).alias("mean_movement_pct"),
    )
    most = F.greatest("down", "up")
    found = (F.col("bookmakers") >= least) & (most >= least) & (most / F.col("bookmakers") >= share)
    return totals.withColumn("steam", found).withColumn("direction", F.when(found, F.when(F.col("down") > F.col("up"), "DOWN").otherwise("UP")))


def closing_prices(trades: DataFrame, odds: DataFrame, key: list[str], price: str) -> DataFrame:
    """Trades with the mean closing price of their key. Prices are reduced to one row a key first."""
    return trades.join(odds.groupBy(*key).agg(F.avg(price).alias("closing_price")), key, "left")


def clv_summary(trades: DataFrame, group: list[str], value: str, date: str, as_of: Column, days: int = 30) -> DataFrame:
    """Closing-line value of each group: mean, share of positive ones, mean of the last ``days`` days, and whether it falls or beats the market."""
    recent = F.col(date) >= F.date_sub(as_of, days)
    d = trades.groupBy(*group).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("_mean"),
        F.avg((F.col(value) > 0).cast("double")).alias("_positive"),
        F.count(F.when(recent, F.col(value))).alias("n_recent"),
        F.avg(F.when(recent, F.col(value))).alias("_recent"),
    )
    return d.select(
        *group, "n", "n_recent",
        F.round("_mean", 6).alias("mean_clv"), F.round("_positive", 6).alias("positive_rate"), F.round("_recent", 6).alias("recent_clv"),
        ((F.col("n_recent") >= 10) & F.coalesce(F.col("_recent") < F.col("_mean") - 0.02, F.lit(False))).alias("falling"),
        (F.coalesce(F.col("_mean") > 0.01, F.lit(False)) & (F.col("n") >= 50)).alias("beats_market"),
    )


def portfolio_shares(candidates: DataFrame, group: str, market: str, share: str, correlations: DataFrame, limit: float = 0.6, most: float = 0.15, default: float = 0.15) -> DataFrame:
    """Kelly shares of candidates of a group (a day), less for correlated ones, scaled to ``most`` in total.

    Of a pair of markets correlated beyond ``limit`` the one with the smaller
    share (the later name if equal) is halved, once for each such pair.
    ``correlations``: market_a, market_b, correlation; a pair that isn't listed
    has ``default``. Shares are summed by market first, so a group meets itself
    market by market, of which there are few.
    """
    per = candidates.groupBy(group, market).agg(F.sum(share).alias("_s"))
    other = per.select(F.col(group), F.col(market).alias("_other"), F.col("_s").alias("_os"))
    pairs = per.join(other, group).filter(F.col(market) != F.col("_other"))
    a, b = F.least(market, "_other"), F.greatest(market, "_other")
    both = correlations.select(F.least("market_a", "market_b").alias("_a"), F.greatest("market_a", "market_b").alias("_b"), "correlation")
    pairs = pairs.withColumn("_a", a).withColumn("_b", b).join(both, ["_a", "_b"], "left").withColumn("_c", F.coalesce("correlation", F.lit(default)))
    smaller = (F.col("_s") < F.col("_os")) | ((F.col("_s") == F.col("_os")) & (F.col(market) > F.col("_other")))
    cuts = pairs.groupBy(group, market).agg(F.sum(((F.col("_c") > limit) & smaller).cast("int")).alias("_cuts"))
    d = candidates.join(cuts, [group, market], "left").withColumn("_kept", F.col(share) * F.pow(F.lit(0.5), F.coalesce("_cuts", F.lit(0))))
    total = d.groupBy(group).agg(F.sum("_kept").alias("_total"))
    return d.join(total, group).withColumn("portfolio_share", F.round(F.col("_kept") * F.least(F.lit(1.0), F.coalesce(safe_divide(F.lit(most), "_total"), F.lit(1.0))), 6)).drop("_cuts", "_kept", "_total")


def expand_odds(payload: DataFrame, json: str) -> DataFrame:
    """Nested price documents as rows: event, bookmaker, market and outcome by three chained explodes."""
    schema = "id string, home_team string, away_team string, commence_time string, bookmakers array<struct<key:string,last_update:string,markets:array<struct<key:string,outcomes:array<struct<name:string,price:double,point:double>>>>>>"
    d = payload.select(F.from_json(json, schema).alias("e")).select("e.*", F.explode("e.bookmakers").alias("b"))
    d = d.select("id", "home_team", "away_team", "commence_time", F.col("b.key").alias("bookmaker"), F.col("b.last_update").alias("last_update"), F.explode("b.markets").alias("m"))
    d = d.select("*", F.col("m.key").alias("market"), F.explode("m.outcomes").alias("o"))
    return d.select(F.col("id").alias("match_id"), "home_team", "away_team", "commence_time", "bookmaker", "last_update", "market", F.col("o.name").alias("selection"), F.col("o.price").alias("odds_value"), F.col("o.point").alias("point"))


def first_of_group(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter("_n = 1").drop("_n")


def last_n(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group by ``order`` (descending orders give the last)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")
