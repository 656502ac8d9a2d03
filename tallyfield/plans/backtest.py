"""Queries over trades: signals, bankrolls, performance, refinement."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfield.functions import pricing
from tallyfield.functions.nulls import ratio_or_zero
from tallyfield.operators import decisions, features, stats
from tallyfield.operators import trades as t
from tallyfield.plans.bindings import TEAM_SQL, TRADE_SQL, table, team_rows, trade_rows

QUERIES, SQL = {}, {}
_G, _O = ["strategy", "market"], ["ts", "event_id"]
_W = "OVER (PARTITION BY strategy, market ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


_STRATEGIES = [
    t.Strategy("goals_over_2_5", "goals", {"g5": 2.0, "s5": 9.0}, ["odd_a", "odd_b"], 2.5),
    t.Strategy("shots", "shots", {"s5": 10.0}, ["odd_b"], 9.5),
    t.Strategy("low_corners", "corners", {"c5_max": 4.5, "s5": 0.0}, ["odd_a"], 9.5),
]


@query(f"""WITH {TEAM_SQL}, p AS (SELECT event_id,
    avg(goals) OVER w AS g5, avg(shots) OVER w AS s5, avg(corners) OVER w AS c5,
    CASE WHEN event_id % 5 <> 0 THEN round(1.0 + (event_id % 30) / 10.0, 2) END AS odd_a, CASE WHEN event_id % 3 <> 0 THEN 1.9 END AS odd_b
  FROM team WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
s AS (
  SELECT event_id, 'goals_over_2_5' AS strategy, 'goals' AS market, coalesce(odd_a, odd_b) AS odd, round((g5 / 2.0 + s5 / 9.0) / 2, 4) AS strength FROM p WHERE g5 >= 2.0 AND s5 >= 9.0
  UNION ALL SELECT event_id, 'shots', 'shots', odd_b, round(s5 / 10.0, 4) FROM p WHERE s5 >= 10.0
  UNION ALL SELECT event_id, 'low_corners', 'corners', odd_a, 0.0 FROM p WHERE c5 <= 4.5 AND s5 >= 0.0)
SELECT event_id, strategy, market, CAST(odd AS DOUBLE) AS odd, round(strength, 3) AS strength FROM s WHERE odd >= 1.2""")
def threshold_signals(spark, d):
    rows = features.past_features(team_rows(spark, d), ["user_id"], _O, {"g5": ("mean", "goals", 5), "s5": ("mean", "shots", 5), "c5": ("mean", "corners", 5)})
    rows = rows.withColumn("odd_a", F.when(F.col("event_id") % 5 != 0, F.round(1.0 + (F.col("event_id") % 30) / 10.0, 2))).withColumn("odd_b", F.when(F.col("event_id") % 3 != 0, 1.9))
    return t.signals(rows, _STRATEGIES, ["event_id"], least_odd=1.2).withColumn("strength", F.round("strength", 3))


@query(f"""WITH {TRADE_SQL}, e AS (SELECT event_id, profit, 100 + sum(profit) {_W} AS after FROM trade),
f AS (SELECT e.event_id, e.profit, e.after, max(e.after) OVER (PARTITION BY strategy, market ORDER BY ts, e.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM e JOIN trade USING (event_id))
SELECT event_id, round(after, 4) AS bankroll_after, round(after - profit, 4) AS bankroll_before, round(after - peak, 4) AS drawdown, round(coalesce((after - peak) / nullif(peak, 0), 0), 6) AS drawdown_pct FROM f""")
def flat_equity(spark, d):
    e = t.equity(trade_rows(spark, d), _G, _O)
    return e.select("event_id", *[F.round(c, 4).alias(c) for c in ("bankroll_after", "bankroll_before", "drawdown")], F.round("drawdown_pct", 6).alias("drawdown_pct"))


@query(f"""WITH {TRADE_SQL}, x AS (SELECT *, CASE WHEN is_win THEN 1 + 0.01 * (odd - 1) ELSE 0.99 END AS factor FROM trade),
e AS (SELECT event_id, factor, 100 * exp(sum(ln(factor)) {_W}) AS after FROM x) SELECT event_id, round(after, 4) AS bankroll_after, round(after / factor * 0.01, 4) AS stake FROM e""")
def percent_equity(spark, d):
    e = t.percent_stakes(trade_rows(spark, d), _G, _O, F.col("is_win"), "odd", 0.01)
    return e.select("event_id", F.round("bankroll_after", 4).alias("bankroll_after"), F.round("stake", 4).alias("stake"))


_KELLY = "CASE WHEN p > 0 AND p < 1 AND odd > 1 AND ((odd - 1) * p - (1 - p)) / (odd - 1) > 0 THEN round(least(greatest(((odd - 1) * p - (1 - p)) / (odd - 1) * 0.25, 0.005), 0.05), 4) ELSE 0.0 END"


@query(f"""WITH {TRADE_SQL}, k AS (SELECT *, {_KELLY.replace('p ', '0.45 ').replace(' p)', ' 0.45)').replace('* p', '* 0.45').replace('- p)', '- 0.45)')} AS share FROM trade),
x AS (SELECT *, CASE WHEN is_win THEN 1 + share * (odd - 1) ELSE 1 - share END AS factor FROM k),
e AS (SELECT event_id, factor, share, 100 * exp(sum(ln(factor)) {_W}) AS after FROM x) SELECT event_id, share, round(after, 3) AS bankroll_after FROM e""")
def kelly_equity(spark, d):
    rows = trade_rows(spark, d).withColumn("share", pricing.kelly(F.lit(0.45), F.col("odd")))
    return t.kelly_stakes(rows, _G, _O, F.col("is_win"), "odd", "share").select("event_id", "share", F.round("bankroll_after", 3).alias("bankroll_after"))


_SUMMARY = """count(*) AS trades, CAST(sum(CAST(is_win AS BIGINT)) AS BIGINT) AS wins, round(avg(CAST(is_win AS DOUBLE)), 6) AS win_rate, round(sum(stake), 4) AS total_stake, round(sum(profit), 4) AS total_profit,
 round(coalesce(sum(profit) / nullif(sum(stake), 0), 0), 6) AS roi, round(avg(profit), 6) AS mean_profit,
 round(sum(CASE WHEN profit > 0 THEN profit ELSE 0 END) / nullif(-sum(CASE WHEN profit < 0 THEN profit ELSE 0 END), 0), 6) AS profit_factor,
 round(CASE WHEN count(profit) >= 2 THEN avg(profit) / nullif(stddev_pop(profit), 0) END, 6) AS sharpe"""


@query(f"WITH {TRADE_SQL} SELECT strategy, market, {_SUMMARY} FROM trade GROUP BY 1, 2")
def trade_summary(spark, d):
    return t.summary(trade_rows(spark, d), _G)


@query(f"WITH {TRADE_SQL} SELECT market, {_SUMMARY}, round(coalesce(sum(profit) / nullif(sum(stake), 0), 0) * 100, 4) AS roi_percent FROM trade GROUP BY 1")
def market_performance(spark, d):
    return t.summary(trade_rows(spark, d), ["market"]).withColumn("roi_percent", F.round(F.col("roi") * 100, 4))


@query(f"WITH {TRADE_SQL} SELECT league, market, {_SUMMARY}, CASE WHEN count(*) < 100 THEN 'HIGH' WHEN sum(profit) < 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM trade GROUP BY 1, 2")
def league_market_matrix(spark, d):
    s = t.summary(trade_rows(spark, d), ["league", "market"])
    return s.withColumn("risk", F.when(F.col("trades") < 100, "HIGH").when(F.col("total_profit") < 0, "MEDIUM").otherwise("LOW"))


@query(f"""WITH {TRADE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY strategy, market ORDER BY ts, event_id) - row_number() OVER (PARTITION BY strategy, market, is_win ORDER BY ts, event_id) AS run FROM trade),
c AS (SELECT strategy, market, is_win, run, count(*) AS n FROM r GROUP BY 1, 2, 3, 4)
SELECT strategy, market, coalesce(max(CASE WHEN is_win THEN n END), 0) AS longest_wins, coalesce(max(CASE WHEN NOT is_win THEN n END), 0) AS longest_losses FROM c GROUP BY 1, 2""")
def max_streaks(spark, d):
    return t.longest_runs(trade_rows(spark, d), _G, _O, "is_win")


_DD = f"""e AS (SELECT strategy, market, ts, event_id, profit, sum(profit) {_W} AS after FROM trade),
f AS (SELECT *, max(after) {_W} AS peak FROM e),
dd AS (SELECT strategy, market, round(min(after - peak), 6) AS max_drawdown, round(max(peak), 6) AS peak, round(arg_max(after, event_id), 6) AS final FROM f GROUP BY 1, 2)"""


@query(f"WITH {TRADE_SQL}, {_DD.replace('arg_max(after, event_id)', 'arg_max(after, row(ts, event_id))')} SELECT * FROM dd")
def drawdown_curve(spark, d):
    return t.worst_drawdowns(trade_rows(spark, d), _G, _O)


@query(f"""WITH {TRADE_SQL}, e AS (SELECT *, round(sum(profit) {_W}, 9) AS after, row_number() OVER (PARTITION BY strategy, market ORDER BY ts, event_id) AS place FROM trade),
f AS (SELECT *, max(after) {_W} AS top FROM e),
g AS (SELECT *, top - after > 1e-9 AS under, max(CASE WHEN top - after <= 1e-9 THEN place END) {_W} AS episode FROM f),
t AS (SELECT strategy, market, episode, count(*) AS trades_below, max(place) + 1 AS ended, arg_min(day, (after, place)) AS trough_on, min(after) AS low FROM g WHERE under GROUP BY ALL)
SELECT t.strategy, t.market, t.episode AS peak_place, p.day AS peak_on, round(p.after, 6) AS peak, t.trough_on, round(t.low - p.after, 6) AS depth, t.trades_below, r.day AS recovered_on
FROM t JOIN g p ON p.strategy = t.strategy AND p.market = t.market AND p.place = t.episode LEFT JOIN g r ON r.strategy = t.strategy AND r.market = t.market AND r.place = t.ended""")
def drawdown_episodes(spark, d):
    """Every stretch below a peak of the running profit."""
    return t.drawdown_episodes(trade_rows(spark, d), _G, _O, "day")


@query(f"""WITH {TRADE_SQL}, e AS (SELECT *, round(sum(profit) {_W}, 9) AS after, row_number() OVER (PARTITION BY strategy, market ORDER BY ts, event_id) AS place FROM trade),
f AS (SELECT *, max(after) {_W} AS top FROM e), g AS (SELECT *, round(after - top, 9) AS dd FROM f),
w AS (SELECT strategy, market, min(dd) AS dd, arg_min(place, (dd, place)) AS place, arg_min(day, (dd, place)) AS day, arg_min(top, (dd, place)) AS top FROM g GROUP BY 1, 2),
s AS (SELECT g.strategy, g.market, arg_min(g.day, g.place) AS day FROM g JOIN w ON g.strategy = w.strategy AND g.market = w.market AND g.place <= w.place AND abs(g.after - w.top) < 1e-9 GROUP BY 1, 2),
r AS (SELECT g.strategy, g.market, arg_min(g.day, g.place) AS day FROM g JOIN w ON g.strategy = w.strategy AND g.market = w.market AND g.day > w.day AND g.after >= w.top - 1e-9 GROUP BY 1, 2),
n AS (SELECT *, place - row_number() OVER (PARTITION BY strategy, market, is_win ORDER BY ts, event_id) AS run FROM e),
l AS (SELECT strategy, market, max(n) AS n FROM (SELECT strategy, market, run, count(*) AS n FROM n WHERE NOT is_win GROUP BY ALL) GROUP BY 1, 2)
SELECT w.strategy, w.market, round(w.dd, 6) AS max_drawdown, s.day AS worst_period_start, w.day AS worst_period_end, coalesce(l.n, 0) AS max_losing_streak, coalesce(CAST(r.day AS VARCHAR), 'not_recovered') AS recovery_after_worst_drawdown
FROM w JOIN s USING (strategy, market) LEFT JOIN r USING (strategy, market) LEFT JOIN l USING (strategy, market)""")
def drawdown_report(spark, d):
    """The worst drawdown of each strategy and market, with its dates."""
    return t.drawdown_report(trade_rows(spark, d), _G, _O, "day", "is_win")


_RANK = f"s AS (SELECT strategy, market, {_SUMMARY} FROM trade GROUP BY 1, 2), {_DD.replace('arg_max(after, event_id)', 'max(after)')}"


@query(f"WITH {TRADE_SQL}, {_RANK}, c AS (SELECT strategy, market, round(roi + coalesce(profit_factor, 0) - abs(max_drawdown) / 100, 6) AS score FROM s JOIN dd USING (strategy, market)) SELECT *, CAST(row_number() OVER (ORDER BY score DESC, strategy, market) AS INTEGER) AS rank FROM c")
def strategy_ranking(spark, d):
    rows = trade_rows(spark, d)
    return t.rank_strategies(t.summary(rows, _G).join(t.worst_drawdowns(rows, _G, _O), _G)).select("strategy", "market", "score", "rank")


@query(f"WITH {TRADE_SQL} SELECT strategy, market, count(*) AS trades, CASE WHEN count(*) < 50 THEN 'LOW_SAMPLE' WHEN count(*) < 100 THEN 'MEDIUM_SAMPLE' ELSE 'HIGH_SAMPLE' END AS sample, count(*) >= 50 AND sum(profit) > 0 AS is_edge_reliable FROM trade GROUP BY 1, 2")
def qualified_strategies(spark, d):
    s = trade_rows(spark, d).groupBy(*_G).agg(F.count("*").alias("trades"), F.sum("profit").alias("_p"))
    n = F.col("trades")
    return s.select(*_G, "trades", F.when(n < 50, "LOW_SAMPLE").when(n < 100, "MEDIUM_SAMPLE").otherwise("HIGH_SAMPLE").alias("sample"), ((n >= 50) & (F.col("_p") > 0)).alias("is_edge_reliable"))


_RANGE = "CASE WHEN odd IS NULL THEN 'INVALID' WHEN odd BETWEEN 1.20 AND 1.49 THEN '1.20-1.49' WHEN odd BETWEEN 1.50 AND 1.79 THEN '1.50-1.79' WHEN odd BETWEEN 1.80 AND 2.09 THEN '1.80-2.09' WHEN odd BETWEEN 2.10 AND 2.49 THEN '2.10-2.49' WHEN odd >= 2.50 THEN '2.50+' ELSE 'OUT_OF_RANGE' END"


@query(f"WITH {TRADE_SQL} SELECT market, {_RANGE} AS odds_range, {_SUMMARY} FROM trade GROUP BY 1, 2")
def odds_buckets(spark, d):
    return t.summary(trade_rows(spark, d).withColumn("odds_range", t.odds_range(F.col("odd"))), ["market", "odds_range"])


@query(f"""WITH {TRADE_SQL}, p AS (SELECT 'month' AS period_type, strftime(ts, '%Y-%m') AS period, stake, profit FROM trade
UNION ALL SELECT 'quarter', CAST(year(ts) AS VARCHAR) || 'Q' || CAST(quarter(ts) AS VARCHAR), stake, profit FROM trade UNION ALL SELECT 'year', CAST(year(ts) AS VARCHAR), stake, profit FROM trade)
SELECT period_type, period, count(*) AS trades, round(sum(profit), 4) AS total_profit, round(sum(profit) / sum(stake), 6) AS roi FROM p GROUP BY 1, 2""")
def temporal_multi_grain(spark, d):
    return t.by_periods(trade_rows(spark, d), "ts")


def _roll(n: int) -> str:
    f = f"OVER (PARTITION BY strategy, market ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"SELECT strategy, market, {n} AS w, CASE WHEN count(*) {f} = {n} THEN round(sum(profit) {f} / nullif(sum(stake) {f}, 0), 9) END AS r FROM trade"


@query(f"""WITH {TRADE_SQL}, r AS ({_roll(25)} UNION ALL {_roll(50)} UNION ALL {_roll(100)})
SELECT strategy, market, w AS "window", count(r) AS windows, round(coalesce(avg(r), 0), 6) AS mean_roi, round(coalesce(min(r), 0), 6) AS min_roi, round(coalesce(max(r), 0), 6) AS max_roi,
 round(coalesce(stddev_pop(r), 0), 6) AS std_roi, round(coalesce(avg(CAST(r < 0 AS DOUBLE)), 1.0), 6) AS negative_share FROM r GROUP BY 1, 2, 3""")
def rolling_roi(spark, d):
    return t.rolling_returns(trade_rows(spark, d), _G, _O)


@query(f"""WITH {TRADE_SQL}, e AS (SELECT strategy, market, ts, event_id, 10000 + sum(profit) {_W} AS after FROM trade),
c AS (SELECT *, after / nullif(lag(after) OVER (PARTITION BY strategy, market ORDER BY ts, event_id), 0) - 1 AS change FROM e)
SELECT strategy, market, round(arg_min(after, row(ts, event_id)), 6) AS first_bankroll, round(arg_max(after, row(ts, event_id)), 6) AS last_bankroll,
 round(arg_max(after, row(ts, event_id)) - arg_min(after, row(ts, event_id)), 6) AS growth, round(stddev_pop(change), 6) AS volatility FROM c GROUP BY 1, 2""")
def equity_report(spark, d):
    """As the SQL has it, a change is also taken from what rounding left of a bankroll of nothing."""
    return t.equity_report(trade_rows(spark, d), _G, _O, start=10000.0, places=None)


@query(f"WITH {TRADE_SQL}, m AS (SELECT league, market, sum(profit) AS p FROM trade GROUP BY 1, 2) SELECT market, round(coalesce(max(abs(p)) / nullif(sum(abs(p)), 0), 0), 6) AS concentration FROM m GROUP BY 1")
def concentration(spark, d):
    return t.concentration(trade_rows(spark, d).groupBy("league", "market").agg(F.sum("profit").alias("p")), ["market"], "p")


_CONS = f"""{_RANK}, rr AS ({_roll(50)}), ra AS (SELECT strategy, market, stddev_pop(r) AS std_roi, avg(CAST(r < 0 AS DOUBLE)) AS negative_share FROM rr GROUP BY 1, 2),
cj AS (SELECT * FROM s JOIN dd USING (strategy, market) JOIN ra USING (strategy, market))"""


@query(f"""WITH {TRADE_SQL}, {_CONS} SELECT strategy, market, round(
 0.30 * CASE WHEN trades >= 200 THEN 100.0 WHEN trades >= 100 THEN 60.0 ELSE 10.0 END
 + 0.20 * CASE WHEN roi > 0 THEN least(greatest(roi / 0.03 * 30, 0), 100) ELSE 0 END
 + 0.20 * CASE WHEN profit_factor > 1 THEN least(greatest(profit_factor / 1.05 * 30, 0), 100) ELSE 0 END
 + 0.15 * least(greatest(100 - abs(max_drawdown) / 20 * 100, 0), 100)
 + 0.075 * coalesce(least(greatest(100 - std_roi * 100, 0), 100), 20) + 0.075 * coalesce(least(greatest(100 - negative_share * 100, 0), 100), 20), 2) AS consistency_score FROM cj""")
def consistency_score(spark, d):
    rows = trade_rows(spark, d)
    f = Window.partitionBy(*_G).orderBy(*_O).rowsBetween(-49, 0)
    r = rows.withColumn("r", F.round(F.when(F.count("*").over(f) == 50, F.try_divide(F.sum("profit").over(f), F.sum("stake").over(f))), 9))
    r = r.groupBy(*_G).agg(F.stddev_pop("r").alias("std_roi"), F.avg((F.col("r") < 0).cast("double")).alias("negative_share"))
    j = t.summary(rows, _G).join(t.worst_drawdowns(rows, _G, _O), _G).join(r, _G)
    c = {n: F.col(n) for n in ("trades", "roi", "profit_factor", "max_drawdown", "std_roi", "negative_share")}
    score = t.consistency(c | {"least_trades": F.lit(100), "least_roi": F.lit(0.03), "least_factor": F.lit(1.05), "drawdown_limit": F.lit(20.0)})
    return j.select(*_G, score.alias("consistency_score"))


@query(f"""WITH {TRADE_SQL}, {_RANK}, j AS (SELECT * FROM s JOIN dd USING (strategy, market)), r AS (SELECT *, list_filter([CASE WHEN NOT coalesce(trades >= 700, false) THEN 'LOW_TRADES' END, CASE WHEN NOT coalesce(roi >= -0.2, false) THEN 'LOW_ROI' END,
 CASE WHEN NOT coalesce(profit_factor >= 0.7, false) THEN 'LOW_FACTOR' END, CASE WHEN NOT coalesce(max_drawdown >= -150, false) THEN 'DRAWDOWN' END], lambda x: x IS NOT NULL) AS l FROM j)
SELECT strategy, market, array_to_string(l, '|') AS reasons, CASE WHEN len(l) = 0 THEN 'KEEP' ELSE 'DISCARD' END AS verdict FROM r""")
def refine_strategies(spark, d):
    rows = trade_rows(spark, d)
    return decisions.refine(t.summary(rows, _G).join(t.worst_drawdowns(rows, _G, _O), _G), 700, -0.2, 0.7, -150.0).select("strategy", "market", "reasons", "verdict")


@query(f"""WITH {TRADE_SQL}, s AS (SELECT league, {_SUMMARY} FROM trade GROUP BY 1) SELECT league, CASE WHEN trades < 100 THEN 'DISCARD' WHEN roi >= 0.03 AND profit_factor >= 1.05 THEN 'STRONG'
 WHEN roi >= 0 AND profit_factor >= 1 THEN 'ACCEPTABLE' WHEN roi > -0.02 THEN 'WEAK' ELSE 'DISCARD' END AS grade FROM s""")
def refine_leagues(spark, d):
    s = t.summary(trade_rows(spark, d), ["league"])
    return s.select("league", decisions.league_grade(F.col("trades"), F.col("roi"), F.col("profit_factor"), 100, 0.03, 1.05).alias("grade"))


@query(f"""WITH {TRADE_SQL}, s AS (SELECT market, {_RANGE} AS odds_range, {_SUMMARY} FROM trade GROUP BY 1, 2) SELECT market, odds_range, CASE WHEN trades < 100 THEN 'AVOID' WHEN roi >= 0.03 AND profit_factor >= 1.05 AND mean_profit > 0 THEN 'FAVORABLE'
 WHEN roi >= 0 AND profit_factor >= 1 THEN 'NEUTRAL' WHEN roi > -0.03 THEN 'RISKY' ELSE 'AVOID' END AS grade FROM s""")
def refine_odds(spark, d):
    s = t.summary(trade_rows(spark, d).withColumn("odds_range", t.odds_range(F.col("odd"))), ["market", "odds_range"])
    return s.select("market", "odds_range", decisions.odds_grade(F.col("trades"), F.col("roi"), F.col("profit_factor"), F.col("mean_profit"), 100, 0.03, 1.05).alias("grade"))


@query(f"""WITH {TRADE_SQL}, {_RANK}, j AS (SELECT * FROM s JOIN dd USING (strategy, market))
SELECT strategy, market, 'LOW_SAMPLE_SIZE' AS flag, 'HIGH' AS severity FROM j WHERE trades < 700 UNION ALL SELECT strategy, market, 'HIGH_DRAWDOWN', 'HIGH' FROM j WHERE max_drawdown <= -20
UNION ALL SELECT strategy, market, 'POSSIBLE_OVERFITTING', 'HIGH' FROM j WHERE trades < 700 AND roi > 0 UNION ALL SELECT strategy, market, 'UNSTABLE_ROI', 'MEDIUM' FROM j WHERE sharpe < -0.1""")
def risk_flags(spark, d):
    rows = trade_rows(spark, d)
    j = t.summary(rows, _G).join(t.worst_drawdowns(rows, _G, _O), _G)
    few = F.col("trades") < 700
    rules = {"LOW_SAMPLE_SIZE": ("HIGH", few), "HIGH_DRAWDOWN": ("HIGH", F.col("max_drawdown") <= -20), "POSSIBLE_OVERFITTING": ("HIGH", few & (F.col("roi") > 0)), "UNSTABLE_ROI": ("MEDIUM", F.col("sharpe") < -0.1)}
    return decisions.triggered(j, _G, rules)


@query(f"""WITH {TRADE_SQL}, w AS (SELECT event_id, day, ts, round(0.01 + (event_id % 4) / 100.0, 2) AS want FROM trade), g AS (SELECT *, sum(want) OVER (PARTITION BY day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total,
 coalesce(sum(want) OVER (PARTITION BY day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w) SELECT event_id, round(least(0.3, total) - least(0.3, before), 6) AS granted FROM g""")
def exposure_cap(spark, d):
    rows = trade_rows(spark, d).withColumn("want", F.round(0.01 + (F.col("event_id") % 4) / 100, 2))
    return t.exposure_budget(rows, ["day"], _O, "want", 0.3).select("event_id", F.round("granted", 6).alias("granted"))


@query(f"""WITH {TRADE_SQL}, s AS (SELECT strategy, count(profit) AS n, avg(profit) AS m, stddev_samp(profit) AS s FROM trade GROUP BY 1), z AS (SELECT *, m / nullif(s / sqrt(n), 0) AS t FROM s),
q AS (SELECT *, 1 / (1 + 0.2316419 * abs(t)) AS k FROM z), p AS (SELECT *, 0.3989422804014327 * exp(-t * t / 2) * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))) AS u FROM q),
v AS (SELECT *, CASE WHEN t >= 0 THEN u ELSE 1 - u END AS pv FROM p)
SELECT strategy, n, round(m, 6) AS mean, round(t, 6) AS t, round(pv, 6) AS p_value, round(m - 1.96 * s / sqrt(n), 6) AS low, round(m + 1.96 * s / sqrt(n), 6) AS high,
 CASE WHEN n < 300 THEN 'INSUFFICIENT_SAMPLE' WHEN pv < 0.05 THEN 'SIGNIFICANT' ELSE 'NOT_SIGNIFICANT' END AS verdict FROM v""")
def edge_ttest(spark, d):
    return stats.edge_test(trade_rows(spark, d), ["strategy"], "profit")


@query(f"""WITH {TRADE_SQL}, c AS (SELECT *, odd / round(1.15 + (event_id * 3 % 170) / 100.0, 2) - 1 AS clv FROM trade) SELECT market, count(clv) AS n, count(CASE WHEN day >= DATE '2024-01-10' THEN clv END) AS n_recent, round(avg(clv), 6) AS mean_clv,
 round(avg(CAST(clv > 0 AS DOUBLE)), 6) AS positive_rate, round(avg(CASE WHEN day >= DATE '2024-01-10' THEN clv END), 6) AS recent_clv,
 count(CASE WHEN day >= DATE '2024-01-10' THEN clv END) >= 10 AND coalesce(avg(CASE WHEN day >= DATE '2024-01-10' THEN clv END) < avg(clv) - 0.02, false) AS falling, avg(clv) > 0.01 AND count(clv) >= 50 AS beats_market FROM c GROUP BY 1""")
def clv_metrics(spark, d):
    from tallyfield.operators import markets

    rows = trade_rows(spark, d).withColumn("clv", pricing.clv(F.col("odd"), F.round(1.15 + (F.col("event_id") * 3 % 170) / 100, 2)))
    return markets.clv_summary(rows, ["market"], "clv", "day", F.lit("2024-02-09").cast("date"), 30)


@query(f"""WITH {TRADE_SQL}, c AS (SELECT *, odd / round(1.15 + (event_id * 3 % 170) / 100.0, 2) - 1 AS clv FROM trade) SELECT strategy, round(sum(profit) / nullif(sum(stake), 0), 6) AS roi,
 round(avg(clv), 6) AS skill, round(sum(profit) / nullif(sum(stake), 0) - avg(clv), 6) AS variance FROM c GROUP BY 1""")
def skill_variance(spark, d):
    rows = trade_rows(spark, d).withColumn("clv", pricing.clv(F.col("odd"), F.round(1.15 + (F.col("event_id") * 3 % 170) / 100, 2)))
    roi = ratio_or_zero(F.sum("profit"), F.sum("stake"))
    skill = F.when(F.count("clv") > 0.3 * F.count("*"), F.avg("clv"))
    return rows.groupBy("strategy").agg(F.round(roi, 6).alias("roi"), F.round(skill, 6).alias("skill"), F.round(roi - skill, 6).alias("variance"))


@query(f"WITH {TRADE_SQL} SELECT league, market, hour(ts) AS hour, count(*) AS n, round(avg(profit) * 100, 6) AS mean_ev FROM trade GROUP BY 1, 2, 3")
def hourly_ev(spark, d):
    return trade_rows(spark, d).groupBy("league", "market", F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg("profit") * 100, 6).alias("mean_ev"))


@query(f"""WITH {TRADE_SQL}, n AS (SELECT market, profit, row_number() OVER (PARTITION BY market ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY market) AS c FROM trade)
SELECT market, round(avg(profit), 6) AS mean_ev, round(avg(CAST(profit > 0 AS DOUBLE)), 6) AS positive_rate, round(avg(CASE WHEN rn > c // 2 THEN profit END) - avg(CASE WHEN rn <= c // 2 THEN profit END), 6) AS half_trend FROM n GROUP BY 1""")
def bucket_trend(spark, d):
    w = Window.partitionBy("market")
    rows = trade_rows(spark, d).withColumn("late", F.row_number().over(w.orderBy(*_O)) > F.floor(F.count("*").over(w) / 2))
    half = F.avg(F.when(F.col("late"), F.col("profit"))) - F.avg(F.when(~F.col("late"), F.col("profit")))
    return rows.groupBy("market").agg(F.round(F.avg("profit"), 6).alias("mean_ev"), F.round(F.avg((F.col("profit") > 0).cast("double")), 6).alias("positive_rate"), F.round(half, 6).alias("half_trend"))


@query(f"WITH {TRADE_SQL} SELECT market, " + ", ".join(f"round(quantile_cont(profit, {q}), 6) AS p{int(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9)) + ", round(avg(profit), 6) AS mean, round(stddev_pop(profit), 6) AS std FROM trade GROUP BY 1")
def percentiles(spark, d):
    qs = [0.1, 0.25, 0.5, 0.75, 0.9]
    g = trade_rows(spark, d).groupBy("market").agg(F.percentile("profit", qs).alias("q"), F.round(F.avg("profit"), 6).alias("mean"), F.round(F.stddev_pop("profit"), 6).alias("std"))
    return g.select("market", *[F.round(F.col("q")[i], 6).alias(f"p{int(q * 100)}") for i, q in enumerate(qs)], "mean", "std")


@query()
def monte_carlo(spark, d):
    paths = t.bankroll_paths(spark, 2000, 130, 0.52, 2.0, 0.02, seed=7)
    return paths.agg(F.percentile("final", [0.1, 0.5, 0.9]).alias("q"), F.avg(F.col("ruined").cast("double")).alias("ruin_rate"), F.avg("final").alias("mean")).select(F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"), "ruin_rate", "mean")


@query(f"""WITH {TRADE_SQL}, f AS (SELECT strategy, market, count(*) AS trades, round(sum(profit), 4) AS total_profit FROM (
 SELECT * FROM trade JOIN (SELECT event_id, avg(CAST(floor(value) AS BIGINT) % 5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS g5 FROM events) USING (event_id)) WHERE g5 >= 2 GROUP BY 1, 2)
SELECT strategy, market, trades, total_profit, round(total_profit / trades, 6) AS roi FROM f""")
def flagship(spark, d):
    """Trade results by strategy and market where the past five goals averages reach 2."""
    past = features.past_features(team_rows(spark, d), ["user_id"], _O, {"g5": ("mean", "goals", 5)}).filter("g5 >= 2").select("event_id")
    s = trade_rows(spark, d).join(past, "event_id", "left_semi").groupBy(*_G).agg(F.count("*").alias("trades"), F.round(F.sum("profit"), 4).alias("total_profit"))
    return s.withColumn("roi", F.round(F.col("total_profit") / F.col("trades"), 6))
