"""Queries that profile tables, ledgers and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.operators import features
from tallyfield.operators import profile as p
from tallyfield.plans.bindings import PRICE_SQL, TEAM_SQL, TRADE_SQL, price_rows, table, team_rows, trade_rows

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


_GAPS = "gaps AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS status FROM orders)"


def _gaps(spark, d):
    """Orders with gaps."""
    o, keep = table(spark, d, "orders"), lambda c, n: F.when(F.col("o_orderkey") % n != 0, F.col(c))
    return o.select("o_orderkey", "o_custkey", "o_orderdate", keep("o_orderpriority", 7).alias("priority"), keep("o_totalprice", 5).alias("price"), keep("o_orderstatus", 11).alias("status"))


@query(f"WITH {_GAPS} SELECT coalesce(priority, '__MISSING__') AS value, count(*) AS n FROM gaps GROUP BY 1")
def value_counts(spark, d):
    return p.value_counts(_gaps(spark, d), "priority")


@query(f"WITH {_GAPS} SELECT priority AS value, count(*) AS n FROM gaps WHERE priority IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 3")
def most_common(spark, d):
    return p.most_common(_gaps(spark, d), "priority", 3)


@query(f"""WITH {_GAPS}, c AS (SELECT unnest(['priority', 'price', 'status', 'o_custkey']) AS column_name, unnest([priority IS NULL, price IS NULL, status IS NULL, o_custkey IS NULL]) AS gone FROM gaps)
SELECT column_name, CAST(sum(CAST(gone AS BIGINT)) AS BIGINT) AS missing, avg(CAST(gone AS DOUBLE)) AS ratio FROM c GROUP BY 1""")
def missing_ratio(spark, d):
    return p.missing_ratios(_gaps(spark, d), ["priority", "price", "status", "o_custkey"])


@query(f"WITH {_GAPS} SELECT count(*) AS rows, round(avg((CAST(priority IS NOT NULL AS INT) + CAST(price IS NOT NULL AS INT) + CAST(status IS NOT NULL AS INT)) / 3.0) * 100, 4) AS valid_pct FROM gaps")
def valid_cells(spark, d):
    return p.valid_cells(_gaps(spark, d), ["priority", "price", "status"])


@query(f"""WITH {_GAPS}, k AS (SELECT status, o_custkey, count(*) AS n FROM gaps GROUP BY 1, 2)
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(CASE WHEN n > 1 AND status IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS repeated, round(sum(CASE WHEN n > 1 AND status IS NOT NULL THEN n ELSE 0 END) / sum(n), 6)::DOUBLE AS ratio FROM k""")
def duplicate_ratio(spark, d):
    return p.repeats(_gaps(spark, d), ["status", "o_custkey"], skip_blank=True)


_DIST = " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) * 100, 4) AS missing_pct, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS most FROM team" for c in ("goals", "shots", "corners", "value"))


@query(f"WITH {TEAM_SQL} {_DIST}")
def feature_distribution(spark, d):
    return p.distribution(team_rows(spark, d), ["goals", "shots", "corners", "value"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n FROM events" for c in ("user_id", "event_type", "event_id")))
def distinct_counts(spark, d):
    return p.distinct_counts(table(spark, d, "events"), ["user_id", "event_type", "event_id"])


@query("SELECT count(DISTINCT x) AS n FROM (SELECT l_partkey AS x FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem)")
def distinct_over_columns(spark, d):
    return p.distinct_over(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query("SELECT CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day FROM events")
def date_range(spark, d):
    return p.date_range(table(spark, d, "events"), "ts")


@query("""SELECT l_returnflag, count(DISTINCT l_orderkey) AS matches, CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day,
(SELECT count(DISTINCT x) FROM (SELECT l_partkey AS x FROM lineitem b WHERE b.l_returnflag = a.l_returnflag UNION ALL SELECT l_suppkey FROM lineitem b WHERE b.l_returnflag = a.l_returnflag UNION ALL SELECT l_linenumber FROM lineitem b WHERE b.l_returnflag = a.l_returnflag)) AS teams
FROM lineitem a GROUP BY 1""")
def league_overview(spark, d):
    return p.overview(table(spark, d, "lineitem"), "l_returnflag", "l_orderkey", ["l_partkey", "l_suppkey", "l_linenumber"], "l_shipdate")


@query(f"""WITH {_GAPS} SELECT 'prices' AS name, count(*) FILTER (price IS NOT NULL) AS covered, round(avg(CASE WHEN price IS NOT NULL THEN 1.0 ELSE 0 END) * 100, 4) AS pct FROM gaps
UNION ALL SELECT 'labels', count(*) FILTER (priority IS NOT NULL OR status IS NOT NULL), round(avg(CASE WHEN priority IS NOT NULL OR status IS NOT NULL THEN 1.0 ELSE 0 END) * 100, 4) FROM gaps""")
def coverage_report(spark, d):
    return p.coverage(_gaps(spark, d), {"prices": ["price"], "labels": ["priority", "status"]})


@query("""SELECT event_type, round(avg(value), 6) AS mean_confidence, array_to_string(list_sort(list(DISTINCT 'a' || CAST(user_id % 4 AS VARCHAR))), '|') AS agents, round(count(DISTINCT user_id % 4) / 6.0, 6)::DOUBLE AS agreement FROM events GROUP BY 1""")
def agent_consensus(spark, d):
    e = table(spark, d, "events").withColumn("agent", F.concat(F.lit("a"), (F.col("user_id") % 4).cast("string")))
    return p.consensus(e, "event_type", "agent", "value", 6)


_LEDGER = f"WITH {TRADE_SQL}, x AS (SELECT *, event_id % 6 <> 0 AS settled, CASE WHEN event_id % 6 <> 0 THEN profit END AS pnl FROM trade)"


@query(f"""{_LEDGER}, s AS (SELECT strategy, count(*) AS signals, count(*) FILTER (settled) AS settled, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS gains, coalesce(-sum(pnl) FILTER (pnl < 0), 0) AS losses, coalesce(sum(pnl), 0) AS total,
 coalesce(sum(stake) FILTER (settled), 0) AS staked, count(*) FILTER (settled AND is_win) AS wins, coalesce(sum(stake) FILTER (NOT settled), 0) AS open FROM x GROUP BY 1)
SELECT strategy, signals, settled, signals - settled AS pending, round(coalesce(wins / nullif(settled, 0), 0), 6) AS win_rate, round(coalesce(total / nullif(staked, 0), 0), 6) AS roi, round(CASE WHEN losses = 0 THEN gains ELSE gains / losses END, 6) AS profit_factor,
 round(total, 6) AS total_profit, round(total + 100, 6) AS bankroll, round(open, 6) AS exposure FROM s""")
def ledger_summary(spark, d):
    return p.ledger_summary(trade_rows(spark, d), ["strategy"], F.col("event_id") % 6 != 0, F.col("is_win"), "profit", "stake")


@query(f"WITH {TRADE_SQL} SELECT sum(stake) AS exposure, count(*) AS pending FROM trade WHERE event_id % 6 = 0")
def active_exposure(spark, d):
    return p.ledger_summary(trade_rows(spark, d), [], F.col("event_id") % 6 != 0, F.col("is_win"), "profit", "stake").select("exposure", "pending")


_MATCH = """m AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'goals' WHEN 1 THEN 'corners' WHEN 2 THEN 'shots' ELSE 'btts' END AS market, CASE WHEN event_id % 3 = 0 THEN 'over_1.5_no' WHEN event_id % 3 = 1 THEN 'Over_9.5' ELSE 'yes' END AS strategy,
 CASE WHEN event_id % 13 <> 0 THEN CAST(floor(value) AS BIGINT) % 5 END AS goals_for, CAST(floor(value / 3) AS BIGINT) % 3 AS goals_against, CAST(floor(value) AS BIGINT) % 8 AS corners_for, CASE WHEN event_id % 9 <> 0 THEN CAST(floor(value / 2) AS BIGINT) % 7 END AS corners_against,
 CAST(floor(value) AS BIGINT) % 10 AS shots_for FROM events), q AS (SELECT *, goals_for + goals_against AS total_goals FROM m)"""


def _matches(spark, d):
    e, whole = table(spark, d, "events"), lambda k: F.floor(F.col("value") / k).cast("long")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % n + 1).cast("int"))
    m = e.select(
        "event_id", pick(4, "goals", "corners", "shots", "btts").alias("market"), pick(3, "over_1.5_no", "Over_9.5", "yes").alias("strategy"), F.when(F.col("event_id") % 13 != 0, whole(1) % 5).alias("goals_for"), (whole(3) % 3).alias("goals_against"),
        (whole(1) % 8).alias("corners_for"), F.when(F.col("event_id") % 9 != 0, whole(2) % 7).alias("corners_against"), (whole(1) % 10).alias("shots_for"),
    )
    return m.withColumn("total_goals", F.col("goals_for") + F.col("goals_against"))


@query(f"""WITH {_MATCH} SELECT event_id, CASE market WHEN 'goals' THEN total_goals > CASE WHEN strategy LIKE '%1.5%' THEN 1.5 ELSE 2.5 END WHEN 'corners' THEN corners_for + corners_against > CASE WHEN strategy LIKE '%9.5%' THEN 9.5 ELSE 8.5 END
 WHEN 'shots' THEN shots_for >= 5 ELSE CASE WHEN strategy LIKE '%no%' THEN NOT (goals_for > 0 AND goals_against > 0) ELSE goals_for > 0 AND goals_against > 0 END END AS won
FROM q WHERE CASE market WHEN 'goals' THEN total_goals IS NOT NULL WHEN 'corners' THEN corners_against IS NOT NULL WHEN 'shots' THEN true ELSE goals_for IS NOT NULL END""")
def ledger_outcomes(spark, d):
    return _matches(spark, d).filter(p.outcome_known(F.col("market"))).select("event_id", p.ledger_outcome(F.col("strategy"), F.col("market")).alias("won"))


@query(f"WITH {_MATCH} SELECT market, count(*) AS n FROM q WHERE CASE market WHEN 'goals' THEN total_goals IS NOT NULL WHEN 'btts' THEN goals_for IS NOT NULL OR total_goals IS NOT NULL ELSE true END GROUP BY 1")
def market_pool(spark, d):
    return _matches(spark, d).filter(p.any_feature({"goals": ["total_goals"], "btts": ["goals_for", "total_goals"]}, F.col("market"))).groupBy("market").agg(F.count("*").alias("n"))


@query(f"""WITH {TRADE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY odd DESC, event_id) AS i FROM trade) SELECT day, event_id, odd FROM r WHERE i <= 3""")
def signal_cap(spark, d):
    return p.daily_cap(trade_rows(spark, d), "day", [F.desc("odd"), "event_id"], 3).select("day", "event_id", "odd")


@query(f"""WITH {TRADE_SQL}, n AS (SELECT strategy, count(*) AS n, greatest(1, count(*) // 18) AS step FROM trade GROUP BY 1), r AS (SELECT t.strategy, t.event_id, n, step, row_number() OVER (PARTITION BY t.strategy ORDER BY ts, event_id) - 1 AS i FROM trade t JOIN n USING (strategy)),
k AS (SELECT *, i // step - greatest(0, CAST(ceil(n / step) AS BIGINT) - 18) + 1 AS pos FROM r WHERE i % step = 0)
SELECT strategy, event_id, 'D' || CAST(pos AS VARCHAR) AS label FROM k WHERE pos >= 1""")
def sampled_series(spark, d):
    return p.sampled_series(trade_rows(spark, d), ["strategy"], ["ts", "event_id"]).select("strategy", "event_id", "label")


@query(f"""WITH {TRADE_SQL}, s AS (SELECT league, ts, event_id, CASE WHEN event_id % 8 = 0 THEN 0 WHEN profit > 0 THEN 1 ELSE -1 END AS s FROM trade),
r AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY league ORDER BY ts, event_id) - row_number() OVER (PARTITION BY league, s ORDER BY ts, event_id) AS run FROM s),
g AS (SELECT league, s, run, count(*) AS n, max(i) AS last FROM r GROUP BY 1, 2, 3)
SELECT league, CAST(arg_max(n * s, last) AS BIGINT) AS current, coalesce(max(n) FILTER (s > 0), 0) AS best_win, coalesce(max(n) FILTER (s < 0), 0) AS worst_loss, CAST(sum(n) AS BIGINT) AS sample FROM g GROUP BY 1""")
def latest_streaks(spark, d):
    sign = F.when(F.col("event_id") % 8 == 0, 0).when(F.col("profit") > 0, 1).otherwise(-1)
    return p.sign_streaks(trade_rows(spark, d), ["league"], ["ts", "event_id"], sign)


@query(f"""WITH {TEAM_SQL}, r AS (SELECT event_id, user_id, ts, CASE WHEN shots > 0 THEN goals / shots::DOUBLE END AS rate FROM team)
SELECT event_id, round(avg(rate) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS efficiency_5 FROM r""")
def efficiency_rolling(spark, d):
    rows = team_rows(spark, d).withColumn("rate", F.when(F.col("shots") > 0, F.col("goals") / F.col("shots")))
    return features.past_features(rows, ["user_id"], ["ts", "event_id"], {"e": ("mean", "rate", 5)}).select("event_id", F.round("e", 6).alias("efficiency_5"))


@query("SELECT unnest(['o_totalprice', 'o_custkey']) AS feature")
def feature_columns(spark, d):
    o = table(spark, d, "orders").withColumn("result_total", F.lit(1.0))
    return spark.createDataFrame([(c,) for c in p.feature_columns(o, ["o_orderkey"], ["result_"])], "feature string")


@query(f"WITH {PRICE_SQL}, x AS (SELECT match_id, CASE WHEN price > 3 THEN 'HIGH' WHEN price > 2 THEN 'MEDIUM' ELSE 'LOW' END AS s FROM price) SELECT match_id, CASE max(CASE s WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS highest FROM x GROUP BY 1")
def highest_severity(spark, d):
    rows = price_rows(spark, d).withColumn("s", F.when(F.col("price") > 3, "HIGH").when(F.col("price") > 2, "MEDIUM").otherwise("LOW"))
    return p.highest_severity(rows, ["match_id"], "s")


@query("SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority").distinct()


@query("""WITH s AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS a, list(DISTINCT l_partkey % 20) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_sort(list_intersect(a, b)), '|') AS both, len(list_distinct(list_concat(a, b))) AS either FROM s""")
def set_overlap(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("a"), F.collect_set(F.col("l_partkey") % 20).alias("b"))
    return s.select("l_orderkey", F.array_join(F.sort_array(F.array_intersect("a", "b")), "|").alias("both"), F.size(F.array_union("a", "b")).cast("long").alias("either"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def id_difference(spark, d):
    return table(spark, d, "customer").select("c_custkey").distinct().join(table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""SELECT o_custkey, '[' || string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) || ']' AS orders FROM orders GROUP BY 1""")
def json_cells(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.to_json(F.sort_array(F.collect_list("o_orderkey"))).alias("orders"))


@query(f"""WITH {PRICE_SQL} SELECT count(*) AS snapshots, count(DISTINCT match_id) AS matches, count(DISTINCT bookmaker) AS bookmakers, count(*) FILTER (price > 3) AS high, count(*) FILTER (price <= 1.5) AS low FROM price""")
def movement_counts(spark, d):
    x = price_rows(spark, d).groupBy("match_id", "bookmaker").agg(F.count("*").alias("n"), F.sum((F.col("price") > 3).cast("long")).alias("h"), F.sum((F.col("price") <= 1.5).cast("long")).alias("l"))
    return x.agg(F.sum("n").alias("snapshots"), F.count_distinct("match_id").alias("matches"), F.count_distinct("bookmaker").alias("bookmakers"), F.sum("h").alias("high"), F.sum("l").alias("low"))


@query(f"WITH {TRADE_SQL} SELECT event_id, league FROM trade WHERE league IN ('l1', 'l2', 'l3') AND NOT regexp_matches(strategy || ' ' || market, '(guaranteed|sure|click)')")
def eligible_candidates(spark, d):
    """Rows of allowed bands, without a forbidden term in their texts."""
    rows = trade_rows(spark, d)
    return rows.filter(F.col("league").isin("l1", "l2", "l3") & ~F.concat_ws(" ", "strategy", "market").rlike("guaranteed|sure|click")).select("event_id", "league")
