"""Queries that join with fallbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.operators import lookup
from tallyfield.plans.bindings import TRADE_SQL, table, trade_rows

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


_RISK = "risk AS (SELECT strategy, market, count(*) AS trades, CASE WHEN sum(profit) < 0 THEN 'NEGATIVE' ELSE 'POSITIVE' END AS league FROM trade WHERE market <> 'view' GROUP BY 1, 2)"


@query(f"WITH {TRADE_SQL}, {_RISK} SELECT event_id, t.league, trades, r.league AS league_risk FROM trade t LEFT JOIN risk r USING (strategy, market)")
def risk_report_join(spark, d):
    rows = trade_rows(spark, d)
    risk = rows.filter("market <> 'view'").groupBy("strategy", "market").agg(F.count("*").alias("trades"), F.when(F.sum("profit") < 0, "NEGATIVE").otherwise("POSITIVE").alias("league"))
    return lookup.left_with_suffix(rows.select("event_id", "strategy", "market", "league"), risk, ["strategy", "market"], "_risk").select("event_id", "league", "trades", "league_risk")


@query(f"""WITH {TRADE_SQL}, q AS (SELECT strategy, market, count(*) AS trades FROM trade GROUP BY 1, 2), r AS (SELECT strategy, market, round(min(profit), 6) AS worst FROM trade WHERE strategy <> 's1' GROUP BY 1, 2),
b AS (SELECT market, league, count(*) AS n, sum(profit) AS p FROM trade GROUP BY 1, 2), lm AS (SELECT market, max(n) AS top_league, count(*) FILTER (p > 0) AS winning_leagues FROM b GROUP BY 1)
SELECT q.*, worst, top_league, winning_leagues, round(top_league / (SELECT sum(n) FROM b WHERE b.market = q.market), 6)::DOUBLE AS top_share FROM q LEFT JOIN r USING (strategy, market) LEFT JOIN lm USING (market)""")
def bucket_enrichment(spark, d):
    """Strategies with their own rolling figures, and those of league buckets by market alone."""
    rows = trade_rows(spark, d)
    own = rows.groupBy("strategy", "market").agg(F.count("*").alias("trades"))
    rolling = rows.filter("strategy <> 's1'").groupBy("strategy", "market").agg(F.round(F.min("profit"), 6).alias("worst"))
    buckets = rows.groupBy("market", "league").agg(F.count("*").alias("n"), F.sum("profit").alias("p"))
    by_market = buckets.groupBy("market").agg(F.max("n").alias("top_league"), F.sum((F.col("p") > 0).cast("long")).alias("winning_leagues"), F.sum("n").alias("_all"))
    out = own.join(rolling, ["strategy", "market"], "left").join(by_market, "market", "left")
    return out.select("strategy", "market", "trades", "worst", "top_league", "winning_leagues", F.round(F.col("top_league") / F.col("_all"), 6).alias("top_share"))


_CONS = """cons AS (SELECT * FROM (VALUES ('s0', 'view', 61.5, 120), ('s1', 'purchase', 40.0, 80), ('click', 'signup', 55.0, 300), ('zz', 's2', 20.0, 10)) v(strategy, market, consistency_score, total_trades))"""


@query(f"""WITH {TRADE_SQL}, {_CONS}, b AS (SELECT event_id, arg_min(c.consistency_score, c.strategy) AS score FROM trade t JOIN cons c ON c.market IN (t.strategy, t.market) GROUP BY 1)
SELECT event_id, coalesce(x.score, b.score)::DOUBLE AS consistency_score FROM trade LEFT JOIN (SELECT event_id, arg_min(c.consistency_score, c.strategy) AS score FROM trade t JOIN cons c ON c.strategy IN (t.strategy, t.market) GROUP BY 1) x USING (event_id) LEFT JOIN b USING (event_id)""")
def consistency_lookup(spark, d):
    """A consistency row whose strategy, else whose market, is the trade's strategy or market: the first by name."""
    cons = spark.createDataFrame([("s0", "view", 61.5, 120), ("s1", "purchase", 40.0, 80), ("click", "signup", 55.0, 300), ("zz", "s2", 20.0, 10)], "strategy string, market string, consistency_score double, total_trades int")
    rows = trade_rows(spark, d).select("event_id", "strategy", "market")
    parts = cons.select(F.explode(F.array(*[F.struct(F.lit(i).alias("_by"), F.col(c).alias("_name")) for i, c in enumerate(("strategy", "market"))])).alias("x"), "strategy", "consistency_score").select("x.*", F.col("strategy").alias("_first"), "consistency_score")
    firsts = parts.groupBy("_name").agg(F.min(F.struct("_by", "_first", "consistency_score")).alias("hit"))
    names = rows.select("event_id", F.explode(F.array_distinct(F.array("strategy", "market"))).alias("_name"))
    best = names.join(firsts, "_name").groupBy("event_id").agg(F.min("hit").alias("hit"))
    return rows.join(best, "event_id", "left").select("event_id", F.col("hit.consistency_score").alias("consistency_score"))


@query("""WITH bets AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS match_id FROM orders WHERE o_orderstatus = 'O'),
loc AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey % 2 = 0), api AS (SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_nationkey % 3 <> 1)
SELECT o_orderkey, round(coalesce(l.c_acctbal, a.c_acctbal), 2) AS result, CASE WHEN l.c_custkey IS NOT NULL THEN 'local' WHEN a.c_custkey IS NOT NULL THEN 'api' ELSE 'pending' END AS found
FROM bets LEFT JOIN loc l ON match_id = CAST(l.c_custkey AS VARCHAR) LEFT JOIN api a ON match_id = CAST(a.c_custkey AS VARCHAR)""")
def result_lookup(spark, d):
    """Open bets with the result of their match: the local one, else the other source's; ids compare as text."""
    bets = table(spark, d, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey").cast("string")).alias("match_id"))
    c = table(spark, d, "customer")
    local = c.filter("c_nationkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("match_id"), F.col("c_acctbal").alias("_local"))
    other = c.filter("c_nationkey % 3 <> 1").select(F.col("c_custkey").cast("string").alias("match_id"), (F.col("c_acctbal") + 1).alias("_api"))
    out = bets.join(local, "match_id", "left").join(other, "match_id", "left")
    return out.select("o_orderkey", F.round(F.coalesce("_local", "_api"), 2).alias("result"), F.when(F.col("_local").isNotNull(), "local").when(F.col("_api").isNotNull(), "api").otherwise("pending").alias("found"))


_PRED = "pred AS (SELECT event_id AS pid, CASE WHEN event_id % 3 = 0 THEN 'k' || CAST(user_id % 50 AS VARCHAR) END AS identity, CAST(user_id % 90 AS VARCHAR) AS match_id, event_type AS market FROM events), ask AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'k' || CAST(o_custkey % 60 AS VARCHAR) ELSE CAST(o_custkey % 120 AS VARCHAR) END AS key, CASE o_orderkey % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'nothing' END AS market FROM orders)"


@query(f"""WITH {_PRED}, e AS (SELECT identity, market, min(pid) AS pid FROM pred WHERE identity IS NOT NULL GROUP BY 1, 2), f AS (SELECT identity, min(pid) AS pid FROM pred WHERE identity IS NOT NULL GROUP BY 1),
g AS (SELECT match_id, market, min(pid) AS pid FROM pred GROUP BY 1, 2), h AS (SELECT match_id, min(pid) AS pid FROM pred GROUP BY 1)
SELECT o_orderkey, coalesce(e.pid, f.pid, g.pid, h.pid) AS pid FROM ask a LEFT JOIN e ON a.key = e.identity AND a.market = e.market LEFT JOIN f ON a.key = f.identity LEFT JOIN g ON a.key = g.match_id AND a.market = g.market LEFT JOIN h ON a.key = h.match_id""")
def prediction_lookup(spark, d):
    """The prediction of a key, as identity or else as match id, of the same market if there is one; the first by id."""
    key = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("k"), (F.col("o_custkey") % 60).cast("string"))).otherwise((F.col("o_custkey") % 120).cast("string"))
    ask = table(spark, d, "orders").select("o_orderkey", key.alias("key"), F.element_at(F.array(F.lit("click"), F.lit("view"), F.lit("nothing")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("market"))
    pred = table(spark, d, "events").select(F.col("event_id").alias("pid"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("k"), (F.col("user_id") % 50).cast("string"))).alias("identity"), (F.col("user_id") % 90).cast("string").alias("match_id"), F.col("event_type").alias("market"))
    return lookup.prefer_same(ask, pred, [("key", "identity"), ("key", "match_id")], "market", [F.col("pid")], ["pid"]).select("o_orderkey", "pid")


@query("""WITH v AS (SELECT n_nationkey, n_name, unnest([lower(n_name), 'n' || CAST(n_nationkey AS VARCHAR), 'league ' || CAST(n_nationkey // 2 AS VARCHAR)]) AS variant FROM nation WHERE n_nationkey < 20), u AS (SELECT variant, min(n_nationkey) AS canonical FROM v GROUP BY 1),
x AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ' N' || CAST(c_nationkey AS VARCHAR) WHEN 1 THEN 'League ' || CAST(c_nationkey AS VARCHAR) || ' ' ELSE 'unknown' END AS name FROM customer)
SELECT c_custkey, canonical FROM x LEFT JOIN u ON lower(trim(name)) = variant""")
def league_mapping(spark, d):
    n = table(spark, d, "nation").filter("n_nationkey < 20")
    variants = n.select(F.col("n_nationkey").alias("canonical"), F.array(F.lower("n_name"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("league "), F.floor(F.col("n_nationkey") / 2).cast("string"))).alias("names"))
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" N"), F.col("c_nationkey").cast("string"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("League "), F.col("c_nationkey").cast("string"), F.lit(" "))).otherwise("unknown")
    return lookup.map_variants(table(spark, d, "customer").select("c_custkey", name.alias("name")), "name", variants, "names", "canonical").select("c_custkey", "canonical")


@query(f"""WITH {TRADE_SQL}, base AS (SELECT market, strategy, round(sum(profit) / sum(stake), 6) AS roi, row_number() OVER (PARTITION BY market ORDER BY strategy) AS i FROM trade WHERE market <> 'signup' GROUP BY 1, 2),
best AS (SELECT market, round(avg(CAST(is_win AS INT)), 6) AS accuracy FROM trade GROUP BY 1) SELECT market, accuracy, strategy AS baseline, roi AS baseline_roi FROM best LEFT JOIN base ON best.market = base.market AND i = 1""".replace("SELECT market, accuracy", "SELECT best.market, accuracy"))
def baseline_compare(spark, d):
    """Each market's model beside the first strategy of the rules."""
    rows = trade_rows(spark, d)
    base = rows.filter("market <> 'signup'").groupBy("market", "strategy").agg(F.round(F.sum("profit") / F.sum("stake"), 6).alias("baseline_roi"))
    first = lookup.first_per(base, ["market"], [F.col("strategy")]).withColumnRenamed("strategy", "baseline")
    return rows.groupBy("market").agg(F.round(F.avg(F.col("is_win").cast("int")), 6).alias("accuracy")).join(first, "market", "left").select("market", "accuracy", "baseline", "baseline_roi")


@query("SELECT value, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CAST(l_suppkey AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT CAST(l_partkey AS VARCHAR), count(*) FROM lineitem GROUP BY 1) GROUP BY 1")
def outer_counts(spark, d):
    return lookup.outer_counts(table(spark, d, "lineitem"), ["l_suppkey", "l_partkey"])


@query(f"""WITH {TRADE_SQL}, s AS (SELECT strategy, market, count(*) AS trades, round(sum(profit) / sum(stake), 6) AS roi FROM trade GROUP BY 1, 2) SELECT market, arg_max(strategy, row(roi, -ascii(substr(strategy, 2)))) AS strategy, round(max(roi), 6) AS best_roi, CAST(sum(trades) AS BIGINT) AS total, round(avg(roi), 6) AS mean_roi FROM s GROUP BY 1""")
def backtest_best(spark, d):
    """Each market's best strategy, with total and mean."""
    s = trade_rows(spark, d).groupBy("strategy", "market").agg(F.count("*").alias("trades"), F.round(F.sum("profit") / F.sum("stake"), 6).alias("roi"))
    order = F.struct("roi", (-F.ascii(F.substring("strategy", 2, 1))).alias("x"))
    return s.groupBy("market").agg(F.max_by("strategy", order).alias("strategy"), F.round(F.max("roi"), 6).alias("best_roi"), F.sum("trades").alias("total"), F.round(F.avg("roi"), 6).alias("mean_roi"))
