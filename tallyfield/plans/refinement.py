"""Queries that refine, report risks, raise alerts and sum up models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfield.functions import pricing
from tallyfield.operators import decisions
from tallyfield.operators import refinement as r
from tallyfield.operators import stats
from tallyfield.plans.bindings import PROBABILITY_SQL, TEAM_SQL, TRADE_SQL, probability_rows, table, team_rows, trade_rows

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


_TOTALS = "coalesce(sum(profit) / nullif(sum(stake), 0), 0) AS roi, coalesce(sum(profit) FILTER (profit > 0) / nullif(-sum(profit) FILTER (profit < 0), 0), 0) AS pf"


def _totals(rows, *group):
    gains, losses = F.sum(F.when(F.col("profit") > 0, F.col("profit"))), -F.sum(F.when(F.col("profit") < 0, F.col("profit")))
    return rows.groupBy(*group).agg(F.count("*").alias("trades"), F.coalesce(F.sum("profit") / F.sum("stake"), F.lit(0.0)).alias("roi"), F.coalesce(gains / losses, F.lit(0.0)).alias("pf"), F.avg("profit").alias("mean_profit"))


@query(f"""WITH {TRADE_SQL}, s AS (SELECT league, market, count(*) AS trades, {_TOTALS}, -30.0 - count(*) % 60 AS dd FROM trade GROUP BY 1, 2),
a AS (SELECT *, list_filter([CASE WHEN trades < 30 THEN 'LOW_SAMPLE' END, CASE WHEN roi < 0 THEN 'NEGATIVE_ROI' END, CASE WHEN pf < 1 THEN 'PROFIT_FACTOR_BELOW_1' END, CASE WHEN dd < -60 THEN 'HIGH_DRAWDOWN' END], lambda x: x IS NOT NULL) AS against FROM s),
v AS (SELECT *, CASE WHEN len(against) = 0 AND roi >= 0.03 AND pf >= 1.05 THEN 'KEEP' WHEN trades >= 30 AND roi >= 0 AND pf >= 1 THEN 'WATCH' ELSE 'DISCARD' END AS verdict FROM a)
SELECT league, market, verdict, array_to_string(list_concat(against, CASE verdict WHEN 'KEEP' THEN ['MEETS_CRITERIA'] WHEN 'WATCH' THEN ['POSITIVE_NOT_STRONG'] ELSE [] END), '|') AS reason FROM v""")
def refine_markets(spark, d):
    s = _totals(trade_rows(spark, d), "league", "market").withColumn("dd", -30.0 - F.col("trades") % 60)
    verdict, reason = r.market_verdict(F.col("trades"), F.col("roi"), F.col("pf"), F.col("dd"), least=30)
    return s.select("league", "market", verdict.alias("verdict"), reason.alias("reason"))


_GRADE = "CASE WHEN trades < 20 THEN '{0}' WHEN roi >= 0.03 AND pf >= 1.05 {2}THEN '{1}' ELSE 'OTHER' END"


@query(f"""WITH {TRADE_SQL}, o AS (SELECT market, CASE WHEN odd < 1.5 THEN 'low' WHEN odd < 2.5 THEN 'mid' ELSE 'high' END AS odds_range, count(*) AS trades, {_TOTALS}, avg(profit) AS mp FROM trade GROUP BY 1, 2),
l AS (SELECT market, league, count(*) AS trades, {_TOTALS} FROM trade GROUP BY 1, 2), c AS (SELECT strategy, market, count(*) AS trades, round(50 + 100 * avg(profit), 6) AS score FROM trade GROUP BY 1, 2)
SELECT DISTINCT * FROM (
SELECT 'ANY' AS strategy, market, 'odds_range=' || odds_range AS suggestion, CASE WHEN trades < 100 THEN 'MEDIUM' ELSE 'LOW' END AS risk, trades FROM o WHERE trades >= 20 AND roi >= 0.03 AND pf >= 1.05 AND mp > 0
UNION ALL SELECT 'ANY', market, 'league=' || league, CASE WHEN trades < 100 THEN 'MEDIUM' ELSE 'LOW' END, trades FROM l WHERE trades >= 20 AND roi >= 0.03 AND pf >= 1.05
UNION ALL SELECT * FROM (SELECT strategy, market, 'manual_review_required', CASE WHEN trades < 50 THEN 'HIGH' ELSE 'MEDIUM' END, trades FROM c ORDER BY score DESC, trades DESC, strategy, market LIMIT 5))""")
def threshold_suggestions(spark, d):
    rows = trade_rows(spark, d)
    ranges = F.when(F.col("odd") < 1.5, "low").when(F.col("odd") < 2.5, "mid").otherwise("high")
    odds = _totals(rows.withColumn("odds_range", ranges), "market", "odds_range")
    odds = odds.withColumn("grade", decisions.odds_grade(F.col("trades"), F.col("roi"), F.col("pf"), F.col("mean_profit"), 20, 0.03, 1.05))
    leagues = _totals(rows, "market", "league")
    leagues = leagues.withColumn("grade", decisions.league_grade(F.col("trades"), F.col("roi"), F.col("pf"), 20, 0.03, 1.05))
    scores = rows.groupBy("strategy", "market").agg(F.count("*").alias("trades"), F.round(50 + 100 * F.avg("profit"), 6).alias("score"))
    return r.suggestions(odds, leagues, scores)


@query(f"""WITH {TRADE_SQL}, s AS (SELECT strategy, market, league, count(*) AS trades, sum(profit) AS p FROM trade GROUP BY 1, 2, 3), f AS (SELECT strategy, market, league, unnest([CASE WHEN p < 0 THEN 'UNSTABLE_ROI' END, CASE WHEN trades % 2 = 0 THEN 'LEAGUE_DEPENDENCY' END]) AS flag FROM s),
g AS (SELECT strategy, market, league, list(DISTINCT flag) AS flags FROM f WHERE flag IS NOT NULL GROUP BY 1, 2, 3),
x AS (SELECT s.*, list_sort(list_distinct(list_concat(coalesce(flags, []), CASE WHEN trades % 3 = 0 THEN ['LOW_EV', 'UNSTABLE_ROI'] ELSE [] END))) AS every, CASE WHEN p > 0 THEN 'KEEP' ELSE 'DISCARD' END AS verdict, CASE WHEN trades < 50 THEN 'LOW_SAMPLE' WHEN trades < 100 THEN 'ACCEPTABLE_SAMPLE' ELSE 'STRONG_SAMPLE' END AS sample_status FROM s LEFT JOIN g USING (strategy, market, league))
SELECT strategy, market, league, array_to_string(every, '|') AS risk_flags, sample_status, CASE WHEN list_contains(every, 'LEAGUE_DEPENDENCY') THEN 'HIGH' ELSE 'LOW' END AS dependency_risk, CASE WHEN list_contains(every, 'UNSTABLE_ROI') THEN 'HIGH' ELSE 'LOW' END AS temporal_instability,
CASE WHEN sample_status = 'LOW_SAMPLE' THEN 'DISCARD' ELSE verdict END AS recommendation FROM x""")
def risk_report(spark, d):
    key = ["strategy", "market", "league"]
    s = trade_rows(spark, d).groupBy(*key).agg(F.count("*").alias("trades"), F.sum("profit").alias("p"))
    flags = decisions.triggered(s, key, {"UNSTABLE_ROI": ("HIGH", F.col("p") < 0), "LEAGUE_DEPENDENCY": ("MEDIUM", F.col("trades") % 2 == 0)})
    s = s.withColumn("risk_flags", F.when(F.col("trades") % 3 == 0, "LOW_EV|UNSTABLE_ROI")).withColumn("verdict", F.when(F.col("p") > 0, "KEEP").otherwise("DISCARD"))
    return r.risk_report(s, flags, key)


@query(f"""WITH {TRADE_SQL}, s AS (SELECT strategy, sum(profit) / sum(stake) AS roi, min(profit) * 30 AS dd, avg(CASE WHEN odd < 1.5 THEN 1.0 ELSE 0 END) AS rejected, count(*) FILTER (odd > 2.88) AS high FROM trade GROUP BY 1),
a AS (SELECT strategy, unnest([CASE WHEN roi < -0.10 THEN 'PAPER_ROI_DROP' END, CASE WHEN dd < -20 THEN 'PAPER_DRAWDOWN_SPIKE' END, CASE WHEN rejected > 0.15 THEN 'HIGH_REJECTION_RATE' END, CASE WHEN high = 0 THEN 'NO_HIGH_CONFIDENCE' END]) AS flag FROM s)
SELECT strategy, flag, CASE WHEN flag LIKE 'PAPER%' THEN 'HIGH' WHEN flag = 'HIGH_REJECTION_RATE' THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM a WHERE flag IS NOT NULL""")
def alerts(spark, d):
    s = trade_rows(spark, d).groupBy("strategy").agg((F.sum("profit") / F.sum("stake")).alias("roi"), (F.min("profit") * 30).alias("dd"), F.avg((F.col("odd") < 1.5).cast("double")).alias("rejected"), F.sum((F.col("odd") > 2.88).cast("long")).alias("high"))
    rules = {"PAPER_ROI_DROP": ("HIGH", F.col("roi") < -0.10), "PAPER_DRAWDOWN_SPIKE": ("HIGH", F.col("dd") < -20), "HIGH_REJECTION_RATE": ("MEDIUM", F.col("rejected") > 0.15), "NO_HIGH_CONFIDENCE": ("LOW", F.col("high") == 0)}
    return decisions.triggered(s, ["strategy"], rules)


@query(f"""WITH {TRADE_SQL}, s AS (SELECT league, avg(CASE WHEN event_id % 10 < 8 THEN 1.0 ELSE 0 END) AS risk_rate, avg(odd * 10) AS mean_score FROM trade GROUP BY 1),
a AS (SELECT league, unnest([CASE WHEN risk_rate > 0.70 THEN 'RISK_FLAGS_SPIKE' END, CASE WHEN mean_score < 30 THEN 'LOW_DECISION_SCORE_AVERAGE' END]) AS flag FROM s) SELECT league, flag, CASE WHEN flag = 'RISK_FLAGS_SPIKE' THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM a WHERE flag IS NOT NULL""")
def anomalies(spark, d):
    s = trade_rows(spark, d).groupBy("league").agg(F.avg((F.col("event_id") % 10 < 8).cast("double")).alias("risk_rate"), F.avg(F.col("odd") * 10).alias("mean_score"))
    return decisions.triggered(s, ["league"], {"RISK_FLAGS_SPIKE": ("MEDIUM", F.col("risk_rate") > 0.70), "LOW_DECISION_SCORE_AVERAGE": ("LOW", F.col("mean_score") < 30)})


@query("""WITH s AS (SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'P') AS ok, count(*) AS total FROM orders GROUP BY 1) SELECT o_custkey, total, CASE WHEN ok = total THEN 'SUCCESS' WHEN ok > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM s""")
def status_rollup(spark, d):
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum((F.col("o_orderstatus") != "P").cast("long")).alias("ok"), F.count("*").alias("total"))
    return s.select("o_custkey", "total", r.rolled_up(F.col("ok"), F.col("total")).alias("status"))


_P = "p AS (SELECT event_id, 0.30 + (event_id * 37 % 500) / 1000.0 AS p, round(1.3 + (event_id % 200) / 100.0, 2)::DOUBLE AS odd FROM events)"


def _priced(spark, d):
    return table(spark, d, "events").select("event_id", (0.30 + (F.col("event_id") * 37 % 500) / 1000).alias("p"), F.round(1.3 + (F.col("event_id") % 200) / 100, 2).alias("odd"))


@query(f"""WITH {_P}, k AS (SELECT *, CASE WHEN (p * (odd - 1) - (1 - p)) / (odd - 1) <= 0 THEN 0 ELSE round(greatest(0.005, least(0.05, (p * (odd - 1) - (1 - p)) / (odd - 1) * 0.25)), 4) END AS share FROM p)
SELECT event_id, round(share, 4)::DOUBLE AS stake_pct, round(1000 * share, 2)::DOUBLE AS stake_units, round(1000 * share * ((odd - 1) * p - (1 - p)), 2)::DOUBLE AS expected_profit FROM k""")
def kelly_units(spark, d):
    k = _priced(spark, d).withColumn("stake_pct", pricing.kelly(F.col("p"), F.col("odd")))
    units = F.lit(1000.0) * F.col("stake_pct")
    return k.select("event_id", "stake_pct", F.round(units, 2).alias("stake_units"), F.round(units * ((F.col("odd") - 1) * F.col("p") - (1 - F.col("p"))), 2).alias("expected_profit"))


@query(f"""WITH {_P} SELECT event_id, array_to_string(list_filter([CASE WHEN p >= 0.6 THEN 'probability is high' END, CASE WHEN p * odd > 1 THEN 'expected value is positive' END, CASE WHEN odd < 1.5 THEN 'price is low' END, CASE WHEN p < 0.4 THEN 'probability is low' END], lambda x: x IS NOT NULL), '; ') AS explanation FROM p""")
def explanations(spark, d):
    p, odd = F.col("p"), F.col("odd")
    return _priced(spark, d).select("event_id", F.array_join(r.explanations([(p >= 0.6, "probability is high"), (p * odd > 1, "expected value is positive"), (odd < 1.5, "price is low"), (p < 0.4, "probability is low")]), "; ").alias("explanation"))


@query(f"""WITH {TRADE_SQL}, s AS (SELECT league, market, count(*) AS n, CASE WHEN count(*) % 5 <> 0 THEN avg(profit) END AS skill, sum(profit) < -20 AS worse FROM trade GROUP BY 1, 2)
SELECT league, market, CASE WHEN n < 50 THEN 'COLETAR_MAIS_DADOS' WHEN worse THEN 'REDUZIR_STAKES' WHEN skill IS NULL THEN 'AGUARDAR_CLV' WHEN skill > 0.04 THEN 'CONTINUAR' WHEN skill > 0.01 THEN 'MONITORAR' WHEN skill > -0.01 THEN 'AVALIAR' ELSE 'PAUSAR' END AS advice FROM s""")
def edge_advice(spark, d):
    s = trade_rows(spark, d).groupBy("league", "market").agg(F.count("*").alias("n"), F.avg("profit").alias("m"), F.sum("profit").alias("p"))
    return s.select("league", "market", r.edge_advice(F.col("p") < -20, F.when(F.col("n") % 5 != 0, F.col("m")), F.col("n")).alias("advice"))


@query(f"""WITH {PROBABILITY_SQL} SELECT event_type, count(*) AS n, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END), 6) AS accuracy,
round(coalesce(count(*) FILTER (p >= 0.5 AND y = 1) / nullif(count(*) FILTER (p >= 0.5), 0), 0), 6) AS precision, round(coalesce(count(*) FILTER (p >= 0.5 AND y = 1) / nullif(count(*) FILTER (y = 1), 0), 0), 6) AS recall FROM prob GROUP BY 1""")
def classification_metrics(spark, d):
    return r.classification(probability_rows(spark, d), ["event_type"], "p", "y")


_SETTLED = f"{PROBABILITY_SQL}, x AS (SELECT event_id, event_type, y, unnest(['random_forest', 'lightgbm', 'xgboost']) AS model, unnest([greatest(0, p - 0.018), p, least(1, p + 0.016)]) AS q, CASE WHEN event_id % 3 = 0 THEN 'real' ELSE 'paper' END AS source FROM prob)"


@query(f"WITH {_SETTLED} SELECT model, count(*) AS n, round(avg((q - y) * (q - y)), 6) AS brier, round(avg(q), 6) AS mean_p FROM x WHERE source = 'real' GROUP BY 1 HAVING count(*) >= 30")
def settled_predictions(spark, d):
    """Outcomes beside three models' probabilities; only real ones with 30 rows or more count."""
    p, models = F.col("p"), [("random_forest", -0.018), ("lightgbm", 0.0), ("xgboost", 0.016)]
    rows = probability_rows(spark, d).filter("event_id % 3 = 0").select("y", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.least(F.greatest(p + off, F.lit(0.0)), F.lit(1.0)).alias("q")) for m, off in models])))
    out = rows.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg((F.col("q") - F.col("y")) ** 2), 6).alias("brier"), F.round(F.avg("q"), 6).alias("mean_p"))
    return out.filter("n >= 30")


@query(f"""WITH {TEAM_SQL}, g AS (SELECT event_id, goals, CASE WHEN event_id % 17 <> 0 THEN corners % 4 END AS against, corners, CASE WHEN event_id % 19 <> 0 THEN shots END AS shots FROM team)
SELECT event_id, CAST(goals + against > 2.5 AS INT) AS target_goals, CAST(corners + against > 10.5 AS INT) AS target_corners, CAST(shots >= 10 AS INT) AS target_shots, CAST(goals > 0 AND against > 0 AS INT) AS target_btts FROM (SELECT *, CASE WHEN against IS NULL THEN NULL ELSE goals END AS known FROM g) WHERE known IS NOT NULL
UNION ALL SELECT event_id, NULL, NULL, CAST(shots >= 10 AS INT), NULL FROM g WHERE against IS NULL""")
def outcome_targets(spark, d):
    rows = team_rows(spark, d).withColumn("against", F.when(F.col("event_id") % 17 != 0, F.col("corners") % 4)).withColumn("shots", F.when(F.col("event_id") % 19 != 0, F.col("shots")))
    both = F.when(F.col("against").isNotNull(), ((F.col("goals") > 0) & (F.col("against") > 0)).cast("int"))
    return rows.select("event_id", (F.col("goals") + F.col("against") > 2.5).cast("int").alias("target_goals"), (F.col("corners") + F.col("against") > 10.5).cast("int").alias("target_corners"), (F.col("shots") >= 10).cast("int").alias("target_shots"), both.alias("target_btts"))


@query(f"""WITH {_SETTLED}, m AS (SELECT event_type, model, event_id % 4 AS fold, CASE WHEN event_type <> 'view' THEN avg(q * y) + 0.5 END AS auc, avg((q - y) * (q - y)) AS brier FROM x GROUP BY 1, 2, 3),
b AS (SELECT event_type, model, round(coalesce(avg(auc), 1 - avg(brier)), 6) AS score, count(*) AS folds, row_number() OVER (PARTITION BY event_type ORDER BY round(coalesce(avg(auc), 1 - avg(brier)), 6) DESC, model) AS i FROM m GROUP BY 1, 2) SELECT event_type, model, score, folds FROM b WHERE i = 1""")
def best_models(spark, d):
    p, models = F.col("p"), [("random_forest", -0.018), ("lightgbm", 0.0), ("xgboost", 0.016)]
    rows = probability_rows(spark, d).select("event_type", "event_id", "y", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.least(F.greatest(p + off, F.lit(0.0)), F.lit(1.0)).alias("q")) for m, off in models])))
    folds = rows.groupBy("event_type", "model", (F.col("event_id") % 4).alias("fold")).agg((F.avg(F.col("q") * F.col("y")) + 0.5).alias("_auc"), F.avg((F.col("q") - F.col("y")) ** 2).alias("brier"))
    return r.best_models(folds.withColumn("auc", F.when(F.col("event_type") != "view", F.col("_auc"))), ["event_type"], "model")


_IN = "i AS (SELECT event_id, (event_id % 30) / 10.0 AS eg, (event_id % 7) / 5.0 AS atk, (event_id % 11) / 6.0 AS weak, (event_id % 10) / 10.0 AS form, (event_id % 4) / 4.0 AS q, CASE WHEN event_id % 5 <> 0 THEN (event_id % 13) / 13.0 END AS rate, CASE WHEN event_id % 6 <> 0 THEN 1.2 + (event_id % 25) / 10.0 END AS odd FROM events)"
_BASE = "s AS (SELECT *, 1 / (1 + exp(-greatest(-8, least(8, (eg - 1.0) * 0.55 + (atk - 1.2) * 0.12 + (weak - 1.1) * 0.10 + (form - 0.5) * 0.15 + (q - 0.6) * 0.10 + (coalesce(rate, 0.5) - 0.5) * 0.75 + (0.5 - 1 / coalesce(odd, 2.0)) * 0.12)))) AS z FROM i), m AS (SELECT *, round(least(0.92, greatest(0.08, z - 0.018)), 6) AS a, round(least(0.92, greatest(0.08, z)), 6) AS b, round(least(0.92, greatest(0.08, z + 0.016)), 6) AS c FROM s)"


@query(f"""WITH {_IN}, {_BASE}, e AS (SELECT *, round((a + b + c) / 3, 6) AS ensemble, round(1 - (greatest(a, b, c) - least(a, b, c)), 6) AS agreement FROM m)
SELECT event_id, ensemble, agreement, round(greatest(0, least(1, 1 - (greatest(a, b, c) - least(a, b, c)) * 2.5)), 6) AS stability, round(greatest(0, least(1, (abs(ensemble - 0.5) * 1.8 + agreement * 0.45 + round(q * agreement, 6) * 0.35) / 1.8)), 6) AS confidence,
round(-((a * ln(a) + (1 - a) * ln(1 - a)) + (b * ln(b) + (1 - b) * ln(1 - b)) + (c * ln(c) + (1 - c) * ln(1 - c))) / 3, 6) AS entropy FROM e""")
def probability_proxy(spark, d):
    e = F.col("event_id")
    inputs = {"expected_goals": (e % 30) / 10, "attack": (e % 7) / 5, "weakness": (e % 11) / 6, "form": (e % 10) / 10, "quality": (e % 4) / 4, "rate": F.when(e % 5 != 0, (e % 13) / 13)}
    models = r.proxy_probabilities(inputs, F.when(e % 6 != 0, 1.2 + (e % 25) / 10))
    rows = table(spark, d, "events").select("event_id", ((e % 4) / 4).alias("q"), *[c.alias(m) for m, c in models.items()])
    out = r.ensemble([F.col(m) for m in models], F.col("q"))
    return rows.select("event_id", *[out[c].alias(c) for c in ("ensemble", "agreement", "stability", "confidence", "entropy")])


@query(f"""WITH {_P}, n AS (SELECT event_id, p, odd, p * odd - 1 AS ev FROM p) SELECT event_id, round(p, 4) AS p, round(ev, 4) AS ev FROM n WHERE p >= 0.6 AND (p * (odd - 1) - (1 - p)) / (odd - 1) > 0 ORDER BY p DESC, ev DESC, event_id LIMIT 5""")
def top_signals(spark, d):
    """The five likeliest candidates of high confidence with a positive share, ties by value and id."""
    s = _priced(spark, d).withColumn("ev", F.col("p") * F.col("odd") - 1).filter((F.col("p") >= 0.6) & (pricing.kelly(F.col("p"), F.col("odd")) > 0))
    return s.orderBy(F.desc("p"), F.desc("ev"), "event_id").limit(5).select("event_id", F.round("p", 4).alias("p"), F.round("ev", 4).alias("ev"))


@query(f"""WITH {TRADE_SQL}, c AS (SELECT strategy, market, count(*) AS n FROM trade GROUP BY 1, 2), k AS (SELECT strategy, market, n, row_number() OVER (PARTITION BY strategy ORDER BY n DESC, market) AS i FROM c)
SELECT t.strategy, count(*) AS signals, round(avg(odd), 6) AS mean_odd, round(greatest(0, -sum(profit) / 100), 6) AS drawdown_pct, any_value(k.market) AS top_market FROM trade t JOIN k ON t.strategy = k.strategy AND k.i = 1 GROUP BY 1""")
def brain_snapshot(spark, d):
    """Counts, means, drawdown against an initial 100 and the most frequent market of each strategy."""
    by = trade_rows(spark, d).groupBy("strategy", "market").agg(F.count("*").alias("n"), F.sum("odd").alias("o"), F.sum("profit").alias("p"))
    n = F.sum("n")
    return by.groupBy("strategy").agg(n.alias("signals"), F.round(F.sum("o") / n, 6).alias("mean_odd"), F.round(F.greatest(F.lit(0.0), -F.sum("p") / 100), 6).alias("drawdown_pct"), F.min_by("market", F.struct(-F.col("n"), F.col("market"))).alias("top_market"))


@query("SELECT l_partkey, arg_max(l_orderkey, row(l_shipdate, l_orderkey, l_linenumber)) AS latest FROM lineitem GROUP BY 1")
def latest_records(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max_by("l_orderkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("latest"))


@query("SELECT o_orderkey, o_orderpriority, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS place FROM orders ORDER BY place LIMIT 20")
def objectives(spark, d):
    """The first 20 by priority."""
    order = [F.desc("o_totalprice"), "o_orderkey"]
    top = table(spark, d, "orders").orderBy(*order).limit(20)
    return top.select("o_orderkey", "o_orderpriority", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query(f"""WITH {_P}, n AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN p END AS p, CASE WHEN event_id % 7 <> 0 THEN odd END AS odd FROM p)
SELECT event_id, round(1 / odd, 6) AS implied, round(p - 1 / odd, 6) AS ev, CASE WHEN p IS NOT NULL AND odd IS NOT NULL THEN 'complete' WHEN p IS NULL AND odd IS NULL THEN 'empty' ELSE 'partial' END AS state FROM n""")
def candidate_states(spark, d):
    n = _priced(spark, d).select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("p")).alias("p"), F.when(F.col("event_id") % 7 != 0, F.col("odd")).alias("odd"))
    known = F.col("p").isNotNull().cast("int") + F.col("odd").isNotNull().cast("int")
    return n.select("event_id", F.round(1 / F.col("odd"), 6).alias("implied"), F.round(F.col("p") - 1 / F.col("odd"), 6).alias("ev"), F.when(known == 2, "complete").when(known == 0, "empty").otherwise("partial").alias("state"))


@query(f"""WITH {_SETTLED}, c AS (SELECT event_type, model, event_id % 4 AS fold, q, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM x GROUP BY ALL),
w AS (SELECT *, pos * (coalesce(sum(neg) OVER (PARTITION BY event_type, model, fold ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2.0) AS won FROM c),
a AS (SELECT event_type, model, fold, CASE WHEN event_type <> 'view' THEN round(sum(won) / nullif(sum(pos) * sum(neg), 0), 6) END AS auc FROM w GROUP BY 1, 2, 3), r AS (SELECT event_type, model, event_id % 4 AS fold, avg((q - y) * (q - y)) AS brier FROM x GROUP BY 1, 2, 3),
b AS (SELECT event_type, model, round(coalesce(avg(auc), 1 - avg(brier)), 6) AS score, count(*) AS folds, row_number() OVER (PARTITION BY event_type ORDER BY round(coalesce(avg(auc), 1 - avg(brier)), 6) DESC, model) AS i FROM a JOIN r USING (event_type, model, fold) GROUP BY 1, 2) SELECT event_type, model, score, folds FROM b WHERE i = 1""")
def best_models_auc(spark, d):
    """The best model of each event type by the mean AUC of its folds; where there is none (views), by the Brier score."""
    p, models = F.col("p"), [("random_forest", -0.018), ("lightgbm", 0.0), ("xgboost", 0.016)]
    rows = probability_rows(spark, d).select("event_type", (F.col("event_id") % 4).alias("fold"), "y", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.least(F.greatest(p + off, F.lit(0.0)), F.lit(1.0)).alias("q")) for m, off in models])))
    keys = ["event_type", "model", "fold"]
    area = stats.auc(rows.filter("event_type <> 'view'"), keys, "q", "y")
    folds = rows.groupBy(*keys).agg(F.avg((F.col("q") - F.col("y")) ** 2).alias("brier")).join(area, keys, "left")
    return r.best_models(folds, ["event_type"], "model")
