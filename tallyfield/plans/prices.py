"""Queries over prices: margins, value, stakes, best prices, movement, candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions import pricing
from tallyfield.operators import decisions as dec
from tallyfield.operators import markets
from tallyfield.plans.bindings import PRICE_SQL, price_rows, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _candidates(spark, d):
    """Events as candidates with a probability, a price and its opposite."""
    e = table(spark, d, "events")
    i = F.col("event_id")
    return e.select(
        "event_id", "ts", F.to_date("ts").alias("day"), "event_type", (0.3 + (i * 37 % 500) / 1000).alias("p"), F.round(1.3 + (i % 240) / 100, 2).alias("odd"), F.when(i % 4 != 0, F.round(1.5 + (i * 3 % 200) / 100, 2)).alias("opposite"),
        (i * 11 % 100).cast("double").alias("consistency"), (i * 17 % 700).cast("double").alias("sample"), F.element_at(F.array(*map(F.lit, ["KEEP", "WATCH", "DISCARD"])), (i % 3 + 1).cast("int")).alias("rule"),
        F.element_at(F.array(*map(F.lit, ["LOW_SAMPLE_SIZE", "HIGH_DRAWDOWN|UNSTABLE_ROI", "", "OTHER"])), (i % 4 + 1).cast("int")).alias("flags"), F.element_at(F.array(*map(F.lit, ["SHARP_MOVEMENT", "LATE_SHARP", "PUBLIC_MONEY", "NEUTRAL", "SIGNIFICANT_MOVEMENT"])), (i % 5 + 1).cast("int")).alias("moved"),
    )


_CAND = """cand AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, event_type, (0.3 + (event_id * 37 % 500) / 1000.0)::DOUBLE AS p, round(1.3 + (event_id % 240) / 100.0, 2)::DOUBLE AS odd,
 CASE WHEN event_id % 4 <> 0 THEN round(1.5 + (event_id * 3 % 200) / 100.0, 2)::DOUBLE END AS opposite, (event_id * 11 % 100)::DOUBLE AS consistency, (event_id * 17 % 700)::DOUBLE AS sample,
 CASE event_id % 3 WHEN 0 THEN 'KEEP' WHEN 1 THEN 'WATCH' ELSE 'DISCARD' END AS rule, CASE event_id % 4 WHEN 0 THEN 'LOW_SAMPLE_SIZE' WHEN 1 THEN 'HIGH_DRAWDOWN|UNSTABLE_ROI' WHEN 2 THEN '' ELSE 'OTHER' END AS flags,
 CASE event_id % 5 WHEN 0 THEN 'SHARP_MOVEMENT' WHEN 1 THEN 'LATE_SHARP' WHEN 2 THEN 'PUBLIC_MONEY' WHEN 3 THEN 'NEUTRAL' ELSE 'SIGNIFICANT_MOVEMENT' END AS moved FROM events),
ev AS (SELECT *, CASE WHEN opposite > 1 THEN (1 / odd) / (1 / odd + 1 / opposite) ELSE 1 / odd * 0.95 END AS fair FROM cand)"""


@query(f"""WITH {_CAND}, m AS (SELECT *, (1 / odd + 1 / opposite - 1) / 2 AS g, coalesce(odd > 1 AND opposite > 1, false) AS ok FROM cand), c AS (SELECT *, greatest(1 / odd - g, 0.001) AS a1, greatest(1 / opposite - g, 0.001) AS a2 FROM m)
SELECT event_id, round(CASE WHEN ok THEN 1 / odd / (1 / odd + 1 / opposite) ELSE 0.5 END, 6) AS p_multiplicative, round(CASE WHEN ok THEN a1 / (a1 + a2) ELSE 0.5 END, 6) AS p_additive FROM c""")
def remove_vig(spark, d):
    c = _candidates(spark, d)
    both = [F.col("odd"), F.col("opposite")]
    return c.select("event_id", F.round(pricing.fair_multiplicative(both)[0], 6).alias("p_multiplicative"), F.round(pricing.fair_additive(both)[0], 6).alias("p_additive"))


_GRADE = "CASE WHEN p - fair > 0.08 AND (p - fair) * (odd - 1) > 0.05 THEN 'PREMIUM_VALUE' WHEN p - fair > 0.05 AND (p - fair) * (odd - 1) > 0.03 THEN 'HIGH_VALUE' WHEN p - fair > 0.02 AND (p - fair) * (odd - 1) > 0.01 THEN 'VALUE' WHEN p - fair > 0 THEN 'MARGINAL' ELSE 'NO_VALUE' END"


@query(f"WITH {_CAND} SELECT event_id, round(fair, 6) AS fair, round(p - fair, 6) AS edge, round((p - fair) * (odd - 1), 6) AS true_ev, round(p * odd - 1, 6) AS naive_ev, round(CASE WHEN opposite > 1 THEN 1 / odd + 1 / opposite - 1 END, 6) AS vig, p - fair > 0.02 AS is_value, {_GRADE} AS grade FROM ev")
def true_ev(spark, d):
    c = _candidates(spark, d)
    v = pricing.expected_values(F.col("p"), F.col("odd"), F.col("opposite"))
    return c.select("event_id", *[F.round(v[k], 6).alias(k) for k in ("fair", "edge", "true_ev", "naive_ev", "vig")], v["is_value"].alias("is_value"), pricing.ev_grade(v["true_ev"], v["edge"]).alias("grade"))


_KELLY = "CASE WHEN ((odd - 1) * p - (1 - p)) / (odd - 1) > 0 THEN round(least(greatest(((odd - 1) * p - (1 - p)) / (odd - 1) * 0.25, 0.005), 0.05), 4) ELSE 0.0 END"


@query(f"""WITH {_CAND}, m AS (SELECT event_id, {_KELLY} AS kelly, CASE WHEN (event_id % 30) / 100.0 >= 0.25 THEN 0.0 WHEN (event_id % 30) / 100.0 > 0.19 THEN 0.25 WHEN (event_id % 30) / 100.0 > 0.09 THEN 0.5 ELSE 1.0 END
 * CASE WHEN p < 0.55 THEN 0.75 ELSE 1.0 END AS multiplier FROM cand) SELECT event_id, CAST(kelly AS DOUBLE) AS kelly, CAST(multiplier AS DOUBLE) AS multiplier FROM m""")
def kelly_pct(spark, d):
    c = _candidates(spark, d).withColumn("drawdown", (F.col("event_id") % 30) / 100)
    return c.select("event_id", pricing.kelly(F.col("p"), F.col("odd")).alias("kelly"), pricing.kelly_multiplier(F.col("drawdown"), F.lit(None).cast("double"), F.col("p")).alias("multiplier"))


@query(f"""WITH {_CAND}, c AS (SELECT event_id, odd / opposite - 1 AS clv FROM cand) SELECT event_id, round(clv, 6) AS clv, CASE WHEN clv IS NULL THEN NULL WHEN clv >= 0.08 THEN 'EXCELLENT' WHEN clv >= 0.04 THEN 'GOOD' WHEN clv >= 0.01 THEN 'MARGINAL'
 WHEN clv >= -0.01 THEN 'NEUTRAL' WHEN clv >= -0.05 THEN 'BAD' ELSE 'TERRIBLE' END AS category FROM c""")
def clv(spark, d):
    value = pricing.clv(F.col("odd"), F.col("opposite"))
    return _candidates(spark, d).select("event_id", F.round(value, 6).alias("clv"), pricing.clv_category(value).alias("category"))


@query(f"""WITH {PRICE_SQL}, c AS (SELECT match_id, selection, avg(price) AS closing FROM price WHERE bookmaker = 0 GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, match_id, selection, bookmaker, CAST(snapshot AS VARCHAR) AS snapshot, price, round(closing, 6) AS closing_price FROM price LEFT JOIN c USING (match_id, selection)""")
def closing_join(spark, d):
    p = price_rows(spark, d)
    return markets.closing_prices(p, p.filter("bookmaker = 0"), ["match_id", "selection"], "price").withColumn("closing_price", F.round("closing_price", 6)).withColumn("snapshot", F.col("snapshot").cast("string"))


@query(f"""WITH {PRICE_SQL}, b AS (SELECT match_id, selection, bookmaker, max(price) AS p FROM price GROUP BY 1, 2, 3)
SELECT match_id, selection, max(p) AS best_price, arg_max(bookmaker, row(p, -bookmaker)) AS best_bookmaker, count(*) AS bookmakers, max(CASE WHEN bookmaker = 0 THEN p END) AS reference_price,
 round(max(p) / nullif(max(CASE WHEN bookmaker = 0 THEN p END), 0), 6) AS ratio FROM b GROUP BY 1, 2""")
def best_price(spark, d):
    return markets.best_prices(price_rows(spark, d), ["match_id", "selection"], "bookmaker", "price", 0).withColumn("ratio", F.round("ratio", 6))


_MOVE = f"""{PRICE_SQL}, s AS (SELECT match_id, selection, snapshot, avg(price) AS p FROM price GROUP BY 1, 2, 3), oc AS (SELECT match_id, selection, arg_min(p, snapshot) AS opening, arg_max(p, snapshot) AS current FROM s GROUP BY 1, 2),
mv AS (SELECT *, CASE WHEN opening > 0 THEN (opening - current) / opening ELSE 0 END AS change, match_id % 60 AS hours FROM oc)"""


@query(f"""WITH {_MOVE} SELECT match_id, selection, round(opening, 3) AS opening, round(current, 3) AS current, round(change * 100, 2) AS movement_pct, CASE WHEN abs(change) > 0.08 AND hours > 24 THEN 'SHARP_MOVEMENT' WHEN abs(change) > 0.08 AND hours <= 24 THEN 'LATE_SHARP'
 WHEN abs(change) < 0.03 AND hours < 2 THEN 'PUBLIC_MONEY' WHEN abs(change) >= 0.04 THEN 'SIGNIFICANT_MOVEMENT' ELSE 'NEUTRAL' END AS movement_type FROM mv""")
def price_movement(spark, d):
    m = markets.opening_and_current(price_rows(spark, d), ["match_id", "selection"], "snapshot", "price")
    change = markets.movement(F.col("opening"), F.col("current"))
    return m.select("match_id", "selection", F.round("opening", 3).alias("opening"), F.round("current", 3).alias("current"), F.round(change * 100, 2).alias("movement_pct"), markets.movement_class(change, F.col("match_id") % 60).alias("movement_type"))


@query(f"""WITH {PRICE_SQL}, s AS (SELECT match_id, selection, bookmaker, snapshot, avg(price) AS p FROM price GROUP BY 1, 2, 3, 4), o AS (SELECT match_id, selection, bookmaker, arg_min(p, snapshot) AS a, arg_max(p, snapshot) AS b FROM s GROUP BY 1, 2, 3),
c AS (SELECT *, (a - b) / a AS ch FROM o WHERE a > 0 AND b > 0), g AS (SELECT match_id, selection, count(*) AS bookmakers, CAST(sum(CAST(ch > 0.02 AS BIGINT)) AS BIGINT) AS down, CAST(sum(CAST(ch < -0.02 AS BIGINT)) AS BIGINT) AS up, round(avg(ch) * 100, 4) + 0.0 AS mean_movement_pct FROM c GROUP BY 1, 2),
f AS (SELECT *, bookmakers >= 3 AND greatest(down, up) >= 3 AND greatest(down, up) / bookmakers >= 0.7 AS steam FROM g) SELECT *, CASE WHEN steam THEN CASE WHEN down > up THEN 'DOWN' ELSE 'UP' END END AS direction FROM f""")
def steam_moves(spark, d):
    return markets.steam(price_rows(spark, d), ["match_id", "selection"], "bookmaker", "snapshot", "price")


@query(f"WITH {PRICE_SQL}, t AS (SELECT DISTINCT snapshot FROM price ORDER BY 1 DESC LIMIT 12) SELECT l_orderkey, l_linenumber, match_id, bookmaker, selection, CAST(snapshot AS VARCHAR) AS snapshot, price FROM price WHERE snapshot IN (SELECT snapshot FROM t)")
def latest_snapshots(spark, d):
    return markets.latest_snapshots(price_rows(spark, d), "snapshot", 12).withColumn("snapshot", F.col("snapshot").cast("string"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN coalesce(CASE WHEN l_linenumber % 3 <> 0 THEN l_discount * 30 END, CASE WHEN l_linenumber % 2 = 0 THEN l_tax * 40 END) >= 1.2
 THEN round(coalesce(CASE WHEN l_linenumber % 3 <> 0 THEN l_discount * 30 END, CASE WHEN l_linenumber % 2 = 0 THEN l_tax * 40 END), 6) END AS odd FROM lineitem""")
def first_valid_odd(spark, d):
    from tallyfield.operators.trades import first_price

    i = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(i % 3 != 0, F.col("l_discount") * 30).alias("a"), F.when(i % 2 == 0, F.col("l_tax") * 40).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", F.round(first_price(["a", "b"], 1.2), 6).alias("odd"))


_SCORE = f"""{_CAND}, sc AS (SELECT event_id, p, odd, sample, flags, CASE rule WHEN 'KEEP' THEN 25.0 WHEN 'WATCH' THEN 10.0 ELSE 0.0 END + least(p * 20, 20)
 + CASE WHEN v >= 0.08 THEN 20.0 WHEN v >= 0.05 THEN 16.0 WHEN v >= 0.03 THEN 12.0 WHEN v >= 0.01 THEN 7.0 WHEN v > 0 THEN 3.0 ELSE 0.0 END + least(consistency * 0.15, 15)
 + CASE WHEN sample >= 500 THEN 10.0 WHEN sample >= 300 THEN 8.0 WHEN sample >= 100 THEN 4.0 WHEN sample > 0 THEN 1.0 ELSE 0.0 END
 + CASE moved WHEN 'SHARP_MOVEMENT' THEN 7.0 WHEN 'LATE_SHARP' THEN 5.0 WHEN 'SIGNIFICANT_MOVEMENT' THEN 3.0 WHEN 'PUBLIC_MONEY' THEN -3.0 ELSE 0.0 END + 4.0 + 4.0 - CASE WHEN odd < 1.40 THEN 5.0 ELSE 0.0 END + 3.0
 - CASE event_id % 4 WHEN 0 THEN 25 WHEN 1 THEN 33 WHEN 2 THEN 0 ELSE 5 END AS raw FROM (SELECT *, (p - fair) * (odd - 1) AS v FROM ev)),
ds AS (SELECT *, round(CASE event_id % 4 WHEN 0 THEN least(greatest(least(raw, 100), 0), 59) WHEN 1 THEN least(greatest(least(raw, 100), 0), 49) ELSE greatest(least(raw, 100), 0) END, 2)::DOUBLE AS score FROM sc)"""
_BAND = "CASE WHEN score >= 80 THEN 'HIGH_CONFIDENCE_SIMULATION' WHEN score >= 60 THEN 'MEDIUM_CONFIDENCE_SIMULATION' WHEN score >= 40 THEN 'WATCH_ONLY' ELSE 'REJECTED' END"


def _scored(spark, d):
    from tallyfield.functions.text import parse_flags

    c = _candidates(spark, d)
    ev = pricing.expected_values(F.col("p"), F.col("odd"), F.col("opposite"))["true_ev"]
    none = F.lit(None).cast("double")
    score = dec.decision_score(F.col("rule"), F.col("p"), none, ev, F.col("consistency"), F.col("sample"), F.col("moved"), F.lit(False), F.lit("NEUTRAL"), F.lit("STRONG"), F.col("odd"), F.lit("OK"), parse_flags("flags"))
    return c.withColumn("true_ev", ev).withColumn("score", score)


@query(f"WITH {_SCORE} SELECT event_id, score, {_BAND} AS band FROM ds")
def decision_score(spark, d):
    return _scored(spark, d).select("event_id", "score", dec.band(F.col("score")).alias("band"))


@query(f"WITH {_SCORE}, b AS (SELECT *, {_BAND} AS band FROM ds) SELECT event_id, band, CASE WHEN band = 'REJECTED' THEN 0.0 ELSE {_KELLY} END::DOUBLE AS stake, CASE WHEN band = 'REJECTED' THEN 'NO SIGNAL' ELSE 'SIGNAL' END AS signal_label, band <> 'REJECTED' AND {_KELLY} > 0 AS action_required FROM b")
def safety_gate(spark, d):
    s = _scored(spark, d).withColumn("band", dec.band(F.col("score"))).withColumn("decision_status", F.lit("OK")).withColumn("signal_label", F.lit("SIGNAL"))
    s = s.withColumn("stake", pricing.kelly(F.col("p"), F.col("odd"))).withColumn("action_required", F.col("stake") > 0)
    return dec.enforce_safety(s, "decision_status", "band", ["stake"]).select("event_id", "band", "stake", "signal_label", "action_required")


@query(f"WITH {_SCORE} SELECT {_BAND} AS band, count(*) AS n, round(avg(score), 4) AS mean_score, round(avg(p), 6) AS mean_p FROM ds GROUP BY 1")
def decision_summary(spark, d):
    return _scored(spark, d).groupBy(dec.band(F.col("score")).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.avg("p"), 6).alias("mean_p"))


@query(f"""WITH {_CAND}, k AS (SELECT event_id, p, sample, least(0.02, CASE WHEN odd > 1 THEN greatest(0, (p * (odd - 1) - (1 - p)) / (odd - 1)) ELSE 0 END * 0.25) AS s FROM cand)
SELECT event_id, round(s * CASE WHEN p < 0.58 THEN 0.5 ELSE 1 END * CASE WHEN sample < 60 THEN 0.5 ELSE 1 END, 6)::DOUBLE AS share FROM k""")
def profile_sizing(spark, d):
    share = dec.profile_share(F.col("p"), F.col("odd"), F.col("p"), F.col("sample"), F.lit(0), {})
    return _candidates(spark, d).select("event_id", share.alias("share"))


@query(f"""WITH {_CAND} SELECT event_id, array_to_string(list_filter([CASE WHEN NOT (p >= 0.54) THEN 'PROBABILITY' END, CASE WHEN NOT (p * odd - 1 > -0.05) THEN 'VALUE' END, CASE WHEN NOT (sample >= 60) THEN 'SAMPLE' END], lambda x: x IS NOT NULL), '|') AS reasons FROM cand""")
def eligibility(spark, d):
    reasons = dec.reject_reasons({"PROBABILITY": F.col("p") >= 0.54, "VALUE": F.col("p") * F.col("odd") - 1 > -0.05, "SAMPLE": F.col("sample") >= 60})
    return _candidates(spark, d).select("event_id", F.array_join(reasons, "|").alias("reasons"))


@query(f"""WITH {_CAND}, k AS (SELECT day, event_id, event_type, {_KELLY} AS share FROM cand WHERE event_id % 40 = 0 OR event_id < 400), m AS (SELECT day, event_type, sum(share) AS s FROM k GROUP BY 1, 2),
x AS (SELECT a.day, a.event_type, count(CASE WHEN (a.event_type IN ('click', 'view') AND b.event_type IN ('click', 'view')) AND (a.s < b.s OR (a.s = b.s AND a.event_type > b.event_type)) THEN 1 END) AS cuts FROM m a JOIN m b ON a.day = b.day AND a.event_type <> b.event_type GROUP BY 1, 2),
h AS (SELECT k.*, k.share * pow(0.5, coalesce(cuts, 0)) AS kept FROM k LEFT JOIN x USING (day, event_type)), t AS (SELECT day, sum(kept) AS total FROM h GROUP BY 1)
SELECT event_id, round(kept * least(1.0, coalesce(0.15 / nullif(total, 0), 1.0)), 6)::DOUBLE AS portfolio_share FROM h JOIN t USING (day)""")
def portfolio_kelly(spark, d):
    c = _candidates(spark, d).withColumn("share", pricing.kelly(F.col("p"), F.col("odd"))).filter("event_id % 40 = 0 OR event_id < 400")
    pairs = spark.createDataFrame([("view", "click", 0.7)], "market_a string, market_b string, correlation double")
    return markets.portfolio_shares(c, "day", "event_type", "share", pairs).select("event_id", "portfolio_share")


@query(f"""WITH {_CAND}, k AS (SELECT day, event_id, event_type, {_KELLY} AS share FROM cand), m AS (SELECT day, event_type, sum(share) AS s FROM k GROUP BY 1, 2),
x AS (SELECT a.day, a.event_type, count(CASE WHEN (a.event_type IN ('click', 'view') AND b.event_type IN ('click', 'view')) AND (a.s < b.s OR (a.s = b.s AND a.event_type > b.event_type)) THEN 1 END) AS cuts FROM m a JOIN m b ON a.day = b.day AND a.event_type <> b.event_type GROUP BY 1, 2),
h AS (SELECT k.*, k.share * pow(0.5, coalesce(cuts, 0)) AS kept FROM k LEFT JOIN x USING (day, event_type)), t AS (SELECT day, sum(kept) AS total FROM h GROUP BY 1)
SELECT event_id, round(kept * least(1.0, coalesce(0.15 / nullif(total, 0), 1.0)), 6)::DOUBLE AS portfolio_share FROM h JOIN t USING (day)""")
def portfolio_kelly_all(spark, d):
    """Shares of all candidates; portfolio_kelly, whose SQL is fixed, gives those of a subset."""
    c = _candidates(spark, d).withColumn("share", pricing.kelly(F.col("p"), F.col("odd")))
    pairs = spark.createDataFrame([("view", "click", 0.7)], "market_a string, market_b string, correlation double")
    return markets.portfolio_shares(c, "day", "event_type", "share", pairs).select("event_id", "portfolio_share")


@query(f"WITH {_CAND} SELECT event_id, p, odd FROM cand ORDER BY p * odd DESC, event_id LIMIT 10")
def top_k(spark, d):
    return _candidates(spark, d).orderBy((F.col("p") * F.col("odd")).desc(), "event_id").limit(10).select("event_id", "p", "odd")


@query("""SELECT o_orderkey, CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 5 + CAST(floor(o_totalprice / 7) AS BIGINT) % 4 > 2.5 THEN true ELSE false END AS over_25, CAST(floor(o_totalprice) AS BIGINT) % 5 > 0 AND CAST(floor(o_totalprice / 7) AS BIGINT) % 4 > 0 AS btts, CASE WHEN o_orderstatus = 'P' THEN 'NO_RESULT' ELSE 'SETTLED' END AS reason FROM orders""")
def settle_outcomes(spark, d):
    o = table(spark, d, "orders")
    h, a = (F.floor("o_totalprice") % 5).cast("int"), (F.floor(F.col("o_totalprice") / 7) % 4).cast("int")
    known = F.when(F.col("o_orderstatus") != "P", h)
    r = dec.settlement(F.lit("totals"), known, a, F.lit(2.5), F.lit("over"))
    return o.select("o_orderkey", (dec.outcome(F.lit("over_25"), h, a, F.lit(None).cast("int")) == 1).alias("over_25"), (dec.outcome(F.lit("btts_yes"), h, a, F.lit(None).cast("int")) == 1).alias("btts"), r["reason"].alias("reason"))


@query("""WITH m AS (SELECT o_orderstatus, CAST(floor(o_totalprice) AS BIGINT) % 5 AS h, CAST(floor(o_totalprice / 7) AS BIGINT) % 4 AS a, CAST(floor(o_totalprice / 3) AS BIGINT) % 14 AS c FROM orders),
s AS (SELECT o_orderstatus, unnest(['over_05', 'over_15', 'over_25', 'under_25', 'btts_yes', 'btts_no', 'home_win', 'draw', 'away_win', 'corners_over_85', 'corners_over_95']) AS market,
 unnest([h + a > 0.5, h + a > 1.5, h + a > 2.5, h + a < 2.5, h > 0 AND a > 0, h = 0 OR a = 0, h > a, h = a, h < a, c > 8.5, c > 9.5]) AS won FROM m)
SELECT o_orderstatus, market, count(*) AS n, CAST(sum(CAST(won AS BIGINT)) AS BIGINT) AS won FROM s GROUP BY 1, 2""")
def settled_by_source(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", (F.floor("o_totalprice") % 5).alias("h"), (F.floor(F.col("o_totalprice") / 7) % 4).alias("a"), (F.floor(F.col("o_totalprice") / 3) % 14).alias("c"))
    s = dec.settle_all(o, "h", "a", "c", ["o_orderstatus"])
    return s.groupBy("o_orderstatus", "market").agg(F.count("*").alias("n"), F.sum(F.col("won").cast("long")).alias("won"))


@query(f"""WITH {PRICE_SQL}, q AS (SELECT match_id, snapshot, round(avg(price), 6) AS price FROM price GROUP BY 1, 2), m AS (SELECT o_orderkey, o_custkey % 40 AS match_id, CAST(o_orderdate AS DATE) AS due FROM orders),
q40 AS (SELECT match_id % 40 AS match_id, snapshot, max(price) AS price FROM q GROUP BY 1, 2)
SELECT o_orderkey, due, q.snapshot AS quoted_on, q.price, CASE WHEN date_diff('day', q.snapshot, due) <= 2 THEN q.price END AS fresh_price FROM m ASOF LEFT JOIN q40 q ON m.match_id = q.match_id AND m.due >= q.snapshot""")
def asof_price(spark, d):
    """Every order's last quote by its date, and that quote if it is at most two days old."""
    q = price_rows(spark, d).groupBy("match_id", "snapshot").agg(F.round(F.avg("price"), 6).alias("price"))
    q = q.groupBy((F.col("match_id") % 40).alias("match_id"), "snapshot").agg(F.max("price").alias("price"))
    m = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("match_id"), F.to_date("o_orderdate").alias("due"))
    found = markets.asof_join(m, q, ["match_id"], "due", "snapshot", ["price"])
    return found.select("o_orderkey", "due", F.to_date("matched_at").alias("quoted_on"), F.col("matched_price").alias("price"), F.when(F.datediff("due", F.to_date("matched_at")) <= 2, F.col("matched_price")).alias("fresh_price"))


_AHEAD = f"""{PRICE_SQL}, monthly AS (SELECT match_id % 60 AS match_id, selection, bookmaker, CAST(date_trunc('month', snapshot) AS DATE) AS snapshot, price FROM price),
times AS (SELECT DISTINCT snapshot FROM monthly ORDER BY 1 DESC LIMIT 12), recent AS (SELECT * FROM monthly WHERE snapshot IN (SELECT snapshot FROM times)),
now AS (SELECT max(snapshot) AS now, min(snapshot) AS first FROM recent), matches AS (SELECT DISTINCT match_id, (match_id * 2 - 10)::DOUBLE AS hours FROM monthly),
mine AS (SELECT match_id, selection, snapshot, avg(price) AS p FROM recent WHERE bookmaker = 0 GROUP BY 1, 2, 3),
lines AS (SELECT o.match_id, o.selection, o.p AS opening, c.p AS current, m.hours FROM mine o JOIN now ON o.snapshot = now.first JOIN (SELECT match_id, selection, arg_max(p, snapshot) AS p FROM mine GROUP BY 1, 2) c ON c.match_id = o.match_id AND c.selection = o.selection JOIN matches m ON m.match_id = o.match_id WHERE m.hours BETWEEN 0 AND 72),
per AS (SELECT match_id, selection, bookmaker, arg_min(p, snapshot) AS a, arg_max(p, snapshot) AS b FROM (SELECT match_id, selection, bookmaker, snapshot, avg(price) AS p FROM recent GROUP BY ALL) GROUP BY 1, 2, 3),
s AS (SELECT match_id, selection, count(*) AS n, count(*) FILTER ((a - b) / a > 0.02) AS down, count(*) FILTER ((a - b) / a < -0.02) AS up FROM per WHERE a > 0 AND b > 0 GROUP BY 1, 2),
moved AS (SELECT l.*, (opening - current) / opening AS m, coalesce(n >= 3 AND greatest(down, up) >= 3 AND greatest(down, up) / n >= 0.7, false) AS steam, down, up FROM lines l LEFT JOIN s USING (match_id, selection)),
report AS (SELECT match_id, selection, round(hours, 1) AS hours_to_start, round(opening, 3) AS opening, round(current, 3) AS current, round(m * 100, 2) AS movement_pct,
 CASE WHEN abs(m) > 0.08 AND hours > 24 THEN 'SHARP_MOVEMENT' WHEN abs(m) > 0.08 THEN 'LATE_SHARP' WHEN abs(m) < 0.03 AND hours < 2 THEN 'PUBLIC_MONEY' WHEN abs(m) >= 0.04 THEN 'SIGNIFICANT_MOVEMENT' ELSE 'NEUTRAL' END AS movement_type, steam, CASE WHEN steam THEN CASE WHEN down > up THEN 'DOWN' ELSE 'UP' END END AS direction FROM moved)"""


def _ahead(spark, d):
    """Monthly quotes, and matches that start from ten hours before to days after the last of them."""
    odds = price_rows(spark, d).select((F.col("match_id") % 60).alias("match_id"), "selection", "bookmaker", F.to_date(F.date_trunc("month", "snapshot")).alias("snapshot"), "price")
    last = odds.agg(F.max("snapshot").cast("timestamp")).first()[0]  # one value
    matches = odds.select("match_id").distinct().withColumn("starts", F.lit(last) + F.make_dt_interval(hours=(F.col("match_id") * 2 - 10).cast("int")))
    return markets.movement_report(odds, matches, "match_id", ["selection"], "bookmaker", "snapshot", "price", "starts", F.lit(last), 0)


@query(f"WITH {_AHEAD} SELECT *, CASE WHEN steam THEN 0.15 WHEN movement_type = 'SHARP_MOVEMENT' THEN 0.10 WHEN movement_type = 'LATE_SHARP' THEN 0.08 WHEN movement_type = 'PUBLIC_MONEY' THEN -0.05 ELSE 0.0 END AS modifier FROM report")
def movement_ahead(spark, d):
    """Movements of the matches of the next 72 hours."""
    return _ahead(spark, d)


@query(f"WITH {_AHEAD} SELECT count(DISTINCT match_id) AS matches_analyzed, count(*) AS total_lines, count(*) FILTER (movement_type IN ('SHARP_MOVEMENT', 'LATE_SHARP')) AS sharp_movements, count(*) FILTER (steam) AS steam_moves FROM report")
def movement_summary(spark, d):
    """Counts of those movements."""
    return markets.movement_summary(_ahead(spark, d), "match_id")
