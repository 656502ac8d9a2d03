"""Queries over what comes in from others' files and what goes out to them, and one-row summaries of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions import scan
from tallyfield.operators import decisions, summaries
from tallyfield.plans.bindings import TRADE_SQL, table, trade_rows
from tallyfield.session import fresh_path
from tallyfield.sources import files, intake, outputs

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


@query("""SELECT count(*) AS total_rows, count(DISTINCT CASE WHEN event_type <> 'error' THEN event_type END) AS total_leagues,
 (SELECT count(DISTINCT k) FROM (SELECT CAST(user_id AS VARCHAR) AS k FROM events UNION ALL SELECT CAST(event_id % 97 AS VARCHAR) FROM events WHERE event_id % 4 <> 0)) AS total_teams,
 CAST(min(ts) FILTER (event_id % 10 <> 0) AS DATE) AS first_date, CAST(max(ts) FILTER (event_id % 10 <> 0) AS DATE) AS last_date, 8 AS columns, 5 AS features_count, 4 AS advanced_features_count FROM events""")
def dataset_summary(spark, d):
    """Events as matches: rows, leagues, teams of both sides together, dates, and what kinds of columns there are."""
    e = table(spark, d, "events")
    rows = e.select(
        "event_id", F.when(F.col("event_id") % 10 == 0, "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("date"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("league"),
        F.col("user_id").cast("string").alias("home_team_key"), F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 97).cast("string")).alias("away_team_key"),
        F.col("value").alias("goals_std_last_5"), F.lit(True).alias("high_shots_flag"), F.lit(0).alias("rest_days"),
    )
    return summaries.dataset_summary(rows, ["home_team_key", "away_team_key"])


@query(f"""WITH {TRADE_SQL}, c AS (SELECT count(*) AS n, count(DISTINCT league) AS l, count(DISTINCT event_id % 50) AS k, count(DISTINCT market) AS m FROM trade)
SELECT n AS total_trades, l AS league_count, k AS team_count, m AS market_count, CASE WHEN n < 100 THEN '{summaries.WEAK}' WHEN n < 1000 THEN '{summaries.MIDDLE}' ELSE '{summaries.STRONG}' END AS sample_level,
 n >= 100 AND l >= 2 AS is_ready_for_ml, CASE WHEN n < 1000 THEN '{summaries.NEXT_STEP}' ELSE '{summaries.LAST_STEP}' END AS recommended_next_step,
 concat_ws(' | ', CASE WHEN n < 100 THEN '{summaries.MORE_TRADES}' END, CASE WHEN l <= 1 THEN '{summaries.BY_LEAGUE}' END, CASE WHEN k > 0 THEN '{summaries.BY_TEAM}' END, CASE WHEN m > 1 THEN '{summaries.BY_MARKET}' END) AS recommendations FROM c""")
def backtest_health(spark, d):
    """How large and how broad a log of trades is."""
    rows = trade_rows(spark, d).withColumn("team_key", F.concat(F.lit("t"), (F.col("event_id") % 50).cast("string")))
    return summaries.backtest_health(rows).withColumn("recommendations", F.array_join("recommendations", " | "))


@query(f"""WITH {TRADE_SQL} SELECT event_id, strategy, market, CASE WHEN event_id % 11 <> 0 THEN date_trunc('second', ts) END AS date, is_win,
 CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE profit END AS profit, CASE WHEN event_id % 5 = 0 THEN 1.0 ELSE 1.5 END AS stake, CASE WHEN event_id % 13 <> 0 THEN odd END AS odd FROM trade""")
def trade_log(spark, d):
    """A log of trades written as text files, with blanks and words among its numbers, found by its base name and typed again."""
    n = F.col("event_id")
    words = F.when(n % 3 == 0, F.when(F.col("is_win"), "1").otherwise("0")).when(F.col("is_win"), "True").otherwise("False")
    rows = trade_rows(spark, d).select(
        "event_id", "strategy", "market", F.when(n % 11 == 0, "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("date"), words.alias("is_win"),
        F.when(n % 7 == 0, "n/a").otherwise(F.col("profit").cast("string")).alias("profit"), F.when(n % 5 != 0, "1.5").alias("stake"), F.when(n % 13 == 0, "nan").otherwise(F.col("odd").cast("string")).alias("odd"),
    )
    path = fresh_path(spark, "trade-log")
    rows.write.csv(f"{path}.csv", header=True)
    return intake.load_trades(files.read_first(spark, path)).withColumn("event_id", F.col("event_id").cast("long"))


@query(f"""WITH {TRADE_SQL}, v AS (SELECT strategy, ts, event_id, 100 + sum(profit) OVER w AS v FROM trade WINDOW w AS (PARTITION BY strategy ORDER BY ts, event_id)),
p AS (SELECT strategy, v, max(v) OVER (PARTITION BY strategy ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM v)
SELECT strategy, count(*) AS points, round(min(CASE WHEN peak = 0 THEN 0 ELSE (v - peak) / peak * 100 END), 2) AS max_drawdown FROM p GROUP BY 1""")
def curve_risk(spark, d):
    """The worst fall, in percent of the highest value so far, of each strategy's curve of bankrolls."""
    rows = scan.numbered(trade_rows(spark, d), ["strategy"], ["ts", "event_id"])
    curve = scan.running_peak(rows, ["strategy"], F.col("profit"), [], "v", "_peak", 100.0).drop("_peak")
    return summaries.curve_risk(summaries.percent_drawdown(curve, ["strategy"], "v"), ["strategy"])


@query("SELECT o_orderkey AS signal_id, o_orderdate AS signal_date, 's' || CAST(o_custkey % 3 AS VARCHAR) AS strategy, round(o_totalprice / 1000, 3) AS stake FROM orders WHERE o_orderstatus IN ('P', 'O')")
def active_signals(spark, d):
    """Orders as signals: those pending, whatever the case of the word."""
    word = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("SETTLED")
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("signal_id"), F.col("o_orderdate").alias("signal_date"), F.concat(F.lit("s"), (F.col("o_custkey") % 3).cast("string")).alias("strategy"),
        F.round(F.col("o_totalprice") / 1000, 3).alias("stake"), word.alias("status"), F.col("o_orderdate").alias("note"),
    )
    return summaries.active_signals(rows)


_RESEARCH = """q AS (SELECT event_id, event_type, (event_id * 37 % 1000) / 1000.0::DOUBLE AS p, CASE WHEN event_id % 9 = 0 THEN 0.0 WHEN event_id % 8 = 0 THEN round(1.4 + event_id % 50 / 100.0, 2) ELSE round(1.3 + event_id % 140 / 100.0, 2) END::DOUBLE AS odds FROM events),
r AS (SELECT *, CASE WHEN odds > 1 THEN round(p * odds - 1, 6) END AS true_ev, concat_ws(' | ', CASE WHEN event_id % 6 = 0 OR event_id % 10 < 6 THEN 'LOW_DATA_QUALITY' END, CASE WHEN event_id % 7 = 0 THEN 'LOW_SAMPLE_SIZE' END) AS risk_flags FROM q)"""


def _research(spark, d):
    n = F.col("event_id")
    zero = F.when(n % 9 == 0, 0.0)
    rows = table(spark, d, "events").select(
        "event_id", "event_type", ((n * 37 % 1000) / 1000).alias("p"), zero.when(n % 8 != 0, F.round(1.3 + n % 140 / 100, 2)).alias("odds_a"), zero.otherwise(F.round(1.4 + n % 50 / 100, 2)).cast("string").alias("odds_b"),
        F.when(n % 6 != 0, (n % 10) / 10).alias("quality"), F.when(n % 7 == 0, "X;LOW_SAMPLE_LEAGUE").alias("warnings"),
    )
    found = decisions.research_candidate(F.col("p"), ["odds_a", "odds_b"], "quality", "warnings")
    return rows.select("event_id", "event_type", *[c.alias(name) for name, c in found.items()])


@query(f"""WITH {_RESEARCH} SELECT event_id, event_type, p AS ensemble_probability, odds, true_ev, risk_flags, CASE WHEN p >= 0.58 THEN 'MEDIUM_CONFIDENCE_SIMULATION' ELSE 'WATCH_ONLY' END AS confidence_band,
 CASE WHEN p >= 0.54 AND (true_ev IS NULL OR true_ev > -0.05) THEN 'SIMULATION_CANDIDATE' ELSE 'WATCH_ONLY' END AS recommendation_type, CASE WHEN p >= 0.54 AND (true_ev IS NULL OR true_ev > -0.05) THEN 'KEEP' ELSE 'WATCH' END AS rule_status FROM r""")
def research_candidates(spark, d):
    """Predictions with a first and a second price: worth, recommendation, band and risks."""
    return _research(spark, d)


@query(f"""WITH {_RESEARCH} SELECT CASE WHEN event_id % 2 = 0 THEN 'Match "' || CAST(event_id AS VARCHAR) || '", final' ELSE 'home ' || CAST(event_id AS VARCHAR) || ' vs ' END AS match, event_type AS market, CAST(event_id AS DOUBLE) AS score,
 p AS probability, nullif(risk_flags, '') AS risks, CAST(NULL AS VARCHAR) AS explanation, '{outputs.MODE}' AS mode FROM r WHERE p >= 0.58""")
def exported_candidates(spark, d):
    """Candidates of the exported bands, written as text files and read by their reader."""
    n = F.col("event_id")
    rows = _research(spark, d).withColumns({"match": F.when(n % 2 == 0, F.concat(F.lit('Match "'), n.cast("string"), F.lit('", final'))).otherwise(""), "home_team": F.concat(F.lit("home "), n.cast("string")), "market": F.col("event_type"), "score": n})
    read = outputs.export_candidates(rows, fresh_path(spark, "exported"))
    return read.withColumn("risks", F.nullif("risks", F.lit("")))


@query("""WITH o AS (SELECT *, o_orderkey % 13 AS c, round(o_totalprice / 100000 + 1, 2) AS p FROM orders) SELECT 'matches' AS part, 6 AS columns, count(*) AS n, sum(o_orderkey) AS ids, sum(c) AS corners, round(sum(p), 4) AS odds FROM o
UNION ALL SELECT 'odds', 3, count(*), sum(o_orderkey), NULL, round(sum(p), 4) FROM o UNION ALL SELECT 'stats', 3, count(*), sum(o_orderkey), sum(c), NULL FROM o""")
def part_sinks(spark, d):
    """Orders as matches, written in parts: how many columns and rows each part's reader finds, and their sums."""
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("match_id"), F.lit("p").alias("provider"), (F.col("o_orderkey") % 13).alias("corners_home"), F.round(F.col("o_totalprice") / 100000 + 1, 2).alias("odds_home"), F.col("o_orderdate").alias("date"), F.col("o_custkey").alias("home_team"))
    whole = None
    for part, path in outputs.write_parts(rows, fresh_path(spark, "match-parts")).items():
        p = spark.read.parquet(path)
        of = lambda c, kind: (F.sum(c) if c in p.columns else F.lit(None)).cast(kind)  # noqa: E731, B023
        one = p.agg(F.lit(part).alias("part"), F.lit(len(p.columns)).alias("columns"), F.count("*").alias("n"), F.sum("match_id").alias("ids"), of("corners_home", "long").alias("corners"), F.round(of("odds_home", "double"), 4).alias("odds"))
        whole = one if whole is None else whole.unionByName(one)
    return whole


@query("""SELECT vec_id, len(list_filter(range(1, len(embedding) + 1), lambda i: NOT (i = 1 AND vec_id % 3 < 2) AND embedding[i] IS NOT NULL AND isfinite(embedding[i]))) AS numbers, len(embedding) AS components,
 CASE WHEN vec_id % 5 <> 0 THEN vec_id / 4.0 END::DOUBLE AS score, label FROM embeddings""")
def strict_rows(spark, d):
    """Vectors with NaN and infinities put in, written as JSON and read back by a reader that fails on what isn't JSON."""
    e, n = table(spark, d, "embeddings"), F.col("vec_id")
    first = F.when(n % 3 == 0, F.lit(float("nan"))).when(n % 3 == 1, F.lit(float("-inf"))).cast("float")
    rows = e.select("vec_id", "label", F.transform("embedding", lambda x, i: F.when(i == 0, F.coalesce(first, x)).otherwise(x)).alias("v"), F.struct(F.when(n % 5 == 0, F.lit(float("inf"))).otherwise(n / 4).alias("score")).alias("facts"))
    path = fresh_path(spark, "strict")
    rows.select(outputs.strict_json(rows).alias("value")).write.text(path)
    read = spark.read.schema("vec_id long, label int, v array<float>, facts struct<score:double>").option("mode", "FAILFAST").option("allowNonNumericNumbers", False).json(path)
    there = F.size(F.filter("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    return read.select("vec_id", F.when(F.col("v").isNotNull(), there).alias("numbers"), F.when(F.col("v").isNotNull(), F.size("v")).alias("components"), F.col("facts.score").alias("score"), "label")


_GOALS = "g AS (SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN event_id % 5 END AS h, event_id % 4 AS a FROM events)"


@query(f"""WITH {_GOALS} SELECT event_id, h::DOUBLE AS goals_home_ft, a::DOUBLE AS goals_away_ft, (h + a)::DOUBLE AS total_goals_ft, CASE WHEN event_id % 3 = 0 THEN 1.0 END::DOUBLE AS total_goals_ht, CAST(NULL AS DOUBLE) AS shots_home,
 'shots_home,shots_away,shots_on_target_home,shots_on_target_away,corners_home,corners_away' AS missing FROM g""")
def metric_columns(spark, d):
    """Measures by other names and as text: an empty total is made from both sides, a total with gaps keeps them."""
    n = F.col("event_id")
    rows = table(spark, d, "events").select(
        "event_id", F.when(n % 17 == 0, "x").otherwise((n % 5).cast("string")).alias("GOALS_H_FT"), (n % 4).alias("away_goals"), F.lit(None).cast("string").alias("TotalGoals_FT"),
        F.lit("1").alias("goals_h_ht"), F.lit("2").alias("goals_a_ht"), F.when(n % 3 == 0, "1").alias("total_goals_ht"),
    )
    out, missing = intake.metric_columns(rows)
    return out.select("event_id", "goals_home_ft", "goals_away_ft", "total_goals_ft", "total_goals_ht", "shots_home", F.lit(",".join(missing)).alias("missing"))


@query(f"""WITH {_GOALS} SELECT event_id, CAST(event_id AS VARCHAR) AS match_id, '2024-01-05T10:00:00Z' AS date, 'League' AS league, CASE WHEN event_id % 2 = 0 THEN 'L1' ELSE '' END AS competition_code, 'Home' AS home_team, CASE WHEN event_id % 6 <> 0 THEN 'Away' END AS away_team, '1' AS home_team_id,
 CASE WHEN event_id % 6 <> 0 THEN '2' END AS away_team_id, h::INT AS goals_home_ft, CASE WHEN h IS NOT NULL THEN a END::INT AS goals_away_ft, CASE WHEN event_id % 17 <> 0 THEN 1 END AS goals_home_ht, CASE WHEN event_id % 17 <> 0 THEN 0 END AS goals_away_ht, 'FINISHED' AS match_status, CAST(event_id % 38 AS INTEGER) AS matchday, '2023-08-01' AS season,
 (h + a)::INT AS total_goals_ft, CASE WHEN h IS NOT NULL THEN h > 0 AND a > 0 END AS btts, h + a > 1 AS over_1_5, h + a > 2 AS over_2_5, h + a > 3 AS over_3_5, CASE WHEN h > a THEN 'H' WHEN a > h THEN 'A' WHEN h = a THEN 'D' END AS result FROM g""")
def flattened_matches(spark, d):
    """Matches as their source nests them, flat and with what follows from the score; some lack a side or the score."""
    n = F.col("event_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    score = F.when(n % 17 == 0, F.lit('{"fullTime":null}')).otherwise(text('{"fullTime":{"home":', n % 5, ',"away":', n % 4, '},"halfTime":{"home":1,"away":0}}'))
    code = F.when(n % 2 == 0, ',"code":"L1"').otherwise("")
    away = F.when(n % 6 == 0, "null").otherwise('{"id":2,"name":"Away"}')
    json = text('{"id":', n, ',"utcDate":"2024-01-05T10:00:00Z","status":"FINISHED","matchday":', n % 38, ',"competition":{"name":"League"', code, '},"season":{"startDate":"2023-08-01"},"homeTeam":{"id":1,"name":"Home"},"awayTeam":', away, ',"score":', score, "}")
    return intake.match_columns(table(spark, d, "events").select("event_id", json.alias("json")), "json", ["event_id"])
