"""Queries over match histories, league configurations and stores of bounded length."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.operators import outlook
from tallyfield.plans.bindings import table
from tallyfield.session import fresh_path
from tallyfield.sources import files, history, intake

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


@query("""SELECT CAST(event_id AS VARCHAR) AS match_id, CASE WHEN event_id % 10 <> 0 THEN date_trunc('second', ts) END AS date, CASE event_type WHEN 'click' THEN '' ELSE event_type END AS competition_code,
 CAST(event_id % 5 AS INTEGER) AS goals_home_ft, CAST(event_id % 4 AS INTEGER) AS goals_away_ft, CASE WHEN event_id % 5 > event_id % 4 THEN 'H' WHEN event_id % 5 < event_id % 4 THEN 'A' ELSE 'D' END AS result FROM events WHERE event_id % 7 <> 0""")
def match_history(spark, d):
    """Events as matches of several leagues, nested as their source has them: the finished ones, written by league and together."""
    n = F.col("event_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    when = F.when(n % 10 == 0, "postponed").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    code = F.when(F.col("event_type") == "click", F.lit("{}")).otherwise(text('{"code":"', F.col("event_type"), '"}'))
    json = text('{"id":', n, ',"utcDate":"', when, '","status":"', F.when(n % 7 == 0, "SCHEDULED").otherwise("FINISHED"), '","competition":', code, ',"score":{"fullTime":{"home":', n % 5, ',"away":', n % 4, "}}}")
    flat = intake.match_columns(table(spark, d, "events").select(json.alias("json")), "json", [])
    return history.write_history(flat, fresh_path(spark, "history")).select("match_id", "date", "competition_code", "goals_home_ft", "goals_away_ft", "result")


_CONFIGS = """SELECT 'conf/' || r.r_name || '.json' AS path, 'slug-' || n_nationkey AS league_slug, CASE WHEN n_nationkey % 3 = 0 THEN 'slug-' || n_nationkey ELSE n_name END AS league_name, r_name AS country,
 CASE WHEN n_nationkey % 2 = 0 THEN '2024' ELSE '2023+' END AS season, CASE WHEN n_nationkey % 4 = 0 THEN 2 ELSE 1 END AS priority, CAST(NULL AS VARCHAR) AS warning
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n_nationkey % 5 <> 4 AND r_regionkey <> 2"""


@query(f"{_CONFIGS} UNION ALL SELECT 'conf/' || r_name || '.json', NULL, NULL, NULL, NULL, NULL, 'invalid_leagues_payload:' || r_name || '.json' FROM region WHERE r_regionkey = 2")
def league_configs(spark, d):
    """Nations as leagues in a file for each region: those enabled, and a warning for the file that isn't a list."""
    k = F.col("n_nationkey")
    league = F.struct(
        F.concat(F.lit("slug-"), k.cast("string")).alias("league_slug"), F.when(k % 3 != 0, F.col("n_name")).alias("name"), F.col("r_name").alias("country"),
        F.when(k % 2 == 0, "2024").alias("season"), F.when(k % 5 == 4, False).alias("enabled"), F.when(k % 4 == 0, 2).alias("priority"),
    )
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lists = both.groupBy("r_regionkey", "r_name").agg(F.to_json(F.collect_list(league)).alias("list"))  # a region's nations: a configuration file
    text = F.when(F.col("r_regionkey") == 2, '{"leagues": 5}').when(F.col("r_regionkey") == 1, F.col("list")).otherwise(F.concat(F.lit('{"leagues":'), F.col("list"), F.lit("}")))
    rows, bad = history.league_configs(lists.select(F.concat(F.lit("conf/"), F.col("r_name"), F.lit(".json")).alias("path"), text.alias("text")), "path", "text")
    return rows.drop("place", "canonical_league_id").unionByName(bad, allowMissingColumns=True)


@query("""WITH s AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'ENGINE_READY' WHEN 'O' THEN 'ENGINE_FOUND_OUTPUTS_EMPTY' WHEN 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'ENGINE_MISSING' END END AS e,
 CASE WHEN o_custkey % 3 <> 0 THEN 'FUTURE_GAMES_READY' ELSE 'FUTURE_GAMES_EMPTY' END AS f FROM orders)
SELECT o_orderkey, CASE WHEN e = 'ENGINE_READY' AND f = 'FUTURE_GAMES_READY' THEN 'READY' WHEN e = 'ENGINE_MISSING' THEN 'ENGINE_MISSING' WHEN e = 'ENGINE_FOUND_OUTPUTS_EMPTY' THEN 'ENGINE_OUTPUTS_EMPTY' ELSE 'PARTIAL_READY' END AS readiness FROM s""")
def source_readiness(spark, d):
    """What the states of two sources amount to."""
    s = F.col("o_orderstatus")
    engine = F.when(s == "F", "ENGINE_READY").when(s == "O", "ENGINE_FOUND_OUTPUTS_EMPTY").when((s == "P") & (F.col("o_orderkey") % 2 == 0), "ENGINE_MISSING")
    future = F.when(F.col("o_custkey") % 3 != 0, "FUTURE_GAMES_READY").otherwise("FUTURE_GAMES_EMPTY")
    return table(spark, d, "orders").select("o_orderkey", history.readiness(engine, future).alias("readiness"))


@query(f"SELECT coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN 'm' || o_orderkey END, CAST(o_custkey AS VARCHAR)) AS match_id, CAST(o_custkey AS VARCHAR) AS flashscore_match_id, o_totalprice AS odds_home, CAST(NULL AS VARCHAR) AS xg_home, {len(history.MATCH_COLUMNS) + 1} AS columns FROM orders")
def completed_columns(spark, d):
    """Orders as matches of few columns, with all that a match table has and missing ids from the other."""
    rows = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("m"), F.col("o_orderkey").cast("string"))).alias("match_id"), F.col("o_custkey").alias("flashscore_match_id"), F.col("o_totalprice").alias("odds_home"), F.lit(1).alias("extra"))
    out = history.complete_columns(rows)
    return out.select("match_id", F.col("flashscore_match_id").cast("string").alias("flashscore_match_id"), "odds_home", "xg_home", F.lit(len(out.columns)).alias("columns"))


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def event_store(spark, d):
    """A store of the last 500 events: a first part of them, the rest, and the rest once more."""
    e = table(spark, d, "events").select("event_id", "ts", "event_type")
    path = fresh_path(spark, "event-store")
    for rows in ("event_id % 3 <> 0", "event_id % 3 = 0", "event_id % 3 = 0"):
        held = files.append_bounded(path, e.filter(rows), ["ts", "event_id"], 500)
    return held


_BREAK = """c AS (SELECT event_type, event_id, (event_id * 61 % 977)::DOUBLE AS decision_score, (event_id * 37 % 1000) / 1000.0::DOUBLE AS p, CASE WHEN event_id % 3 <> 0 THEN (event_id % 200 - 100) / 1000.0 END::DOUBLE AS ev, (event_id % 80)::DOUBLE AS risk FROM events WHERE event_id % 50 <> 7),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY decision_score DESC, event_id) = 1)"""


@query(f"""WITH {_BREAK} SELECT event_type, event_id, decision_score, 'Probabilidade ML' AS name, round(p * 100, 2) AS value, 'positive' AS impact FROM b UNION ALL SELECT event_type, event_id, decision_score, 'Valor esperado', round(ev * 100, 2), 'positive' FROM b WHERE ev IS NOT NULL
UNION ALL SELECT event_type, event_id, decision_score, 'Odds vs prob. implícita', round((p - 0.5) * 100, 2), 'positive' FROM b UNION ALL SELECT event_type, event_id, decision_score, 'Risco operacional', round(risk, 2), 'negative' FROM b""")
def factor_breakdown(spark, d):
    """What speaks for and against the best signal of each market; one factor's column is absent."""
    n = F.col("event_id")
    rows = table(spark, d, "events").select(
        "event_type", "event_id", F.when(n % 50 != 7, (n * 61 % 977).cast("double")).alias("decision_score"), ((n * 37 % 1000) / 1000).alias("ml_probability"), F.when(n % 3 != 0, (n % 200 - 100) / 1000).alias("true_ev"),
        F.lit(0.5).alias("implied_probability"), (n % 80).cast("double").alias("risk_score"),
    )
    return outlook.factor_breakdown(rows, ["event_type"], "decision_score", "event_id")
