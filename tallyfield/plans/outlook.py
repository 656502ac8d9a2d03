"""Queries of the feature table and of what signals promise."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.operators import outlook, specification
from tallyfield.operators.features import points_of
from tallyfield.plans.bindings import PROBABILITY_SQL, TEAM_SQL, probability_rows, team_rows

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


#: The sources of features among the columns of the bindings' team rows.
_SOURCES = {
    "goals_for_ft": "goals", "goals_against_ft": "event_id % 4", "total_goals_ft": "goals + event_id % 4", "points": "CASE result WHEN 'W' THEN 3 WHEN 'D' THEN 1 ELSE 0 END",
    "is_win": "CASE WHEN result = 'W' THEN 1 ELSE 0 END", "is_draw": "CASE WHEN result = 'D' THEN 1 ELSE 0 END", "is_loss": "CASE WHEN result = 'L' THEN 1 ELSE 0 END", "shots_for": "shots", "shots_against": "event_id % 13",
    "shots_on_target_for": "shots % 7", "shots_on_target_against": "event_id % 6", "corners_for": "CASE WHEN event_id % 8 <> 0 THEN corners END", "corners_against": "event_id % 9",
    "shots_conversion_rate": "goals / 4.0", "shots_on_target_rate": "CASE WHEN shots > 0 THEN (shots % 7) / 8.0 END",
}


def _feature_sql(f: specification.Feature) -> str:
    by = "user_id, side" if f.side else "user_id"
    mean = f"avg({f.source}::DOUBLE) OVER (PARTITION BY {by} ORDER BY ts, event_id ROWS BETWEEN {f.rows} PRECEDING AND 1 PRECEDING)"
    x = f"CASE WHEN side = '{f.side}' THEN {mean} END" if f.side else mean
    return f"SELECT '{f.name}' AS feature, '{f.source}' AS source, {f.rows} AS rows, '{f.scope}' AS scope, count(*) AS total_rows, count(x) AS filled, 0 AS first_filled, 0 AS differing FROM (SELECT {x} AS x FROM s)"


_ALL = specification.rolling_features()


def _team_sources(spark, d):
    return team_rows(spark, d).select("event_id", "user_id", "ts", "side", *[F.expr(e).alias(c) for c, e in _SOURCES.items() if c != "points"], points_of(F.col("result")).alias("points"))


_S = f"WITH {TEAM_SQL}, s AS MATERIALIZED (SELECT event_id, user_id, ts, side, {', '.join(f'{e} AS {c}' for c, e in _SOURCES.items())} FROM team)"


@query(f"{_S} {' UNION ALL '.join(_feature_sql(f) for f in _ALL)}")
def feature_specification(spark, d):
    """Every rolling feature, made and checked by the table that names it."""
    rows = specification.build(_team_sources(spark, d), "user_id", "side", ["ts", "event_id"])
    return specification.check(rows, "user_id", "side", ["ts", "event_id"])


_SIDES = [f for f in _ALL if f.side or f.name.endswith("rate_avg_last_5")]


def _value_sql(f: specification.Feature) -> str:
    by = "user_id, side" if f.side else "user_id"
    mean = f"round(avg({f.source}::DOUBLE) OVER (PARTITION BY {by} ORDER BY ts, event_id ROWS BETWEEN {f.rows} PRECEDING AND 1 PRECEDING), 6)"
    return f"CASE WHEN side = '{f.side}' THEN {mean} END AS {f.name}" if f.side else f"{mean} AS {f.name}"


@query(f"{_S} SELECT event_id, {', '.join(_value_sql(f) for f in _SIDES)} FROM s")
def specified_features(spark, d):
    """The values of the features by side and of the rates."""
    rows = specification.build(_team_sources(spark, d), "user_id", "side", ["ts", "event_id"], _SIDES)
    return rows.select("event_id", *[F.round(f.name, 6).alias(f.name) for f in _SIDES])


_BUCKETS = f"WITH {PROBABILITY_SQL}, b AS (SELECT event_type, user_id % 12 AS bucket, avg(p * (1.6 + event_id % 50 / 100.0) - 1) * 100 AS ev FROM prob GROUP BY 1, 2)"


def _buckets(spark, d):
    ev = F.avg(F.col("p") * (1.6 + F.col("event_id") % 50 / 100) - 1) * 100
    return probability_rows(spark, d).groupBy("event_type", (F.col("user_id") % 12).alias("bucket")).agg(ev.alias("ev"))


def _scenario_sql(name: str) -> str:
    risk, exposure = outlook.SCENARIOS[name]
    score = f"(coalesce(spread, 0) * {risk} + greatest(0, -ev * {exposure}) * 2)"
    advice = f"CASE WHEN {score} > 20 THEN '{outlook.ADVICE[name]}' ELSE '{outlook.BASELINE}' END" if name == "defensive" else f"'{outlook.ADVICE.get(name, outlook.BASELINE)}'"
    return f"SELECT event_type, '{name}' AS name, round(ev * {exposure}, 3) AS projected_ev_pct, round(spread * {risk}, 3) AS volatility_proxy, round({score}, 3) AS risk_score, {advice} AS recommendation FROM m"


@query(f"{_BUCKETS}, m AS (SELECT event_type, avg(ev) AS ev, CASE WHEN count(ev) > 1 THEN stddev_pop(ev) END AS spread FROM b GROUP BY 1) {' UNION ALL '.join(map(_scenario_sql, outlook.SCENARIOS))}")
def scenario_projection(spark, d):
    """Defensive, balanced and aggressive projections of each market from its buckets."""
    return outlook.scenarios(_buckets(spark, d), "ev", ["event_type"])


_SNAP = "snap AS (SELECT user_id, CASE WHEN user_id % 10 <> 0 THEN 'real_data' ELSE 'no_data' END AS state, round(avg(p * 2 - 1) * 100, 6) AS ev, round(avg(event_id % 90), 6) AS risk, count(*) AS n, count(*) FILTER (event_type = 'error') AS critical FROM prob GROUP BY 1)"
_U = "least(0.95, CASE WHEN state = 'real_data' THEN 0.18 ELSE 0.62 END + CASE WHEN n < 30 THEN 0.22 WHEN n < 100 THEN 0.1 ELSE 0.0 END + least(0.24, critical * 0.035))::DOUBLE"


@query(f"""WITH {PROBABILITY_SQL}, {_SNAP}, u AS (SELECT *, {_U} AS u FROM snap)
SELECT user_id, CASE WHEN state <> 'real_data' THEN 'diagnostic' WHEN critical >= 2 OR risk >= 65 OR ev < -1 THEN 'defensive' WHEN ev > 2 AND risk < 45 THEN 'aggressive' WHEN risk >= 50 THEN 'conservative' ELSE 'balanced' END AS regime,
 round(u, 3) AS uncertainty_score, CASE WHEN u > 0.65 THEN 'high' WHEN u > 0.38 THEN 'medium' ELSE 'low' END AS ambiguity_level, round(1 - u, 3) AS robustness_score, round(greatest(0, 1 - u) * 0.45, 3) AS p_low, 0.35::DOUBLE AS p_medium, round(u * 0.65, 3) AS p_high,
 round(greatest(0.1, 1 - u), 3) AS p_base_case, round(least(0.8, u), 3) AS p_stress_case, round(greatest(0.05, 0.45 - u / 3), 3) AS p_recovery_case FROM u""")
def regimes(spark, d):
    """Regime and uncertainty of each user's signals."""
    count = lambda test: F.count(F.when(test, 1))
    s = probability_rows(spark, d).groupBy("user_id").agg(
        F.round(F.avg(F.col("p") * 2 - 1) * 100, 6).alias("ev"), F.round(F.avg(F.col("event_id") % 90), 6).alias("risk"), F.count("*").alias("n"), count(F.col("event_type") == "error").alias("critical")
    )
    state = F.when(F.col("user_id") % 10 != 0, "real_data").otherwise("no_data")
    found = outlook.reasoning(outlook.uncertainty(state, F.col("n"), F.col("critical")))
    return s.select("user_id", outlook.regime(state, F.col("ev"), F.col("risk"), F.col("critical")).alias("regime"), *[c.alias(n) for n, c in found.items()])
