"""Queries over predictions and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.operators import features, learning, stats
from tallyfield.plans.bindings import PROBABILITY_SQL, probability_rows, table, team_rows
from tallyfield.session import fresh_path, materialise
from tallyfield.sources import models as registry_of_models

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


_C = "least(greatest(p, 1e-15), 1 - 1e-15)"


@query(f"""WITH {PROBABILITY_SQL} SELECT event_type, count(*) AS n, round(avg(pow(p - y, 2)), 6) AS brier, round(-avg(y * ln({_C}) + (1 - y) * ln(1 - {_C})), 6) AS log_loss, round(avg(CAST((p >= 0.5) = (y = 1) AS DOUBLE)), 6) AS accuracy,
 round(coalesce(sum(CASE WHEN p >= 0.5 AND y = 1 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END), 0), 0), 6) AS precision, round(coalesce(sum(CASE WHEN p >= 0.5 AND y = 1 THEN 1 ELSE 0 END) / nullif(sum(y), 0), 0), 6) AS recall FROM prob GROUP BY 1""")
def brier_logloss(spark, d):
    return stats.scores(probability_rows(spark, d), ["event_type"], "p", "y")


@query(f"""WITH {PROBABILITY_SQL}, g AS (SELECT event_type, p, sum(y) AS pos, sum(1 - y) AS neg FROM prob GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY event_type ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT event_type, round(sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0), 6) AS auc FROM b GROUP BY 1""")
def auc_rank(spark, d):
    return stats.auc(probability_rows(spark, d), ["event_type"], "p", "y")


_BIN = "CAST(least(floor(p * 10), 9) AS INTEGER)"


@query(f"WITH {PROBABILITY_SQL}, b AS (SELECT {_BIN} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM prob GROUP BY 1) SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n, round(mp, 6) AS mean_p, round(my, 6) AS rate, round(abs(mp - my), 6) AS gap FROM range(10) r(i) LEFT JOIN b ON b.bin = i")
def reliability_bins(spark, d):
    return stats.reliability(probability_rows(spark, d), "p", "y")


@query(f"WITH {PROBABILITY_SQL}, b AS (SELECT {_BIN} AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM prob GROUP BY 1) SELECT round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS mce FROM b")
def ece_bins(spark, d):
    return stats.calibration_error(probability_rows(spark, d), "p", "y")


@query(f"WITH {PROBABILITY_SQL}, b AS (SELECT {_BIN} AS bin, round(least(greatest(round(avg(y), 6), 0.02), 0.98), 6) AS c FROM prob GROUP BY 1) SELECT event_id, c AS calibrated FROM prob JOIN b ON b.bin = {_BIN}")
def calibrator_apply(spark, d):
    rows = probability_rows(spark, d)
    return stats.calibrate(rows, stats.calibrator(rows, "p", "y"), "p").select("event_id", "calibrated")


_CUR = "o_orderdate >= TIMESTAMP '1997-01-01'"


@query(f"""WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), b AS (SELECT CAST(greatest(ceil((o_totalprice - lo) / (hi - lo) * 10) - 1, 0) AS INTEGER) AS bin, sum(CAST({_CUR} AS INTEGER)) AS a, sum(CAST(NOT ({_CUR}) AS INTEGER)) AS b FROM orders, s GROUP BY 1),
e AS (SELECT coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM range(10) r(i) LEFT JOIN b ON bin = i), q AS (SELECT a / sum(a) OVER () AS a, b / sum(b) OVER () AS b FROM e)
SELECT round(sum((a - b) * ln((a + 1e-6) / (b + 1e-6))), 6) AS psi, round((sum((a + 1e-12) * ln((a + 1e-12) / ((a + b) / 2 + 1e-12))) + sum((b + 1e-12) * ln((b + 1e-12) / ((a + b) / 2 + 1e-12)))) / 2, 6) AS js FROM q""")
def psi_js(spark, d):
    return stats.histogram_drift(table(spark, d, "orders"), "o_totalprice", F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))


@query(f"""WITH v AS (SELECT o_totalprice AS x, sum(CAST({_CUR} AS INTEGER)) AS a, sum(CAST(NOT ({_CUR}) AS INTEGER)) AS b FROM orders GROUP BY 1), t AS (SELECT sum(a) AS na, sum(b) AS nb FROM v),
c AS (SELECT sum(a) OVER (ORDER BY x) / na AS fa, sum(b) OVER (ORDER BY x) / nb AS fb FROM v, t) SELECT round(max(abs(fa - fb)), 6) AS ks FROM c""")
def ks_stat(spark, d):
    return stats.ks_statistic(table(spark, d, "orders"), "o_totalprice", F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LCUR = "l_shipdate >= TIMESTAMP '1997-01-01'"


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(abs(avg(CASE WHEN {_LCUR} THEN {c} END) - avg(CASE WHEN NOT ({_LCUR}) THEN {c} END)) / nullif(stddev_pop(CASE WHEN NOT ({_LCUR}) THEN {c} END), 0), 6) AS z, false AS drifted FROM lineitem" for c in _COLS))
def zshift(spark, d):
    return stats.mean_shifts(table(spark, d, "lineitem"), _COLS, F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, abs(corr({a}, {b})) > 0.9 AS dropped FROM lineitem" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]))
def corr_prune(spark, d):
    return stats.correlated_pairs(table(spark, d, "lineitem"), _COLS, 0.9)


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS filled, count(DISTINCT {c}) AS \"distinct\", count({c}) >= greatest(4, count(*) * 0.4) AND count(DISTINCT {c}) >= 2 AS usable FROM lineitem" for c in _COLS))
def feature_quality(spark, d):
    return stats.usable_features(table(spark, d, "lineitem"), _COLS)


@query(f"WITH {PROBABILITY_SQL} SELECT event_type, round(avg(CAST(p < 0.4 AS DOUBLE)), 6) AS low_share, round(avg(CAST(p >= 0.7 AS DOUBLE)), 6) AS high_share, round(avg(p), 6) AS mean_p FROM prob GROUP BY 1")
def probability_drift(spark, d):
    p = F.col("p")
    return probability_rows(spark, d).groupBy("event_type").agg(F.round(F.avg((p < 0.4).cast("double")), 6).alias("low_share"), F.round(F.avg((p >= 0.7).cast("double")), 6).alias("high_share"), F.round(F.avg(p), 6).alias("mean_p"))


@query(f"""WITH {PROBABILITY_SQL}, b AS (SELECT event_type, avg(pow(p - y, 2)) AS br, avg(CAST((p >= 0.5) = (y = 1) AS DOUBLE)) AS acc FROM prob GROUP BY 1), h AS (SELECT event_type, round(0.45 * (0.5 * (1 - br) + 0.3 * 0.8 + 0.2 * acc) + 0.25 * (1 - br) + 0.20 * (1 - 0.1) + 0.10 * 0.8, 6) AS health FROM b)
SELECT *, CASE WHEN health >= 0.75 THEN 'HEALTHY' WHEN health >= 0.55 THEN 'STABLE' WHEN health >= 0.35 THEN 'DEGRADED' WHEN health >= 0.2 THEN 'POOR' ELSE 'CRITICAL' END AS status FROM h""")
def model_health(spark, d):
    g = probability_rows(spark, d).groupBy("event_type").agg(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2))).alias("br"), F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double")).alias("acc"))
    h = g.select("event_type", stats.health(1 - F.col("br"), F.lit(0.8), F.col("acc"), 1 - F.col("br"), F.lit(0.1)).alias("health"))
    return h.withColumn("status", stats.health_status(F.col("health")))


_PAST = ["g5", "s5", "c5"]


def _learning_rows(spark, d):
    """Team rows with past means and a target of two markets, written once: a fit reads them several times."""
    rows = features.past_features(team_rows(spark, d), ["user_id"], ["ts", "event_id"], {"g5": ("mean", "goals", 5), "s5": ("mean", "shots", 5), "c5": ("mean", "corners", 5)})
    return materialise(rows.select("event_id", "ts", *_PAST, (F.col("goals") > 2).cast("double").alias("target"), (F.col("shots") >= 10).cast("double").alias("many_shots")), "learning-rows")


@query()
def forest_probability(spark, d):
    """Every row's probability by a model that did not see it; past_only is false for the first fold, which has no past."""
    return learning.fold_probabilities(_learning_rows(spark, d), _PAST, "target", "ts").select("event_id", "target", "probability", "fold", "past_only")


@query()
def walk_forward(spark, d):
    """Metrics of two models a market by fold in time."""
    rows, out = _learning_rows(spark, d), None
    for market, target in (("over_25", "target"), ("shots", "many_shots")):
        for kind in ("forest", "boosted"):
            fold = learning.walk_forward(rows, _PAST, target, "ts", kind).withColumn("market", F.lit(market)).withColumn("model", F.lit(kind))
            out = fold if out is None else out.unionByName(fold)
    return out


@query()
def forest_importances(spark, d):
    """Columns by importance in the model of all folds but the last."""
    rows, folds = learning.time_folds(_learning_rows(spark, d), "ts")
    model = learning.train(rows.filter(F.col("fold") < folds[-1]), _PAST, "target")
    return spark.createDataFrame(learning.importances(model, _PAST), "column string, importance double")


@query()
def calibrated_models(spark, d):
    """AUC and Brier score by fold of two models, calibrated and not, and of their ensemble, for two markets."""
    rows, out = _learning_rows(spark, d), None
    for market, target in (("over_25", "target"), ("shots", "many_shots")):
        folds = learning.calibrated_folds(rows, _PAST, target, "ts", trees=8)
        m = learning.fold_metrics(folds, ["forest", "boosted", "calibrated_forest", "calibrated_boosted", "ensemble"], target).withColumn("market", F.lit(market))
        out = m if out is None else out.unionByName(m)
    return out


@query()
def registered_probability(spark, d):
    """Every row's probability by the last registered version of its market's model, of two that were committed."""
    folder = fresh_path(spark, "models")
    rows, folds = learning.time_folds(_learning_rows(spark, d), "ts")
    for upto in folds[1:3]:
        model = learning.train(rows.filter(F.col("fold") < upto), _PAST, "target", trees=8)
        curve = learning.calibrate(learning.score(model, rows.filter(F.col("fold") == upto)), "probability", "target")
        registry_of_models.register(spark, folder, "over_25", model, "forest", _PAST, f"folds before {upto}", curve=curve)
    return registry_of_models.score_registered(rows, folder, "over_25").select("event_id", F.round("probability", 9).alias("probability"), "model_version")
