"""Regime, uncertainty and projected scenarios of groups of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How exposure and risk change by scenario, and how likely what is.
SCENARIOS = {"defensive": (0.55, 0.7), "balanced": (1.0, 1.0), "aggressive": (1.45, 1.25)}
ADVICE = {"defensive": "preferir este regime", "aggressive": "usar apenas com validação paper"}
BASELINE = "baseline operacional"
REAL = "real_data"


def regime(state: Column, ev: Column, risk: Column, critical: Column) -> Column:
    """diagnostic without real data; else defensive, aggressive, conservative or balanced. Missing numbers are 0."""
    ev, risk, critical = (F.coalesce(x, F.lit(0)) for x in (ev, risk, critical))
    real = F.coalesce(state == REAL, F.lit(False))
    return F.when(~real, "diagnostic").when((critical >= 2) | (risk >= 65) | (ev < -1), "defensive").when((ev > 2) & (risk < 45), "aggressive").when(risk >= 50, "conservative").otherwise("balanced")


def uncertainty(state: Column, sample: Column, alerts: Column) -> Column:
    """0.18 with real data and 0.62 without, more for samples below 100 and 30 and for each alert; 0.95 at most."""
    sample, alerts = F.coalesce(sample, F.lit(0)), F.coalesce(alerts, F.lit(0))
    base = F.when(F.coalesce(state == REAL, F.lit(False)), 0.18).otherwise(0.62)
    return F.least(F.lit(0.95), base + F.when(sample < 30, 0.22).when(sample < 100, 0.1).otherwise(0.0) + F.least(F.lit(0.24), alerts * F.lit(0.035)))


def reasoning(x: Column) -> dict[str, Column]:
    """What an uncertainty means: score, level, robustness, and how likely low, medium and high confidence and three cases are."""
    r = lambda c: F.round(c, 3)
    sure = 1 - x
    return {
        "uncertainty_score": r(x), "ambiguity_level": F.when(x > 0.65, "high").when(x > 0.38, "medium").otherwise("low"), "robustness_score": r(sure),
        "p_low": r(F.greatest(F.lit(0.0), sure) * 0.45), "p_medium": F.lit(0.35), "p_high": r(x * 0.65),
        "p_base_case": r(F.greatest(F.lit(0.1), sure)), "p_stress_case": r(F.least(F.lit(0.8), x)), "p_recovery_case": r(F.greatest(F.lit(0.05), 0.45 - x / 3)),
    }


def scenarios(buckets: DataFrame, ev: str, group: list[str]) -> DataFrame:
    """For each group of buckets three projections of its mean expected value: name, projected_ev_pct, volatility_proxy, risk_score, recommendation.

    Volatility is the population's deviation of the buckets, null for a single
    one. Groups without any expected value give no row. Means and deviations
    are partial aggregates, so a group of any size is no task of its own.
    """
    known = buckets.filter(F.col(ev).isNotNull()).groupBy(*group).agg(F.avg(ev).alias("_ev"), F.when(F.count(ev) > 1, F.stddev_pop(ev)).alias("_spread"))
    made = []
    for name, (risk, exposure) in SCENARIOS.items():
        projected = F.col("_ev") * exposure
        score = F.coalesce(F.col("_spread"), F.lit(0.0)) * risk + F.greatest(F.lit(0.0), -projected) * 2
        advice = F.when(score > 20, ADVICE[name]).otherwise(BASELINE) if name == "defensive" else F.lit(ADVICE.get(name, BASELINE))
        made.append(F.struct(F.lit(name).alias("name"), F.round(projected, 3).alias("projected_ev_pct"), F.round(F.col("_spread") * risk, 3).alias("volatility_proxy"), F.round(score, 3).alias("risk_score"), advice.alias("recommendation")))
    return known.select(*group, F.inline(F.array(*made)))


#: Names of what speaks for or against a signal: its column (less another), its effect, and whether it is a share.
FACTORS = {
    "Probabilidade ML": ("ml_probability", None, "positive", True),
    "Valor esperado": ("true_ev", None, "positive", True),
    "Odds vs prob. implícita": ("ml_probability", "implied_probability", "positive", True),
    "Risco operacional": ("risk_score", None, "negative", False),
    "Kelly recomendado": ("kelly_stake_pct", None, "neutral", True),
}


def factor_breakdown(candidates: DataFrame, group: list[str], score: str, key: str) -> DataFrame:
    """For each group its signal of the highest score, ties to the smaller key, as rows: key, score, name, value, impact.

    Shares are in percent; factors without a value, or whose columns the table
    lacks, are left out, and so are rows without a score. The best is a partial
    aggregate, so no group is sorted.
    """
    known = candidates.filter(F.col(score).isNotNull())
    columns = [c for c in dict.fromkeys(x for a, b, _, _ in FACTORS.values() for x in (a, b) if x) if c in candidates.columns]
    first = F.min_by(F.struct(key, score, *columns), F.struct((-F.col(score)).alias("s"), F.col(key).alias("k")))
    best = known.groupBy(*group).agg(first.alias("_best"))
    made = []
    for name, (a, b, impact, share) in FACTORS.items():
        if a in columns and (b is None or b in columns):
            x = F.col(f"_best.{a}") - F.col(f"_best.{b}") if b else F.col(f"_best.{a}")
            value = F.round(x * 100 if share else x, 2)
            made.append(F.when(value.isNotNull(), F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), F.lit(impact).alias("impact"))))
    return best.select(*group, F.col(f"_best.{key}").alias(key), F.col(f"_best.{score}").alias(score), F.inline(F.array_compact(F.array(*made))))
