"""Verdicts on markets, suggestions, risk reports, alerts and rolled-up states, as columns and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.nulls import clamp, sigmoid

#: Flags that stand for each kind of risk.
DEPENDENCY = ["LEAGUE_DEPENDENCY", "ODDS_RANGE_DEPENDENCY"]
INSTABILITY = ["UNSTABLE_ROI", "NEGATIVE_ROLLING_ROI"]


def market_verdict(trades: Column, roi: Column, factor: Column, drawdown: Column, least: int = 100, least_roi: float = 0.03, least_factor: float = 1.05, worst: float = -60.0) -> tuple[Column, Column]:
    """KEEP, WATCH or DISCARD, and the reasons joined by "|"."""
    tests = {"LOW_SAMPLE": trades < least, "NEGATIVE_ROI": roi < 0, "PROFIT_FACTOR_BELOW_1": factor < 1, "HIGH_DRAWDOWN": drawdown < worst}
    against = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()]))
    keep = (F.size(against) == 0) & (roi >= least_roi) & (factor >= least_factor)
    watch = (trades >= least) & (roi >= 0) & (factor >= 1)
    verdict = F.when(keep, "KEEP").when(watch, "WATCH").otherwise("DISCARD")
    note = F.when(keep, F.array(F.lit("MEETS_CRITERIA"))).when(watch, F.array(F.lit("POSITIVE_NOT_STRONG"))).otherwise(F.array().cast("array<string>"))
    return verdict, F.array_join(F.concat(against, note), "|")


def suggestions(odds: DataFrame, leagues: DataFrame, consistency: DataFrame, least: int = 50, best: int = 5) -> DataFrame:
    """Filters worth a look: favourable odds ranges and strong leagues of a market, and the most consistent strategies; each once."""
    risk = F.when(F.col("trades") < 100, "MEDIUM").otherwise("LOW")
    of_market = lambda df, grade, text: df.filter(F.col("grade") == grade).select(F.lit("ANY").alias("strategy"), "market", text.alias("suggestion"), risk.alias("risk"), "trades")
    top = consistency.orderBy(F.desc("score"), F.desc("trades"), "strategy", "market").limit(best)
    top = top.select("strategy", "market", F.lit("manual_review_required").alias("suggestion"), F.when(F.col("trades") < least, "HIGH").otherwise("MEDIUM").alias("risk"), "trades")
    parts = [of_market(odds, "FAVORABLE", F.concat(F.lit("odds_range="), "odds_range")), of_market(leagues, "STRONG", F.concat(F.lit("league="), "league")), top]
    return reduce(DataFrame.unionByName, parts).distinct()


def sample_class(trades: Column) -> Column:
    return F.when(trades < 50, "LOW_SAMPLE").when(trades < 100, "ACCEPTABLE_SAMPLE").otherwise("STRONG_SAMPLE")


def risk_report(strategies: DataFrame, flags: DataFrame, key: list[str], own: str = "risk_flags") -> DataFrame:
    """Flags of a strategy from its rows in ``flags`` and its own list, each once and in order, and what they amount to; a small sample overrules KEEP."""
    found = flags.groupBy(*key).agg(F.collect_set("flag").alias("_found"))
    d = strategies.join(found, key, "left")
    listed = F.filter(F.split(F.coalesce(F.col(own), F.lit("")), r"\|"), lambda x: x != "")
    d = d.withColumn("_all", F.sort_array(F.array_union(F.coalesce("_found", F.array().cast("array<string>")), listed)))
    has = lambda names: F.when(F.arrays_overlap("_all", F.array(*map(F.lit, names))), "HIGH").otherwise("LOW")
    status = sample_class(F.col("trades"))
    return d.select(
        *key, F.array_join("_all", "|").alias("risk_flags"), status.alias("sample_status"), has(DEPENDENCY).alias("dependency_risk"), has(INSTABILITY).alias("temporal_instability"),
        F.when((status == "LOW_SAMPLE") & (F.col("verdict") == "KEEP"), "DISCARD").otherwise(F.col("verdict")).alias("recommendation"),
    )


def explanations(rules: list[tuple[Column, str]]) -> Column:
    """Texts of the rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(text)) for test, text in rules]))


def rolled_up(ok: Column, total: Column) -> Column:
    """SUCCESS, PARTIAL or FAILED, of how many of how many went well."""
    return F.when(ok == total, "SUCCESS").when(ok > 0, "PARTIAL").otherwise("FAILED")


def edge_advice(deteriorating: Column, skill: Column, n: Column) -> Column:
    """What to do about an edge, by sample, trend and skill. The words are fixed values."""
    return (
        F.when(n < 50, "COLETAR_MAIS_DADOS").when(deteriorating, "REDUZIR_STAKES").when(skill.isNull(), "AGUARDAR_CLV")
        .when(skill > 0.04, "CONTINUAR").when(skill > 0.01, "MONITORAR").when(skill > -0.01, "AVALIAR").otherwise("PAUSAR")
    )


#: What each model adds to the shared probability, and the weights of its inputs (input: centre, weight).
OFFSETS = {"random_forest": -0.018, "lightgbm": 0.0, "xgboost": 0.016}
PROXY = {"expected_goals": (1.0, 0.55), "attack": (1.2, 0.12), "weakness": (1.1, 0.10), "form": (0.5, 0.15), "quality": (0.6, 0.10), "rate": (0.5, 0.75)}


def proxy_probabilities(inputs: dict[str, Column], odd: Column) -> dict[str, Column]:
    """A probability by model from past features: a sigmoid of weighted distances from usual values, and the price's share."""
    base = sum(((F.coalesce(inputs[k], F.lit(centre)) - centre) * weight for k, (centre, weight) in PROXY.items()), F.lit(0.0))
    base = base + (0.5 - F.when(F.coalesce(odd, F.lit(2.0)) > 1, 1 / F.coalesce(odd, F.lit(2.0))).otherwise(0.5)) * 0.12
    return {m: F.round(clamp(sigmoid(base) + off, 0.08, 0.92), 6) for m, off in OFFSETS.items()}


def ensemble(probabilities: list[Column], quality: Column) -> dict[str, Column]:
    """Mean, agreement, entropy, stability and confidence of several models' probabilities."""
    n, spread = len(probabilities), F.greatest(*probabilities) - F.least(*probabilities)
    mean = F.round(sum(probabilities[1:], probabilities[0]) / n, 6)
    agreement = F.round(1 - spread, 6)
    q = F.round(quality * agreement, 6)
    entropies = [-(p * F.ln(p) + (1 - p) * F.ln(1 - p)) for p in probabilities]
    return {
        "ensemble": mean, "agreement": agreement, "entropy": F.round(sum(entropies[1:], entropies[0]) / n, 6), "stability": F.round(clamp(1 - spread * 2.5, 0.0, 1.0), 6),
        "quality": q, "confidence": F.round(clamp((F.abs(mean - 0.5) * 1.8 + agreement * 0.45 + q * 0.35) / 1.8, 0.0, 1.0), 6),
    }


def classification(df: DataFrame, group: list[str], p: str, y: str, cut: float = 0.5) -> DataFrame:
    """Accuracy, precision and recall at a cut; 0 where nothing is predicted or there."""
    said, true = F.col(p) >= cut, F.col(y) == 1
    count = lambda c: F.sum(c.cast("double"))
    part = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    hit = count(said & true)
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.round(F.avg((said == true).cast("double")), 6).alias("accuracy"), part(hit, count(said)).alias("precision"), part(hit, count(true)).alias("recall"))


def best_models(metrics: DataFrame, group: list[str], model: str) -> DataFrame:
    """The model with the highest mean AUC over folds, or, without AUC, 1 - Brier; ties to the smaller name."""
    means = metrics.groupBy(*group, model).agg(F.avg("auc").alias("auc"), F.avg("brier").alias("brier"), F.count("*").alias("folds"))
    score = F.coalesce(F.col("auc"), 1 - F.col("brier"), F.lit(0.0))
    best = means.withColumn("score", F.round(score, 6)).groupBy(*group).agg(F.min_by(F.struct(model, "score", "folds"), F.struct(-F.col("score"), F.col(model))).alias("b"))
    return best.select(*group, "b.*")
