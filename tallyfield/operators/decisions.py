"""Settlement of markets, scores of candidates, sizing and safety."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.nulls import number

#: Canonical markets.
MARKETS = ["over_05", "over_15", "over_25", "under_25", "btts_yes", "btts_no", "home_win", "draw", "away_win", "corners_over_85", "corners_over_95"]

# Penalties of risk flags; any other flag costs 5.
PENALTIES = {
    "LOW_SAMPLE_SIZE": 25,
    "HIGH_DRAWDOWN": 18,
    "UNSTABLE_ROI": 15,
    "ODDS_RANGE_DEPENDENCY": 10,
    "LEAGUE_DEPENDENCY": 10,
    "NEGATIVE_ROLLING_ROI": 15,
    "POSSIBLE_OVERFITTING": 20,
}


def outcome(market: Column, home: Column, away: Column, corners: Column) -> Column:
    """1 if a market won, 0 if it lost, null if it can't be told."""
    total = home + away
    rules = {
        "over_05": total > 0.5, "over_15": total > 1.5, "over_25": total > 2.5, "under_25": total < 2.5,
        "btts_yes": (home > 0) & (away > 0), "btts_no": (home == 0) | (away == 0),
        "home_win": home > away, "draw": home == away, "away_win": home < away,
        "corners_over_85": corners > 8.5, "corners_over_95": corners > 9.5,
    }
    known = home.isNotNull() & away.isNotNull()
    out = F.lit(None).cast("int")
    for name, won in rules.items():
        ok = corners.isNotNull() if name.startswith("corners") else known
        out = F.when((market == name) & ok, won.cast("int")).otherwise(out)
    return out


def settle_all(matches: DataFrame, home: str, away: str, corners: str, keep: list[str]) -> DataFrame:
    """A row for each match and market that can be settled."""
    d = matches.select(*keep, F.col(home).alias("_h"), F.col(away).alias("_a"), F.col(corners).alias("_c"), F.explode(F.array(*map(F.lit, MARKETS))).alias("market"))
    return d.withColumn("won", outcome(F.col("market"), F.col("_h"), F.col("_a"), F.col("_c"))).filter("won IS NOT NULL").drop("_h", "_a", "_c")


def settlement(kind: Column, home: Column, away: Column, line: Column, pick: Column) -> Column:
    """is_win and the reason for totals, btts and 1x2 bets; an unknown result or kind is null with a reason."""
    total = home + away
    won = (
        F.when(kind == "totals", F.when(pick == "over", total > line).when(pick == "under", total < line))
        .when(kind == "btts", F.when(pick == "yes", (home > 0) & (away > 0)).when(pick == "no", (home == 0) | (away == 0)))
        .when(kind == "1x2", F.when(pick == "home", home > away).when(pick == "draw", home == away).when(pick == "away", home < away))
    )
    reason = F.when(home.isNull() | away.isNull(), "NO_RESULT").when(won.isNull(), "UNKNOWN_BET").otherwise("SETTLED")
    return F.struct(F.when(reason == "SETTLED", won).alias("is_win"), reason.alias("reason"))


def won_from_status(status: Column, flag: Column) -> Column:
    """Win or loss from a status text, else from a yes/no text."""
    s, f = F.upper(F.coalesce(status, F.lit(""))), F.lower(F.coalesce(flag.cast("string"), F.lit("")))
    return F.when(s.isin("WIN", "WON", "SETTLED_WIN"), True).when(s.isin("LOSS", "LOST", "SETTLED_LOSS"), False).when(f.isin("true", "1", "yes"), True).when(f.isin("false", "0", "no"), False)


def market_name(market: Column, selection: Column, line: Column) -> Column:
    """The canonical name of a market as providers write it."""
    m = F.replace(F.replace(F.trim(F.lower(F.coalesce(market, F.lit("")))), F.lit(" "), F.lit("_")), F.lit("goals_"), F.lit(""))
    s = F.trim(F.lower(F.coalesce(selection, F.lit(""))))
    over, under, default = s.contains("over"), s.contains("under"), line.isNull()
    on = lambda x: F.coalesce(line == x, F.lit(False))
    winner = m.isin("1x2", "h2h", "match_winner")
    return (
        F.when(m.isin("over_05", "over05", "o05") | (over & on(0.5)), "over_05")
        .when(m.isin("over_15", "over15", "o15") | (over & on(1.5)), "over_15")
        .when(m.isin("over_25", "over25", "o25", "totals", "goals", "over_2_5") | (over & (on(2.5) | default)), "over_25")
        .when(m.isin("under_25", "under25", "u25", "under_2_5") | (under & (on(2.5) | default)), "under_25")
        .when(m.isin("btts", "btts_yes") & ((s == "") | s.contains("yes") | s.contains("sim")), "btts_yes")
        .when((m == "btts_no") | ((m == "btts") & s.contains("no")), "btts_no")
        .when(m.isin("home_win", "h", "1") | (winner & s.contains("home")), "home_win")
        .when(m.isin("draw", "x") | (winner & s.contains("draw")), "draw")
        .when(m.isin("away_win", "a", "2") | (winner & s.contains("away")), "away_win")
        .when((m == "corners_over_85") | (m.contains("corner") & over & on(8.5)), "corners_over_85")
        .when((m == "corners_over_95") | (m.contains("corner") & over & (on(9.5) | default)), "corners_over_95")
        .otherwise(F.when(m == "", "unknown").otherwise(m))
    )


def penalised(score: Column, flags: Column) -> Column:
    """A score less the penalties of its flags, within 0 and 100, capped for the gravest ones."""
    table = F.create_map(*[F.lit(x) for i in PENALTIES.items() for x in i])
    cost = F.aggregate(F.transform(flags, lambda f: F.coalesce(F.try_element_at(table, f), F.lit(5))), F.lit(0), lambda a, b: a + b)
    x = F.least(F.greatest(score - cost, F.lit(0.0)), F.lit(100.0))
    x = F.when(F.array_contains(flags, "LOW_SAMPLE_SIZE") | F.array_contains(flags, "POSSIBLE_OVERFITTING"), F.least(x, F.lit(59.0))).otherwise(x)
    return F.when(F.array_contains(flags, "HIGH_DRAWDOWN") & F.array_contains(flags, "UNSTABLE_ROI"), F.least(x, F.lit(49.0))).otherwise(x)


def band(score: Column) -> Column:
    return F.when(score >= 80, "HIGH_CONFIDENCE_SIMULATION").when(score >= 60, "MEDIUM_CONFIDENCE_SIMULATION").when(score >= 40, "WATCH_ONLY").otherwise("REJECTED")


def ev_points(ev: Column) -> Column:
    return F.when(ev >= 0.08, 20.0).when(ev >= 0.05, 16.0).when(ev >= 0.03, 12.0).when(ev >= 0.01, 7.0).when(ev > 0, 3.0).otherwise(0.0)


def movement_points(kind: Column, steam: Column) -> Column:
    return F.when(steam, 10.0).when(kind == "SHARP_MOVEMENT", 7.0).when(kind == "LATE_SHARP", 5.0).when(kind == "SIGNIFICANT_MOVEMENT", 3.0).when(kind == "PUBLIC_MONEY", -3.0).otherwise(0.0)


def sample_points(n: Column) -> Column:
    return F.when(n >= 500, 10.0).when(n >= 300, 8.0).when(n >= 100, 4.0).when(n > 0, 1.0).otherwise(0.0)


def decision_score(rule: Column, p_model: Column, p_ensemble: Column, ev: Column, consistency: Column, sample: Column, moved: Column, steam: Column, odds_quality: Column, league_quality: Column, odd: Column, paper: Column, flags: Column) -> Column:
    """0 to 100: rule 25, probability 20, value 20, consistency 15, sample 10, movement 10, quality 8 + 4, paper trading 3, low price -5; then flags."""
    fine = lambda p: F.when((p > 0) & (p <= 1), p)
    both = F.array_compact(F.array(fine(p_model), fine(p_ensemble)))
    mean = F.when(F.size(both) > 0, F.aggregate(both, F.lit(0.0), lambda a, b: a + b) / F.size(both)).otherwise(0.0)
    grade = lambda v, good, fair: F.when(v.rlike(good), 8.0).when(v.rlike(fair), 4.0).otherwise(0.0)
    score = (
        F.when(rule == "KEEP", 25.0).when(rule == "WATCH", 10.0).otherwise(0.0)
        + F.least(F.greatest(mean * 20, F.lit(0.0)), F.lit(20.0))
        + ev_points(ev)
        + F.least(F.greatest(consistency * 0.15, F.lit(0.0)), F.lit(15.0))
        + sample_points(sample)
        + movement_points(moved, steam)
        + grade(odds_quality, "FAVORABLE|POSITIVE", "NEUTRAL")
        + grade(league_quality, "STRONG|HIGH_EDGE|ACCEPTABLE", "NEUTRAL") * 0.5
        - F.when((odd > 0) & (odd < 1.40), 5.0).otherwise(0.0)
        + F.when(paper.isin("HEALTHY", "ACTIVE", "OK"), 3.0).otherwise(0.0)
    )
    return F.round(penalised(score, flags), 2)


def profile_share(p: Column, odd: Column, confidence: Column, sample: Column, n_flags: Column, profile: dict) -> Column:
    """Share of the bankroll by a risk profile: fractional Kelly, capped, halved for each of low confidence, low sample and many flags.

    The day's budget comes after, in order: ``trades.exposure_budget``.
    """
    b = odd - 1
    raw = F.when(odd > 1, F.greatest(F.lit(0.0), (p * b - (1 - p)) / b)).otherwise(0.0)
    x = F.least(F.lit(profile.get("max_stake_pct", 0.02)), raw * profile.get("kelly_fraction", 0.25))
    for bad in (confidence < profile.get("min_confidence", 0.58), sample < profile.get("min_sample_size", 60), n_flags > profile.get("max_risk_flags_allowed", 2)):
        x = F.when(F.coalesce(bad, F.lit(False)), x * 0.5).otherwise(x)
    return F.round(x, 6)


def enforce_safety(candidates: DataFrame, status: str, band_col: str, zero: list[str]) -> DataFrame:
    """Rejected rows can't look actionable: sizes 0, label NO SIGNAL, no action. To be applied last."""
    bad = F.coalesce((F.upper(status) == "REJECTED") | (F.upper(band_col) == "REJECTED"), F.lit(False))
    d = candidates.withColumns({c: F.when(bad, 0.0).otherwise(F.col(c)) for c in zero})
    return d.withColumns(
        {
            status: F.when(bad, "REJECTED").otherwise(F.col(status)),
            band_col: F.when(bad, "REJECTED").otherwise(F.col(band_col)),
            "signal_label": F.when(bad, "NO SIGNAL").otherwise(F.col("signal_label")),
            "action_required": F.when(bad, False).otherwise(F.col("action_required")),
        }
    )


def reject_reasons(tests: dict[str, Column]) -> Column:
    """Names of the tests that fail, in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in tests.items()]))


def refine(totals: DataFrame, least_trades: int = 100, least_roi: float = 0.03, least_factor: float = 1.05, worst_drawdown: float = -60.0) -> DataFrame:
    """Adds reasons and verdict of each strategy: KEEP without a reason, else DISCARD."""
    reasons = reject_reasons({"LOW_TRADES": F.col("trades") >= least_trades, "LOW_ROI": F.col("roi") >= least_roi, "LOW_FACTOR": F.col("profit_factor") >= least_factor, "DRAWDOWN": F.col("max_drawdown") >= worst_drawdown})
    return totals.withColumn("reasons", F.array_join(reasons, "|")).withColumn("verdict", F.when(F.size(reasons) == 0, "KEEP").otherwise("DISCARD"))


def league_grade(trades: Column, roi: Column, factor: Column, least: int, least_roi: float, least_factor: float) -> Column:
    return F.when(trades < least, "DISCARD").when((roi >= least_roi) & (factor >= least_factor), "STRONG").when((roi >= 0) & (factor >= 1), "ACCEPTABLE").when(roi > -0.02, "WEAK").otherwise("DISCARD")


def odds_grade(trades: Column, roi: Column, factor: Column, mean_profit: Column, least: int, least_roi: float, least_factor: float) -> Column:
    return F.when(trades < least, "AVOID").when((roi >= least_roi) & (factor >= least_factor) & (mean_profit > 0), "FAVORABLE").when((roi >= 0) & (factor >= 1), "NEUTRAL").when(roi > -0.03, "RISKY").otherwise("AVOID")


def triggered(df: DataFrame, keep: list[str], rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """A row for each row and rule (name: severity, condition) that holds."""
    made = [F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(name).alias("flag"), F.lit(severity).alias("severity"))) for name, (severity, test) in rules.items()]
    return df.select(*keep, F.inline(F.array_compact(F.array(*made))))


def severity_order(severity: Column) -> Column:
    return F.when(severity == "HIGH", 0).when(severity == "MEDIUM", 1).when(severity == "LOW", 2).otherwise(9)


def research_candidate(p: Column, odds: list[str], quality: str, warnings: str) -> dict[str, Column]:
    """What a prediction is worth looking at by: probability, odds, true_ev, recommendation_type, rule_status, confidence_band and risk_flags.

    A missing probability and price are 0; the first price that is there and
    isn't 0 counts. Without a price above 1 there is no true_ev, and the
    probability alone decides.
    """
    p = F.coalesce(number(p), F.lit(0.0))
    odd = F.coalesce(*[F.when(number(c) != 0, number(c)) for c in odds], F.lit(0.0))
    ev = F.when(odd > 1, F.round(p * odd - 1, 6))
    good = (p >= 0.54) & (ev.isNull() | (ev > -0.05))
    flags = F.array(F.when(F.coalesce(number(quality), F.lit(0.0)) < 0.6, "LOW_DATA_QUALITY"), F.when(F.contains(F.col(warnings), F.lit("LOW_SAMPLE")), "LOW_SAMPLE_SIZE"))
    return {
        "ensemble_probability": p, "odds": odd, "true_ev": ev, "recommendation_type": F.when(good, "SIMULATION_CANDIDATE").otherwise("WATCH_ONLY"), "rule_status": F.when(good, "KEEP").otherwise("WATCH"),
        "confidence_band": F.when(p >= 0.58, "MEDIUM_CONFIDENCE_SIMULATION").otherwise("WATCH_ONLY"), "risk_flags": F.array_join(F.array_compact(flags), " | "),
    }
