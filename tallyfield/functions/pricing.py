"""Odds arithmetic: margins, expected value, Kelly stakes, closing-line value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfield.functions.nulls import clamp, safe_divide


def fair_multiplicative(odds: list[Column]) -> list[Column]:
    """Probabilities 1/o scaled to sum to 1; equal ones if any price is 1 or less or null."""
    good = F.lit(True)
    for o in odds:
        good = good & F.coalesce(o > 1, F.lit(False))
    total = sum((safe_divide(F.lit(1), o) for o in odds), F.lit(0.0))
    return [F.when(good, safe_divide(F.lit(1), o) / total).otherwise(1.0 / len(odds)) for o in odds]


def fair_additive(odds: list[Column], least: float = 0.001) -> list[Column]:
    """Probabilities 1/o less an equal share of the margin, ``least`` at least, scaled to sum to 1."""
    good = F.lit(True)
    for o in odds:
        good = good & F.coalesce(o > 1, F.lit(False))
    implied = [safe_divide(F.lit(1), o) for o in odds]
    margin = (sum(implied, F.lit(0.0)) - 1) / len(odds)
    cut = [F.greatest(p - margin, F.lit(least)) for p in implied]
    total = sum(cut, F.lit(0.0))
    return [F.when(good, c / total).otherwise(1.0 / len(odds)) for c in cut]


def fair_probability(odd: Column, opposite: Column) -> Column:
    """Of a price against its opposite; without one the implied probability less a twentieth."""
    return F.when(F.coalesce(opposite > 1, F.lit(False)), (1 / odd) / (1 / odd + 1 / opposite)).otherwise((1 / odd) * 0.95)


def expected_values(p: Column, odd: Column, opposite: Column, value_edge: float = 0.02) -> dict[str, Column]:
    """fair, edge, true_ev, naive_ev, vig and is_value; null without a probability or a price above 1."""
    ok = p.isNotNull() & (odd > 1)
    fair = fair_probability(odd, opposite)
    cols = {
        "fair": fair,
        "edge": p - fair,
        "true_ev": (p - fair) * (odd - 1),
        "naive_ev": p * odd - 1,
        "vig": F.when(opposite > 1, 1 / odd + 1 / opposite - 1),
    }
    out = {k: F.when(ok, v) for k, v in cols.items()}
    out["is_value"] = F.coalesce(out["edge"] > value_edge, F.lit(False))
    return out


def ev_grade(ev: Column, edge: Column) -> Column:
    """Five levels of value, by edge and expected value; UNKNOWN without either."""
    return (
        F.when(ev.isNull() | edge.isNull(), "UNKNOWN")
        .when((edge > 0.08) & (ev > 0.05), "PREMIUM_VALUE")
        .when((edge > 0.05) & (ev > 0.03), "HIGH_VALUE")
        .when((edge > 0.02) & (ev > 0.01), "VALUE")
        .when(edge > 0, "MARGINAL")
        .otherwise("NO_VALUE")
    )


def kelly(p: Column, odd: Column, fraction: Column | float = 0.25, least: float = 0.005, most: float = 0.05) -> Column:
    """Fractional Kelly stake as a share of the bankroll: 0 without an edge, else within [least, most]."""
    b = odd - 1
    full = (b * p - (1 - p)) / b
    ok = (p > 0) & (p < 1) & (odd > 1)
    return F.when(F.coalesce(ok, F.lit(False)), F.when(full > 0, F.round(clamp(full * fraction, least, most), 4)).otherwise(0.0)).otherwise(0.0)


def kelly_multiplier(drawdown: Column, recent_clv: Column, confidence: Column) -> Column:
    """What Kelly stakes are multiplied by: less in a drawdown, on a falling closing-line value, without confidence."""
    by_drawdown = F.when(drawdown >= 0.25, 0.0).when(drawdown > 0.19, 0.25).when(drawdown > 0.09, 0.5).otherwise(1.0)
    return by_drawdown * F.when(recent_clv < -0.02, 0.5).otherwise(1.0) * F.when(confidence < 0.55, 0.75).otherwise(1.0)


def clv(entry: Column, closing: Column) -> Column:
    """Closing-line value: entry / closing - 1; null unless both exceed 1."""
    return F.when((entry > 1) & (closing > 1), entry / closing - 1)


def clv_category(x: Column) -> Column:
    """Six levels of closing-line value; null stays null."""
    levels = [(0.08, "EXCELLENT"), (0.04, "GOOD"), (0.01, "MARGINAL"), (-0.01, "NEUTRAL"), (-0.05, "BAD")]
    out = F.when(x.isNull(), None)
    for least, name in levels:
        out = out.when(x >= least, name)
    return out.otherwise("TERRIBLE")


def settle_profit(won: Column, stake: Column, odd: Column) -> Column:
    """stake * (odd - 1) if won, -stake if lost, null if unknown."""
    return F.round(F.when(won.isNull(), None).when(won, stake * (odd - 1)).otherwise(-stake), 4)
