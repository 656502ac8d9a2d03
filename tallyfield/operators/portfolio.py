"""Stakes of a day's candidates that grow the bankroll most, within limits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Correlations of markets of one match (names in order), and that of all others, a market with itself too.
CORRELATIONS = {("btts", "goals"): 0.72, ("corners", "goals"): 0.35, ("goals", "shots"): 0.45, ("btts", "corners"): 0.28, ("btts", "shots"): 0.38, ("corners", "shots"): 0.40}
OTHER = 0.15


def correlation_matrix(markets: list[str], known: dict[tuple[str, str], float] = CORRELATIONS, other: float = OTHER) -> np.ndarray:
    """Correlation of each two bets by their markets; 0 on the diagonal, which no sum needs."""
    out = np.array([[known.get(tuple(sorted((a.lower(), b.lower()))), other) for b in markets] for a in markets], float).reshape(len(markets), len(markets))
    np.fill_diagonal(out, 0.0)
    return out


def growth(stakes: np.ndarray, values: np.ndarray, correlation: np.ndarray) -> float:
    """What is maximised: each stake by its value, less half of what it shares with the other stakes."""
    return float(stakes @ values - 0.5 * stakes @ correlation @ (stakes * values))


def within_limits(x: np.ndarray, most_each: float, most: float) -> np.ndarray:
    """The nearest point with every stake in [0, ``most_each``] and a total of at most ``most``, by halving."""
    held = np.clip(x, 0, most_each)
    if held.sum() <= most:
        return held
    low, high = 0.0, float(x.max())
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if np.clip(x - mid, 0, most_each).sum() > most else (low, mid)
    return np.clip(x - high, 0, most_each)


def best_stakes(values: np.ndarray, correlation: np.ndarray, most_each: float, most: float, rounds: int = 200) -> np.ndarray:
    """Stakes by projected gradient ascent: a step up the gradient, then back to the limits, a fixed number of rounds.

    Starts from the larger of half the limit or the value, and from the best
    values filled up to the limits, and keeps the better end.
    """
    curve = 0.5 * (correlation * values[None, :] + correlation.T * values[:, None])
    step = 1 / max(float(np.abs(curve).sum(1).max(initial=0)), 1e-6)
    filled, left = np.zeros(len(values)), most
    for i in np.argsort(-values, kind="stable"):
        filled[i] = min(most_each, left) if values[i] > 0 else 0.0
        left -= filled[i]
    ends = []
    for s in (within_limits(np.minimum(most_each / 2, values), most_each, most), filled):
        for _ in range(rounds):
            after = within_limits(s + step * (values - curve @ s), most_each, most)
            if np.array_equal(after, s):
                break
            s = after
        ends.append(s)
    return max([*ends, filled], key=lambda s: growth(s, values, correlation))


def optimal_shares(candidates: DataFrame, group: str, key: str, market: str, share: str, most_each: float = 0.05, most: float = 0.15, rounds: int = 200) -> DataFrame:
    """Adds portfolio_share and method to candidates: what each of a group (a day) is best given, by ``share``, its fractional Kelly share.

    A lone candidate gets its share, at most ``most_each`` (single_kelly).
    Of several, the stakes are optimised. Of bets on one market a better one
    is never given less: moving a stake to it raises the growth as long as
    limits allow, so of each market only the best ``most`` / ``most_each``
    (ties: the smaller key) can get anything, and only these meet in a task,
    however many candidates a day has. Null shares count as 0; every row comes
    back. ``key`` is unique in a group; the rows' own names are kept.
    """
    d = candidates.withColumn("_value", F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(0.0)))
    reach = math.ceil(round(most / most_each, 9))
    best = Window.partitionBy(group, market).orderBy(F.desc("_value"), key)
    few = d.select(group, key, F.coalesce(F.col(market).cast("string"), F.lit("")).alias("_market"), "_value", F.row_number().over(best).alias("_n")).filter(F.col("_n") <= reach).drop("_n")
    few = few.join(d.groupBy(group).agg(F.count("*").alias("_size")), group)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_key")
        values = pdf["_value"].to_numpy(float)
        if pdf["_size"].iat[0] == 1:
            return pd.DataFrame({"_group": pdf["_group"], "_key": pdf["_key"], "_stake": np.minimum(values, most_each), "_how": "single_kelly"})
        stakes = best_stakes(values, correlation_matrix(pdf["_market"].tolist()), most_each, most, rounds)
        return pd.DataFrame({"_group": pdf["_group"], "_key": pdf["_key"], "_stake": stakes, "_how": "optimised"})

    text = few.select(F.col(group).cast("string").alias("_group"), F.col(key).cast("string").alias("_key"), "_market", "_value", "_size")
    found = text.groupBy("_group").applyInPandas(solve, "_group string, _key string, _stake double, _how string")
    d = d.join(found, (F.col(group).cast("string") == F.col("_group")) & (F.col(key).cast("string") == F.col("_key")), "left")
    return d.withColumn("portfolio_share", F.round(F.coalesce("_stake", F.lit(0.0)), 4)).withColumn("method", F.coalesce("_how", F.lit("optimised"))).drop("_value", "_group", "_key", "_stake", "_how")
