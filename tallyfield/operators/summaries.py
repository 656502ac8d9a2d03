"""What a table of matches, team rows or trades holds, in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions import scan

#: Columns that are no features, and how names of advanced features begin.
TECHNICAL = ["event_id", "match_key", "date", "league", "season", "source_file", "source_layer", "team_key", "team_name", "opponent_key", "opponent_name", "side", "result_ft", "result_ht"]
ADVANCED = [
    "win_streak", "loss_streak", "unbeaten_streak", "points_last_5", "points_trend", "goals_std", "shots_std", "corners_std", "goals_vs_", "shots_vs_", "corners_vs_", "goals_per_",
    "shots_on_target_ratio", "pressure_", "home_", "away_", "attack_vs_", "team_attack", "opponent_defense", "goal_trend", "expected_goals_proxy", "corners_trend", "high_", "low_conversion",
]
#: Words for the size of a sample, the next step and what to do about a backtest.
WEAK, MIDDLE, STRONG = "fraca", "média", "forte"
NEXT_STEP, LAST_STEP = "Backtest por time + liga antes de alimentar produção ML.", "ML pode usar backtest como camada de validação."
MORE_TRADES = "Aumentar amostra antes de confiar em ROI por estratégia."
BY_LEAGUE = "Separar backtest por liga para reduzir viés de campeonato."
BY_TEAM = "Criar thresholds por time usando forma recente, liga e mercado."
BY_MARKET = "Comparar mercados separadamente: gols, escanteios, BTTS e chutes não devem compartilhar a mesma regra."


def features(df: DataFrame) -> list[str]:
    """Columns that aren't technical."""
    return [c for c in df.columns if c not in TECHNICAL]


def advanced_features(df: DataFrame) -> list[str]:
    """Columns named as advanced features are."""
    return [c for c in df.columns if c.startswith(tuple(ADVANCED))]


def counted(df: DataFrame, kinds: dict[str, list[str]], date: str | None = None) -> DataFrame:
    """One row: total_rows, first_date, last_date, and for each kind how many different values its columns have together.

    The table is read once. Each row gives its values as (kind, value), which
    are made different by one shuffle after a partial aggregate, so neither a
    kind with many values nor a frequent value is one task. Columns that the
    table doesn't have count as empty, nulls don't count, and a date that
    doesn't parse is no date.
    """
    day = F.to_date(F.col(date).try_cast("timestamp")) if date in df.columns else F.lit(None).cast("date")
    pairs = [("", F.lit(None).cast("string"))] + [(k, F.col(c).cast("string")) for k, columns in kinds.items() for c in columns if c in df.columns]
    stacked = df.select(day.alias("day"), F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in pairs]))).filter("kind = '' OR value IS NOT NULL")
    values = stacked.groupBy("kind", "value").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))
    number = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(f"total_{k}")
    rows = F.coalesce(F.sum(F.when(F.col("kind") == "", F.col("n"))), F.lit(0)).alias("total_rows")
    return values.agg(rows, *[number(k) for k in kinds], F.min("first").alias("first_date"), F.max("last").alias("last_date"))


def dataset_summary(df: DataFrame, teams: list[str], league: str = "league", date: str = "date") -> DataFrame:
    """One row: rows, leagues, teams (over all of ``teams`` together), dates, columns, features and advanced features. Empty tables have 0 of each and no dates."""
    d = counted(df, {"leagues": [league], "teams": teams}, date)
    return d.withColumns({"columns": F.lit(len(df.columns)), "features_count": F.lit(len(features(df))), "advanced_features_count": F.lit(len(advanced_features(df)))})


def backtest_health(trades: DataFrame, league: str = "league", team: str = "team_key", market: str = "market") -> DataFrame:
    """One row: trades, leagues, teams and markets, how large a sample that is, whether models may use it, and what to do next."""
    d = counted(trades, {"leagues": [league], "teams": [team], "markets": [market]})
    n = F.col("total_rows")
    advice: list[tuple[Column, str]] = [(n < 100, MORE_TRADES), (F.col("total_leagues") <= 1, BY_LEAGUE), (F.col("total_teams") > 0, BY_TEAM), (F.col("total_markets") > 1, BY_MARKET)]
    return d.select(
        n.alias("total_trades"), F.col("total_leagues").alias("league_count"), F.col("total_teams").alias("team_count"), F.col("total_markets").alias("market_count"),
        F.when(n < 100, WEAK).when(n < 1000, MIDDLE).otherwise(STRONG).alias("sample_level"), ((n >= 100) & (F.col("total_leagues") >= 2)).alias("is_ready_for_ml"),
        F.when(n < 1000, NEXT_STEP).otherwise(LAST_STEP).alias("recommended_next_step"), F.array_compact(F.array(*[F.when(c, text) for c, text in advice])).alias("recommendations"),
    )


def percent_drawdown(d: DataFrame, group: list[str], value: str) -> DataFrame:
    """Adds peak, the highest value so far, and drawdown_pct, how far below it in percent of it; 0 where the peak is 0.

    ``d`` comes from ``scan.numbered``: a group of any size lies in blocks, and
    only each block's highest value is handed on. Null values are no part of
    the curve and have no drawdown.
    """
    carried = scan.with_carry(d, group, {"_top": F.max(value)}, {"_before": (F.col("_top"), "max")})
    peak = F.greatest(F.col("_before"), F.max(value).over(scan.inside(group)))
    out = carried.withColumn("peak", peak).drop("_before")
    return out.withColumn("drawdown_pct", F.when(F.col(value).isNull(), None).when(F.col("peak") == 0, 0.0).otherwise((F.col(value) - F.col("peak")) / F.col("peak") * 100))


def curve_risk(d: DataFrame, group: list[str]) -> DataFrame:
    """For each group of ``percent_drawdown``'s rows: how many points the curve has and the worst drawdown, to 2 places."""
    return d.groupBy(*group).agg(F.count("drawdown_pct").alias("points"), F.round(F.min("drawdown_pct"), 2).alias("max_drawdown"))


def active_signals(signals: DataFrame, status: str = "status") -> DataFrame:
    """Pending signals, with those of the columns a holder needs that the table has; none where there is no status."""
    wanted = ["signal_id", "signal_date", "expected_resolution_date", "strategy", "market", "stake", "odd"]
    pending = F.upper(F.col(status).cast("string")) == "PENDING" if status in signals.columns else F.lit(False)
    return signals.filter(pending).select(*[c for c in wanted if c in signals.columns])

