"""Tables of others, made into the columns and types that operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.nulls import alias, blank_to_null, number

#: The names that a measure may go by, its own first.
METRICS = {
    "goals_home_ft": ["Goals_H_FT", "goals_h_ft", "home_goals", "goals_home"],
    "goals_away_ft": ["Goals_A_FT", "goals_a_ft", "away_goals", "goals_away"],
    "total_goals_ft": ["TotalGoals_FT", "totalgoals_ft"],
    "goals_home_ht": ["Goals_H_HT", "goals_h_ht"],
    "goals_away_ht": ["Goals_A_HT", "goals_a_ht"],
    "total_goals_ht": ["TotalGoals_HT", "totalgoals_ht"],
    "shots_home": ["Shots_H", "shots_h"],
    "shots_away": ["Shots_A", "shots_a"],
    "shots_on_target_home": ["ShotsOnTarget_H", "shots_on_target_h"],
    "shots_on_target_away": ["ShotsOnTarget_A", "shots_on_target_a"],
    "corners_home": ["Corners_H_FT", "corners_h_ft"],
    "corners_away": ["Corners_A_FT", "corners_a_ft"],
}
#: Columns of a match as its source nests it.
MATCH_JSON = (
    "id string, utcDate string, status string, matchday int, competition struct<name:string,code:string>, season struct<startDate:string>, homeTeam struct<id:string,name:string>, "
    "awayTeam struct<id:string,name:string>, score struct<fullTime:struct<home:int,away:int>,halfTime:struct<home:int,away:int>>"
)


def metric_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds every measure of ``METRICS`` as a double, and names those that no column stands for.

    A total is the sum of both sides only where its whole column is empty; a
    single missing total stays missing. Whether it is empty is asked of the
    table before, which ends at the first value found.
    """
    found = {name: alias(df, name, *others) for name, others in METRICS.items()}
    out = df.withColumns({n: F.lit(None).cast("double") if c is None else number(c) for n, c in found.items()})
    for half in ("ft", "ht"):
        total = f"total_goals_{half}"
        if found[total] is None or out.filter(F.col(total).isNotNull()).isEmpty():
            out = out.withColumn(total, F.col(f"goals_home_{half}") + F.col(f"goals_away_{half}"))
    return out, [n for n, c in found.items() if c is None]


def _truth(x: Column) -> Column:
    """Text as a yes or no: empty text and null, 0, false and no are no."""
    text = F.lower(blank_to_null(x))
    return F.coalesce(~(text.isin("false", "no", "f", "n") | F.coalesce(text.try_cast("double") == 0, F.lit(False))), F.lit(False))


def load_trades(df: DataFrame) -> DataFrame:
    """A log of trades with its types: date a timestamp, is_win a boolean, profit, stake and odd doubles.

    What doesn't parse is null, but a profit is 0 then and a stake 1, also
    where the column is absent; an absent odd is a column of nulls. All other
    columns stay. An empty log gives an empty one with these columns.
    """
    have = set(df.columns)
    of = lambda c: number(c) if c in have else F.lit(None).cast("double")
    typed = {"profit": F.coalesce(of("profit"), F.lit(0.0)), "stake": F.coalesce(of("stake"), F.lit(1.0)), "odd": of("odd")}
    if "date" in have:
        typed["date"] = F.col("date").try_cast("timestamp")
    if "is_win" in have:
        typed["is_win"] = F.col("is_win") if dict(df.dtypes)["is_win"] == "boolean" else _truth(F.col("is_win"))
    return df.withColumns(typed)


def match_columns(df: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """Matches nested as JSON in a column, flat, with totals, both-scored, over lines and result where both full-time goals are there.

    What doesn't parse gives nulls; a match without a competition code has an
    empty one.
    """
    d = df.select(*keep, F.from_json(json, MATCH_JSON).alias("_m"))
    at = lambda path: F.col(f"_m.{path}")
    home, away = at("score.fullTime.home"), at("score.fullTime.away")
    total = home + away
    return d.select(
        *keep, at("id").alias("match_id"), at("utcDate").alias("date"), at("competition.name").alias("league"), F.coalesce(at("competition.code"), F.lit("")).alias("competition_code"),
        at("homeTeam.name").alias("home_team"), at("awayTeam.name").alias("away_team"), at("homeTeam.id").alias("home_team_id"), at("awayTeam.id").alias("away_team_id"),
        home.alias("goals_home_ft"), away.alias("goals_away_ft"), at("score.halfTime.home").alias("goals_home_ht"), at("score.halfTime.away").alias("goals_away_ht"),
        at("status").alias("match_status"), at("matchday").alias("matchday"), at("season.startDate").alias("season"), total.alias("total_goals_ft"), ((home > 0) & (away > 0)).alias("btts"),
        *[(total > n).alias(f"over_{n}_5") for n in (1, 2, 3)], F.when(home > away, "H").when(away > home, "A").when(home == away, "D").alias("result"),
    )
