"""Match histories by league, configurations of leagues, and tables brought to the columns that all have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.nulls import blank_to_null

#: The columns of a match table, and states of sources.
MATCH_COLUMNS = [
    "provider", "source", "is_demo_data", "flashscore_match_id", "match_id", "league", "season", "match_date", "kickoff_time", "home_team", "away_team", "status",
    "goals_home_ft", "goals_away_ft", "goals_home_ht", "goals_away_ht", "corners_home", "corners_away", "shots_home", "shots_away", "shots_on_target_home", "shots_on_target_away",
    "xg_home", "xg_away", "goal_minutes_home", "goal_minutes_away", "odds_home", "odds_draw", "odds_away", "odds_over_05", "odds_under_05", "odds_over_15", "odds_under_15", "odds_over_25", "odds_under_25",
    "odds_btts_yes", "odds_btts_no", "provider_warnings", "data_quality_score", "canonical_home_team_id", "canonical_away_team_id", "canonical_league_id",
    "match_identity_key", "mapping_confidence", "identity_confidence", "duplicate_status", "conflict_flags", "final_data_quality_score",
]
READY = {("ENGINE_READY", "FUTURE_GAMES_READY"): "READY", ("ENGINE_MISSING", None): "ENGINE_MISSING", ("ENGINE_FOUND_OUTPUTS_EMPTY", None): "ENGINE_OUTPUTS_EMPTY"}
PARTIAL = "PARTIAL_READY"
_LEAGUE = "array<struct<league_slug:string,slug:string,name:string,league_name:string,country:string,season:string,enabled:boolean,priority:int,canonical_league_id:string>>"


def complete_columns(df: DataFrame, columns: list[str] | None = None, key: str = "match_id", other: str = "flashscore_match_id") -> DataFrame:
    """Adds the columns that are absent, as text without values; a missing ``key`` is filled from ``other``."""
    out = df.withColumns({c: F.lit(None).cast("string") for c in columns or MATCH_COLUMNS if c not in df.columns})
    if key in out.columns and other in out.columns:
        out = out.withColumn(key, F.coalesce(F.col(key).cast("string"), F.col(other).cast("string")))
    return out


def write_history(matches: DataFrame, root: str) -> DataFrame:
    """Finished matches of several leagues: written apart by competition_code, and together in the order of their dates; returns the latter.

    Dates are read as times, what doesn't parse is null and comes first.
    Matches without a code are in one of their own. The rows are dealt to
    files by ranges of league and date, so a league with most of them has many.
    """
    spark = matches.sparkSession
    done = matches.filter("match_status = 'FINISHED'").withColumn("date", F.col("date").try_cast("timestamp"))
    done.repartitionByRange("competition_code", "date", "match_id").write.mode("overwrite").partitionBy("competition_code").parquet(f"{root}/leagues")
    done.orderBy("date", "match_id").write.mode("overwrite").parquet(f"{root}/all")
    return spark.read.parquet(f"{root}/all")


def league_configs(files: DataFrame, path: str, text: str, country: str | None = None, season: str | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Enabled leagues of configuration files, and a warning for each file that holds no list of them.

    A file is a list of leagues, or has one under "leagues". A slug and a name
    stand for each other; a season is "2023+" and a priority 1 where absent,
    and a league without the field is enabled. ``country`` is compared without
    case. ``most`` keeps that many by path and place in the file, as trial
    runs do.
    """
    t = F.trim(F.col(text))
    listed = F.when(F.startswith(t, F.lit("[")), F.from_json(t, _LEAGUE)).otherwise(F.from_json(t, f"leagues {_LEAGUE}")["leagues"])
    whole = files.select(F.col(path).alias("path"), listed.alias("_all"))
    bad = whole.filter("_all IS NULL").select("path", F.concat(F.lit("invalid_leagues_payload:"), F.element_at(F.split("path", "/"), -1)).alias("warning"))
    d = whole.select("path", F.posexplode("_all").alias("place", "l")).filter("l IS NOT NULL").select("path", "place", "l.*")
    full = lambda *c: F.coalesce(*[blank_to_null(x) for x in c])
    rows = d.filter(F.coalesce("enabled", F.lit(True))).select(
        "path", "place", F.coalesce(full("league_slug", "slug", "name"), F.lit("unknown")).alias("league_slug"), F.coalesce(full("league_name", "name", "league_slug"), F.lit("Unknown")).alias("league_name"),
        F.coalesce("country", F.lit("")).alias("country"), F.coalesce(full("season"), F.lit("2023+")).alias("season"), F.coalesce("priority", F.lit(1)).alias("priority"), "canonical_league_id",
    )
    if country:
        rows = rows.filter(F.lower("country") == country.lower())
    if season:
        rows = rows.filter(F.col("season") == season)
    return (rows.orderBy("path", "place").limit(most) if most else rows), bad


def readiness(engine: Column, future: Column) -> Column:
    """What two sources' states amount to; any other pair, and unknown states, are partly ready."""
    out = F.lit(PARTIAL)
    for (a, b), state in READY.items():
        out = F.when((engine == a) & (future == b if b else F.lit(True)), state).otherwise(out)
    return out
