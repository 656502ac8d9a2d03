"""Several sources of the same matches as one table: fill from the others, add what they alone have, keep the fullest row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.nulls import blank_to_null
from tallyfield.functions.text import normalise_name, stable_id
from tallyfield.operators import entities, resolve
from tallyfield.session import materialise


@dataclass(frozen=True)
class Source:
    """A table of matches (``id`` unique and in its order, date, home_team, away_team), the columns it may fill, and whether matches that it alone has join the result."""

    name: str
    table: DataFrame
    fills: list[str] = field(default_factory=list)
    adds: bool = False


def match_key() -> Column:
    """Date and normalised teams; null if one is missing."""
    parts = [F.to_date("date").cast("string"), normalise_name("home_team"), normalise_name("away_team")]
    return F.when(parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull(), F.concat_ws("|", *parts))


def _keyed(d: DataFrame) -> DataFrame:
    return d.withColumn("_key", match_key())


def _targets(primary: DataFrame, days: int) -> DataFrame:
    """_key and the id of the primary row that it finds: the last of that very key, else the first within ``days`` days."""
    known = primary.filter("_key IS NOT NULL")
    exact = known.groupBy("_key").agg(F.max("id").alias("_exact"))
    around = F.array(*[F.date_add(F.to_date("date"), i) for i in range(-days, days + 1) if i]) if days else F.array().cast("array<date>")
    moved = known.select("id", "home_team", "away_team", F.explode(around).alias("date"))
    near = _keyed(moved).groupBy("_key").agg(F.min("id").alias("_near"))
    return exact.join(near, "_key", "full").select("_key", F.coalesce("_exact", "_near").alias("_target"))


def reconcile(primary: Source, others: list[Source], columns: list[str], days: int = 1) -> DataFrame:
    """The matches of ``primary`` with empty ``columns`` filled from the others, matches that only they have, and one row a match.

    What the primary says is never overwritten. A row of another source finds
    its match by date and normalised teams, or within ``days`` days where that
    very key isn't there; of several that fill a column the first by id does.
    Of rows of one key the one with most columns filled stays, of equals the
    primary's, then the smaller id. Rows without a key fill nothing and stay.
    Returns data_source, id, date, home_team, away_team, the columns and
    ``filled_from``, the sources that filled something.
    """
    base = ["id", "date", "home_team", "away_team"]
    own = lambda s: [F.col(c) if c in s.table.columns else F.lit(None).cast(_type(c, [primary, *others])).alias(c) for c in columns]
    first = materialise(_keyed(primary.table.select(*base, *own(primary))), "reconcile-primary")
    targets = materialise(_targets(first, days), "reconcile-keys")
    whole = first.withColumn("filled_from", F.array().cast("array<string>")).withColumn("data_source", F.lit(primary.name))
    alone = []
    for s in others:
        met = materialise(_keyed(s.table.select(*base, *own(s))).join(targets, "_key", "left"), "reconcile-source")
        given = met.filter("_target IS NOT NULL").groupBy("_target").agg(*[F.min_by(c, F.when(blank_to_null(c).isNotNull(), F.col("id"))).alias(f"_g_{c}") for c in s.fills])
        whole = whole.join(given, F.col("id") == F.col("_target"), "left")
        takes = {c: blank_to_null(c).isNull() & F.col(f"_g_{c}").isNotNull() for c in s.fills}
        any_ = F.coalesce(F.greatest(*[t.cast("int") for t in takes.values()], F.lit(0)), F.lit(0)) == 1
        whole = whole.withColumn("filled_from", F.when(any_, F.array_append("filled_from", F.lit(s.name))).otherwise(F.col("filled_from")))
        whole = whole.withColumns({c: F.when(t, F.col(f"_g_{c}")).otherwise(F.col(c)) for c, t in takes.items()}).drop("_target", *[f"_g_{c}" for c in s.fills])
        if s.adds:
            alone.append(met.filter("_target IS NULL").drop("_target").withColumn("filled_from", F.array().cast("array<string>")).withColumn("data_source", F.lit(s.name)))
    for more in alone:
        whole = whole.unionByName(more)
    names = [primary.name, *[s.name for s in others]]
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("data_source"))
    filled = sum((blank_to_null(c).isNotNull().cast("int") for c in columns), F.lit(0))
    out = ["data_source", *base, *columns, "filled_from"]
    keyed = whole.filter("_key IS NOT NULL").groupBy("_key").agg(F.min_by(F.struct(*out), F.struct(-filled, rank, F.col("id"))).alias("_best")).select("_best.*")
    return keyed.unionByName(whole.filter("_key IS NULL").select(*out))


def _type(column: str, sources: list[Source]) -> str:
    return next(s.table.schema[column].dataType.simpleString() for s in sources if column in s.table.columns)


def canonicalise(rows: DataFrame, teams: DataFrame, leagues: DataFrame, columns: list[str], priority: dict[str, int], aliases: DataFrame | None = None) -> DataFrame:
    """Rows of all sources (source, id, date, league, home_team, away_team, ``columns``) as canonical matches with a quality.

    Names of teams and leagues are mapped to entities, which with the date are
    a match's identity; rows of one identity become one, each column from the
    best source by ``priority`` that fills it. The quality weighs mapping,
    identity, completeness, agreement and duplicates; a match whose names need
    a review says so. Rows without a date share an identity by teams alone.
    """
    d = rows
    for name, canon, prefix in (("home_team", teams, "home"), ("away_team", teams, "away"), ("league", leagues, "league")):
        named = d.select(F.col(name).alias("raw_name"), F.col("source").alias("provider")).distinct().withColumn("provider_id", F.lit(None).cast("string"))
        found = entities.resolve_entities(named, canon, aliases if name != "league" else None)
        found = found.select(F.col("raw_name").alias("_raw"), F.col("provider").alias("_from"), F.col("canonical_id").alias(f"{prefix}_id"), F.col("score").alias(f"_{prefix}_score"), F.col("needs_review").alias(f"_{prefix}_review"))
        d = materialise(d.join(found, F.col(name).eqNullSafe(F.col("_raw")) & F.col("source").eqNullSafe(F.col("_from"))).drop("_raw", "_from"), "canonical-names")
    d = d.withColumn("mapping_confidence", F.round(F.least("_home_score", "_away_score", "_league_score") / 100, 3)).withColumn("needs_review", F.col("_home_review") | F.col("_away_review") | F.col("_league_review"))
    day = F.to_date("date").cast("string")
    d = d.withColumn("match_id", stable_id(day, "league_id", "home_id", "away_id")).withColumn("date", day)
    kept = ["date", "league_id", "home_id", "away_id", *columns]
    one = resolve.merge_sources(d, "match_id", "source", priority, kept, ["id"])
    facts = d.groupBy("match_id").agg(F.min("mapping_confidence").alias("mapping_confidence"), F.max("needs_review").alias("needs_review"))
    one = one.join(facts, "match_id")
    warnings = F.col("needs_review").cast("int") + F.col("date").isNull().cast("int")
    complete = sum((blank_to_null(c).isNotNull().cast("int") for c in columns), F.lit(0)) / F.lit(len(columns))
    agreement = 1 - F.col("conflicts") / F.lit(len(kept))
    enrichment = F.least(F.size("sources") / F.lit(len(priority)), F.lit(1.0))
    risk = F.least((F.col("merged_rows") - F.size("sources")) / F.lit(4.0), F.lit(1.0))
    quality = resolve.quality_score(F.col("mapping_confidence"), resolve.identity_confidence(warnings), complete, agreement, enrichment, risk, F.col("conflicts"))
    return one.withColumn("quality", quality).withColumn("band", resolve.quality_band(F.col("quality")))
