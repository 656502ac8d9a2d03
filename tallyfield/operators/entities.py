"""Names mapped to canonical entities: known ids, aliases, equal names, then an exact join by likeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.fuzzy import ratio, subsequence_length
from tallyfield.functions.nulls import blank_to_null
from tallyfield.functions.text import normalise_name, slug
from tallyfield.session import materialise

# The scores from which a match holds and from which it goes to review.
SURE, REVIEW = 92, 82
#: Canonical names of one gram that a task holds.
POSTINGS = 2000


def grams(x: str) -> Column:
    """Pairs of neighbouring characters, each with how often it came before, so that two names share as many of these as they share pairs."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(F.col(x), i, F.lit(2)))
    numbered = F.transform(pairs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda h: h == g)).cast("string")))
    return F.when(F.length(x) >= 2, numbered).otherwise(F.array().cast("array<string>"))


def needed(total: Column, least: int) -> Column:
    """How many grams two different names share at least if their lengths sum to ``total`` and their ratio is ``least`` or more.

    With a common subsequence of L characters, |a| - L are deleted, each of
    which breaks up at most two pairs of a, and |b| - L inserted, each of
    which breaks up at most one: |a| - 1 - 2 (|a| - L) - (|b| - L) are left.
    """
    common = F.ceil(least * total / F.lit(200))
    return (3 * common - total - 1).cast("int")


def _shortest(length: Column, least: int) -> Column:
    """The least length that a name may have beside one of ``length``."""
    return F.ceil(least * length / F.lit(200 - least)).cast("int")


def similar_names(names: DataFrame, canon: DataFrame, least: int = REVIEW) -> DataFrame:
    """norm, canon and score of all pairs of different strings with a token-sort ratio of ``least`` (percent, above 80) or more.

    ``names`` and ``canon`` hold distinct strings in ``norm``. An inverted
    index of character pairs: a name's grams are ordered by how many
    canonical names have them, the rarest first, and of n grams only the first
    n - needed + 1 are looked up, as two names that share ``needed`` grams
    share one of those. Grams of many canonical names are split into blocks,
    so no task holds a hot one. A pair is taken at its first common gram only,
    then by lengths, by all its grams, and last by the exact ratio. No pair
    that reaches ``least`` is missed; of names below two characters only
    equal ones could, which are left out.
    """
    if not 80 < least <= 100:
        raise ValueError("two pairs of neighbouring characters need not be common at 80 percent or less")
    prepared = lambda d: d.filter("norm IS NOT NULL").select("norm", sorted_words("norm").alias("sorted")).withColumn("grams", grams("sorted"))
    left, right = materialise(prepared(names), "names"), materialise(prepared(canon), "canon")
    often = materialise(right.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("often")), "grams")

    def ranked(d: DataFrame) -> DataFrame:
        """Each name with its grams from rare to frequent (unknown ones are of no use: nothing has them, but they count), and those to look up."""
        each = d.select("norm", "sorted", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(often, "gram", "left")
        place = F.struct(F.coalesce("often", F.lit(0).cast("long")).alias("often"), "gram")
        whole = each.groupBy("norm").agg(F.first("sorted").alias("sorted"), F.array_sort(F.collect_list(place)).alias("order"))
        length = F.length("sorted")
        fewest = F.ceil((3 * least - 200) * (length + _shortest(length, least)) / F.lit(200)) - 1  # of ``needed`` beside names of any length
        keep = F.size("order") - F.greatest(fewest, F.lit(1)).cast("int") + 1
        whole = whole.withColumn("grams", F.transform("order", lambda o: o["gram"])).withColumn("first", F.slice("order", F.lit(1), F.greatest(keep, F.lit(0))))
        return whole.select("norm", "sorted", "grams", "first")

    blocks = F.greatest(F.ceil(F.col("look.often") / POSTINGS), F.lit(1)).cast("int")
    ask = ranked(left).withColumn("firsts", F.transform("first", lambda o: o["gram"])).select("norm", F.col("sorted").alias("a"), F.col("grams").alias("ga"), "firsts", F.explode("first").alias("look"))
    ask = ask.filter("look.often > 0").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).select("norm", "a", "ga", "firsts", F.col("look.gram").alias("gram"), "block")
    have = ranked(right).withColumn("seconds", F.transform("first", lambda o: o["gram"])).select(F.col("norm").alias("canon"), F.col("sorted").alias("b"), F.col("grams").alias("gb"), "seconds", F.explode("first").alias("look"))
    have = have.select("canon", "b", "gb", "seconds", F.col("look.gram").alias("gram"), F.pmod(F.xxhash64("canon"), blocks).cast("int").alias("block"))
    total, shorter = F.length("a") + F.length("b"), F.least(F.length("a"), F.length("b"))
    met = ask.join(have, ["gram", "block"]).filter((F.col("a") != F.col("b")) | (F.col("norm") != F.col("canon")))
    met = met.filter((200 * shorter >= least * total) & (F.get(F.array_intersect("firsts", "seconds"), F.lit(0)) == F.col("gram")))
    met = met.filter((F.col("a") == F.col("b")) | (F.size(F.array_intersect("ga", "gb")) >= needed(total, least))).select("norm", "canon", "a", "b")
    scored = met.withColumn("score", ratio(subsequence_length("a", "b"), "a", "b"))
    return scored.filter(F.col("score") >= least).select("norm", "canon", "score")


def sorted_words(x: str) -> Column:
    """Words of an already normalised name in order."""
    return F.array_join(F.array_sort(F.split(F.trim(F.col(x)), r"\s+")), " ")


def best_names(names: DataFrame, canon: DataFrame, least: int = REVIEW) -> DataFrame:
    """norm, canon and score: the most alike canonical name of each, of equally alike ones the first in order; names without one are left out."""
    pairs = similar_names(names, canon, least)
    return pairs.groupBy("norm").agg(F.min_by("canon", F.struct(-F.col("score"), F.col("canon"))).alias("canon"), F.max("score").alias("score"))


def _first(df: DataFrame, keys: list[str]) -> DataFrame:
    """One canonical_id for each key, the smallest."""
    return df.groupBy(*keys).agg(F.min("canonical_id").alias("canonical_id"))


def resolve_entities(rows: DataFrame, canon: DataFrame, aliases: DataFrame | None = None, provider_ids: DataFrame | None = None, sure: int = SURE, review: int = REVIEW) -> DataFrame:
    """Adds canonical_id, canonical_name, normalized, score, method, band and needs_review to rows (raw_name, provider, provider_id).

    In this order: the provider's id (``provider_ids``: provider, provider_id,
    canonical_id), an alias of the provider or of any (``aliases``: provider or
    null, alias, canonical_id), an equal normalised name or alias of ``canon``
    (canonical_id, canonical_name), the most alike one with a score of ``sure``
    or more, of ``review`` or more (to be reviewed), else a new entity whose id
    is the name's slug, with the score 0. Every row comes back once. Names that
    are null or blank and have no known id are of a new entity "unknown". Only
    distinct names that nothing else resolves are compared.
    """
    canon = canon.select("canonical_id", "canonical_name").filter("canonical_id IS NOT NULL")
    named = _first(canon.select("canonical_id", normalise_name("canonical_name").alias("normalized")), ["normalized"]).filter("normalized IS NOT NULL")
    d = rows.withColumn("normalized", normalise_name("raw_name"))
    if provider_ids is not None:
        known = _first(provider_ids.filter("provider IS NOT NULL AND provider_id IS NOT NULL"), ["provider", "provider_id"]).withColumnRenamed("canonical_id", "_by_id")
        d = d.join(known, ["provider", "provider_id"], "left")
    else:
        d = d.withColumn("_by_id", F.lit(None).cast("string"))
    d = d.withColumn("_by_alias", F.lit(None).cast("string"))
    if aliases is not None:
        alias = aliases.select("provider", normalise_name("alias").alias("normalized"), "canonical_id").filter("normalized IS NOT NULL")
        own = _first(alias.filter("provider IS NOT NULL"), ["provider", "normalized"]).withColumnRenamed("canonical_id", "_own")
        any_ = _first(alias.filter("provider IS NULL"), ["normalized"]).withColumnRenamed("canonical_id", "_any")
        d = d.drop("_by_alias").join(own, ["provider", "normalized"], "left").join(any_, "normalized", "left").withColumn("_by_alias", F.coalesce("_own", "_any")).drop("_own", "_any")
        named = _first(named.unionByName(alias.select("normalized", "canonical_id")), ["normalized"])
    d = d.join(named.withColumnRenamed("canonical_id", "_by_name"), "normalized", "left")
    open_ = F.col("_by_id").isNull() & F.col("_by_alias").isNull() & F.col("_by_name").isNull()
    asked = d.filter(open_ & F.col("normalized").isNotNull()).select(F.col("normalized").alias("norm")).distinct()
    found = best_names(asked, named.select(F.col("normalized").alias("norm")), review).join(named.withColumnRenamed("normalized", "canon"), "canon").select(F.col("norm").alias("normalized"), F.col("canonical_id").alias("_by_likeness"), F.col("score").alias("_score"))
    d = d.join(found, "normalized", "left")
    made = F.coalesce(blank_to_null(slug("normalized")), F.lit("unknown"))
    method = F.when(F.col("_by_id").isNotNull(), "provider_id").when(F.col("_by_alias").isNotNull(), "alias").when(F.col("_by_name").isNotNull(), "normalized_exact")
    method = method.when(F.col("_score") >= sure, "fuzzy_auto").when(F.col("_score") >= review, "fuzzy_review").otherwise("created")
    d = d.withColumn("method", method).withColumn("score", F.when(F.col("method").isin("provider_id", "alias", "normalized_exact"), 100.0).otherwise(F.round(F.coalesce("_score", F.lit(0.0)), 3)))
    d = d.withColumn("canonical_id", F.coalesce("_by_id", "_by_alias", "_by_name", "_by_likeness", made)).drop("_by_id", "_by_alias", "_by_name", "_by_likeness", "_score")
    names = canon.groupBy("canonical_id").agg(F.min("canonical_name").alias("canonical_name"))
    d = d.join(names, "canonical_id", "left").withColumn("canonical_name", F.coalesce("canonical_name", F.trim("raw_name"), "canonical_id"))
    band = F.when(F.col("score") >= sure, "high").when(F.col("score") >= review, "medium").otherwise("low")
    return d.withColumn("band", band).withColumn("needs_review", F.col("method").isin("fuzzy_review", "created"))


def review_queue(resolved: DataFrame) -> DataFrame:
    """The distinct names to be looked at, each once a provider: reason score_between or no_match, how many rows have it."""
    reason = F.when(F.col("method") == "fuzzy_review", "score_between").otherwise("no_match")
    queue = resolved.filter("needs_review").groupBy("provider", "normalized", reason.alias("reason"), "canonical_id", "score").agg(F.min("raw_name").alias("raw_name"), F.count("*").alias("rows"))
    return queue


def registered(canon: DataFrame, resolved: DataFrame) -> DataFrame:
    """The registry with the entities that ``resolve_entities`` made, each once, and the confidence they are kept with."""
    new = resolved.filter("method = 'created'").groupBy("canonical_id").agg(F.min("canonical_name").alias("canonical_name"))
    known = canon.select("canonical_id", "canonical_name", F.lit(1.0).alias("confidence"))
    return known.unionByName(new.join(known, "canonical_id", "left_anti").withColumn("confidence", F.lit(0.55)))


def learned_aliases(resolved: DataFrame) -> DataFrame:
    """Aliases (provider, alias, canonical_id) that later runs may use: of all rows that needed likeness or an equal name, one an alias."""
    d = resolved.filter(F.col("method").isin("normalized_exact", "fuzzy_auto", "created") & F.col("normalized").isNotNull())
    best = Window.partitionBy("provider", "normalized").orderBy(F.desc("score"), "canonical_id")
    return d.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select("provider", F.col("normalized").alias("alias"), "canonical_id")
