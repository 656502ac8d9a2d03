"""Payloads of any nesting as VARIANT columns: every object in them, and statistics, prices and incidents in whichever shape they come."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions import payloads
from tallyfield.functions.text import parse_number, parse_score, parse_status
from tallyfield.session import drop_written, materialise

# The keys that sources use for the same thing, in order.
NAMES = ("name", "shortName", "participantName")
STAT_NAMES = ("name", "categoryName", "type", "key", "statName")
MARKET_NAMES = ("name", "marketName", "label", "type")
MARKET_VALUES = ("values", "odds", "outcomes", "selections")
PAIR_HOME = ("home", "homeValue", "home_value", "homeScore", "home_score", "h")
PAIR_AWAY = ("away", "awayValue", "away_value", "awayScore", "away_score", "a")
PRICES = ("odds", "value", "decimal", "price")
OUTCOMES = (("home", "draw", "away"), ("yes", "no"), ("over", "under"))
SCORES = {"home_ft": ("home", "homeScore", "home_score"), "away_ft": ("away", "awayScore", "away_score"), "home_ht": ("homeHT", "home_ht", "homeHalfTime"), "away_ht": ("awayHT", "away_ht", "awayHalfTime")}
STATS, MARKETS, EVENTS = ("stats", "statistics"), ("markets", "odds", "bookmakers"), ("events", "incidents")
WRITTEN, LEAGUE, DATE, STATUS = ("score", "result", "ftScore"), ("league", "competitionName"), ("match_date", "date", "startTime", "start_time"), ("status", "stage", "matchStatus")
#: Members that an object must have to be a match: one of the pairs of teams, and one of the others.
TEAM_PAIRS = (("home", "away"), ("homename", "awayname"), ("home_team", "away_team"), ("homeparticipantname", "awayparticipantname"))
MARKERS = ("id", "eventid", "event_id", "matchid", "match_id", "score", "starttime", "date", "markets", "odds", "stats", "statistics", "events", "incidents")


# In what follows variants, structs and results are SQL.


def _object(v: str) -> str:
    """Whether a variant is an object, told without reading what is in it."""
    return f"try_variant_get({v}, '$', 'struct<>') IS NOT NULL"


def _array(v: str) -> str:
    return f"try_variant_get({v}, '$', 'array<struct<>>') IS NOT NULL"


def _cast(v: str, kind: str) -> str:
    return f"try_variant_get({v}, '$', '{kind}')"


def _list(v: str) -> str:
    return _cast(v, "array<variant>")


def _map(v: str) -> str:
    return _cast(v, "map<string,variant>")


def _fields(kind: str, *names: str) -> str:
    """Fields of one type for members of these names."""
    return ", ".join(f"`{n}` {kind}" for n in dict.fromkeys(names))


def _read(v: str, *fields: str) -> str:
    """An object's members as a struct, in one pass over it; null unless it is an object."""
    return _cast(v, f"struct<{', '.join(fields)}>")


def _first(s: str, keys) -> str:
    """The first of the text fields of a struct that is neither null nor empty."""
    return "coalesce(" + ", ".join(f"nullif({s}.`{k}`, '')" for k in keys) + ")"


def _there(v: str) -> str:
    """Whether a variant is neither absent, null nor an empty text."""
    return f"({_object(v)} OR {_array(v)} OR {_cast(v, 'string')} <> '')"


def _member(s: str, keys) -> str:
    """The first variant field of a struct that is there and not empty."""
    return "coalesce(" + ", ".join(f"CASE WHEN {_there(f'{s}.`{k}`')} THEN {s}.`{k}` END" for k in keys) + ")"


def _levels(df: DataFrame, keys: list[str], json: str, values: bool = True, **columns: Column) -> list[DataFrame]:
    """The values of JSON texts by depth, written level by level: objects and arrays, and the rest with ``values``; ``columns`` are expressions over ``value``."""
    level = df.select(*keys, F.lit("$").alias("path"), F.lit(0).alias("depth"), F.try_parse_json(json).alias("value"))
    kind = F.expr(f"CASE WHEN {_object('value')} THEN 'object' WHEN {_array('value')} THEN 'array' ELSE 'value' END")
    found = []
    while True:
        level = materialise(level.withColumns({"kind": kind, **columns}), "payload-nodes").filter("value IS NOT NULL")  # here, as a filter before would parse again
        found.append(level)
        inner = level.filter("kind <> 'value'")
        if inner.isEmpty():
            return found
        inner.createOrReplaceTempView("_payload_level")
        names = ", ".join(f"t.`{k}`" for k in keys)
        level = df.sparkSession.sql(f"SELECT {names}, concat(t.path, CASE WHEN t.kind = 'array' THEN concat('[', e.pos, ']') ELSE concat('.', e.key) END) AS path, t.depth + 1 AS depth, e.value AS value FROM _payload_level t, LATERAL variant_explode(t.value) e")
        if not values:
            level = level.filter(f"{_object('value')} OR {_array('value')}")
        df.sparkSession.catalog.dropTempView("_payload_level")


def nodes(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """Every value inside the JSON texts of a column, whatever the depth: keys, path, depth, kind (object, array, or value), value (variant).

    A level is one ``variant_explode`` of the level above, so texts of any
    shape need no schema, and work follows their size. Texts that are null or
    no JSON have no rows. Paths name members as ``$.a.b[0]``.
    """
    return reduce(DataFrame.unionByName, _levels(df, keys, json)).select(*keys, "path", "depth", "kind", "value")


def objects(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """The objects among ``nodes``."""
    return reduce(DataFrame.unionByName, _levels(df, keys, json, values=False)).filter("kind = 'object'").select(*keys, "path", "depth", "value")


def stats_of(v: str) -> Column:
    """Statistics of a variant (a list of items or an object by name) as (name, home, away) items.

    A pair is the home and away members of an object, the first two of a list,
    or a text such as "3-4".
    """
    pair = _fields("string", *PAIR_HOME, *PAIR_AWAY)
    of = lambda s: f"{_first(s, PAIR_HOME)} AS home, {_first(s, PAIR_AWAY)} AS away"
    listed = _cast(v, f"array<struct<{_fields('string', *STAT_NAMES, *PAIR_HOME, *PAIR_AWAY)}>>")
    items = f"transform(filter({listed}, x -> x IS NOT NULL), x -> struct(coalesce({_first('x', STAT_NAMES)}, '') AS name, {of('x')}))"
    text = _cast("e.value", "string")
    written = f"CASE WHEN {text} RLIKE '\\\\d\\\\s*[-:–]\\\\s*\\\\d' THEN split({text}, '\\\\s*[-:–]\\\\s*', 2) END"
    members = f"transform(map_entries({_map(v)}), e -> struct(e.key AS name, e.value AS value, {_read('e.value', pair)} AS own))"
    members = f"transform({members}, e -> struct(e.name AS name, CASE WHEN e.own IS NOT NULL THEN array({_first('e.own', PAIR_HOME)}, {_first('e.own', PAIR_AWAY)}) ELSE coalesce({_cast('e.value', 'array<string>')}, {written}) END AS pair))"
    members = f"transform({members}, e -> struct(e.name AS name, get(e.pair, 0) AS home, get(e.pair, 1) AS away))"
    return F.expr(f"coalesce({items}, {members}, array())")


def markets_of(v: str) -> Column:
    """Markets of a variant (a list of items with values, or an object by name) as (name, values) items.

    Prices are a list of numbers, texts or objects with one, or an object of
    outcomes. Empty lists go on to the next shape.
    """
    fields = [_fields("string", *MARKET_NAMES), _fields("variant", *MARKET_VALUES)]
    items = f"filter(transform({_list(v)}, x -> struct(x AS value, {_read('x', *fields)} AS own)), x -> x.own IS NOT NULL)"
    items = f"transform({items}, x -> struct(coalesce({_first('x.own', MARKET_NAMES)}, '') AS name, coalesce({_member('x.own', MARKET_VALUES)}, x.value) AS value))"
    members = f"transform(map_entries({_map(v)}), e -> struct(e.key AS name, e.value AS value))"
    fields = [_fields("array<variant>", *MARKET_VALUES[:3]), _fields("variant", *(n for names in OUTCOMES for n in names))]
    read = f"transform(coalesce({items}, {members}, array()), m -> struct(m.name AS name, {_list('m.value')} AS list, {_read('m.value', *fields)} AS own))"
    lists = [f"CASE WHEN size(m.own.`{k}`) > 0 THEN m.own.`{k}` END" for k in MARKET_VALUES[:3]]
    outcomes = [f"CASE WHEN {' OR '.join(f'm.own.`{n}` IS NOT NULL' for n in names)} THEN array({', '.join(f'm.own.`{n}`' for n in names)}) END" for names in OUTCOMES]
    found = f"transform(coalesce(m.list, {', '.join(lists + outcomes)}, array()), o -> struct(o AS value, {_read('o', _fields('string', *PRICES))} AS own))"
    return F.expr(f"transform({read}, m -> struct(m.name AS name, transform({found}, o -> CASE WHEN o.own IS NOT NULL THEN {_first('o.own', PRICES)} ELSE {_cast('o.value', 'string')} END) AS values))")


def events_of(v: str) -> Column:
    """Incidents of a list as (type, minute, side) items."""
    kinds, minutes, sides = ("type", "incidentType", "eventType"), ("minute", "time", "matchTime"), ("side", "teamSide", "participant")
    listed = _cast(v, f"array<struct<{_fields('string', *kinds, *minutes, *sides)}>>")
    return F.expr(f"transform(coalesce({listed}, array()), x -> struct({_first('x', kinds)} AS type, {_first('x', minutes)} AS minute, {_first('x', sides)} AS side))")


def _team(s: str, keys) -> Column:
    """The first team member of a struct that is there; of an object its name."""
    read = f"transform(array({', '.join(f'{s}.`{k}`' for k in keys)}), x -> struct({_read('x', _fields('string', *NAMES))} AS own, x AS value))"
    names = f"transform({read}, x -> CASE WHEN x.own IS NOT NULL THEN struct({_first('x.own', NAMES)} AS name) WHEN {_cast('x.value', 'string')} <> '' THEN struct({_cast('x.value', 'string')} AS name) END)"
    return F.expr(f"get(filter({names}, x -> x IS NOT NULL), 0).name")


def is_match(v: str) -> Column:
    """An object of a variant column that has both teams and something that tells of a match; the case of names doesn't count."""

    def told(names: Column) -> Column:
        pairs = [F.array_contains(names, a) & F.array_contains(names, b) for a, b in TEAM_PAIRS]
        return reduce(lambda x, y: x | y, pairs) & F.arrays_overlap(names, F.array(*map(F.lit, MARKERS)))

    names = F.transform(F.map_keys(F.expr(_cast(v, "map<string,struct<>>"))), lambda k: F.lower(k))
    return F.coalesce(F.get(F.transform(F.array(names), told), F.lit(0)), F.lit(False))  # names are made once


def captured_rows(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """A row for each object, at any depth, that is a match (``is_match``) and names both teams, in whichever of the known shapes: see ``payloads.structured_rows`` for the columns, and ``path``.

    Where a statistic or market occurs twice in an object the last in order of
    a list, or of the sorted names of an object, holds.
    """
    levels = _levels(df, keys, json, values=False, match=is_match("value"))
    variants, texts = (*payloads.HOME, *payloads.AWAY, "score", *STATS, *MARKETS, *EVENTS), (*payloads.IDS, *WRITTEN[1:], *LEAGUE, *DATE, *STATUS, "provider_warnings", "data_quality_score")
    d = reduce(DataFrame.unionByName, levels).filter("match").select(*keys, "path", "value", F.expr(_read("value", _fields("variant", *variants), _fields("string", *texts))).alias("_own"))
    own = lambda names: F.expr(_first("_own", names))
    d = d.select(
        *keys, "path", own(payloads.IDS).alias("_id"), F.when(own(payloads.IDS).isNull(), F.to_json("value")).alias("_json"), own(LEAGUE).alias("league"), own(DATE).alias("match_date"), own(STATUS).alias("status"), own(("provider_warnings",)).alias("provider_warnings"), own(("data_quality_score",)).alias("data_quality_score"),
        _team("_own", payloads.HOME).alias("home_team"), _team("_own", payloads.AWAY).alias("away_team"), F.expr(f"coalesce(nullif({_cast('_own.score', 'string')}, ''), {_first('_own', WRITTEN[1:])})").alias("_written"),
        F.expr(_read("_own.score", *(_fields("string", *k) for k in SCORES.values()))).alias("_score"), *[F.expr(_member("_own", k)).alias(n) for n, k in (("_stats", STATS), ("_markets", MARKETS), ("_events", EVENTS))],
    )
    written = F.transform(F.array("_written"), lambda x: parse_score(x))
    told = F.transform(F.array(*[F.expr(_first("_score", k)) for k in SCORES.values()]), lambda x: F.floor(parse_number(x)).cast("int"))
    d = d.withColumns({"_stats": payloads.stat_hits(stats_of("_stats")), "_prices": payloads.price_hits(markets_of("_markets")), "_events": events_of("_events"), "_written": F.get(written, F.lit(0)), "_score": told})
    texts = payloads.texts_of_stats(F.col("_stats")) | payloads.texts_of_prices(F.col("_prices"))
    d = d.withColumn("_numbers", F.transform(F.array(*texts.values()), lambda x: parse_number(x)))
    columns = {n: F.get("_numbers", F.lit(i)) if n.startswith("odds") else payloads.stat_number(n, F.get("_numbers", F.lit(i))) for i, n in enumerate(texts)}
    any_written = F.coalesce(*[F.col("_written")[n] for n in SCORES]).isNotNull()
    score = F.struct(*[F.when(any_written, F.col("_written")[n]).otherwise(F.get("_score", F.lit(i))).alias(n) for i, n in enumerate(SCORES)])
    d = d.select(
        *keys, "path", F.coalesce("_id", payloads.match_id(F.col("_json"))).alias("flashscore_match_id"), F.coalesce("league", F.lit("Unknown League")).alias("league"),
        F.substring("match_date", 1, 10).alias("match_date"), "home_team", "away_team", parse_status("status").alias("status"), score.alias("_score"),
        *[c.alias(n) for n, c in columns.items()], payloads.goal_minutes(F.col("_events"), "home").alias("goal_minutes_home"), payloads.goal_minutes(F.col("_events"), "away").alias("goal_minutes_away"),
        F.coalesce("provider_warnings", F.lit("structured_capture")).alias("provider_warnings"), F.coalesce(F.nullif(parse_number("data_quality_score"), F.lit(0.0)), F.lit(0.80)).alias("data_quality_score"),
    )
    d = materialise(d, "payload-matches")  # a filter on teams would be moved below all of it, and everything read twice
    for level in levels:
        drop_written(level)
    return payloads.finalised(d.filter("home_team IS NOT NULL AND away_team IS NOT NULL"))
