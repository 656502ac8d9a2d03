"""Captured match payloads as columns: ids, statistics, prices, incidents and whole rows, in functions of arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.nulls import blank_to_null, col
from tallyfield.functions.text import first_match, parse_number, parse_score, parse_status

# Where ids stand in markup and payloads, in order, and the names that payloads use.
ID_PATTERNS = (
    r"(?i)data-(?:event|match|id)=['\"]([A-Za-z0-9]{6,})['\"]",
    r"(?i)(?:eventId|event_id|matchId|match_id|flashscore_match_id|id)['\"]?\s*[:=]\s*['\"]([A-Za-z0-9_-]{6,})['\"]",
    r"(?i)id=['\"]g_\d_([A-Za-z0-9]{6,})['\"]",
    r"(?i)(?:match[-_/]summary|match-detail|/match/|#/match/)[^A-Za-z0-9]*([A-Za-z0-9]{6,})",
)
ID_WORDS = ("data-", "id", "g_", "match")  # a text without the word can't fit the pattern
# Words of addresses and bodies, and members of payloads, that tell what a response holds; words that no team's name has.
KIND_WORDS = (("odds", "odds|prematch|bookmaker"), ("stats", "statistic|stats|xg|corner|shot"), ("events", "incident|event|goal|card|substitution"), ("standings", "standings|table"), ("fixtures", "fixture|match"))
KIND_MEMBERS = (("odds", ("odds", "markets", "bookmakers")), ("stats", ("stats", "statistics")), ("events", ("incidents", "events")))
NO_TEAM = "standings|draw|fixtures|results|loading|odds|betting|summary|advertisement|show more|table"
HOME = ("home_team", "home", "homeName", "homeParticipantName", "homeTeamName")
AWAY = ("away_team", "away", "awayName", "awayParticipantName", "awayTeamName")
IDS = ("flashscore_match_id", "id", "eventId", "event_id", "matchId", "match_id")
OPTIONAL = ("odds_home", "odds_over_25", "corners_home", "shots_home", "xg_home")

STATS_SCHEMA = "array<struct<name:string,home:string,away:string>>"
MARKETS_SCHEMA = "array<struct<name:string,values:array<string>>>"
EVENTS_SCHEMA = "array<struct<type:string,minute:string,side:string>>"


def match_id(text: Column | str) -> Column:
    """The id by the first pattern that finds one."""
    x = col(text)
    return F.coalesce(*[F.when(F.contains(F.lower(x), F.lit(word)), first_match(x, p)) for word, p in zip(ID_WORDS, ID_PATTERNS)])


def _last(items: Column, test) -> Column:
    """The last item that passes; later ones overrule."""
    return F.try_element_at(F.filter(items, test), F.lit(-1))


def _once(x: Column, then) -> Column:
    """``then(x)`` with x made once, however often it is used."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def _plain(name: Column) -> Column:
    return F.lower(F.trim(F.coalesce(name, F.lit(""))))


STAT_KINDS = ("corners", "shots_on_target", "shots", "xg")


def stat_hits(stats: Column) -> Column:
    """The last item of each of the ``STAT_KINDS`` among (name, home, away) items; an item goes to the first kind that its name fits, and pairs with a gap don't count."""
    known = F.transform(F.filter(stats, lambda s: s["home"].isNotNull() & s["away"].isNotNull()), lambda s: F.struct(_plain(s["name"]).alias("name"), s["home"].alias("home"), s["away"].alias("away")))
    has = lambda n, word: F.contains(n, F.lit(word))

    def kind(n: Column) -> Column:
        shots = n.isin("shots", "goal attempts", "total shots", "attempts on goal") | has(n, "shots total")
        return F.when(has(n, "corner"), 0).when(has(n, "on target") | has(n, "shots on"), 1).when(shots, 2).when((n == "xg") | has(n, "expected goals"), 3)

    sorted_out = F.transform(known, lambda s: F.struct(kind(s["name"]).alias("kind"), s["home"].alias("home"), s["away"].alias("away")))
    hit = lambda items, k: _last(items, lambda s: s["kind"] == k)
    return _once(sorted_out, lambda items: F.array(*[hit(items, k) for k in range(len(STAT_KINDS))]))


def texts_of_stats(hits: Column) -> dict[str, Column]:
    return {f"{kind}_{side}": F.get(hits, F.lit(i))[side] for i, kind in enumerate(STAT_KINDS) for side in ("home", "away")}


def stat_texts(stats: Column) -> dict[str, Column]:
    """Eight texts from (name, home, away) items, by ``stat_hits``."""
    return texts_of_stats(stat_hits(stats))


def stat_number(name: str, x: Column) -> Column:
    """A statistic's number: whole but for expected goals."""
    return x if name.startswith("xg") else F.floor(x).cast("int")


PRICES = (("odds_home", "odds_draw", "odds_away"), *((f"odds_over_{c}", f"odds_under_{c}") for c in ("05", "15", "25")), ("odds_btts_yes", "odds_btts_no"))


def price_hits(markets: Column) -> Column:
    """The values of the last market of each of the kinds in ``PRICES`` among (name, values) items that has enough of them: result, three lines of totals, both score."""
    has = lambda n, *words: reduce(lambda x, y: x | y, [F.contains(n, F.lit(w)) for w in words])
    total = lambda n: has(n, "over/under", "total", "goals")
    lines = [lambda n, line=line: total(n) & has(n, line) for line in ("0.5", "1.5", "2.5")]
    tests = [lambda n: n.isin("1x2", "match winner", "h2h", "full time result"), *lines, lambda n: has(n, "btts", "both teams")]
    named = F.transform(markets, lambda m: F.struct(_plain(m["name"]).alias("name"), m["values"].alias("values")))
    hit = lambda items, test, names: _last(items, lambda m: test(m["name"]) & (F.size(m["values"]) >= len(names)))["values"]
    return _once(named, lambda items: F.array(*[hit(items, test, names) for test, names in zip(tests, PRICES)]))


def texts_of_prices(hits: Column) -> dict[str, Column]:
    return {name: F.get(F.get(hits, F.lit(i)), F.lit(k)) for i, names in enumerate(PRICES) for k, name in enumerate(names)}


def price_texts(markets: Column) -> dict[str, Column]:
    """Eleven texts of prices from (name, values) items, by ``price_hits``."""
    return texts_of_prices(price_hits(markets))


def goal_minutes(events: Column, side: str) -> Column:
    """Minutes of one side's goals in order of the payload; null without one."""
    own = F.filter(events, lambda e: F.contains(F.lower(F.coalesce(e["type"], F.lit(""))), F.lit("goal")) & F.lower(F.coalesce(e["side"], F.lit(""))).startswith(side[0]) & parse_number(e["minute"]).isNotNull())
    minutes = F.transform(own, lambda e: F.floor(parse_number(e["minute"])).cast("int"))
    return F.when(F.size(minutes) > 0, minutes)


def payload_kind(url: Column, body: Column) -> Column:
    """What a captured response holds: by words of its address and the first 500 characters of its body, else by the members of its JSON.

    A classification by words reads no further by definition.
    """
    text = F.lower(F.concat_ws(" ", url, F.substring(body, 1, 500)))
    members = F.transform(F.coalesce(F.json_object_keys(F.when(F.try_parse_json(body).isNotNull(), body)), F.array().cast("array<string>")), lambda k: F.lower(k))
    out = F.lit("unknown")
    for kind, names in reversed(KIND_MEMBERS):
        out = F.when(F.arrays_overlap(members, F.array(*map(F.lit, names))), kind).otherwise(out)
    for kind, words in reversed(KIND_WORDS):
        out = F.when(text.rlike(words), kind).otherwise(out)
    return out


def finalised(df: DataFrame) -> DataFrame:
    """Rows with an id: the given one, else one from league, date and teams, which caps the quality; missing optional columns are noted.

    Needs flashscore_match_id, league, match_date, home_team, away_team,
    provider_warnings, data_quality_score and the ``OPTIONAL`` columns.
    """
    given = F.when(F.trim(F.coalesce("flashscore_match_id", F.lit(""))) != "", F.col("flashscore_match_id"))
    base = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("league", "match_date", "home_team", "away_team")])
    made = F.concat(F.lit("fallback_"), F.substring(F.regexp_replace(F.regexp_replace(F.lower(base), "[^a-z0-9]+", "_"), "^_|_$", ""), 1, 140))
    quality = F.when(given.isNull(), F.least(F.coalesce("data_quality_score", F.lit(0.70)), F.lit(0.64))).otherwise(F.col("data_quality_score"))
    gone = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in OPTIONAL])), ",")
    new = F.array(*[F.when(given.isNull(), w) for w in ("missing_flashscore_match_id", "fallback_provider_match_id_generated")], F.concat(F.lit("optional_fields_missing:"), F.nullif(gone, F.lit(""))))
    warnings = F.array_distinct(F.filter(F.concat(F.split(F.coalesce("provider_warnings", F.lit("")), ";"), F.array_compact(new)), lambda x: x != ""))
    made_id = F.regexp_replace(F.coalesce(given, made), "g_1_", "")
    return df.select(*[c for c in df.columns if c not in ("provider_warnings", "data_quality_score")], F.array_join(warnings, ";").alias("provider_warnings"), quality.alias("data_quality_score"), made_id.alias("match_id"))


def structured_rows(df: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """A row for each JSON payload that names both teams: names by whichever key has them, score, status, prices, statistics and goal minutes."""
    own = lambda *keys: F.coalesce(*[blank_to_null(F.col(f"_json.{k}")) for k in keys])
    score = parse_score(own("score", "result", "ftScore"))
    names = [*HOME, *AWAY, *IDS, "league", "competitionName", "match_date", "date", "startTime", "start_time", "status", "stage", "matchStatus", "score", "result", "ftScore"]
    schema = ", ".join([*(f"{n} string" for n in names), f"stats {STATS_SCHEMA}", f"markets {MARKETS_SCHEMA}", f"events {EVENTS_SCHEMA}"])
    read = df.select(*keep, json, F.from_json(json, schema).alias("_json"))  # one pass over the text
    read = read.withColumns({"_stats": stat_hits(F.col("_json.stats")), "_prices": price_hits(F.col("_json.markets"))})  # columns, so that each is made once
    texts, events = texts_of_stats(F.col("_stats")) | texts_of_prices(F.col("_prices")), F.col("_json.events")
    read = read.withColumn("_numbers", F.transform(F.array(*texts.values()), lambda x: parse_number(x)))  # one parser for all of them
    columns = {n: F.get("_numbers", F.lit(i)) if n.startswith("odds") else stat_number(n, F.get("_numbers", F.lit(i))) for i, n in enumerate(texts)}
    d = read.select(
        *keep, F.coalesce(own(*IDS), match_id(json)).alias("flashscore_match_id"), F.coalesce(own("league", "competitionName"), F.lit("Unknown League")).alias("league"), F.substring(own("match_date", "date", "startTime", "start_time"), 1, 10).alias("match_date"),
        own(*HOME).alias("home_team"), own(*AWAY).alias("away_team"), parse_status(own("status", "stage", "matchStatus")).alias("status"), score.alias("_score"), *[c.alias(n) for n, c in columns.items()],
        goal_minutes(events, "home").alias("goal_minutes_home"), goal_minutes(events, "away").alias("goal_minutes_away"), F.lit("structured_capture").alias("provider_warnings"), F.lit(0.80).alias("data_quality_score"),
    )
    return finalised(d.filter("home_team IS NOT NULL AND away_team IS NOT NULL"))


def text_rows(df: DataFrame, key: str, text: str, year: int) -> DataFrame:
    """Matches in plain lines: a time line followed by two team lines, under the last date line before it.

    A date line starts with a day and month ("Sat 3.2.", "3/2"), of ``year``
    unless a year of four digits follows ("03-02-2024"); a day that doesn't
    exist leaves the date as it was. Team lines have three characters at least
    and none of the ``NO_TEAM`` words. One pass over the lines of each text: the lines ahead are array elements,
    the date the last one found so far.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    d = df.select(key, lines.alias("_lines")).select(key, "_lines", F.posexplode("_lines").alias("_i", "_line"))
    at = lambda k: F.get("_lines", F.col("_i") + k)
    part = lambda i: F.regexp_extract("_line", r"^(?:[A-Za-z]{3}\s+)?(\d{1,2})[./-](\d{1,2})(?:[./-](\d{4})?)?(?!\d)", i)
    dated = (part(1) != "") & (F.contains(F.col("_line"), F.lit(".")) | F.contains(F.col("_line"), F.lit("/")) | (part(3) != ""))  # "2-1" is a score
    day = F.when(dated, F.try_to_date(F.concat_ws("-", F.coalesce(F.nullif(part(3), F.lit("")), F.lit(str(year))), part(2), part(1)), "yyyy-M-d"))
    d = d.withColumn("match_date", F.last(day, ignorenulls=True).over(Window.partitionBy(key).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)))
    clock = r"^(?:[01]?\d|2[0-3]):[0-5]\d$"
    team = lambda x: (F.length(x) >= 3) & ~F.lower(x).rlike(NO_TEAM) & ~x.rlike(clock)
    rows = d.filter(F.col("_line").rlike(clock) & team(at(1)) & team(at(2)) & (F.lower(at(1)) != F.lower(at(2))))
    return rows.select(key, "match_date", F.col("_line").alias("kickoff_time"), at(1).alias("home_team"), at(2).alias("away_team"), parse_score(at(3)).alias("score"))


def demo_quality(df: DataFrame, demo: str, quality: str, most: float = 0.65, default: float = 0.62) -> DataFrame:
    """Demonstration rows trusted no more than ``most``."""
    is_demo = F.lower(F.col(demo).cast("string")).isin("true", "1", "yes")
    return df.withColumn(quality, F.when(is_demo, F.least(F.coalesce(quality, F.lit(default)), F.lit(most))).otherwise(F.col(quality)))
