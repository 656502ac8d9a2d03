"""Queries over captured payloads, which events and orders are written as."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions import nested
from tallyfield.functions import payloads as f
from tallyfield.functions.text import parse_number, parse_status
from tallyfield.plans.bindings import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _text(c) -> F.Column:
    return c.cast("string")


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE CASE event_id % 4 WHEN 2 THEN 'g_1_' ELSE '' END || 'abc' || CAST(100000 + event_id AS VARCHAR) END AS match_id FROM events""")
def payload_ids(spark, d):
    e, key = table(spark, d, "events"), F.concat(F.lit("abc"), _text(F.col("event_id") + 100000))
    shapes = [F.concat(F.lit("<div data-event='"), key, F.lit("'>")), F.concat(F.lit('{"eventId": "'), key, F.lit('"}')), F.concat(F.lit('<a id="g_1_'), key, F.lit('">')), F.lit("no id here")]
    return e.select("event_id", f.match_id(F.element_at(F.array(*shapes), (F.col("event_id") % 4 + 1).cast("int"))).alias("match_id"))


def _payloads(spark, d):
    """Events as JSON payloads; odd ones lack what is optional."""
    e, i = table(spark, d, "events"), F.col("event_id")
    item = lambda name, home, away: F.struct(F.lit(name).alias("name"), _text(home).alias("home"), _text(away).alias("away"))
    stats = F.array(item("Corner Kicks", i % 9, i % 7), item("Shots on target", i % 5, i % 6), item("Total shots", i % 15, i % 14), item("Expected goals (xG)", (i % 20) / 10, (i % 30) / 10), item("Fouls", i, i))
    market = lambda name, *values: F.struct(F.lit(name).alias("name"), F.array(*[_text(v) for v in values]).alias("values"))
    markets = F.array(market("1X2", 1 + (i % 10) / 10, F.lit("7/2"), F.lit("3,25")), market("Over/Under 2.5", 1 + (i % 4) / 2, F.lit(1.9)), market("Both teams to score", F.lit(1.8), F.lit("-")))
    goal = lambda kind, minute, side: F.struct(F.lit(kind).alias("type"), _text(minute).alias("minute"), F.lit(side).alias("side"))
    events = F.array(goal("Goal", i % 45, "home"), goal("Yellow card", i % 50, "home"), goal("Own goal", i % 60 + 20, "away"), goal("goal", i % 30 + 60, "HOME"))
    full = i % 2 == 0
    json = F.to_json(F.struct(
        F.when(i % 3 != 0, F.concat(F.lit("id"), _text(i))).alias("matchId"), F.concat(F.lit("Team "), _text(i % 40)).alias("homeName"), F.when(i % 11 != 0, F.concat(F.lit("Side "), _text(i % 30))).alias("away_team"), F.concat(_text(i % 4), F.lit("-"), _text(i % 3), F.lit(" (1-0)")).alias("score"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("startTime"), F.lit("Cup").alias("competitionName"), F.lit("Finished").alias("status"), F.when(full, stats).alias("stats"), F.when(full, markets).alias("markets"), F.when(full, events).alias("events"),
    ))
    return e.select("event_id", json.alias("json"))


@query("""SELECT event_id, CAST(event_id % 9 AS INT) AS corners_home, CAST(event_id % 7 AS INT) AS corners_away, CAST(event_id % 5 AS INT) AS shots_on_target_home, CAST(event_id % 6 AS INT) AS shots_on_target_away, CAST(event_id % 15 AS INT) AS shots_home, CAST(event_id % 14 AS INT) AS shots_away,
(event_id % 20) / 10.0 AS xg_home, (event_id % 30) / 10.0 AS xg_away FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM events WHERE event_id % 2 = 1""")
def stat_columns(spark, d):
    stats = F.from_json(F.get_json_object("json", "$.stats"), f.STATS_SCHEMA)
    return _payloads(spark, d).select("event_id", *[f.stat_number(n, parse_number(c)).alias(n) for n, c in f.stat_texts(stats).items()])


@query("""SELECT event_id, 1 + (event_id % 10) / 10.0 AS odds_home, 4.5::DOUBLE AS odds_draw, 3.25::DOUBLE AS odds_away, NULL::DOUBLE AS odds_over_05, NULL::DOUBLE AS odds_under_05, NULL::DOUBLE AS odds_over_15, NULL::DOUBLE AS odds_under_15,
1 + (event_id % 4) / 2.0 AS odds_over_25, 1.9::DOUBLE AS odds_under_25, 1.8::DOUBLE AS odds_btts_yes, NULL::DOUBLE AS odds_btts_no FROM events WHERE event_id % 2 = 0""")
def price_columns(spark, d):
    markets = F.from_json(F.get_json_object("json", "$.markets"), f.MARKETS_SCHEMA)
    return _payloads(spark, d).filter("event_id % 2 = 0").select("event_id", *[parse_number(c).alias(n) for n, c in f.price_texts(markets).items()])


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 45 AS VARCHAR) || ',' || CAST(event_id % 30 + 60 AS VARCHAR) END AS home, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 60 + 20 AS VARCHAR) END AS away FROM events""")
def goal_minutes(spark, d):
    events = F.from_json(F.get_json_object("json", "$.events"), f.EVENTS_SCHEMA)
    return _payloads(spark, d).select("event_id", *[F.array_join(f.goal_minutes(events, side), ",").alias(side) for side in ("home", "away")])


@query("""SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 'id' || CAST(event_id AS VARCHAR) ELSE 'fallback_cup_' || replace(CAST(CAST(ts AS DATE) AS VARCHAR), '-', '_') || '_team_' || CAST(event_id % 40 AS VARCHAR) || '_side_' || CAST(event_id % 30 AS VARCHAR) END AS match_id,
CAST(event_id % 4 AS INT) AS goals_home, 'finished' AS status, CASE WHEN event_id % 3 <> 0 THEN 0.8 ELSE 0.64 END::DOUBLE AS data_quality_score,
'structured_capture' || CASE WHEN event_id % 3 = 0 THEN ';missing_flashscore_match_id;fallback_provider_match_id_generated' ELSE '' END || CASE WHEN event_id % 2 = 1 THEN ';optional_fields_missing:odds_home,odds_over_25,corners_home,shots_home,xg_home' ELSE '' END AS provider_warnings
FROM events WHERE event_id % 11 <> 0""")
def structured_rows(spark, d):
    rows = f.structured_rows(_payloads(spark, d), "json", ["event_id"])
    return rows.select("event_id", "match_id", F.col("_score.home_ft").alias("goals_home"), "status", "data_quality_score", "provider_warnings")


@query("""WITH o AS (SELECT o_orderkey, o_custkey % 28 + 1 AS day, o_orderkey % 12 + 1 AS month FROM orders)
SELECT o_orderkey, make_date(2024, CAST(month AS INT), CAST(day AS INT)) AS match_date, '18:30' AS kickoff_time, 'Team ' || CAST(o_custkey AS VARCHAR) AS home_team, 'Second' AS away_team, 2 AS goals_home FROM o JOIN orders USING (o_orderkey)
UNION ALL SELECT o_orderkey, make_date(2024, CAST(month AS INT), CAST(day AS INT)), '20:00', 'Third', 'Fourth', NULL FROM o WHERE o_orderkey % 2 = 0""")
def text_rows(spark, d):
    o = table(spark, d, "orders")
    lines = F.concat_ws("\n", F.lit("noise"), F.concat(_text(F.col("o_custkey") % 28 + 1), F.lit("."), _text(F.col("o_orderkey") % 12 + 1), F.lit(".")), F.lit(" 18:30 "), F.concat(F.lit("Team "), _text(F.col("o_custkey"))), F.lit("Second"), F.lit("2-1"), F.lit(""), F.lit("20:00"), F.lit("Third"), F.when(F.col("o_orderkey") % 2 == 0, "Fourth").otherwise("THIRD"), F.lit("end"))
    rows = f.text_rows(o.select("o_orderkey", lines.alias("text")), "o_orderkey", "text", 2024)
    return rows.select("o_orderkey", "match_date", "kickoff_time", "home_team", "away_team", F.col("score.home_ft").alias("goals_home"))


@query("""SELECT event_id, ['odds', 'stats', 'events', 'standings', 'fixtures', 'unknown'][CAST(event_id % 6 + 1 AS INT)] AS kind FROM events""")
def payload_kinds(spark, d):
    urls = ["/prematch/list", "/xg/per-team", "/substitution", "/league-table", "/next-fixtures", "/other"]
    return table(spark, d, "events").select("event_id", f.payload_kind(F.element_at(F.array(*map(F.lit, urls)), (F.col("event_id") % 6 + 1).cast("int")), F.lit("{}")).alias("kind"))


@query("""WITH q AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN (event_id % 100) / 100.0 END AS q FROM events) SELECT event_id, CASE WHEN event_id % 3 = 0 THEN least(coalesce(q, 0.62), 0.65) ELSE q END::DOUBLE AS quality FROM q""")
def demo_quality(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 100) / 100).alias("quality"), F.when(F.col("event_id") % 3 == 0, F.lit("Yes")).otherwise("no").alias("demo"))
    return f.demo_quality(e, "demo", "quality").select("event_id", "quality")


#: Payloads by event type as sources nest them; {e}, {u} and {x} stand for an event's id, user and whole value.
SHAPES = {
    "click": '{"data": {"stage": {"events": [{"id": "ev{e}abc", "homeName": "Home {u}", "awayName": "Away {x}", "score": "2-1 (1-0)", "status": "After Penalties", "stats": {"Corners": "{x}-4", "Shots on target": [3, {u}], "xG": {"home": "1,25", "away": 0.5}}, "markets": {"1X2": {"home": 1.5, "draw": "7/2", "away": 6}, "Over/Under 2.5": {"over": 1.8, "under": {x}.5}, "Both teams to score": {"yes": 1.7, "no": "-"}}, "incidents": [{"incidentType": "Goal", "time": "{x}", "teamSide": "home"}, {"eventType": "goal", "matchTime": 77, "participant": "away"}, {"type": "card", "minute": 3, "side": "home"}]}]}}}',
    "view": '[{"home": {"shortName": "Home {u}"}, "away": {"name": "Away {x}"}, "score": {"home": 3, "away": "{x}", "homeHT": 1}, "league": "Cup", "date": "2024-03-05T18:00", "statistics": [{"statName": "Total shots", "h": {x}, "a": 9}, {"categoryName": "corner kicks", "homeValue": 5, "awayValue": {u}}], "bookmakers": [{"label": "h2h", "outcomes": [{"decimal": 2.1}, {"price": 3.3}, {"odds": "4.4"}]}, {"marketName": "Total goals 1.5", "selections": [1.3, {u}.25]}], "stage": "2nd half", "events": []}, {"home": "only one"}, 5]',
    "error": 'no json {"home": "a", "away": "b"}',
    "signup": '{"home_team": "", "home": "Home {u}", "away": {"x": 1}, "awayName": "Away {x}", "status": "To finish", "match_id": "g_1_m{e}"}',
    "purchase": '{"list": [{"homeParticipantName": "Home {u}", "awayParticipantName": "Away {x}", "matchStatus": "Canceled", "link": "/match/Zz{e}9999", "competitionName": "League", "startTime": "2024-02-0{p}", "data_quality_score": "0.9", "provider_warnings": "w", "extra": {"homeName": "Inner {u}", "awayName": "Inner {x}"}}]}',
}


def _shaped(spark, d):
    e = table(spark, d, "events")
    json = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in SHAPES.items()])
    for mark, value in (("{e}", F.col("event_id")), ("{u}", F.col("user_id")), ("{x}", F.floor("value")), ("{p}", F.col("event_id") % 9 + 1)):
        json = F.replace(json, F.lit(mark), _text(value))
    return e.select("event_id", json.alias("json"))


_SHAPED = "shaped AS (SELECT event_id, event_type, user_id AS u, CAST(floor(value) AS BIGINT) AS x, replace(replace(replace(replace(CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SHAPES.items()) + " END, '{e}', CAST(event_id AS VARCHAR)), '{u}', CAST(user_id AS VARCHAR)), '{x}', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)), '{p}', CAST(event_id % 9 + 1 AS VARCHAR)) AS json FROM events)"


@query(f"""WITH {_SHAPED}, tree AS (SELECT event_id, unnest(t) AS t FROM (SELECT event_id, (SELECT list(t) FROM json_tree(s.json) t) AS t FROM shaped s WHERE json_valid(json)))
SELECT event_id, replace(t.fullkey, '"', '') AS path, CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'value' END AS kind, CASE WHEN t.type NOT IN ('OBJECT', 'ARRAY') THEN t.atom->>'$' END AS text FROM tree""")
def payload_nodes(spark, d):
    """Every value in the payloads, whatever they look like."""
    n = nested.nodes(_shaped(spark, d), ["event_id"], "json")
    return n.select("event_id", "path", "kind", F.expr("CASE WHEN kind = 'value' THEN try_variant_get(value, '$', 'string') END").alias("text"))


@query(f"""WITH {_SHAPED}, rows AS (
SELECT event_id, '$.data.stage.events[0]' AS path, 'ev' || event_id || 'abc' AS match_id, 'Unknown League' AS league, 'Home ' || u AS home_team, 'Away ' || x AS away_team, 'finished' AS status, 2 AS goals_home, 1 AS goals_away, 1 AS half_home,
 x AS corners_home, 4 AS corners_away, NULL AS shots_home, 3 AS on_target_home, u AS on_target_away, 1.25 AS xg_home, 1.5 AS odds_home, 4.5 AS odds_draw, 6.0 AS odds_away, NULL AS over_15, NULL AS under_15, 1.8 AS over_25, x + 0.5 AS under_25, 1.7 AS btts_yes, NULL AS btts_no,
 CAST(x AS VARCHAR) AS minutes_home, '77' AS minutes_away, 0.8 AS quality, 'structured_capture;optional_fields_missing:shots_home' AS warnings FROM shaped WHERE event_type = 'click'
UNION ALL SELECT event_id, '$[0]', 'fallback_cup_2024_03_05_home_' || u || '_away_' || x, 'Cup', 'Home ' || u, 'Away ' || x, 'live', 3, x, 1, 5, u, x, NULL, NULL, NULL, 2.1, 3.3, 4.4, 1.3, u + 0.25, NULL, NULL, NULL, NULL, NULL, NULL, 0.64,
 'structured_capture;missing_flashscore_match_id;fallback_provider_match_id_generated;optional_fields_missing:odds_over_25,xg_home' FROM shaped WHERE event_type = 'view'
UNION ALL SELECT event_id, '$.list[0]', 'Zz' || event_id || '9999', 'League', 'Home ' || u, 'Away ' || x, 'postponed', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0.9,
 'w;optional_fields_missing:odds_home,odds_over_25,corners_home,shots_home,xg_home' FROM shaped WHERE event_type = 'purchase') SELECT * FROM rows""")
def captured_rows(spark, d):
    """Matches anywhere in the payloads, in whichever of the known shapes."""
    r = nested.captured_rows(_shaped(spark, d), ["event_id"], "json")
    names = {"_score.home_ft": "goals_home", "_score.away_ft": "goals_away", "_score.home_ht": "half_home", "corners_home": "corners_home", "corners_away": "corners_away", "shots_home": "shots_home", "shots_on_target_home": "on_target_home", "shots_on_target_away": "on_target_away", "xg_home": "xg_home"}
    names |= {"odds_home": "odds_home", "odds_draw": "odds_draw", "odds_away": "odds_away", "odds_over_15": "over_15", "odds_under_15": "under_15", "odds_over_25": "over_25", "odds_under_25": "under_25", "odds_btts_yes": "btts_yes", "odds_btts_no": "btts_no"}
    minutes = [F.array_join(F.transform(f"goal_minutes_{side}", lambda m: m.cast("string")), ",").alias(f"minutes_{side}") for side in ("home", "away")]
    return r.select("event_id", "path", "match_id", "league", "home_team", "away_team", "status", *[F.col(a).alias(b) for a, b in names.items()], *minutes, F.col("data_quality_score").alias("quality"), F.col("provider_warnings").alias("warnings"))


#: Status texts, addresses and bodies that reach every rule, each with what it stands for.
STATUSES = {"AET": "finished", "After Penalties": "finished", "FT": "finished", "Full Time": "finished", "HT": "live", "1st half": "live", "Live now": "live", "Cancelled": "postponed", "Postponed": "postponed", "To finish": "to_finish", "": "scheduled"}
CAPTURES = [("/x/status", "{}", "unknown"), ("/x/station", '{"markets": []}', "odds"), ("/x", '{"Statistics": 1}', "stats"), ("/statistics", "", "stats"), ("/prematch", "", "odds"), ("/league-table", "", "standings"), ("/next-fixture", "", "fixtures"), ("/substitution", "", "events"), ("/x", "[1]", "unknown"), ("/x", '{"incidents": []}', "events")]


@query("WITH o AS (SELECT o_orderkey, CAST(o_custkey % " + str(len(STATUSES)) + " AS INT) + 1 AS i, CAST(o_custkey % " + str(len(CAPTURES)) + " AS INT) + 1 AS j FROM orders) SELECT o_orderkey, [" + ", ".join(f"'{v}'" for v in STATUSES.values()) + "][i] AS status, [" + ", ".join(f"'{c[2]}'" for c in CAPTURES) + "][j] AS kind, CASE WHEN i % 2 = 0 THEN 'AbC' || CAST(o_orderkey + 1000 AS VARCHAR) END AS match_id FROM o")
def capture_rules(spark, d):
    """Statuses, kinds of responses and ids in addresses, by every rule."""
    o = table(spark, d, "orders")
    at = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("o_custkey") % n + 1).cast("int"))
    pick = [at([c[k] for c in CAPTURES], len(CAPTURES)) for k in (0, 1)]
    address = F.concat(F.when(F.col("o_custkey") % len(STATUSES) % 2 == 1, "https://a.example/#/match/").otherwise("https://a.example/"), F.lit("AbC"), _text(F.col("o_orderkey") + 1000))
    return o.select("o_orderkey", parse_status(at(list(STATUSES), len(STATUSES))).alias("status"), f.payload_kind(*pick).alias("kind"), f.match_id(address).alias("match_id"))
