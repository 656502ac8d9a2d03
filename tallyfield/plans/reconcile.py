"""Queries over names, sources, duplicates, parsing and the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions import text as T
from tallyfield.operators import reconcile as rec
from tallyfield.operators import resolve
from tallyfield.plans.bindings import table
from tallyfield.session import fresh_path
from tallyfield.streaming import ledger

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


_DROP = ", ".join(f"'{w}'" for w in T.EMPTY_WORDS)
_SHORT = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.SHORT_FORMS.items()) + " ELSE w END"


@query(f"""WITH w AS (SELECT p_partkey, list_transform(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(p_name), '&', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''), lambda w: {_SHORT}) AS w FROM part),
k AS (SELECT *, list_filter(w, lambda x: x NOT IN ({_DROP})) AS kept FROM w) SELECT p_partkey, array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE w END, ' ') AS name FROM k""")
def normalize_text(spark, d):
    return table(spark, d, "part").select("p_partkey", T.normalise_name("p_name").alias("name"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS slug, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS key FROM part")
def slugs_and_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", T.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), T.team_key("p_brand").alias("key"))


@query("SELECT o_orderkey, substr(sha1(CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_custkey AS VARCHAR) || '|' || o_orderstatus || '|' || o_orderpriority), 1, 16) AS id FROM orders")
def stable_ids(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.stable_id("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").alias("id"))


@query("SELECT o_orderkey, len(list_distinct([o_orderstatus, 'X', o_orderstatus])) AS n_flags, o_orderstatus || '|X' AS flags FROM orders")
def flag_parse(spark, d):
    raw = F.concat(F.lit("["), F.col("o_orderstatus"), F.lit(", 'X'; "), F.col("o_orderstatus"), F.lit("|X]"))
    return table(spark, d, "orders").select("o_orderkey", T.parse_flags(raw).alias("f")).select("o_orderkey", F.size("f").cast("long").alias("n_flags"), F.array_join("f", "|").alias("flags"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type || '|' || CAST(user_id AS VARCHAR) AS identity FROM events")
def json_props(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", T.first_path("props", "$.none", "$.k").cast("long").alias("k"), T.match_identity(F.lit(None).cast("string"), "event_type", "user_id").alias("identity"))


@query("SELECT o_orderkey, CAST(o_orderkey % 6 AS INTEGER) AS home, CAST(o_custkey % 5 AS INTEGER) AS away, CAST(o_orderkey % 3 AS INTEGER) AS home_half, 1.0 + (o_custkey % 4) / (1.0 + o_orderkey % 3) AS price FROM orders")
def score_parse(spark, d):
    o = table(spark, d, "orders")
    s = T.parse_score(F.format_string("%d-%d (%d-0)", F.col("o_orderkey") % 6, F.col("o_custkey") % 5, F.col("o_orderkey") % 3))
    price = T.parse_number(F.format_string("%d/%d", F.col("o_custkey") % 4, 1 + F.col("o_orderkey") % 3))
    return o.select("o_orderkey", s.alias("s"), price.alias("price")).select("o_orderkey", F.col("s.home_ft").alias("home"), F.col("s.away_ft").alias("away"), F.col("s.home_ht").alias("home_half"), "price")


@query("""WITH s AS (SELECT l_partkey, l_suppkey % 4 AS src, l_returnflag, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END AS status, l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem),
r AS (SELECT *, CASE src WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS rk FROM s)
SELECT l_partkey, arg_min(l_returnflag, (rk, l_orderkey, l_linenumber, l_quantity, l_extendedprice)) AS l_returnflag, arg_min(status, (rk, l_orderkey, l_linenumber, l_quantity, l_extendedprice)) FILTER (status IS NOT NULL) AS status,
array_to_string(list_sort(list(DISTINCT CAST(src AS VARCHAR))), ',') AS sources, count(*) AS merged_rows, CAST(count(DISTINCT l_returnflag) > 1 AS INTEGER) + CAST(count(DISTINCT status) > 1 AS INTEGER) AS conflicts FROM r GROUP BY 1""")
def priority_dedup(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", (F.col("l_suppkey") % 4).cast("string").alias("src"), "l_returnflag", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).alias("status"), "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    m = resolve.merge_sources(rows, "l_partkey", "src", {"2": 0, "0": 1}, ["l_returnflag", "status"], ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])
    return m.withColumn("sources", F.array_join("sources", ","))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, CAST(l_partkey % 2 = 0 AS INTEGER) + CAST(l_suppkey % 3 = 0 AS INTEGER) AS filled FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, filled FROM f QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY filled DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1""")
def most_complete_dedup(spark, d):
    rows = table(spark, d, "lineitem").withColumn("a", F.when(F.col("l_partkey") % 2 == 0, "x")).withColumn("b", F.when(F.col("l_suppkey") % 3 == 0, "y"))
    best = resolve.most_complete(rows, ["l_orderkey", "l_linenumber"], ["a", "b"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return best.select("l_orderkey", "l_linenumber", "l_partkey", "filled")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders), r AS (SELECT o_custkey, o_orderkey AS other, CAST(o_orderdate AS DATE) AS oday FROM orders WHERE o_orderkey % 3 = 0),
j AS (SELECT o.*, other, CAST(oday - day AS INTEGER) AS off FROM o LEFT JOIN r ON o.o_custkey = r.o_custkey AND abs(oday - day) <= 30)
SELECT o_orderkey, other AS matched_other, off AS days_off FROM j QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY other IS NULL, abs(off), off, other) = 1""")
def date_tolerance_join(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    r = o.filter("o_orderkey % 3 = 0").select("o_custkey", F.col("o_orderkey").alias("other"), "day")
    return resolve.nearest_date_join(o, r, ["o_custkey"], "day", "day", ["other"], ["other"], "o_orderkey", 30).select("o_orderkey", "matched_other", "days_off")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_join_new(spark, d):
    known = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return resolve.only_new(table(spark, d, "customer"), known, ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_join_orders(spark, d):
    """Orders none of whose lines came back."""
    back = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return resolve.only_new(table(spark, d, "orders"), back, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND s_name IS NOT NULL THEN s_name WHEN c_custkey % 3 <> 0 THEN c_name END AS name,
CASE WHEN c_custkey % 5 < 2 AND s_name IS NOT NULL THEN 'segment-' || CAST(s_nationkey AS VARCHAR) ELSE c_mktsegment END AS segment, CAST(coalesce(c_custkey % 3 = 0 AND s_name IS NOT NULL, false) AS INTEGER) + CAST(coalesce(c_custkey % 5 < 2 AND s_name IS NOT NULL, false) AS INTEGER) AS n_filled
FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def enrich_by_policy(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_custkey") % 5 < 2, 0.4).otherwise(0.9).alias("quality"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("name"), F.concat(F.lit("segment-"), F.col("s_nationkey").cast("string")).alias("segment"))
    return resolve.enrich(c, s, ["c_custkey"], {"name": "fill", "segment": "low"}, "quality").select("c_custkey", "name", "segment", F.size("filled").alias("n_filled"))


@query("""WITH q AS (SELECT p_partkey, round(least(greatest(0.22 * (p_size % 3) / 2.0 + 0.18 * (p_partkey % 2) + 0.24 * (p_size % 5) / 4.0 + 0.14 * 0.5 + 0.12 * (p_partkey % 4) / 3.0 + 0.10 * (1 - 0.25) - 0.08 * (p_size % 2), 0), 1), 6) AS quality FROM part)
SELECT p_partkey, quality, CASE WHEN quality >= 0.82 THEN 'EXCELLENT' WHEN quality >= 0.62 THEN 'GOOD' WHEN quality >= 0.42 THEN 'FAIR' ELSE 'POOR' END AS band FROM q""")
def source_quality(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    score = resolve.quality_score(size % 3 / F.lit(2.0), key % 2, size % 5 / F.lit(4.0), F.lit(0.5), key % 4 / F.lit(3.0), F.lit(0.25), size % 2)
    return table(spark, d, "part").select("p_partkey", score.alias("quality")).withColumn("band", resolve.quality_band(F.col("quality")))


@query("SELECT count(*) AS rows, CAST(count(*) FILTER (o_orderkey % 7 = 0) AS BIGINT) AS bad_dates, CAST(count(*) FILTER (o_orderkey % 5 = 0) AS BIGINT) AS missing_teams, CAST(count(*) FILTER (o_orderkey % 5 <> 0 AND o_custkey = o_orderkey) AS BIGINT) AS same_team FROM orders")
def quality_gate(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 7 == 0, "no date").otherwise(F.col("o_orderdate").cast("string")).alias("day"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey").cast("string")).alias("home"), F.col("o_custkey").cast("string").alias("away"))
    return resolve.content_checks(o, "day", "home", "away")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 24 AS hr FROM orders)
SELECT o_orderkey, coalesce(day <> first_value(day) OVER w OR abs(hr - first_value(hr) OVER w) > 3, false) AS conflict FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY day, o_orderkey)""")
def kickoff_conflict(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 24).alias("hr"))
    return resolve.kickoff_conflicts(o, "o_custkey", "day", "hr", ["day", "o_orderkey"]).select("o_orderkey", "conflict")


_SIGNALS = "o_orderkey % 4 <> 0"


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS signal_id, CASE WHEN ok THEN 'SETTLED' ELSE 'PENDING' END AS status, CASE WHEN ok THEN round(CASE WHEN o_custkey % 2 = 0 THEN odd - 1 ELSE -1.0 END, 4) END AS profit
FROM (SELECT *, 1 + (o_orderkey % 9) / 10.0 AS odd, CAST(o_orderdate AS DATE) <= DATE '1997-01-01' AND o_orderkey % 4 <> 0 AND o_orderkey % 9 > 0 AS ok FROM orders)""")
def ledger_batch(spark, d):
    o = table(spark, d, "orders")
    return ledger.settle(_signals(o), _outcomes(o), F.lit("1997-01-01").cast("date")).select("signal_id", "status", "profit")


def _signals(o):
    return o.select(F.col("o_orderkey").cast("string").alias("signal_id"), F.to_date("o_orderdate").alias("due"), (1 + (F.col("o_orderkey") % 9) / 10).alias("odd"), F.lit(1.0).alias("stake"))


def _outcomes(o):
    return o.filter(_SIGNALS).select(F.col("o_orderkey").cast("string").alias("signal_id"), (F.col("o_custkey") % 2 == 0).alias("is_win"))


@query(SQL["ledger_batch"])
def ledger_stream(spark, d):
    """The same ledger, kept by a stream over the files of the orders."""
    o = table(spark, d, "orders")
    stream = spark.readStream.schema(o.schema).parquet(f"{d}/orders.parquet*")
    return ledger.run_stream(spark, _signals(stream), _outcomes(o), fresh_path(spark, "ledger"), "1997-01-01").select("signal_id", "status", "profit")


_SOURCES = """o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, o_custkey % 50 AS h, o_orderkey % 5 AS a, o_orderstatus, o_totalprice FROM orders),
flat AS (SELECT id, date, h, a, CASE WHEN id % 2 = 0 THEN o_orderstatus END AS status, CASE WHEN id % 7 = 0 THEN CAST(id % 4 AS VARCHAR) || '-1' END AS score, NULL::DOUBLE AS odd FROM o WHERE id % 3 <> 1),
api AS (SELECT id, date + CAST(id % 4 - 1 AS INTEGER) AS date, h, a, o_orderstatus AS status, CASE WHEN id % 5 <> 0 THEN '2-2' ELSE '' END AS score, NULL::DOUBLE AS odd FROM o WHERE id % 3 <> 0),
quotes AS (SELECT id, date, h, a, NULL AS status, NULL AS score, CASE WHEN id % 6 <> 0 THEN o_totalprice END AS odd FROM o WHERE id % 2 = 0)"""


def _sources(spark, d):
    """Orders as matches of three sources, which write names and dates in their own ways."""
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "id").withColumn("date", F.to_date("o_orderdate"))
    i = F.col("id")
    home, away = (F.col("o_custkey") % 50).cast("string"), (i % 5).cast("string")
    flat = o.filter("id % 3 <> 1").select("id", "date", F.concat(F.lit("Téam "), home).alias("home_team"), F.concat(F.lit("Side "), away).alias("away_team"), F.when(i % 2 == 0, F.col("o_orderstatus")).alias("status"), F.when(i % 7 == 0, F.concat((i % 4).cast("string"), F.lit("-1"))).alias("score"))
    api = o.filter("id % 3 <> 0").select("id", F.date_add("date", (i % 4 - 1).cast("int")).alias("date"), F.concat(F.lit("TEAM "), home, F.lit(" FC")).alias("home_team"), F.concat(F.lit("side-"), away).alias("away_team"), F.col("o_orderstatus").alias("status"), F.when(i % 5 != 0, "2-2").otherwise("").alias("score"))
    odds = o.filter("id % 2 = 0").select("id", "date", F.concat(F.lit("team "), home).alias("home_team"), F.concat(F.lit("Side "), away).alias("away_team"), F.when(i % 6 != 0, F.col("o_totalprice")).alias("odd"))
    return rec.Source("flat", flat), [rec.Source("api", api, ["status", "score"], adds=True), rec.Source("quotes", odds, ["odd"])]


@query(f"""WITH {_SOURCES}, e AS (SELECT date, h, a, max(id) AS t FROM flat GROUP BY 1, 2, 3), n AS (SELECT date + off AS date, h, a, min(id) AS t FROM flat, (VALUES (-1), (1)) v(off) GROUP BY 1, 2, 3),
k AS (SELECT date, h, a, coalesce(e.t, n.t) AS t FROM e FULL JOIN n USING (date, h, a)),
ga AS (SELECT t, arg_min(status, api.id) FILTER (status IS NOT NULL) AS status, arg_min(score, api.id) FILTER (score <> '') AS score FROM api JOIN k USING (date, h, a) GROUP BY 1),
gq AS (SELECT t, arg_min(odd, quotes.id) FILTER (odd IS NOT NULL) AS odd FROM quotes JOIN k USING (date, h, a) GROUP BY 1),
w AS (SELECT 'flat' AS data_source, 1 AS rk, f.id, f.date, f.h, f.a, coalesce(f.status, ga.status) AS status, coalesce(f.score, ga.score) AS score, gq.odd,
  concat_ws('|', CASE WHEN (f.status IS NULL AND ga.status IS NOT NULL) OR (f.score IS NULL AND ga.score IS NOT NULL) THEN 'api' END, CASE WHEN gq.odd IS NOT NULL THEN 'quotes' END) AS filled_from
  FROM flat f LEFT JOIN ga ON ga.t = f.id LEFT JOIN gq ON gq.t = f.id
UNION ALL SELECT 'api', 2, api.id, api.date, api.h, api.a, api.status, api.score, NULL, '' FROM api LEFT JOIN k USING (date, h, a) WHERE k.t IS NULL)
SELECT data_source, id, date, h, a, status, score, odd, filled_from FROM w
QUALIFY row_number() OVER (PARTITION BY date, h, a ORDER BY CAST(status IS NOT NULL AS INT) + CAST(coalesce(score, '') <> '' AS INT) + CAST(odd IS NOT NULL AS INT) DESC, rk, id) = 1""")
def reconciled_matches(spark, d):
    """Matches of three sources as one table."""
    primary, others = _sources(spark, d)
    r = rec.reconcile(primary, others, ["status", "score", "odd"])
    number = lambda c: F.regexp_extract(c, "([0-9]+)", 1).cast("long")
    return r.select("data_source", "id", "date", number("home_team").alias("h"), number("away_team").alias("a"), "status", "score", "odd", F.array_join("filled_from", "|").alias("filled_from"))


@query(f"""WITH {_SOURCES}, s AS (SELECT 'flat' AS source, 0 AS rk, id, date, h, a, status, score, odd FROM flat UNION ALL SELECT 'api', 1, id, date, h, a, status, nullif(score, ''), odd FROM api UNION ALL SELECT 'quotes', 2, id, date, h, a, status, score, odd FROM quotes),
g AS (SELECT date, h, a, arg_min(status, (rk, id)) FILTER (status IS NOT NULL) AS status, arg_min(score, (rk, id)) FILTER (score IS NOT NULL) AS score, arg_min(odd, (rk, id)) FILTER (odd IS NOT NULL) AS odd,
  count(DISTINCT source) AS n, count(*) AS merged_rows, CAST(count(DISTINCT status) > 1 AS INT) + CAST(count(DISTINCT score) > 1 AS INT) + CAST(count(DISTINCT odd) > 1 AS INT) AS conflicts FROM s GROUP BY 1, 2, 3),
q AS (SELECT *, round(least(greatest(0.22 * 1.0 + 0.18 * 1 + 0.24 * (CAST(status IS NOT NULL AS INT) + CAST(score IS NOT NULL AS INT) + CAST(odd IS NOT NULL AS INT)) / 3.0 + 0.14 * (1 - conflicts / 7.0) + 0.12 * least(n / 3.0, 1.0) + 0.10 * (1 - least((merged_rows - n) / 4.0, 1.0)) - 0.08 * conflicts, 0), 1), 6) AS quality FROM g)
SELECT CAST(date AS VARCHAR) AS date, 'team_' || h AS home_id, 'side_' || a AS away_id, status, score, odd, merged_rows, conflicts, false AS needs_review, 1.0 AS mapping_confidence, quality, CASE WHEN quality >= 0.82 THEN 'EXCELLENT' WHEN quality >= 0.62 THEN 'GOOD' WHEN quality >= 0.42 THEN 'FAIR' ELSE 'POOR' END AS band FROM q""")
def canonical_matches(spark, d):
    """The same sources mapped to canonical teams, merged by identity and scored."""
    primary, others = _sources(spark, d)
    rows = None
    for s in (primary, *others):
        one = s.table.withColumn("source", F.lit(s.name)).withColumn("league", F.lit("Cup"))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    names = spark.range(50).select(F.format_string("team_%d", "id").alias("canonical_id"), F.format_string("Team %d", "id").alias("canonical_name"))
    names = names.union(spark.range(5).select(F.format_string("side_%d", "id"), F.format_string("Side %d", "id")))
    leagues = spark.createDataFrame([("cup", "Cup")], "canonical_id string, canonical_name string")
    m = rec.canonicalise(rows, names, leagues, ["status", "score", "odd"], {"flat": 0, "api": 1, "quotes": 2})
    return m.select("date", "home_id", "away_id", "status", "score", "odd", "merged_rows", "conflicts", "needs_review", "mapping_confidence", "quality", "band")
