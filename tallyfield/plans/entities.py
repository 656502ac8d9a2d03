"""Queries over names and the entities they stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions import text as T
from tallyfield.operators import entities, resolve
from tallyfield.plans.bindings import table

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


def _norm(x: str) -> str:
    """A normalised name in SQL, for names of plain letters."""
    words = f"list_transform(list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''), lambda w: {_SHORT})"
    return f"array_to_string(list_filter({words}, lambda w: w NOT IN ({_DROP})), ' ')"


#: The longest common subsequence in SQL, a bit for each character of a: scored (norm, canon, score) of all pairs of asked (norm) and named (normalized).
_SCORED = """scored AS MATERIALIZED (
  SELECT norm, canon, 200.0 * (len(a) - bit_count(list_reduce(list_prepend(f, list_transform(string_split(b, ''),
    lambda ch: CAST(list_sum(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN substr(a, i, 1) = ch THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END)) AS BIGINT))),
    lambda v, m: ((v + (v & m)) | (v & ~m)) & f))) / (len(a) + len(b)) AS score
  FROM (SELECT *, (CAST(1 AS BIGINT) << len(a)) - 1 AS f FROM (
    SELECT q.norm, c.normalized AS canon, array_to_string(list_sort(string_split(q.norm, ' ')), ' ') AS a, array_to_string(list_sort(string_split(c.normalized, ' ')), ' ') AS b FROM asked q CROSS JOIN named c)
    WHERE 200 * least(len(a), len(b)) >= 82 * (len(a) + len(b)))),
likely AS MATERIALIZED (SELECT norm, arg_min(canon, (-score, canon)) AS canon, max(score) AS score FROM scored WHERE score >= 82 GROUP BY norm)"""


@query(f"""WITH names AS (SELECT DISTINCT p_name || 's' AS name FROM part), canon AS (SELECT DISTINCT p_name AS canonical FROM part),
named AS (SELECT {_norm("canonical")} AS normalized, min(canonical) AS canonical FROM canon GROUP BY 1),
n AS (SELECT name, {_norm("name")} AS norm FROM names), asked AS (SELECT DISTINCT norm FROM n WHERE norm NOT IN (SELECT normalized FROM named)), {_SCORED}
SELECT n.name, coalesce(e.canonical, c.canonical) AS canonical, round(CASE WHEN e.canonical IS NOT NULL THEN 100.0 ELSE l.score END, 3) AS score,
  CASE WHEN e.canonical IS NOT NULL THEN 'exact' WHEN l.score >= 92 THEN 'fuzzy' WHEN l.score >= 82 THEN 'review' ELSE 'unresolved' END AS status
FROM n LEFT JOIN named e ON e.normalized = n.norm LEFT JOIN likely l USING (norm) LEFT JOIN named c ON c.normalized = l.canon""")
def fuzzy_match(spark, d):
    """Names with a letter more against canonical ones."""
    part = table(spark, d, "part")
    return resolve.fuzzy_entities(part.select(F.concat("p_name", F.lit("s")).alias("name")), part.select("p_name"), "name", "p_name")


_WHOLE = "p_name || ' ' || lower(p_type)"

#: Rows of raw names as sources write them, and the tables that a registry holds. Every way through the cascade occurs in them.
_NAMES = f"""raw AS (SELECT p_partkey, 'p' || p_partkey % 4 AS provider, CASE WHEN p_partkey % 10 = 0 THEN CAST(p_partkey AS VARCHAR) END AS provider_id,
  CASE WHEN p_partkey % 25 = 1 THEN 'The Alias ' || p_partkey % 50 WHEN p_partkey % 17 = 3 THEN 'zz' || p_partkey WHEN p_partkey % 29 = 5 THEN NULL
    WHEN p_partkey % 3 = 0 THEN substr(w, 1, p_partkey % len(w)) || substr(w, p_partkey % len(w) + 2)
    WHEN p_partkey % 3 = 1 THEN upper(lower(p_type) || ' ' || replace(p_name, 'e', 'ee')) ELSE w || ' F.C.' END AS raw_name
  FROM (SELECT *, {_WHOLE} AS w FROM part)),
canon AS (SELECT DISTINCT replace({_WHOLE}, ' ', '_') AS canonical_id, {_WHOLE} AS canonical_name FROM part),
provider_ids AS (SELECT 'p' || p_partkey % 4 AS provider, CAST(p_partkey AS VARCHAR) AS provider_id, replace({_WHOLE}, ' ', '_') AS canonical_id FROM part WHERE p_partkey % 20 = 0),
aliases AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'p' || p_partkey % 4 END AS provider, 'the alias ' || p_partkey AS alias, replace({_WHOLE}, ' ', '_') AS canonical_id FROM part WHERE p_partkey < 50 AND p_partkey % 25 = 1)"""

_CASCADE = f"""{_NAMES},
alias AS (SELECT provider, {_norm("alias")} AS normalized, canonical_id FROM aliases),
named AS (SELECT normalized, min(canonical_id) AS canonical_id FROM (SELECT {_norm("canonical_name")} AS normalized, canonical_id FROM canon UNION ALL SELECT normalized, canonical_id FROM alias) GROUP BY 1),
base AS (SELECT r.*, nullif({_norm("raw_name")}, '') AS normalized FROM raw r),
known AS (SELECT b.*, p.canonical_id AS by_id, coalesce(o.canonical_id, a.canonical_id) AS by_alias, n.canonical_id AS by_name FROM base b
  LEFT JOIN provider_ids p USING (provider, provider_id) LEFT JOIN alias o ON o.provider = b.provider AND o.normalized = b.normalized
  LEFT JOIN alias a ON a.provider IS NULL AND a.normalized = b.normalized LEFT JOIN named n ON n.normalized = b.normalized),
asked AS (SELECT DISTINCT normalized AS norm FROM known WHERE coalesce(by_id, by_alias, by_name) IS NULL AND normalized IS NOT NULL), {_SCORED},
chosen AS (SELECT k.*, l.score AS likeness, c.canonical_id AS by_likeness, CASE WHEN by_id IS NOT NULL THEN 'provider_id' WHEN by_alias IS NOT NULL THEN 'alias' WHEN by_name IS NOT NULL THEN 'normalized_exact'
    WHEN l.score >= 92 THEN 'fuzzy_auto' WHEN l.score >= 82 THEN 'fuzzy_review' ELSE 'created' END AS method
  FROM known k LEFT JOIN likely l ON l.norm = k.normalized LEFT JOIN named c ON c.normalized = l.canon),
resolved AS (SELECT p_partkey, provider, raw_name, normalized, method, CASE WHEN method IN ('provider_id', 'alias', 'normalized_exact') THEN 100.0 ELSE round(coalesce(likeness, 0.0), 3) END AS score,
  coalesce(by_id, by_alias, by_name, by_likeness, replace(normalized, ' ', '_'), 'unknown') AS canonical_id FROM chosen)"""


def _names(spark, d):
    p = table(spark, d, "part").withColumn("w", F.concat_ws(" ", "p_name", F.lower("p_type")))
    key, size = F.col("p_partkey"), F.length("w")
    at = F.col("p_partkey") % size
    cut = F.concat(F.substring("w", F.lit(1), at.cast("int")), F.substring("w", (at + 2).cast("int"), size))
    turned = F.upper(F.concat_ws(" ", F.lower("p_type"), F.replace("p_name", F.lit("e"), F.lit("ee"))))
    raw = F.when(key % 25 == 1, F.concat(F.lit("The Alias "), (key % 50).cast("string"))).when(key % 17 == 3, F.concat(F.lit("zz"), key.cast("string"))).when(key % 29 == 5, F.lit(None).cast("string"))
    raw = raw.when(key % 3 == 0, cut).when(key % 3 == 1, turned).otherwise(F.concat("w", F.lit(" F.C.")))
    provider, ident = F.concat(F.lit("p"), (key % 4).cast("string")), F.replace("w", F.lit(" "), F.lit("_"))
    rows = p.select("p_partkey", provider.alias("provider"), F.when(key % 10 == 0, key.cast("string")).alias("provider_id"), raw.alias("raw_name"))
    canon = p.select(ident.alias("canonical_id"), F.col("w").alias("canonical_name")).distinct()
    ids = p.filter(key % 20 == 0).select(provider.alias("provider"), key.cast("string").alias("provider_id"), ident.alias("canonical_id"))
    aliases = p.filter((key < 50) & (key % 25 == 1)).select(F.when(key % 2 == 0, provider).alias("provider"), F.concat(F.lit("the alias "), key.cast("string")).alias("alias"), ident.alias("canonical_id")).distinct()
    return rows, canon, aliases, ids


@query(f"WITH {_CASCADE} SELECT p_partkey, normalized, method, score, r.canonical_id, coalesce(canonical_name, trim(raw_name), r.canonical_id) AS canonical_name, CASE WHEN score >= 92 THEN 'high' WHEN score >= 82 THEN 'medium' ELSE 'low' END AS band, method IN ('fuzzy_review', 'created') AS needs_review FROM resolved r LEFT JOIN canon c USING (canonical_id)")
def entity_cascade(spark, d):
    """Every row's entity, by provider id, alias, equal name or likeness."""
    rows, canon, aliases, ids = _names(spark, d)
    return entities.resolve_entities(rows, canon, aliases, ids).select("p_partkey", "normalized", "method", "score", "canonical_id", "canonical_name", "band", "needs_review")


@query(f"""WITH {_CASCADE} SELECT provider, normalized, CASE WHEN method = 'fuzzy_review' THEN 'score_between' ELSE 'no_match' END AS reason, canonical_id, score, min(raw_name) AS raw_name, count(*) AS rows
FROM resolved WHERE method IN ('fuzzy_review', 'created') GROUP BY ALL""")
def entity_review_queue(spark, d):
    """The names that need a look, with how many rows have them."""
    rows, canon, aliases, ids = _names(spark, d)
    return entities.review_queue(entities.resolve_entities(rows, canon, aliases, ids))


@query(f"""WITH {_CASCADE}, created AS (SELECT canonical_id, min(coalesce(trim(raw_name), canonical_id)) AS canonical_name FROM resolved WHERE method = 'created' GROUP BY 1)
SELECT canonical_id, canonical_name, 1.0 AS confidence FROM canon UNION ALL SELECT canonical_id, canonical_name, 0.55 FROM created WHERE canonical_id NOT IN (SELECT canonical_id FROM canon)""")
def entity_registry(spark, d):
    """The registry with the entities that the names made."""
    rows, canon, aliases, ids = _names(spark, d)
    return entities.registered(canon, entities.resolve_entities(rows, canon, aliases, ids))
