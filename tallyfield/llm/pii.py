"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans. Four labelers, by pattern, gazetteer, context and
shape, vote on each: 1 personal, -1 not, 0 no opinion. How often each pattern
of votes occurs is counted (a bounded table), expectation-maximisation
estimates each labeler's reliability from these counts, and a logistic span
classifier is trained on the resulting posteriors. Its weights become a column
expression. Spans of the fixed patterns always stay; the classifier adds
others.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.session import materialise

#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "secret")

# The patterns of the four base kinds, written so that no search
# goes back over a run of characters; they match where and what these match:
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+
#   phone \+[0-9][\x20().0-9-]+[0-9]
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?:[0-9]{2,}+|[0-9][\x20-][0-9]++)(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Proposals beyond these: a named value, a number written like a national telephone number, an address without a dotted host.
SECRET = r"(?<![A-Za-z_])[A-Za-z_]{2,}+[\"']?+\x20?+[=:]\x20?+[\"']?+[A-Za-z0-9_./+-]{6,}+[\"']?+"
NATIONAL = r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
BARE = r"(?<![^\s<(\"'])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?![A-Za-z0-9.@-])"

# Gazetteers.
DOMAINS = "com org net edu gov mil int info io co uk de fr es it nl eu us ca au jp cn br in".split()
SECRET_NAMES = "password passwd passphrase pwd pass secret token apikey api_key access_key private_key auth credential".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
CONTEXT = "mail contact write tel phone call fax mobile card visa account paid ip host server address login user password key".split()

LABELERS = ("pattern", "gazetteer", "context", "shape")
#: Characters before a span that the context labeler sees.
BEFORE = 32


_SPAN = "array<struct<k:int,kind:string,rule:string,start:bigint,end:bigint,hit:string,before:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body or lambdas in it name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(values: Column, join: Callable[[Column, Column], Column], step: int = 256) -> Column:
    """Running totals of a non-empty array by an associative ``join``.

    A fold that appends copies what it has at each step; here it runs within
    blocks of ``step`` values, then over the totals of the blocks.
    """

    def totals(block: Column) -> Column:
        return F.aggregate(F.slice(block, 2, F.size(block)), F.slice(block, 1, 1), lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x))))

    def joined(inner: Column) -> Column:
        before = totals(F.transform(inner, lambda x: F.element_at(x, -1)))
        return _let(before, lambda t: F.flatten(F.transform(inner, lambda x, i: F.when(i == 0, x).otherwise(F.transform(x, lambda y: join(F.get(t, i - 1), y))))))

    return _let(values, lambda v: _let(F.transform(F.sequence(F.lit(1), F.size(v), F.lit(step)), lambda at: totals(F.slice(v, at, F.lit(step)))), joined))


def _found(text: Column, pattern: str, needs: Column, kind: str, rule: str) -> Column:
    """Matches of a pattern as an array of structs with code point places, leftmost and without overlap; an empty array where ``needs`` is false.

    One pass finds the matches and one more what lies between them; places are running totals of lengths.
    """
    none = F.array().cast(_SPAN)

    def span(pair: Column, end: Column) -> Column:
        return F.struct(
            F.lit(KINDS.index(kind)).alias("k"), F.lit(kind).alias("kind"), F.lit(rule).alias("rule"),
            (end - F.length(pair["hit"])).alias("start"), end.alias("end"), pair["hit"].alias("hit"), F.lower(F.substring(pair["gap"], -BEFORE, BEFORE)).alias("before"),
        )

    def placed(pairs: Column) -> Column:
        ends = _scan(F.transform(pairs, lambda x: (F.length(x["gap"]) + F.length(x["hit"])).cast("long")), lambda a, b: a + b)
        return F.zip_with(pairs, ends, span)

    def paired(hits: Column) -> Column:
        pairs = F.zip_with(hits, F.split(text, pattern, -1), lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap")))
        return F.when(F.size(hits) > 0, _let(F.slice(pairs, 1, F.size(hits)), placed)).otherwise(none)

    return F.when(needs, _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), paired)).otherwise(none)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid Luhn sum."""
    backwards = F.split(F.reverse(digits), "")

    def value(digit: Column, i: Column) -> Column:
        d = digit.cast("int")
        return F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.filter(backwards, lambda x: x != ""), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(s: Column) -> Column:
    """Whether a span of a base rule passes its check."""
    number = lambda check: _let(_digits(s["hit"]), check)
    parts = F.forall(F.split(s["hit"], r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    return (
        F.when(s["rule"] != "base", False)
        .when(s["kind"] == "email", True)
        .when(s["kind"] == "ip", parts)
        .when(s["kind"] == "card", number(lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)))
        .otherwise(number(lambda d: F.length(d).between(10, 15)))
    )


def proposals(text: Column) -> tuple[Column, Column]:
    """Matches of the base patterns, and those of the others."""
    at, digit, plus = F.contains(text, F.lit("@")), text.rlike("[0-9]"), F.contains(text, F.lit("+"))
    named = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    base = F.concat(_found(text, EMAIL, at, "email", "base"), _found(text, IP, digit, "ip", "base"), _found(text, CARD, digit, "card", "base"), _found(text, PHONE, plus, "phone", "base"))
    more = F.concat(_found(text, SECRET, named, "secret", "named"), _found(text, NATIONAL, digit, "phone", "national"), _found(text, BARE, at, "email", "bare"))
    return base, more


def _votes(s: Column) -> list[Column]:
    """One vote of each labeler on a span."""
    digits, hit, kind = _digits(s["hit"]), F.lower(s["hit"]), s["kind"]
    n, size = F.length(digits), F.length(s["hit"])
    name = F.regexp_extract(hit, r"^([a-z_]+)", 1)
    value = F.regexp_extract(hit, r"[=:]\x20?[\"']?([a-z0-9_./+-]+)", 1)

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, -1).otherwise(0)

    base = s["valid"]
    strong = value.rlike("[0-9]") & value.rlike("[a-z]") & (F.length(value) >= 12)
    pattern = vote(base | ((kind == "secret") & strong), (s["rule"] == "base") | (kind == "secret"))
    domain = F.regexp_extract(hit, r"([a-z0-9-]+)$", 1)
    known = (
        F.when(kind == "email", domain.isin(DOMAINS))
        .when(kind == "ip", ~F.substring_index(hit, ".", 1).isin("0", "127", "255"))
        .when(kind == "card", F.substring(digits, 1, 1).isin("3", "4", "5", "6"))
        .when(kind == "phone", (s["rule"] == "national") | F.regexp_extract(hit, r"^\+([0-9]{1,2})", 1).isin(CALLING) | F.substring(digits, 1, 1).isin("1", "7"))
        .otherwise(F.exists(F.array(*[F.lit(x) for x in SECRET_NAMES]), lambda w: F.contains(name, w)))
    )
    near = s["before"].rlike("(?:" + "|".join(CONTEXT) + r")[^.!?\n]*$")
    glued = s["before"].rlike(r"[a-z0-9/$#]$")
    shape = (
        F.when(kind == "email", size.between(6, 80))
        .when(kind == "ip", size.between(7, 15))
        .when(kind == "card", n.between(14, 19))
        .when(kind == "phone", n.between(10, 15) & (size <= 24))
        .otherwise(F.length(value).between(8, 128) & value.rlike("[0-9]"))
    )
    return [pattern, vote(known, ~known), vote(near, glued), vote(shape, ~shape)]


def _length_step(s: Column) -> Column:
    """Length of a span in five steps."""
    size = F.length(s["hit"])
    return F.when(size < 8, 0).when(size < 14, 1).when(size < 20, 2).when(size < 32, 3).otherwise(4)


def reliabilities(counts: dict[tuple, int], rounds: int = 50) -> tuple[dict[str, float], dict[tuple, tuple[float, float]], dict[tuple, float]]:
    """Expectation-maximisation over (kind, votes) counts: the share of personal spans by kind, each labeler's rate of being right about personal and about other spans, and P(personal) of each (kind, votes).

    It begins with the share of votes in favour. Rates are held between 0.5
    and 0.99, so that a labeler is never believed less than chance.
    """
    keys = list(counts)
    p = {}
    for k in keys:
        given = [v for v in k[1] if v]
        p[k] = (1 + sum(v > 0 for v in given)) / (2 + len(given))
    share: dict[str, float] = {}
    rates: dict[tuple, tuple[float, float]] = {}
    for _ in range(rounds):
        for kind in {k[0] for k in keys}:
            own = [k for k in keys if k[0] == kind]
            total = sum(counts[k] for k in own)
            share[kind] = (1 + sum(counts[k] * p[k] for k in own)) / (2 + total)
            for j in range(len(LABELERS)):
                right = [1.0, 1.0]
                seen = [1.5, 1.5]
                for k in own:
                    if k[1][j]:
                        right[0] += counts[k] * p[k] * (k[1][j] > 0)
                        seen[0] += counts[k] * p[k]
                        right[1] += counts[k] * (1 - p[k]) * (k[1][j] < 0)
                        seen[1] += counts[k] * (1 - p[k])
                rates[kind, j] = tuple(min(0.99, max(0.5, r / s)) for r, s in zip(right, seen))
            for k in own:
                odds = math.log(share[kind] / (1 - share[kind]))
                for j, v in enumerate(k[1]):
                    yes, no = rates[kind, j]
                    odds += math.log(yes / (1 - no)) if v > 0 else math.log((1 - yes) / no) if v < 0 else 0.0
                p[k] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return share, rates, p


def _inputs(kind: str, votes: tuple, step: int) -> list[str]:
    """Names of the classifier's inputs that a span has."""
    return [kind, *(f"{kind}:{name}:{v}" for name, v in zip(LABELERS, votes) if v), f"{kind}:length:{step}"]


def train_classifier(counts: dict[tuple, int], rounds: int = 200, penalty: float = 1e-3) -> dict[str, float]:
    """Logistic weights by input name, from (kind, votes, length step) counts."""
    pooled: dict[tuple, int] = {}
    for (kind, votes, _), n in counts.items():
        pooled[kind, votes] = pooled.get((kind, votes), 0) + n
    _, _, p = reliabilities(pooled)
    rows = [(_inputs(*k), p[k[0], k[1]], n) for k, n in sorted(counts.items())]
    weights = {name: 0.0 for r in rows for name in r[0]}
    kinds: dict[str, int] = {}
    for k, n in counts.items():
        kinds[k[0]] = kinds.get(k[0], 0) + n
    for i in range(rounds):
        slope = {name: -penalty * w for name, w in weights.items()}
        for names, target, n in rows:
            z = sum(weights[x] for x in names)
            off = (target - 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))) * n / kinds[names[0]]
            for x in names:
                slope[x] += off
        for x in weights:
            weights[x] += 2.0 * slope[x]
    return weights


def _score(weights: dict[str, float]) -> Callable[[Column], Column]:
    """The classifier's log-odds of a span as a column expression."""
    table = F.create_map(*[F.lit(x) for item in sorted(weights.items()) for x in item]) if weights else None

    def score(s: Column) -> Column:
        if table is None:
            return F.lit(-1.0)
        names = [s["kind"], *(F.when(v != 0, F.concat(s["kind"], F.lit(f":{name}:"), v.cast("string"))) for name, v in zip(LABELERS, _votes(s))), F.concat(s["kind"], F.lit(":length:"), _length_step(s).cast("string"))]
        return sum((F.coalesce(F.try_element_at(table, F.coalesce(x, F.lit(""))), F.lit(0.0)) for x in names), F.lit(0.0))

    return score


def _checked(s: Column) -> Column:
    return s.withField("valid", _valid(s))


def _apart(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that overlap none of ``others``.

    In the order of their starts a span meets another one if an earlier one
    ends behind its start or the next one starts before its end.
    """
    never = F.lit(2**62)

    def ordered(both: Column) -> Column:
        reach = _scan(F.transform(both, lambda x: F.when(x["own"] == 0, x["end"]).otherwise(F.lit(-1).cast("long"))), lambda a, b: F.greatest(a, b))
        following = F.reverse(_scan(F.transform(F.reverse(both), lambda x: F.when(x["own"] == 0, x["start"]).otherwise(never)), lambda a, b: F.least(a, b)))
        near = F.zip_with(reach, following, lambda a, b: F.struct(a.alias("reach"), b.alias("following")))
        free = F.zip_with(both, near, lambda x, y: F.when((x["own"] == 1) & (y["reach"] <= x["start"]) & (y["following"] >= x["end"]), x["span"]))
        return F.filter(free, lambda x: x.isNotNull())

    def keyed(own: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s.alias("span"))

    both = F.array_sort(F.concat(F.transform(others, keyed(0)), F.transform(spans, keyed(1))))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), _let(both, ordered)).otherwise(spans)


def find_spans(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (k, kind, start, end), by start and then kind; code points, end exclusive.

    ``keep`` names the columns to keep, doc_id if not given. Null texts are
    empty and have no spans. Spans of the base patterns come first in
    ``spans``' making: whatever overlaps one isn't added. The classifier is
    trained on the proposals of all documents; with none it adds nothing.
    """
    keep = ["doc_id"] if keep is None else keep
    base, more = proposals(F.coalesce(F.col("text"), F.lit("")))
    d = materialise(docs.select(*keep, F.transform(base, _checked).alias("_base"), F.transform(more, _checked).alias("_more")), "pii-proposals")
    every = d.select(F.explode(F.concat("_base", "_more")).alias("s"))
    votes = _votes(F.col("s"))
    table = every.groupBy(F.col("s.kind").alias("kind"), *[v.alias(n) for n, v in zip(LABELERS, votes)], _length_step(F.col("s")).alias("step")).count()
    # At most 5 kinds, 81 patterns of votes and 5 lengths.
    counts = {(r["kind"], tuple(r[n] for n in LABELERS), r["step"]): r["count"] for r in table.collect()}
    score = _score(train_classifier(counts))
    slim = lambda a: F.transform(a, lambda s: F.struct(s["k"].alias("k"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    d = d.withColumn("_base", F.filter("_base", lambda s: s["valid"]))
    d = d.withColumn("_more", F.when(F.size("_more") > 0, F.filter("_more", lambda s: score(s) >= 0)).otherwise(F.col("_more")))
    d = d.withColumn("_more", _apart(F.col("_more"), F.col("_base")))
    named = lambda yes: F.filter("_more", lambda s: (s["kind"] == "secret") == F.lit(yes))
    d = d.withColumn("_named", named(True)).withColumn("_more", named(False))
    d = d.withColumn("_more", F.concat("_named", _apart(F.col("_more"), F.col("_named")))).drop("_named")
    by_place = lambda a: F.transform(F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["k"].alias("k"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return d.withColumn("base", by_place(slim(F.col("_base")))).withColumn("spans", by_place(slim(F.concat("_base", "_more")))).drop("_base", "_more")


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Bits of the length, in code points, of the chunks in which ``_replaced`` holds a text.
_CHUNK = 10


def _replaced(text: Column, spans: Column) -> Column:
    """A text with each of its spans, at least one and by start, replaced by its kind. Each piece between spans is taken from the chunks it lies in, not sought from the text's beginning."""
    size = 1 << _CHUNK

    def piece(chunks: Column, a: Column, b: Column) -> Column:
        first, last = F.shiftright(a, _CHUNK).cast("int"), F.shiftright(b - 1, _CHUNK).cast("int")
        at, upto = (a.bitwiseAND(F.lit(size - 1).cast("long")) + 1).cast("int"), ((b - 1).bitwiseAND(F.lit(size - 1).cast("long")) + 1).cast("int")
        inner = F.array_join(F.slice(chunks, first + 2, last - first - 1), "")
        several = F.concat(F.substring(F.get(chunks, first), at, F.lit(size)), inner, F.substring(F.get(chunks, last), F.lit(1), upto))
        return F.when(b <= a, "").when(first == last, F.substring(F.get(chunks, first), at, upto - at + 1)).otherwise(several)

    def marked(chunks: Column, reach: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            at = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(reach, i - 1))
            return _let(at, lambda at: F.concat(piece(chunks, at, F.greatest(s["start"], at)), F.when(s["start"] >= at, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")))

        rest = piece(chunks, F.element_at(reach, -1), F.length(text).cast("long"))
        return F.concat(F.array_join(F.transform(spans, one), ""), rest)

    ends = _scan(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return _let(chunks, lambda c: _let(ends, lambda reach: marked(c, reach)))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in angle brackets; other columns as they are, but n_chars, where it is the text's length, follows.

    Null texts stay null. Spans that overlap are replaced from left to right;
    what is left of a later one goes too. Texts of any length with any number
    of spans take time in proportion to both.
    """
    found = find_spans(docs.select("text", F.struct(*docs.columns).alias("_row")), keep=["_row"])  # whatever other columns are called
    whole = F.col("_row.text")
    text = F.when(F.size("spans") > 0, _replaced(whole, F.col("spans"))).otherwise(whole)
    new = {}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    out = found.withColumn("_text", text)
    return out.select(*[F.col("_text").alias(c) if c == "text" else new[c].alias(c) if c in new else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(k) for k in KINDS[:4]], F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
