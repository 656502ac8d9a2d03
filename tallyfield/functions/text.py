"""Names, keys and parsers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfield.functions.nulls import blank_to_null, col

# Latin letters with marks and the letter each becomes.
MARKED = "áàâãäåāăąéèêëēĕėęěíìîïīĭįóòôõöōŏőúùûüūŭůűųñńňçćčýÿžźżšśğłřťď"
PLAIN = "aaaaaaaaaeeeeeeeeeiiiiiiioooooooouuuuuuuuunnncccyyzzzssglrtd"

# What short forms of club names stand for, and words that say nothing.
SHORT_FORMS = {"utd": "united", "psg": "paris saint germain", "mg": "mineiro", "man": "manchester"}
EMPTY_WORDS = ["fc", "cf", "sc", "afc", "ac", "club", "clube", "de", "futebol", "football"]


def strip_marks(x: Column | str) -> Column:
    """Lower case without marks on Latin letters."""
    return F.translate(F.lower(col(x)), MARKED, PLAIN)


def normalise_name(x: Column | str, short: dict[str, str] = SHORT_FORMS, drop: list[str] = EMPTY_WORDS) -> Column:
    """A name to compare by: no marks, "&" as and, punctuation as space, short forms written out, empty words gone.

    A name of empty words only keeps them. Null and blank names are null.
    """
    plain = F.regexp_replace(F.regexp_replace(strip_marks(x), "&", " and "), "[^a-z0-9]+", " ")
    words = F.filter(F.split(F.trim(plain), " "), lambda w: w != "")
    table = F.create_map(*[F.lit(v) for item in short.items() for v in item]) if short else F.create_map()
    full = F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)) if short else words
    kept = F.filter(full, lambda w: ~w.isin(drop))
    return F.when(F.size(words) > 0, F.array_join(F.when(F.size(kept) > 0, kept).otherwise(full), " "))


def slug(x: Column | str) -> Column:
    """Letters and digits joined by underscores."""
    return F.regexp_replace(F.regexp_replace(strip_marks(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def team_key(x: Column | str) -> Column:
    """Only the letters and digits, in lower case."""
    return F.regexp_replace(strip_marks(x), "[^a-z0-9]", "")


def stable_id(*parts: Column | str, length: int = 16) -> Column:
    """The first digits of the SHA-1 of the parts joined by "|"; null parts are empty."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])), 1, length)


def parse_flags(x: Column | str) -> Column:
    """The distinct flags in upper case, in order, of a text such as "[a, 'b'; c|a]"."""
    bare = F.regexp_replace(F.coalesce(col(x), F.lit("")), r"[\[\]'\"]", "")
    return F.array_distinct(F.filter(F.transform(F.split(F.upper(bare), r"[,;|]"), lambda f: F.trim(f)), lambda f: f != ""))


def add_warning(x: Column | str, warning: str) -> Column:
    """A ";" list with a warning appended unless it is there."""
    have = F.filter(F.split(F.coalesce(col(x), F.lit("")), ";"), lambda w: w != "")
    return F.array_join(F.array_union(have, F.array(F.lit(warning))), ";")


def token_sort(x: Column | str) -> Column:
    """Words of a normalised name in order."""
    return F.array_join(F.array_sort(F.split(normalise_name(x), " ")), " ")


def parse_number(x: Column | str) -> Column:
    """A number written with a decimal comma or point, or as a fraction a/b, which is a price of a/b + 1."""
    t = F.trim(col(x))
    a, b = F.regexp_extract(t, r"^(\d+)\s*/\s*(\d+)$", 1), F.regexp_extract(t, r"^(\d+)\s*/\s*(\d+)$", 2)
    plain = F.regexp_extract(F.replace(t, F.lit(","), F.lit(".")), r"-?\d+(?:\.\d+)?", 0)
    return F.when(F.contains(t, F.lit("/")) & (a != ""), F.try_divide(a.try_cast("double"), b.try_cast("double")) + 1).otherwise(plain.try_cast("double"))


def parse_score(x: Column | str) -> Column:
    """"2-1 (1-0)" as full-time and half-time goals; parts that are absent are null."""
    part = lambda p, i: F.regexp_extract(col(x), p, i).try_cast("int")
    full, half = r"^\s*(\d+)\s*[-:]\s*(\d+)", r"\(\s*(\d+)\s*[-:]\s*(\d+)\s*\)"
    return F.struct(part(full, 1).alias("home_ft"), part(full, 2).alias("away_ft"), part(half, 1).alias("home_ht"), part(half, 2).alias("away_ht"))


# What status texts hold, in the order in which they are tried.
STATUS_WORDS = (("finished", "finished|after penalties|aet|full time|ft"), ("live", "live|1st half|2nd half|half time|ht"), ("postponed", "postponed|cancelled|canceled|abandoned"))


def parse_status(x: Column | str) -> Column:
    """Finished, live or postponed by what a status text holds, scheduled if it is blank, else the text itself with underscores, at most 40 characters."""
    t = F.lower(F.trim(F.coalesce(col(x), F.lit(""))))
    out = F.when(t == "", "scheduled")
    for status, words in STATUS_WORDS:
        out = out.when(t.rlike(words), status)
    return out.otherwise(F.substring(F.replace(t, F.lit(" "), F.lit("_")), 1, 40))


def first_path(json: Column | str, *paths: str) -> Column:
    """The first of the JSON paths that holds something."""
    return F.coalesce(*[blank_to_null(F.get_json_object(col(json), p)) for p in paths])


def first_match(x: Column | str, *patterns: str) -> Column:
    """Group 1 of the first pattern that matches."""
    return F.coalesce(*[F.nullif(F.regexp_extract(col(x), p, 1), F.lit("")) for p in patterns])


def match_identity(key: Column | str, *parts: Column | str) -> Column:
    """The given key, or else the parts, lower-cased and joined by "|"."""
    return F.coalesce(blank_to_null(key), F.lower(F.concat_ws("|", *[F.coalesce(blank_to_null(p), F.lit("")) for p in parts])))
