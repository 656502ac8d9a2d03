"""Missing values, safe arithmetic and rounding, once for all operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(x: Column | str) -> Column:
    """A double; what doesn't parse, NaN and infinities are null."""
    v = col(x).try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float and double columns becomes null, as it means missing."""
    return df.withColumns({c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c, kind in df.dtypes if kind in ("float", "double")})


def blank_to_null(x: Column | str) -> Column:
    """Trimmed text; empty text and the words nan, none, null are null."""
    v = F.trim(col(x).cast("string"))
    return F.when(F.lower(v).isin("", "nan", "none", "null"), None).otherwise(v)


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """a / b; null if b is 0 or null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def ratio_or_zero(a: Column | str, b: Column | str) -> Column:
    """a / b; 0 if b is 0 or either is null."""
    return F.coalesce(safe_divide(a, b), F.lit(0.0))


def clamp(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def first_valid(*names: Column | str, above: float | None = None) -> Column:
    """The first number that is there, or the first above ``above``."""
    values = [number(n) for n in names]
    return F.coalesce(*([F.when(v > above, v) for v in values] if above is not None else values))


def alias(df: DataFrame, *names: str) -> Column | None:
    """The columns of ``df`` that have one of these names, exactly or but for case, coalesced in that order; None without any."""
    have = {c.lower(): c for c in reversed(df.columns)}
    found = [n if n in df.columns else have[n.lower()] for n in names if n in df.columns or n.lower() in have]
    return F.coalesce(*map(F.col, dict.fromkeys(found))) if found else None


def conform(df: DataFrame, spec: dict[str, tuple[str, list[str]]], required: list[str] = ()) -> DataFrame:
    """Columns by canonical name: ``spec`` maps it to a type and the names it may go by. Absent ones are null.

    Raises ValueError if a required one is absent altogether.
    """
    found = {name: alias(df, name, *others) for name, (_, others) in spec.items()}
    if missing := [n for n in required if found.get(n) is None]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[(F.lit(None) if found[n] is None else found[n]).try_cast(kind).alias(n) for n, (kind, _) in spec.items()])


def present(names: list[str]) -> Column:
    """How many of the columns hold something other than null and blank."""
    return reduce(lambda a, b: a + b, [blank_to_null(n).isNotNull().cast("int") for n in names])


def completeness(names: list[str]) -> Column:
    """Share of the columns that hold something."""
    return present(names) / F.lit(float(len(names)))


def sigmoid(x: Column, bound: float = 8.0) -> Column:
    """Logistic function of x held within +-bound."""
    return 1 / (1 + F.exp(-clamp(x, -bound, bound)))


def entropy(p: Column) -> Column:
    """Entropy in bits of a yes/no probability; 0 at 0 and 1."""
    q = 1 - p
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-(p * F.log2(p) + q * F.log2(q)))


def as_percent(x: Column) -> Column:
    """Percentages become shares: what is beyond 1.5 is divided by 100."""
    return F.when(F.abs(x) > 1.5, x / 100).otherwise(x)
