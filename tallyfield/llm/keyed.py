"""Python functions over rows whose keys must stay as they are, and rows told apart by a key before a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_keyed(df: DataFrame, keys: tuple[str, ...], function: Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``mapInPandas`` to ``keys`` and then ``schema``, with the keys as text on the way: beside nulls pandas would make whole numbers doubles, and ids above 2^53 would change."""
    types = {k: df.schema[k].dataType for k in keys}
    text = df.select(*[F.col(c).cast("string").alias(c) if c in types else c for c in df.columns])
    out = text.mapInPandas(function, ", ".join([*(f"`{k}` string" for k in keys), schema]))
    return out.select(*[F.col(c).cast(types[c]).alias(c) if c in types else c for c in out.columns])


def maybe_among(rows: DataFrame, wanted: DataFrame, column: str, bits: int) -> DataFrame:
    """``rows`` with ``_among``: true of every row whose ``column`` is in ``wanted``, and of some others.

    A bitmap of ``bits`` hash places, broadcast in rows of 4 KB and no larger
    for larger inputs, tells so without a shuffle of ``rows``. Where it fills
    up more others are true, so a join or count must follow.
    """
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    found = wanted.select(place.alias("_p")).groupBy(F.expr("_p div 32768").alias("_row")).agg(F.bitmap_construct_agg(F.col("_p") % 32768).alias("_bits"))
    marked = F.expr("shiftright(cast(conv(hex(substring(_bits, cast(_p % 32768 div 8 as int) + 1, 1)), 16, 10) as int), cast(_p % 8 as int)) & 1 = 1")
    out = rows.withColumn("_p", place).withColumn("_row", F.expr("_p div 32768")).join(F.broadcast(found), "_row", "left")
    return out.select(*rows.columns, F.coalesce(marked, F.lit(False)).alias("_among"))
