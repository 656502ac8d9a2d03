"""Likeness of names: the longest common subsequence and the ratio made of it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallyfield.functions.nulls import col

#: Pairs handled at a time, and the longest strings whose steps fit one machine word.
_PAIRS, _BITS = 4096, 63


def _long_subsequence(a: str, b: str) -> int:
    """One pair of any length, a bit of a Python integer for each character of ``a``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        m = v & where.get(ch, 0)
        v = (v + m | v - m) & full
    return len(a) - v.bit_count()


def _codes(strings: list[str], width: int) -> np.ndarray:
    """Code points in rows of ``width``, zeros behind the end."""
    joined = np.frombuffer("".join(s.ljust(width, "\0") for s in strings).encode("utf-32-le", "surrogatepass"), "<u4")
    return joined.reshape(len(strings), width)


def common_subsequence(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair, all pairs of a batch a character at a time."""
    out = np.zeros(len(a), np.int32)
    size = np.array([max(len(x), len(y)) for x, y in zip(a, b)], np.int64)
    for i in np.flatnonzero(size > _BITS):
        out[i] = _long_subsequence(a[i], b[i])
    short = np.flatnonzero((size <= _BITS) & (size > 0))
    short = short[np.argsort(size[short], kind="stable")]
    for at in range(0, len(short), _PAIRS):
        own = short[at : at + _PAIRS]
        x, y = [a[i] for i in own], [b[i] for i in own]
        wx, wy = max(map(len, x)), max(map(len, y))
        if not wx or not wy:
            continue
        left, right = _codes(x, wx), _codes(y, wy)
        bits = np.uint64(1) << np.arange(wx, dtype=np.uint64)
        v = np.full(len(own), (1 << wx) - 1, np.uint64)
        full = v.copy()
        for j in range(wy):
            ch = right[:, j : j + 1]
            m = v & np.where((left == ch) & (ch != 0), bits, np.uint64(0)).sum(1, dtype=np.uint64)
            v = (v + m | v - m) & full
        out[own] = wx - np.bitwise_count(v)
    return out


def subsequence_length(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common subsequence of two strings; 0 beside null."""

    @pandas_udf("int")
    def lengths(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(common_subsequence(x.fillna("").tolist(), y.fillna("").tolist()))

    return lengths(col(a), col(b))


def ratio(common: Column, a: Column | str, b: Column | str) -> Column:
    """0 to 100: twice the common subsequence by the sum of the lengths; two empty strings are alike."""
    total = F.length(col(a)) + F.length(col(b))
    return F.when(total == 0, 100.0).otherwise(200.0 * common / total)
