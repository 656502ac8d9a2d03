"""Words of many texts at once as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that separate words: space and the controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_VALUES = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The multiplier to the powers 0 to n - 1, modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS))
        steps = np.full(size, _MULTIPLIER, np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run data[start:end]; runs are in order and don't overlap."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = _VALUES[data[place + np.repeat(starts, lengths)]] * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64) * _MULTIPLIER)


_INVERSE = np.ones(1, np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _VALUES) -> np.ndarray:
    """A 64-bit hash of each data[start:end], by prefix sums, so spans may overlap and cost the same at any length."""
    global _INVERSE
    n = len(data)
    if len(_INVERSE) < n + 1:
        steps = np.full(max(n + 1, 2 * len(_INVERSE)), pow(int(_MULTIPLIER), -1, 1 << 64), np.uint64)
        steps[0] = 1
        _INVERSE = np.multiply.accumulate(steps)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * powers(n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _INVERSE[starts] + (ends - starts).astype(np.uint64) * _MULTIPLIER)


def pieces_of(items: list, size, limit: int) -> Iterator[slice]:
    """Slices of ``items`` whose sizes add up to about ``limit``, or a single larger item."""
    at, total = 0, 0
    for i, x in enumerate(items):
        if i > at and total + size(x) > limit:
            yield slice(at, i)
            at, total = i, 0
        total += size(x)
    if at < len(items):
        yield slice(at, len(items))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, where words start and end in them, and the index of each text's first word (one more at the end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = ~SPACE[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return data, starts, ends, np.searchsorted(starts, begins)
