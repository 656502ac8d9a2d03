"""Removal of byte strings that occur elsewhere, by suffix arrays of shards.

Every window of ``passage`` bytes selects one of its ``gram``-byte strings,
the one of the smallest hash. What is selected follows from the window's bytes
alone, so equal windows select equal grams and meet in one gram's shards.
Neighbouring windows that select the same place are one run, which reaches
``length`` bytes beyond its last start. Runs of equal bytes travel once, with
their number. In each shard a suffix array (Larsson-Sadakane) and common
prefixes (Kasai) tell which windows are equal; classes of equal windows are
refined by what follows up to ``length`` bytes. Those of ``length`` bytes are
what is removed, those of ``passage`` bytes are reported as passages if they
cover enough words. The different windows of all shards of a gram are merged
by binary search.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm import arrays
from tallyfield.llm.keyed import maybe_among
from tallyfield.session import drop_written, materialise

LENGTH, GRAM = 400, 48
#: A repeated string of at least PASSAGE bytes and more than WORDS words is a passage, removed or not.
PASSAGE, WORDS = 240, 50
#: Different runs of a gram in a shard, and bytes of a suffix array.
SHARD_RUNS, ARRAY_BYTES = 512, 400_000
#: Bits of the broadcast bitmaps that keep grams that occur once and texts nobody asked for out of shuffles (16 MB and 1 MB).
GRAM_BITS, TEXT_BITS = 1 << 27, 1 << 23
#: Low bits of a selection key that hold the place, so bytes handled at a time stay below 2^24.
_PLACE = np.uint64((1 << 24) - 1)
_SEGMENT = 1 << 22


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place, by joining hashes of half the length."""
    h, n = arrays._VALUES[data], 1
    whole, covered, left = None, 0, gram
    while left:
        if left & 1:
            if whole is None:
                whole, covered = h, n
            else:
                m = len(data) - covered - n + 1
                whole = whole[:m] * arrays.powers(n + 1)[n] + h[covered : covered + m]
                covered += n
        left >>= 1
        if left:
            m = len(data) - 2 * n + 1
            if m <= 0:
                return np.empty(0, np.uint64)
            h = h[:m] * arrays.powers(n + 1)[n] + h[n : n + m]
            n *= 2
    return arrays.mix(whole)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours."""
    m, n = x, 1
    while 2 * n <= width:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    rest = width - n
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def window_runs(texts: list[bytes], length: int, gram: int = GRAM, reach: int = 0, most: int | None = None) -> tuple[np.ndarray, ...]:
    """Runs of windows of ``length`` bytes in texts of a few MB together, as arrays: text, gram hash, content hash, first start, last start.

    The content is all bytes from the first start to ``reach`` bytes after the
    last one, or to the text's end. Only the first ``most`` windows of a text
    count.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    fits = np.minimum(np.maximum(sizes - length + 1, 0), len(data) if most is None else most)
    if not fits.sum():
        return tuple(np.empty(0, np.int64) for _ in range(5))
    h = _gram_hashes(data, gram)
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    chosen = (_least(key, length - gram + 1) & _PLACE).astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), fits)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(fits) - fits, fits)  # within the text
    picked = chosen[starts + begins[owner]]
    first = np.flatnonzero(np.concatenate([[True], (picked[1:] != picked[:-1]) | (owner[1:] != owner[:-1])]))
    last = np.append(first[1:], len(owner)) - 1
    own, lo, hi = owner[first], starts[first], starts[last]
    content = arrays.span_hashes(data, begins[own] + lo, begins[own] + np.minimum(hi + max(reach, length), sizes[own]))
    return own, h[picked[first]].astype(np.int64), content.astype(np.int64), lo, hi


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of bytes and separators (256 and above, smaller than any byte, the earlier the smaller) in order.

    Larsson-Sadakane: suffixes are sorted by as many symbols as a key holds;
    then groups of equal prefixes double the length they are sorted by in each
    pass, and only groups of several suffixes are sorted again, until there
    are none. The text must end with a separator.
    """
    n = len(text)
    width = n.bit_length()
    apart = text >= 256
    alphabet = np.unique(text[~apart])
    code = np.zeros(256, np.int64)
    code[alphabet] = np.arange(1, len(alphabet) + 1)
    bits = max(1, int(len(alphabet)).bit_length())
    h = max(1, 63 // bits)
    symbols = np.zeros(n + h, np.int64)
    symbols[:n][~apart] = code[text[~apart]]
    key = np.zeros(n, np.int64)
    for i in range(h):
        key = key << bits | symbols[i : i + n]
    at = np.flatnonzero(apart)
    left = np.repeat(at, np.diff(at, prepend=-1)) - np.arange(n)  # to the next separator
    ends = np.flatnonzero(left < h)
    beyond = bits * (h - left[ends])
    key[ends] = key[ends] >> beyond << beyond
    order = np.argsort(key)
    key = key[order]
    change = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(change, np.arange(n), 0))
    # Suffixes that reach their separator within the key differ there: the earlier is the smaller.
    ends = ends[np.lexsort((ends, rank[ends]))]
    group = rank[ends]
    first = np.concatenate([[True], group[1:] != group[:-1]])
    places = group + np.arange(len(group)) - np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
    order[places], rank[ends], change[places] = ends, places, True
    while True:
        alone = change.copy()
        alone[:-1] &= change[1:]
        places = np.flatnonzero(~alone)
        if not len(places):
            return order
        own = order[places]
        pairs = rank[own] << width | (rank[np.minimum(own + h, n)] + 1)
        if 3 * width <= 63:  # the place fits beside the two ranks, so that a plain sort will do
            pairs = np.sort(pairs << width | own)
            own, pairs = pairs & ((1 << width) - 1), pairs >> width
        else:
            sort = np.argsort(pairs)
            own, pairs = own[sort], pairs[sort]
        order[places] = own
        new = np.concatenate([[True], pairs[1:] != pairs[:-1]])
        change[places] = new
        rank[own] = places[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        h *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, begins: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """For the first ``counts`` places of each part: how far, up to ``most``, a suffix agrees with the one before it in ``order``; 0 elsewhere.

    Kasai: from one place to the next the agreement falls by one at most,
    which holds only where all suffixes are sorted to their ends. All parts
    take this step together.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text, np.full(most + 16, -1, text.dtype)])
    out, now = np.zeros(n, np.int64), np.zeros(len(begins), np.int64)
    lanes = np.arange(16)
    for t in range(int(counts.max(initial=0))):
        live = np.flatnonzero(counts > t)
        p = begins[live] + t
        q = before[p]
        have = np.where(q >= 0, np.maximum(now[live] - 1, 0), 0)
        go = np.flatnonzero(q >= 0)
        while len(go):
            a, b = p[go] + have[go], q[go] + have[go]
            same = padded[a[:, None] + lanes] == padded[np.minimum(b[:, None] + lanes, n + most + 15)]
            step = np.where(same.all(1), 16, same.argmin(1))
            have[go] = np.minimum(have[go] + step, most)
            go = go[(step == 16) & (have[go] < most)]
        out[p] = have
        now[live] = have
    return out


def equal_windows(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of ``length`` bytes in the order of their bytes: part, place in it, and whether it equals the one before."""
    sizes = np.array([len(p) for p in parts])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.zeros(int(sizes.sum()) + len(parts), np.int32)
    text[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(parts)), sizes)] = np.frombuffer(b"".join(parts), np.uint8)
    text[begins + sizes] = 256 + np.arange(len(parts))  # no two parts end alike
    order = suffix_array(text)
    counts = np.maximum(sizes - length + 1, 0)
    agree = common_prefixes(text, order, begins, counts, length)
    owner = np.repeat(np.arange(len(parts)), counts)
    part = np.full(len(text), -1)
    part[np.arange(len(owner)) + np.repeat(begins - (np.cumsum(counts) - counts), counts)] = owner
    windows = order[part[order] >= 0]  # equal ones stand side by side, as what is shorter can't stand between them
    return part[windows], windows - begins[part[windows]], agree[windows] >= length


def _runs(docs: DataFrame, length: int, passage: int, gram: int) -> DataFrame:
    """Every run of windows of ``passage`` bytes; ``fit`` is the last start that has ``length`` bytes, before ``lo`` if none has."""

    def run(batches):
        for pdf in batches:
            raw = [t.encode() for t in pdf["text"]]
            keys = pdf["key"].to_numpy()
            cut = []  # (document, offset, bytes): a long text in segments, each with the bytes that its last window's run reaches
            for i, b in enumerate(raw):
                cut += [(i, at, b[at : at + _SEGMENT + length - 1]) for at in range(0, max(1, len(b) - passage + 1), _SEGMENT)]
            for part in arrays.pieces_of(cut, lambda x: len(x[2]), 1_000_000):
                own = cut[part]
                k, grams, content, lo, hi = window_runs([x[2] for x in own], passage, gram, length, _SEGMENT)
                if len(k):
                    doc, at, size = np.array([(i, at, len(b)) for i, at, b in own], np.int64)[k].T
                    yield pd.DataFrame({"key": keys[doc], "gram": grams, "content": content, "lo": lo + at, "hi": hi + at, "fit": np.minimum(hi, size - length) + at})

    return docs.mapInPandas(run, "key long, gram long, content long, lo long, hi long, fit long")


def _with_bytes(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Adds the bytes of runs: one list of runs a document meets its text."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("gram", "content", "shard", "shards", "times", "lo", "hi")).alias("runs"))

    def run(batches):
        for pdf in batches:
            rows = []
            for key, text, runs in zip(pdf["key"], pdf["text"], pdf["runs"]):
                raw = text.encode()
                rows += [(r["gram"], r["content"], r["shard"], r["shards"], r["times"], key, r["lo"], r["hi"] - r["lo"] + 1, raw[r["lo"] : r["hi"] + length]) for r in runs]
            yield pd.DataFrame(rows, columns=["gram", "content", "shard", "shards", "times", "key", "lo", "starts", "bytes"])

    asked = maybe_among(docs, wanted, "key", TEXT_BITS).filter("_among").drop("_among")
    return asked.dropDuplicates(["key"]).join(lists, "key").mapInPandas(run, "gram long, content long, shard int, shards int, times long, key long, lo long, starts long, bytes binary")


_FOUND = "gram long, content long, times long, key long, first long, lo long, hi long, width long, shard long, bucket long, digests binary, places binary"
_FIELDS = [x.split()[0] for x in _FOUND.split(", ")]
_SECOND = np.random.default_rng(20240202).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _window_digests(parts: list[bytes], part: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """16 bytes for each window."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    at = (np.cumsum(sizes) - sizes)[part] + place
    both = np.stack([arrays.span_hashes(data, at, at + width), arrays.span_hashes(data, at, at + width, _SECOND)], 1)
    return np.ascontiguousarray(both).view("S16").ravel()


def _solve(pdf: pd.DataFrame, length: int, passage: int) -> pd.DataFrame:
    """What one suffix array tells: intervals of starts within runs; and, of grams with several shards, their different windows.

    The array holds each run up to the end of its last window of ``passage``
    bytes, equal ones once. Windows of ``length`` bytes refine its classes of
    equal windows by what follows. Intervals are (lo, hi) from a run's first
    start, by ``width``, the bytes that repeat. Windows leave in blocks: of a
    shard, width and bucket the sorted digests and, in that order, keys and
    starts.
    """
    raw, starts, times = pdf["bytes"].tolist(), pdf["starts"].to_numpy(), pdf["times"].to_numpy()
    known: dict[bytes, int] = {}
    of = np.array([known.setdefault(x[: n - 1 + passage], len(known)) for x, n in zip(raw, starts.tolist())])
    part, place, same = equal_windows(list(known), passage)
    counts = np.array([len(k) - passage + 1 for k in known])
    begins = np.cumsum(counts) - counts
    kind = np.empty(len(part), np.int64)
    kind[begins[part] + place] = np.cumsum(~same) - 1
    # Every start of every run: its run, its place there and its class.
    run = np.repeat(np.arange(len(raw)), starts)
    at = np.arange(len(run)) - np.repeat(np.cumsum(starts) - starts, starts)
    kind = kind[begins[of[run]] + at]
    left = np.array([len(x) for x in raw])[run] - at
    widths = [(passage, kind, np.arange(len(run)))]
    if length > passage:
        data, far = np.frombuffer(b"".join(raw), np.uint8), np.flatnonzero(left >= length)
        sizes = np.array([len(x) for x in raw])
        begin = (np.cumsum(sizes) - sizes)[run[far]] + at[far]
        tail = arrays.span_hashes(data, begin + passage, begin + length)
        widths.append((length, arrays.mix(tail ^ arrays.mix(kind[far].astype(np.uint64))), far))
    heads = list(zip(*(pdf[c].tolist() for c in ("gram", "content", "times", "key", "lo"))))
    shards, rows = pdf["shards"].to_numpy(), []
    for width, value, own in widths:
        order = np.argsort(value, kind="stable")
        value = value[order]
        first = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.empty(0, bool)
        again = times[run] > 1
        again[own[order]] |= ~first | ~np.append(first[1:], True)
        again &= left >= width
        hit = np.flatnonzero(again)
        new = np.flatnonzero((np.diff(hit, prepend=-2) > 1) | (np.diff(run[hit], prepend=-1) != 0))
        end = np.append(new[1:], len(hit))[: len(new)] - 1
        rows += [(*heads[i], a, b, width, None, None, None, None) for i, a, b in zip(run[hit[new]].tolist(), at[hit[new]].tolist(), at[hit[end]].tolist())]
        lead = own[order[first]]
        lead = lead[shards[run[lead]] > 1]
        if len(lead):
            rows += _blocks(pdf, raw, run[lead], at[lead], width)
    return pd.DataFrame(rows, columns=_FIELDS, dtype=object).astype({c: "Int64" for c in _FIELDS[:10]})  # through objects: as doubles, keys beside nulls would lose digits


def _blocks(pdf: pd.DataFrame, raw: list[bytes], run: np.ndarray, at: np.ndarray, width: int) -> list[tuple]:
    """Different windows as rows of ``_FOUND``, a row for each shard and bucket."""
    digests = _window_digests(raw, run, at, width)
    shards, places = pdf["shards"].to_numpy()[run], np.stack([pdf["key"].to_numpy()[run], pdf["lo"].to_numpy()[run] + at], 1)
    group = np.stack([pdf["gram"].to_numpy()[run], pdf["shard"].to_numpy()[run], (digests.view("<u8")[::2] % (2 * shards).astype(np.uint64)).astype(np.int64)], 1)
    order = np.lexsort((digests, *group.T[::-1]))
    digests, group, places = digests[order], group[order], places[order]
    cut = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(1)]))
    return [(int(group[a, 0]), None, None, None, None, None, None, width, int(group[a, 1]), int(group[a, 2]), digests[a:b].tobytes(), places[a:b].tobytes()) for a, b in zip(cut, np.append(cut[1:], len(run)))]


def _search_shards(parts: DataFrame, length: int, passage: int) -> DataFrame:
    """Each shard's findings (``_solve``). Shards are sorted together up to ``ARRAY_BYTES``."""
    dealt = parts.repartition("gram", "shard").sortWithinPartitions("gram", "shard")

    def run(batches):
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in batches:
            groups = pdf[["gram", "shard"]].to_numpy()
            cuts = np.append(np.flatnonzero((groups[1:] != groups[:-1]).any(1)) + 1, len(pdf))
            start = 0
            for end in cuts:
                own = pdf.iloc[start:end]
                goes_on = held and tuple(held[-1][["gram", "shard"]].iloc[-1]) == tuple(groups[start])
                if size > ARRAY_BYTES and not goes_on:
                    yield _solve(pd.concat(held, ignore_index=True), length, passage)
                    held, size = [], 0
                held.append(own)
                size += int(own["bytes"].map(len).sum())
                start = end
        if held:
            yield _solve(pd.concat(held, ignore_index=True), length, passage)

    return dealt.mapInPandas(run, _FOUND)


def _shared(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Merges two sorted lists of digests and places by binary search; places of digests of both go to ``found``."""
    at = np.searchsorted(a[0], b[0])
    same = a[0][np.minimum(at, len(a[0]) - 1)] == b[0]
    found += [a[1][at[same]], b[1][same]]
    return np.insert(a[0], at[~same], b[0][~same]), np.insert(a[1], at[~same], b[1][~same], axis=0)


def _merge_shards(blocks: DataFrame) -> DataFrame:
    """Windows (key, lo, hi = lo, width) that several shards of their gram have.

    The sorted blocks of a bucket are merged in pairs, the results again: of S
    shards each window is searched for log S times. Buckets grow in number
    with a gram's shards, so that none holds more than a shard's windows.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = [(np.frombuffer(d, "S16"), np.frombuffer(p, np.int64).reshape(-1, 2)) for d, p in zip(pdf["digests"], pdf["places"])]
        out = [np.empty((0, 2), np.int64)]
        while len(runs) > 1:
            runs = [_shared(*runs[i : i + 2], out) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
        found = pd.DataFrame(np.concatenate(out), columns=["key", "lo"]).drop_duplicates().sort_values(["key", "lo"])
        new = (found["key"].diff() != 0) | (found["lo"].diff() != 1)  # neighbours become one interval
        return found.groupby(new.cumsum()).agg(key=("key", "first"), lo=("lo", "first"), hi=("lo", "last")).assign(width=pdf["width"].iloc[0])

    return blocks.select("gram", "width", "bucket", "digests", "places").groupBy("gram", "width", "bucket").applyInPandas(merge, "key long, lo long, hi long, width long")


def repeat_spans(docs: DataFrame, length: int = LENGTH, passage: int | None = None, gram: int = GRAM) -> DataFrame:
    """key and lists of starts (lo, hi, width): the windows of ``width`` bytes from lo to hi occur elsewhere; texts without one are left out.

    Widths are ``length`` and the shorter ``passage``. ``docs``: key, which
    must differ for different texts, and text. Rows of equal key count as
    occurrences of their own.
    """
    passage = min(passage or length, length)
    every = materialise(_runs(docs, length, passage, gram), "repeat-runs")
    again = every.groupBy("gram").agg(F.count("*").alias("all")).filter("all > 1")
    runs = materialise(maybe_among(every, again, "gram", GRAM_BITS).filter("_among").drop("_among"), "repeat-grams")
    drop_written(every)
    contents = runs.groupBy("gram", "content").agg(F.count("*").alias("times"), F.first("key").alias("key"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("fit").alias("fit"))
    grams = contents.groupBy("gram").agg(F.sum("times").alias("all"), F.count("*").alias("contents")).filter("all > 1").drop("all")
    shards = (F.floor((F.col("contents") - 1) / SHARD_RUNS) + 1).cast("int")
    met = contents.join(grams, "gram").withColumn("shards", shards).withColumn("shard", F.pmod(F.xxhash64("key", "lo"), F.col("shards")).cast("int"))
    met = materialise(met, "repeat-contents")
    wanted = met.filter("contents > 1")
    found = materialise(_search_shards(_with_bytes(wanted, docs, length), length, passage), "repeat-found")
    of_run = found.filter("bucket IS NULL")
    once = of_run.filter("times = 1").select("key", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi"), "width")
    # What was found in a run holds for all runs of its bytes; if its gram has no other content, equal runs are all there is to find.
    only = met.filter("contents = 1")
    ends = F.array(*[F.struct((F.col(c) - F.col("lo")).alias("to"), F.lit(w).cast("long").alias("width")) for c, w in dict.fromkeys((("hi", passage), ("fit", length)))])
    only = only.withColumn("end", F.explode(ends)).select("gram", "content", F.lit(0).cast("long").alias("from"), "end.to", "end.width").filter("to >= 0")
    shared = of_run.filter("times > 1").select("gram", "content", F.col("lo").alias("from"), F.col("hi").alias("to"), "width").union(only)
    equal = runs.select("gram", "content", "key", F.col("lo").alias("at")).join(shared, ["gram", "content"]).select("key", (F.col("at") + F.col("from")).alias("lo"), (F.col("at") + F.col("to")).alias("hi"), "width")
    # A window of several shards stands for its equals in its own shard, which are found already unless it is the only one.
    both = once.union(equal).union(_merge_shards(found.filter("bucket IS NOT NULL")))
    spans = materialise(both.groupBy("key").agg(F.collect_list(F.struct("lo", "hi", "width")).alias("starts")), "repeat-spans")
    for table in (runs, met, found):
        drop_written(table)
    return spans


def _covered(starts, width: int) -> list[list[int]]:
    """Maximal byte ranges covered by windows of ``width`` bytes or more."""
    merged: list[list[int]] = []
    for lo, end in sorted((x["lo"], x["hi"] + x["width"]) for x in starts if x["width"] >= width):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([lo, end])
    return merged


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, passage: int | None = None, words: int = WORDS) -> DataFrame:
    """Each text without the bytes that a repeated window of ``length`` bytes covers.

    Returns a row for each row: doc_id, n_bytes, spans (removed byte ranges,
    end exclusive, maximal), kept (the remaining bytes, joined) and passages
    (ranges covered by repeated windows of ``passage`` bytes, ``length`` if not
    given, with more than ``words`` words; they tell what repeats and remove
    nothing by themselves). Texts are judged as given; windows may overlap and
    may repeat within one text. Null texts are empty; texts shorter than
    ``length`` stay whole. Repeated rows count as repeats of each other. An
    empty table gives an empty one.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    spans = repeat_spans(texts.select("key", "text"), length, passage, gram)

    def run(batches):
        for pdf in batches:
            rows = []
            for doc_id, text, starts in zip(pdf["doc_id"], pdf["text"], pdf["starts"]):
                raw = text.encode()
                starts = [] if starts is None else starts
                gone = _covered(starts, length)
                edges = [0, *(x for s in gone for x in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                again = [(a, b) for a, b in _covered(starts, 0) if len(raw[a:b].split()) > words]
                rows.append((doc_id, len(raw), *([{"start": a, "end": b} for a, b in x] for x in (gone, again)), kept))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "spans", "passages", "kept"])

    ranges = "array<struct<start:long,end:long>>"
    told = maybe_among(texts, spans, "key", TEXT_BITS)
    joined = told.filter("_among").join(spans, "key", "left").unionByName(told.filter("NOT _among").withColumn("starts", F.lit(None)))  # texts without a span stay where they are
    found = joined.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "starts")  # ids as text: beside nulls pandas would make them doubles
    found = found.mapInPandas(run, f"doc_id string, n_bytes long, spans {ranges}, passages {ranges}, kept binary")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), passage=PASSAGE)
    removed = F.col("n_bytes") - F.octet_length("kept")
    number = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return cut.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), number("spans"), F.sha2("kept", 256).alias("kept_sha256"), number("passages"))
