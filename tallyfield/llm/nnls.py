"""Packing by non-negative least squares over combinations of lengths that fill a window.

Documents are cut into whole windows and a rest. Only how many pieces have
each length matters for the plan, so it is made on the driver from the
histogram, which has at most ``capacity`` rows whatever the corpus: pairs and
triples of lengths that fill a window are enumerated, how often each repeats
is solved against the histogram and rounded, and what is left is packed
greedily, cutting a piece where nothing fits. The last tokens fill sequences
of powers of two, which need no padding either. Pieces then take their places
by their rank among those of their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.functions.prefix import running_totals, spread_key
from tallyfield.llm import arrays
from tallyfield.llm.keyed import map_keyed
from tallyfield.session import materialise

CAPACITY, END_ID = 2048, 1
#: Combinations that a plan keeps, however large the corpus, and solver steps each time they are thinned out.
COLUMNS, STEPS = 4096, 60
#: What combinations leave is packed in units of about 2^-BITS of its pieces, then in smaller ones.
BITS = 16


class ByteTokenizer:
    """Ids of a byte-level BPE file, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    The file's vocabulary with the pre-tokenizer's pattern in tiktoken, which
    is several times faster; special strings inside a text are cut out first,
    as the tokenizer itself does.
    """

    #: Fixed: the pattern of byte-level pre-tokenizers.
    _PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # A byte alphabet writes printable bytes as themselves and the others, in order, as the characters from 256.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.specials = {t["content"]: np.array([t["id"]], "<u4") for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.specials}
        self.bpe = tiktoken.Encoding("bytes", pat_str=self._PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        parts: list = [text]
        for special, ids in self.specials.items():
            if special in text:
                parts = [x for p in parts for x in (self._split(p, special, ids) if isinstance(p, str) else [p])]
        out = [self.bpe.encode_to_numpy(p, disallowed_special=()) if isinstance(p, str) else p for p in parts]
        return out[0] if len(out) == 1 else np.concatenate(out)

    @staticmethod
    def _split(text: str, special: str, ids: np.ndarray) -> list:
        first, *others = text.split(special)
        return [first, *(x for o in others for x in (ids, o))]


_TOKENIZERS: dict[str, ByteTokenizer] = {}


def tokenizer(path: str) -> ByteTokenizer:
    """The worker's tokenizer of a path, loaded once."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ByteTokenizer(path)
    return _TOKENIZERS[path]


def windows(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Each document's whole windows and its rest: row, doc_id, start, length, ids_crc32, doc_tokens, ids.

    A document is its ids and then ``END_ID``; a null or empty text is that one
    id. Every row counts, also where a doc_id repeats or is null; ``row`` is
    its own once the table is written. ``ids`` are those of a rest as 32-bit
    little-endian numbers, as it may be cut; a whole window never is.
    """

    def run(batches):
        coder = tokenizer(path)
        for pdf in batches:
            for part in arrays.pieces_of(pdf["text"].tolist(), len, 2_000_000):
                rows = []
                for row, doc_id, text in zip(pdf["row"][part], pdf["doc_id"][part], pdf["text"][part]):
                    ids = np.append(coder.encode(text), np.uint32(END_ID)).astype("<u4")
                    for start in range(0, len(ids), capacity):
                        own = ids[start : start + capacity].tobytes()
                        rows.append((doc_id, row, start, len(own) // 4, zlib.crc32(own), len(ids), own if len(own) < 4 * capacity else None))
                yield pd.DataFrame(rows, columns=["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    return map_keyed(texts, ("doc_id",), run, "row long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def fillings(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All pairs and triples of ``lengths`` (ascending) that sum to ``capacity``: three columns, descending, 0 where a pair has no third."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    there[0] = True  # the third of a pair
    found = []
    for a in lengths[lengths * 3 >= capacity]:
        rest = capacity - int(a)
        b = np.arange((rest + 1) // 2, min(int(a), rest) + 1)
        b = b[(b > 0) & there[b] & there[rest - b]]
        found.append(np.column_stack([np.full(len(b), a), b, rest - b]))
    return np.concatenate(found) if found else np.empty((0, 3), np.int64)


def solve(columns: np.ndarray, counts: np.ndarray, steps: int = STEPS, x: np.ndarray | None = None) -> np.ndarray:
    """Repeats x >= 0 of each column that bring the lengths they use near to ``counts``, in least squares.

    Multiplicative steps: they keep x non-negative and never raise the error.
    Place 0 of ``counts`` stands for "no third length" and has no weight.
    """
    size = len(counts)
    if x is None:
        x = np.full(len(columns), max(1.0, float(counts.sum())) / max(1, len(columns)))
    gather = lambda r: r[columns[:, 0]] + r[columns[:, 1]] + r[columns[:, 2]]
    want = counts.astype(float)
    want[0] = 0
    top = gather(want)
    for _ in range(steps):
        used = sum(np.bincount(columns[:, i], x, size) for i in range(3))
        used[0] = 0
        x = x * top / (gather(used) + 1e-12)
    return x


class WindowPlan:
    """Where the pieces of each length go, for counts of pieces by length.

    ``runs`` has a row (length, rank, sequence, offset, take, rest): pieces of
    ``length`` from ``rank`` on go, one a sequence from ``sequence`` on, to
    ``offset``, with their first ``take`` tokens; what is left of them are
    pieces of that length from rank ``rest`` on. How many rows there are
    depends on the lengths, not on how many pieces have them.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, columns: int = COLUMNS):
        self.capacity = capacity
        self.left = [0] * (capacity + 1)  # Python integers: totals may be large
        for length, n in counts.items():
            self.left[length] = n
        self.used = [0] * (capacity + 1)
        self.known = list(self.left)  # pieces of each length so far, rests of others included
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self.cuts = 0
        self._deal_in(1)
        if n := self.left[capacity]:
            self._close([self._take(capacity, n)], n)
        self._combine(columns)
        unit = max(1, sum(self.left) >> BITS)
        while True:
            self._deal_in(unit)
            while self.total >= capacity * unit:
                first = self.present.bit_length() - 1
                n = min(self.left[first] // unit, self.total // (capacity * unit)) * unit
                self._fill([self._take(first, n)], capacity - first, n)
            if unit == 1:
                break
            unit = max(1, min(unit // 2, sum(self.left) >> BITS))
        for power in range(capacity.bit_length() - 1, -1, -1):
            if self.total >> power & 1:
                self._fill([], 1 << power, 1)

    def _deal_in(self, unit: int) -> None:
        """From now on pieces of a length are taken ``unit`` at a time, so that many pieces need no more steps than few; those left over go by a smaller unit."""
        self.unit = unit
        self.present = sum(1 << x for x, n in enumerate(self.left) if n >= unit)
        self.total = sum(x * (n - n % unit) for x, n in enumerate(self.left))

    def _take(self, length: int, n: int, take: int = 0) -> tuple[int, int, int, int]:
        """The next ``n`` pieces of a length, whole or their first ``take`` tokens: (length, rank, take, rest)."""
        rank, rest = self.used[length], -1
        self.used[length] += n
        self._count(length, -n)
        if take:
            self.cuts += n
            rest = self.known[length - take]
            self.known[length - take] += n
            self._count(length - take, n)
        self.total -= (take or length) * n
        return length, rank, take or length, rest

    def _count(self, length: int, n: int) -> None:
        self.left[length] += n
        if self.left[length] >= self.unit:
            self.present |= 1 << length
        else:
            self.present &= ~(1 << length)

    def _close(self, parts: list[tuple[int, int, int, int]], n: int) -> None:
        """``n`` sequences that hold ``parts`` one behind the other."""
        offset = 0
        for length, rank, take, rest in parts:
            self.runs.append((length, rank, self.sequences, offset, take, rest))
            offset += take
        self.sequences += n

    def _combine(self, most: int) -> None:
        """Combinations as often as the solution repeats them, as far as there are pieces."""
        counts = np.array([float(n) for n in self.left])
        columns = fillings(np.flatnonzero(counts[: self.capacity]), self.capacity)
        if not len(columns):
            return
        most = min(most, max(16, int(counts.sum()) // 8))  # no more columns than can repeat a few times
        x = solve(columns, counts)
        while len(columns) > most:
            keep = np.argsort(-x, kind="stable")[: max(most, len(columns) // 4)]
            columns = columns[keep]
            x = solve(columns, counts, x=np.maximum(x[keep], 1e-9))
        for i in np.argsort(-x, kind="stable"):
            parts = [int(p) for p in columns[i] if p]
            n = min(round(float(x[i])), *(self.left[p] // parts.count(p) for p in parts))
            if n > 0:
                self._close([self._take(p, n) for p in parts], n)

    def _fill(self, parts: list[tuple[int, int, int, int]], gap: int, n: int) -> None:
        """Fills ``n`` sequences to the brim: the longest piece that fits, else the shortest one, cut.

        No more sequences are begun than there are tokens for, so something is always left to put in.
        """
        bundles = [(parts, gap, n)]
        while bundles:
            parts, gap, n = bundles.pop()
            if not gap:
                self._close(parts, n)
                continue
            fits = self.present & ((1 << (gap + 1)) - 1)
            if fits:
                length, take = fits.bit_length() - 1, 0
            else:
                longer = self.present >> (gap + 1)
                length, take = gap + (longer & -longer).bit_length(), gap
            k = min(n, self.left[length] - self.left[length] % self.unit)
            if k < n:
                bundles.append(([(p, rank + k, t, rest + k if rest >= 0 else rest) for p, rank, t, rest in parts], gap, n - k))
            bundles.append((parts + [self._take(length, k, take)], gap - (take or length), k))

    def table(self) -> np.ndarray:
        """``runs`` by length and rank."""
        runs = np.array(self.runs, np.int64).reshape(-1, 6)
        return runs[np.lexsort((runs[:, 1], runs[:, 0]))]


def place(pieces: DataFrame, plan: WindowPlan, rows: int) -> DataFrame:
    """Pieces (row, doc_id, start, length, ids_crc32, doc_tokens) in their sequences; those that the plan cuts are several rows without an ids_crc32."""
    runs = plan.table()
    keys = runs[:, 0] << 45 | runs[:, 1]

    def run(batches):
        for pdf in batches:
            rank, length = pdf["_rank"].to_numpy(np.int64), pdf["length"].to_numpy(np.int64)
            start, own = pdf["start"].to_numpy(np.int64), np.arange(len(pdf))
            whole = np.ones(len(pdf), bool)
            while len(own):
                at = np.searchsorted(keys, length << 45 | rank, "right") - 1
                _, first, sequence, offset, take, rest = runs[at].T
                whole &= take == length
                crc = pdf["ids_crc32"].iloc[own].astype("Int64").where(whole)
                out = pdf[["doc_id", "row", "doc_tokens"]].iloc[own]
                yield out.assign(start=start, length=take, ids_crc32=crc.to_numpy(object, na_value=None), sequence_id=sequence + rank - first, offset=offset)
                more = take < length
                own, rank, length, start = own[more], (rest + rank - first)[more], (length - take)[more], (start + take)[more]
                whole = np.zeros(len(own), bool)

    keyed = pieces.drop("ids").withColumn("_key", spread_key("row", "start", seed="windows")).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_totals(keyed, "length", "_key", ["row", "start"], "_one", "_rank", rows).withColumn("_rank", F.col("_rank").cast("long"))
    return map_keyed(ranked.select("row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "_rank"), ("doc_id",), run, "row long, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_windows(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents in sequences without padding: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``capacity`` is a power of two. All sequences are full but at most one of
    each smaller power of two, which is full at that length. An empty table
    gives an empty one; other columns than doc_id and text are not read.
    """
    pieces = materialise(windows(docs, path or vocabulary(), capacity), "windows")
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = WindowPlan(counts, capacity)
    placed = materialise(place(pieces, plan, sum(counts.values())), "windows-placed")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = placed.filter("ids_crc32 IS NOT NULL").select(*names)
    cut = placed.filter("ids_crc32 IS NULL").drop("ids_crc32")
    lengths = sorted({length for length, _, _, _, take, _ in plan.runs if take < length and length <= capacity})
    rests = pieces.filter(F.col("length").isin(lengths) & F.col("ids").isNotNull()).select("row", F.col("start").alias("_from"), "ids")
    own = F.expr("crc32(substring(ids, CAST(4 * (start - _from) + 1 AS INT), CAST(4 * length AS INT)))")
    return whole.union(cut.join(rests, "row").withColumn("ids_crc32", own).select(*names))


def op12_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
