"""Best-fit packing of tokenised documents by exact complements.

Documents become pieces of at most ``capacity`` tokens. Only how many pieces
have each length matters for the plan, so it is made from the histogram, which
has at most ``capacity`` rows whatever the corpus: availability counts, an
index of single, pair and triple length sums, combinations that fill a gap
exactly, then the largest piece that fits. Pieces then take their places by
their rank among those of their length.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm import arrays
from tallyfield.llm.keyed import map_keyed
from tallyfield.functions.prefix import running_totals, spread_key
from tallyfield.session import materialise

CAPACITY = 2048
END_ID = 0


class WordTokenizer:
    """Ids of a BPE tokenizer whose merges stay inside words (end-of-word suffix, byte alphabet).

    Gives what ``Tokenizer.encode(text, add_special_tokens=False)`` gives.
    Texts of plain Latin letters, ASCII digits and punctuation are cut into
    words in numpy and every distinct word is encoded once, by the same merges
    with a space as the end-of-word mark; any other text goes to the tokenizer
    itself. Distinct words are kept up to ``most_words``, then forgotten.
    """

    #: A character outside these sends a text to the tokenizer itself: tab, line ends, printable ASCII without the apostrophe (contractions), Latin letters.
    _PLAIN = re.compile("[^\t\n\r\x20-\x26\x28-\x7e" + "".join(chr(c) for c in range(0xC0, 0x250) if unicodedata.category(chr(c))[0] == "L" and chr(c) != "İ") + "]")

    def __init__(self, path: str, most_words: int = 300_000):
        import json

        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        suffix = spec["model"]["end_of_word_suffix"]
        # A byte alphabet writes printable bytes as themselves and the others, in order, as the characters from 256.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token in self.specials:
                continue
            ends = token.endswith(suffix) and token != suffix
            ranks[bytes(byte_of[c] for c in (token[: -len(suffix)] if ends else token)) + b" " * ends] = i
        self.bpe = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(ranks.values()) + 1, bool)
        self.ends[[i for b, i in ranks.items() if b.endswith(b" ") and len(b) > 1]] = True
        kinds = np.full(256, 3, np.uint8)
        kinds[arrays.SPACE] = 0
        kinds[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
        kinds[48:58] = 2
        self.kinds, self.most_words = kinds, most_words
        self._forget()

    @functools.cached_property
    def exact(self):
        """The tokenizer itself, loaded when a text first needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.store, self.used = np.empty(1 << 16, np.uint32), 0
        self.first, self.count = np.empty(1 << 15, np.int64), np.empty(1 << 15, np.int64)

    def encode(self, texts: list[str], chunk: int = 500_000) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if self._PLAIN.search(t) or any(s in t for s in self.specials):
                out[i] = np.array(self.exact.encode(t, add_special_tokens=False).ids, np.uint32)
            else:
                plain.append((i, t.lower().encode()))
        for part in arrays.pieces_of(plain, lambda x: len(x[1]), chunk):
            for (i, _), ids in zip(plain[part], self._encode_plain([b for _, b in plain[part]])):
                out[i] = ids
        return out

    def _encode_plain(self, texts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        kind = self.kinds[data]
        before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
        starts = np.flatnonzero((kind != 0) & ((kind != before) | (kind == 2)))
        ends = np.append(starts[1:], len(data))
        gaps = np.flatnonzero((kind == 0) & (before != 0))  # a word ends where the next one starts, or at the space before that
        if len(starts):
            after = np.append(gaps, len(data))[np.searchsorted(gaps, starts, "right")]
            ends = np.minimum(ends, after)
        hashes = arrays.run_hashes(data, starts, ends)
        codes, distinct = pd.factorize(hashes)
        if len(self.known) + len(distinct) > self.most_words:
            self._forget()
        at = np.fromiter(map(self.known.get, distinct.tolist(), [-1] * len(distinct)), np.int64, len(distinct))
        if len(new := np.flatnonzero(at < 0)):
            where = np.empty(len(distinct), np.int64)
            where[codes[::-1]] = np.arange(len(codes))[::-1]
            raw = data.tobytes()
            at[new] = self._learn([raw[starts[w] : ends[w]] for w in where[new]], distinct[new])
        index = at[codes]
        counts = self.count[index]
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = self.store[np.repeat(self.first[index] - total[:-1], counts) + np.arange(total[-1])]
        edges = total[np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))]
        return [ids[a:b] for a, b in zip(edges[:-1], edges[1:])]

    def _learn(self, new: list[bytes], hashes: np.ndarray) -> np.ndarray:
        ids = np.array(self.bpe.encode_ordinary(b" ".join(new).decode() + " "), np.uint32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(new):  # then words can't be told apart by their ends: each by the tokenizer itself
            own = [np.array(self.exact.encode(w.decode(), add_special_tokens=False).ids, np.uint32) for w in new]
            ids, last = np.concatenate(own), np.cumsum([len(x) for x in own]) - 1
        n, k = len(self.known), len(new)
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.empty_like(self.store)])
        while n + k > len(self.first):
            self.first, self.count = (np.concatenate([x, np.empty_like(x)]) for x in (self.first, self.count))
        self.store[self.used : self.used + len(ids)] = ids
        begin = np.concatenate([[0], last[:-1] + 1])
        self.first[n : n + k], self.count[n : n + k] = begin + self.used, last + 1 - begin
        self.used += len(ids)
        at = np.arange(n, n + k)
        self.known.update(zip(hashes.tolist(), at.tolist()))
        return at


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer of a path: loaded once, its words kept between tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def _cut(n: int, capacity: int) -> list[int]:
    return list(range(0, n, capacity)) if n > capacity else [0]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of each document: doc_id, piece, start, length, ids_crc32 and, if asked for, token_ids.

    A document is its ids and then ``END_ID``; a null or empty text is that
    one id. Only what is longer than ``capacity`` is cut, into whole pieces
    and a rest. Each row counts, also when a doc_id repeats.
    """

    def run(batches):
        coder = tokenizer(path)
        for pdf in batches:
            for part in arrays.pieces_of(pdf["text"].tolist(), len, 2_000_000):
                rows = []
                for doc_id, ids in zip(pdf["doc_id"][part], coder.encode(pdf["text"][part].tolist())):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for k, start in enumerate(_cut(len(ids), capacity)):
                        own = ids[start : start + capacity]
                        rows.append((doc_id, k, start, len(own), zlib.crc32(own.tobytes()), *([own.tolist()] if keep_ids else [])))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["token_ids"] * keep_ids])

    schema = "piece int, start long, length long, ids_crc32 long" + ", token_ids array<long>" * keep_ids
    return map_keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), ("doc_id",), run, schema)


class ComplementPlan:
    """Patterns of lengths, each with how many sequences follow it, for counts of pieces by length."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = [0] * (capacity + 1)
        for length, n in counts.items():
            self.left[length] = n
        self.single = sum(1 << x for x, n in enumerate(self.left) if n)
        self.pairs: int | None = None
        self.patterns: list[tuple[list[int], int]] = []
        for first in range(capacity, 0, -1):
            while self.left[first]:
                n = -(-self.left[first] // (capacity // first))  # short lengths may fill gaps behind their equals
                self._take(first, n)
                self._fill([first], capacity - first, n)

    def _take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            self.single &= ~(1 << length)
            self.pairs = None

    def _has(self, length: int) -> bool:
        return bool(self.single >> length & 1)

    def _pair_sums(self) -> int:
        """A bit for each sum of two lengths that are both there."""
        if self.pairs is None:
            self.pairs, rest = 0, self.single
            while rest:
                low = rest & -rest
                self.pairs |= self.single << (low.bit_length() - 1)
                rest ^= low
            self.pairs &= (1 << (self.capacity + 1)) - 1
        return self.pairs

    def _enough(self, parts: list[int]) -> int:
        """How often ``parts`` can be taken together."""
        return min(self.left[x] // parts.count(x) for x in parts)

    def _pair(self, gap: int, most: int) -> list[int] | None:
        for b in range(min(gap - 1, most), (gap + 1) // 2 - 1, -1):
            if self._has(b) and self._has(gap - b) and self._enough([b, gap - b]):
                return [b, gap - b]
        return None

    def _exact(self, gap: int) -> list[int] | None:
        """One, two or three lengths that are there and sum to ``gap``, the largest first."""
        if self._has(gap):
            return [gap]
        sums = self._pair_sums()
        if sums >> gap & 1 and (found := self._pair(gap, gap)):
            return found
        rest = self.single & ((1 << max(gap - 1, 0)) - 1)
        while rest:
            b = rest.bit_length() - 1
            rest ^= 1 << b
            if 3 * b < gap:
                return None
            if sums >> (gap - b) & 1 and (two := self._pair(gap - b, b)) and self._enough([b, *two]):
                return [b, *two]
        return None

    def _fill(self, pattern: list[int], gap: int, n: int) -> None:
        bundles = [(pattern, gap, n)]
        while bundles:
            pattern, gap, n = bundles.pop()
            while n:
                found = self._exact(gap) if gap else None
                if found:
                    k = min(n, self._enough(found))
                    for x in found:
                        self._take(x, k)
                    self.patterns.append((pattern + found, k))
                elif gap and (fits := self.single & ((1 << (gap + 1)) - 1)):
                    b = fits.bit_length() - 1  # the largest that fits leaves the smallest gap
                    k = min(n, self.left[b])
                    self._take(b, k)
                    bundles.append((pattern, gap, n - k))
                    pattern, gap, n = pattern + [b], gap - b, k
                    continue
                else:
                    k = n
                    self.patterns.append((pattern, k))
                n -= k

    def slots(self) -> pd.DataFrame:
        """Where pieces go: for each length, runs of ranks with the first sequence of the run and the offset in it."""
        rows, used, base = [], dict.fromkeys(range(self.capacity + 1), 0), 0
        for pattern, n in self.patterns:
            offset = 0
            for x in pattern:
                rows.append((x, used[x], base, offset))
                used[x] += n
                offset += x
            base += n
        return pd.DataFrame(rows, columns=["length", "rank", "sequence_id", "offset"]).sort_values(["length", "rank"], ignore_index=True)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length), each length from 1 to ``capacity``.

    ``pieces`` is read several times: give it a written table. Sequences are
    filled from offset 0 without gaps. An empty table gives an empty one.
    """
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots = ComplementPlan(counts, capacity).slots()
    keys = slots["length"].to_numpy(np.int64) << 45 | slots["rank"].to_numpy(np.int64)
    ranks, sequences, offsets = (slots[c].to_numpy(np.int64) for c in ("rank", "sequence_id", "offset"))

    def run(batches):
        for pdf in batches:
            rank = pdf["_rank"].to_numpy(np.int64)
            at = np.searchsorted(keys, pdf["length"].to_numpy(np.int64) << 45 | rank, "right") - 1
            yield pdf.drop(columns=["_rank"]).assign(sequence_id=sequences[at] + rank - ranks[at], offset=offsets[at])

    keyed = pieces.withColumn("_key", spread_key("doc_id", "piece", seed="pack")).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_totals(keyed, "length", "_key", ["doc_id", "piece"], "_one", "_rank", sum(counts.values())).select(*pieces.columns, F.col("_rank").cast("long").alias("_rank"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "doc_id")
    return map_keyed(ranked, ("doc_id",), run, f"{fields}, sequence_id long, offset long")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenises and packs documents: a row for each piece with its sequence and place there."""
    return pack(materialise(token_pieces(docs, path or vocabulary(), capacity, keep_ids), "pack-pieces"), capacity)


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
