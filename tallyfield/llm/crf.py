"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its score comes from shape features of the line and
of its neighbours, and chains of lines from transition scores. The field is
trained on a bounded sample of labelled documents; forward-backward marginals,
weighted by line length, give a document's share of good text, and a logistic
curve fitted on whole texts of the same sample turns that into a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm import arrays
from tallyfield.functions.prefix import spread_key
from tallyfield.session import materialise

#: Labelled documents of each class that training sees at most, and neighbouring lines of each that the field is fitted to.
SAMPLE_DOCS, SAMPLE_LINES = 1500, 64
THRESHOLD = 0.7

_KIND = np.zeros(256, np.uint8)  # 1 letter, 2 capital, 3 digit, 4 sentence mark, 5 other mark
_KIND[[*range(97, 123), *range(128, 256)]] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[list(b".,;:?'\"()-")] = 4
_KIND[[b for b in range(33, 127) if not _KIND[b]]] = 5
_OWN = 8
FEATURES = 3 * _OWN - 2 + 1


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines that hold a word, the bytes of their words, and the lines of each text.

    Own features: shares of capitals and digits among bytes, of words that
    hold another mark, of sentence marks among bytes, of words that repeat the
    word before, mean word length, a saturating word count, and a constant. Those of the line before and
    after follow, zeros beyond the text, and how far the mark and repeat
    shares lie from the line before.
    """
    data, starts, ends, first = arrays.words(texts)
    n_words = len(starts)
    if not n_words:
        return np.zeros((0, FEATURES)), np.zeros(0), np.zeros(len(texts), np.int64)
    line_of_byte = np.cumsum(data == 10)
    line = line_of_byte[starts]
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    opens = np.concatenate([[True], (line[1:] != line[:-1]) | (text[1:] != text[:-1])])
    at = np.flatnonzero(opens)
    sizes = ends - starts
    begin, total = np.cumsum(sizes) - sizes, int(sizes.sum())
    kinds = _KIND[data[np.arange(total) + np.repeat(starts - begin, sizes)]]
    bytes_of = np.add.reduceat(sizes, at).astype(float)
    words_of = np.diff(np.append(at, n_words)).astype(float)
    marked = np.add.reduceat(kinds == 5, begin, dtype=np.int64) > 0
    counts = [np.add.reduceat(kinds == k, begin[at], dtype=np.int64) / bytes_of for k in (2, 3)]
    counts += [np.add.reduceat(marked, at, dtype=np.int64) / words_of, np.add.reduceat(kinds == 4, begin[at], dtype=np.int64) / bytes_of]
    h = arrays.run_hashes(data, starts, ends)
    repeats = np.concatenate([[False], h[1:] == h[:-1]]) & ~opens
    again = np.add.reduceat(repeats, at, dtype=np.int64) / words_of
    own = np.stack([*counts, again, np.minimum(bytes_of / words_of, 20) / 10, words_of / (words_of + 10), np.ones(len(at))], 1)
    lines = np.bincount(text[at], minlength=len(texts))
    head = np.cumsum(lines)[lines > 0] - lines[lines > 0]
    tail = np.cumsum(lines)[lines > 0] - 1
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[head], after[tail] = 0, 0
    step = np.abs(own[:, [2, 4]] - before[:, [2, 4]]) * before[:, -1:]
    keep = np.concatenate([own, before[:, :-2], after[:, :-2], step[:, :2], before[:, -1:]], 1)
    return keep, bytes_of, lines


@dataclass
class Field:
    """Emission weights of "good", transition scores [from, to], and the curve from good share to score."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float
    offset: float

    def marginals(self, emit: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """P(good) of each line; ``emit`` are scores of good over bad, ``lines`` how many each text has. Texts step together."""
        order = np.argsort(-lines, kind="stable")
        order = order[lines[order] > 0]
        begin = (np.cumsum(lines) - lines)[order]
        count = lines[order]
        m, out = self.moves, np.zeros((len(emit), 2))
        a0 = a1 = np.zeros(0)
        longest = int(count.max(initial=0))
        alive = np.searchsorted(-count, -np.arange(longest), "left")  # texts with more than t lines
        for t in range(longest):
            k = alive[t]
            e = emit[begin[:k] + t]
            if t:
                a0, a1 = np.logaddexp(a0[:k] + m[0, 0], a1[:k] + m[1, 0]), e + np.logaddexp(a0[:k] + m[0, 1], a1[:k] + m[1, 1])
            else:
                a0, a1 = np.zeros(k), e
            top = np.maximum(a0, a1)
            a0, a1 = a0 - top, a1 - top
            out[begin[:k] + t, 0], out[begin[:k] + t, 1] = a0, a1
        b0 = b1 = np.zeros(len(count))
        for t in range(longest - 1, -1, -1):
            k = alive[t]
            more = alive[t + 1] if t + 1 < longest else 0
            n0, n1 = np.zeros(k), np.zeros(k)
            if more:
                e = emit[begin[:more] + t + 1]
                n0[:more] = np.logaddexp(m[0, 0] + b0[:more], m[0, 1] + e + b1[:more])
                n1[:more] = np.logaddexp(m[1, 0] + b0[:more], m[1, 1] + e + b1[:more])
                top = np.maximum(n0, n1)
                n0, n1 = n0 - top, n1 - top
            b0, b1 = n0, n1
            out[begin[:k] + t, 0] += b0
            out[begin[:k] + t, 1] += b1
        return 1 / (1 + np.exp(np.clip(out[:, 0] - out[:, 1], -500, 500)))

    def shares(self, features: np.ndarray, sizes: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Good bytes among the bytes of each text; NaN without a word."""
        p = self.marginals(features @ self.weights, lines)
        text = np.repeat(np.arange(len(lines)), lines)
        total = np.bincount(text, sizes, len(lines))
        with np.errstate(invalid="ignore"):
            return np.bincount(text, sizes * p, len(lines)) / np.where(total > 0, total, np.nan)

    def scores(self, texts: list[str]) -> np.ndarray:
        """0 to 1; a text without a word scores 0."""
        out = np.zeros(len(texts))
        for part in arrays.pieces_of(texts, len, 500_000):
            share = self.shares(*line_features([t.encode() for t in texts[part]]))
            curve = 1 / (1 + np.exp(-np.clip(self.slope * share + self.offset, -500, 500)))
            out[part] = np.where(np.isnan(share), 0.0, curve)
        return out


def _gradient(x: np.ndarray, y: np.ndarray, mask: np.ndarray, w: np.ndarray, m: np.ndarray):
    """Of the log-likelihood of padded chains (texts, places), by weights and moves; and emission-only P(good)."""
    e = np.where(mask, x @ w, 0.0)
    n, places = mask.shape
    a, b = np.zeros((n, places, 2)), np.zeros((n, places, 2))
    a[:, 0, 1] = e[:, 0]
    for t in range(1, places):
        for to in (0, 1):
            a[:, t, to] = np.logaddexp(a[:, t - 1, 0] + m[0, to], a[:, t - 1, 1] + m[1, to]) + to * e[:, t]
    for t in range(places - 2, -1, -1):
        on = mask[:, t + 1]
        for frm in (0, 1):
            b[on, t, frm] = np.logaddexp(m[frm, 0] + b[on, t + 1, 0], m[frm, 1] + e[on, t + 1] + b[on, t + 1, 1])
    both = a + b
    z = np.logaddexp(both[:, 0, 0], both[:, 0, 1])
    p = np.where(mask, np.exp(both[..., 1] - z[:, None]), 0.0)
    gw = np.einsum("ntf,nt->f", x, np.where(mask, y - p, 0.0))
    gm, pair = np.zeros((2, 2)), mask[:, 1:]
    for frm in (0, 1):
        for to in (0, 1):
            seen = (y[:, :-1] == frm) & (y[:, 1:] == to) & pair
            expect = np.exp(a[:, :-1, frm] + m[frm, to] + to * e[:, 1:] + b[:, 1:, to] - z[:, None])
            gm[frm, to] = seen.sum() - expect[pair].sum()
    return gw, gm, 1 / (1 + np.exp(-np.clip(e, -500, 500)))


def _ascend(gradient, start: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    """Adam, with a fixed number of rounds, so that reruns agree."""
    p, first, second = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for i in range(1, rounds + 1):
        g = gradient(p)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        p += rate * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.99**i)) + 1e-9)
    return p


def fit(docs: list[tuple[np.ndarray, int]], rounds: int = 150, penalty: float = 3e-5) -> Field:
    """Fits a field, without its curve, to (line features, label) of documents.

    At first all lines have their document's label. Then lines of bad
    documents that look good by themselves count as good, as a bad document
    may begin well, and the field is fitted again.
    """
    docs = [d for d in docs if len(d[0])]
    labels = np.array([d[1] for d in docs])
    if not len(docs) or labels.min() == labels.max():
        # Nothing to tell apart: every text with words scores 1, or 0 if all that is known is bad.
        return Field(np.zeros(FEATURES), np.zeros((2, 2)), 0.0, -500.0 if len(docs) and labels[0] == 0 else 500.0)
    places = max(len(d[0]) for d in docs)
    x, mask = np.zeros((len(docs), places, FEATURES)), np.zeros((len(docs), places), bool)
    for i, (f, _) in enumerate(docs):
        x[i, : len(f)], mask[i, : len(f)] = f, True
    y = np.repeat(labels[:, None], places, 1)
    p = np.zeros(FEATURES + 4)
    for turn in (0, 1):
        def gradient(p):
            gw, gm, _ = _gradient(x, y, mask, p[:FEATURES], p[FEATURES:].reshape(2, 2))
            return np.concatenate([gw, gm.ravel()]) / mask.sum() - penalty * p

        p = _ascend(gradient, p, rounds, 0.3)
        if turn == 0:
            alone = _gradient(x, y, mask, p[:FEATURES], p[FEATURES:].reshape(2, 2))[2]
            better = np.where(mask & (labels[:, None] == 0), (alone > 0.5).astype(int), y)
            some_bad = ((better == 0) & mask).any(1) | (labels == 1)
            y = np.where(some_bad[:, None], better, y)
    field = Field(p[:FEATURES], p[FEATURES:].reshape(2, 2), 0.0, 0.0)
    return field


def fit_curve(field: Field, share: np.ndarray, labels: np.ndarray) -> Field:
    """``field`` with the curve from the good shares of whole texts, none NaN, to their labels."""
    if field.slope == 0.0 and field.offset != 0.0:
        return field
    weight = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())

    def curve(c):
        off = weight * (labels - 1 / (1 + np.exp(-np.clip(c[0] * share + c[1], -500, 500))))
        return np.array([(off * share).sum(), off.sum()]) - 1e-4 * c

    slope, offset = _ascend(curve, np.array([1.0, -0.5]), 400, 0.2)
    field.slope, field.offset = float(slope), float(offset)
    return field


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document's labels are never seen: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_DOCS, lines: int = SAMPLE_LINES) -> Field:
    """A field from at most ``per_class`` labelled documents of each quality, by hash of their id.

    Its weights are fitted to ``lines`` neighbouring lines of each, from a
    place that the id's hash picks in the whole text, whose features still see
    the lines around them; its curve is fitted to whole texts. Only rows that
    aren't ``held_out`` are seen. Null labels, other labels than 0 and 1, and
    labels without a document don't count.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(~held_out() & F.col("doc_id").isNotNull())
    order = spread_key("doc_id", seed="train")
    some = [known.filter(F.col("quality") == q).dropDuplicates(["doc_id"]).orderBy(order, "doc_id").limit(per_class) for q in (0, 1)]
    sample = some[0].union(some[1])  # 2 * per_class rows at most, so it may be broadcast
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])
    texts = materialise(texts.select("doc_id", "quality", "text", spread_key("doc_id", seed="lines").alias("place")), "quality-sample")

    def chosen(batches):
        for pdf in batches:
            rows = []
            for doc_id, q, text, place in zip(pdf["doc_id"], pdf["quality"], pdf["text"], pdf["place"]):
                f = line_features([text.encode()])[0]
                at = place % max(1, len(f) - lines + 1)
                rows.append((doc_id, q, f[at : at + lines].ravel().tolist()))
            yield pd.DataFrame(rows, columns=["doc_id", "quality", "features"])

    found = texts.mapInPandas(chosen, "doc_id long, quality int, features array<double>").collect()
    found.sort(key=lambda r: r["doc_id"])
    field = fit([(np.array(r["features"]).reshape(-1, FEATURES), r["quality"]) for r in found])

    def shares(batches):
        for pdf in batches:
            raw = [t.encode() for t in pdf.pop("text")]
            got = [field.shares(*line_features(raw[part])) for part in arrays.pieces_of(raw, len, 500_000)]
            yield pdf[["doc_id", "quality"]].assign(share=np.concatenate(got))

    whole = [r for r in texts.mapInPandas(shares, "doc_id long, quality int, share double").collect() if r["share"] is not None]  # null without a word
    whole.sort(key=lambda r: r["doc_id"])
    return fit_curve(field, np.array([r["share"] for r in whole]), np.array([r["quality"] for r in whole]))


def quality_score(field: Field, text: str = "text") -> Column:
    """The score of a text column; null and wordless texts score 0."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(field.scores(texts.fillna("").tolist()))

    return score(F.col(text))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose text scores ``threshold`` or more."""
    return docs.filter(quality_score(train(docs, labels)) >= threshold)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    field = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", held_out().alias("held_out"), quality_score(field).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int"))
