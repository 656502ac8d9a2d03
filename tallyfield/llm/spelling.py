"""Groups of spelling variants: frequent words that differ by one letter.

Letters are hashed to a few symbols. Words within one edit of each other have
reduced forms within one edit, so the full one-edit neighbourhood of a word's
reduced form, joined with the reduced vocabulary, meets every near word. What
meets is verified on the words themselves. Neighbourhoods are 64-bit hashes
made from prefix sums, so a word of any length costs its length times the
number of symbols.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm import arrays
from tallyfield.session import materialise

LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, FEWEST, DROPPED, TIMES = 6, 5, 199, 5
_BACK = np.uint64(pow(int(arrays._MULTIPLIER), -1, 1 << 64))


def lowered(run: str) -> Column:
    """Only A-Z in lower case: by ``lower`` where all characters are of one byte, by ``translate`` else."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, string.ascii_uppercase, string.ascii_lowercase))


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, one_in: int = DROPPED) -> DataFrame:
    """word and n: the runs of all texts, with a letter dropped in one of ``one_in``, of at least ``shortest`` letters and ``fewest`` occurrences.

    A null text has no words; a null doc_id counts as empty text in the CRC.
    Repeated rows count each time. Counts are combined before the shuffle.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_doc"), F.explode(F.regexp_extract_all("text", F.lit(f"([{LETTERS}]+)"), 1)).alias("_run"))
    runs = runs.filter(F.length("_run") >= shortest).select("_doc", lowered("_run").alias("_run"))
    runs = runs.withColumn("_crc", F.crc32(F.encode(F.concat("_doc", F.lit(":"), "_run"), "UTF-8")))
    at = (F.col("_crc") % F.length("_run")).cast("int")
    word = F.when(F.col("_crc") % one_in == 0, F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))).otherwise(F.col("_run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= fewest)


def symbols_for(words: int, shortest: int = SHORTEST) -> int:
    """So many symbols that the shortest words have about as many reduced forms as there are words, 4 to 32: results are the same with any number."""
    return min(32, max(4, math.ceil(max(words, 1) ** (1 / shortest))))


class Reduced:
    """Reduced forms of a batch of words as numbers: symbols of all letters, where words start, and sums over prefixes."""

    def __init__(self, words: list[str], symbols: int):
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
        self.length = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.of = np.repeat(np.arange(len(words)), self.length)
        self.place = np.arange(len(points)) - self.first[self.of]
        self.values = arrays.mix(np.arange(1, symbols + 1, dtype=np.uint64)) | np.uint64(1)
        self.symbol = (arrays.mix(points) % np.uint64(symbols)).astype(np.int64)
        self.power = arrays.powers(int(self.length.max(initial=0)) + 2)
        self.term = self.values[self.symbol] * self.power[self.place]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.term)])
        self.before = sums[:-1] - sums[self.first][self.of]
        self.whole = sums[self.first + self.length] - sums[self.first]

    def _finish(self, sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return arrays.mix(sums + lengths.astype(np.uint64) * arrays._MULTIPLIER).view(np.int64)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's reduced form."""
        return self._finish(self.whole, self.length)

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Index of a word and hash, for each different string within one edit of its reduced form, that form included."""
        of, before, term = self.of, self.before, self.term
        after = self.whole[of] - before - term
        at, length = self.power[self.place], self.length[of]
        words, found = [np.arange(len(self.length))], [self.hashes()]
        words.append(of)
        found.append(self._finish(before + after * _BACK, length - 1))
        end = self.power[self.length]
        for i, value in enumerate(self.values):
            other = self.symbol != i
            words += [of[other], of, np.arange(len(self.length))]
            found.append(self._finish((before + value * at + after)[other], length[other]))
            found.append(self._finish(before + value * at + (term + after) * arrays._MULTIPLIER, length + 1))
            found.append(self._finish(self.whole + value * end, self.length + 1))  # behind the last letter
        word, key = np.concatenate(words), np.concatenate(found)
        order = np.lexsort((key, word))
        word, key = word[order], key[order]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (key[1:] != key[:-1])
        return word[new], key[new]


#: Letters up to which a pair is verified by ``levenshtein``, whose time grows with the square of the length.
_SHORT = 64


def one_edit(a: str, b: str) -> Column:
    """Two strings differ by exactly one inserted, deleted or replaced code point.

    Beyond ``_SHORT`` letters by the length of their common prefix, found in
    halving steps, and what is behind it: time in proportion to the length.
    """
    shorter = f"least(length({a}), length({b}))"
    prefix = f"aggregate(sequence(31, 0), 0, (p, k) -> CASE WHEN p + shiftleft(1L, k) <= {shorter} AND substring({a}, p + 1, CAST(shiftleft(1L, k) AS INT)) = substring({b}, p + 1, CAST(shiftleft(1L, k) AS INT)) THEN CAST(p + shiftleft(1L, k) AS INT) ELSE p END)"
    behind = lambda d: f"CASE WHEN length({a}) = length({b}) THEN {d} < length({a}) AND substring({a}, {d} + 2) = substring({b}, {d} + 2) WHEN length({a}) > length({b}) THEN substring({a}, {d} + 2) = substring({b}, {d} + 1) ELSE substring({a}, {d} + 1) = substring({b}, {d} + 2) END"
    long = f"element_at(transform(array({prefix}), d -> {behind('d')}), 1)"
    return F.expr(f"abs(length({a}) - length({b})) <= 1 AND CASE WHEN {shorter} <= {_SHORT} THEN levenshtein({a}, {b}, 1) = 1 ELSE {long} END")


def near_words(words: DataFrame, rows: int) -> DataFrame:
    """word, n, other, other_n for each two of ``words`` (word, n, each once) that differ by one inserted, deleted or replaced code point, both ways.

    ``words`` is read several times: give it a written table. A row of a
    neighbourhood is two numbers; the words themselves travel once with the
    reduced vocabulary and once for verification. Joins are by merge: Spark
    goes by the compressed size of written words, and would build tables many
    times that size on the driver.
    """
    symbols = symbols_for(rows)
    words = materialise(words.withColumn("id", F.monotonically_increasing_id()), "spelling-words")

    def reduce(batches):
        for pdf in batches:
            for part in arrays.pieces_of(pdf["word"].tolist(), len, 500_000):
                own = pdf[part]
                yield own.drop(columns="id").assign(key=Reduced(own["word"].tolist(), symbols).hashes())

    def surround(batches):
        for pdf in batches:
            for part in arrays.pieces_of(pdf["word"].tolist(), len, 50_000):
                ids = pdf["id"].to_numpy()[part]
                word, key = Reduced(pdf["word"][part].tolist(), symbols).neighbours()
                for a in range(0, len(word), 500_000):
                    yield pd.DataFrame({"id": ids[word[a : a + 500_000]], "key": key[a : a + 500_000]})

    reduced = words.mapInPandas(reduce, "word string, n long, key long").select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    around = words.select("id", "word").mapInPandas(surround, "id long, key long")
    met = around.join(reduced.hint("merge"), "key").drop("key").join(words.hint("merge"), "id")
    return met.filter(one_edit("word", "other")).select("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """word and root for links (word, form), each word once: the form that has no form itself. Counts grow along links, so there are no circles; a round doubles what a link spans."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = materialise(now.join(step.hint("merge"), "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spelling-roots")
        now = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return now


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n for each row of a vocabulary (word, n).

    ``form`` is the near word of the largest n (ties: the smallest in
    code-point order) if that is at least ``times`` the word's. An empty
    vocabulary gives an empty table.
    """
    words = materialise(words, "spelling-vocabulary")
    near = near_words(words, words.count())
    best = near.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    chosen = -F.col("best.less") >= times * F.col("n")
    best = materialise(best.select("word", "n_near", F.when(chosen, F.col("best.other")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n")), "spelling-forms")
    root = roots(best.filter("form IS NOT NULL"))
    whole = words.join(best.hint("merge"), "word", "left").join(root.hint("merge"), "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: CRC-32 byte by byte; near words by equal strings after one deletion each at the same place, or of one of them.
OP13_SQL = """
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL HAVING length(run) >= 6),
bytes AS (SELECT *, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CAST(unicode(x) AS BIGINT)) AS p FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(p, lambda x: CASE WHEN x < 128 THEN [x] ELSE [192 + (x >> 6), 128 + (x & 63)] END))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.d = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.d = b.word),
best AS (SELECT word, n, count(*) AS n_near, max(other_n) AS top, min(other) FILTER (other_n = m) AS other
  FROM (SELECT *, max(other_n) OVER (PARTITION BY word) AS m FROM near) GROUP BY word, n),
forms AS MATERIALIZED (SELECT word, n_near, CASE WHEN top >= 5 * n THEN other END AS form, CASE WHEN top >= 5 * n THEN top END AS form_n FROM best),
chain AS (SELECT word, form AS root FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT w.word, f.form, coalesce(e.root, w.word) AS root, w.n, coalesce(f.n_near, 0) AS n_near, f.form_n
FROM words w LEFT JOIN forms f USING (word) LEFT JOIN ends e ON e.word = w.word
"""
