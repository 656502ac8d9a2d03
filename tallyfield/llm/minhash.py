"""Near-duplicate detection by min-max hashing.

Each of ``PERMS`` hash functions gives two signature values, the smallest and
the largest over a document's shingles; either agrees between two documents
with probability equal to their Jaccard similarity. Bands of ``BAND`` values
make candidates and full shingle sets confirm them.

Texts with equal sets are one class and only classes take part. In a bucket
all classes are first compared with its smallest; classes that this joins need
no more comparisons. What then still meets in a bucket from different
components is compared by signature, in blocks; what near signatures connect
is a family, whose members are compared on full sets, in blocks as well.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm import arrays
from tallyfield.llm.graph import components
from tallyfield.llm.keyed import map_keyed
from tallyfield.session import materialise

#: 80 functions give 160 values in 32 bands of 5: of pairs at similarity 0.8, 3 in a million share no band.
PERMS, BAND = 80, 5
#: Signatures of 160 values differ from the similarity by 0.03 in the mean; below this a pair of 0.8 is out of question (nearly five times that).
LEAST_ESTIMATE = 0.65
#: Members compared with a head in one group, and members in a block of a bucket.
GROUP, BLOCK = 128, 256
#: Places of the filter in front of the shuffle of texts: 1 MB.
FILTER_BITS = 1 << 23

_RNG = np.random.default_rng(9)
_FACTORS = _RNG.integers(0, 2**63, PERMS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 2**63, PERMS, dtype=np.int64).astype(np.uint64)
_PLACES = _RNG.integers(0, 2**63, 16, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BANDS = _RNG.integers(0, 2**63, 2 * PERMS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def lowered(text: str) -> bytes:
    """UTF-8 with A-Z in lower case and nothing else changed."""
    return text.encode().lower()


def shingle_sets(texts: list[str], width: int = 4) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's ``width``-word shingles; a text of fewer words is one shingle, an empty one none."""
    raw = [lowered(t) for t in texts]
    data, starts, ends, first = arrays.words(raw)
    h = arrays.run_hashes(data, starts, ends)
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    whole = np.zeros(len(h), np.uint64)
    for i in range(width):
        whole += padded[i : i + len(h)] * _PLACES[i]
    whole = arrays.mix(whole)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            out.append(arrays.mix((h[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Min and max of each function over each set (none may be empty): a row of 2 * PERMS values."""
    values = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), 2 * PERMS), np.uint64)
    for j in range(PERMS):
        h = values * _FACTORS[j] + _SHIFTS[j]
        out[:, j] = np.minimum.reduceat(h, at)
        out[:, PERMS + j] = np.maximum.reduceat(h, at)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each band of each signature; keys of different bands differ."""
    parts = (arrays.mix(sig) * _BANDS).reshape(len(sig), -1, BAND).sum(2, dtype=np.uint64)
    return arrays.mix(parts + np.arange(parts.shape[1], dtype=np.uint64)).astype(np.int64)


SKETCH_SCHEMA = "n_shingles long, digest binary, bands array<long>, sketch binary"


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """A row for each document: set size, digest of the set, band keys, and a byte of each signature value."""

    def run(batches):
        for pdf in batches:
            texts, ids = pdf["text"].tolist(), pdf["doc_id"]
            for part in arrays.pieces_of(texts, len, 1_000_000):
                sets = shingle_sets(texts[part], width)
                full = [i for i, s in enumerate(sets) if len(s)]
                rows = pd.DataFrame({"doc_id": ids[part].to_numpy(), "n_shingles": [len(s) for s in sets], "digest": None, "bands": None, "sketch": None}).astype({"digest": object, "bands": object, "sketch": object})
                if full:
                    sig = signatures([sets[i] for i in full])
                    keys, small = band_keys(sig), (arrays.mix(sig) >> np.uint64(56)).astype(np.uint8)
                    for c, values in (("digest", [hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest() for i in full]), ("bands", list(keys)), ("sketch", [s.tobytes() for s in small])):
                        column = [None] * len(sets)
                        for i, v in zip(full, values):
                            column[i] = v
                        rows[c] = pd.Series(column, dtype=object)
                yield rows

    return map_keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), ("doc_id",), run, SKETCH_SCHEMA)


def texts_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``wanted`` (id and more) with the text of each id.

    A bitmap of ``FILTER_BITS`` hash places, broadcast in rows of 4 KB and of
    the same size for any input, keeps most other texts out of the shuffle.
    Where it fills up it lets more through, which the join then drops.
    """
    def place(c: str):
        return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))

    bits = wanted.select(place("id").alias("p")).groupBy(F.expr("p div 32768").alias("_row")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("_bits"))
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_p", place("id")).withColumn("_row", F.expr("_p div 32768"))
    marked = F.expr("shiftright(cast(conv(hex(substring(_bits, cast(_p % 32768 div 8 as int) + 1, 1)), 16, 10) as int), cast(_p % 8 as int)) & 1 = 1")
    return wanted.join(texts.join(F.broadcast(bits), "_row").filter(marked).select("id", "text"), "id")


def confirm(pairs: DataFrame, docs: DataFrame, width: int, similarity: int) -> DataFrame:
    """Those pairs (a, b) whose full sets reach ``similarity`` per cent.

    Partners of an a are dealt into groups of about ``GROUP``, each with a's
    text, so an a with very many partners spreads over tasks. Texts stream:
    a group's first row is its a.
    """
    sizes = pairs.groupBy("a").agg((F.floor((F.count("*") - 1) / GROUP) + 1).cast("int").alias("groups"))
    dealt = pairs.join(sizes, "a").withColumn("grp", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int"))
    heads = sizes.withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select(F.col("a").alias("id"), "a", "grp", F.lit(0).alias("member"))
    wanted = heads.union(dealt.select(F.col("b").alias("id"), "a", "grp", F.lit(1).alias("member")))
    rows = texts_of(wanted, docs).repartition("a", "grp").sortWithinPartitions("a", "grp", "member", "id")

    def run(batches):
        now, head = None, None
        for pdf in batches:
            found, texts = [], pdf["text"].tolist()
            for part in arrays.pieces_of(texts, len, 1_000_000):
                for a, grp, member, i, s in zip(pdf["a"][part], pdf["grp"][part], pdf["member"][part], pdf["id"][part], shingle_sets(texts[part], width)):
                    if not member:
                        now, head = (a, grp), s
                    elif now == (a, grp):
                        common = len(head) + len(s) - len(np.unique(np.concatenate([head, s])))
                        if 100 * common >= similarity * (len(head) + len(s) - common):
                            found.append((a, i))
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return rows.mapInPandas(run, "a long, b long").distinct()


def confirm_families(edges: DataFrame, docs: DataFrame, width: int, similarity: int) -> DataFrame:
    """Links among documents that ``edges`` (a, b) connect, a forest of them a group.

    Documents that edges connect are a family, cut into blocks of about
    ``GROUP``. Each pair of a family's blocks is a group, which gets each of
    its documents once and compares all of them, so dense families make no row
    a pair, neither coming nor going.
    """
    families = components(edges, "near-families")
    sizes = families.groupBy("component").agg((F.floor((F.count("*") - 1) / GROUP) + 1).cast("int").alias("blocks"))
    placed = families.join(sizes, "component").select(F.col("node").alias("id"), F.col("component").alias("family"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"))
    wanted = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("id", "family", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    rows = texts_of(wanted, docs).repartition("family", "x", "y").sortWithinPartitions("family", "x", "y", "id")

    def solve(ids: list[int], texts: list[str]) -> list[tuple[int, int]]:
        sets = []
        for part in arrays.pieces_of(texts, len, 1_000_000):
            sets += shingle_sets(texts[part], width)
        label = np.arange(len(ids))
        for i, j in similar_sets(sets, similarity):
            _unite(label, np.array([i, j]))
        return _forest(label, ids)

    def run(batches):
        now, ids, texts = None, [], []
        for pdf in batches:
            found = []
            for *key, i, text in zip(pdf["family"], pdf["x"], pdf["y"], pdf["id"], pdf["text"]):
                if key != now:
                    found += solve(ids, texts)
                    now, ids, texts = key, [], []
                ids.append(i)
                texts.append(text)
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)
        yield pd.DataFrame(solve(ids, texts), columns=["a", "b"], dtype=np.int64)

    return rows.mapInPandas(run, "a long, b long").distinct()


def _unite(label: np.ndarray, members: np.ndarray) -> None:
    """Gives all that share a label with ``members`` the smallest of their labels."""
    own = np.unique(label[members])
    if len(own) > 1:
        label[np.isin(label, own)] = own[0]


def _forest(label: np.ndarray, ids) -> list[tuple[int, int]]:
    """A pair (a, b) for each place whose label is another place."""
    return [(min(ids[i], ids[k]), max(ids[i], ids[k])) for i, k in enumerate(label.tolist()) if i != k and ids[i] != ids[k]]


def similar_sets(sets: list[np.ndarray], similarity: int, columns: int = 20_000) -> list[tuple[int, int]]:
    """Index pairs of sets with a Jaccard similarity of ``similarity`` per cent or more, by products of incidence matrices."""
    if len(sets) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times[column] > 1  # what one set has alone is in no intersection
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [first, first + columns])
        m = np.zeros((len(sets), columns), np.float32)
        m[row[a:b], column[a:b] - first] = 1
        common += m @ m.T
    union = sizes[:, None] + sizes[None, :] - common
    i, j = np.nonzero(np.triu((100 * common >= similarity * union) & (sizes[:, None] > 0) & (sizes[None, :] > 0), 1))
    return list(zip(i.tolist(), j.tolist()))


def _met(members: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what shares a bucket, is of different components, is near enough by sketch and isn't compared yet: a forest a group.

    ``members``: key, doc_id, component, n_shingles, sketch, heads (those it
    was compared with), and n, the rows of the key. A bucket is cut into blocks
    and each pair of blocks is a group of its own, so that a group has at most
    two blocks.
    """
    blocks = (F.floor((F.col("n") - 1) / BLOCK) + 1).cast("int")
    d = members.withColumn("own", F.pmod(F.xxhash64("doc_id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    d = d.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "doc_id", "component", "n_shingles", "sketch", "heads")
    d = d.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "doc_id")

    def near(g: pd.DataFrame) -> list[tuple[int, int]]:
        sk = np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(len(g), -1)
        ids, comp, n, own = (g[c].to_numpy() for c in ("doc_id", "component", "n_shingles", "own"))
        heads = np.zeros((len(g), 2 * PERMS // BAND), np.int64)
        for i, h in enumerate(g["heads"]):
            heads[i] = np.resize(h, heads.shape[1])  # repeats fill the row
        label, diagonal = np.arange(len(g)), g["x"].iat[0] == g["y"].iat[0]
        for i in range(len(g) - 1):
            j = np.arange(i + 1, len(g))
            # Sets whose sizes differ by more than a fifth can't reach a similarity of 0.8.
            fits = (comp[j] != comp[i]) & (label[j] != label[i]) & (100 * np.minimum(n[j], n[i]) >= 80 * np.maximum(n[j], n[i]))
            if not diagonal:
                fits &= own[j] != own[i]
            j = j[fits]
            if len(j):
                j = j[~np.isin(ids[j], heads[i]) & ~(heads[j] == ids[i]).any(1)]
                agree = (sk[j] == sk[i]).mean(1)
                j = j[(agree - 1 / 256) / (1 - 1 / 256) >= LEAST_ESTIMATE]
                _unite(label, np.append(j, i))
        return _forest(label, ids)

    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            keys = pdf[["key", "x", "y"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            found, start = [], 0
            for end in cuts:
                found += near(pdf.iloc[start:end])
                start = end
            held = pdf.iloc[start:]
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)
        if held is not None and len(held):
            yield pd.DataFrame(near(held), columns=["a", "b"], dtype=np.int64)

    return d.mapInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, similarity: int = 80) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (the smallest doc_id that links reach) and kept.

    Documents link if the distinct ``width``-word shingles of their whole
    texts have a Jaccard similarity of ``similarity`` per cent or more (80 or
    more: the bands are made for that). Null, empty and blank texts link with
    nothing and are kept. Rows that repeat a doc_id are one document in the
    links, which links whatever any of its texts does, and a row each in the
    result. A null doc_id never is a component. An empty table gives an empty
    one.
    """
    if similarity < 80:
        raise ValueError("bands and bounds are made for similarities of 80 per cent and more")
    docs = docs.select("doc_id", "text")
    rows = materialise(sketches(docs, width), "near-sketches")
    set_of = F.coalesce("digest", F.lit(b""))
    sets = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(set_of).alias("lo"), F.max(set_of).alias("hi"))
    several = materialise(sets.filter("lo <> hi").select("doc_id"), "near-several")
    if not several.isEmpty():
        return _of_several_texts(docs, rows, several, width, similarity)
    full = rows.filter("n_shingles > 0")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = full.join(classes.filter("rep IS NOT NULL"), "digest").filter("doc_id = rep").dropDuplicates(["doc_id"]).select("doc_id", "n_shingles", "bands", "sketch")
    reps = materialise(reps, "near-classes")
    keyed = reps.select("doc_id", F.explode("bands").alias("key"))
    heads = keyed.groupBy("key").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    shared = materialise(keyed.join(heads, "key"), "near-buckets")  # buckets of one class are gone
    stars = materialise(shared.filter("doc_id > a").select("a", F.col("doc_id").alias("b")).distinct(), "near-stars")
    first = materialise(confirm(stars, docs, width, similarity), "near-links")
    labels = components(first)

    placed = shared.join(labels, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("key", "n")
    met = shared.groupBy("doc_id").agg(F.collect_set("a").alias("heads"))  # one a band at most
    members = placed.join(mixed, "key").join(reps.select("doc_id", "n_shingles", "sketch"), "doc_id").join(met, "doc_id")
    later = materialise(_met(members), "near-later")
    second = confirm_families(later, docs, width, similarity)
    labels = materialise(_joined(labels, second), "near-labels")

    groups = classes.join(labels, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "n_shingles", "digest").join(groups, "digest", "left")
    out = out.select("doc_id", F.col("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _of_several_texts(docs: DataFrame, rows: DataFrame, several: DataFrame, width: int, similarity: int) -> DataFrame:
    """``near_duplicates`` where the ids ``several`` have texts of different sets: each such text is a document of its own, above all other ids, and its id links them."""
    top = rows.agg(F.max("doc_id")).first()[0]
    twins = docs.join(several, "doc_id", "left_semi").filter("text IS NOT NULL").distinct()
    twins = materialise(twins.withColumn("own", F.lit(top + 1) + F.monotonically_increasing_id()), "near-twins")
    apart = docs.join(several, "doc_id", "left_anti").unionByName(twins.select(F.col("own").alias("doc_id"), "text"))
    found = materialise(near_duplicates(apart, width, similarity).filter("doc_id IS NOT NULL").select("doc_id", "component_id").distinct(), "near-apart")
    links = twins.join(found.select(F.col("doc_id").alias("own"), "component_id"), "own").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    labels = components(links, "near-several")
    known = found.filter(F.col("doc_id") <= top).unionByName(several.select("doc_id", F.col("doc_id").alias("component_id")))
    known = known.join(labels, F.col("component_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "component_id").alias("component_id"))
    known = materialise(known.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "near-known")
    named = rows.filter("doc_id IS NOT NULL").join(known, "doc_id").select("doc_id", "n_shingles", "digest", "component_id")
    equal = named.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("component_id").alias("component_id"))
    nameless = rows.filter("doc_id IS NULL").select("doc_id", "n_shingles", "digest").join(equal, "digest", "left")
    out = named.unionByName(nameless).drop("digest")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links between components."""

    def label(side: str) -> DataFrame:
        return labels.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))

    between = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    more = components(between, "near-joins").select(F.col("component").alias("whole"), F.col("node").alias("component"))
    old = labels.join(more, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    new = more.join(labels.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("whole").alias("component"))
    return old.union(new)


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, that of the smallest doc_id; rows without a doc_id stay."""
    kept = near_duplicates(docs, width, similarity).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    stay = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return stay.unionByName(docs.filter("doc_id IS NULL"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)
