"""Exact top-k inner products by pivot-table elimination.

With an extra component sqrt(M - |x|^2) for candidates and 0 for queries, M
the largest squared length, a larger inner product is a smaller distance:
d(q, x)^2 = |q|^2 + M - 2 <q, x>. Distances to pivots are computed once. They
fix a point's place in the pivots' span and its distance from it, and the
distance of two such places bounds d(q, x) from below, so <q, x> from above:
the best bound that distances to all the pivots allow, no less than the
largest |d(q, p) - d(x, p)|. Queries lie in cells by nearest pivot; a candidate
that no query of a cell can rank among its best, by the cell's range of
distances, doesn't travel there. What does is evaluated in bound order until
no bound reaches the k-th score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfield.functions.prefix import spread_key
from tallyfield.session import drop_written, materialise

#: Pivots, chosen far apart among SAMPLE rows; rows of a block of candidates and of queries.
PIVOTS, SAMPLE, BLOCK, QUERIES = 64, 4096, 8192, 4096


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """vec_id and v, floor(scale * component) as longs; vectors that are null, or hold null or non-finite components, are out."""
    c = F.col(vector_col)
    fine = c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(c, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))


def _matrix(lists, dim: int) -> np.ndarray:
    """Rows as whole numbers; shorter vectors end in zeros."""
    out = np.zeros((len(lists), dim), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles as long as every partial sum stays below 2^53."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows far from each other, the first as given."""
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


class Table:
    """Pivots, the largest squared length and a sample: all that a task needs besides its block. Of fixed size."""

    def __init__(self, sample_ids: np.ndarray, sample: np.ndarray, longest: int, dim: int, n_pivots: int):
        self.sample_ids, self.sample, self.longest, self.dim = sample_ids, sample, float(longest), dim
        self.pivots = _pivots(sample, n_pivots)
        self.lift = np.sqrt(self.longest - np.minimum((self.pivots.astype(float) ** 2).sum(1), self.longest))
        whole = np.column_stack([self.pivots.astype(float), self.lift])
        away = whole[1:] - whole[:1]
        # Directions from the first pivot to others, as long as they aren't nearly within the span of those before.
        chosen, unit = [], np.empty((0, whole.shape[1]))
        for i, x in enumerate(away):
            rest = x - unit.T @ (unit @ x)
            rest -= unit.T @ (unit @ rest)
            if np.linalg.norm(rest) > 1e-3 * np.linalg.norm(x):
                chosen.append(i)
                unit = np.vstack([unit, rest / np.linalg.norm(rest)])
        self.span = np.array(chosen, int) + 1
        self.span_squares = (away[chosen] ** 2).sum(1)
        self.basis = np.linalg.inv(away[chosen] @ unit.T).T  # from inner products with the directions to places along the units
        self.places = self.coordinates(self.distances(sample, False))

    def distances(self, v: np.ndarray, query: bool) -> np.ndarray:
        """Distances of rows to the pivots in the lifted space."""
        square = (v.astype(float) ** 2).sum(1)
        lift = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.longest - square, 0))
        flat = square[:, None] + (self.pivots.astype(float) ** 2).sum(1) - 2.0 * _products(v, self.pivots)
        return np.sqrt(np.maximum(flat + (lift[:, None] - self.lift) ** 2, 0))

    def coordinates(self, d: np.ndarray) -> np.ndarray:
        """From distances to the pivots: places in the pivots' span, and the distance from it last.

        Two points are no nearer to each other than these rows, so that one
        product bounds a block of pairs by all pivots at once; the largest
        |d(q, p) - d(x, p)| is never a better bound.
        """
        square = d**2
        inner = (square[:, :1] + self.span_squares - square[:, self.span]) / 2
        places = inner @ self.basis
        return np.column_stack([places, np.sqrt(np.maximum(square[:, 0] - (places**2).sum(1), 0))])

    def bounds(self, q: np.ndarray, cq: np.ndarray, cc: np.ndarray) -> np.ndarray:
        """No less than the score of any query with any candidate, by the coordinates of both."""
        far = np.maximum((cq**2).sum(1)[:, None] + (cc**2).sum(1) - 2 * cq @ cc.T, 0)
        top = ((q.astype(float) ** 2).sum(1) + self.longest)[:, None]
        return (top - far) / 2 + 1e-6 * (1 + top + self.longest)  # many times the rounding

    def floors(self, ids: np.ndarray, q: np.ndarray, cq: np.ndarray, k: int) -> np.ndarray:
        """A score that k candidates reach for each query: its k-th best in the sample, itself left out, found in bound order."""
        out = np.full(len(q), -np.inf)
        for at in range(0, len(q), 512):
            own = ids[at : at + 512]
            best, _ = best_in_block(self, k, own, q[at : at + 512], cq[at : at + 512], out[at : at + 512], self.sample_ids, self.sample, self.places)
            reached = {i: np.partition(x.to_numpy(), -k)[-k] for i, x in best.groupby("query_id")["score"] if len(x) >= k}
            out[at : at + 512] = [reached.get(i, -np.inf) for i in own]
        return out


class Cells:
    """What is known of the queries of each cell: the least and greatest distance to each pivot, the largest square, the lowest floor.

    ``rows`` has a row a pivot; neighbouring ones of fewer than ``size``
    queries together are one cell, named by the first, so that small query
    sets don't make candidates travel many times.
    """

    def __init__(self, t: Table, rows: list, size: int):
        rows = sorted(rows, key=lambda r: r["cell"])
        self.of: dict[int, int] = {}
        joined: list[list] = []
        for r in rows:
            if not joined or sum(x["n"] for x in joined[-1]) >= size:
                joined.append([])
            joined[-1].append(r)
            self.of[r["cell"]] = joined[-1][0]["cell"]
        merged = lambda name, f: np.array([f(x[name] for x in g) for g in joined], float)
        self.cells = np.array([g[0]["cell"] for g in joined], np.int32)
        self.sizes = {g[0]["cell"]: sum(x["n"] for x in g) for g in joined}
        self.least = np.stack([merged(f"least{p}", min) for p in range(len(t.pivots))], 1)
        self.most = np.stack([merged(f"most{p}", max) for p in range(len(t.pivots))], 1)
        self.top, self.floor = merged("square", max) + t.longest, merged("floor", min)

    def wanting(self, d: np.ndarray) -> list[list[int]]:
        """For each candidate the cells of which a query may rank it, by its distances to the pivots."""
        may = np.empty((len(d), len(self.cells)), bool)
        for i in range(len(self.cells)):
            low = np.maximum(self.least[i] - d, d - self.most[i]).max(1, initial=0)
            low = np.maximum(low - 1e-6 * (1 + float(d.max(initial=0)) + float(self.most[i].max(initial=0))), 0)
            may[:, i] = (self.top[i] - low**2) / 2 + 1e-6 * (1 + self.top[i]) >= self.floor[i]
        return [self.cells[m].tolist() for m in may]


class Boxes:
    """Where the candidates lie that a cell of queries wants: for each cell of theirs, the least and greatest coordinates.

    ``rows`` has one for each pair of cells, pivots squared at most.
    """

    def __init__(self, rows: list, width: int):
        self.parts: dict[int, list] = {}
        for r in rows:
            box = np.array([[r[f"least{i}"], r[f"most{i}"]] for i in range(width)], float)
            self.parts.setdefault(r["ask"], []).append((r["cell"], r["n"], box[:, 0], box[:, 1]))

    def wanted(self, t: Table, ask: int, square: np.ndarray, cq: np.ndarray, floor: np.ndarray) -> list[list[int]]:
        """For each query of a cell the cells of candidates that its own floor doesn't rule out."""
        own = self.parts.get(ask, [])
        may = np.empty((len(cq), len(own)), bool)
        top = square + t.longest
        for i, (_, _, least, most) in enumerate(own):
            far = (np.maximum(np.maximum(least - cq, cq - most), 0) ** 2).sum(1)
            may[:, i] = (top - far) / 2 + 1e-6 * (1 + top + t.longest) >= floor
        cells = np.array([x[0] for x in own], int)
        return [cells[m].tolist() for m in may]


def _scores(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact products of the pairs (i, j); of all pairs at once where those are many."""
    if 8 * len(i) > len(q) * len(c):
        return _products(q, c)[i, j]
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), 50_000):
        part = slice(at, at + 50_000)
        out[part] = (q[i[part]] * c[j[part]]).sum(1)
    return out


def best_in_block(t: Table, k: int, qid: np.ndarray, q: np.ndarray, cq: np.ndarray, floor: np.ndarray, cid: np.ndarray, c: np.ndarray, cc: np.ndarray) -> tuple[pd.DataFrame, int]:
    """query_id, vec_id, score of all that can be among a query's k best; and how many pairs were evaluated.

    Each query's candidates go by their bounds, ``cq`` and ``cc`` being the
    coordinates of both. The best 2k are evaluated first; then, of the rest,
    those whose bounds reach the k-th score so far or ``floor``: beyond these
    no bound does.
    """
    bound = t.bounds(q, cq, cc)
    bound[qid[:, None] == cid[None, :]] = -np.inf
    head = min(2 * k, len(c))
    first = np.argpartition(-bound, head - 1, axis=1)[:, :head]
    i, j = np.repeat(np.arange(len(q)), head), first.ravel()
    s = np.where(np.isfinite(bound[i, j]), _scores(q, c, i, j), -np.inf)
    need = floor.copy()
    if head >= k:
        need = np.maximum(need, np.partition(s.reshape(len(q), head), head - k, axis=1)[:, head - k])
    bound[i, j] = -np.inf
    more = np.nonzero((bound >= need[:, None]) & np.isfinite(bound))
    i, j, s = np.append(i, more[0]), np.append(j, more[1]), np.append(s, _scores(q, c, *more))
    keep = np.isfinite(s) & (s >= need[i])
    return pd.DataFrame({"query_id": qid[i[keep]], "vec_id": cid[j[keep]], "score": np.rint(s[keep]).astype(np.int64)}), len(i)


def _packed(rows: np.ndarray, dtype) -> list[bytes]:
    return [x.tobytes() for x in np.ascontiguousarray(rows, dtype)]


def _unpacked(cells: pd.Series, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), dtype).reshape(len(cells), width)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, n_pivots: int = PIVOTS, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """For each query its k candidates of the highest inner product, ties to the smaller id: query_id, rank, vec_id, score.

    Both tables hold vec_id and v (``usable``). A query's own id is no
    candidate for it; fewer candidates than k give as many rows. Vectors of
    unequal length count as ending in zeros, an empty one scores 0 with all.
    Each row of an id that repeats is a candidate of its own, and rows of a
    repeated query id are one query: its smallest vector. Candidates and
    queries lie in cells by nearest pivot. What a cell of queries wants of a
    cell of candidates is dealt into blocks of about ``block`` rows, the
    queries into blocks of about ``query_block``, so equal vectors spread too;
    a query travels only to cells whose coordinates its own floor doesn't rule
    out.
    """
    spark = vectors.sparkSession
    vectors, queries = materialise(vectors, "topk-vectors"), queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    facts = vectors.agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)), F.max(F.size("v"))).first()
    if facts[1] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(1, int(facts[1]))
    rows = vectors.orderBy(spread_key("vec_id", seed="pivot"), "vec_id").limit(SAMPLE).collect()  # of fixed size
    t = Table(np.array([r["vec_id"] for r in rows]), _matrix([r["v"] for r in rows], dim), int(facts[0]), dim, n_pivots)

    def prepare(batches):
        for pdf in batches:
            q = _matrix(pdf["v"].tolist(), dim)
            d = t.distances(q, True)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": _packed(q, np.int64), "d": list(d), "floor": t.floors(pdf["vec_id"].to_numpy(), q, t.coordinates(d), k), "square": (q.astype(float) ** 2).sum(1), "cell": d.argmin(1).astype(np.int32)})

    asked = materialise(queries.mapInPandas(prepare, "vec_id long, v binary, d array<double>, floor double, square double, cell int"), "topk-queries")
    sides = [f(F.get("d", F.lit(p))).alias(f"{name}{p}") for name, f in (("least", F.min), ("most", F.max)) for p in range(len(t.pivots))]
    known = asked.groupBy("cell").agg(F.count("*").alias("n"), F.min("floor").alias("floor"), F.max("square").alias("square"), *sides).collect()  # a row a pivot
    if not known:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cells = Cells(t, known, query_block)

    def measure(batches):
        for pdf in batches:
            v = _matrix(pdf["v"].tolist(), dim)
            d = t.distances(v, False)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": _packed(v, np.int64), "d": _packed(t.coordinates(d), np.float64), "cell": d.argmin(1).astype(np.int32), "wanting": cells.wanting(d)})

    table = materialise(vectors.mapInPandas(measure, "vec_id long, v binary, d binary, cell int, wanting array<int>"), "topk-table")
    drop_written(vectors)
    width = len(t.span) + 1
    travels = table.withColumn("ask", F.explode("wanting"))

    def boxes(batches):
        """Least and greatest coordinates of this task's candidates, a row for each pair of cells that meet."""
        held: dict[tuple[int, int], list] = {}
        for pdf in batches:
            for pair, x in pdf.groupby(["ask", "cell"]):
                d = _unpacked(x["d"], np.float64, width)
                n, least, most = held.get(pair, (0, d[0], d[0]))
                held[pair] = (n + len(d), np.minimum(least, d.min(0)), np.maximum(most, d.max(0)))
        yield pd.DataFrame([(*p, n, a.tolist(), b.tolist()) for p, (n, a, b) in held.items()], columns=["ask", "cell", "n", "least", "most"])

    ends = [f(F.get(name, F.lit(i))).alias(f"{name}{i}") for i in range(width) for name, f in (("least", F.min), ("most", F.max))]
    met = travels.select("ask", "cell", "d").mapInPandas(boxes, "ask int, cell int, n long, least array<double>, most array<double>").groupBy("ask", "cell").agg(F.sum("n").alias("n"), *ends).collect()
    seen = Boxes(met, width)
    parts = {(r["ask"], r["cell"]): -(-r["n"] // block) for r in met}  # blocks of what one cell of queries wants of one of candidates
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    place = lambda cell, number: F.shiftleft(cell.cast("long"), 32) + number
    of_query = F.create_map(*[F.lit(x) for c, n in cells.sizes.items() for x in (c, -(-n // query_block))])
    n = len(t.pivots)
    of_pair = F.array(*[F.lit(parts.get(divmod(i, n), 1)) for i in range(n * n)])
    blocked = travels.withColumn("part", place(F.col("cell"), spread_key("vec_id", seed="block") % F.get(of_pair, F.col("ask") * n + F.col("cell"))))
    blocked = blocked.withColumn("of", F.explode(F.transform(F.sequence(F.lit(0), of_query[F.col("ask")] - 1), lambda i: place(F.col("ask"), i)))).select("of", "part", "vec_id", "v", "d")

    def aim(batches):
        for pdf in batches:
            asks = [cells.of[c] for c in pdf["cell"]]
            cq = t.coordinates(np.array(pdf["d"].tolist()).reshape(len(pdf), -1))
            targets: list = [[]] * len(pdf)
            for ask in set(asks):
                own = np.array([i for i, a in enumerate(asks) if a == ask])
                for i, to in zip(own, seen.wanted(t, ask, pdf["square"].to_numpy()[own], cq[own], pdf["floor"].to_numpy()[own])):
                    targets[i] = [(c << 32) + n for c in to for n in range(parts[ask, c])]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": pdf["v"], "d": _packed(cq, np.float64), "floor": pdf["floor"], "ask": np.array(asks, np.int32), "parts": targets})

    asked = asked.mapInPandas(aim, "vec_id long, v binary, d binary, floor double, ask int, parts array<long>")
    asked = asked.withColumn("of", place(F.col("ask"), spread_key("vec_id", seed="ask") % of_query[F.col("ask")])).select("of", F.explode("parts").alias("part"), "vec_id", "v", "d", "floor")

    def meet(key, q, c):
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)]
        if len(q) and len(c):
            cid, cv, theirs = c["vec_id"].to_numpy(), _unpacked(c["v"], np.int64, dim), _unpacked(c["d"], np.float64, width)
            for at in range(0, len(q), 512):
                own = q.iloc[at : at + 512]
                out.append(best_in_block(t, k, own["vec_id"].to_numpy(), _unpacked(own["v"], np.int64, dim), _unpacked(own["d"], np.float64, width), own["floor"].to_numpy(), cid, cv, theirs)[0])
        return pd.concat(out)

    found = asked.groupBy("of", "part").cogroup(blocked.groupBy("of", "part")).applyInPandas(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"))


OP2_SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
