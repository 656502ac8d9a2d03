"""Models by Spark's ML library: median imputation, trees, batch scoring, folds."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.operators import stats
from tallyfield.session import materialise

#: How many models of a kind are fitted at once: boosting is hundreds of short jobs one after the other, a forest fits its own trees together.
TOGETHER = {"forest": 1, "boosted": 4, "tree": 16, "large tree": 4}

#: Different rows to learn from that one task reads.
ROWS = 50_000

#: A forest of no more rows takes its bootstraps from the rows themselves, all trees in one fit.
FEW = 200_000


def _draws(n: Column, key: Column, trees: int) -> Column:
    """For each tree how often a bootstrap takes a row that stands for ``n``: the sum of ``n`` draws of a row, Poisson with mean ``n``. The same key draws the same."""

    @F.pandas_udf("array<double>")
    def drawn(n: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng(k).poisson(c, trees).astype(float) for c, k in zip(n, key)])

    return drawn(n, key)


def train(df: DataFrame, columns: list[str], target: str, kind: str = "forest", trees: int = 40, depth: int = 5, seed: int = 42) -> PipelineModel:
    """A forest or boosted trees on median-imputed columns. Rows without a target are left out.

    Rows that are equal in columns and target are learnt from as one that
    weighs as many, so a fit reads as many rows as differ, and ``df`` is read
    twice. The trees of a forest of more than ``FEW`` rows are stages of their
    own, each over its own bootstrap of all rows.
    """
    filled = [f"_{c}" for c in columns]
    known = df.filter(F.col(target).isNotNull())
    imputer = Imputer(inputCols=columns, outputCols=filled, strategy="median").fit(known)
    counted = imputer.transform(known).groupBy(*filled, target).agg(F.count("*").cast("double").alias("_n"))
    if kind == "forest":
        counted = counted.withColumn("_draws", _draws(F.col("_n"), F.abs(F.xxhash64(F.lit(seed), *filled, target) % 2**62), trees))
    counted = materialise(counted, "learning-counts")
    rows, all_rows, *drawn = counted.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0.0)), *[F.sum(F.col("_draws")[i]) for i in range(trees if kind == "forest" else 0)]).first()
    assembler = VectorAssembler(inputCols=filled, outputCol="_features", handleInvalid="keep")
    if kind == "forest" and all_rows <= FEW:
        forest = RandomForestClassifier(featuresCol="_features", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed)
        return PipelineModel([imputer, assembler, forest.fit(assembler.transform(imputer.transform(known)))])
    vectors = assembler.transform(counted.coalesce(max(1, -(-rows // ROWS)))).persist()

    def boosted():
        return GBTClassifier(featuresCol="_features", labelCol=target, weightCol="_n", maxIter=trees, maxDepth=depth, seed=seed).fit(vectors)

    def tree(i: int):
        weight = F.col("_draws")[i] if drawn[i] else F.col("_n")  # a bootstrap of very few rows may be empty
        own = vectors.select("_features", target, weight.alias("_weight")).filter("_weight > 0")
        made = RandomForestClassifier(
            featuresCol="_features", labelCol=target, weightCol="_weight", probabilityCol=f"_tree_{i}", rawPredictionCol="", predictionCol="",
            numTrees=1, maxDepth=depth, bootstrap=False, featureSubsetStrategy="sqrt" if trees > 1 else "all", seed=seed + i,
        )
        return made.fit(own)

    try:
        made = [boosted()] if kind == "boosted" else fitted(df.sparkSession, "tree" if rows <= ROWS else "large tree", [lambda i=i: tree(i) for i in range(trees)])
    finally:
        vectors.unpersist()
    return PipelineModel([imputer, assembler, *made])


def fitted(spark: SparkSession, kind: str, fits: list[Callable]) -> list:
    """What ``fits`` return, in their order, ``TOGETHER`` of the kind at a time."""
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(TOGETHER[kind]) as pool:
        return list(pool.map(lambda fit: fit(), [inherit(f) for f in fits]))


def _learners(model: PipelineModel) -> list:
    """The stages that predict: boosted trees are one, a forest is as many as it has trees."""
    return [x for x in model.stages if hasattr(x, "featureImportances")]


def score(model: PipelineModel, df: DataFrame, name: str = "probability") -> DataFrame:
    """Adds the probability of class 1, the mean over a forest's trees; one that saw one class gives it 1 or 0.

    Labels that were all 0 leave one entry, that of class 0; labels that were all 1 leave two.
    """
    out = model.transform(df)
    found = [vector_to_array(x.getProbabilityCol()) for x in _learners(model)]
    value = sum((F.when(F.size(p) > 1, p[1]).otherwise(F.lit(0.0)) for p in found), F.lit(0.0)) / len(found)
    out = out.withColumn("_p", value)
    own = set(df.columns)
    return out.select(*[c for c in out.columns if c in own and c != name], F.col("_p").alias(name))


def importances(model: PipelineModel, columns: list[str]) -> list[tuple[str, float]]:
    """Columns by importance, the mean over a forest's trees; they come to 1."""
    weights = sum(x.featureImportances.toArray() for x in _learners(model))
    weights = (weights / (weights.sum() or 1.0)).tolist()
    return sorted(zip(columns, weights), key=lambda x: (-x[1], x[0]))


def time_folds(df: DataFrame, date: str, parts: int = 5) -> tuple[DataFrame, list[int]]:
    """Adds fold and lists the folds in order: calendar years or, where there is one year, ``parts`` stretches of about equally many rows.

    Stretches end with an hour. Rows without a date have no fold and are left
    out.
    """
    hour = F.date_trunc("hour", F.col(date).cast("timestamp"))
    d = df.filter(F.col(date).isNotNull())
    years = [r[0] for r in d.select(F.year(date).alias("y")).distinct().orderBy("y").collect()]  # a row a year
    if len(years) != 1:
        return d.withColumn("fold", F.year(date)), years
    counts = d.groupBy(hour.alias("hour")).count().orderBy("hour").collect()  # a row an hour of one year
    total, seen, begins = sum(r["count"] for r in counts), 0, []
    for r in counts:
        if len(begins) < parts and seen * parts >= len(begins) * total:
            begins.append(r["hour"])
        seen += r["count"]
    fold = sum(((hour >= F.lit(b)).cast("int") for b in begins), F.lit(0))
    return d.withColumn("fold", fold), list(range(1, len(begins) + 1))


def fold_probabilities(df: DataFrame, columns: list[str], target: str, date: str, kind: str = "forest", trees: int = 40) -> DataFrame:
    """Adds fold, probability and past_only: each row scored by a model of the folds before its own.

    There is nothing before the first fold. Its rows are scored by a model of
    the later folds, and past_only is false for them alone. With one fold only
    there is no model, and probabilities are null. ``df`` is read several
    times for each fold: give it a written table.
    """
    d, folds = time_folds(df, date)
    if len(folds) < 2:
        return d.withColumn("probability", F.lit(None).cast("double")).withColumn("past_only", F.lit(False))
    seen = [F.col("fold") < f if i else F.col("fold") > f for i, f in enumerate(folds)]
    models = fitted(df.sparkSession, kind, [lambda s=s: train(d.filter(s), columns, target, kind, trees) for s in seen])
    scored = [score(m, d.filter(F.col("fold") == f)).withColumn("past_only", F.lit(i > 0)) for i, (f, m) in enumerate(zip(folds, models))]
    return reduce(DataFrame.unionByName, scored)


def walk_forward(df: DataFrame, columns: list[str], target: str, date: str, kind: str = "forest", trees: int = 40) -> DataFrame:
    """A row of metrics for each fold in time but the first, trained on the folds before. One model a fold.

    ``df`` is read several times for each fold: give it a written table. Rows
    that are equal in columns and target are scored once, and count as many.
    """
    d, folds = time_folds(df, date)
    models = fitted(df.sparkSession, kind, [lambda f=f: train(d.filter(F.col("fold") < f), columns, target, kind, trees) for f in folds[1:]])
    counted = materialise(d.groupBy("fold", *columns, target).agg(F.count("*").alias("_n")), "fold-counts")
    scored = [score(m, counted.filter(F.col("fold") == f)) for f, m in zip(folds[1:], models)]
    if not scored:  # one fold has no past: no rows
        scored = [counted.filter(F.lit(False)).withColumn("probability", F.lit(None).cast("double"))]
    scored = materialise(reduce(DataFrame.unionByName, scored).select("fold", "probability", target, "_n"), "fold-scores")
    return stats.scores(scored, ["fold"], "probability", target, count="_n").join(stats.auc(scored, ["fold"], "probability", target, "_n"), "fold")


def calibrate(df: DataFrame, p: str, target: str) -> IsotonicRegressionModel:
    """A monotone curve from probabilities to observed rates, from predictions of rows that the model hadn't seen."""
    d = df.filter(F.col(p).isNotNull() & F.col(target).isNotNull()).select(F.col(p).alias("_p"), F.col(target).cast("double").alias("_y"))
    return IsotonicRegression(featuresCol="_p", labelCol="_y", predictionCol="_q").fit(d)


def calibrated(model: IsotonicRegressionModel, df: DataFrame, p: str, out: str) -> DataFrame:
    """Adds the curve's value at ``p``; null stays null."""
    known = model.transform(df.withColumn("_p", F.coalesce(p, F.lit(0.0))))
    value = F.least(F.greatest(F.col("_q"), F.lit(0.0)), F.lit(1.0))
    return known.withColumn(out, F.when(F.col(p).isNotNull(), value)).drop("_p", "_q")


def calibrated_folds(df: DataFrame, columns: list[str], target: str, date: str, kinds: tuple[str, ...] = ("forest", "boosted"), trees: int = 20) -> DataFrame:
    """Rows of all folds from the third on with fold, for each kind its probability and calibrated_<kind>, and ensemble, the mean of the calibrated ones.

    For a fold, models learn from those before the last one, curves from the
    last one, so both have only seen the past and the curve only rows that its
    model hadn't. The rows of all folds are written once and read by each fit.
    """
    d, folds = time_folds(df, date)
    d = materialise(d.filter(F.col(target).isNotNull()), "fold-rows")

    def fit(kind: str, last: int) -> tuple[PipelineModel, IsotonicRegressionModel]:
        model = train(d.filter(F.col("fold") < last), columns, target, kind, trees)
        return model, calibrate(score(model, d.filter(F.col("fold") == last), kind), kind, target)

    found = {kind: fitted(df.sparkSession, kind, [lambda k=kind, f=f: fit(k, f) for f in folds[1:-1]]) for kind in kinds}
    out = None
    for i, now in enumerate(folds[2:]):
        part = d.filter(F.col("fold") == now)
        for kind in kinds:
            model, curve = found[kind][i]
            part = calibrated(curve, score(model, part, kind), kind, f"calibrated_{kind}")
        part = part.withColumn("ensemble", sum((F.col(f"calibrated_{k}") for k in kinds), F.lit(0.0)) / len(kinds))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else d.limit(0)


def fold_metrics(rows: DataFrame, models: list[str], target: str) -> DataFrame:
    """fold, model, AUC and Brier score of columns of probabilities. Rows are scored once."""
    long = rows.select("fold", F.col(target).cast("int").alias("_y"), F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("_p")) for m in models])))
    long = materialise(long, "fold-scores")
    keys = ["fold", "model"]
    return stats.scores(long, keys, "_p", "_y").select(*keys, "n", "brier").join(stats.auc(long, keys, "_p", "_y"), keys, "left")
