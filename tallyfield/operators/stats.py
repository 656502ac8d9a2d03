"""Calibration, drift and tests of an edge, in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions import scan
from tallyfield.functions.nulls import safe_divide


def _clip(p: Column, eps: float) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def scores(df: DataFrame, group: list[str], p: str, y: str, cut: float = 0.5, count: str | None = None) -> DataFrame:
    """Brier score, log loss, accuracy, precision and recall of each group. A row stands for ``count`` equal ones, or one."""
    prob, true = F.col(p), F.col(y).cast("double")
    times = lambda x: x if count is None else x * F.col(count)
    n = F.count("*") if count is None else F.sum(count)
    mean = F.avg if count is None else lambda x: F.sum(times(x)) / n
    guess = prob >= cut
    c = _clip(prob, 1e-15)
    hit = F.sum(times((guess & (true == 1)).cast("long")))
    return df.filter(prob.isNotNull() & true.isNotNull()).groupBy(*group).agg(
        n.alias("n"),
        F.round(mean(F.pow(prob - true, F.lit(2))), 6).alias("brier"),
        F.round(-mean(true * F.ln(c) + (1 - true) * F.ln(1 - c)), 6).alias("log_loss"),
        F.round(mean((guess == (true == 1)).cast("double")), 6).alias("accuracy"),
        F.round(F.coalesce(safe_divide(hit, F.sum(times(guess.cast("long")))), F.lit(0.0)), 6).alias("precision"),
        F.round(F.coalesce(safe_divide(hit, F.sum(times(true))), F.lit(0.0)), 6).alias("recall"),
    )


def brier_grade(b: Column) -> Column:
    return F.when(b < 0.15, "EXCELLENT").when(b < 0.20, "GOOD").when(b < 0.25, "ACCEPTABLE").when(b < 0.30, "POOR").otherwise("BAD")


def auc(df: DataFrame, group: list[str], p: str, y: str, count: str | None = None) -> DataFrame:
    """Area under the ROC curve by rank sums with mean ranks for ties; null without both classes. A row stands for ``count`` equal ones, or one.

    Rows are reduced to counts by probability, and these are summed along
    blocks (``scan``), so a group may have any number of probabilities.
    """
    n = F.lit(1) if count is None else F.col(count)
    d = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*group, p).agg(F.sum((F.col(y) == 1).cast("long") * n).alias("_pos"), F.sum((F.col(y) == 0).cast("long") * n).alias("_neg"))
    d = scan.running_sum(scan.numbered(d, group, [p]), group, F.col("_neg").cast("double"), "_upto")
    d = d.withColumn("_won", F.col("_pos") * (F.col("_upto") - F.col("_neg") / 2))
    return d.groupBy(*group).agg(F.round(safe_divide(F.sum("_won"), F.sum("_pos") * F.sum("_neg")), 6).alias("auc"))


def bin_of(p: Column, bins: int) -> Column:
    """Equal bins of [0, 1], the last one closed."""
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """For every bin, empty ones too: count, mean probability, observed rate and their gap."""
    d = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(bin_of(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("_p"), F.avg(F.col(y).cast("double")).alias("_y"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(d, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round("_p", 6).alias("mean_p"), F.round("_y", 6).alias("rate"), F.round(F.abs(F.col("_p") - F.col("_y")), 6).alias("gap"))


def calibration_error(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """One row: expected and maximum calibration error."""
    d = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(bin_of(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg(p) - F.avg(F.col(y).cast("double"))).alias("gap"))
    return d.agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"), F.round(F.max("gap"), 6).alias("mce"))


def calibrator(df: DataFrame, p: str, y: str, bins: int = 10, least: int = 3) -> DataFrame:
    """For each bin the calibrated probability: the observed rate from ``least`` rows on, else the middle drawn to a half; within .02 and .98."""
    r = reliability(df, p, y, bins)
    middle = (F.col("bin") + 0.5) / bins
    value = F.when(F.col("n") >= least, F.col("rate")).otherwise(0.5 + (middle - 0.5) * 0.85)
    return r.select("bin", F.round(F.least(F.greatest(value, F.lit(0.02)), F.lit(0.98)), 6).alias("calibrated"))


def calibrate(df: DataFrame, table: DataFrame, p: str, bins: int = 10) -> DataFrame:
    """Adds calibrated by the bin of p: a range lookup as an equi-join; without a bin p drawn to a half."""
    d = df.withColumn("bin", bin_of(F.col(p), bins)).join(F.broadcast(table), "bin", "left")  # `bins` rows
    return d.withColumn("calibrated", F.coalesce("calibrated", 0.5 + (F.col(p) - 0.5) * 0.88)).drop("bin")


def edge_test(trades: DataFrame, group: list[str], value: str, least: int = 300) -> DataFrame:
    """One-sample test that the mean of ``value`` exceeds 0: t, normal p-value, 95 % interval, and whether it is significant.

    The p-value is one-sided, by a polynomial of the normal distribution
    (Abramowitz and Stegun 26.2.17).
    """
    d = trades.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    se = F.col("_s") / F.sqrt("n")
    d = d.withColumn("_t", safe_divide(F.col("_m"), se))
    return d.select(
        *group, "n", F.round("_m", 6).alias("mean"), F.round("_t", 6).alias("t"), F.round(normal_tail(F.col("_t")), 6).alias("p_value"),
        F.round(F.col("_m") - 1.96 * se, 6).alias("low"), F.round(F.col("_m") + 1.96 * se, 6).alias("high"),
        F.when(F.col("n") < least, "INSUFFICIENT_SAMPLE").when(F.coalesce(normal_tail(F.col("_t")) < 0.05, F.lit(False)), "SIGNIFICANT").otherwise("NOT_SIGNIFICANT").alias("verdict"),
    )


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution, to seven places."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = 0.3989422804014327 * F.exp(-z * z / 2) * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def ks_statistic(df: DataFrame, value: str, current: Column) -> DataFrame:
    """One row: the largest gap between the distributions of current and other rows; null if either has none.

    Counts by value come first, and these are summed along blocks of values
    (``scan``), of whatever type they are.
    """
    d = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.sum(current.cast("double")).alias("_a"), F.sum((~current).cast("double")).alias("_b"))
    d = scan.numbered(d, [], [value])
    for c in ("_a", "_b"):
        d = scan.running_sum(d, [], F.col(c), f"{c}_upto")
    totals = d.agg(F.max("_a_upto").alias("_na"), F.max("_b_upto").alias("_nb"))
    gap = F.abs(safe_divide("_a_upto", "_na") - safe_divide("_b_upto", "_nb"))
    return d.crossJoin(F.broadcast(totals)).agg(F.round(F.max(gap), 6).alias("ks"))  # one row


def histogram_drift(df: DataFrame, value: str, current: Column, bins: int = 10) -> DataFrame:
    """One row: PSI and Jensen-Shannon divergence of the histograms of current and other rows, over edges that both share."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    d = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(span))  # one row
    place = F.when(F.col("hi") > F.col("lo"), F.greatest(F.ceil((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) - 1, F.lit(0))).otherwise(0).cast("int")
    h = d.groupBy(place.alias("bin")).agg(F.sum(current.cast("double")).alias("a"), F.sum((~current).cast("double")).alias("b"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    w = Window.partitionBy()
    h = every.join(h, "bin", "left").fillna(0.0, ["a", "b"]).withColumn("a", F.col("a") / F.sum("a").over(w)).withColumn("b", F.col("b") / F.sum("b").over(w))
    e, f = 1e-6, 1e-12
    m = (F.col("a") + F.col("b")) / 2
    kl = lambda x: (x + f) * F.ln((x + f) / (m + f))
    return h.agg(F.round(F.sum((F.col("a") - F.col("b")) * F.ln((F.col("a") + e) / (F.col("b") + e))), 6).alias("psi"), F.round((F.sum(kl(F.col("a"))) + F.sum(kl(F.col("b")))) / 2, 6).alias("js"))


def drift_score(psi: Column, js: Column, ks: Column) -> Column:
    return F.round(F.least(F.lit(1.0), 0.45 * psi + 1.2 * js + 0.35 * ks), 6)


def mean_shifts(df: DataFrame, columns: list[str], current: Column, limit: float = 2.0) -> DataFrame:
    """For each column how far its mean moved, in deviations of the other rows; one aggregate for all."""
    parts = []
    for c in columns:
        parts += [F.avg(F.when(current, F.col(c))).alias(f"m_{c}"), F.avg(F.when(~current, F.col(c))).alias(f"b_{c}"), F.stddev_pop(F.when(~current, F.col(c))).alias(f"s_{c}")]
    one = df.agg(*parts)
    rows = [F.struct(F.lit(c).alias("column"), F.round(safe_divide(F.abs(F.col(f"m_{c}") - F.col(f"b_{c}")), f"s_{c}"), 6).alias("z")) for c in columns]
    return one.select(F.inline(F.array(*rows))).withColumn("drifted", F.coalesce(F.col("z") >= limit, F.lit(False)))


def correlated_pairs(df: DataFrame, columns: list[str], limit: float = 0.95) -> DataFrame:
    """Pairs of columns with their correlation, and whether the second one is dropped; one aggregate for all pairs."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"r{i}", 6).alias("r")) for i, (a, b) in enumerate(pairs)]
    return one.select(F.inline(F.array(*rows))).withColumn("dropped", F.coalesce(F.abs("r") > limit, F.lit(False)))


def usable_features(df: DataFrame, columns: list[str], least_share: float = 0.4) -> DataFrame:
    """For each column its non-null and distinct counts, and whether it has enough of both."""
    parts = [F.count("*").alias("n")]
    for c in columns:
        parts += [F.count(c).alias(f"c_{c}"), F.count_distinct(c).alias(f"d_{c}")]
    one = df.agg(*parts)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"c_{c}").alias("filled"), F.col(f"d_{c}").alias("distinct"), ((F.col(f"c_{c}") >= F.greatest(F.lit(4.0), F.col("n") * least_share)) & (F.col(f"d_{c}") >= 2)).alias("usable")) for c in columns]
    return one.select(F.inline(F.array(*rows)))


def health(reliability_: Column, stability: Column, accuracy: Column, calibration: Column, drift: Column) -> Column:
    return F.round(0.45 * (0.5 * reliability_ + 0.3 * stability + 0.2 * accuracy) + 0.25 * calibration + 0.20 * (1 - drift) + 0.10 * stability, 6)


def health_status(x: Column) -> Column:
    return F.when(x >= 0.75, "HEALTHY").when(x >= 0.55, "STABLE").when(x >= 0.35, "DEGRADED").when(x >= 0.2, "POOR").otherwise("CRITICAL")
