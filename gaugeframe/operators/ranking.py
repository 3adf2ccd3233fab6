"""Ranking metrics from one score histogram: ROC area, average precision, partial area.

A histogram row (group, score, positives, negatives) carries everything: with the running totals
of the lower scores, each row knows how many rows of both labels score at least as high, so ties
are grouped and no row-level sort is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.scalar import standardised_partial_area
from gaugeframe.operators.prefix import running_totals, value_boundaries


def score_histogram(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label",
                    weight: Column | None = None) -> DataFrame:
    w = (F.lit(1) if weight is None else weight).cast("bigint")
    return df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(w * F.col(label)).alias("pos"), F.sum(w * (1 - F.col(label))).alias("neg"))


def curve_points(hist: DataFrame, keys: Sequence[str], source: DataFrame | None = None,
                 bounds: list[float] | None = None) -> DataFrame:
    """Histogram rows (keys, score, pos, neg) with tp, fp (score >= threshold), tpr and fpr."""
    curve = running_totals(hist, keys, ["score"], ["pos", "neg"], source=source, bounds=bounds)
    return curve.select(
        *keys, "score", "pos", "neg", F.col("neg_before").alias("negatives_below"),
        (F.col("pos_total") - F.col("pos_before")).alias("tp"), (F.col("neg_total") - F.col("neg_before")).alias("fp"),
        F.col("pos_total").alias("positives"), F.col("neg_total").alias("negatives")
    ).withColumns({"tpr": F.try_divide("tp", "positives"), "fpr": F.try_divide("fp", "negatives")})


def roc_points(df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label",
               weight: Column | None = None, bounds: list[float] | None = None,
               source: DataFrame | None = None) -> DataFrame:
    """One row per threshold of labelled scores."""
    if source is None and bounds is None:
        source = df.select(*keys, F.col(score).alias("score"))
    return curve_points(score_histogram(df, keys, score, label, weight), list(keys), source, bounds)


def _partial_slice(limit: float) -> Column:
    """Area below one ROC segment, cut at the false-positive limit."""
    x1, y1 = F.col("fpr"), F.col("tpr")
    x0 = F.try_divide(F.col("fp") - F.col("neg"), F.col("negatives"))
    y0 = F.try_divide(F.col("tp") - F.col("pos"), F.col("positives"))
    right = F.least(x1, F.lit(limit))
    y_right = y0 + (y1 - y0) * F.coalesce(F.try_divide(right - x0, x1 - x0), F.lit(1.0))
    return F.when(x0 < limit, (right - x0) * (y0 + y_right) / 2).otherwise(F.lit(0.0))


def summarise(points: DataFrame, keys: Sequence[str] = (), max_fpr: float = 0.1) -> DataFrame:
    """auroc, ap and standardised partial auroc per group; NULL where a class is missing."""
    p, n = F.max("positives"), F.max("negatives")
    favourable = F.sum(F.col("pos") * (F.col("negatives_below") + F.col("neg") / 2))
    precision = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    both = (p > 0) & (n > 0)
    return points.groupBy(*keys).agg(
        p.alias("positives"), n.alias("negatives"),
        F.when(both, F.try_divide(favourable, p.cast("double") * n)).alias("auroc"),
        F.try_divide(F.sum(F.col("pos") * precision), p).alias("ap"),
        F.when(both, standardised_partial_area(F.sum(_partial_slice(max_fpr)), max_fpr)).alias("partial_auroc"))


def ranking_metrics(df: DataFrame, keys: Sequence[str] = (), max_fpr: float = 0.1, **options) -> DataFrame:
    return summarise(roc_points(df, keys, **options), keys, max_fpr)


def with_pooled(df: DataFrame, key: str, pooled: str = "pooled") -> DataFrame:
    """Histogram per key and over all keys at once, by grouping sets on the score histogram."""
    hist = score_histogram(df, [key])
    return (hist.groupingSets([[key, "score"], ["score"]], key, "score")
            .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.grouping(key).alias("__all"))
            .select(F.when(F.col("__all") == 1, pooled).otherwise(F.col(key)).alias(key), "score", "pos", "neg"))


def metrics_from_histogram(hist: DataFrame, keys: Sequence[str], source: DataFrame | None = None,
                           max_fpr: float = 0.1) -> DataFrame:
    """The same metrics when the caller already holds (keys, score, pos, neg)."""
    return summarise(curve_points(hist, list(keys), source), keys, max_fpr)


def pixel_average_precision(pixels: DataFrame, keys: Sequence[str] = (), no_positive: str = "null") -> DataFrame:
    """Exact AP over valid pixels at float precision; no positives give NULL or zero."""
    valid = pixels.filter("valid").withColumn("score", F.col("score").cast("float"))
    out = ranking_metrics(valid, keys).select(
        *keys, (F.col("positives") + F.col("negatives")).alias("pixels"), F.col("positives").alias("positive_pixels"),
        F.col("ap").alias("average_precision"))
    if no_positive == "zero":
        return out.withColumn("average_precision", F.coalesce("average_precision", F.lit(0.0)))
    return out


def score_boundaries(df: DataFrame, score: str = "score") -> list[float]:
    return value_boundaries(df, [], score)
