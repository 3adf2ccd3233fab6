"""Pixel maps to image scores, and quality measures of saved maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.operators.prefix import running_totals


def top_fraction_mean(pixels: DataFrame, keys: Sequence[str] = ("image",), fraction: float = 0.01) -> DataFrame:
    """Mean of the top max(1, floor(fraction * n)) valid scores per image.

    Works on the histogram of distinct scores, so an image of any size is spread over buckets.
    """
    keys = list(keys)
    valid = pixels.filter("valid").select(*keys, "score")
    hist = valid.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("rows"))
    ranked = running_totals(hist, keys, ["score"], ["rows"], source=valid)
    higher = F.col("rows_total") - F.col("rows_before") - F.col("rows")
    k = F.greatest(F.lit(1), F.floor(F.col("rows_total") * fraction))
    taken = F.greatest(F.lit(0), F.least(F.col("rows"), k - higher))
    return ranked.groupBy(*keys).agg(
        F.max("rows_total").alias("valid_pixels"), F.max(k).alias("top_k"),
        F.try_divide(F.sum(F.col("score") * taken), F.sum(taken)).alias("score"))


def mask_fractions(pixels: DataFrame, keys: Sequence[str] = ("image",)) -> DataFrame:
    return pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pixels"), F.sum("label").alias("positive_pixels"),
        F.avg("label").alias("positive_fraction"), F.max("label").alias("label"))


def stable_bce(logit: Column, target: Column, positive_weight: float) -> Column:
    """Weighted binary cross-entropy on a logit, without overflow."""
    softplus = F.log1p(F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0))
    return (1 - target) * logit + (1 + (positive_weight - 1) * target) * softplus


def pixel_losses(pixels: DataFrame, logit: Column, positive_weight: float = 3.0, image: str = "image") -> DataFrame:
    """Cross-entropy over all valid pixels and soft Dice (+1) per image, then their mean."""
    valid, target = F.col("valid").cast("double"), F.col("label").cast("double")
    probability = 1 / (1 + F.exp(-logit))
    per_image = pixels.groupBy(image).agg(
        F.sum(stable_bce(logit, target, positive_weight) * valid).alias("bce"), F.sum(valid).alias("valid"),
        F.sum(probability * valid * target).alias("both"), F.sum(probability * valid).alias("predicted"),
        F.sum(target * valid).alias("true"),
        F.sum(F.abs(probability - target) * valid).alias("l1"))
    dice = 1 - (2 * F.col("both") + 1) / (F.col("predicted") + F.col("true") + 1)
    return per_image.agg(
        F.try_divide(F.sum("bce"), F.sum("valid")).alias("bce"), F.avg(dice).alias("dice"),
        F.try_divide(F.sum("l1"), F.sum("valid")).alias("l1"), F.count(F.lit(1)).alias("images"))


def coverage(pixels: DataFrame, foreground: Column, image: str = "image") -> DataFrame:
    """Share of each mask outside the candidate foreground, and of the image under the mask."""
    masked = F.col("label") == 1
    return pixels.groupBy(image).agg(
        F.try_divide(F.count_if(masked & ~foreground), F.count_if(masked)).alias("outside_foreground"),
        F.avg("label").alias("mask_fraction"), F.avg(foreground.cast("int")).alias("foreground_fraction"))
