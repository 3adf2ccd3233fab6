"""Operators on pixel tables (image, y, x, values)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeframe.operators.prefix import exact_quantiles, running_totals
from gaugeframe.runtime import rows_per_bucket


def survives_nearest(position: Column, size: int, target: int) -> Column:
    """Does nearest-neighbour resizing from ``size`` to ``target`` sample this position?

    Target cell o samples floor((o + 0.5) * size / target).
    """
    cell = F.greatest(F.ceil(position * target / F.lit(float(size)) - 0.5), F.lit(0))
    return (cell < target) & (F.floor((cell + 0.5) * size / F.lit(float(target))) == position)


def vanishing_masks(pixels: DataFrame, keys: Sequence[str], size: tuple[int, int], target: tuple[int, int], image: str = "image") -> DataFrame:
    """Defective images whose mask has no positive pixel left after resizing, per group."""
    kept = survives_nearest(F.col("y"), size[0], target[0]) & survives_nearest(F.col("x"), size[1], target[1])
    images = pixels.groupBy(*keys, image).agg(
        F.max("label").alias("label"), F.max(F.when(kept, F.col("label")).otherwise(0)).alias("resized"))
    return images.groupBy(*keys).agg(
        F.count_if(F.col("label") == 1).alias("defective"), F.count_if((F.col("label") == 1) & (F.col("resized") == 0)).alias("vanished"))


def every_kth(pixels: DataFrame, k: int, width: int, image: str = "image") -> DataFrame:
    """Every k-th of the given pixels of each image in row-major order, starting with the first."""
    placed = pixels.withColumns({"__place": (F.col("y").cast("bigint") * width + F.col("x")), "__one": F.lit(1).cast("bigint")})
    numbered = running_totals(placed, [image], ["__place"], ["__one"], source=placed.select(image, "__place"))
    return numbered.filter(F.col("__one_before") % k == 0).select(*pixels.columns)


def _line_extreme(fixed: str, along: str, radius: int, image: str):
    return Window.partitionBy(image, fixed).orderBy(along).rangeBetween(-radius, radius)


def morphology_open(pixels: DataFrame, flag: str = "flag", radius: int = 1, image: str = "image") -> DataFrame:
    """Erosion then dilation by a (2 radius + 1)-square; cells outside the grid are ignored.

    The square splits into a row and a column pass, and a partition is one line of one image, so
    pixels are never multiplied and a large image is spread over its lines.
    """
    rows, columns = _line_extreme("y", "x", radius, image), _line_extreme("x", "y", radius, image)
    eroded = pixels.withColumn("__e", F.min(flag).over(rows)).withColumn("__e", F.min("__e").over(columns))
    dilated = eroded.withColumn("__d", F.max("__e").over(columns)).withColumn("opened", F.max("__d").over(rows))
    return dilated.withColumnRenamed("__e", "eroded").drop("__d")


def dilate(pixels: DataFrame, flag: str, name: str, radius: int = 1, image: str = "image") -> DataFrame:
    rows, columns = _line_extreme("y", "x", radius, image), _line_extreme("x", "y", radius, image)
    return pixels.withColumn("__d", F.max(flag).over(rows)).withColumn(name, F.max("__d").over(columns)).drop("__d")


def foreground_thresholds(pixels: DataFrame, channels: Sequence[str], size: tuple[int, int], image: str = "image",
                          floor: float = 0.04, spread: float = 6.0, quantile: float = 0.98) -> DataFrame:
    """Per image: border background per channel and the distance from it that counts as foreground."""
    height, width = size
    border = max(1, min(height, width) // 32)
    sides = F.array_compact(F.array(     # a corner belongs to two sides and counts twice
        F.when(F.col("x") < border, 1), F.when(F.col("x") >= width - border, 2),
        F.when(F.col("y") < border, 3), F.when(F.col("y") >= height - border, 4)))
    edge = pixels.select(image, *channels, F.explode(sides).alias("__side")).drop("__side")
    small = 4 * border * max(height, width) <= rows_per_bucket(pixels.sparkSession)
    known = {"bounds": []} if small else {}        # the border of one image bounds the group
    background = None
    for c in channels:
        median = exact_quantiles(edge, [image], c, {f"{c}_background": 0.5}, lower=[f"{c}_background"], **known).drop("n")
        background = median if background is None else background.join(median, image)
    distances = edge.join(background, image).select(image, background_distance(channels).alias("distance"))
    middle = exact_quantiles(distances, [image], "distance", {"middle": 0.5, "high": quantile}, lower=["middle"], **known).drop("n")
    deviations = distances.join(middle, image).select(image, F.abs(F.col("distance") - F.col("middle")).alias("deviation"))
    mad = exact_quantiles(deviations, [image], "deviation", {"mad": 0.5}, lower=["mad"], **known).drop("n")
    return (background.join(middle, image).join(mad, image)
            .withColumn("threshold", F.greatest(F.lit(floor), F.col("middle") + spread * F.col("mad"), F.col("high")))
            .drop("middle", "high", "mad"))


def background_distance(channels: Sequence[str]) -> Column:
    total = None
    for c in channels:
        square = (F.col(c) - F.col(f"{c}_background")) * (F.col(c) - F.col(f"{c}_background"))
        total = square if total is None else total + square
    return F.sqrt(total / len(channels))


def robust_foreground(pixels: DataFrame, channels: Sequence[str], size: tuple[int, int], image: str = "image", **options) -> DataFrame:
    """Flag what stands out from the border, then open the flags."""
    thresholds = foreground_thresholds(pixels, channels, size, image, **options)
    flagged = pixels.join(thresholds, image).withColumn("distance", background_distance(channels)).withColumn(
        "flag", (F.col("distance") > F.col("threshold")).cast("int"))
    return morphology_open(flagged.select(image, "y", "x", "distance", "threshold", "flag"), "flag", 1, image)


def map_statistics(pixels: DataFrame, value: str, image: str = "image") -> DataFrame:
    kept = F.when(F.col("valid"), F.col(value))
    return pixels.groupBy(image).agg(F.count(kept).alias("valid_pixels"), F.avg(kept).alias("mean"), F.max(kept).alias("maximum"))


def block_means(pixels: DataFrame, value: str, block: int, image: str = "image") -> DataFrame:
    """Mean over the valid cells of each block; 0 where nothing is valid."""
    kept = F.when(F.col("valid"), F.col(value))
    return pixels.groupBy(image, F.floor(F.col("y") / block).cast("int").alias("block_y"), F.floor(F.col("x") / block).cast("int").alias("block_x")).agg(
        F.avg(F.col("valid").cast("int")).alias("coverage"), F.coalesce(F.avg(kept), F.lit(0.0)).alias("mean"))


def donor_blend(pixels: DataFrame, pairs: DataFrame, size: tuple[int, int], image: str = "image", value: str = "value") -> DataFrame:
    """Blend a shifted donor into each recipient where ``alpha`` is positive.

    ``pairs`` holds (image, donor, shift_y, shift_x); ``pixels`` also carries ``alpha``. The donor
    wraps around the edges and is first moved to the recipient's mean inside the support.
    """
    height, width = size
    donors = pixels.select(F.col(image).alias("donor"), F.col("y").alias("__y"), F.col("x").alias("__x"), F.col(value).alias("replacement"))
    moved = pairs.join(donors, "donor").select(
        image, F.pmod(F.col("__y") + F.col("shift_y"), F.lit(height)).alias("y"), F.pmod(F.col("__x") + F.col("shift_x"), F.lit(width)).alias("x"), "replacement")
    both = pixels.join(moved, [image, "y", "x"])
    inside = F.col("alpha") > 0
    offsets = both.groupBy(image).agg((F.avg(F.when(inside, F.col(value))) - F.avg(F.when(inside, F.col("replacement")))).alias("offset"))
    shifted = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("replacement") + F.coalesce("offset", F.lit(0.0))))
    blended = F.col(value) * (1 - F.col("alpha")) + shifted * F.col("alpha")
    return both.join(offsets, image).select(image, "y", "x", value, blended.alias("blended"),
                                            (F.abs(blended - F.col(value)) > 1e-6).alias("changed"))
