"""Bootstrap replicates as counts: a class size is split over score blocks, so no row is drawn and none is repeated."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeframe.operators.ranking import score_histogram
from gaugeframe.runtime import cut

CELLS_PER_BLOCK = 2_000_000
CLASSES = ("neg", "pos")


def _generator(seed: int, *place) -> np.random.Generator:
    digest = hashlib.sha256("|".join(map(str, (seed, *place))).encode()).digest()
    return np.random.Generator(np.random.Philox(key=int.from_bytes(digest[:16], "little")))


def block_totals(path: pd.DataFrame, block: int, samples: int, seed: int, label: str) -> np.ndarray:
    """Draws that reach a block in each replicate, by one binomial a level on the way from the root.

    ``path`` holds a row per level with the class total of the node and of its left half. The
    generator of a node depends on the seed and the node, so both halves agree without meeting.
    """
    levels = path.sort_values("level")
    drawn = np.full(samples, int(levels[f"{label}_total"].iloc[0]), dtype=np.int64)
    depth = len(levels)
    for level, total, left in zip(levels["level"], levels[f"{label}_total"], levels[f"{label}_left"]):
        share = left / total if total else 0.0
        to_left = _generator(seed, label, level, block >> (depth - level)).binomial(drawn, share)
        drawn = drawn - to_left if block >> (depth - level - 1) & 1 else to_left
    return drawn


def block_weights(counts: np.ndarray, drawn: np.ndarray, block: int, seed: int, label: str, start: int) -> np.ndarray:
    """Draws per (replicate, score) inside one block, for the replicates of ``drawn``."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros((len(drawn), len(counts)), dtype=np.int64)
    return _generator(seed, label, "block", block, start).multinomial(drawn, counts / total)


def chained_areas(whole: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ROC area per (keys, replicate) of sums per bucket: positives also win against the negatives of lower buckets."""
    lower = Window.partitionBy(*keys, "replicate").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)   # one row per bucket
    chained = whole.withColumn("won", F.col("won") + F.col("pos") * F.coalesce(F.sum("neg").over(lower), F.lit(0.0)))
    return chained.groupBy(*keys, "replicate").agg(
        F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg")).alias("auroc"))


def score_ranges(rows: DataFrame, samples: int, cells: int = CELLS_PER_BLOCK) -> tuple[DataFrame, int]:
    """(block, score, pos, neg): the score histogram in written ranges of about cells / samples scores, and the depth of the tree.

    A score is one row however often it occurs. The range of a row is data, so a recomputed stage finds it in the same block.
    """
    hist = cut(score_histogram(rows, []))
    parts = max(1, math.ceil(hist.count() * samples / cells))
    ranged = cut(hist.repartitionByRange(parts, "score").withColumn("block", F.spark_partition_id()))
    last = ranged.agg(F.max("block")).first()[0] or 0
    return ranged.select("block", "score", "pos", "neg"), max(1, last.bit_length())


def tree_paths(ranges: DataFrame, depth: int) -> DataFrame:
    """(block, level, totals of the node and of its left half per class); a few rows per block."""
    totals = ranges.groupBy("block").agg(*[F.sum(c).alias(c) for c in CLASSES])
    placed = totals.select(F.col("block").alias("block"), *CLASSES, F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("level")).withColumns({
        "node": F.expr(f"shiftright(block, {depth} - level)"), "right": F.expr(f"shiftright(block, {depth} - level - 1) & 1")})
    nodes = placed.groupBy("level", "node").agg(
        *[F.sum(c).alias(f"{c}_total") for c in CLASSES],
        *[F.sum(F.when(F.col("right") == 0, F.col(c)).otherwise(0)).alias(f"{c}_left") for c in CLASSES])
    return placed.select("block", "level", "node").join(nodes, ["level", "node"]).drop("node")


def split_areas(rows: DataFrame, samples: int, seed: int, cells: int = CELLS_PER_BLOCK) -> DataFrame:
    """(replicate, auroc) of rows (label, score): each class is resampled to its own size.

    The draws of a class are a multinomial over scores. It is split along a binary tree over score
    blocks by binomials and inside a block exactly over its scores, which is the same law as drawing rows.
    Rows must be finite and labelled. A missing class gives NULL areas, no rows no areas.
    Replays are equal where numpy is equal: its streams may change between releases.
    """
    ranges, depth = score_ranges(rows, samples, cells)

    def sums(key: tuple, block: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        number = int(key[0])
        block = block.sort_values("score")
        drawn = {c: block_totals(path, number, samples, seed, c) for c in CLASSES}
        won = np.zeros(samples)
        step = max(1, cells // len(block))
        for start in range(0, samples, step):
            n, p = (block_weights(block[c].to_numpy(), drawn[c][start:start + step], number, seed, c, start) for c in CLASSES)
            won[start:start + step] = (p * (np.cumsum(n, axis=1) - n / 2)).sum(1)
        return pd.DataFrame({"bucket": number, "replicate": np.arange(samples), "pos": drawn["pos"].astype(float), "neg": drawn["neg"].astype(float), "won": won})

    counted = ranges.groupBy("block").cogroup(tree_paths(ranges, depth).groupBy("block")).applyInPandas(
        sums, "bucket int, replicate int, pos double, neg double, won double")
    return chained_areas(counted, [])
