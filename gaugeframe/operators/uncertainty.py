"""Bootstrap intervals with draws that depend on hashes only."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeframe.functions.scalar import hex_word, standardised_partial_area, unit
from gaugeframe.operators.prefix import exact_quantiles, hash_index, value_boundaries
from gaugeframe.operators.ranking import ranking_metrics, score_boundaries
from gaugeframe.operators.splits import order_digest
from gaugeframe.operators.splitting import chained_areas, split_areas
from gaugeframe.runtime import cut

DRAWS_PER_HASH = 8
CELLS_PER_BLOCK = 4_000_000
CELLS_AT_ONCE = 500_000      # of a block's (level, replicate) cells and of its draws, so many are counted at a time
DRAWS_PER_BLOCK = 1_000_000  # four bytes each while they are gathered
MAX_BLOCKS = 65_536


def spread(rows: DataFrame, *columns: str) -> DataFrame:
    """Narrow rows over all tasks, before each becomes many."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *columns)


def _blocks(samples: int) -> int:
    return (samples + DRAWS_PER_HASH - 1) // DRAWS_PER_HASH


def drawn_replicates(rows: DataFrame, key: str, label: str, samples: int, seed: int) -> DataFrame:
    """(key, replicates): the replicates a row is drawn into, each class resampled to its own size.

    A row drawn twice into a replicate lists it twice; the eight words of one digest serve eight
    replicates. A row is drawn about once per replicate, so the lists stay near ``samples`` long. Draws travel
    packed, by blocks of drawn rows that hold about ``DRAWS_PER_BLOCK`` draws. A row without a label is not drawn.
    """
    numbered = cut(hash_index(rows.select(key, label).filter(F.col(label).isNotNull()), [label], order_digest(seed, F.col(key)), [key]))
    number, kind = (pa.int16(), "smallint") if samples <= 32_767 else (pa.int32(), "int")       # short numbers halve what the joins carry
    targets = max(1, DRAWS_PER_BLOCK // samples)
    per_block, tails = targets * samples, [str(b).encode() for b in range(_blocks(samples))]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Draws of some rows at a time, sorted: per block of drawn rows, (drawn row * samples + replicate) as packed numbers."""
        for batch in batches:
            words, index, sizes = (batch.column(c).to_pylist() for c in (1, 2, 3))
            step = max(1, CELLS_AT_ONCE // samples)
            for word in set(words):
                own = [i for i, w in enumerate(words) if w == word]
                for some in (own[at:at + step] for at in range(0, len(own), step)):
                    heads = [f"{seed}-draw|{word}|{index[i]}|".encode() for i in some]
                    packed = b"".join(hashlib.sha256(head + tail).digest() for head in heads for tail in tails)
                    drawn = np.frombuffer(packed, ">u4").reshape(len(some), -1)[:, :samples].astype(np.int64) % sizes[some[0]]
                    codes = np.sort((drawn * samples + np.arange(samples)).ravel())
                    blocks = np.unique(codes // per_block)
                    ends = np.searchsorted(codes, (blocks + 1) * per_block)
                    parts = np.split((codes % per_block).astype("<u4"), ends[:-1])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([some[0]] * len(blocks))), pa.array(blocks, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())],
                        names=[label, "__block", "codes"])

    def gather(group: tuple, table: pa.Table) -> pa.Table:
        codes = np.sort(np.concatenate([np.frombuffer(c.as_py(), "<u4") for c in table.column("codes")]))
        rows, starts = np.unique(codes // samples, return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(codes)), pa.int32()), pa.array((codes % samples).astype(np.int32)).cast(number))
        return pa.table([table.column(label).take(pa.array([0] * len(rows))), pa.array(rows.astype(np.int64) + group[1].as_py() * targets), lists], names=[label, "idx", "replicates"])

    each = spread(numbered.select(label, "idx", "n"), label, "idx").select(label, F.col(label).cast("string").alias("word"), "idx", "n")
    name = _fields(numbered, [label])
    drawn = each.mapInArrow(draw, name + "__block bigint, codes binary").groupBy(label, "__block").applyInArrow(gather, name + f"idx bigint, replicates array<{kind}>")
    return drawn.join(numbered.select(label, "idx", key), [label, "idx"]).select(key, "replicates")


def poisson_replicates(rows: DataFrame, key: str, samples: int, seed: int) -> DataFrame:
    """(key, replicates) with Poisson(1) multiplicities drawn from the row's own digests, so no draw has to find its row.

    The probabilities are those of the Poisson law up to a tail below 1e-9.
    """
    def weight(u: Column) -> Column:
        ladder, mass, term = None, 0.0, 0.36787944117144233
        for k in range(12):
            mass += term
            ladder = F.when(u < mass, k) if ladder is None else ladder.when(u < mass, k)
            term /= k + 1
        return ladder.otherwise(12)

    digests = F.transform(F.sequence(F.lit(0), F.lit(_blocks(samples) - 1)), lambda b: F.sha2(
        F.concat_ws("|", F.lit(f"{seed}-poisson"), F.col(key).cast("string"), b.cast("string")), 256))
    def repeated(digest: Column, block: Column) -> Column:
        words = F.array(*[unit(hex_word(digest, w)) for w in range(DRAWS_PER_HASH)])
        return F.flatten(F.transform(words, lambda u, w: F.array_repeat(block * DRAWS_PER_HASH + w, weight(u))))

    lists = F.filter(F.flatten(F.transform(digests, repeated)), lambda r: r < samples).alias("replicates")
    return spread(rows.select(key), key).select(key, lists).filter(F.size("replicates") > 0)


def _replicates(rows: DataFrame, key: str, label: str, samples: int, seed: int, method: str) -> DataFrame:
    if samples < 1:
        raise ValueError("the bootstrap needs a positive number of samples")
    if method == "poisson":
        return poisson_replicates(rows, key, samples, seed)
    return drawn_replicates(rows, key, label, samples, seed)


def _dense(block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """One entry per (row, replicate) of a block: level of the score, replicate, positive; and the number of levels."""
    order = np.argsort(block["score"].to_numpy(), kind="stable")
    scores, labels = block["score"].to_numpy()[order], block["label"].to_numpy()[order] == 1
    lists = block["replicates"].to_numpy()[order]
    sizes = [len(x) for x in lists]
    group = np.concatenate([[0], np.cumsum(scores[1:] != scores[:-1])])       # equal scores share a number
    return np.repeat(group.astype(np.int32), sizes), np.concatenate(lists), np.repeat(labels, sizes), int(group[-1]) + 1


def _tables(dense, samples: int, falling: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positives and negatives per (level, replicate) for some levels at a time, bounded by cells and by draws.

    Levels rise inside a table; the tables rise too, or fall. Every draw is counted once.
    """
    level, replicate, positive, levels = dense
    first = np.searchsorted(level, np.arange(levels + 1))
    most, cuts = max(1, CELLS_AT_ONCE // samples), [0]
    while cuts[-1] < levels:
        last = int(np.searchsorted(first, first[cuts[-1]] + CELLS_AT_ONCE, "right")) - 1
        cuts.append(min(max(last, cuts[-1] + 1), cuts[-1] + most, levels))
    for a, b in reversed([*zip(cuts, cuts[1:])]) if falling else zip(cuts, cuts[1:]):
        size = (b - a) * samples
        pos, neg = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for at in range(first[a], first[b], CELLS_AT_ONCE):          # one level alone may hold more draws
            some = slice(at, min(at + CELLS_AT_ONCE, first[b]))
            cell, yes = (level[some].astype(np.int64) - a) * samples + replicate[some], positive[some]
            pos += np.bincount(cell[yes], minlength=size)
            neg += np.bincount(cell[~yes], minlength=size)
        yield pos.reshape(-1, samples), neg.reshape(-1, samples)


def _block_sums(keys: Sequence[str], samples: int):
    """Per block and replicate: positives, negatives and the pairs the block's positives win inside it."""
    def sums(part: tuple, block: pd.DataFrame) -> pd.DataFrame:
        pos, neg, won = (np.zeros(samples) for _ in range(3))
        for p, n in _tables(_dense(block), samples):
            below = neg + np.cumsum(n, axis=0) - n
            won += (p * (below + n / 2)).sum(0)
            pos += p.sum(0)
            neg += n.sum(0)
        out = pd.DataFrame({"replicate": np.arange(samples), "pos": pos, "neg": neg, "won": won})
        for name, value in zip([*keys, "bucket"], part):
            out[name] = value
        return out[[*keys, "bucket", "replicate", "pos", "neg", "won"]]
    return sums


def _fields(rows: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys)


def _score_blocks(rows: DataFrame, keys: Sequence[str], samples: int, tie: str, source: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """Rows in score blocks of bounded size, their sums per (keys, bucket, replicate), and the buckets of one single score.

    A score that fills more than a block gets a bucket of its own, which is cut by hash: inside
    one score only totals matter.
    """
    limit = max(256, CELLS_PER_BLOCK // samples)
    points = value_boundaries(source.select(*keys, "score"), keys, "score", limit, MAX_BLOCKS, repeats=True)
    heavy = {v: n for v, n in Counter(points).items() if n > 1}
    bounds = sorted({*points, *(float(np.nextafter(v, np.inf)) for v in heavy)})
    tied = {bounds.index(v) + 1: n + 1 for v, n in heavy.items()}
    splits = [-float("inf"), *(bounds or [0.0]), float("inf")]
    blocks = Bucketizer(splits=splits, inputCol="score", outputCol="__slot").transform(
        rows.select(*keys, F.col(tie).alias("__tie"), "label", F.col("score").cast("double").alias("score"), "replicates"))
    blocks = blocks.withColumn("bucket", F.col("__slot").cast("int"))
    parts = F.lit(1)
    for slot, n in tied.items():
        parts = F.when(F.col("bucket") == slot, n).otherwise(parts)
    blocks = blocks.withColumn("part", F.pmod(F.xxhash64("__tie"), parts)).select(*keys, "bucket", "part", "label", "score", "replicates")
    work = _block_sums(keys, samples)
    counted = blocks.groupBy(*keys, "bucket", "part").applyInPandas(
        lambda part, block: work(part[:-1], block), _fields(rows, keys) + "bucket int, replicate int, pos double, neg double, won double")
    whole = counted.groupBy(*keys, "bucket", "replicate").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("won").alias("won"))
    if tied:
        whole = whole.withColumn("won", F.when(F.col("bucket").isin(*tied), F.col("pos") * F.col("neg") / 2).otherwise(F.col("won")))
    return blocks, whole, sorted(tied)


def resampled_areas(rows: DataFrame, keys: Sequence[str], samples: int, tie: str, source: DataFrame) -> DataFrame:
    """ROC area per (keys, replicate) of rows (keys, label, score, replicates); ``source`` holds their scores.

    Each score block counts inside itself, and a window over the blocks adds the negatives of the lower ones.
    """
    keys = list(keys)
    return chained_areas(_score_blocks(rows, keys, samples, tie, source)[1], keys)


def _cut_areas(tables: Iterator[tuple[np.ndarray, np.ndarray]], ends: pd.DataFrame) -> np.ndarray:
    """Per row of ``ends``: wins of positives over negatives under the curve from (fp, tp) up to ``stop`` negatives; tables fall."""
    at, tp, fp, stop = (ends[c].to_numpy() for c in ("replicate", "tp", "fp", "stop"))
    area = np.zeros(len(ends))
    for pos, neg in tables:
        p, n = pos[::-1, at], neg[::-1, at]
        tps, fps = tp + np.cumsum(p, axis=0), fp + np.cumsum(n, axis=0)
        share = np.divide(np.clip(stop - (fps - n), 0, n), n, out=np.zeros(n.shape), where=n > 0)
        area += (share * n * (tps - p + share * p / 2)).sum(0)
        tp, fp = tps[-1], fps[-1]
        if (fp >= stop).all():
            break
    return area


def resampled_partial_areas(rows: DataFrame, keys: Sequence[str], samples: int, tie: str, source: DataFrame,
                            max_fpr: float = 0.1) -> DataFrame:
    """Standardised partial area up to ``max_fpr`` per (keys, replicate); NULL where a class is missing.

    Block sums say where each replicate reaches the limit. Blocks above count whole, blocks below not at
    all; only the block with the limit is opened again, for the replicates that end in it.
    """
    keys = list(keys)
    blocks, whole, tied = _score_blocks(rows, keys, samples, tie, source)
    part = Window.partitionBy(*keys, "replicate")
    higher = part.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)      # one row per bucket
    placed = cut(whole.withColumns({
        "tp": F.coalesce(F.sum("pos").over(higher), F.lit(0.0)), "fp": F.coalesce(F.sum("neg").over(higher), F.lit(0.0)),
        "positives": F.sum("pos").over(part), "negatives": F.sum("neg").over(part)}).withColumn("stop", F.col("negatives") * max_fpr))
    p, n = F.col("pos"), F.col("neg")
    share = F.least(F.lit(1.0), F.try_divide(F.col("stop") - F.col("fp"), n))
    single = F.col("bucket").isin(*tied) if tied else F.lit(False)
    inside = (F.when(F.col("fp") >= F.col("stop"), 0.0)
              .when(F.col("fp") + n <= F.col("stop"), n * F.col("tp") + F.col("won"))
              .when(single, share * n * (F.col("tp") + share * p / 2)))
    known = placed.withColumn("area", inside)

    def opened(key: tuple, block: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, "replicate", "area"]
        if block.empty or ends.empty:
            return pd.DataFrame(columns=names)
        ends = ends.sort_values("replicate")
        out = pd.DataFrame({"replicate": ends["replicate"].to_numpy(), "area": _cut_areas(_tables(_dense(block), samples, falling=True), ends)})
        for name, value in zip(keys, key):
            out[name] = value
        return out[names]

    ends = known.filter("area IS NULL").select(*keys, "bucket", "replicate", "tp", "fp", "stop")
    refined = blocks.join(ends.select(*keys, "bucket").distinct(), [*keys, "bucket"], "left_semi").groupBy(*keys, "bucket").cogroup(
        ends.groupBy(*keys, "bucket")).applyInPandas(opened, _fields(rows, keys) + "replicate int, area double")
    sums = known.groupBy(*keys, "replicate").agg(F.sum("area").alias("area"), F.max("positives").alias("positives"), F.max("negatives").alias("negatives"))
    closing = refined.groupBy(*keys, "replicate").agg(F.sum("area").alias("closing"))
    total = sums.join(closing, [*keys, "replicate"], "left").withColumn("area", F.coalesce("area", F.lit(0.0)) + F.coalesce("closing", F.lit(0.0)))
    area = F.try_divide(F.col("area"), F.col("positives") * F.col("negatives"))
    return total.select(*keys, "replicate", standardised_partial_area(area, max_fpr).alias("partial_auroc"))


def bootstrap_auroc(rows: DataFrame, samples: int = 1000, seed: int = 42, key: str = "image", method: str = "draws") -> DataFrame:
    """Percentile interval of the ROC area under class-wise resampling.

    "draws" draws rows and "poisson" weights them; "split" splits class sizes over the score histogram, so
    its shuffles hold scores and never rows times samples. A Poisson replicate that lost a whole class has
    no area and is not counted.
    """
    if samples < 1:
        raise ValueError("the bootstrap needs a positive number of samples")
    if method == "split":
        areas = split_areas(rows, samples, seed)
    else:
        lists = _replicates(rows, key, "label", samples, seed, method)
        areas = resampled_areas(rows.select(key, "label", "score").join(lists, key), [], samples, key, rows)
    out = exact_quantiles(areas, [], "auroc", {"lower": 0.025, "upper": 0.975}, bounds=[])
    return out.select(F.col("n").alias("samples"), "lower", "upper")


def check_pairing(control: DataFrame, candidate: DataFrame, key: str, label: str, condition: str) -> None:
    """Both runs must hold the same groups, labels and variants."""
    names = [key, label, condition]
    both = control.select(*names, F.lit(1).alias("side")).unionByName(candidate.select(*names, F.lit(-1).alias("side")))
    if not both.groupBy(*names).agg(F.sum("side").alias("balance")).filter("balance <> 0").isEmpty():
        raise ValueError("a paired bootstrap needs identical groups in both runs")


def paired_bootstrap(control: DataFrame, candidate: DataFrame, samples: int = 1000, seed: int = 4_000_042,
                     key: str = "group_id", metric: str = "auroc", method: str = "draws") -> DataFrame:
    """Interval of candidate minus control in the pooled ROC area or the partial area up to 0.1.

    Groups are resampled and keep all their variants.
    """
    check_pairing(control, candidate, key, "label", "condition")
    groups = control.select(key, "label").distinct()
    lists = _replicates(groups, key, "label", samples, seed, method)
    if metric == "partial_auroc":
        lists = cut(lists)                                    # the blocks are read twice, the draws are made once
    runs = control.select(key, "label", "score", F.lit(0).alias("run")).unionByName(
        candidate.select(key, "label", "score", F.lit(1).alias("run")))
    joined = runs.join(lists, key)
    bounds = score_boundaries(runs)
    work = {"auroc": resampled_areas, "partial_auroc": resampled_partial_areas}[metric]
    areas = work(joined, ["run"], samples, key, runs)
    sign = F.when(F.col("run") == 1, F.col(metric)).otherwise(-F.col(metric))
    change = areas.groupBy("replicate").agg(F.sum(sign).alias("change"))
    interval = exact_quantiles(change, [], "change", {"lower": 0.025, "upper": 0.975}, bounds=[])
    point = ranking_metrics(runs, ["run"], bounds=bounds).agg(F.sum(sign).alias("difference"))
    return interval.select(point.scalar().alias("difference"), "lower", "upper", F.col("n").alias("samples"))
