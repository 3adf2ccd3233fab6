"""Nearest neighbours, coresets and projections of vector columns."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeframe.functions.scalar import draw, unit
from gaugeframe.operators.splits import order_digest, random_subset
from gaugeframe.runtime import cut, scratch

BLOCK_ROWS = 8192
CELLS = 1 << 19           # distances a task holds at once
PAIRS = 1 << 14           # pairs whose differences it holds at once
CODE_ROWS = 1 << 20       # codes in one block of the approximate search
QUERY_PARTS = 64          # parts the queries are cut into at most, until a part holds MOST_QUERIES
MOST_QUERIES = 1 << 16
TRAIN_ROWS = 256          # vectors a coarse centre is fitted on
WORD_ROWS = 65_536        # vectors the codewords are fitted on
PROBE_QUERIES = 200       # queries the number of probes is measured on
STARTING_POINTS = 10


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances by the expansion, never below zero."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.maximum(d, 0, out=d)


def _direct(q: np.ndarray, b: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Squared distances of the named pairs from their differences, some at a time."""
    out = np.empty(len(rows))
    for start in range(0, len(rows), PAIRS):
        here = slice(start, start + PAIRS)
        out[here] = ((q[rows[here]] - b[columns[here]]) ** 2).sum(1)
    return out


def _nearest_in_block(k: int):
    def nearest(queries: pd.DataFrame, bank: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "neighbour_id", "distance"]
        if queries.empty or bank.empty:
            return pd.DataFrame(columns=names).astype({"query_id": "int64", "neighbour_id": "int64", "distance": "float64"})
        b, ids, query_ids = matrix(bank["vector"]), bank["vec_id"].to_numpy(), queries["query_id"].to_numpy()
        keep, parts, middle = min(k, len(b)), [], b.mean(0)
        near = b - middle                                         # around the block's mean, so that little cancels
        eps, far = np.finfo(np.float64).eps * (b.shape[1] + 4), (near * near).sum(1).max()
        step = max(1, CELLS // len(b))                            # so that even a block of copies, all at one distance, stays small
        for start in range(0, len(queries), step):
            q = matrix(queries["vector"].iloc[start:start + step])
            own = q - middle
            d = squared_distances(own, near)
            edge = np.partition(d, keep - 1, axis=1)[:, keep - 1:keep]
            # What the expansion and the shift of the coordinates can be off by; all within it are compared directly.
            shift = eps * max(np.abs(q).max(), np.abs(b).max(), np.abs(middle).max())
            off = 4 * eps * ((own * own).sum(1)[:, None] + far) + 4 * shift * (np.sqrt(edge) + shift)
            rows, columns = np.nonzero(d <= edge + 2 * off)
            exact = _direct(q, b, rows, columns)                  # free of cancellation
            order = np.lexsort((ids[columns], exact, rows))
            rows, columns, exact = rows[order], columns[order], exact[order]
            first = np.searchsorted(rows, np.arange(len(q)))
            kept = np.arange(len(rows)) - first[rows] < keep
            parts.append(pd.DataFrame({"query_id": query_ids[start + rows[kept]], "neighbour_id": ids[columns[kept]], "distance": exact[kept]}))
        return pd.concat(parts, ignore_index=True)
    return nearest


def _blocked_neighbours(queries: DataFrame, bank: DataFrame, k: int) -> DataFrame:
    """Meet every query block with every bank block of its cell; keep k per block, then k per query.

    A cell of any size is cut by hash into blocks of bounded rows, so no task sees a whole cell
    and no pair of rows is ever emitted: a block pair returns at most k rows per query.
    """
    q = queries.select(
        "cell", "query_id", "vector", F.pmod(F.xxhash64("query_id"), "query_parts").alias("query_part"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bank_parts") - 1)).alias("bank_part"))
    b = bank.select(
        "cell", "vec_id", "vector", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("query_parts") - 1)).alias("query_part"),
        F.pmod(F.xxhash64("vec_id"), "bank_parts").alias("bank_part"))
    keys = ["cell", "query_part", "bank_part"]
    found = q.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(
        _nearest_in_block(k), "query_id long, neighbour_id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")     # at most k rows per block met
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _named(df: DataFrame, id_column: str, vector: str, name: str) -> DataFrame:
    return df.select(F.col(id_column).cast("long").alias(name), F.col(vector).alias("vector"))


def knn_exact(queries: DataFrame, bank: DataFrame, k: int, id_column: str = "vec_id", vector: str = "embedding",
              block: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): the k smallest squared distances to the bank."""
    size = bank.count()
    if k > size:
        raise ValueError(f"{k} neighbours asked of a bank of {size}")
    whole = {"cell": F.lit(0), "query_parts": F.lit(math.ceil(queries.count() / block)).cast("long"),
             "bank_parts": F.lit(math.ceil(size / block)).cast("long")}
    return _blocked_neighbours(_named(queries, id_column, vector, "query_id").withColumns(whole),
                               _named(bank, id_column, vector, "vec_id").withColumns(whole), k)


def _centres(vectors: DataFrame, count: int, rows: int, seed: int) -> np.ndarray:
    """``count`` centres by Lloyd's rounds on the executors, from ``TRAIN_ROWS`` vectors a centre drawn by hash; at least one."""
    share = min(1.0, count * TRAIN_ROWS / max(1, rows))
    drawn = vectors.filter(unit(draw(f"{seed}-cells", F.col("vec_id"))) < share) if share < 1 else vectors
    model = KMeans(k=max(2, count), seed=seed, maxIter=12, featuresCol="features").fit(drawn.select(array_to_vector("vector").alias("features")))
    return np.array(model.clusterCenters(), dtype=np.float64)


def _by_cell(centres: np.ndarray, counts: np.ndarray | None, least: int, probes: int):
    """The nearest cells of each vector: ``probes`` of them, and more until they hold ``least`` rows by ``counts``."""
    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        out = []
        for start in range(0, len(vectors), 256):
            order = np.argsort(squared_distances(matrix(vectors.iloc[start:start + 256]), centres), axis=1, kind="stable")
            if counts is None:
                out.extend(order[:, :probes].astype(np.int32))
                continue
            held = np.cumsum(counts[order], axis=1)
            need = np.maximum(probes, 1 + (held < least).sum(axis=1))
            out.extend(row[:n].astype(np.int32) for row, n in zip(order, need))
        return pd.Series(out)
    return nearest


def _lloyd(x: np.ndarray, count: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Codewords of one part position of a bounded sample."""
    words = x[np.random.default_rng(seed).permutation(len(x))[:count]].copy()
    for _ in range(rounds):
        nearest = np.concatenate([squared_distances(x[i:i + 4096], words).argmin(1) for i in range(0, len(x), 4096)])
        sums = np.stack([np.bincount(nearest, weights=x[:, d], minlength=len(words)) for d in range(x.shape[1])], axis=1)
        sizes = np.bincount(nearest, minlength=len(words))
        words[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return words


@dataclass
class VectorIndex:
    """Coarse centres, codewords of the residuals by part, the rows of each cell, and the codes as a table (cell, vec_id, codes)."""
    centres: np.ndarray
    words: list[np.ndarray]
    counts: np.ndarray
    codes: DataFrame
    bank: DataFrame          # vec_id, vector

    def residuals(self, x: np.ndarray, cells: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x - self.centres[cells], len(self.words), axis=1)


def build_index(bank: DataFrame, cells: int | None = None, parts: int = 16, seed: int = 7, id_column: str = "vec_id",
                vector: str = "embedding") -> VectorIndex:
    """An inverted-list index whose rows keep one byte a part instead of their vectors.

    Centres and codewords are fitted on bounded samples drawn by hash (``TRAIN_ROWS`` vectors a centre, ``WORD_ROWS`` vectors for the
    codewords of all parts); every row is indexed. The code table is written to the shared folder.
    """
    spark = bank.sparkSession
    rows = _named(bank, id_column, vector, "vec_id")
    size = rows.count()
    centres = _centres(rows, cells or max(1, round(math.sqrt(size))), size, seed)
    placed = rows.withColumn("cell", _by_cell(centres, None, 0, 1)("vector")[0])
    share = min(1.0, WORD_ROWS / max(1, size))
    sample = placed.filter(unit(draw(f"{seed}-words", F.col("vec_id"))) < share)
    parts = min(parts, centres.shape[1])

    def train(part: pd.DataFrame) -> pd.DataFrame:
        number, part = int(part["part"].iloc[0]), part.sort_values("vec_id")
        x = np.array_split(matrix(part["vector"]) - centres[part["cell"].to_numpy()], parts, axis=1)[number]
        return pd.DataFrame({"part": number, "words": [w for w in _lloyd(x, min(256, len(x)), seed + number)]})

    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    trained = sample.select("vec_id", "vector", "cell", every).groupBy("part").applyInPandas(train, "part int, words array<double>").toPandas()
    words = [np.stack(trained.loc[trained["part"] == p, "words"].to_numpy()) for p in range(parts)]
    index = VectorIndex(centres, words, np.zeros(len(centres), dtype=np.int64), placed, rows)
    index_words = spark.sparkContext.broadcast((centres, words))

    @F.pandas_udf("binary")
    def encode(vectors: pd.Series, cell: pd.Series) -> pd.Series:
        own_centres, own_words = index_words.value
        split = np.array_split(matrix(vectors) - own_centres[cell.to_numpy()], len(own_words), axis=1)
        codes = np.stack([squared_distances(x, w).argmin(1).astype(np.uint8) for x, w in zip(split, own_words)], axis=1)
        return pd.Series([c.tobytes() for c in codes])

    folder = scratch(spark, "vector-codes")
    placed.select("cell", "vec_id", encode("vector", "cell").alias("codes")).write.parquet(folder)
    index.codes = spark.read.schema("cell int, vec_id long, codes binary").parquet(folder)
    for row in index.codes.groupBy("cell").count().collect():
        index.counts[row["cell"]] = row["count"]
    return index


def probes_for(index: VectorIndex, queries: DataFrame, k: int, target: float, id_column: str = "vec_id", vector: str = "embedding",
               seed: int = 7, block: int = BLOCK_ROWS) -> int:
    """The fewest cells whose visit holds the share ``target`` of the true neighbours of at most about ``PROBE_QUERIES`` queries drawn by hash."""
    total = queries.count()
    asked = _named(queries, id_column, vector, "query_id").filter(unit(draw(f"{seed}-probes", F.col("query_id"))) < min(1.0, PROBE_QUERIES / max(1, total)))
    true = knn_exact(asked.withColumnRenamed("query_id", "vec_id"), index.bank, k, "vec_id", "vector", block)
    order = asked.select("query_id", F.posexplode(_by_cell(index.centres, None, 0, len(index.centres))("vector")).alias("place", "cell"))
    held = index.codes.select(F.col("vec_id").alias("neighbour_id"), "cell")
    places = true.join(held, "neighbour_id").join(order, ["query_id", "cell"]).groupBy("place").count().orderBy("place").collect()
    seen, wanted = 0, target * sum(r["count"] for r in places)
    for r in places:
        seen += r["count"]
        if seen >= wanted:
            return r["place"] + 1
    return len(index.centres)


def _scan_codes(index_parts, keep: int):
    """The ``keep`` smallest table-lookup distances of every query among the codes of one block, over all cells it visits."""
    def scan(queries: pa.Table, bank: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if queries.num_rows and bank.num_rows:
            centres, words = index_parts.value
            bank = bank.sort_by("cell")
            ids, cell = bank.column("vec_id").to_numpy(), bank.column("cell").to_numpy()
            codes = np.frombuffer(b"".join(bank.column("codes").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
            held, first = np.unique(cell, return_index=True)
            place = dict(zip(held.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(ids)])))
            for start in range(0, queries.num_rows, 256):
                found.append(visit(queries.slice(start, 256), centres, words, ids, codes, place))
        query, other, distance = (np.concatenate(x) for x in zip(*found))
        return pa.table({"query_id": query, "neighbour_id": other, "distance": distance})

    def visit(batch: pa.Table, centres, words, ids, codes, place):
        x = matrix(batch.column("vector").to_pandas())
        asked = batch.column("query_id").to_numpy()
        visited = batch.column("cells").combine_chunks()
        row, cell = np.repeat(np.arange(len(x)), np.diff(visited.offsets.to_numpy())), visited.flatten().to_numpy()
        order = np.argsort(cell, kind="stable")
        row, cell = row[order], cell[order]
        rows, places, distances = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for c, here in zip(*(lambda u, f: (u.tolist(), np.split(row, f[1:])))(*np.unique(cell, return_index=True))):
            low, high = place.get(c, (0, 0))
            step = max(1, CELLS // max(1, high - low))
            for some in (here[i:i + step] for i in range(0, len(here) if high > low else 0, step)):
                d = np.zeros((len(some), high - low))
                for p, (part, word) in enumerate(zip(np.array_split(x[some] - centres[c], len(words), axis=1), words)):
                    d += np.take(squared_distances(part, word), codes[low:high, p], axis=1)
                best = np.argpartition(d, keep - 1, axis=1)[:, :keep] if d.shape[1] > keep else np.broadcast_to(np.arange(d.shape[1]), d.shape)
                rows.append(np.repeat(some, best.shape[1]))
                places.append((low + best).ravel())
                distances.append(np.take_along_axis(d, best, axis=1).ravel())
        row, at, distance = np.concatenate(rows), np.concatenate(places), np.concatenate(distances)
        order = np.lexsort((ids[at], distance, row))
        row, at, distance = row[order], at[order], distance[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < keep
        return asked[row[kept]], ids[at[kept]], distance[kept]
    return scan


def knn_approx(queries: DataFrame, bank: DataFrame | VectorIndex, k: int, probes: int | None = None, cells: int | None = None, seed: int = 7,
               id_column: str = "vec_id", vector: str = "embedding", block: int = BLOCK_ROWS, target: float = 0.97, keep: int | None = None) -> DataFrame:
    """(query_id, neighbour_id, distance, rank) from an index: cells by trained centres, codes by lookup tables, exact distances last.

    Without ``probes`` their number is the smallest that holds ``target`` of the true neighbours of a sample of the queries. A query
    visits more cells where these hold fewer than ``keep`` rows (default 20 k), so every query gets k. The scan reads codes only; the vectors of
    the ``keep`` best of each query are fetched for the exact order.
    """
    keep = max(k, keep or 20 * k)
    index = bank if isinstance(bank, VectorIndex) else build_index(bank, cells, seed=seed, id_column=id_column, vector=vector)
    size = int(index.counts.sum())
    if k > size:
        raise ValueError(f"{k} neighbours asked of a bank of {size}")
    if probes is None:
        probes = probes_for(index, queries, k, target, id_column, vector, seed, block)
    asked = _named(queries, id_column, vector, "query_id")
    total = queries.count()
    query_parts = max(1, math.ceil(total / min(MOST_QUERIES, max(block, math.ceil(total / QUERY_PARTS)))))
    bank_parts = max(1, math.ceil(size / CODE_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # A query meets all its cells in the same task, so it travels, and brings back candidates, once per block of codes and not once per cell.
    q = asked.withColumn("cells", _by_cell(index.centres, index.counts, min(size, keep), min(probes, len(index.centres)))("vector")).select(
        "query_id", "vector", "cells", F.pmod(F.xxhash64("query_id"), F.lit(query_parts)).cast("int").alias("query_part"), every(bank_parts).alias("bank_part"))
    b = index.codes.select("cell", "vec_id", "codes", every(query_parts).alias("query_part"),
                           F.pmod(F.xxhash64("vec_id"), F.lit(bank_parts)).cast("int").alias("bank_part"))
    keys = ["query_part", "bank_part"]
    parts = queries.sparkSession.sparkContext.broadcast((index.centres, index.words))
    near = q.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(_scan_codes(parts, keep), "query_id long, neighbour_id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")          # at most ``keep`` rows per block met
    few = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep).select("query_id", "neighbour_id")
    pairs = (few.join(asked.withColumnRenamed("vector", "asked"), "query_id")
             .join(index.bank.select(F.col("vec_id").alias("neighbour_id"), "vector"), "neighbour_id"))
    @F.pandas_udf("double")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(((matrix(a) - matrix(b)) ** 2).sum(1) if len(a) else np.empty(0))

    exact = pairs.select("query_id", "neighbour_id", apart("asked", "vector").alias("distance"))
    return exact.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def patch_max(neighbours: DataFrame, images: DataFrame, id_column: str = "vec_id") -> DataFrame:
    """Image score: the largest patch score, a patch scoring the mean of its neighbour distances."""
    patches = neighbours.groupBy("query_id").agg(F.avg("distance").alias("patch_score"))
    return (patches.join(images.select(F.col(id_column).alias("query_id"), "image"), "query_id")
            .groupBy("image").agg(F.max("patch_score").alias("score"), F.count(F.lit(1)).alias("patches")))


def projection_weights(dimension: int, width: int, seed: int) -> np.ndarray:
    """width x dimension weights in +-1/sqrt(dimension), each from its own hash."""
    def weight(i: int, j: int) -> float:
        number = int(hashlib.sha256(f"{seed}|{i}|{j}".encode()).hexdigest()[:8], 16)
        return (2 * number / 4294967296.0 - 1) / math.sqrt(dimension)
    return np.array([[weight(i, j) for j in range(dimension)] for i in range(width)])


def random_projection(vector: Column, dimension: int, width: int = 128, seed: int = 0) -> Column:
    """Bias-free linear map; vectors that already have the width stay as they are."""
    if dimension == width:
        return F.transform(vector, lambda x: x.cast("double"))
    weights = projection_weights(dimension, width, seed).T

    @F.pandas_udf("array<double>")
    def project(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(matrix(vectors) @ weights))
    return project(vector)


# --- coreset --------------------------------------------------------------------------------

def _shrink(picks: np.ndarray):
    """Distance to the nearest pick, where that is smaller than the present value."""
    @F.pandas_udf("double")
    def shrink(vectors: pd.Series, value: pd.Series) -> pd.Series:
        m, out = matrix(vectors), value.to_numpy(dtype=np.float64).copy()
        for pick in picks:
            np.minimum(out, np.sqrt(((m - pick) ** 2).sum(1)), out=out)
        return pd.Series(out)
    return shrink


def _exact_anchor(vectors: DataFrame) -> DataFrame:
    """L2 norm of every row of the full distance matrix, from two sums over the vectors.

    sum_j |x - y_j|^2 = n |x|^2 + sum_j |y_j|^2 - 2 x . sum_j y_j
    """
    cells = vectors.select(F.posexplode("vector").alias("pos", "x")).groupBy("pos").agg(
        F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.col("x").cast("double") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    rows = cells.orderBy("pos").collect()               # one row per dimension
    total, square, n = np.array([r["s"] for r in rows]), sum(r["q"] for r in rows), rows[0]["n"]

    @F.pandas_udf("double")
    def anchor(column: pd.Series) -> pd.Series:
        m = matrix(column)
        return pd.Series(np.sqrt(np.maximum(n * (m * m).sum(1) + square - 2 * (m @ total), 0)))
    return vectors.withColumn("value", anchor("vector"))


def _approximate_anchor(vectors: DataFrame, seed: int, points: int = STARTING_POINTS) -> DataFrame:
    """Mean distance to a few drawn starting points."""
    drawn = vectors.withColumn("__d", order_digest(seed, F.col("id"))).orderBy("__d", "id").limit(points).collect()
    starts = np.array([r["vector"] for r in drawn], dtype=np.float64)

    @F.pandas_udf("double")
    def anchor(column: pd.Series) -> pd.Series:
        return pd.Series(np.sqrt(squared_distances(matrix(column), starts)).mean(1))
    return vectors.withColumn("value", anchor("vector"))


def farthest_point_coreset(vectors: DataFrame, fraction: float, anchor: str = "exact", seed: int = 0, pool: int = 256,
                           cut_every: int = 8, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Greedy coreset of int(n * fraction) vectors, as (pick, id): each pick is the farthest from those before.

    One pass brings the ``pool`` farthest vectors to the driver. Values only shrink, so as long as
    the best value left in the pool is above the pool's lowest, no vector outside can be the
    next pick: many exact greedy picks come from one pass over the data.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_column).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("vector"))
    n = base.count()
    target = n if fraction >= 1 else int(n * fraction)
    state = cut(_exact_anchor(base) if anchor == "exact" else _approximate_anchor(base, seed))
    picks: list[int] = []
    recent: list[np.ndarray] = []
    passes = 0
    while len(picks) < target:
        current = state.withColumn("value", _shrink(np.array(recent))("vector", "value")) if recent else state
        if passes and passes % cut_every == 0:
            state, recent = cut(current), []
            current = state
        top = current.orderBy(F.desc("value"), "id").limit(pool).collect()
        m, values = np.array([r["vector"] for r in top]), np.array([r["value"] for r in top])
        ids, floor, whole = [r["id"] for r in top], values[-1], len(top) == n
        first = True
        while len(picks) < target:
            best = int(np.argmax(values))       # the pool is sorted by id inside equal values
            if not (first or whole or values[best] > floor):
                break
            first = False
            picks.append(ids[best])
            recent.append(m[best])
            values = np.minimum(values, np.sqrt(((m - m[best]) ** 2).sum(1)))
        passes += 1
    return spark.createDataFrame([(i, p) for i, p in enumerate(picks)], "pick int, id long")


def coverage_radius(vectors: DataFrame, coreset: DataFrame, id_column: str = "vec_id", vector: str = "embedding",
                    block: int = BLOCK_ROWS) -> DataFrame:
    """Largest distance of any vector to its nearest coreset member."""
    members = vectors.join(coreset.select(F.col("id").alias(id_column)), id_column, "left_semi")
    return knn_exact(vectors, members, 1, id_column, vector, block).agg(F.sqrt(F.max("distance")).alias("radius"))
