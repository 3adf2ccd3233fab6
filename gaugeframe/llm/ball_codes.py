"""Vector codes by ball k-means.

Vectors of whole numbers are cut into equal parts, and every part position has a codebook of whole-number
entries. The first assignment compares every part with every entry. Later ones use balls: an entry and its parts form a ball
whose radius is bounded by the last radius plus the entry's move. Only entries less than two radii away are its
neighbours. A part nearer to its entry than half the way to the closest neighbour lies in the stable core and keeps
its code; any other lies in an annular ring that names the few neighbours it is compared with. All distances are
whole numbers, so no comparison depends on rounding.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.common import bounded_batches
from gaugeframe.llm.topk import quantised
from gaugeframe.runtime import scratch, tune

PARTS = 16
ENTRIES = 64
ROUNDS = 2
LARGEST = 1 << 26          # components beyond this could overflow the 64-bit sums of squares
BROADCAST_LABELS = 10_000


@dataclass
class Books:
    """Entries by part, entry and position; for later assignments the neighbours within the balls."""
    entries: np.ndarray
    radii: np.ndarray | None = None

    def neighbours(self) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """For each part and entry, the squared distances to itself and its neighbours in rising order, and their numbers."""
        out = []
        for own, radii in zip(self.entries, self.radii):
            between = ((own[:, None, :] - own[None, :, :]) ** 2).sum(2)
            rows = []
            for i in range(len(own)):
                others = np.flatnonzero(between[i] <= 4 * int(radii[i]) ** 2)
                others = np.append(i, others[others != i])
                order = np.append(0, 1 + np.argsort(between[i][others[1:]], kind="stable"))
                rows.append((between[i][others[order]], others[order]))
            out.append(rows)
        return out

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every part and its squared distance; ties to the lower number."""
    code, best = np.zeros(len(parts), dtype=np.int64), ((parts - entries[0]) ** 2).sum(1)
    for number in range(1, len(entries)):
        d = ((parts - entries[number]) ** 2).sum(1)
        closer = d < best
        code[closer], best[closer] = number, d[closer]
    return code, best


def moved(parts: np.ndarray, codes: np.ndarray, entries: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """As ``nearest``, from an earlier assignment: only parts outside the stable cores meet the neighbours that their ring names."""
    own = ((parts - entries[codes]) ** 2).sum(1)
    rings = np.ones(len(parts), dtype=np.int64)
    order = np.argsort(codes, kind="stable")
    cuts = np.searchsorted(codes[order], np.arange(len(entries) + 1))
    for i in range(len(entries)):
        members = order[cuts[i]:cuts[i + 1]]
        if len(members):      # an entry at distance D can be as near as the own one, at d, only where D <= 2 d
            rings[members] = 1 + np.searchsorted(near[i][0][1:], 4 * own[members], side="right")
    outside = np.flatnonzero(rings > 1)
    code, best = codes.copy(), own
    if len(outside):
        first = np.array([0, *np.cumsum([len(n) for _, n in near])[:-1]])
        flat = np.concatenate([n for _, n in near])
        sizes = rings[outside]
        begin = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) - np.repeat(begin, sizes)
        rival = flat[np.repeat(first[codes[outside]], sizes) + place]
        d = ((np.repeat(parts[outside], sizes, axis=0) - entries[rival]) ** 2).sum(1)
        least = np.minimum.reduceat(d, begin)
        number = np.minimum.reduceat(np.where(d == np.repeat(least, sizes), rival, len(entries)), begin)
        code[outside], best[outside] = number, least
    return code, best


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """Rows of equal length as rows x parts x positions."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False)
    if len(x) and max(int(x.max()), -int(x.min())) > LARGEST:
        raise ValueError(f"components beyond {LARGEST} after scaling cannot be compared exactly")
    return x.reshape(len(column), parts, -1) if len(column) else x.reshape(0, parts, 0)


def _assign(frame: DataFrame, books: Books, vectors_stay: bool) -> DataFrame:
    """The rows with new codes and, per part, squared distances; their earlier codes are used where there are any."""
    names = [n for n in frame.columns if n not in ("codes", "distances")]
    names = names if vectors_stay else [n for n in names if n != "x"]
    later = "codes" in frame.columns
    shared = frame.sparkSession.sparkContext.broadcast((books.entries, books.neighbours() if later else None))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, near = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), len(entries))
            old = np.frombuffer(b"".join(batch.column("codes").to_pylist()), dtype=np.uint8).reshape(len(x), -1) if later else None
            codes, distances = np.empty(x.shape[:2], dtype=np.uint8), np.empty(x.shape[:2], dtype=np.int64)
            for p in range(len(entries)):
                own = np.ascontiguousarray(x[:, p])
                codes[:, p], distances[:, p] = (moved(own, old[:, p].astype(np.int64), entries[p], near[p]) if later else nearest(own, entries[p]))
            flat = pa.array(distances.ravel())
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(entries))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array([c.tobytes() for c in codes], pa.binary()), pa.ListArray.from_arrays(offsets, flat)],
                names=[*names, "codes", "distances"])

    return frame.mapInArrow(run, f"{schema}, codes binary, distances array<bigint>")


def _updated(frame: DataFrame, books: Books) -> Books:
    """Entries replaced by the floors of their parts' means, with bounds of the new radii; unused entries stay.

    A task adds up its own rows, so what is shuffled is one row per task, part and entry.
    """
    parts, size, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, far = np.zeros(parts * size, dtype=np.int64), np.zeros(parts * size, dtype=np.int64)
        sums = np.zeros((parts * size, width), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), parts)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), dtype=np.uint8).reshape(len(x), parts)
            distances = batch.column("distances").flatten().to_numpy()
            place = (codes.astype(np.int64) + np.arange(parts) * size).ravel()
            np.add.at(count, place, 1)
            np.add.at(sums, place, x.reshape(-1, width))
            np.maximum.at(far, place, distances)
        used = np.flatnonzero(count)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(used), pa.array(count[used]), pa.array(far[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))],
                names=["place", "n", "far", "sums"])

    partial = frame.select("x", "codes", "distances").mapInArrow(run, "place bigint, n bigint, far bigint, sums array<bigint>")
    total = partial.groupBy("place").agg(F.sum("n").alias("n"), F.max("far").alias("far"),
                                         *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]).collect()
    entries, radii = books.entries.copy(), np.zeros((parts, size), dtype=np.int64)
    for row in total:
        p, i = divmod(row["place"], size)
        new = np.array([row[f"s{k}"] // row["n"] for k in range(width)], dtype=np.int64)
        shift = int(((new - entries[p, i]) ** 2).sum())
        entries[p, i], radii[p, i] = new, _root(int(row["far"])) + _root(shift)
    return Books(entries, radii)


def _root(n: int) -> int:
    """The square root, rounded up."""
    return math.isqrt(n - 1) + 1 if n else 0


def _stored(frame: DataFrame, name: str) -> DataFrame:
    folder = scratch(frame.sparkSession, name)
    frame.write.parquet(folder)
    return frame.sparkSession.read.parquet(folder)


def encode(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256,
           parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Books]:
    """vec_id, label, codes (one byte per part), distances (squared, per part), one row per input row, and the codebooks.

    Components are floor(scale * x). Codebooks start as the parts of the ``entries`` rows with the smallest ids, nulls last,
    equal ids by vector; with fewer rows they have fewer entries. Components that a vector lacks against the longest,
    or against a multiple of ``parts``, count as zero. Repeated rows count each time. The vectors must be free of nulls and
    non-finite components. Every round is a written table, so a lost executor repeats part of one round only.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    spark = tune(vectors.sparkSession)
    bounded_batches(spark)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), quantised(vector).alias("x"))
    longest = vectors.agg(F.max(F.size(vector))).first()[0]
    width = max(1, math.ceil((longest or 0) / parts))
    if longest != width * parts:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(width * parts) - F.size("x"))))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    start = np.array([r["x"] for r in first], dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    books = Books(np.ascontiguousarray(start))
    if not first:
        return rows.select("vec_id", "label", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("array<bigint>").alias("distances")), books
    frame = rows
    for turn in range(rounds):
        frame = _stored(_assign(frame, books, vectors_stay=True), f"ball-codes-{turn}")
        books = _updated(frame, books)
    return _stored(_assign(frame, books, vectors_stay=False), "ball-codes"), books


def decode(codes: bytes, books: Books) -> np.ndarray:
    """The whole-number vector that a code stands for."""
    return np.concatenate([books.entries[p, c] for p, c in enumerate(codes)])


def digests(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code (two hex digits per part), error, label_error (errors of equal labels, nulls together), codebooks_sha256."""
    coded, books = encode(vectors, **options)
    rows = coded.select("vec_id", "label", F.lower(F.hex("codes")).alias("code"),
                        F.aggregate("distances", F.lit(0).cast("bigint"), lambda a, d: a + d).alias("error"))
    totals = _stored(rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label"), "ball-labels")
    few = totals.count() <= BROADCAST_LABELS          # else a shuffled join, whose hot labels adaptive execution splits
    return (rows.join(F.broadcast(totals) if few else totals, F.col("label").eqNullSafe(F.col("__label")))
            .select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")))
