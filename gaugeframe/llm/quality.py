"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors of its features: hashed words, hashed n-grams of the UTF-8 bytes of a word
between its blanks, a mark for every word that repeats its predecessor, and one end mark. A softmax over two
classes reads the average. Vectors and output weights are trained by stochastic gradient descent in numpy on a
bounded sample of labelled rows (``sample_rows``), dealt into shards: every round each shard runs from the shared
weights and Spark averages what they reach. Every document is scored on its whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.common import bounded_batches, labelled_sample, per_batch, raw_text
from gaugeframe.runtime import cut, tune

SAMPLE_ROWS = 6_000
SHARD_ROWS = 2_000
BUCKETS = 1 << 16          # a power of two; feature numbers are stored in two bytes
WIDTH = 8
SIZES = (3, 4, 5)
ROUNDS = 5
EPOCHS = 2
RATE = 15.0
OUTPUT_SHARE = 0.1         # the output layer moves at this part of the rate
STRETCH = 1 << 18          # bytes of a text that are hashed at once; cut at blanks only
CUT = re.compile(rb"[\x20\x09-\x0d]")

# Multipliers of the hashes: odd, with well mixed bits.
STEP, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
INVERSE = pow(STEP, -1, 1 << 64)
MARK_END, MARK_AGAIN = 1, 2


def _mixed(hashes: np.ndarray, kind: int, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (hashes ^ np.uint64(kind)) * np.uint64(MIX)
        h ^= h >> np.uint64(32)
        h *= np.uint64(MIX)
    return (h >> np.uint64(64 - (buckets - 1).bit_length())).astype(np.uint32)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Hasher:
    """Feature numbers of stretches of text; the powers it keeps are no longer than the longest stretch."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self.up, self.down = _powers(STEP, 4096), _powers(INVERSE, 4096)
        marks = _mixed(np.array([MARK_END, MARK_AGAIN], dtype=np.uint64), 99, buckets)
        self.end, self.again = marks[:1], marks[1:]

    def stretch(self, raw: bytes, before: int | None = None) -> tuple[np.ndarray, int | None]:
        """Features of the words of a stretch, and the hash of its last word; ``before`` is that of the word before."""
        b = np.frombuffer(b" " + raw + b" ", dtype=np.uint8)
        blank = (b == 32) | ((b >= 9) & (b <= 13))
        starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        if not len(starts):
            return np.empty(0, dtype=np.uint32), before
        ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        code = np.where(blank, 32, b).astype(np.uint64)
        if len(b) > len(self.up):
            self.up, self.down = _powers(STEP, 2 * len(b)), _powers(INVERSE, 2 * len(b))
        seen = np.concatenate([[0], np.cumsum(blank)])
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * self.up[:len(b)], dtype=np.uint64)])
            words = (sums[ends] - sums[starts]) * self.down[starts] ^ (ends - starts).astype(np.uint64)
            out = [_mixed(words, 1, self.buckets)]
            h = code[:-1] * np.uint64(STEP) + code[1:]
            for n in range(3, max(SIZES) + 1):
                h = h[:-1] * np.uint64(STEP) + code[n - 1:]
                if n in SIZES:
                    inside = seen[n - 1:len(seen) - 1][:len(h)] - seen[1:1 + len(h)]
                    out.append(_mixed(h[inside == 0], n, self.buckets))
        last = np.concatenate([[words[0] if before is None else np.uint64(before)], words[:-1]])
        same = words == last
        if before is None:
            same[0] = False
        out.append(np.repeat(self.again, int(same.sum())))
        return np.concatenate(out), int(words[-1])

    def features(self, raw: bytes) -> Iterator[np.ndarray]:
        """The features of a whole text, a stretch at a time, with the end mark last."""
        at, before = 0, None
        while at < len(raw):
            blank = CUT.search(raw, at + STRETCH)          # a longer word makes a longer stretch
            to = blank.end() if blank else len(raw)
            found, before = self.stretch(raw[at:to], before)
            yield found
            at = to
        yield self.end

    def counts(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Distinct feature numbers of a text, rising, and how often it has them."""
        total = np.zeros(self.buckets, dtype=np.int64)
        for part in self.features(raw):
            total += np.bincount(part, minlength=self.buckets)
        there = np.flatnonzero(total)
        return there, total[there]

    def mean(self, raw: bytes, values: np.ndarray) -> float:
        """The mean over all features of a text of one value per feature."""
        total, n = 0.0, 0
        for part in self.features(raw):
            total += float(values[part].sum())
            n += len(part)
        return total / n


@dataclass
class QualityModel:
    vectors: np.ndarray        # buckets x width
    output: np.ndarray         # width x 2

    def margins(self) -> np.ndarray:
        """What each feature adds to the log odds of class 1: averaging and the output layer are linear."""
        return self.vectors @ (self.output[:, 1] - self.output[:, 0])


def first_model() -> QualityModel:
    """Small random vectors and an output layer of zeros."""
    return QualityModel(np.random.default_rng(7).uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)), np.zeros((WIDTH, 2)))


def descend(model: QualityModel, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int, rates: tuple[float, float],
            seed: int) -> QualityModel:
    """Stochastic gradient descent, one text at a time in seeded order; the rate falls linearly over the call."""
    vectors, output = model.vectors.copy(), model.output.copy()
    rng, done, steps = np.random.default_rng(seed), 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, share = rows[i]
            rate = rates[0] + (rates[1] - rates[0]) * done / steps
            done += 1
            own = vectors[ids]
            hidden = share @ own
            slope = softmax(hidden @ output)
            slope[labels[i]] -= 1.0
            vectors[ids] = own - (rate * share)[:, None] * (output @ slope)[None, :]
            output -= rate * OUTPUT_SHARE * np.outer(hidden, slope)
    return QualityModel(vectors, output)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max())
    return p / p.sum()


def packed(numbers: np.ndarray, counts: np.ndarray) -> bytes:
    return zlib.compress(np.diff(numbers, prepend=0).astype("<u2").tobytes() + counts.astype("<u8").tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their shares of all features."""
    raw = zlib.decompress(data)
    n = len(raw) // 10
    counts = np.frombuffer(raw, dtype="<u8", offset=2 * n)
    return np.frombuffer(raw, dtype="<u2", count=n).astype(np.int64).cumsum(), counts / counts.sum()


def _shard_moves(shared, epochs: int, rates: tuple[float, float], turn: int, axes: list[str]):
    """What each shard of a partition adds to the shared weights, as rows of moved vectors.

    The output layer counts as two more vectors; a last one counts the shards.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, list] = {}
        for batch in batches:
            for shard, place, label, features in zip(*[c.to_pylist() for c in batch.columns]):
                shards.setdefault(shard, []).append((place, label, features))
        for shard, found in sorted(shards.items()):
            found.sort()
            start = QualityModel(*shared.value)
            end = descend(start, [unpacked(f) for _, _, f in found], np.array([label for _, label, _ in found]), epochs, rates, 1000 * turn + shard)
            moves = np.concatenate([end.vectors - start.vectors, (end.output - start.output).T, np.ones((1, WIDTH))])
            moved = np.flatnonzero(moves.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(moved.astype(np.int32)), *[pa.array(moves[moved, a]) for a in range(WIDTH)]], names=["bucket", *axes])

    return run


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS, epochs: int = EPOCHS, rate: float = RATE) -> QualityModel:
    """The model of a bounded sample of the labelled texts, drawn by a hash of the id.

    Null ids and null labels are left out; of several labels of an id the largest counts, of several texts the smallest.
    Per round the driver receives the summed moves of at most ``BUCKETS`` vectors. Without labelled texts every text scores one half.
    """
    spark = tune(docs.sparkSession)
    bounded_batches(spark)
    shards = max(1, -(-min(sample_rows, labels.count()) // SHARD_ROWS))
    texts = (labelled_sample(docs, labels, doc_id, text, label, sample_rows, "quality")
             .withColumn("shard", F.least(F.floor(F.col("place") * shards), F.lit(shards - 1)).cast("int")).repartition(shards, "shard"))

    def make_rows():
        hasher = Hasher()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("place"), pa.array([int(v > 0) for v in batch.column("label").to_pylist()], pa.int32()),
                 pa.array([packed(*hasher.counts(raw.as_py())) for raw in batch.column("raw")], pa.binary())],
                names=["shard", "place", "label", "features"])
        return work

    sampled = cut(per_batch(texts.select("shard", "place", "label", "raw"), make_rows, "shard int, place double, label int, features binary"))
    model = first_model()
    axes = [f"d{i}" for i in range(WIDTH)]
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((model.vectors, model.output))
        rates = (rate * (1 - turn / rounds), rate * (1 - (turn + 1) / rounds))
        schema = "bucket int, " + ", ".join(f"{a} double" for a in axes)
        total = sampled.mapInArrow(_shard_moves(shared, epochs, rates, turn, axes), schema).groupBy("bucket").agg(*[F.sum(a).alias(a) for a in axes]).toArrow()
        moves = np.zeros((BUCKETS + 3, WIDTH))
        moves[total["bucket"].to_numpy()] = np.column_stack([total[a].to_numpy() for a in axes])
        moves /= max(1.0, moves[-1, 0])
        model = QualityModel(model.vectors + moves[:BUCKETS], model.output + moves[BUCKETS:-1].T)
        shared.unpersist()
    return model


def score(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score (probability of class 1), predicted (1 where the score reaches the threshold), one row per input row.

    A null text is empty and has the end mark only. Repeated ids are separate rows; other columns are ignored.
    """
    spark = tune(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    margins = spark.sparkContext.broadcast(model.margins())

    def make():
        hasher = Hasher()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            odds = np.array([hasher.mean(raw, margins.value) for raw in batch.column(1).to_pylist()])
            scores = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])
        return work

    return per_batch(docs.select(F.col(doc_id).alias("doc_id"), raw_text(text).alias("raw")), make,
                     f"doc_id {kind}, score double, predicted int")
