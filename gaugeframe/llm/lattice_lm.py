"""Likelihood of texts under a subword lattice.

The pieces of an existing vocabulary, with the weights its scores imply, are the arcs of a lattice over every
word; weights are re-estimated by expected counts over all training words. The log-space
forward recursion sums over all segmentations. No piece crosses a word boundary, so the
probability of a text is the product over its words and the end, and the recursion runs once
per distinct word of a batch.

Word counts for the plain baseline are looked up in two parts: the most frequent words (a bounded
table) inside the tasks, all other words by a join.
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.common import per_batch, raw_text, words_of
from gaugeframe.runtime import cut, tune

HEAD_WORDS = 300_000
ROUNDS = 2
START = b" "
END_TOKEN = b" "
LONG_WORD = 96
NEVER = -np.inf
PRIME = np.uint64(0x100000001B3)
MIX = np.uint64(0x9E3779B97F4A7C15)


def existing_vocabulary(path: str) -> dict[bytes, float]:
    """Surface bytes and start weights (natural logs) of a sentencepiece model.

    A score that is a merge rank becomes a weight that falls with the rank; single bytes, which make
    every text reachable, get the smallest weight.
    """
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    weights: dict[bytes, float] = {bytes([b]): -math.log(2.0 * size) for b in range(256)}
    for i in range(size):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        surface = model.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in surface[1:]:
            weights[surface] = -math.log(10.0 - model.get_score(i))
    total = math.log(sum(math.exp(w) for w in weights.values()))
    return {s: w - total for s, w in weights.items()}


class Lattice:
    """Pieces by length, with vectorised forward and backward recursions over words of one length."""

    def __init__(self, surfaces: list[bytes], weights: np.ndarray):
        self.surfaces, self.weights = surfaces, np.asarray(weights, dtype=np.float64)
        self.longest = max(map(len, surfaces))
        by_length: dict[int, list[int]] = {}
        for i, s in enumerate(surfaces):
            by_length.setdefault(len(s), []).append(i)
        self.by_length = {}
        for length, members in by_length.items():
            matrix = np.frombuffer(b"".join(surfaces[i] for i in members), dtype=np.uint8).reshape(-1, length)
            h = np.zeros(len(members), dtype=np.uint64)
            for j in range(length):
                h = self._step(h, matrix[:, j])
            order = np.argsort(h)
            self.by_length[length] = (h[order], np.array(members, dtype=np.int64)[order])

    @staticmethod
    def _step(h: np.ndarray, column: np.ndarray) -> np.ndarray:
        h = (h ^ (column.astype(np.uint64) + np.uint64(1))) * PRIME
        return (h ^ (h >> np.uint64(31))) * MIX

    @cached_property
    def lookup(self) -> dict[bytes, float]:
        return dict(zip(self.surfaces, self.weights.tolist()))

    def _arcs(self, matrix: np.ndarray):
        """(length, positions with pieces, piece numbers or -1) for every piece length that fits."""
        count, size = matrix.shape
        h = np.zeros((count, size), dtype=np.uint64)
        for length in range(1, min(self.longest, size) + 1):
            h = self._step(h[:, :size - length + 1], matrix[:, length - 1:])
            if length in self.by_length:
                keys, members = self.by_length[length]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                yield length, np.where(keys[at] == h, members[at], -1)

    def _forward(self, arcs, count: int, size: int) -> np.ndarray:
        alpha = np.full((size + 1, count), NEVER)
        alpha[0] = 0.0
        for end in range(1, size + 1):
            for length, _, weight in arcs:
                if length <= end:
                    alpha[end] = np.logaddexp(alpha[end], alpha[end - length] + weight[end - length])
        return alpha

    def _weighted(self, matrix: np.ndarray):
        padded = np.append(self.weights, NEVER)
        return [(length, piece.T, padded[piece.T]) for length, piece in self._arcs(matrix)]

    def score(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the marginal probability of every word (given with its leading boundary byte)."""
        out = np.empty(len(words))
        for where, matrix in _by_length(words):
            arcs = self._weighted(matrix)
            out[where] = self._forward(arcs, *matrix.shape)[-1]
        for i in (i for i, w in enumerate(words) if len(w) > LONG_WORD):
            out[i] = self._long(words[i])
        return out

    def _long(self, word: bytes) -> float:
        """The same recursion for one long word, in memory linear in its length."""
        alpha = np.full(len(word) + 1, NEVER)
        alpha[0] = 0.0
        get = self.lookup.get
        for end in range(1, len(word) + 1):
            terms = [alpha[i] + w for i in range(max(0, end - self.longest), end) if (w := get(word[i:end])) is not None]
            top = max(terms)
            alpha[end] = top + math.log(sum(math.exp(t - top) for t in terms))
        return float(alpha[-1])

    def expect(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected uses of every piece over all segmentations, weighted by word counts.

        Long words only count their most probable boundaries implicitly through ``score``; they are cut
        into stretches of LONG_WORD bytes here, since weights need no exact boundary.
        """
        total = np.zeros(len(self.surfaces))
        pieces, times = [], []
        for word, n in zip(words, counts.tolist()):
            for start in range(0, len(word), LONG_WORD):
                pieces.append(word[start:start + LONG_WORD])
                times.append(n)
        times = np.asarray(times, dtype=np.float64)
        for where, matrix in _by_length(pieces):
            count, size = matrix.shape
            arcs = self._weighted(matrix)
            alpha = self._forward(arcs, count, size)
            beta = np.full((size + 1, count), NEVER)
            beta[size] = 0.0
            for start in range(size - 1, -1, -1):
                for length, _, weight in arcs:
                    if start + length <= size:
                        beta[start] = np.logaddexp(beta[start], beta[start + length] + weight[start])
            for length, piece, weight in arcs:
                found = piece >= 0
                share = np.exp(alpha[:size - length + 1] + weight + beta[length:] - alpha[size]) * times[where]
                total += np.bincount(piece[found], weights=share[found], minlength=len(total))
        return total


def _by_length(words: list[bytes], rows: int = 8192):
    """(positions, byte matrix) of words of one length, in blocks of bounded size; longer words are left out."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(lengths, kind="stable")
    order = order[(lengths[order] > 0) & (lengths[order] <= LONG_WORD)]
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts):
        for start in range(0, len(group), rows):
            where = group[start:start + rows]
            yield where, np.frombuffer(b"".join(words[i] for i in where), dtype=np.uint8).reshape(len(where), -1)


def word_counts(texts: DataFrame) -> DataFrame:
    """word, c over the column ``raw``; the end of every text counts under a key no word can have."""
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: dict[bytes, int] = {}
            for raw in batch.column(0).to_pylist():
                for w in words_of(raw):
                    counts[w] = counts.get(w, 0) + 1
            counts[END_TOKEN] = batch.num_rows
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                              names=["word", "c"])
        return work

    return per_batch(texts.select("raw"), make, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def train(counts: DataFrame, vocabulary: dict[bytes, float], rounds: int = ROUNDS) -> tuple[list[bytes], np.ndarray, float]:
    """Surfaces, natural log weights and the weight of the end, from word counts; weights and end add up to one.

    The driver receives one number per piece of the vocabulary and round.
    """
    surfaces = list(vocabulary)
    weights = np.array([vocabulary[s] for s in surfaces])
    first = counts.agg(F.sum(F.when(F.col("word") == F.lit(END_TOKEN), F.col("c"))).alias("ends")).first()
    ends = float(first["ends"] or 0)
    end = math.log(0.5)
    for _ in range(rounds):
        given = weights

        def make(given=given):
            lattice = Lattice(surfaces, given)

            def work(batch: pa.RecordBatch) -> pa.RecordBatch:
                words = [START + w for w in batch.column(0).to_pylist()]
                uses = lattice.expect(words, batch.column(1).to_numpy(zero_copy_only=False))
                used = np.flatnonzero(uses)
                return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(uses[used], pa.float64())], names=["piece", "uses"])
            return work

        seen = (per_batch(counts.filter(F.col("word") != F.lit(END_TOKEN)), make, "piece bigint, uses double")
                .groupBy("piece").agg(F.sum("uses").alias("uses")).collect())
        uses = np.full(len(surfaces), 0.1)
        for row in seen:
            uses[row["piece"]] += row["uses"]
        total = uses.sum() + ends + 1.0
        weights, end = np.log(uses / total), math.log((ends + 1.0) / total)
    return surfaces, weights, end


def lattice_scores(docs: DataFrame, vocabulary: str, held_out: Column, doc_id: str = "doc_id", text: str = "text",
                   rounds: int = ROUNDS, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row per input row.

    The model learns from rows whose ``held_out`` is false (null counts as false). Tokens are the words and one end; a
    null or empty text is the end alone. ``base_score`` is the add-one word baseline, ``score`` the
    marginal log10 probability of the text under the lattice. With no training rows the start weights score.
    Long words score exactly; rows are never merged, whatever ids repeat. ``head_words`` bounds the table held in tasks.
    """
    spark = tune(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), raw_text(text).alias("raw"))
    counts = cut(word_counts(rows.filter(~F.col("held_out"))))
    sizes = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(sizes["n"] or 0), int(sizes["v"])
    surfaces, weights, end = train(counts, existing_vocabulary(vocabulary), rounds if n else 0)
    top = counts.orderBy(F.col("c").desc(), "word").limit(head_words)
    head = spark.sparkContext.broadcast({bytes(r["word"]): r["c"] for r in top.toLocalIterator()})
    end_known = END_TOKEN in head.value
    kind = docs.schema[doc_id].dataType.simpleString()

    def make():
        lattice, common = Lattice(surfaces, weights), head.value
        memo: dict[bytes, float] = {}

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            index: dict[bytes, int] = {}
            sizes, ids = [], []
            for raw in batch.column(2).to_pylist():
                tokens = words_of(raw)
                sizes.append(len(tokens))
                ids.append(np.fromiter((index.setdefault(t, len(index)) for t in tokens), dtype=np.int64, count=len(tokens)))
            distinct = list(index)
            scores = np.empty(len(distinct))
            new = [i for i, w in enumerate(distinct) if w not in memo]
            for i, w in enumerate(distinct):
                scores[i] = memo.get(w, 0.0)
            scores[new] = lattice.score([START + distinct[i] for i in new])
            for i in new:
                if len(memo) >= 300_000:
                    break
                if len(distinct[i]) < 32:
                    memo[distinct[i]] = scores[i]
            c = np.array([common.get(w, 0) for w in distinct], dtype=np.float64)
            logs, known = np.log10(c + 1.0), c > 0
            score = [scores[i].sum() for i in ids]
            base = [logs[i].sum() for i in ids]
            found = [int(known[i].sum()) for i in ids]
            tails = []
            for i in ids:
                rare, times = np.unique(i[~known[i]], return_counts=True)
                tails.append([{"word": distinct[j], "times": t} for j, t in zip(rare.tolist(), times.tolist())])
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(found, pa.int64()),
                       pa.array(base, pa.float64()), pa.array(score, pa.float64()),
                       pa.array(tails, pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())])))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "words", "found", "base", "score", "tail"])
        return work

    scored = per_batch(rows, make, f"doc_id {kind}, held_out boolean, words bigint, found bigint, base double, score double, "
                                   "tail array<struct<word:binary,times:bigint>>")
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()))
    tail = scored.select("row", F.explode("tail").alias("t")).select("row", F.col("t.word").alias("word"), F.col("t.times").alias("times"))
    rare = (tail.join(counts, "word").groupBy("row")
            .agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more_base"), F.sum("times").alias("more_found")))
    tokens = F.col("words") + 1
    end_count = float(head.value.get(END_TOKEN, 0))
    base = (F.col("base") + F.coalesce("more_base", F.lit(0.0)) + F.lit(math.log10(end_count + 1.0))
            - tokens * F.lit(math.log10(n + v + 1)))
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", tokens.alias("n_tokens"),
        (F.col("found") + F.coalesce("more_found", F.lit(0)) + F.lit(int(end_known))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"), base.alias("base_score"),
        ((F.col("score") + F.lit(end)) / F.lit(math.log(10.0))).alias("score"))
