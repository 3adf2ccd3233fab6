"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades are 0 (not toxic), 1 (mild) and 2 (severe). The labels only say toxic or not; among toxic training texts
the grade is 2 where the share of associated words, weighted by their association, is above the median of the toxic ones. One weight
vector serves all thresholds: P(grade >= k) = sigmoid(w.x - threshold_k). The classifier is fitted on a bounded
sample of labelled rows (``sample_rows``); every document is scored on its whole text.

A text is toxic where P(grade >= 1) reaches a cut-off. Two halves of the sample are scored by models of the other half, features
included, and the cut-off is where the share of toxic texts found less four times the share of clean texts hit is largest, with
at most ``FALSE_ALARMS`` of the clean ones hit.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.common import bounded_batches, labelled_sample, per_batch, raw_text
from gaugeframe.runtime import cut, tune

SAMPLE_ROWS = 20_000
FEATURES = 1024            # of the words in two texts or more, those most associated with the label; the ridge shrinks weak ones
RIDGE = 1e-4
FALSE_ALARMS = 0.02
ALARM_WEIGHT = 4.0
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5)
GRADES = 3


def features(text: str) -> tuple[Counter, int]:
    """Counts of lower-case words and of the heads of longer words, and the number of words."""
    words = Counter(WORD.findall(text.lower()))
    out = Counter(words)
    for word, n in words.items():
        for size in PREFIXES:
            if len(word) > size:
                out[f"{word[:size]}~"] += n
    return out, words.total()


def unit_of(size: int) -> float:
    """What one occurrence counts in a text of ``size`` words: between a count, which long texts reach by chance, and a share."""
    return 2 / math.sqrt(size + 20)


@dataclass
class OrdinalModel:
    names: list[str]
    weights: np.ndarray
    thresholds: np.ndarray
    cutoff: float = 0.5

    def margin(self, text: str, table: dict[str, float]) -> float:
        """w.x of one text; ``table`` is ``self.table()``."""
        found, size = features(text)
        return sum(table[f] * n for f, n in found.items() if f in table) * unit_of(size)

    def table(self) -> dict[str, float]:
        return dict(zip(self.names, self.weights.tolist()))

    def at_least(self, margins: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. GRADES - 1, one column each."""
        return _sigmoid(margins[:, None] - self.thresholds[None, :])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, size: int,
                steps: int = 300, rate: float = 0.1, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by full-batch Adam on the cumulative-link likelihood of sparse rows."""
    n = max(1, len(grades))
    gaps = GRADES - 1
    share = [np.clip((grades >= k).mean() if len(grades) else 0.0, 1e-3, 1 - 1e-3) for k in range(1, GRADES)]
    start = np.sort([-math.log(s / (1 - s)) for s in share])
    theta = np.concatenate([np.zeros(size), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    first, second = np.zeros_like(theta), np.zeros_like(theta)

    def cuts(theta):
        return np.cumsum(np.concatenate([[theta[size]], np.exp(theta[size + 1:])]))

    for step in range(1, steps + 1):
        b = cuts(theta)
        z = np.bincount(rows, weights=values * theta[columns], minlength=len(grades)) if len(rows) else np.zeros(len(grades))
        upper = np.append(b, np.inf)[grades]
        lower = np.concatenate([[-np.inf], b])[grades]
        hi = np.where(np.isinf(upper), 1.0, _sigmoid(upper - z))
        lo = np.where(np.isinf(lower), 0.0, _sigmoid(lower - z))
        p = np.maximum(hi - lo, 1e-12)
        slope_hi, slope_lo = hi * (1 - hi), lo * (1 - lo)
        dz = (slope_hi - slope_lo) / p
        gradient = np.zeros_like(theta)
        gradient[:size] = np.bincount(columns, weights=values * dz[rows], minlength=size)[:size] / n if len(rows) else 0.0
        gradient[:size] += ridge * theta[:size]
        db = np.array([(-(slope_hi / p)[grades == k].sum() + (slope_lo / p)[grades == k + 1].sum()) / n for k in range(gaps)])
        gradient[size] = db.sum()
        for k in range(1, gaps):
            gradient[size + k] = db[k:].sum() * math.exp(theta[size + k])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient ** 2
        theta -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        theta[size + 1:] = np.clip(theta[size + 1:], -6, 4)
    return theta[:size], cuts(theta)


def _association(bad, good, in_bad, in_good):
    """The signed root of the likelihood ratio of a word's presence in toxic and clean texts."""
    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    n, there = bad + good, in_bad + in_good
    ratio = (part(in_bad, bad * there / n) + part(in_good, good * there / n)
             + part(bad - in_bad, bad * (n - there) / n) + part(good - in_good, good * (n - there) / n))
    return F.signum(in_bad / bad - in_good / good) * F.sqrt(F.greatest(2 * ratio, F.lit(0.0)))


def _fitted(rows, toxic: np.ndarray, words: list[tuple[str, float]]) -> OrdinalModel:
    """A model of the given sample rows (names, times, size in words) on the given words with their association."""
    place = {w: i for i, (w, _) in enumerate(words)}
    pull = np.array([max(0.0, g) for _, g in words])
    found = [[(place[w], t) for w, t in zip(r["names"], r["times"]) if w in place] for r in rows]
    density = np.array([sum(pull[c] * t for c, t in f) / max(1, r["size"]) for f, r in zip(found, rows)])
    grades = np.where(toxic, np.where(density > np.median(density[toxic]), 2, 1), 0)
    lines = np.repeat(np.arange(len(rows)), [len(f) for f in found])
    columns = np.array([c for f in found for c, _ in f], dtype=np.int64)
    scale = np.array([abs(g) for _, g in words])
    scale /= max(scale.max(), 1e-9)          # so the ridge shrinks a word the more, the weaker its association
    values = np.array([t * unit_of(r["size"]) for f, r in zip(found, rows) for _, t in f]) * scale[columns]
    weights, thresholds = fit_ordinal(lines, columns, values, grades, len(words), ridge=RIDGE)
    return OrdinalModel([w for w, _ in words], weights * scale, thresholds)


def choose_cutoff(toxic: np.ndarray, scores: np.ndarray) -> float:
    """The cut-off, half the way between two scores, by ``ALARM_WEIGHT`` and ``FALSE_ALARMS``; ties go to the highest."""
    levels, place = np.unique(scores, return_inverse=True)
    caught = np.bincount(place, weights=toxic, minlength=len(levels))[::-1].cumsum()[::-1] / max(1, toxic.sum())
    alarms = np.bincount(place, weights=~toxic, minlength=len(levels))[::-1].cumsum()[::-1] / max(1, (~toxic).sum())
    worth = np.where(alarms <= FALSE_ALARMS, caught - ALARM_WEIGHT * alarms, -np.inf)
    best = len(levels) - 1 - int(worth[::-1].argmax())
    if toxic.all() or not worth[best] > 0:
        return 1.0 + levels[-1]          # no clean text to go by, or no cut-off worth its alarms: nothing is rejected
    return float(levels[best] if best == 0 else (levels[best] + levels[best - 1]) / 2)


NOTHING = OrdinalModel([], np.zeros(0), np.array([50.0, 51.0]))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
          sample_rows: int = SAMPLE_ROWS, size: int = FEATURES) -> OrdinalModel:
    """The model of a bounded sample of the labelled texts, drawn by a hash of the id; equal texts count once.

    The driver receives at most three times ``size`` words and their counts in the texts of the sample. Labels that are null, or
    whose ids are, are left out; of several labels of an id or a text the largest counts. With fewer than two toxic or two clean
    texts, or no word in two texts, the model has no features and rejects nothing; nor does it where no cut-off is worth its alarms.
    """
    tune(docs.sparkSession)
    texts = labelled_sample(docs, labels, doc_id, text, toxic, sample_rows, "toxicity")
    texts = texts.groupBy(F.sha2("raw", 256).alias("digest")).agg(F.max("label").alias("label"), F.min("place").alias("place"), F.first("raw").alias("raw"))

    def make_rows():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, times, lengths, sizes = [], [], [], []
            for raw in batch.column("raw"):
                counts, size = features(raw.as_py().decode("utf-8", "replace"))
                names.append(pa.array(counts, pa.string()))
                times.append(pa.array(counts.values(), pa.int32()))
                lengths.append(len(counts))
                sizes.append(size)
            ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            return pa.RecordBatch.from_arrays(
                [pa.array([v > 0 for v in batch.column("label").to_pylist()]), pa.array([p >= 0.5 for p in batch.column("place").to_pylist()]),
                 pa.ListArray.from_arrays(ends, pa.concat_arrays(names)), pa.ListArray.from_arrays(ends, pa.concat_arrays(times)),
                 pa.array(sizes, pa.int64())], names=["toxic", "half", "names", "times", "size"])
        return work

    kinds = "toxic boolean, half boolean, names array<string>, times array<int>, size bigint"
    sampled = cut(per_batch(texts.select("label", "place", "raw"), make_rows, kinds))
    total = {(r["toxic"], r["half"]): r["count"] for r in sampled.groupBy("toxic", "half").count().collect()}
    tally = {(t, h): F.count_if((F.col("toxic") == t) & (F.col("half") == h)) for t in (True, False) for h in (True, False)}
    seen = cut(sampled.select("toxic", "half", F.explode("names").alias("name")).groupBy("name")
               .agg(*[c.alias(f"{'bad' if t else 'good'}{int(h)}") for (t, h), c in tally.items()])
               .filter(F.col("bad0") + F.col("bad1") + F.col("good0") + F.col("good1") >= 2))

    def words(halves: tuple[bool, ...]) -> list[tuple[str, float]]:
        bad, good = (sum(total.get((t, h), 0) for h in halves) for t in (True, False))
        if not bad or not good:
            return []
        in_bad, in_good = (sum((F.col(f"{kind}{int(h)}") for h in halves), F.lit(0.0)) for kind in ("bad", "good"))
        rated = seen.filter(in_bad + in_good >= 2).select("name", _association(bad, good, in_bad, in_good).alias("pull"))
        return [(r["name"], r["pull"]) for r in rated.orderBy(F.abs("pull").desc(), "name").limit(size).collect()]

    whole, parts = words((True, False)), {h: words((h,)) for h in (True, False)}
    if not whole or min(sum(total.get((t, h), 0) for h in (True, False)) for t in (True, False)) < 2:
        return NOTHING
    wanted = sampled.sparkSession.sparkContext.broadcast({w for some in (whole, *parts.values()) for w, _ in some})

    def make_sparse():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, times = [], []
            for one, many in zip(batch.column("names"), batch.column("times")):
                kept = [(w, t) for w, t in zip(one.as_py(), many.as_py()) if w in wanted.value]
                names.append([w for w, _ in kept])
                times.append([t for _, t in kept])
            return pa.RecordBatch.from_arrays(
                [batch.column("toxic"), batch.column("half"), pa.array(names, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32())),
                 batch.column("size")], names=["toxic", "half", "names", "times", "size"])
        return work

    rows = per_batch(sampled, make_sparse, kinds).collect()
    toxic_rows, half = np.array([r["toxic"] for r in rows]), np.array([r["half"] for r in rows])
    model = _fitted(rows, toxic_rows, whole)
    truth, scores = [], []
    for h, some in parts.items():
        own = half == h
        if some and toxic_rows[own].any():
            trial = _fitted([r for r, o in zip(rows, own) if o], toxic_rows[own], some)
            table = trial.table()
            other = [sum(table[w] * t for w, t in zip(r["names"], r["times"]) if w in table) * unit_of(r["size"]) for r, o in zip(rows, own) if not o]
            truth.append(toxic_rows[~own])
            scores.append(trial.at_least(np.array(other))[:, 0])
    if truth and np.concatenate(truth).any():
        model.cutoff = choose_cutoff(np.concatenate(truth), np.concatenate(scores))
    return model


def grade(docs: DataFrame, model: OrdinalModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, severity (expected grade), p_toxic, grade (most probable), toxic, kept, one row per input row.

    A text is toxic where P(grade >= 1) reaches the model's cut-off; a null text is empty and has no features. Repeated ids are
    separate rows; other columns are ignored.
    """
    tune(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def make():
        table = model.table()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            margins = np.array([model.margin(raw.as_py().decode("utf-8", "replace"), table) for raw in batch.column(1)])
            above = model.at_least(margins)
            shares = np.column_stack([1 - above[:, 0], above[:, :-1] - above[:, 1:], above[:, -1]])
            toxic = above[:, 0] >= model.cutoff
            columns = [pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(shares.argmax(axis=1).astype(np.int32)),
                       pa.array(toxic), pa.array(~toxic)]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "severity", "p_toxic", "grade", "toxic", "kept"])
        return work

    return per_batch(docs.select(F.col(doc_id).alias("doc_id"), raw_text(text).alias("raw")), make,
                     f"doc_id {kind}, severity double, p_toxic double, grade int, toxic boolean, kept boolean")


def reject(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that the trained model does not call toxic; columns, repeated rows and rows with null ids or texts stay.

    The decision depends on the text alone, so it is made where the row is read and nothing is shuffled.
    """
    model = train(docs, labels, doc_id, text, **options)
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def clean(raw):
        table = model.table()
        margins = np.array([model.margin(bytes(r).decode("utf-8", "replace"), table) for r in raw])
        return pd.Series(model.at_least(margins)[:, 0] < model.cutoff)

    return docs.filter(clean(raw_text(text)))
