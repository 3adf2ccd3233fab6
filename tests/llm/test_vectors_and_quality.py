"""Vector codes, whitening and the quality classifier against brute force, and on nulls, ties, repeats and empty tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.llm import ball_codes, quality, queries, topk, whitening
from oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<float>, label int, x array<int>, codes string, __label string"


def vector_rows(count, width, rng, spread=0.3):
    return [(int(i), [float(v) for v in rng.normal(0, spread, width)], int(rng.integers(0, 4)), [1], "c", "l") for i in range(count)]


def codes_by_force(rows, parts=16, entries=64, rounds=2):
    """rows of (id, whole numbers, label), in the order that gives the first entries."""
    width = len(rows[0][1]) // parts
    cut = [[tuple(x[p * width:(p + 1) * width]) for p in range(parts)] for _, x, _ in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), i) for i, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for i in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found) if f[p][1] == i]
                if own:
                    books[p][i] = tuple(math.floor(sum(v) / len(own)) for v in zip(*own))
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, label), e in zip(rows, errors):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], digest) for (i, _, label), f, e in zip(rows, found, errors))


def codes_of(frame, **options):
    return Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in ball_codes.digests(frame, **options).collect())


def whole(rows, scale=256):
    return [(i, [math.floor(scale * float(np.float32(v))) for v in x], label) for i, x, label, *_ in rows]


@pytest.mark.parametrize("count, options", [(300, {}), (40, {}), (1, {}), (200, {"parts": 4, "entries": 7, "rounds": 5})])
def test_ball_codes(spark, count, options):
    rows = vector_rows(count, 32, np.random.default_rng(count))
    assert codes_of(spark.createDataFrame(rows, VECTORS), **options) == codes_by_force(whole(rows), **options)


def test_ball_codes_on_ties_repeats_and_nulls(spark):
    rng = np.random.default_rng(5)
    flat = [(int(i), [float(v) / 256 for v in rng.integers(-1, 2, 16)], None if i % 3 else 1, None, None, None) for i in range(400)]
    flat += [(int(i), [0.0] * 16, 2, None, None, None) for i in range(500, 800)]          # a third of all rows is one vector
    bad = [(900, None, 1, None, None, None), (901, [float("nan")] * 16, 1, None, None, None), (902, [None] * 16, 1, None, None, None)]
    frame = spark.createDataFrame(flat + bad, VECTORS).repartition(7)
    assert codes_of(frame.filter(topk.usable("embedding"))) == codes_by_force(whole(flat))
    assert ball_codes.digests(spark.createDataFrame([], VECTORS)).count() == 0
    short = spark.createDataFrame([(1, [0.5] * 3, 1, None, None, None), (None, [0.25] * 20, 1, None, None, None), (1, [0.5] * 3, 1, None, None, None)], VECTORS)
    coded, books = ball_codes.encode(short)
    assert coded.count() == 3 and books.entries.shape == (16, 3, 2)
    one = coded.filter("vec_id = 1").first()
    assert ball_codes.decode(bytes(one["codes"]), books).tolist()[:4] == [128, 128, 128, 0]


def test_balls_skip_work_and_lose_nothing():
    rng = np.random.default_rng(2)
    parts = np.concatenate([rng.integers(-40, 40, (2000, 4)) + c for c in rng.integers(-4000, 4000, (60, 4))])
    entries = parts[rng.choice(len(parts), 64, replace=False)]
    codes, far = ball_codes.nearest(parts, entries)
    radii = np.array([ball_codes._root(int(far[codes == i].max(initial=0))) for i in range(64)])
    shifted = entries + rng.integers(-30, 30, entries.shape)
    radii = radii + [ball_codes._root(int(v)) for v in ((shifted - entries) ** 2).sum(1)]
    near = ball_codes.Books(shifted[None], radii[None]).neighbours()[0]
    assert sum(len(n) for _, n in near) < 64 * 16
    got, want = ball_codes.moved(parts, codes, shifted, near), ball_codes.nearest(parts, shifted)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def whitening_by_force(rows):
    x = [[math.floor(64 * float(np.float32(v))) + 1_000_000 for v in vector] for _, vector, *_ in rows]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(v) for v in zip(*fit)]
    centred = np.array([[n * a - s for a, s in zip(row, sums)] for row in fit], dtype=np.float64) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    own = np.array([[n * a - s for a, s in zip(row, sums)] for row in x], dtype=object)
    return n, [sum(v * v for v in row) for row in own.tolist()], own.astype(np.float64) / n, values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("count, width", [(300, 24), (12, 24), (400, 5)])
def test_whitening(spark, count, width):
    rng = np.random.default_rng(width)
    rows = [(i, (np.array(v) * (1 + np.arange(width))).tolist(), *rest) for i, v, *rest in vector_rows(count, width, rng, spread=1.0)]
    rows += [(1000 + i, rows[3][1], *rows[3][2:]) for i in range(count // 2)]              # one vector is very common
    n, deviation, centred, values, vectors = whitening_by_force(rows)
    got = {(r.vec_id, r.component): r for r in whitening.whitened(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()}
    k = min(16, width, count - 1)
    assert len(got) == len(rows) * k and n == count
    assert all(r.n == n and r.identity_error < 1e-8 and r.explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-9) for (_, c), r in got.items())
    for place, (i, *_) in enumerate(rows):
        assert all(got[i, c].deviation == deviation[place] for c in range(1, k + 1))
        mine = [got[i, c].whitened for c in range(1, k + 1)]
        want = centred[place] @ vectors[:, :k] / np.sqrt(values[:k])
        assert np.abs(mine) == pytest.approx(np.abs(want), rel=1e-6, abs=1e-6)


def test_whitening_on_odd_tables(spark):
    assert whitening.whitened(spark.createDataFrame([], VECTORS)).count() == 0
    same = spark.createDataFrame([(i, [0.5, 0.25], 1, None, None, None) for i in range(9)], VECTORS)
    assert whitening.whitened(same).count() == 0
    line = spark.createDataFrame([(None, [0.5, 0.25], None, None, None, None), (1, [1.5], None, None, None, None), (1, [1.5], None, None, None, None)], VECTORS)
    out = whitening.whitened(line).collect()
    assert len(out) == 3 and {r.component for r in out} == {1} and {round(abs(r.whitened), 9) for r in out} == {1.0}


def test_one_sided_jacobi_on_a_badly_scaled_factor():
    rng = np.random.default_rng(1)
    scale = 10.0 ** -np.arange(0, 24, 3)
    basis = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    values, vectors = whitening.one_sided_jacobi(basis * scale)
    assert values == pytest.approx(scale ** 2, rel=1e-12)
    assert np.abs(vectors.T @ basis) == pytest.approx(np.eye(8), abs=1e-12)


def features_by_force(raw, buckets=quality.BUCKETS):
    """Every feature with plain whole numbers, byte by byte."""
    full, hasher = (1 << 64) - 1, quality.Hasher(buckets)

    def mixed(h, kind):
        h = ((h ^ kind) * quality.MIX) & full
        h = ((h ^ (h >> 32)) * quality.MIX) & full
        return h >> (64 - (buckets - 1).bit_length())
    out, before = Counter(), None
    for word in raw.split():
        h = sum(b * pow(quality.STEP, k, 1 << 64) for k, b in enumerate(word)) & full
        out[mixed(h ^ len(word), 1)] += 1
        framed = b" " + word + b" "
        for n in quality.SIZES:
            for i in range(len(framed) - n + 1):
                g = 0
                for b in framed[i:i + n]:
                    g = (g * quality.STEP + b) & full
                out[mixed(g, n)] += 1
        if word == before:
            out[int(hasher.again[0])] += 1
        before = word
    out[int(hasher.end[0])] += 1
    return out


@pytest.mark.parametrize("stretch", [quality.STRETCH, 10])
def test_features_of_words_and_pieces(monkeypatch, stretch):
    monkeypatch.setattr(quality, "STRETCH", stretch)
    hasher = quality.Hasher()
    for text in ("", " ", "a", "a a  a\tb", "Ünder été 漢字 x", "of of of the\nthe end", "w" * 5000 + " tail tail", "12345 " * 900):
        want = features_by_force(text.encode())
        ids, shares = quality.unpacked(quality.packed(*hasher.counts(text.encode())))
        assert dict(zip(ids.tolist(), shares.tolist())) == pytest.approx({i: n / want.total() for i, n in want.items()}, rel=1e-6)
        values = np.arange(quality.BUCKETS, dtype=np.float64)
        assert hasher.mean(text.encode(), values) == pytest.approx(sum(i * n for i, n in want.items()) / want.total(), rel=1e-9)


def test_descent_follows_the_gradient():
    rng = np.random.default_rng(4)
    model = quality.QualityModel(rng.normal(size=(10, 3)), rng.normal(size=(3, 2)))
    ids, share = np.array([1, 4, 7]), np.array([0.5, 0.25, 0.25])

    def loss(vectors, output):
        return -math.log(quality.softmax(share @ vectors[ids] @ output)[1])
    rate, step = 1e-3, 1e-6
    after = quality.descend(model, [(ids, share)], np.array([1]), 1, (rate, rate), 0)
    for name, factor in (("vectors", 1.0), ("output", quality.OUTPUT_SHARE)):
        table = getattr(model, name)
        for place in np.ndindex(table.shape):
            moved = {n: getattr(model, n).copy() for n in ("vectors", "output")}
            moved[name][place] += step
            slope = (loss(**moved) - loss(model.vectors, model.output)) / step
            assert getattr(after, name)[place] - table[place] == pytest.approx(-rate * factor * slope, abs=1e-7)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_quality_on_held_out_rows(spark, folder):
    scored = queries.op13_quality(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    held = scored.filter("held_out").join(labels, "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in held)
    good, bad = [r for r in held if r.quality], [r for r in held if not r.quality]
    assert len(good) > 40 and len(bad) > 4
    assert sum(r.predicted for r in good) / len(good) > 0.97 and sum(1 - r.predicted for r in bad) / len(bad) > 0.9


def test_quality_on_odd_tables(spark):
    docs = "doc_id bigint, text string, label string, place double, raw string, score double"
    odd = spark.createDataFrame([(1, None, "l", 1.0, "r", 0.0), (1, "", None, None, None, None), (None, "a b", None, None, None, None),
                                 (2, "word " * 60000, None, None, None, None), (2, "word " * 60000, None, None, None, None), (3, "z" * 400000, None, None, None, None)], docs)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 1), (None, 1, 1), (3, None, 1), (77, 1, 0)], "doc_id bigint, quality int, toxic int")
    for model in (quality.train(odd, labels), quality.train(odd.filter("false"), labels), quality.train(odd, labels.filter("false"))):
        rows = quality.score(odd, model).collect()
        assert Counter(r.doc_id for r in rows) == Counter({1: 2, 2: 2, 3: 1, None: 1}) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0.5 for r in rows)
    assert quality.score(odd.filter("false"), model).count() == 0


def test_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(300)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i % 5, i % 2) for i in range(50)], "doc_id bigint, quality int")
    from gaugeframe.llm.common import labelled_sample
    got = labelled_sample(docs, labels, "doc_id", "text", "quality", 2, "quality").collect()
    assert len(got) <= 2 and all(bytes(r.raw) in {b"text 0", b"text 1", b"text 101"} for r in got)


@pytest.mark.parametrize("name", ["op11_ball_codes"])
def test_query_matches_sql(spark, name):
    _, _, same, note = compare(spark, connect(FOLDER), FOLDER, name, queries.QUERIES, queries.ORACLES)
    assert same, note
