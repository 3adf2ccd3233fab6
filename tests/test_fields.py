import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import grids, vectors
from gaugeframe.operators.batch_scoring import score_batch
from gaugeframe.streaming import decisions


def table(spark, m, start=0):
    return spark.createDataFrame([(start + i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<float>")


@pytest.fixture(scope="module")
def bank():
    return np.random.default_rng(0).normal(size=(31, 12)).astype(np.float32)


@pytest.mark.parametrize("block", [8192, 50, 7])
def test_knn_equals_direct_distances(spark, bank, block):
    queries = np.random.default_rng(1).normal(size=(300, 12)).astype(np.float32)
    got = vectors.knn_exact(table(spark, queries), table(spark, bank), 3, block=block).collect()
    d = ((queries[:, None].astype(float) - bank[None]) ** 2).sum(2)
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert len(got) == 900
    for r in got:
        assert r["neighbour_id"] == want[r["query_id"], r["rank"] - 1]
        assert r["distance"] == pytest.approx(d[r["query_id"], r["neighbour_id"]], rel=1e-12)


def test_knn_bank_of_copies_and_small_bank(spark, bank):
    copies = np.repeat(bank[:1], 40, axis=0)
    got = sorted((r["query_id"], r["rank"], r["neighbour_id"], r["distance"]) for r in vectors.knn_exact(table(spark, bank[:2]), table(spark, copies), 3, block=9).collect())
    assert [g[2] for g in got] == [0, 1, 2, 0, 1, 2] and got[0][3] == 0
    with pytest.raises(ValueError):
        vectors.knn_exact(table(spark, bank), table(spark, bank), 32)


@pytest.mark.parametrize("level", [1.0, 1e3, 1e4, 1e5])
def test_knn_far_from_the_origin(spark, level):
    rng = np.random.default_rng(6)
    m, q = level + rng.normal(0, 1e-3, (300, 64)), level + rng.normal(0, 1e-3, (100, 64))
    frame = lambda a: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["neighbour_id"] for r in vectors.knn_exact(frame(q), frame(m), 3, block=64).collect()}
    for i, v in enumerate(q):
        want = np.lexsort((np.arange(300), ((v - m) ** 2).sum(1)))[:3]
        assert [got[i, r] for r in (1, 2, 3)] == want.tolist()


def test_approximate_search(spark, bank):
    q, b = table(spark, bank[:10] + .01), table(spark, bank)
    exact = sorted(map(tuple, vectors.knn_exact(q, b, 3).collect()))
    assert sorted(map(tuple, vectors.knn_approx(q, b, 3, probes=99).collect())) == exact      # every cell probed
    some = {tuple(r)[:1] + (r["neighbour_id"],) for r in vectors.knn_approx(q, b, 1, probes=2).collect()}
    assert len(some & {(r[0], r[1]) for r in exact if r[3] == 1}) >= 9


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_approximate_search_recall(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    bank, queries = rows.filter("label < 5"), rows.filter("label >= 5")
    b, q = ([(r.vec_id, np.array(r.embedding, dtype=float)) for r in t.collect()] for t in (bank, queries))
    ids, matrix = np.array([i for i, _ in b]), np.stack([v for _, v in b])
    true = {i: set(ids[np.lexsort((ids, ((matrix - v) ** 2).sum(1)))[:3]].tolist()) for i, v in q}
    got = vectors.knn_approx(queries, bank, 3).collect()
    found = {i: [r for r in got if r["query_id"] == i] for i in true}
    assert all(sorted(r["rank"] for r in rs) == [1, 2, 3] for rs in found.values())
    assert sum(len({r["neighbour_id"] for r in rs} & true[i]) for i, rs in found.items()) / (3 * len(true)) >= 0.9


def test_approximate_search_always_returns_k(spark):
    rng = np.random.default_rng(3)
    m = np.concatenate([rng.normal(size=(3, 8)) + 100 * c for c in range(20)] + [np.zeros((60, 8))]).astype(np.float32)
    q, b = table(spark, m[::7] + 1), table(spark, m)
    index = vectors.build_index(b, cells=25)
    assert "vector" not in index.codes.columns and index.counts.sum() == len(m)
    got = vectors.knn_approx(q, index, 9, probes=1, keep=9).collect()
    assert len(got) == 9 * len(m[::7])
    with pytest.raises(ValueError):
        vectors.knn_approx(q, index, len(m) + 1, probes=1)


def brute_coreset(m, count, anchor):
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    value, picks = anchor(d), []
    for _ in range(count):
        best = int(np.argmax(value))
        picks.append(best)
        value = np.minimum(value, d[:, best])
    return picks


@pytest.mark.parametrize("pool", [1, 4, 256])
def test_coreset_is_the_exact_greedy(spark, pool):
    m = np.random.default_rng(7).normal(size=(60, 5)).astype(np.float32)
    got = vectors.farthest_point_coreset(table(spark, m), .3, pool=pool, cut_every=3).orderBy("pick").collect()
    assert [r["id"] for r in got] == brute_coreset(m.astype(float), 18, lambda d: np.linalg.norm(d, axis=1))


def test_approximate_coreset_covers(spark):
    m = np.random.default_rng(8).normal(size=(60, 5)).astype(np.float32)
    df = table(spark, m)
    exact, approximate = (vectors.farthest_point_coreset(df, .3, anchor=a) for a in ("exact", "approximate"))
    radii = [vectors.coverage_radius(df, c).first()["radius"] for c in (exact, approximate)]
    assert approximate.select("id").distinct().count() == 18 and radii[1] < 1.5 * radii[0]
    assert vectors.farthest_point_coreset(df, 1).select("id").distinct().count() == 60


def test_projection(spark, bank):
    out = table(spark, bank).select("vec_id", vectors.random_projection(F.col("embedding"), 12, 128, 3).alias("p")).collect()
    want = bank.astype(float) @ vectors.projection_weights(12, 128, 3).T
    assert all(np.allclose(r["p"], want[r["vec_id"]]) for r in out)
    same = table(spark, bank).select(vectors.random_projection(F.col("embedding"), 12, 12).alias("p")).first()["p"]
    assert np.allclose(same, bank[0])


def grid(spark, arrays, name="flag", kind="int"):
    rows = [(i, y, x, a[y, x].item()) for i, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, f"image int, y int, x int, {name} {kind}")


def extreme(a, radius, f):
    h, w = a.shape
    return np.array([[f(a[max(0, y - radius):y + radius + 1, max(0, x - radius):x + radius + 1]) for x in range(w)] for y in range(h)])


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_opening(spark, radius):
    rng = np.random.default_rng(radius)
    masks = [(rng.random((9, 13)) < .85).astype(int) for _ in range(3)]
    out = grids.morphology_open(grid(spark, masks), radius=radius).collect()
    eroded = [extreme(m, radius, np.min) for m in masks]
    opened = [extreme(e, radius, np.max) for e in eroded]
    assert all(r["eroded"] == eroded[r["image"]][r["y"], r["x"]] and r["opened"] == opened[r["image"]][r["y"], r["x"]] for r in out)
    wide = grids.dilate(grid(spark, masks), "flag", "wide", radius).collect()
    assert all(r["wide"] == extreme(masks[r["image"]], radius, np.max)[r["y"], r["x"]] for r in wide)


@pytest.mark.parametrize("size,target", [(8, 3), (10, 10), (7, 4), (640, 256), (5, 12), (1000, 7)])
def test_nearest_positions(spark, size, target):
    got = [r[0] for r in spark.range(size).filter(grids.survives_nearest(F.col("id"), size, target)).collect()]
    assert sorted(got) == sorted({int((o + .5) * size / target) for o in range(target)})


def test_foreground_finds_a_square(spark, bucketing):
    rng = np.random.default_rng(2)
    image = .1 + rng.normal(0, .004, (32, 32))
    image[10:20, 12:22] = .9
    image[3, 3] = .9                                  # an isolated dot is opened away
    out = grids.robust_foreground(grid(spark, [image], "v", "double"), ["v"], (32, 32)).collect()
    found = {(r["y"], r["x"]) for r in out if r["opened"]}
    assert found == {(y, x) for y in range(10, 20) for x in range(12, 22)}
    edge = np.concatenate([image[:, :1].ravel(), image[:, -1:].ravel(), image[:1].ravel(), image[-1:].ravel()])
    lower = lambda v: np.sort(v)[(len(v) - 1) // 2]
    d = np.abs(edge - lower(edge))
    want = max(.04, lower(d) + 6 * lower(np.abs(d - lower(d))), np.quantile(d, .98))
    assert out[0]["threshold"] == pytest.approx(want, abs=1e-12)


def test_every_kth_follows_the_rows(spark, bucketing):
    rng = np.random.default_rng(6)
    images = [rng.random((7, 9)) for _ in range(2)]
    kept = grids.every_kth(grid(spark, images, "v", "double").filter("v > 0.4"), 5, 9).collect()
    for i, a in enumerate(images):
        assert sorted(r["v"] for r in kept if r["image"] == i) == sorted(a[a > .4][::5])


def test_blend_wraps_and_keeps_the_outside(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random((6, 5)), rng.random((6, 5))
    alpha = np.zeros((6, 5))
    alpha[1:4, 2:4] = .5
    pixels = grid(spark, [a, b], "value", "double").join(grid(spark, [alpha, alpha], "alpha", "double"), ["image", "y", "x"])
    pairs = spark.createDataFrame([(0, 1, -2, 1)], "image int, donor int, shift_y int, shift_x int")
    out = grids.donor_blend(pixels, pairs, (6, 5)).collect()
    moved = np.roll(b, (-2, 1), (0, 1))
    moved = np.clip(moved + a[alpha > 0].mean() - moved[alpha > 0].mean(), 0, 1)
    want = a * (1 - alpha) + moved * alpha
    assert len(out) == 30 and all(r["blended"] == pytest.approx(want[r["y"], r["x"]]) for r in out)
    assert all(not r["changed"] for r in out if alpha[r["y"], r["x"]] == 0)


def test_scorer_contract(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i)) for i in range(20)], "i int, category string, v double")

    def build():
        return lambda batch: batch["v"].to_numpy() / 10
    got = score_batch(df, build, .5, ["a"], payload=("v",)).collect()
    assert len(got) == 10 and "v" not in got[0].asDict() and all(r["predicted_defective"] == (r["score"] >= .5) for r in got)
    assert score_batch(df, build, .5, [], payload=("v",)).count() == 0 and score_batch(df, build, .5, payload=("v",)).count() == 20
    for bad in (lambda: (lambda b: b["v"].to_numpy() * float("nan")), lambda: (lambda b: np.zeros(1 + len(b)))):
        with pytest.raises(Exception, match="one finite score"):
            score_batch(df, bad, .5).collect()


def test_stream_keeps_the_first_result(spark, tmp_path):
    schema = "key long, category string, size_bytes long, width int, height int, score double, arrived timestamp"
    thresholds = spark.createDataFrame([("a", .5)], "category string, threshold double")

    def arrive(rows):
        (spark.createDataFrame(rows, "key long, category string, size_bytes long, width int, height int, score double, s long")
         .withColumn("arrived", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / "in")))

    def drain():
        stream = decisions.read_arrivals(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        out = decisions.decide(decisions.first_only(stream, "key", "arrived", "1 hour"), thresholds).select("key", "score", "outcome")
        decisions.drain(out, str(tmp_path / "out"), str(tmp_path / "progress"))
        return {r["key"]: r["outcome"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    arrive([(1, "a", 10, 100, 100, .9, 1000), (2, "a", 10, 100, 100, .1, 1001), (3, "b", 10, 100, 100, .9, 1002), (4, "a", 10, 10, 100, .9, 1003)])
    first = drain()
    assert first == {1: "defective", 2: "normal", 3: "refused: category", 4: "refused: dimensions"}
    arrive([(1, "a", 10, 100, 100, .1, 1100), (5, "a", 10, 100, 100, .5, 1101)])
    assert drain() == {**first, 5: "defective"}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_stream_never_overwrites(spark, tmp_path):
    schema = "key long, score double, arrived timestamp"

    def arrive(rows):
        (spark.createDataFrame(rows, "key long, score double, s long").withColumn("arrived", F.timestamp_seconds("s")).drop("s")
         .coalesce(1).write.mode("append").parquet(str(tmp_path / "in")))

    def drain(progress):
        stream = decisions.read_arrivals(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema).withColumn("outcome", F.col("score") >= .5)
        decisions.drain_once(stream, "key", "arrived", "1 hour", str(tmp_path / "out"), str(tmp_path / progress))
        read = lambda name: [r for r in spark.read.parquet(str(tmp_path / "out" / name)).collect()]
        return {(r["key"], r["outcome"]) for r in read("decisions")}, sorted((r["key"], r["reason"]) for r in read("refused")), len(read("decisions"))
    arrive([(1, .9, 10_000), (1, .1, 10_001), (2, .1, 10_002), (2, .1, 10_002), (3, .7, None)])
    first = {(1, True), (2, False), (3, True)}
    assert drain("p") == (first, [(1, "repeated"), (2, "repeated")], 3)
    arrive([(1, .1, 10_500), (4, .9, 1_000), (5, .2, 9_000)])                  # a decided key, a row behind the watermark, a row within it
    second = (first | {(5, False)}, [(1, "repeated"), (1, "repeated"), (2, "repeated"), (4, "late")], 4)
    assert drain("p") == second
    assert drain("p") == second                                                # nothing new
    arrive([(1, .1, 10_000), (2, .9, 20_000)])
    again = drain("p")
    assert again[0] == second[0] and len(again[1]) == 6


def test_stream_batch_run_again_writes_the_same(spark, tmp_path):
    import shutil
    rows = spark.createDataFrame([(1, .9, 100), (2, .1, 101)], "key long, score double, s long").withColumn("arrived", F.timestamp_seconds("s")).drop("s")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))

    def drain():
        stream = decisions.read_arrivals(spark, str(tmp_path / "in"), rows.schema)
        decisions.drain_once(stream, "key", "arrived", "1 hour", str(tmp_path / "out"), str(tmp_path / "progress"))
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "decisions")).collect())
    first = drain()
    shutil.rmtree(tmp_path / "progress" / "commits")                           # as if the driver was lost before the commit
    assert drain() == first and len(first) == 2


def peak_megabytes(work):
    import tracemalloc
    tracemalloc.start()
    result = work()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return result, peak


def test_block_of_copies_needs_little_memory():
    """All 2,048 bank rows are at one distance from every query."""
    import pandas as pd
    queries = pd.DataFrame({"query_id": range(512), "vector": [np.full(64, .25)] * 512})
    bank = pd.DataFrame({"vec_id": range(2048), "vector": [np.full(64, .5)] * 2048})
    found, peak = peak_megabytes(lambda: vectors._nearest_in_block(3)(queries, bank))
    assert found["neighbour_id"].tolist() == [0, 1, 2] * 512 and set(found["distance"]) == {4.0}
    assert peak < 80


def test_code_scan_returns_few_rows_however_many_cells():
    from types import SimpleNamespace
    import pyarrow as pa
    rng = np.random.default_rng(2)
    centres, words = rng.random((40, 8)), [rng.random((16, 4)) for _ in range(2)]
    codes, cell = rng.integers(0, 16, (2000, 2)).astype(np.uint8), rng.integers(0, 40, 2000).astype(np.int32)
    x, visits = rng.random((300, 8)), [sorted(rng.choice(40, 30, replace=False).tolist()) for _ in range(300)]
    queries = pa.table({"query_id": np.arange(300), "vector": pa.array(x.tolist()), "cells": pa.array(visits, pa.list_(pa.int32()))})
    bank = pa.table({"cell": cell, "vec_id": np.arange(2000), "codes": pa.array([c.tobytes() for c in codes])})
    scan = vectors._scan_codes(SimpleNamespace(value=(centres, words)), 7)
    out = scan(queries, bank)
    got = {}
    for q, n, d in zip(*(out[c].to_pylist() for c in ("query_id", "neighbour_id", "distance"))):
        got.setdefault(q, {})[n] = d
    points = centres[cell] + np.hstack([words[0][codes[:, 0]], words[1][codes[:, 1]]])
    for q in range(300):
        inside = np.flatnonzero(np.isin(cell, visits[q]))
        d = ((points[inside] - x[q]) ** 2).sum(1)
        assert len(got[q]) == 7 and sorted(got[q].values()) == pytest.approx(np.sort(d)[:7])      # equal codes tie
        assert got[q] == pytest.approx({n: d[inside == n][0] for n in got[q]})
    assert scan(queries.slice(0, 0), bank).num_rows == scan(queries, bank.slice(0, 0)).num_rows == 0
