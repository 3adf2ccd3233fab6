import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.functions.scalar import wilson
from gaugeframe.operators import ranking, rates, scoring, splitting, uncertainty
from gaugeframe.operators.prefix import exact_quantiles, hash_index, ordered_index, running_totals


def frame(spark, labels, scores, **columns):
    rows = [(i, int(a), float(b), *[columns[c][i] for c in columns]) for i, (a, b) in enumerate(zip(labels, scores))]
    return spark.createDataFrame(rows, "image long, label int, score double" + "".join(f", {c} string" for c in columns))


def brute_auroc(labels, scores):
    pairs = [(p, n) for p, n in itertools.product(range(len(labels)), repeat=2) if labels[p] == 1 and labels[n] == 0]
    return sum(1.0 if scores[p] > scores[n] else 0.5 if scores[p] == scores[n] else 0.0 for p, n in pairs) / len(pairs)


def brute_ap(labels, scores):
    total, found = sum(labels), 0.0
    if not total:
        return None
    for t in set(scores):
        pos = sum(1 for a, s in zip(labels, scores) if s == t and a)
        tp = sum(1 for a, s in zip(labels, scores) if s >= t and a)
        found += pos * tp / sum(1 for s in scores if s >= t)
    return found / total


def brute_partial(labels, scores, limit=0.1):
    p, n = sum(labels), len(labels) - sum(labels)
    points = [(0.0, 0.0)] + [(sum(1 for a, s in zip(labels, scores) if s >= t and not a) / n,
                              sum(1 for a, s in zip(labels, scores) if s >= t and a) / p) for t in sorted(set(scores), reverse=True)]
    x, y = np.array([q[0] for q in points]), np.array([q[1] for q in points])
    inside = int(np.searchsorted(x, limit, side="right"))
    xs, ys = list(x[:inside]), list(y[:inside])
    if inside < len(x):
        ys.append(np.interp(limit, [x[inside - 1], x[inside]], [y[inside - 1], y[inside]]))
        xs.append(limit)
    area = sum((xs[i + 1] - xs[i]) * (ys[i + 1] + ys[i]) / 2 for i in range(len(xs) - 1))
    low = 0.5 * limit ** 2
    return 0.5 * (1 + (area - low) / (limit - low))


def test_threshold_is_not_ranking(spark):
    df = frame(spark, [0, 0, 1, 1], [.1, .6, .7, .9])
    assert ranking.ranking_metrics(df).first()["auroc"] == 1.0
    row = rates.confusion(df, F.lit(.8)).first()
    assert (row["tp"], row["fp"], row["tn"], row["fn"], row["recall"]) == (1, 0, 2, 1, .5)


def test_missing_class_gives_null(spark):
    df = frame(spark, [0, 0], [.1, .8])
    m = ranking.ranking_metrics(df).first()
    assert m["auroc"] is None and m["partial_auroc"] is None and m["ap"] is None
    row = rates.confusion(df, F.lit(.5)).first()
    assert row["recall"] is None and row["false_alarm_rate"] == .5
    pixels = df.withColumn("valid", F.lit(True))
    assert ranking.pixel_average_precision(pixels).first()["average_precision"] is None
    assert ranking.pixel_average_precision(pixels, no_positive="zero").first()["average_precision"] == 0


@pytest.mark.parametrize("labels,scores", [
    ([0, 1, 0, 1, 1, 0], [.8, .8, .8, .2, .2, .2]), ([1, 1, 1], [.3, .3, .1]), ([1] + [0] * 30, [.5] + [i / 30 for i in range(30)])])
def test_average_precision_with_ties(spark, bucketing, labels, scores):
    got = ranking.ranking_metrics(frame(spark, labels, scores)).first()["ap"]
    assert got == pytest.approx(brute_ap(labels, scores), abs=1e-12)


@pytest.mark.parametrize("seed", range(3))
def test_ranking_against_brute_force(spark, bucketing, seed):
    rng = random.Random(seed)
    labels = [int(rng.random() < .3) for _ in range(120)]
    scores = [round(rng.random() + .3 * a, 2) for a in labels]
    m = ranking.ranking_metrics(frame(spark, labels, scores).repartition(5)).first()
    assert m["auroc"] == pytest.approx(brute_auroc(labels, scores), abs=1e-12)
    assert m["ap"] == pytest.approx(brute_ap(labels, scores), abs=1e-12)
    assert m["partial_auroc"] == pytest.approx(brute_partial(labels, scores), abs=1e-12)


def test_hot_group_equals_brute_force(spark, bucketing):
    """One category holds most rows; the others stay whole."""
    rng = random.Random(5)
    rows = [("hot" if i % 4 else f"c{i % 12}", int(rng.random() < .4), round(rng.random(), 2)) for i in range(400)]
    df = spark.createDataFrame([(i, b, c, a) for i, (a, b, c) in enumerate(rows)], "image long, label int, score double, category string")
    got = {r["category"]: r["auroc"] for r in ranking.ranking_metrics(df, ["category"]).collect()}
    for name in {r[0] for r in rows}:
        mine = [(a, s) for c, a, s in rows if c == name]
        assert got[name] == pytest.approx(brute_auroc(*zip(*mine)), abs=1e-12)


def test_pooled_can_be_below_each_condition(spark):
    rows = [(g, c, int(g >= 2), (10.0 * c) + (5 if g >= 2 else 0) + g * .1) for g in range(4) for c in range(4)]
    df = spark.createDataFrame([(g, str(c), a, s) for g, c, a, s in rows], "group_id long, condition string, label int, score double")
    got = {r["condition"]: r["auroc"] for r in ranking.metrics_from_histogram(ranking.with_pooled(df, "condition"), ["condition"]).collect()}
    assert all(got[str(c)] == 1.0 for c in range(4)) and got["pooled"] < 1


def test_quantiles_equal_numpy(spark, bucketing):
    rng = np.random.default_rng(3)
    values = {k: np.round(rng.normal(size=n), 2) for k, n in (("a", 1), ("b", 2), ("c", 57), ("d", 200))}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v], "k string, v double").repartition(6)
    out = exact_quantiles(df, ["k"], "v", {"q05": .05, "q50": .5, "q98": .98, "low": .5}, lower=["low"])
    for r in out.collect():
        v = values[r["k"]]
        assert r["n"] == len(v)
        for name, q in (("q05", .05), ("q50", .5), ("q98", .98)):
            assert r[name] == pytest.approx(np.quantile(v, q), abs=1e-12)
        assert r["low"] == np.sort(v)[(len(v) - 1) // 2]


def test_threshold_counts_ties_and_normals_only(spark, bucketing):
    df = frame(spark, [0] * 10 + [1], [1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 100])
    row = rates.normal_threshold(df, .9).first()
    assert row["threshold"] == np.quantile([1, 2, 3, 4, 5, 6, 7, 8, 9, 9], .9) and row["normal_count"] == 10
    assert row["exceedances"] == 2 and row["score_std"] == pytest.approx(np.std([1, 2, 3, 4, 5, 6, 7, 8, 9, 9]))


def test_top_fraction(spark, bucketing):
    rng = np.random.default_rng(1)
    images = {i: np.round(rng.random(n), 2) for i, n in enumerate((1, 99, 100, 250, 1000))}
    df = spark.createDataFrame([(i, float(s), True) for i, v in images.items() for s in v] + [(0, 9.0, False)], "image int, score double, valid boolean")
    for r in scoring.top_fraction_mean(df).collect():
        v = np.sort(images[r["image"]])[::-1]
        assert r["score"] == pytest.approx(v[:max(1, int(len(v) * .01))].mean(), abs=1e-12)


def test_indexes_are_complete_and_repeatable(spark, bucketing):
    df = spark.range(300).select("id", F.when(F.col("id") < 200, "hot").otherwise("cold").alias("k"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    once, again = (sorted((r["k"], r["idx"], r["id"]) for r in hash_index(df.repartition(n), ["k"], digest, ["id"]).collect()) for n in (1, 9))
    assert once == again
    assert [i for k, i, _ in once if k == "hot"] == list(range(200))
    rows = ordered_index(df.repartition(6), ["k"], [F.col("id").cast("string")]).collect()
    for k in ("hot", "cold"):
        mine = sorted((r for r in rows if r["k"] == k), key=lambda r: r["idx"])
        assert [r["id"] for r in mine] == [int(s) for s in sorted(str(r["id"]) for r in mine)] and mine[0]["n"] == len(mine)


def test_running_totals_do_not_depend_on_partitions(spark, bucketing):
    df = spark.range(150).select((F.col("id") % 3).alias("k"), (F.col("id") * 37 % 151).cast("double").alias("o"), F.col("id").alias("v"))
    got = [sorted(map(tuple, running_totals(df.repartition(n), ["k"], ["o"], ["v"]).collect())) for n in (1, 11)]
    assert got[0] == got[1]
    for k, o, v, before, total in got[0]:
        mine = [(b, c) for a, b, c, *_ in got[0] if a == k]
        assert before == sum(c for b, c in mine if b < o) and total == sum(c for _, c in mine)


def test_wilson(spark):
    row = spark.range(1).select(wilson(F.lit(0), F.lit(0)).alias("none"), wilson(F.lit(8), F.lit(10)).alias("w"), wilson(F.lit(0), F.lit(5)).alias("z")).first()
    assert row["none"] is None and row["z"]["lower"] == 0
    for bound in (row["w"]["lower"], row["w"]["upper"]):       # the bounds solve (p - x)^2 = z^2 x (1 - x) / n
        assert (.8 - bound) ** 2 == pytest.approx(1.959963984540054 ** 2 * bound * (1 - bound) / 10, abs=1e-12)
    assert row["w"]["lower"] < .8 < row["w"]["upper"]
    with pytest.raises(Exception, match="between 0 and trials"):
        spark.range(1).select(wilson(F.col("id") + 3, F.lit(2))).collect()


def test_losses_against_numpy(spark):
    rng = np.random.default_rng(0)
    z, t, m = rng.normal(size=(3, 40)) * 20, rng.random((3, 40)) < .3, rng.random((3, 40)) < .8
    df = spark.createDataFrame([(i, float(z[i, j]), int(t[i, j]), bool(m[i, j])) for i in range(3) for j in range(40)], "image int, z double, label int, valid boolean")
    out = scoring.pixel_losses(df, F.col("z")).first()
    p = 1 / (1 + np.exp(-z))
    bce = np.where(t, 3 * np.logaddexp(0, -z), np.logaddexp(0, z))
    assert out["bce"] == pytest.approx((bce * m).sum() / m.sum(), abs=1e-9)
    pm, tm = p * m, t * m
    assert out["dice"] == pytest.approx((1 - (2 * (pm * tm).sum(1) + 1) / (pm.sum(1) + tm.sum(1) + 1)).mean(), abs=1e-9)


def test_bootstrap_on_separable_scores(spark):
    row = uncertainty.bootstrap_auroc(frame(spark, [0, 0, 1, 1], [.1, .6, .7, .9]), 50).first()
    assert (row["lower"], row["upper"], row["samples"]) == (1.0, 1.0, 50)


@pytest.mark.parametrize("method", ["draws", "poisson"])
def test_paired_bootstrap(spark, method, bucketing):
    rows = [(g, c, int(g in "de"), s) for g in "abcde" for c, s in (("x", .2), ("y", .4))]
    rng = random.Random(0)
    control = spark.createDataFrame([(g, c, a, s + rng.random()) for g, c, a, s in rows], "group_id string, condition string, label int, score double")
    control = spark.createDataFrame(control.collect(), control.schema)
    candidate = control.withColumn("score", F.col("score") + 2 * F.col("label"))
    first = uncertainty.paired_bootstrap(control, candidate, 40, method=method).first()
    assert first["difference"] > 0 and first["lower"] <= first["upper"]
    assert uncertainty.paired_bootstrap(control.repartition(4), candidate, 40, method=method).first() == first
    other = candidate.withColumn("group_id", F.concat("group_id", F.lit("!")))
    with pytest.raises(ValueError):
        uncertainty.paired_bootstrap(control, other, 40)


def test_poisson_and_draw_intervals_agree(spark):
    rng = random.Random(9)
    labels = [int(rng.random() < .4) for _ in range(300)]
    df = frame(spark, labels, [rng.gauss(a, 1) for a in labels]).persist()
    a, b = (uncertainty.bootstrap_auroc(df, 200, method=m).first() for m in ("draws", "poisson"))
    assert abs(a["lower"] - b["lower"]) < .02 and abs(a["upper"] - b["upper"]) < .02


def test_score_blocks_equal_exploded_replicates(spark, monkeypatch):
    """A third of the rows share one score, so that score is cut over several blocks."""
    monkeypatch.setattr(uncertainty, "CELLS_PER_BLOCK", 1000)
    rng = random.Random(3)
    labels = [int(rng.random() < .3) for _ in range(3000)]
    scores = [5.0 if rng.random() < .33 else round(rng.gauss(5 + a, 2), 2) for a in labels]
    df = frame(spark, labels, scores).persist()
    lists = df.join(uncertainty.poisson_replicates(df, "image", 10, 1), "image")
    fast = {r["replicate"]: r["auroc"] for r in uncertainty.resampled_areas(lists, [], 10, "image", df).collect()}
    exploded = lists.select("label", "score", F.explode("replicates").alias("replicate"))
    slow = {r["replicate"]: r["auroc"] for r in ranking.ranking_metrics(exploded, ["replicate"]).collect()}
    assert len(fast) == 10 and fast == pytest.approx(slow, abs=1e-12)


def test_draws_keep_class_sizes(spark, bucketing):
    df = frame(spark, [0] * 30 + [1] * 11, range(41))
    lists = uncertainty.drawn_replicates(df, "image", "label", 13, 5).join(df, "image")
    sizes = {(r["label"], r["c"]): r["count"] for r in lists.select("label", F.explode("replicates").alias("c")).groupBy("label", "c").count().collect()}
    assert sizes == {(label, c): n for label, n in ((0, 30), (1, 11)) for c in range(13)}


def test_paired_partial_area(spark):
    rng = random.Random(1)
    rows = [(g, c, int(g % 3 == 0), rng.random()) for g in range(60) for c in "xy"]
    control = spark.createDataFrame(rows, "group_id int, condition string, label int, score double")
    row = uncertainty.paired_bootstrap(control, control.withColumn("score", F.col("score") + F.col("label")), 30, metric="partial_auroc").first()
    assert 0 < row["lower"] <= row["difference"] <= row["upper"] + .2


@pytest.mark.parametrize("cells", [4_000_000, 1000])
def test_partial_area_in_blocks_equals_exploded_replicates(spark, monkeypatch, cells):
    """Many blocks, and a third of the rows at one score that holds the limit in some replicates."""
    monkeypatch.setattr(uncertainty, "CELLS_PER_BLOCK", cells)
    rng = random.Random(6)
    labels = [int(rng.random() < .3) for _ in range(3000)]
    for centre in (8.0, 5.0):
        scores = [centre if rng.random() < .33 else round(rng.gauss(5 + a, 2), 2) for a in labels]
        df = frame(spark, labels, scores).persist()
        lists = df.join(uncertainty.poisson_replicates(df, "image", 10, 1), "image")
        fast = {r["replicate"]: r["partial_auroc"] for r in uncertainty.resampled_partial_areas(lists, [], 10, "image", df).collect()}
        exploded = lists.select("label", "score", F.explode("replicates").alias("replicate"))
        slow = {r["replicate"]: r["partial_auroc"] for r in ranking.ranking_metrics(exploded, ["replicate"]).collect()}
        assert len(fast) == 10 and fast == pytest.approx(slow, abs=1e-12)


def test_split_replicates_equal_full_counts(spark):
    """Rebuild every replicate's counts from the tree: classes keep their sizes and the areas are those of the counts."""
    rng = random.Random(8)
    labels = [int(rng.random() < .3) for _ in range(800)]
    df = frame(spark, labels, [5.0 if rng.random() < .3 else round(rng.gauss(5 + a, 2), 2) for a in labels]).persist()
    samples, cells = 20, 1200
    ranges, depth = splitting.score_ranges(df, samples, cells)
    blocks, paths = ranges.toPandas(), splitting.tree_paths(ranges, depth).toPandas()
    assert blocks["block"].nunique() > 4 and blocks["pos"].sum() + blocks["neg"].sum() == 800
    table = []
    for number, block in blocks.groupby("block"):
        path, block = paths[paths["block"] == number], block.sort_values("score")
        step = max(1, cells // len(block))
        for label in splitting.CLASSES:
            drawn = splitting.block_totals(path, number, samples, 3, label)
            parts = [splitting.block_weights(block[label].to_numpy(), drawn[at:at + step], number, 3, label, at) for at in range(0, samples, step)]
            table += [(r, label, s, w) for r, row in enumerate(np.concatenate(parts)) for s, w in zip(block["score"], row)]
    got = {r["replicate"]: r["auroc"] for r in splitting.split_areas(df, samples, 3, cells).collect()}
    for r in range(samples):
        p = [(s, w) for q, c, s, w in table if q == r and c == "pos" and w]
        n = [(s, w) for q, c, s, w in table if q == r and c == "neg" and w]
        assert sum(w for _, w in p) == sum(labels) and sum(w for _, w in n) == 800 - sum(labels)
        won = sum(w * v * ((s > t) + (s == t) / 2) for s, w in p for t, v in n)
        assert got[r] == pytest.approx(won / sum(labels) / (800 - sum(labels)), abs=1e-12)


def test_split_interval_follows_the_law_of_draws(spark):
    rng = random.Random(2)
    labels = [int(rng.random() < .4) for _ in range(300)]
    df = frame(spark, labels, [round(rng.gauss(a, 1), 1) for a in labels]).persist()
    a, b = (uncertainty.bootstrap_auroc(df, 400, method=m).first() for m in ("draws", "split"))
    assert b["samples"] == 400 and abs(a["lower"] - b["lower"]) < .015 and abs(a["upper"] - b["upper"]) < .015
    assert uncertainty.bootstrap_auroc(df.repartition(3), 400, method="split").first() == b
    alone = uncertainty.bootstrap_auroc(df.filter("label = 1"), 10, method="split").first()
    assert alone is None or alone["lower"] is None


def test_area_bins_keep_empty_rows(spark):
    df = frame(spark, [1, 1, 0], [.9, .1, .9])
    got = {r["area_bin"]: r for r in rates.area_groups(df, F.lit(.02), F.lit(.5)).collect()}
    assert len(got) == 4 and got["medium_1_to_5_percent"]["recall"] == .5 and got["tiny_below_0.1_percent"]["recall"] is None


def test_stress_flips(spark):
    rows = [(1, "original", 0, 1.0), (1, "dark", 0, 5.0), (2, "original", 1, 5.0), (2, "dark", 1, 1.0), (3, "original", 0, 1.0), (3, "dark", 0, 1.5)]
    df = spark.createDataFrame(rows, "group_id int, condition string, label int, score double")
    dark = {r["condition"]: r for r in rates.stress_summary(df, F.lit(3.0)).collect()}["dark"]
    assert (dark["flips"], dark["accepted_to_flagged"], dark["flagged_to_accepted"]) == (2, 1, 1)
    assert dark["mean_abs_change"] == pytest.approx(8.5 / 3)


def test_area_without_a_fraction_is_in_no_bin(spark):
    df = spark.createDataFrame([(1, .9, None), (1, .9, float("nan")), (1, .1, 2.), (1, .9, .3)], "label int, score double, part double")
    got = {r["area_bin"]: (r["bin_order"], r["images"], r["detected"]) for r in rates.area_groups(df, F.col("part"), F.lit(.5)).collect()}
    assert got["large_at_least_5_percent"] == (3, 1, 1) and got["invalid_fraction"] == (4, 3, 2) and len(got) == 5


def test_stress_rows_without_a_base_are_counted(spark):
    df = spark.createDataFrame([(1, "original", 0, 1.), (1, "dark", 0, 5.), (2, "dark", 1, 5.)], "group_id int, condition string, label int, score double")
    dark = {r["condition"]: r for r in rates.stress_summary(df, F.lit(3.0)).collect()}["dark"]
    assert (dark["images"], dark["without_base"], dark["flips"], dark["mean_abs_change"]) == (2, 1, 1, 4.0)


def test_score_block_needs_little_memory():
    """A full block, 4,000 rows drawn about once into each of 1,000 replicates, against one table of all cells."""
    import tracemalloc
    import pandas as pd
    rng = np.random.default_rng(5)
    lists = [np.sort(rng.integers(0, 1000, 1000)).astype(np.int32) for _ in range(4000)]
    block = pd.DataFrame({"label": rng.integers(0, 2, 4000), "score": rng.permutation(3000).repeat(2)[:4000].astype(float), "replicates": lists})
    tracemalloc.start()
    got = uncertainty._block_sums([], 1000)((0,), block)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    order = block.sort_values("score", kind="stable")
    counts = np.stack([np.bincount(x, minlength=1000) for x in order["replicates"]])
    yes, score = order["label"].to_numpy() == 1, order["score"].to_numpy()
    p, n = (np.stack([counts[(score == v) & k].sum(0) for v in np.unique(score)]) for k in (yes, ~yes))
    assert (got["pos"] == p.sum(0)).all() and (got["neg"] == n.sum(0)).all()
    assert got["won"].to_numpy() == pytest.approx((p * (np.cumsum(n, axis=0) - n / 2)).sum(0))
    assert peak < 110


def test_draws_travel_packed_and_are_those_of_the_digests(spark, monkeypatch):
    """Blocks of three drawn rows and slices of two rows: the lists are those of the digests, and no row stands for one draw."""
    monkeypatch.setattr(uncertainty, "DRAWS_PER_BLOCK", 40)
    monkeypatch.setattr(uncertainty, "CELLS_AT_ONCE", 30)
    rows = [(i, i % 3 == 0 and 1 or 0) for i in range(40)] + [(7, 0), (99, None)]
    df = spark.createDataFrame(rows, "image int, label int")
    drawn = uncertainty.drawn_replicates(df, "image", "label", 13, 5)
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    want = []
    for label in (0, 1):
        keys = sorted((hashlib.sha256(f"5|{i}".encode()).hexdigest()[:8], i) for i, y in rows if y == label)
        lists = [[] for _ in keys]
        for i in range(len(keys)):
            for r in range(13):
                word = hashlib.sha256(f"5-draw|{label}|{i}|{r // 8}".encode()).digest()[4 * (r % 8):4 * (r % 8) + 4]
                lists[int.from_bytes(word, "big") % len(keys)].append(r)
        want += [(k[1], tuple(sorted(x))) for k, x in zip(keys, lists) if x]
    assert sorted((r["image"], tuple(r["replicates"])) for r in drawn.collect()) == sorted(want)
