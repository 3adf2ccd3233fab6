import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import duplicates, splits


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        parent[find(a)] = find(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), []).append(x)
    return {x: min(g) for g in groups.values() for x in g}


@pytest.mark.parametrize("edges", [
    [("a", "b"), ("b", "c"), ("x", "y")],
    [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(120)],                  # a long chain
    [("hub", f"leaf{i:03d}") for i in range(200)],                         # one star holds everything
    [(f"v{a}", f"v{b}") for a, b in [(random.Random(i).randrange(90), random.Random(i + 500).randrange(90)) for i in range(70)] if a != b],
])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a string, b string")
    got = {r["node"]: r["component"] for r in duplicates.connected_components(df, "a", "b").collect()}
    assert got == union_find(edges)


def test_masks_miss_nothing():
    rng = random.Random(2)
    for bands in (3, 4, 5, 6):
        masks = duplicates.band_masks(2, bands)
        for _ in range(300):
            flipped = sum(1 << b for b in rng.sample(range(64), 2))
            assert any(flipped & (m & (1 << 64) - 1) == 0 for m in masks)


@pytest.mark.parametrize("hot_rows,bands", [(512, None), (5, 3), (5, 4), (3, 5)])
def test_near_duplicates_against_all_pairs(spark, hot_rows, bands):
    """A third of the contents share one fingerprint; copies of one content are another third."""
    rng = np.random.default_rng(4)
    centre = rng.random(64)
    rows = []
    for i in range(90):
        if i % 3 == 0:
            fp, thumb, content = 12345, centre + rng.normal(0, .004, 64), f"c{i}"
        elif i % 3 == 1:
            fp, thumb, content = 777, np.full(64, .5), "copied"
        else:
            fp, thumb, content = 12345 ^ int(sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 4), replace=False))), centre + rng.normal(0, .006, 64), f"c{i}"
        rows.append((f"p{i:02d}", content, int(fp), [float(x) for x in thumb]))
    df = spark.createDataFrame(rows, "path string, content_hash string, fp long, thumb array<double>").repartition(4)
    got = {(r["left_path"], r["right_path"]): r for r in duplicates.near_duplicates(df, 2, .004, crowd_rows=hot_rows, part_rows=hot_rows + 1, bands=bands).collect()}
    first = {}
    for p, c, f, t in rows:
        first.setdefault(c, (p, f, t))
    want = {}
    items = sorted(first.values())
    for i, (p, f, t) in enumerate(items):
        for q, g, u in items[i + 1:]:
            if bin(f ^ g).count("1") <= 2 and np.abs(np.array(t) - u).mean() <= .004:
                want[(p, q)] = bin(f ^ g).count("1")
    assert want and {k: r["hamming"] for k, r in got.items()} == want
    assert duplicates.near_duplicates(df, 2, .004, crowd_rows=hot_rows, part_rows=hot_rows + 1, bands=bands).count() == len(want)


def components_by_force(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("crowd_rows, block_rows", [(64, 1024), (2, 5), (0, 3)])
def test_forest_connects_what_the_pairs_connect(spark, crowd_rows, block_rows):
    rng = np.random.default_rng(8)
    centres = [(int(rng.integers(0, 2**62)) if i else 0, rng.random(64)) for i in range(4)]
    rows = []
    for i in range(120):
        word, picture = centres[0 if i < 70 else i % 4]
        flips = sum(1 << int(b) for b in rng.choice(62, int(rng.integers(0, 3)), replace=False))
        rows.append((f"p{i:03d}", f"c{i}", word ^ flips, [float(x) for x in picture + rng.normal(0, .0035, 64)]))
    rows += [("q", "c0", rows[0][2], rows[0][3]), ("r", "r", None, None), ("s", "s", 0, None), ("t", "t", 0, [0.5]), ("u", "u", 0, [0.5])]
    df = spark.createDataFrame(rows, "path string, content_hash string, fp long, thumb array<double>").repartition(4)
    usable = [r for r in rows if r[3] is not None and r[0] != "q"]
    pairs = [(p, q) for i, (p, _, f, t) in enumerate(usable) for q, _, g, u in usable[i + 1:]
             if len(t) == len(u) and bin(f ^ g).count("1") <= 2 and np.abs(np.array(t) - u).mean() <= .004]
    edges = [tuple(e) for e in duplicates.near_forest(df, 2, .004, crowd_rows=crowd_rows, block_rows=block_rows).collect()]
    names = [r[0] for r in usable]
    assert pairs and {tuple(sorted(e)) for e in edges} <= {tuple(sorted(p)) for p in pairs}
    assert components_by_force(names, edges) == components_by_force(names, pairs)


def test_forest_of_one_crowd_is_linear(spark):
    rng = np.random.default_rng(9)
    n = 5000
    rows = [(f"p{i:04d}", f"c{i}", 7, [.5 + float(x) for x in rng.normal(0, .0005, 16)]) for i in range(n)]
    df = spark.createDataFrame(rows, "path string, content_hash string, fp long, thumb array<double>")
    edges = duplicates.near_forest(df, 2, .004, bands=3).collect()
    assert len(edges) == n - 1 and len(set(components_by_force([r[0] for r in rows], edges).values())) == 1
    assert duplicates.near_forest(df.limit(0), 2, .004).count() == 0


def test_rows_of_a_crowd_travel_once_a_block(spark):
    """3,000 rows of one fingerprint with equal section sums: no sum tells them apart, and few are near each other."""
    rng = np.random.default_rng(3)
    base = np.tile([.9, .1, .2, .3, .4, .5, .6, .7], (8, 1))
    rows = [(f"p{i:04d}", f"c{i}", 7, [float(x) for x in rng.permuted(base, axis=1).ravel()]) for i in range(3000)]
    rows += [(f"q{i:02d}", f"d{i}", 7, [x + 1e-4 * i for x in rows[0][3]]) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "path string, content_hash string, fp long, thumb array<double>").repartition(4)
    crowd = df.select(F.lit(0).alias("no"), F.col("fp").alias("bits"), "path", "fp", F.lit(1).cast("long").alias("copies"), F.lit(False).alias("hung"))
    pictures = df.select("path", "thumb")
    assert duplicates._tiles(crowd, pictures, 100_000).count() == len(rows)
    assert duplicates._tiles(crowd, pictures, 1600).count() == 2 * len(rows)
    hung = crowd.withColumn("hung", F.col("path") != "p0000")
    assert duplicates._tiles(hung, pictures, 100_000).count() == len(rows) + 1      # tiles (0, 0) and (0, 1)
    assert duplicates._tiles(hung.filter("hung"), pictures, 100).count() == 0
    thumbs = {p: np.array(t) for p, _, _, t in rows}
    names, matrix = sorted(thumbs), np.array([thumbs[p] for p in sorted(thumbs)])
    want = {(names[i], names[j]) for i in range(len(names)) for j in np.flatnonzero(np.abs(matrix[i + 1:] - matrix[i]).mean(1) <= .002) + i + 1}
    got = [(r["left_path"], r["right_path"]) for r in duplicates.near_duplicates(df, 2, .002, part_rows=1600).collect()]
    assert len(want) > 300 and len(got) == len(want) and set(got) == want
    edges = [tuple(e) for e in duplicates.near_forest(df, 2, .002, block_rows=1600).collect()]
    assert components_by_force(names, edges) == components_by_force(names, want)


@pytest.mark.parametrize("table", [1, 1 << 60])
@pytest.mark.parametrize("cells, tolerance", [(1 << 18, .002), (64, .002), (64, .3)])
def test_rows_of_two_words_meet_once(monkeypatch, table, cells, tolerance):
    """A hundred words carry 600 rows; every near pair of a block, or of two blocks, comes once, as a table and as a list, and nothing else."""
    monkeypatch.setattr(duplicates, "TABLE", table)
    monkeypatch.setattr(duplicates, "TABLE_CELLS", cells)
    monkeypatch.setattr(duplicates, "TABLE_WIDTH", min(cells, 64))
    monkeypatch.setattr(duplicates, "CELLS", 1000)
    rng = np.random.default_rng(12)
    known = np.array([sum(1 << int(b) for b in rng.choice(40, rng.integers(0, 3), replace=False)) for _ in range(100)], dtype=np.uint64)
    words = known[rng.integers(0, 100, 600) * rng.integers(0, 2, 600)]               # half of the rows share one word
    centres = rng.random((5, 40))
    pictures = centres[rng.integers(0, 5, 600)] + rng.normal(0, .0018, (600, 40))
    pictures[7] = pictures[8] + np.eye(40)[0] * 1e6                                    # far beyond the short numbers
    apart = np.bitwise_count(words[:, None] ^ words[None, :])
    difference = np.zeros((600, 600))
    for k in range(40):
        difference += np.abs(pictures[:, None, k] - pictures[None, :, k])
    near = (apart <= 2) & (difference / 40 <= tolerance)
    near[:, 3] = near[3, :] = False                                                    # not wanted

    def got(left, right):
        sides = (left, pictures[left]) * 2 if left is right else (left, pictures[left], right, pictures[right])
        found = duplicates._near_rows(words, *sides, 2, tolerance, lambda bits: np.full(len(bits), True), lambda a, b: (a != 3) & (b != 3))
        pairs = [(int(a), int(b), int(h), float(d)) for part in found for a, b, h, d in zip(*part)]
        assert len({tuple(sorted(p[:2])) for p in pairs}) == len(pairs)
        assert all(h == apart[a, b] and d == difference[a, b] / 40 for a, b, h, d in pairs)
        return {tuple(sorted(p[:2])) for p in pairs}
    rows = np.arange(600)
    assert len(want := {(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b}) > 300 and got(rows, rows) == want
    assert got(rows[:250], rows[250:]) == {(a, b) for a, b in want if a < 250 <= b}


def test_small_keys_share_buckets(spark):
    """4,000 rows of 2,000 small keys a mask meet in a few tiles, each row once a mask, and only rows of one key pair up."""
    rng = np.random.default_rng(13)
    words = [int(w) for w in rng.integers(-2**62, 2**62, 2000)]
    rows = [(f"p{i:04d}", f"c{i}", words[i // 2] ^ (i % 2), [.5, .25 + 1e-5 * (i % 3)]) for i in range(4000)]
    rows.append(("none", "none", None, [.5, .25]))
    df = spark.createDataFrame(rows, "path string, content_hash string, fp long, thumb array<double>").repartition(4)
    keyed, masks, contents = duplicates._keyed(df, 2, "path", "content_hash", "fp", "thumb", 64, None)
    tiles = duplicates._buckets(keyed, df.select("path", "thumb"), contents)
    assert tiles.count() == 4000 * len(masks) and tiles.select(*duplicates.TILE).distinct().count() == len(masks)
    want = {(f"p{i:04d}", f"p{i + 1:04d}") for i in range(0, 4000, 2)}
    got = [(r["left_path"], r["right_path"], r["hamming"]) for r in duplicates.near_duplicates(df, 2, .004).collect()]
    assert len(got) == len(want) and {g[:2] for g in got} == want and {g[2] for g in got} == {1}
    edges = [tuple(sorted(e)) for e in duplicates.near_forest(df, 2, .004).collect()]
    assert len(edges) == len(want) and set(edges) == want


def test_pairs_reach_to_the_tolerance_of_the_audit(spark, tmp_path):
    """Texts of one fingerprint whose letter shares differ by 0.0001, 0.001, 0.003 and 0.005 on average from the first."""
    counts = [(300, 500, 800), (305, 500, 795), (351, 500, 749), (453, 500, 647), (300, 756, 544)]
    rows = [(i, "a" * a + "b" * b + "c" * c, "en", "s", a + b + c) for i, (a, b, c) in enumerate(counts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    shares = [[x / 1600 for x in c] for c in counts]
    difference = {(i, j): sum(abs(x - y) for x, y in zip(shares[i], shares[j])) / 64 for j in range(5) for i in range(j)}
    want = {pair for pair, d in difference.items() if d <= .004}
    assert len(want) == 6 and sum(.0005 < difference[pair] for pair in want) == 5
    from gaugeframe.plans.catalog import QUERIES
    got = {(int(r["left_path"][2:]), int(r["right_path"][2:])) for r in QUERIES["near_duplicate_join"](spark, str(tmp_path)).collect()}
    assert got == want


def test_groups_and_quarantine(spark):
    rows = [("a1", "x", "train"), ("a2", "x", "test"), ("b1", "y", "train"), ("b2", "z", "test"), ("c1", "w", "train")]
    records = spark.createDataFrame(rows, "path string, content_hash string, split string")
    near = spark.createDataFrame([("b1", "b2")], "left_path string, right_path string")
    grouped = duplicates.similarity_groups(records, near)
    assert {r["path"]: r["group"] for r in grouped.collect()} == {"a1": "a1", "a2": "a1", "b1": "b1", "b2": "b1", "c1": "c1"}
    roles = {r["path"]: r["role"] for r in duplicates.quarantine(grouped).collect()}
    assert roles == {"a1": "quarantined", "a2": "test", "b1": "quarantined", "b2": "test", "c1": "training"}
    assert [(r["first_path"], r["later_path"]) for r in duplicates.exact_duplicates(records).collect()] == [("a1", "a2")]


def test_seeded_split_counts(spark, bucketing):
    df = spark.range(134).select(F.when(F.col("id") < 14, "small").otherwise("big").alias("category"), F.col("id").cast("string").alias("path"))
    once, again = (sorted(map(tuple, splits.seeded_split(df.repartition(n), 42).collect())) for n in (1, 6))
    assert once == again
    other = sorted(map(tuple, splits.seeded_split(df, 43).collect()))
    assert once != other
    for category, n in (("small", 14), ("big", 120)):
        first = max(1, min(n - 2, round(n * .15)))
        second = max(1, min(n - first - 1, round(n * .15)))
        have = [r[2] for r in once if r[0] == category]
        assert (have.count("validation"), have.count("calibration"), len(have)) == (first, second, n)
    with pytest.raises(ValueError):
        splits.seeded_split(df, 42, .6, .5)


def test_groups_are_never_cut(spark, bucketing):
    rows = [(f"g{i // 2:03d}", int(i // 2 % 4 == 0), f"r{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "group string, label int, path string")
    out = splits.grouped_stratified_split(df, 42)
    assert out.groupBy("group").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()
    shares = {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()}
    for label, total in ((0, 300), (1, 100)):
        assert abs(shares[label, "train"] - .7 * total) <= 2 and abs(shares[label, "validation"] - .15 * total) <= 2
    assert splits.splits_without_both_labels(out).isEmpty()
    assert out.count() == 400


def test_balanced_batches(spark):
    df = spark.createDataFrame([(i, int(i < 3)) for i in range(50)], "image long, label int")
    out = splits.balanced_batches(df, 8, 1, "image").collect()
    assert len(out) == 7 * 8
    for b in range(7):
        assert sum(r["label"] for r in out if r["batch"] == b) == 4
    assert all((r["image"] < 3) == (r["label"] == 1) for r in out)
    for bad in (3, 0):
        with pytest.raises(ValueError):
            splits.balanced_batches(df, bad, 1, "image")
    with pytest.raises(ValueError):
        splits.balanced_batches(df.filter("label = 0"), 8, 1, "image")


def test_donors(spark, bucketing):
    df = spark.createDataFrame([(k, f"{k}{i:02d}") for k, n in (("a", 20), ("b", 2)) for i in range(n)], "category string, path string")
    nxt = {r["path"]: r["donor"] for r in splits.next_donor(df, ["category"], "path").collect()}
    assert nxt["a00"] == "a01" and nxt["a19"] == "a00" and nxt["b01"] == "b00"
    drawn = splits.random_donor(df, ["category"], "path", 4).collect()
    assert len(drawn) == 22 and all(r["donor"] != r["path"] and r["donor"][0] == r["path"][0] for r in drawn)


def test_subset_and_retry(spark, bucketing):
    df = spark.range(101)
    assert splits.random_subset(df, .25, 1, "id").count() == 25 and splits.random_subset(df, 1, 1, "id").count() == 101
    cases = spark.createDataFrame([(0,), (5,), (70,)], "want int")
    got = {r["want"]: r["attempt"] for r in splits.first_nonempty(cases, F.col("attempt") >= F.col("want"), ["want"]).collect()}
    assert got == {0: 0, 5: 5, 70: None}


def test_single_records_have_no_donor(spark):
    df = spark.createDataFrame([("a", "p1"), ("a", "p2"), ("b", "p3")], "category string, path string")
    for rows in (splits.next_donor(df, ["category"], "path").collect(), splits.random_donor(df, ["category"], "path", 4).collect()):
        assert {r["path"]: r["donor"] for r in rows} == {"p1": "p2", "p2": "p1", "p3": None}


SHARES = {"train": .70, "validation": .85 - .70, "calibration": 1 - .85}


def split_by_force(groups, seed):
    """groups: name -> (normal, defective); the greedy pass over classes of like groups, group by group in hash order."""
    import hashlib
    import math

    def two(n):
        step = 10 ** max(int(math.floor(math.log10(max(n, 1)))) - 1, 0)
        return n // step * step
    classes = {}
    for name, (a, b) in groups.items():
        classes.setdefault((two(a), two(b)), []).append(name)
    order = sorted(classes, key=lambda c: (-(c[0] + c[1]), c[0]))
    table = [(len(classes[c]), *[sum(groups[g][i] for g in classes[c]) / len(classes[c]) for i in (0, 1)]) for c in order]
    out = {}
    for c, counts in zip(order, splits.allot(table, list(SHARES.values()))):
        names = sorted(classes[c], key=lambda g: (hashlib.sha256(f"{seed}|{g}".encode()).hexdigest(), g))
        places = [s for s, n in zip(SHARES, counts) for _ in range(n)]
        out.update(zip(names, places))
    return out


@pytest.mark.parametrize("shape", ["one label", "both labels"])
def test_grouped_split_is_balanced_for_heavy_groups(spark, shape):
    groups = {f"g{i:03}": (i, 0 if shape == "one label" else i % 7) for i in range(1, 61)}
    if shape == "both labels":
        groups |= {f"h{i:03}": (0, 1 + i % 3) for i in range(200)} | {"big": (1234, 56)}
    rows = [(g, label) for g, sizes in groups.items() for label in (0, 1) for _ in range(sizes[label])]
    out = splits.grouped_stratified_split(spark.createDataFrame(rows, "group string, label int"), 42).collect()
    place = {r["group"]: r["split"] for r in out}
    assert len(out) == len(rows) and len({(r["group"], r["split"]) for r in out}) == len(groups)
    assert place == split_by_force(groups, 42)
    for label in (0, 1):
        total = sum(s[label] for s in groups.values())
        most = max(s[label] for s in groups.values())
        for name, share in SHARES.items():
            assert abs(sum(s[label] for g, s in groups.items() if place[g] == name) - share * total) <= max(1, most)


def test_grouped_split_refuses_other_labels(spark):
    for odd in (2, None):
        with pytest.raises(Exception, match="labels must be 0 or 1"):
            splits.grouped_stratified_split(spark.createDataFrame([("a", 0), ("b", odd)], "group string, label int"), 42).collect()


def test_grouped_split_query_keeps_groups_whole(spark):
    from gaugeframe.plans.catalog import QUERIES
    rows = QUERIES["grouped_stratified_split"](spark, "/root/testdata/sf0.01").collect()
    groups = {}
    for r in rows:
        counts = groups.setdefault(r["group"], [0, 0])
        counts[r["label"]] += 1
    assert {r["group"]: r["split"] for r in rows} == split_by_force({g: tuple(c) for g, c in groups.items()}, 42)
