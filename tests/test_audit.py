import os

import pytest
from pyspark.sql import functions as F

from gaugeframe.functions import arrays, scalar
from gaugeframe.operators import integrity
from gaugeframe.sources import assets, evidence_files


@pytest.fixture(scope="module")
def records(spark):
    rows = [(f"p{i:02d}", "abc"[i % 3], int(i % 4 == 0), ("train", "validation", "calibration", "test")[i % 4], f"h{i}") for i in range(40)]
    return spark.createDataFrame(rows, "path string, category string, label int, split string, content_hash string")


NAMES = ["path", "category", "label", "split", "content_hash"]


def digest(df):
    return integrity.frame_digest(df, NAMES).first()["digest"]


def test_digest_ignores_order_and_sees_every_edit(spark, records):
    base = digest(records)
    assert digest(records.repartition(7).orderBy(F.desc("path"))) == base
    for column in NAMES:
        edited = F.when(F.col("path") == "p05", F.lit("1" if column == "label" else "x").cast(records.schema[column].dataType)).otherwise(F.col(column))
        assert digest(records.withColumn(column, edited)) != base
    assert digest(records.filter("path <> 'p05'")) != base
    assert digest(records.unionByName(records.filter("path = 'p05'"))) != base


def test_row_digest_keeps_fields_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("ab", None)], "x string, y string").select(scalar.row_digest(["x", "y"]).alias("d"))
    assert df.distinct().count() == 3


def test_manifest_is_written_once(spark, records, tmp_path):
    path = str(tmp_path / "m")
    evidence_files.write_manifest(records, path)
    assert evidence_files.write_manifest(records.repartition(3), path).count() == 40
    with pytest.raises(ValueError, match="differs"):
        evidence_files.write_manifest(records.withColumn("label", 1 - F.col("label")), path)


def test_only_named_splits_are_opened(spark, records, tmp_path):
    path = str(tmp_path / "m")
    evidence_files.write_manifest(records, path)
    for name in os.listdir(f"{path}/split=test"):
        if name.endswith(".parquet"):
            with open(f"{path}/split=test/{name}", "wb") as broken:
                broken.write(b"not parquet")
    kept = evidence_files.read_manifest(spark, path, records, ["train", "calibration"])
    assert kept.count() == 20
    with pytest.raises(Exception):
        evidence_files.read_manifest(spark, path, records, ["test"]).collect()


def test_scan_tree_and_pairs(spark, tmp_path):
    root = tmp_path / "metal"
    files = ["train/good/000.png", "train/good/001.png", "test/good/000.png", "test/scratch/000.png", "test/scratch/001.png",
             "ground_truth/scratch/000_mask.png", "ground_truth/scratch/009_mask.png", "train/good/10301 (copy).png"]
    for i, name in enumerate(files):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(f"content {i}".encode())
    seen = {r["path"].split("/metal/")[1].replace("%20", " "): r for r in assets.scan_tree(spark, str(tmp_path)).collect()}
    assert set(seen) == set(files)
    one = seen["test/scratch/000.png"]
    assert (one["category"], one["split"], one["defect"], one["stem"], one["kind"]) == ("metal", "test", "scratch", "000", "image")
    assert seen["train/good/10301 (copy).png"]["kind"] == "copy" and seen["ground_truth/scratch/000_mask.png"]["record"] == "000"
    tree = assets.scan_tree(spark, str(tmp_path)).select("split", "defect", "record", "kind")
    key = F.concat_ws("/", "defect", "record").alias("key")
    images = tree.filter("split = 'test' AND defect <> 'good' AND kind = 'image'").select(key)
    masks = tree.filter("kind = 'mask'").select(key)
    assert [r["key"] for r in integrity.unpaired(images, masks, "key").collect()] == ["scratch/001"]
    assert [r["key"] for r in integrity.outside_known(masks, [images], "key").collect()] == ["scratch/009"]
    content = assets.read_content(spark, str(tmp_path))
    assert content.select("content_hash").distinct().count() == len(files)


def test_changed_and_missing_content(spark, records):
    actual = records.filter("path <> 'p01'").withColumn("content_hash", F.when(F.col("path") == "p02", "zz").otherwise(F.col("content_hash")))
    got = {r["path"]: r["reason"] for r in integrity.changed_content(records, actual, "path", "content_hash", "content_hash").collect()}
    assert got == {"p01": "missing", "p02": "changed"}
    assert integrity.changed_content(records, records, "path", "content_hash", "content_hash").isEmpty()


def test_membership(spark, records):
    actual = (records.filter("path <> 'p03'").unionByName(records.filter("path = 'p04'"))
              .withColumn("label", F.when(F.col("path") == "p05", 9).otherwise(F.col("label")))
              .unionByName(records.filter("path = 'p06'").withColumn("path", F.lit("q"))))
    got = {r["path"]: r["reason"] for r in integrity.membership(records, actual, "path", "label").collect()}
    assert got == {"p03": "missing", "p04": "duplicate", "p05": "differs", "q": "foreign"}
    assert integrity.membership(records, records, "path", "label").isEmpty()


def test_leaks_and_overlap(spark, records):
    leaked = records.unionByName(records.filter("path = 'p00'").withColumns({"path": F.lit("z"), "split": F.lit("test")}))
    assert integrity.shared_between(records, "content_hash", "split").isEmpty()
    assert [r["parts"] for r in integrity.shared_between(leaked, "content_hash", "split").collect()] == [["test", "train"]]
    row = integrity.pairwise_overlap(leaked, "content_hash", "split").first()
    assert (row["left_part"], row["right_part"], row["shared"]) == ("test", "train", 1)


def test_grid_and_required(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (2, "c")], "s int, c string")
    got = {(r["s"], r["c"]): r["reason"] for r in integrity.grid_violations(df, "s", "c", ["a", "b"]).collect()}
    assert got == {(2, "a"): "repeated", (2, "b"): "missing", (2, "c"): "undeclared"}
    need = spark.createDataFrame([("a",), ("d",)], "c string")
    assert [r["c"] for r in integrity.missing_required(need, df, ["c"]).collect()] == ["d"]


def test_masks_and_sizes(spark):
    pixels = spark.createDataFrame([("ok", 0), ("ok", 255), ("odd", 3), ("odd", 255), ("empty", 0)], "image string, v int")
    assert {r["image"]: r["reason"] for r in integrity.mask_value_violations(pixels, "image", "v").collect()} == {"odd": "not binary", "empty": "empty"}
    a = spark.createDataFrame([("x", 16, 16), ("y", 16, 16)], "image string, width int, height int")
    b = a.withColumn("height", F.when(F.col("image") == "y", 17).otherwise(F.col("height")))
    assert [r["image"] for r in integrity.geometry_violations(a, b, "image").collect()] == ["y"]


def test_ranges(spark):
    rows = [(1, .5, 0), (2, float("nan"), 0), (3, float("inf"), 1), (4, 2.0, 0), (5, .1, 3), (6, None, 0)]
    df = spark.createDataFrame(rows, "i int, s double, l int")
    got = {r["i"]: r["reason"] for r in integrity.out_of_range(df, "i", "s", "l", 0, 1).collect()}
    assert got == {2: "not a number", 3: "infinite", 4: "out of range", 5: "label", 6: "not a number"}


def test_copies(spark):
    df = spark.createDataFrame([("a.png", "1"), ("a (copy).png", "1"), ("b (copy).png", "1")], "p string, h string")
    assert {r["copy"]: r["identical"] for r in integrity.copy_pairs(df, "p", "h").collect()} == {"a (copy).png": True, "b (copy).png": False}


def test_unknown_dataset_is_refused(spark, records):
    with pytest.raises(ValueError):
        integrity.unify({"other": records}, ["known"])


def test_letterbox_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(640, 480), (48, 20), (5, 1000), (2048, 16)], "w int, h int")
    out = df.select("w", "h", *[c.alias(n) for n, c in scalar.letterbox(F.col("w"), F.col("h"), 256, 640).items()]).collect()
    for r in out:
        scale = min(256 / r["w"], 640 / r["h"])
        size = (max(1, round(r["w"] * scale)), max(1, round(r["h"] * scale)))
        assert (r["resized_width"], r["resized_height"]) == size
        assert (r["left_offset"], r["top_offset"]) == ((256 - size[0]) // 2, (640 - size[1]) // 2)


def test_paths_and_limits(spark):
    paths = {"a/b": False, "/a": True, "a/../b": True, "..": True, "a..b/c": False}
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", scalar.unsafe_path(F.col("p")).alias("u"))
    assert {r["p"]: r["u"] for r in df.collect()} == paths
    sizes = spark.createDataFrame([(1, 16, 2048), (10485761, 16, 16), (1, 5000, 5000), (1, 15, 100), (1, 2049, 100)], "b long, w int, h int")
    assert [r[0] for r in sizes.select(scalar.size_reason(F.col("b"), F.col("w"), F.col("h"))).collect()] == [None, "bytes", "pixels", "dimensions", "dimensions"]


def test_evaluation_documents_round_trip(spark, tmp_path):
    rows = spark.range(2500).select(
        F.lit("c").alias("checkpoint_sha256"), F.lit(.5).alias("threshold"), F.col("id").cast("string").alias("image"), F.lit("k").alias("category"),
        F.lit("d").alias("defect"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") / 7).alias("score"), (F.col("id") > 3).alias("predicted_defective"))
    evidence_files.write_predictions(rows, str(tmp_path / "e"), rows_per_document=100)
    assert spark.read.json(str(tmp_path / "e")).agg(F.max("images")).first()[0] < 300
    back = evidence_files.read_predictions(spark, str(tmp_path / "e"))
    assert back.exceptAll(rows.select(back.columns)).isEmpty() and back.count() == 2500


def test_noise_and_brightness_are_repeatable(spark):
    df = spark.range(50).select("id", F.array(*[F.lit(i / 9) for i in range(10)]).alias("v"))
    noisy = df.select("id", arrays.add_noise(F.col("v"), F.col("id"), .1, 3).alias("n"), arrays.drawn_factor(F.col("id"), 3).alias("f"))
    a, b = (sorted(map(tuple, x.collect()), key=lambda r: r[0]) for x in (noisy, noisy.repartition(7)))
    assert a == b and all(0 <= x <= 1 for r in a for x in r[1])
    assert 10 < sum(r[2] == 1 for r in a) < 40 and all(.75 <= r[2] <= 1.25 for r in a)


def test_fingerprint_bits(spark):
    grid = [((r * 7 + c * 5) % 11) / 11 for r in range(8) for c in range(9)]
    bits = "".join("1" if grid[r * 9 + c + 1] > grid[r * 9 + c] else "0" for r in range(8) for c in range(8))
    want = int(bits, 2) - (1 << 64 if bits[0] == "1" else 0)
    assert spark.createDataFrame([(grid,)], "g array<double>").select(arrays.row_gradient_bits(F.col("g"))).first()[0] == want


def test_portable_takes_the_root_literally(spark):
    paths = spark.createDataFrame([("/r.n/a..b",), ("/rxn/a",), ("/r.n/../a",), ("/r.n/known",)], "stored string")
    known = spark.createDataFrame([("/r.n/known", "k/1")], "local_path string, relative_path string")
    got = {r.stored: (r.portable_path, r.leftover) for r in integrity.portable(paths, known, "stored", "/r.n/").collect()}
    assert got == {"/r.n/a..b": ("a..b", False), "/rxn/a": ("/rxn/a", True), "/r.n/../a": ("../a", True), "/r.n/known": ("k/1", False)}
