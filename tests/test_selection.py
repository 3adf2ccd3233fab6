import random

import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import evidence, selection
from gaugeframe.plans.catalog import QUERIES


def candidates(spark, rows):
    return spark.createDataFrame(rows, "checkpoint_sha256 string, validation_score double, latency double, kind string")


def test_select_best(spark):
    row = selection.select_best(candidates(spark, [("s44", .70, 1., "joint"), ("s43", .90, 1., "joint"), ("b", .99, 1., "baseline")])).first()
    assert (row["checkpoint_sha256"], row["candidates"]) == ("s43", 2)
    tied = [("slow", .8, 20., "joint"), ("fast", .8 - 1e-13, 10., "joint"), ("low", .8 - 1e-6, 1., "joint")]
    assert selection.select_best(candidates(spark, tied)).first()["checkpoint_sha256"] == "fast"
    same = [("bb", .8, 10., "joint"), ("aa", .8, 10., "joint")]
    assert selection.select_best(candidates(spark, same)).first()["checkpoint_sha256"] == "aa"
    mixed = candidates(spark, same).withColumns({"bank_digest": F.col("checkpoint_sha256"), "split_digest": F.lit("s")})
    assert mixed_count(mixed) == 1 and mixed_count(mixed.withColumn("bank_digest", F.lit("b"))) == 0


def mixed_count(df):
    return selection.mixed_evidence(df).count()


def test_gallery(spark):
    labels, scores = [0, 0, 1, 1, 1, 1, 1, 0], [.8, .95, .2, .01, .51, .7, .99, .1]
    df = spark.createDataFrame([(i, a, s) for i, (a, s) in enumerate(zip(labels, scores))], "image long, label int, score double")
    rows = sorted(selection.gallery_cases(df, F.lit(.5), 2).collect(), key=lambda r: (r["decision"], r["position"]))
    got = {}
    for r in rows:
        got.setdefault(r["decision"], []).append(r["image"])
    assert got == {"FP": [1, 0], "FN": [3, 2], "TP": [4, 6], "TN": [7]}
    with pytest.raises(ValueError):
        selection.gallery_cases(df, F.lit(.5), 0)
    ties = spark.createDataFrame([(f"i{i:02d}", 1, .9) for i in range(30)], "image string, label int, score double").repartition(5)
    assert sorted(r["image"] for r in selection.gallery_cases(ties, F.lit(.5), 3).collect()) == ["i00", "i14", "i29"]


def brute_stop(metrics, patience):
    best, last = None, 0
    for epoch, m in enumerate(metrics, start=1):
        if best is None or m > best:
            best, last = m, epoch
        elif epoch - last >= patience:
            return epoch
    return None


@pytest.mark.parametrize("seed", range(4))
def test_histories(spark, seed):
    rng = random.Random(seed)
    runs = {r: [round(rng.random(), 1) for _ in range(rng.randint(1, 60))] for r in range(12)}
    df = spark.createDataFrame([(r, e, m) for r, ms in runs.items() for e, m in enumerate(ms, 1)], "run int, epoch int, metric double")
    stops = {r["run"]: r["stop_epoch"] for r in selection.early_stop(df, 5).collect()}
    assert stops == {r: brute_stop(ms, 5) for r, ms in runs.items()}
    firsts = df.groupBy("run", "metric").agg(F.min("epoch").alias("first"))
    assert sorted(map(tuple, selection._records(firsts, "run", block=3).collect())) == sorted(map(tuple, selection._records(firsts, "run").collect()))
    for r in selection.best_epoch(df, 5).collect():
        ms = runs[r["run"]]
        eligible = [(m, -e) for e, m in enumerate(ms, 1) if e % 5 == 0 or e == len(ms)]
        assert (r["best_metric"], -r["best_epoch"]) == max(eligible)


def test_quality_target(spark):
    df = spark.createDataFrame([(.9, .1), (.89, .0), (1., .11), (None, .0), (1., None), (float("nan"), .0)], "r double, f double")
    assert [r[0] for r in df.select(selection.quality_target(F.col("r"), F.col("f"))).collect()] == [True, False, False, False, False, False]


def test_family_gate(spark):
    schema = "k int, candidate string, macro_h double, old_macro_h double"
    control = spark.createDataFrame([(1, "control", .8, .8)], schema)

    def outcome(*rows):
        r = selection.gate_family(spark.createDataFrame([(1, *x) for x in rows], schema), control, ["k"]).first()
        return r["state"], r["selected"]
    assert outcome(("A", .805, .8), ("B", .95, .7)) == ("stopped_no_validation_gain", None)
    assert outcome(("A", .82, .8), ("B", .95, .7)) == ("passed", "A")
    assert outcome(("B", .85, .8), ("A", .85, .8)) == ("passed", "A")


@pytest.mark.parametrize("control,candidate,passed", [(.999, .9992, True), (1., 1., False), (.9, .905, False)])
def test_shortfall_gate(spark, control, candidate, passed):
    rows = [(1, "image_pauc", "pooled", control, candidate), (1, "pixel_ap", "pooled", .5, .5), (1, "image_pauc", "clean", .5, .495)]
    df = spark.createDataFrame(rows, "k int, metric string, condition string, control double, candidate double")
    assert selection.gate_shortfall(df, ["k"]).first()["passed"] is passed
    worse = df.withColumn("candidate", F.when(F.col("metric") == "pixel_ap", .48).otherwise(F.col("candidate")))
    assert selection.gate_shortfall(worse, ["k"]).first()["passed"] is False


def test_pooled_gate(spark):
    df = spark.createDataFrame([(1, "pooled", .8, .82), (1, "clean", .9, .895), (2, "pooled", .8, .82), (2, "clean", .9, .88), (3, "pooled", .8, .805)],
                               "k int, condition string, control double, candidate double")
    assert {r["k"]: r["passed"] for r in selection.gate_pooled(df, ["k"]).collect()} == {1: True, 2: False, 3: False}


def test_evidence_edits_are_found(spark):
    base = spark.createDataFrame([("a", "recall", .5), ("a", "auroc", None), ("b", "recall", 1.)], "run string, metric string, value double")
    assert evidence.differing_metrics(base, base, ["run"]).isEmpty()
    edited = base.withColumn("value", F.when(F.col("run") == "b", 1 - 1e-9).otherwise(F.col("value"))).filter("metric <> 'auroc'")
    assert {(r["run"], r["metric"]): r["reason"] for r in evidence.differing_metrics(edited, base, ["run"]).collect()} == {
        ("b", "recall"): "differs", ("a", "auroc"): "not reported"}
    filled = base.fillna(.3, ["value"])
    assert evidence.differing_metrics(filled, base, ["run"]).first()["reason"] == "differs"


def test_decisions_records_and_order(spark):
    df = spark.createDataFrame([("r", "i", .5, .5, True), ("r", "j", .4, .5, True), ("s", "k", .4, .3, True), ("s", "l", .4, .4, True)],
                               "run string, image string, score double, threshold double, predicted_defective boolean")
    got = {(r["run"], r["subject"], r["reason"]) for r in evidence.decision_violations(df, ["run"], "image").collect()}
    assert got == {("r", "j", "decision"), ("s", None, "several thresholds")}
    a = spark.createDataFrame([("x", 1, None), ("y", 2, "q")], "id string, n int, s string")
    b = spark.createDataFrame([("x", 1, "w"), ("z", 2, "q")], "id string, n int, s string")
    got = {(r["id"], r["field"], r["reason"]) for r in evidence.record_differences(a, b, "id", ["n", "s"]).collect()}
    assert got == {("x", "s", "changed"), ("y", "n", "removed"), ("y", "s", "removed"), ("z", "n", "added"), ("z", "s", "added")}
    early = evidence.started_too_early(
        spark.createDataFrame([(1, 5), (1, 9), (2, 1)], "k int, started_at int"), spark.createDataFrame([(1, 3), (1, 7)], "k int, frozen_at int"), ["k"])
    assert {(r["k"], r["started_at"]) for r in early.collect()} == {(1, 5), (2, 1)}


def test_gallery_edits_are_found(spark):
    predictions = spark.createDataFrame([(i, int(i % 2), i / 10) for i in range(10)], "image long, label int, score double")
    gallery = selection.gallery_cases(predictions, F.lit(.5), 3).persist()
    sizes = predictions.groupBy(selection.decision(F.col("score"), F.col("label"), F.lit(.5)).alias("decision")).agg(F.count(F.lit(1)).alias("available"))
    assert evidence.gallery_violations(gallery, predictions, sizes).isEmpty()
    moved = gallery.withColumn("score", F.when(F.col("image") == 9, 5.0).otherwise(F.col("score")))
    assert [r["reason"] for r in evidence.gallery_violations(moved, predictions, sizes).collect()] == ["score"]
    short = gallery.filter("image <> 9")
    assert [r["reason"] for r in evidence.gallery_violations(short, predictions, sizes).collect()] == ["group size"]
    foreign = gallery.withColumn("image", F.when(F.col("image") == 9, 99).otherwise(F.col("image")))
    assert [r["reason"] for r in evidence.gallery_violations(foreign, predictions, sizes).collect()] == ["foreign"]


def test_gallery_groups_repeats_and_digests_are_checked(spark):
    predictions = spark.createDataFrame([(i, int(i % 2), i / 10, f"h{i}") for i in range(10)], "image long, label int, score double, hash string")
    sizes = spark.createDataFrame([], "decision string, available long")
    stored = spark.createDataFrame([("TP", 9, 1, .9, "h9"), ("TP", 8, 0, .8, "h8"), ("FN", 1, 1, .1, "h1"), ("TN", 1, 1, .1, "h1"), ("FP", 6, 0, .6, "other"), ("TN", 0, None, 0., "h0")],
                                   "decision string, image long, label int, score double, hash string")

    def found(**options):
        return sorted((r["subject"], r["reason"]) for r in evidence.gallery_violations(stored, predictions, sizes, **options).collect())
    assert found(threshold=F.lit(.5), digest="hash") == [("0", "label"), ("1", "repeated"), ("1", "repeated"), ("6", "content"), ("8", "group")]
    assert found() == [("0", "label"), ("1", "repeated"), ("1", "repeated")]
    missing = found(threshold=F.lit(None).cast("double"))
    assert missing == [("0", "group"), ("1", "repeated"), ("1", "repeated"), ("6", "group"), ("8", "group"), ("9", "group")]


def test_config_agreement(spark):
    rows = [("a", {"lr": "1", "seed": "1"}), ("a", {"seed": "2", "lr": "1"}), ("b", {"lr": "1", "seed": "1"}), ("b", {"lr": "2", "seed": "1"}), ("c", {"lr": "1"}), ("c", {"lr": "1", "x": "1"})]
    df = spark.createDataFrame(rows, "k string, config map<string,string>")
    assert {r["k"] for r in evidence.config_disagreements(df, ["k"], "config", ["seed"]).collect()} == {"b", "c"}


def test_names_follow_the_inventory():
    assert len(QUERIES) >= 110


NAN = float("nan")


def test_select_best_says_why_not(spark):
    schema = "k int, checkpoint_sha256 string, validation_score double, latency double, kind string, bank_digest string, split_digest string"
    rows = [(1, "a", .7, 1., "joint", "b", "s"), (1, "c", .6, 1., "joint", "b", "s"), (2, "a", NAN, 1., "joint", "b", "s"), (2, "c", .6, 1., "joint", "b", "s"),
            (3, "a", None, 1., "joint", "b", "s"), (4, "a", .7, 1., "joint", "b", "s"), (4, "c", .6, 1., "joint", "x", "s"), (5, "a", 1.2, 1., "joint", "b", "s")]
    got = {r["k"]: (r["checkpoint_sha256"], r["reason"]) for r in selection.select_best(spark.createDataFrame(rows, schema), ["k"]).collect()}
    odd = (None, "score outside [0, 1]")
    assert got == {1: ("a", None), 2: odd, 3: odd, 4: (None, "several banks or splits"), 5: odd}


def test_family_gate_fails_closed(spark):
    schema = "k int, candidate string, macro_h double, old_macro_h double, bank_digest string, split_digest string"
    control = spark.createDataFrame([(k, "control", .8, .7, "b", "s") for k in range(1, 6)], schema)
    rows = [(1, "a", .9, .7, "b", "s"), (2, "a", NAN, .7, "b", "s"), (3, "a", .9, None, "b", "s"), (4, "a", .9, .7, "x", "s"), (6, "a", .9, .7, "b", "s")]
    got = {r["k"]: (r["selected"], r["state"]) for r in selection.gate_family(spark.createDataFrame(rows, schema), control, ["k"]).collect()}
    assert got == {1: ("a", "passed"), 2: (None, "stopped_invalid_value"), 3: (None, "stopped_invalid_value"), 4: (None, "stopped_mixed_evidence"),
                   5: (None, "stopped_no_validation_gain"), 6: (None, "stopped_no_single_control")}


@pytest.mark.parametrize("cell, reason", [(("dark", .5, .5), None), (("dark", .5, NAN), "missing value"), (("dark", None, .5), "missing value"), (("blur", .5, .5), "missing value"),
                                          (("dark", .5, .4), "a condition loses"), (("dark", .5, float("inf")), "missing value")])
def test_pooled_gate_fails_closed(spark, cell, reason):
    rows = [(1, "pooled", .5, .6), (1, "blur", .5, .5), (1, *cell)]
    df = spark.createDataFrame(rows, "k int, condition string, control double, candidate double")
    row = selection.gate_pooled(df, ["k"], conditions=["blur", "dark"]).first()
    assert (row["passed"], row["reason"]) == (reason is None, reason)
    both = df.withColumn("metric", F.lit("image_pauc"))
    row = selection.gate_shortfall(both, ["k"], cells=[f"image_pauc/{c}" for c in ("pooled", "blur", "dark")]).first()
    assert (row["passed"], row["reason"]) == (reason is None, reason and reason.replace("a condition", "another value"))
    absent = selection.gate_pooled(df.filter("condition <> 'dark'"), ["k"], conditions=["blur", "dark"]).first()
    assert (absent["passed"], absent["reason"]) == (False, "missing value")
