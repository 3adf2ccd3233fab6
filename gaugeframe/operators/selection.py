"""Choice among runs, gates and example cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.operators.prefix import ordered_index

# The tolerance of equal scores, and the state texts of the family gate.
TIE_TOLERANCE = 1e-12


def usable(value: Column) -> Column:
    """True for a finite number."""
    return F.coalesce(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def _foreign(df: DataFrame) -> Column:
    """True for a group whose rows do not share one bank and one split, where the columns are there."""
    mixed = F.lit(False)
    for name in ("bank_digest", "split_digest"):
        if name in df.columns:
            mixed = mixed | (F.count_distinct(name) != 1) | (F.count_if(F.col(name).isNull()) > 0)
    return mixed


def select_best(candidates: DataFrame, keys: Sequence[str] = (), excluded: str = "baseline") -> DataFrame:
    """The highest validation score; ties go to the lower latency, then to the smaller hash.

    A group with a score that is no number in [0, 1], or with several banks or splits, selects nothing and says why in ``reason``.
    """
    keys = list(keys)
    pool = candidates.filter(F.col("kind") != excluded)
    score = F.col("validation_score")
    odd = ~(usable(score) & F.coalesce(score.between(0, 1), F.lit(False)))
    best = pool.groupBy(*keys).agg(F.max(F.when(~odd, score)).alias("__best"), F.count(F.lit(1)).alias("candidates"),
                                   F.count_if(odd).alias("__odd"), _foreign(pool).alias("__mixed"))
    names = ["__best", "candidates", "__odd", "__mixed"]
    joined = pool.join(best, keys) if keys else pool.select("*", *[best.select(n).scalar().alias(n) for n in names])
    tied = F.coalesce(F.abs(score - F.col("__best")) <= TIE_TOLERANCE, F.lit(False))
    reason = F.when(F.max("__odd") > 0, "score outside [0, 1]").when(F.max("__mixed"), "several banks or splits")
    chosen = joined.groupBy(*keys).agg(
        F.min(F.when(tied, F.struct("latency", "checkpoint_sha256"))).alias("w"), F.max(F.when(tied, score)).alias("validation_score"),
        F.count_if(tied).alias("tied"), F.max("candidates").alias("candidates"), reason.alias("reason"))
    good = F.col("reason").isNull()
    return chosen.select(*keys, F.when(good, F.col("w.checkpoint_sha256")).alias("checkpoint_sha256"),
                         F.when(good, F.col("validation_score")).alias("validation_score"), F.when(good, F.col("tied")).alias("tied"), "candidates", "reason")


def mixed_evidence(candidates: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Groups whose candidates do not share one bank and one split, or have a score outside [0, 1]."""
    score = F.col("validation_score")
    odd = score.isNull() | F.isnan(score) | ~score.between(0, 1)
    return (candidates.groupBy(*keys).agg(
        F.count_distinct("bank_digest").alias("banks"), F.count_distinct("split_digest").alias("splits"), F.count_if(odd).alias("odd_scores"))
        .filter((F.col("banks") != 1) | (F.col("splits") != 1) | (F.col("odd_scores") > 0)))


def best_epoch(history: DataFrame, every: int, run: str = "run") -> DataFrame:
    """Earliest epoch with the highest metric among every k-th epoch and the last one."""
    last = history.groupBy(run).agg(F.max("epoch").alias("__last"))
    eligible = history.join(last, run).filter((F.col("epoch") % every == 0) | (F.col("epoch") == F.col("__last")))
    top = F.struct(F.col("metric"), (-F.col("epoch")).alias("back"))
    return eligible.groupBy(run).agg(F.max(top).alias("t")).select(
        run, (-F.col("t.back")).alias("best_epoch"), F.col("t.metric").alias("best_metric"))


def early_stop(history: DataFrame, patience: int, run: str = "run") -> DataFrame:
    """The first epoch with no strict improvement for ``patience`` epochs, NULL when never.

    An improvement is the first epoch that reaches a metric no earlier epoch reached. Per metric
    value only its first epoch matters, so improvements are the values whose first epoch comes
    before the first epoch of everything higher.
    """
    firsts = history.groupBy(run, "metric").agg(F.min("epoch").alias("first"))
    improving = _records(firsts, run)
    last = history.groupBy(run).agg(F.max("epoch").alias("last_epoch"))
    gaps = improving.withColumn("stop", F.col("first") + patience)
    ends = gaps.filter(F.col("next").isNull() | (F.col("next") > F.col("stop"))).groupBy(run).agg(F.min("stop").alias("stop"))
    return last.join(ends, run, "left").select(
        run, F.when(F.col("stop") <= F.col("last_epoch"), F.col("stop")).alias("stop_epoch"), "last_epoch")


def _records(firsts: DataFrame, run: str, block: int = 4096) -> DataFrame:
    """Strict running-maximum records per run, in two steps so that a long run is cut into blocks.

    Inside a block of epochs the running maximum is a window; a block starts from the maximum of
    the blocks before it. Both windows hold a bounded or much smaller number of rows.
    """
    from pyspark.sql.window import Window
    cells = firsts.withColumn("__cell", F.floor(F.col("first") / block))
    tops = cells.groupBy(run, "__cell").agg(F.max("metric").alias("__top"))
    before = Window.partitionBy(run).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = tops.select(run, "__cell", F.max("__top").over(before).alias("__start"))
    inside = Window.partitionBy(run, "__cell").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    local = cells.withColumn("__inside", F.max("metric").over(inside)).join(starts, [run, "__cell"])
    bar = F.greatest("__inside", "__start")     # NULLs are skipped
    records = local.filter(bar.isNull() | (F.col("metric") > bar)).select(run, "__cell", "first", "metric")
    following = Window.partitionBy(run, "__cell").orderBy("first")
    heads = records.groupBy(run, "__cell").agg(F.min("first").alias("__head"))
    after = Window.partitionBy(run).orderBy("__cell")
    heads = heads.select(run, "__cell", F.lead("__head").over(after).alias("__next_head"))
    return records.withColumn("__lead", F.lead("first").over(following)).join(heads, [run, "__cell"]).select(
        run, "first", "metric", F.coalesce("__lead", "__next_head").alias("next"))


def decision(score: Column, label: Column, threshold: Column) -> Column:
    flagged = score >= threshold
    return (F.when(flagged & (label == 1), "TP").when(flagged, "FP").when(label == 1, "FN").otherwise("TN"))


def gallery_cases(predictions: DataFrame, threshold: Column, limit: int = 3, image: str = "image") -> DataFrame:
    """Example cases per decision: worst false alarms, worst misses, evenly ranked successes.

    Ties follow the image name. One numbering of (decision, score, image) serves all four kinds.
    """
    if limit < 1:
        raise ValueError("the gallery limit must be positive")
    kind = decision(F.col("score"), F.col("label"), threshold)
    rows = predictions.select(image, "label", "score", kind.alias("decision"))
    # False alarms start from the highest score.
    rank = F.when(F.col("decision") == "FP", -F.col("score")).otherwise(F.col("score"))
    numbered = ordered_index(rows.withColumn("__rank", rank), ["decision"], ["__rank", image])
    m = F.least(F.lit(limit), F.col("n"))
    spread = F.transform(F.sequence(F.lit(0).cast("bigint"), m - 1),
                         lambda j: F.when(m > 1, F.floor(j * (F.col("n") - 1) / F.greatest(m - 1, F.lit(1)))).otherwise(F.lit(0)))
    place = F.when(F.col("decision").isin("TP", "TN"), F.array_position(spread, F.col("idx"))).otherwise(
        F.when(F.col("idx") < m, F.col("idx") + 1).otherwise(0))
    return numbered.withColumn("position", place).filter("position > 0").select("decision", "position", image, "label", "score")


def first_per_group(records: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    return records.groupBy(*keys).agg(F.min(path).alias(path))


def weakest_group(groups: DataFrame, run: str, group: str, value: str) -> DataFrame:
    return groups.groupBy(run).agg(F.min_by(group, F.struct(value, group)).alias("weakest"), F.min(value).alias("weakest_value"))


def best_per_metric(long: DataFrame, run: str) -> DataFrame:
    """Rows (run, metric, value): the best run of each metric, the smaller name on equal values."""
    return long.filter("value IS NOT NULL").groupBy("metric").agg(
        F.min_by(run, F.struct((-F.col("value")).alias("back"), F.col(run))).alias("best_run"), F.max("value").alias("best_value"))


# --- gates ----------------------------------------------------------------------------------

def quality_target(recall: Column, false_alarm: Column) -> Column:
    return F.coalesce((recall >= 0.90) & ~F.isnan(recall) & (false_alarm <= 0.10), F.lit(False))


def gate_family(candidates: DataFrame, control: DataFrame, keys: Sequence[str],
                gain: float = 0.01, old_loss: float = 0.02) -> DataFrame:
    """The best candidate that gains enough overall and loses little on the old families; NULL when none does.

    A group stops with another state where a value is no number in [0, 1], where it has not exactly one control, or where
    candidates and control do not share one bank and one split.
    """
    values = ["macro_h", "old_macro_h"]
    extra = [n for n in ("bank_digest", "split_digest") if n in candidates.columns and n in control.columns]
    both = (candidates.select(*keys, "candidate", *values, *extra, F.lit(False).alias("__control"))
            .unionByName(control.select(*keys, F.lit(None).cast(candidates.schema["candidate"].dataType).alias("candidate"), *values, *extra, F.lit(True).alias("__control"))))
    odd = F.lit(False)
    for name in values:
        odd = odd | ~(usable(F.col(name)) & F.coalesce(F.col(name).between(0, 1), F.lit(False)))
    own = F.col("__control")
    base = both.groupBy(*keys).agg(*[F.max(F.when(own, F.col(n))).alias(f"c_{n}") for n in values], F.count_if(odd).alias("__odd"),
                                   F.count_if(own).alias("__controls"), _foreign(both).alias("__mixed"))
    joined = candidates.join(base, list(keys), "right")
    eligible = ((F.col("__odd") == 0) & ~F.col("__mixed") & (F.col("__controls") == 1)
                & (F.col("macro_h") >= F.col("c_macro_h") + gain) & (F.col("old_macro_h") >= F.col("c_old_macro_h") - old_loss))
    order = F.struct((-F.col("macro_h")).alias("s"), F.col("candidate"))
    state = (F.when(F.max("__odd") > 0, "stopped_invalid_value").when(F.max("__mixed"), "stopped_mixed_evidence")
             .when(F.max("__controls") != 1, "stopped_no_single_control")
             .when(F.count_if(eligible) > 0, "passed").otherwise("stopped_no_validation_gain"))
    return joined.groupBy(*keys).agg(
        F.min(F.when(eligible, order)).alias("w"), F.count_if(eligible).alias("eligible"), state.alias("state")
    ).select(*keys, F.col("w.candidate").alias("selected"), "eligible", "state")


def _gate(passed: Column, wanted: Sequence[tuple[Column, str]], missing: Column) -> dict[str, Column]:
    """``passed`` and the first reason against it; a value that is missing or no number comes before all others."""
    reason = F.when(missing, "missing value")
    for good, name in wanted:
        reason = reason.when(~F.coalesce(good, F.lit(False)), name)
    return {"reason": reason, "passed": F.coalesce(passed, F.lit(False)) & ~missing}


def _absent(cell: Column, expected: Sequence[str] | None) -> Column:
    """True for a group without rows of an expected cell, or with several of one."""
    if expected is None:
        return F.count(cell) != F.count_distinct(cell)
    return (F.count_distinct(F.when(cell.isin(*expected), cell)) != len(expected)) | (F.count(cell) != F.count_distinct(cell))


def gate_pooled(pairs: DataFrame, keys: Sequence[str], gain: float = 0.01, loss: float = 0.01, conditions: Sequence[str] | None = None) -> DataFrame:
    """Rows (condition, control, candidate): the pooled value must gain, no condition may lose much.

    A value that is null or no finite number, a repeated condition, an absent one of ``conditions``, or none beside the pooled one fails the gate.
    """
    change = F.col("candidate") - F.col("control")
    pooled = F.col("condition") == "pooled"
    expected = None if conditions is None else ["pooled", *conditions]
    out = pairs.groupBy(*keys).agg(
        F.max(F.when(pooled, change)).alias("pooled_gain"), F.min(F.when(~pooled, change)).alias("worst_change"),
        ((F.count_if(~usable(change)) > 0) | (F.count_if(F.col("condition").isNull()) > 0) | (F.count_if(pooled) != 1)
         | (F.count_if(~pooled) == 0) | _absent(F.col("condition"), expected)).alias("__missing"))
    gained, kept = F.col("pooled_gain") >= gain, F.col("worst_change") >= -loss
    return out.withColumns(_gate(gained & kept, [(gained, "pooled gain too small"), (kept, "a condition loses")], F.col("__missing"))).drop("__missing")


def gate_shortfall(pairs: DataFrame, keys: Sequence[str], share: float = 0.1, loss: float = 0.01, cells: Sequence[str] | None = None) -> DataFrame:
    """Rows (metric, condition, control, candidate): close part of the distance to 1, lose nothing elsewhere.

    Fails closed as ``gate_pooled``; ``cells`` lists the expected 'metric/condition'.
    """
    change = F.col("candidate") - F.col("control")
    target = (F.col("condition") == "pooled") & (F.col("metric") == "image_pauc")
    cell = F.concat_ws("/", "metric", "condition")
    out = pairs.groupBy(*keys).agg(
        F.max(F.when(target, change)).alias("gain"), F.max(F.when(target, 1 - F.col("control"))).alias("shortfall"),
        F.min(F.when(~target, change)).alias("worst_change"),
        ((F.count_if(~usable(change)) > 0) | (F.count_if(F.col("metric").isNull() | F.col("condition").isNull()) > 0) | (F.count_if(target) != 1)
         | (F.count_if(~target) == 0) | _absent(cell, cells)).alias("__missing"))
    gained = (F.col("gain") > 0) & (F.col("gain") >= share * F.col("shortfall"))
    kept = F.col("worst_change") >= -loss
    reduction = F.when(F.col("shortfall") > 0, F.col("gain") / F.col("shortfall"))
    return out.withColumns({"reduction": reduction, **_gate(gained & kept, [(gained, "shortfall not closed"), (kept, "another value loses")], F.col("__missing"))}).drop("__missing")
