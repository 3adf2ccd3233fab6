"""Registered queries: intervals, selection, gates and replay of evidence."""

from pyspark.sql import functions as F

from gaugeframe.operators import evidence, ranking, rates, selection, uncertainty
from gaugeframe.operators.nested import nested_differences
from gaugeframe.plans.measure import COUNTS_SQL, curve_sql
from gaugeframe.plans.registry import query
from gaugeframe.views import Views, sql, sql_draw, sql_more

SAMPLES = 1000


def sql_word(seed: str, word: str, *parts: str) -> str:
    text = ", ".join([f"'{seed}'"] + [f"({p})::VARCHAR" for p in parts])
    return f"('0x' || substr(sha256(concat_ws('|', {text})), ({8} * ({word}) + 1)::BIGINT, 8))::UBIGINT::BIGINT"


def draws_sql(rows: str, key: str, seed: int) -> str:
    """weights(replicate, key, weight) of a class-wise resampling."""
    return f"""numbered AS (SELECT {key}, label, row_number() OVER (PARTITION BY label ORDER BY {sql_draw(seed, key)}, {key}) - 1 AS idx,
      count(*) OVER (PARTITION BY label) AS n FROM {rows}),
    drawn AS (SELECT r AS replicate, label, {sql_word(f'{seed}-draw', 'r % 8', 'label', 'idx', 'r // 8')} % n AS idx FROM numbered, range(0, {SAMPLES}) t(r)),
    counted AS (SELECT replicate, label, idx, count(*) AS weight FROM drawn GROUP BY ALL),
    weights AS (SELECT replicate, {key}, weight FROM counted JOIN numbered USING (label, idx))"""


WEIGHTED = """hist AS (SELECT {k}, score, sum(weight * label)::BIGINT AS pos, sum(weight * (1 - label))::BIGINT AS neg FROM {src} GROUP BY ALL),
  curve AS (SELECT *, (sum(neg) OVER (PARTITION BY {k} ORDER BY score) - neg)::BIGINT AS below FROM hist),
  areas AS (SELECT {k}, sum(pos * (below + neg / 2)) / (sum(pos)::DOUBLE * sum(neg)) AS area FROM curve GROUP BY {k})"""


@query(sql_more("predictions", draws_sql("predictions", "image", 42) + ", w AS (SELECT * FROM predictions JOIN weights USING (image)), "
                + WEIGHTED.format(k="replicate", src="w") + """
  SELECT count(*) AS samples, round(quantile_cont(area, 0.025), 8) AS lower, round(quantile_cont(area, 0.975), 8) AS upper FROM areas"""))
def bootstrap_auroc(v: Views):
    out = uncertainty.bootstrap_auroc(v.predictions(), SAMPLES, 42)
    return out.select("samples", F.round("lower", 8).alias("lower"), F.round("upper", 8).alias("upper"))


def _poisson_ladder() -> str:
    mass, term, parts = 0.0, 0.36787944117144233, []
    for k in range(12):
        mass += term
        parts.append(f"WHEN u < {mass!r}::DOUBLE THEN {k}")
        term /= k + 1
    return "CASE " + " ".join(parts) + " ELSE 12 END"


@query(sql_more("predictions", f"""u AS (SELECT r AS replicate, image, label, score, {sql_word('42-poisson', 'r % 8', 'image', 'r // 8')} / 4294967296.0::DOUBLE AS u FROM predictions, range(0, {SAMPLES}) t(r)),
  w AS (SELECT replicate, image, label, score, {_poisson_ladder()} AS weight FROM u), """ + WEIGHTED.format(k="replicate", src="w") + """
  SELECT count(*) AS samples, round(quantile_cont(area, 0.025), 8) AS lower, round(quantile_cont(area, 0.975), 8) AS upper FROM areas"""))
def bootstrap_auroc_poisson(v: Views):
    out = uncertainty.bootstrap_auroc(v.predictions(), SAMPLES, 42, method="poisson")
    return out.select("samples", F.round("lower", 8).alias("lower"), F.round("upper", 8).alias("upper"))


@query()
def bootstrap_auroc_split(v: Views):
    """Draws come from numpy, so tests compare it with full counts and with the drawn form."""
    out = uncertainty.bootstrap_auroc(v.predictions(), SAMPLES, 42, method="split")
    return out.select("samples", F.round("lower", 8).alias("lower"), F.round("upper", 8).alias("upper"))


CANDIDATE_SHIFT = 4000.0
PAIRED_SQL = f"""groups AS (SELECT DISTINCT group_id, label FROM conditions),
  {draws_sql('groups', 'group_id', 4000042)},
  runs AS (SELECT 0 AS run, group_id, label, score FROM conditions UNION ALL SELECT 1, group_id, label, score + label * {CANDIDATE_SHIFT} FROM conditions),
  w AS (SELECT * FROM runs JOIN weights USING (group_id)), {WEIGHTED.format(k='replicate, run', src='w')},
  d AS (SELECT replicate, sum(CASE WHEN run = 1 THEN area ELSE -area END) AS change FROM areas GROUP BY replicate),
  point AS (SELECT sum((CASE WHEN a.run = 1 THEN 1 ELSE -1 END) * CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END)
     / ((SELECT sum(label) FROM conditions) * (SELECT sum(1 - label) FROM conditions)::DOUBLE) AS difference
     FROM runs a JOIN runs b ON a.run = b.run AND a.label = 1 AND b.label = 0)"""


@query(sql_more("conditions", PAIRED_SQL + """ SELECT round(any_value(difference), 8) AS difference, round(quantile_cont(change, 0.025), 8) AS lower,
  round(quantile_cont(change, 0.975), 8) AS upper, count(*) AS samples FROM d, point"""))
def paired_bootstrap(v: Views):
    control = v.conditions()
    candidate = control.withColumn("score", F.col("score") + F.col("label") * CANDIDATE_SHIFT)
    out = uncertainty.paired_bootstrap(control, candidate, SAMPLES)
    return out.select(*[F.round(c, 8).alias(c) for c in ("difference", "lower", "upper")], "samples")


PARTIAL_PAIR_SQL = f"""groups AS (SELECT DISTINCT group_id, label FROM conditions),
  {draws_sql('groups', 'group_id', 5000042)},
  runs AS (SELECT 0 AS run, group_id, label, score FROM conditions UNION ALL SELECT 1, group_id, label, score + label * {CANDIDATE_SHIFT} FROM conditions),
  w AS (SELECT replicate, run, label, score, weight FROM runs JOIN weights USING (group_id) UNION ALL SELECT -1, run, label, score, 1 FROM runs),
  hist AS (SELECT replicate, run, score, sum(weight * label)::DOUBLE AS pos, sum(weight * (1 - label))::DOUBLE AS neg FROM w GROUP BY ALL),
  curve AS (SELECT *, sum(pos) OVER a AS tp, sum(neg) OVER a AS fp, sum(pos) OVER g AS P, sum(neg) OVER g AS N FROM hist
    WINDOW a AS (PARTITION BY replicate, run ORDER BY score DESC), g AS (PARTITION BY replicate, run)),
  shares AS (SELECT *, CASE WHEN neg > 0 THEN least(1.0, greatest(0.0, (0.1 * N - (fp - neg)) / neg)) ELSE 0.0 END AS part FROM curve),
  areas AS (SELECT replicate, run, 0.5 * (1 + (sum(part * neg * (tp - pos + part * pos / 2)) / (max(P) * max(N)) - 0.005) / (0.1 - 0.005)) AS area FROM shares GROUP BY replicate, run),
  d AS (SELECT replicate, sum(CASE WHEN run = 1 THEN area ELSE -area END) AS change FROM areas GROUP BY replicate)"""


@query(sql_more("conditions", PARTIAL_PAIR_SQL + """ SELECT round(max(change) FILTER (replicate = -1), 8) AS difference, round(quantile_cont(change, 0.025) FILTER (replicate >= 0), 8) AS lower,
  round(quantile_cont(change, 0.975) FILTER (replicate >= 0), 8) AS upper, count(*) FILTER (replicate >= 0) AS samples FROM d"""))
def paired_partial_area(v: Views):
    control = v.conditions()
    candidate = control.withColumn("score", F.col("score") + F.col("label") * CANDIDATE_SHIFT)
    out = uncertainty.paired_bootstrap(control, candidate, SAMPLES, 5_000_042, metric="partial_auroc")
    return out.select(*[F.round(c, 8).alias(c) for c in ("difference", "lower", "upper")], "samples")


# --- histories ------------------------------------------------------------------------------

@query("SELECT user_id AS run, round(sum(value * (1 + event_id % 8)) / sum(1 + event_id % 8), 8) AS mean_loss, sum(1 + event_id % 8)::BIGINT AS samples FROM events GROUP BY user_id")
def weighted_epoch_means(v: Views):
    n = 1 + F.col("event_id") % 8
    return v.table("events").groupBy(F.col("user_id").alias("run")).agg(
        F.round(F.sum(F.col("value") * n) / F.sum(n), 8).alias("mean_loss"), F.sum(n).alias("samples"))


@query("""WITH s AS (SELECT s_nationkey AS category, CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 11 = 0 THEN 'nan'::DOUBLE ELSE s_acctbal END AS v FROM supplier),
  f AS (SELECT category, CASE WHEN v IS NULL OR isnan(v) THEN NULL ELSE v END AS v FROM s)
  SELECT category, count(v) AS finite, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sample_std, min(v) AS minimum, max(v) AS maximum FROM f GROUP BY category""")
def seed_variability(v: Views):
    key = F.col("s_suppkey")
    value = F.when(key % 7 == 0, F.lit(None).cast("double")).when(key % 11 == 0, F.lit(float("nan"))).otherwise(F.col("s_acctbal"))
    finite = v.table("supplier").select(F.col("s_nationkey").alias("category"), value.alias("raw")).select(
        "category", F.when(~F.isnan("raw") & (F.abs("raw") < float("inf")), F.col("raw")).alias("value"))
    return finite.groupBy("category").agg(
        F.count("value").alias("finite"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sample_std"),
        F.min("value").alias("minimum"), F.max("value").alias("maximum"))


@query(sql("history", """SELECT run, epoch, component, value FROM (SELECT run, epoch, metric AS loss, metric * 0.5::DOUBLE AS validation, epoch::DOUBLE AS seconds FROM history)
  UNPIVOT (value FOR component IN (loss, validation, seconds))"""))
def history_curves(v: Views):
    wide = v.history().select("run", "epoch", F.col("metric").alias("loss"), (F.col("metric") * 0.5).alias("validation"), F.col("epoch").cast("double").alias("seconds"))
    return wide.unpivot(["run", "epoch"], ["loss", "validation", "seconds"], "component", "value")


@query(sql_more("history", """l AS (SELECT *, max(epoch) OVER (PARTITION BY run) AS last FROM history),
  r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY metric DESC, epoch) AS k FROM l WHERE epoch % 5 = 0 OR epoch = last)
  SELECT run, epoch AS best_epoch, metric AS best_metric FROM r WHERE k = 1"""))
def best_epoch(v: Views):
    return selection.best_epoch(v.history(), 5)


@query(sql_more("history", """m AS (SELECT *, max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, max(epoch) OVER (PARTITION BY run) AS last FROM history),
  i AS (SELECT *, max(CASE WHEN before IS NULL OR metric > before THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS improved FROM m)
  SELECT run, min(epoch) FILTER (epoch - improved >= 15) AS stop_epoch, max(last) AS last_epoch FROM i GROUP BY run"""))
def early_stop_epoch(v: Views):
    return selection.early_stop(v.history(), 15)


# --- choice ---------------------------------------------------------------------------------

GALLERY = """d AS (SELECT image, label, score, CASE WHEN score >= 4000 THEN CASE WHEN label = 1 THEN 'TP' ELSE 'FP' END WHEN label = 1 THEN 'FN' ELSE 'TN' END AS decision FROM predictions),
  o AS (SELECT *, row_number() OVER (PARTITION BY decision ORDER BY CASE WHEN decision = 'FP' THEN -score ELSE score END, image) - 1 AS idx, count(*) OVER (PARTITION BY decision) AS n FROM d),
  s AS (SELECT *, least(3, n) AS m FROM o),
  gallery AS (SELECT decision, idx + 1 AS position, image, label, score FROM s WHERE decision IN ('FP', 'FN') AND idx < m
    UNION ALL SELECT decision, j + 1, image, label, score FROM s, range(0, 3) t(j) WHERE decision IN ('TP', 'TN') AND j < m AND idx = CASE WHEN m > 1 THEN (j * (n - 1)) // (m - 1) ELSE 0 END)"""


@query(sql_more("predictions", GALLERY + " SELECT decision, position, image, label, score FROM gallery"))
def gallery_cases(v: Views):
    return selection.gallery_cases(v.predictions(), F.lit(4000.0), 3)


@query(sql("records", "SELECT defect, label, min(path) AS path FROM records GROUP BY defect, label"))
def first_per_group(v: Views):
    return selection.first_per_group(v.records(), ["defect", "label"], "path")


@query(sql_more("candidates", """p AS (SELECT *, max(validation_score) OVER (PARTITION BY category) AS best, count(*) OVER (PARTITION BY category) AS candidates FROM candidates WHERE kind <> 'baseline'),
  t AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY latency, checkpoint_sha256) AS k, count(*) OVER (PARTITION BY category) AS tied FROM p WHERE best - validation_score <= 1e-12),
  o AS (SELECT category, CASE WHEN count(*) FILTER (validation_score IS NULL OR isnan(validation_score) OR validation_score NOT BETWEEN 0 AND 1) > 0 THEN 'score outside [0, 1]' END AS reason FROM p GROUP BY category)
  SELECT category, CASE WHEN reason IS NULL THEN checkpoint_sha256 END AS checkpoint_sha256, CASE WHEN reason IS NULL THEN validation_score END AS validation_score,
    CASE WHEN reason IS NULL THEN tied END AS tied, candidates, reason FROM t JOIN o USING (category) WHERE k = 1"""))
def select_best(v: Views):
    return selection.select_best(v.candidates(), ["category"])


@query(sql_more("predictions", f"""c AS (SELECT category, defect, {COUNTS_SQL.format(t=2000)} FROM predictions GROUP BY ALL),
  r AS (SELECT category, defect, tp / (tp + fn) AS recall FROM c WHERE tp + fn > 0),
  w AS (SELECT category, defect AS weakest, recall AS weakest_value, row_number() OVER (PARTITION BY category ORDER BY recall, defect) AS k FROM r)
  SELECT category, weakest, round(weakest_value, 8) AS weakest_value, category = (SELECT category FROM r GROUP BY category ORDER BY max(recall) DESC, category LIMIT 1) AS holds_best FROM w WHERE k = 1"""))
def weakest_and_best(v: Views):
    groups = rates.recall_by_group(v.predictions(), F.lit(2000.0), ["category", "defect"])
    best = groups.groupBy("category").agg(F.max("recall").alias("r")).agg(
        F.min_by("category", F.struct((-F.col("r")).alias("b"), F.col("category"))).alias("best_category"))
    weakest = selection.weakest_group(groups, "category", "defect", "recall")
    return weakest.select(
        "category", "weakest", F.round("weakest_value", 8).alias("weakest_value"), (F.col("category") == best.scalar()).alias("holds_best"))


@query(sql_more("predictions", f"""c AS (SELECT category, {COUNTS_SQL.format(t=4000)} FROM predictions GROUP BY category), {curve_sql('predictions', 'category')},
  m AS (SELECT category, sum(pos * (N - fp + neg / 2)) / nullif(max(P) * max(N), 0) AS auroc, sum(pos * tp / (tp + fp)) / nullif(max(P), 0) AS ap FROM curve GROUP BY category),
  l AS (SELECT category, unnest(['recall', 'auroc', 'ap']) AS metric, unnest([tp / nullif(tp + fn, 0), auroc, ap]) AS value FROM c JOIN m USING (category))
  SELECT metric, first(category ORDER BY round(value, 10) DESC, category) AS best_run, round(max(value), 8) AS best_value FROM l WHERE value IS NOT NULL GROUP BY metric"""))
def best_per_metric(v: Views):
    from gaugeframe.sources.evidence_files import long_metrics
    rows = v.predictions()
    wide = rates.confusion(rows, F.lit(4000.0), ["category"]).select("category", "recall").join(
        ranking.ranking_metrics(rows, ["category"]).select("category", "auroc", "ap"), "category")
    long = long_metrics(wide, ["category"]).withColumn("value", F.round("value", 10))
    return selection.best_per_metric(long, "category").withColumn("best_value", F.round("best_value", 8))


@query(sql_more("predictions", f"""c AS (SELECT category, defect, {COUNTS_SQL.format(t=2000)} FROM predictions GROUP BY ALL)
  SELECT category, defect, coalesce(tp / nullif(tp + fn, 0) >= 0.90 AND fp / nullif(fp + tn, 0) <= 0.10, false) AS met FROM c"""))
def quality_target(v: Views):
    out = rates.confusion(v.predictions(), F.lit(2000.0), ["category", "defect"])
    return out.select("category", "defect", selection.quality_target(F.col("recall"), F.col("false_alarm_rate")).alias("met"))


SCREEN = """s AS (SELECT category, seed, validation_score AS macro_h, round(((seed * 37) % 100) / 100.0, 2)::DOUBLE AS old_macro_h, min(seed) OVER (PARTITION BY category) AS control FROM candidates)"""


@query(sql_more("candidates", SCREEN + """, k AS (SELECT category, macro_h AS c, old_macro_h AS o FROM s WHERE seed = control),
  e AS (SELECT category, seed AS candidate, macro_h, macro_h >= c + 0.01::DOUBLE AND old_macro_h >= o - 0.02::DOUBLE AS ok FROM s JOIN k USING (category) WHERE seed <> control)
  SELECT category, first(candidate ORDER BY macro_h DESC, candidate) FILTER (ok) AS selected, count(*) FILTER (ok) AS eligible,
    CASE WHEN count(*) FILTER (ok) > 0 THEN 'passed' ELSE 'stopped_no_validation_gain' END AS state FROM (SELECT DISTINCT category FROM s) LEFT JOIN e USING (category) GROUP BY category"""))
def gate_family(v: Views):
    rows = v.candidates().select("category", F.col("seed").alias("candidate"), F.col("validation_score").alias("macro_h"),
                                 F.round(((F.col("seed") * 37) % 100) / 100.0, 2).alias("old_macro_h"))
    first = rows.groupBy("category").agg(F.min("candidate").alias("control_seed"))
    marked = rows.join(first, "category")
    is_control = F.col("candidate") == F.col("control_seed")
    return selection.gate_family(marked.filter(~is_control), marked.filter(is_control), ["category"])


PAIRS = """b AS (SELECT p_brand AS screen, p_type AS condition, (sum(p_partkey) % 9)::BIGINT AS k, round(avg(p_size) / 60, 6) AS control FROM part GROUP BY ALL),
  q AS (SELECT screen, condition, control, control + (k - 1) / 100.0::DOUBLE AS candidate FROM b),
  pairs AS (SELECT * FROM q UNION ALL SELECT screen, 'pooled', avg(control), avg(candidate) FROM q GROUP BY screen)"""


def gate_pairs(v: Views):
    cells = v.table("part").groupBy(F.col("p_brand").alias("screen"), F.col("p_type").alias("condition")).agg(
        (F.sum("p_partkey") % 9).alias("k"), F.round(F.avg("p_size") / 60, 6).alias("control"))
    q = cells.select("screen", "condition", "control", (F.col("control") + (F.col("k") - 1) / 100.0).alias("candidate"))
    pooled = q.groupBy("screen").agg(F.lit("pooled").alias("condition"), F.avg("control").alias("control"), F.avg("candidate").alias("candidate"))
    return q.unionByName(pooled)


@query(f"""WITH {PAIRS} SELECT screen, round(max(candidate - control) FILTER (condition = 'pooled'), 8) AS pooled_gain, round(min(candidate - control) FILTER (condition <> 'pooled'), 8) AS worst_change,
  CASE WHEN count(*) FILTER (candidate - control IS NULL OR NOT isfinite(candidate - control)) > 0 THEN 'missing value' WHEN NOT max(candidate - control) FILTER (condition = 'pooled') >= 0.01::DOUBLE THEN 'pooled gain too small'
    WHEN NOT min(candidate - control) FILTER (condition <> 'pooled') >= -0.01::DOUBLE THEN 'a condition loses' END AS reason, reason IS NULL AS passed FROM pairs GROUP BY screen""")
def gate_pooled(v: Views):
    return selection.gate_pooled(gate_pairs(v), ["screen"]).withColumns(
        {c: F.round(c, 8) for c in ("pooled_gain", "worst_change")})


@query(f"""WITH {PAIRS}, m AS (SELECT screen, condition, 'image_pauc' AS metric, control, candidate FROM pairs UNION ALL SELECT screen, condition, 'pixel_ap', control * 0.5::DOUBLE, candidate * 0.5::DOUBLE FROM pairs),
  g AS (SELECT screen, max(candidate - control) FILTER (condition = 'pooled' AND metric = 'image_pauc') AS gain, max(1 - control) FILTER (condition = 'pooled' AND metric = 'image_pauc') AS shortfall,
    min(candidate - control) FILTER (condition <> 'pooled' OR metric <> 'image_pauc') AS worst, count(*) FILTER (candidate - control IS NULL OR NOT isfinite(candidate - control)) AS bad FROM m GROUP BY screen)
  SELECT screen, round(gain, 8) AS gain, round(shortfall, 8) AS shortfall, round(worst, 8) AS worst_change, CASE WHEN shortfall > 0 THEN round(gain / shortfall, 8) END AS reduction,
    CASE WHEN bad > 0 THEN 'missing value' WHEN NOT (gain > 0 AND gain >= 0.1::DOUBLE * shortfall) THEN 'shortfall not closed' WHEN NOT worst >= -0.01::DOUBLE THEN 'another value loses' END AS reason,
    reason IS NULL AS passed FROM g""")
def gate_shortfall(v: Views):
    pairs = gate_pairs(v)
    both = pairs.withColumn("metric", F.lit("image_pauc")).unionByName(
        pairs.withColumns({"control": F.col("control") * 0.5, "candidate": F.col("candidate") * 0.5}).withColumn("metric", F.lit("pixel_ap")))
    out = selection.gate_shortfall(both, ["screen"])
    return out.withColumns({c: F.round(c, 8) for c in ("gain", "shortfall", "worst_change", "reduction")})


# --- evidence -------------------------------------------------------------------------------

@query(sql_more("predictions", f"""m(category, metric) AS (SELECT category, unnest(['tp', 'fp', 'tn', 'fn', 'recall', 'false_alarm_rate', 'precision', 'auroc', 'ap', 'recall_low', 'recall_high']) FROM predictions GROUP BY category)
  SELECT category, metric, CASE WHEN category = 'fr' AND metric = 'tp' THEN 'not reported' ELSE 'differs' END AS reason FROM m
  WHERE (category = 'de' AND metric IN ('recall', 'auroc')) OR (category = 'fr' AND metric = 'tp') OR (category = 'es' AND metric = 'recall_high')"""))
def recompute_check(v: Views):
    from gaugeframe.sources.evidence_files import long_metrics
    rows = v.predictions()

    def replay(frame):
        counted = rates.with_intervals(rates.confusion(frame, F.lit(4000.0), ["category"]))
        wide = counted.join(ranking.ranking_metrics(frame, ["category"]).select("category", "auroc", "ap"), "category")
        wide = wide.withColumns({"recall_low": F.col("recall_interval.lower"), "recall_high": F.col("recall_interval.upper")})
        return long_metrics(wide.drop("recall_interval", "false_alarm_interval", "precision_interval"), ["category"])
    truth = replay(rows)
    category, metric = F.col("category"), F.col("metric")
    bump = F.when((category == "de") & metric.isin("recall", "auroc"), 1e-6).when((category == "es") & (metric == "recall_high"), 1e-3).otherwise(0.0)
    reported = truth.withColumn("value", F.col("value") + bump).filter(~((category == "fr") & (metric == "tp")))
    return evidence.differing_metrics(reported, truth, ["category"], relative=1e-9).select("category", "metric", "reason")


@query(sql("predictions", """SELECT category, image::VARCHAR AS subject, 'decision' AS reason FROM predictions WHERE image % 37 = 0
  UNION ALL SELECT category, NULL, 'several thresholds' FROM predictions GROUP BY category HAVING count(*) FILTER (image % 101 = 0) > 0 AND count(*) FILTER (image % 101 <> 0) > 0"""))
def decision_consistency(v: Views):
    threshold = F.when(F.col("image") % 101 == 0, 3999.5).otherwise(4000.0)
    right = F.col("score") >= F.col("threshold")
    stored = v.predictions().withColumn("threshold", threshold).withColumn(
        "predicted_defective", F.when(F.col("image") % 37 == 0, ~right).otherwise(right))
    return evidence.decision_violations(stored, ["category"], "image")


@query(sql("predictions", """SELECT category, round(quantile_cont(score, 0.9) + 0.5, 6) AS stored, round(quantile_cont(score, 0.9), 6) AS replayed FROM predictions
  WHERE label = 0 AND category IN ('es', 'fr') GROUP BY category"""))
def threshold_replay(v: Views):
    replayed = rates.normal_threshold(v.predictions(), 0.9, ["category"])
    stored = replayed.withColumn("threshold", F.col("threshold") + F.when(F.col("category").isin("es", "fr"), 0.5).otherwise(0.0))
    out = evidence.threshold_violations(stored, replayed, ["category"])
    return out.select("category", F.round("stored", 6).alias("stored"), F.round("replayed", 6).alias("replayed"))


@query("""WITH d AS (SELECT c_custkey AS record, c_name, c_nationkey::VARCHAR AS c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 23 <> 0),
  a AS (SELECT c_custkey AS record, CASE WHEN c_custkey % 17 = 0 THEN c_name || '!' ELSE c_name END AS c_name, (c_nationkey + (c_custkey % 29 = 0)::INT)::VARCHAR AS c_nationkey,
    CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 19 <> 0),
  dl AS (SELECT record, unnest(['c_name', 'c_nationkey', 'c_mktsegment']) AS field, unnest([c_name, c_nationkey, c_mktsegment]) AS declared, true AS hd FROM d),
  al AS (SELECT record, unnest(['c_name', 'c_nationkey', 'c_mktsegment']) AS field, unnest([c_name, c_nationkey, c_mktsegment]) AS actual, true AS ha FROM a)
  SELECT record, field, declared, actual, CASE WHEN ha IS NULL THEN 'removed' WHEN hd IS NULL THEN 'added' ELSE 'changed' END AS reason
  FROM dl FULL JOIN al USING (record, field) WHERE ha IS NULL OR hd IS NULL OR declared IS DISTINCT FROM actual""")
def frozen_record_diff(v: Views):
    rows = v.table("customer").withColumnRenamed("c_custkey", "record")
    i = F.col("record")
    actual = rows.filter(i % 19 != 0).withColumns({
        "c_name": F.when(i % 17 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")),
        "c_nationkey": F.col("c_nationkey") + F.when(i % 29 == 0, 1).otherwise(0),
        "c_mktsegment": F.when(i % 31 != 0, F.col("c_mktsegment"))})
    return evidence.record_differences(rows.filter(i % 23 != 0), actual, "record", ["c_name", "c_nationkey", "c_mktsegment"])


@query("""WITH c AS (SELECT c_custkey AS record, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer),
  kept AS (SELECT * FROM c WHERE record % 19 <> 0 AND record % 23 <> 0)
  SELECT record, '/place/nation' AS path, nation::VARCHAR AS declared, CASE WHEN record % 41 = 0 THEN '"' || nation || '"' ELSE (nation + 1)::VARCHAR END AS actual,
    CASE WHEN record % 41 = 0 THEN 'type' ELSE 'changed' END AS reason FROM kept WHERE record % 41 = 0 OR record % 29 = 0
  UNION ALL SELECT record, '/place/segment', '"' || segment || '"', NULL, 'removed' FROM kept WHERE record % 31 = 0
  UNION ALL SELECT record, '/place/note', NULL, '{"by":"' || name || '","n":1}', 'added' FROM kept WHERE record % 37 = 0
  UNION ALL SELECT record, '/codes/1/deep', (record % 7)::VARCHAR, (record % 7 + 100)::VARCHAR, 'changed' FROM kept WHERE record % 43 = 0
  UNION ALL SELECT record, '', '{"codes":[' || record % 5 || ',{"deep":' || record % 7 || '}],"name":"' || name || '","place":{"nation":' || nation || ',"segment":"' || segment || '"}}', NULL, 'removed'
    FROM c WHERE record % 19 = 0 AND record % 23 <> 0""")
def nested_record_diff(v: Views):
    i, nation = F.col("c_custkey"), F.col("c_nationkey")
    place = [F.when(i % 31 != 0, F.col("c_mktsegment")).alias("segment"),
             F.when(i % 37 == 0, F.struct(F.col("c_name").alias("by"), F.lit(1).alias("n"))).alias("note")]
    def body(place: list, deep):
        codes = F.format_string('[%d,{"deep":%d}]', i % 5, deep)
        return F.concat(F.lit('{"name":'), F.concat(F.lit('"'), "c_name", F.lit('"')), F.lit(',"place":'), F.to_json(F.struct(*place)),
                        F.lit(',"codes":'), codes, F.lit("}"))
    rows = v.table("customer")
    declared = rows.filter(i % 23 != 0).select(i.alias("record"), body([nation.alias("nation"), F.col("c_mktsegment").alias("segment")], i % 7).alias("body"))
    texts = body([nation.cast("string").alias("nation"), *place], i % 7 + F.when(i % 43 == 0, 100).otherwise(0))
    numbers = body([(nation + F.when(i % 29 == 0, 1).otherwise(0)).alias("nation"), *place], i % 7 + F.when(i % 43 == 0, 100).otherwise(0))
    actual = rows.filter((i % 19 != 0) & (i % 23 != 0)).select(i.alias("record"), F.when(i % 41 == 0, texts).otherwise(numbers).alias("body"))
    return nested_differences(declared, actual, "record", "body")


@query("""WITH f AS (SELECT o_custkey, max(o_orderdate) AS frozen_at FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY o_custkey)
  SELECT o_orderkey AS evaluation, strftime(o_orderdate, '%Y-%m-%d') AS started FROM orders LEFT JOIN f USING (o_custkey) WHERE o_orderpriority = '1-URGENT' AND (frozen_at IS NULL OR o_orderdate < frozen_at)""")
def ordering_check(v: Views):
    orders = v.table("orders")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")       # saved as zoned ISO text
    evaluations = orders.filter(urgent).select("o_custkey", F.col("o_orderkey").alias("evaluation"), F.to_timestamp(text).alias("started_at"))
    freezes = orders.filter(~urgent).select("o_custkey", F.to_timestamp(text).alias("frozen_at"))
    out = evidence.started_too_early(evaluations, freezes, ["o_custkey"])
    return out.select("evaluation", F.date_format("started_at", "yyyy-MM-dd").alias("started"))


@query("SELECT p_brand AS brand, p_size AS size, count(*) AS runs FROM part GROUP BY ALL HAVING count(DISTINCT p_type) > 1")
def config_agreement(v: Views):
    config = F.create_map(F.lit("type"), F.col("p_type"), F.lit("seed"), F.col("p_partkey").cast("string"))
    runs = v.table("part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), config.alias("config"))
    return evidence.config_disagreements(runs, ["brand", "size"], "config", ["seed"])


@query("SELECT o_custkey AS run, count(*) AS steps, count(*) FILTER (o_orderstatus <> 'F') AS open_steps FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus <> 'F') > 0")
def all_complete(v: Views):
    return evidence.incomplete_runs(v.table("orders").withColumnRenamed("o_custkey", "run"), "run", F.col("o_orderstatus") == "F")


@query(sql_more("predictions", GALLERY + """, stored AS (SELECT CASE WHEN w.decision = 'TN' AND position = 1 THEN 'TP' ELSE w.decision END AS decision, image, label,
    score + CASE WHEN w.decision = 'FP' AND position = 1 THEN 1 ELSE 0 END AS score FROM gallery w WHERE NOT (w.decision = 'TN' AND position = 2)
    UNION ALL SELECT decision, image, label, score FROM gallery WHERE decision = 'FN' AND position = 1),
  g AS (SELECT decision, image, max(score) AS s FROM stored GROUP BY ALL), t AS (SELECT image, count(*) AS n FROM stored GROUP BY image),
  k AS (SELECT g.decision, g.image, n, s, p.score, CASE WHEN p.score >= 4000 THEN CASE WHEN label = 1 THEN 'TP' ELSE 'FP' END WHEN label = 1 THEN 'FN' ELSE 'TN' END AS own
    FROM g JOIN t USING (image) JOIN predictions p USING (image))
  SELECT decision, image::VARCHAR AS subject, CASE WHEN n > 1 THEN 'repeated' WHEN decision <> own THEN 'group' ELSE 'score' END AS reason
    FROM k WHERE n > 1 OR decision <> own OR s <> score
  UNION ALL SELECT c.decision, NULL, 'group size' FROM (SELECT decision, count(*) AS n FROM d GROUP BY 1) c LEFT JOIN (SELECT decision, count(DISTINCT image) AS k FROM stored GROUP BY 1) s USING (decision)
    WHERE coalesce(k, 0) <> least(3, n)"""))
def gallery_check(v: Views):
    predictions = v.predictions()
    gallery = selection.gallery_cases(predictions, F.lit(4000.0), 3)
    kind, place = F.col("decision"), F.col("position")
    stored = gallery.filter(~((kind == "TN") & (place == 2))).withColumn(
        "score", F.col("score") + F.when((kind == "FP") & (place == 1), 1.0).otherwise(0.0))
    stored = stored.unionByName(gallery.filter((kind == "FN") & (place == 1)))
    stored = stored.withColumn("decision", F.when((kind == "TN") & (place == 1), "TP").otherwise(kind))
    available = predictions.groupBy(selection.decision(F.col("score"), F.col("label"), F.lit(4000.0)).alias("decision")).agg(F.count(F.lit(1)).alias("available"))
    return evidence.gallery_violations(stored, predictions, available, 3, threshold=F.lit(4000.0))
