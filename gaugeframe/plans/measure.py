"""Registered queries: scoring, calibration, rates and ranking metrics."""

from pyspark.sql import functions as F

from gaugeframe.functions import scalar
from gaugeframe.operators import grids, ranking, rates, scoring
from gaugeframe.operators.order_statistics import selected_quantiles, top_means
from gaugeframe.operators.prefix import exact_quantiles, hash_index
from gaugeframe.plans.registry import query
from gaugeframe.views import Views, sql, sql_draw, sql_more

WILSON_SQL = """
  CASE WHEN {n} > 0 THEN round(greatest(0, ({s}::DOUBLE/{n} + 3.841458820694124/(2*{n})) / (1+3.841458820694124/{n})
    - 1.959963984540054*sqrt({s}::DOUBLE/{n}*(1-{s}::DOUBLE/{n})/{n} + 3.841458820694124/(4.0*{n}*{n}))/(1+3.841458820694124/{n})), 8) END AS {name}_low,
  CASE WHEN {n} > 0 THEN round(least(1, ({s}::DOUBLE/{n} + 3.841458820694124/(2*{n})) / (1+3.841458820694124/{n})
    + 1.959963984540054*sqrt({s}::DOUBLE/{n}*(1-{s}::DOUBLE/{n})/{n} + 3.841458820694124/(4.0*{n}*{n}))/(1+3.841458820694124/{n})), 8) END AS {name}_high"""


def wilson_sql(s: str, n: str, name: str) -> str:
    return WILSON_SQL.format(s=f"({s})", n=f"({n})", name=name)


def r8(*names: str):
    return {n: F.round(n, 8) for n in names}


def interval_columns(df, *names: str):
    for name in names:
        df = (df.withColumn(f"{name}_low", F.round(F.col(f"{name}_interval.lower"), 8))
              .withColumn(f"{name}_high", F.round(F.col(f"{name}_interval.upper"), 8)).drop(f"{name}_interval"))
    return df


CURVE = """hist AS (SELECT {k} score, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg FROM {src} GROUP BY ALL),
  curve AS (SELECT *, (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp,
     (sum(pos) OVER p)::BIGINT AS P, (sum(neg) OVER p)::BIGINT AS N FROM hist
     WINDOW w AS ({part} ORDER BY score DESC), p AS ({part}))"""


def curve_sql(src: str, keys: str = "") -> str:
    return CURVE.format(src=src, k=f"{keys}," if keys else "", part=f"PARTITION BY {keys}" if keys else "")


PARTIAL_SQL = """round(0.5*(1+(sum(CASE WHEN (fp-neg)/N::DOUBLE >= 0.1 THEN 0
    WHEN fp/N::DOUBLE <= 0.1 THEN (neg/N::DOUBLE)*((tp-pos)+tp)/(2.0*P)
    ELSE (0.1-(fp-neg)/N::DOUBLE)*(2.0*(tp-pos)/P + (pos/P::DOUBLE)*(0.1-(fp-neg)/N::DOUBLE)/(neg/N::DOUBLE))/2 END)-0.005)/(0.1-0.005)), 8)"""


# --- the flagship question ------------------------------------------------------------------

def held_out_rates(v: Views, keys=("category",), q: float = 0.9):
    """Recall and false-alarm rate per category at the threshold calibrated on held-out normals."""
    labelled = v.predictions().select("image", "category", "defect", "label", "score")
    numbered = hash_index(labelled.filter(F.col("label") == 0), ["category"],
                          F.sha2(F.concat_ws("|", F.lit("hold"), F.col("category"), F.col("image").cast("string")), 256), ["image"])
    held = numbered.filter(F.col("idx") < F.greatest(F.lit(1), F.bround(F.col("n") * 0.5)))
    thresholds = exact_quantiles(held, ["category"], "score", {"threshold": q}, source=labelled).select("category", "threshold")
    rest = labelled.join(held.select("image"), "image", "left_anti")
    measured = rest.join(thresholds, "category").groupBy("category", "threshold").agg(*rates.confusion_counts(F.col("threshold")))
    return interval_columns(rates.with_intervals(rates.with_rates(measured)), "recall", "false_alarm", "precision").withColumns(
        r8("threshold", "recall", "false_alarm_rate", "precision"))


@query(sql_more("predictions", f"""
  numbered AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {sql_draw('hold', 'category', 'image')}, image) - 1 AS idx,
     count(*) OVER (PARTITION BY category) AS n FROM predictions WHERE label = 0),
  held AS (SELECT * FROM numbered WHERE idx < greatest(1, round_even(n * 0.5, 0))),
  cuts AS (SELECT category, quantile_cont(score, 0.9) AS t FROM held GROUP BY category),
  c AS (SELECT category, t, count(*) FILTER (score >= t AND label = 1) AS tp, count(*) FILTER (score >= t AND label = 0) AS fp,
     count(*) FILTER (score < t AND label = 0) AS tn, count(*) FILTER (score < t AND label = 1) AS fn
     FROM predictions JOIN cuts USING (category) WHERE image NOT IN (SELECT image FROM held) GROUP BY ALL)
  SELECT category, round(t, 8) AS threshold, tp, fp, tn, fn,
    CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 8) END AS recall,
    CASE WHEN fp + tn > 0 THEN round(fp / (fp + tn), 8) END AS false_alarm_rate,
    CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 8) END AS precision,
    {wilson_sql('tp', 'tp+fn', 'recall')}, {wilson_sql('fp', 'fp+tn', 'false_alarm')}, {wilson_sql('tp', 'tp+fp', 'precision')} FROM c"""))
def calibrated_rates(v: Views):
    return held_out_rates(v)


# --- scores from maps -----------------------------------------------------------------------

@query(sql_more("pixels", """
  ranked AS (SELECT image, score, row_number() OVER (PARTITION BY image ORDER BY score DESC) AS r,
    count(*) OVER (PARTITION BY image) AS n FROM pixels WHERE valid)
  SELECT image, n AS valid_pixels, greatest(1, floor(n * 0.01))::BIGINT AS top_k, round(avg(score), 8) AS score
  FROM ranked WHERE r <= greatest(1, floor(n * 0.01)) GROUP BY image, n"""))
def top_fraction_mean(v: Views):
    return scoring.top_fraction_mean(v.pixels()).withColumns(r8("score"))


@query(sql("pixels", """SELECT image, count(*) AS pixels, sum(label)::BIGINT AS positive_pixels, round(avg(label), 8) AS positive_fraction,
  max(label) AS label, (sum(label) FILTER (valid))::BIGINT AS valid_positive_pixels FROM pixels GROUP BY image"""))
def mask_fraction(v: Views):
    pixels = v.pixels()
    kept = F.sum(F.when(F.col("valid"), F.col("label"))).alias("valid_positive_pixels")
    return pixels.groupBy("image").agg(
        F.count(F.lit(1)).alias("pixels"), F.sum("label").alias("positive_pixels"),
        F.round(F.avg("label"), 8).alias("positive_fraction"), F.max("label").alias("label"), kept)


@query(sql_more("pixels", """z AS (SELECT image, valid::INT AS m, label AS t, (score - 0.5) * 4 AS z FROM pixels),
  l AS (SELECT image, m, t, 1/(1+exp(-z)) AS p, m * CASE WHEN t = 1 THEN -3*ln(1/(1+exp(-z))) ELSE -ln(1-1/(1+exp(-z))) END AS b FROM z),
  i AS (SELECT image, sum(b) AS b, sum(m) AS m, 1-(2*sum(p*m*t)+1)/(sum(p*m)+sum(t*m)+1) AS d, sum(abs(p-t)*m) AS a FROM l GROUP BY image)
  SELECT round(sum(b)/sum(m), 8) AS bce, round(avg(d), 8) AS dice, round(sum(a)/sum(m), 8) AS l1, count(*) AS images FROM i"""))
def pixel_losses(v: Views):
    return scoring.pixel_losses(v.pixels(), (F.col("score") - 0.5) * 4).withColumns(r8("bce", "dice", "l1"))


@query(sql("pixels", """SELECT image,
  CASE WHEN sum(label) > 0 THEN round(count(*) FILTER (label = 1 AND score <= 0.3) / sum(label), 8) END AS outside_foreground,
  round(avg(label), 8) AS mask_fraction, round(avg((score > 0.3)::INT), 8) AS foreground_fraction FROM pixels GROUP BY image"""))
def coverage_outside(v: Views):
    return scoring.coverage(v.pixels(), F.col("score") > 0.3).withColumns(
        r8("outside_foreground", "mask_fraction", "foreground_fraction"))


# --- calibration and rates ------------------------------------------------------------------

@query(sql_more("predictions", """t AS (SELECT category, quantile_cont(score, 0.9) AS threshold, count(*) AS normal_count, stddev_pop(score) AS sd
    FROM predictions WHERE label = 0 GROUP BY category)
  SELECT category, round(threshold, 8) AS threshold, normal_count, count(*) FILTER (score >= threshold) AS exceedances, round(sd, 6) AS score_std
  FROM predictions JOIN t USING (category) WHERE label = 0 GROUP BY category, threshold, normal_count, sd"""))
def quantile_threshold(v: Views):
    return rates.normal_threshold(v.predictions(), 0.9, ["category"]).withColumns(
        {"threshold": F.round("threshold", 8), "score_std": F.round("score_std", 6)})


RATES_SQL = """tp, fp, tn, fn, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 8) END AS recall,
    CASE WHEN fp + tn > 0 THEN round(fp / (fp + tn), 8) END AS false_alarm_rate,
    CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 8) END AS precision"""
COUNTS_SQL = """count(*) FILTER (score >= {t} AND label = 1) AS tp, count(*) FILTER (score >= {t} AND label = 0) AS fp,
     count(*) FILTER (score < {t} AND label = 0) AS tn, count(*) FILTER (score < {t} AND label = 1) AS fn"""


@query(sql_more("predictions", f"""c AS (SELECT category, {COUNTS_SQL.format(t=4000)} FROM predictions GROUP BY category)
  SELECT category, {RATES_SQL} FROM c"""))
def confusion(v: Views):
    return rates.confusion(v.predictions(), F.lit(4000.0), ["category"]).withColumns(r8("recall", "false_alarm_rate", "precision"))


@query(sql_more("predictions", f"""c AS (SELECT category, {COUNTS_SQL.format(t=4000)} FROM predictions GROUP BY category)
  SELECT category, tp, fp, tn, fn, {wilson_sql('tp', 'tp+fn', 'recall')}, {wilson_sql('fp', 'fp+tn', 'false_alarm')},
  {wilson_sql('tp', 'tp+fp', 'precision')} FROM c"""))
def wilson_interval(v: Views):
    counts = v.predictions().groupBy("category").agg(*rates.confusion_counts(F.lit(4000.0)))
    return interval_columns(rates.with_intervals(counts), "recall", "false_alarm", "precision")


@query(sql("predictions", """SELECT category, defect, count(*) AS images, count(*) FILTER (score >= 2000) AS detected,
  round(count(*) FILTER (score >= 2000) / count(*), 8) AS recall FROM predictions WHERE label = 1 GROUP BY category, defect"""))
def recall_by_defect(v: Views):
    return rates.recall_by_group(v.predictions(), F.lit(2000.0), ["category", "defect"]).withColumns(r8("recall"))


@query(sql("predictions", """SELECT category, count(*) FILTER (label = 0) AS normal, count(*) FILTER (label = 1) AS defective,
  round(avg(label), 8) AS defective_fraction FROM predictions GROUP BY category"""))
def prevalence(v: Views):
    return v.predictions().groupBy("category").agg(
        F.count_if(F.col("label") == 0).alias("normal"), F.count_if(F.col("label") == 1).alias("defective"),
        F.round(F.avg("label"), 8).alias("defective_fraction"))


AREA_SQL = """bins(bin_order, area_bin) AS (VALUES (0, 'tiny_below_0.1_percent'), (1, 'small_0.1_to_1_percent'),
    (2, 'medium_1_to_5_percent'), (3, 'large_at_least_5_percent')),
  f AS (SELECT score, CASE WHEN score/100000 < 0.001 THEN 0 WHEN score/100000 < 0.01 THEN 1 WHEN score/100000 < 0.05 THEN 2 ELSE 3 END AS bin_order
    FROM predictions WHERE label = 1),
  g AS (SELECT bin_order, count(*) AS images, count(*) FILTER (score >= 500) AS detected FROM f GROUP BY 1),
  a AS (SELECT bin_order, area_bin, coalesce(images, 0) AS images, coalesce(detected, 0) AS detected FROM bins LEFT JOIN g USING (bin_order))"""


@query(sql_more("predictions", f"""{AREA_SQL} SELECT bin_order, area_bin, images, detected, images - detected AS missed,
  CASE WHEN images > 0 THEN round(detected / images, 8) END AS recall, {wilson_sql('detected', 'images', 'recall')} FROM a"""))
def area_groups(v: Views):
    out = rates.area_groups(v.predictions(), F.col("score") / 100000, F.lit(500.0))
    return interval_columns(out.withColumnRenamed("interval", "recall_interval"), "recall").withColumns(r8("recall"))


@query(sql_more("predictions", f"{AREA_SQL} SELECT area_bin, images, CASE WHEN images > 0 THEN round(detected / images, 8) END AS recall FROM a"))
def bin_zero_fill(v: Views):
    return rates.area_groups(v.predictions(), F.col("score") / 100000, F.lit(500.0)).select("area_bin", "images", F.round("recall", 8).alias("recall"))


# --- ranking metrics ------------------------------------------------------------------------

@query(sql("predictions", """SELECT round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 8) AS auroc,
  (SELECT sum(label) FROM predictions)::BIGINT AS positives, (SELECT sum(1 - label) FROM predictions)::BIGINT AS negatives
  FROM predictions a, predictions b WHERE a.label = 1 AND b.label = 0"""))
def auroc(v: Views):
    return ranking.ranking_metrics(v.predictions()).select(F.round("auroc", 8).alias("auroc"), "positives", "negatives")


@query(sql_more("predictions", f"""{curve_sql('predictions', 'category')}
  SELECT category, CASE WHEN max(P) > 0 THEN round(sum(pos * tp / (tp + fp)) / max(P), 8) END AS average_precision, max(P) AS positives FROM curve GROUP BY category"""))
def average_precision(v: Views):
    return ranking.ranking_metrics(v.predictions(), ["category"]).select(
        "category", F.round("ap", 8).alias("average_precision"), "positives")


@query(sql_more("predictions", f"{curve_sql('predictions')} SELECT score AS threshold, tp, fp, round(fp / N, 8) AS fpr, round(tp / P, 8) AS tpr FROM curve"))
def roc_curve(v: Views):
    return ranking.roc_points(v.predictions()).select(
        F.col("score").alias("threshold"), "tp", "fp", F.round("fpr", 8).alias("fpr"), F.round("tpr", 8).alias("tpr"))


@query(sql_more("predictions", f"{curve_sql('predictions')} SELECT {PARTIAL_SQL} AS partial_auroc FROM curve"))
def partial_auroc(v: Views):
    return ranking.ranking_metrics(v.predictions()).select(F.round("partial_auroc", 8).alias("partial_auroc"))


FLOAT_PIXELS = "valid_pixels AS (SELECT image, image % 7 AS category, label, score::FLOAT AS score FROM pixels WHERE valid)"


@query(sql_more("pixels", f"""{FLOAT_PIXELS}, {curve_sql('valid_pixels')}
  SELECT (max(P) + max(N))::BIGINT AS pixels, max(P) AS positive_pixels, round(sum(pos * tp / (tp + fp)) / max(P), 8) AS average_precision FROM curve"""))
def pixel_ap(v: Views):
    return ranking.pixel_average_precision(v.pixels(), no_positive="zero").withColumns(r8("average_precision"))


@query(sql_more("pixels", f"""{FLOAT_PIXELS}, {curve_sql('valid_pixels', 'category')},
  a AS (SELECT category, (max(P) + max(N))::BIGINT AS pixels, max(P) AS positive_pixels, sum(pos * tp / (tp + fp)) / max(P) AS ap FROM curve GROUP BY category)
  SELECT count(*) AS categories, sum(pixels)::BIGINT AS pixels, sum(positive_pixels)::BIGINT AS positive_pixels, round(avg(ap), 8) AS macro_average_precision FROM a"""))
def pixel_ap_macro(v: Views):
    by_category = ranking.pixel_average_precision(v.pixels().withColumn("category", F.col("image") % 7), ["category"])
    return by_category.agg(
        F.count(F.lit(1)).alias("categories"), F.sum("pixels").alias("pixels"), F.sum("positive_pixels").alias("positive_pixels"),
        F.round(F.avg("average_precision"), 8).alias("macro_average_precision"))


@query(sql_more("conditions", f"""stacked AS (SELECT condition, label, score FROM conditions UNION ALL SELECT 'pooled', label, score FROM conditions),
  {curve_sql('stacked', 'condition')}
  SELECT condition, max(P) AS positives, max(N) AS negatives, round(sum(pos * (N - fp + neg / 2)) / (max(P) * max(N)), 8) AS auroc,
    round(sum(pos * tp / (tp + fp)) / max(P), 8) AS ap, {PARTIAL_SQL} AS partial_auroc FROM curve GROUP BY condition"""))
def pooled_and_by_condition(v: Views):
    rows = v.conditions()
    hist = ranking.with_pooled(rows, "condition")
    return ranking.metrics_from_histogram(hist, ["condition"]).withColumns(r8("auroc", "ap", "partial_auroc")).select(
        "condition", "positives", "negatives", "auroc", "ap", "partial_auroc")


# --- quantiles ------------------------------------------------------------------------------

@query(sql_more("grid", """picked AS (SELECT kind, value, row_number() OVER (PARTITION BY image ORDER BY y, x) - 1 AS idx FROM grid WHERE value > -0.05)
  SELECT kind, count(*) AS samples, round(quantile_cont(value, 0.05), 8) AS q05, round(quantile_cont(value, 0.5), 8) AS q50,
    round(quantile_cont(value, 0.95), 8) AS q95 FROM picked WHERE idx % 8 = 0 GROUP BY kind"""))
def descriptive_quantiles(v: Views):
    pixels = v.grid()
    picked = grids.every_kth(pixels.filter(F.col("value") > -0.05), 8, 8)
    return exact_quantiles(picked, ["kind"], "value", {"q05": 0.05, "q50": 0.5, "q95": 0.95}, source=pixels).select(
        "kind", F.col("n").alias("samples"), *[F.round(q, 8).alias(q) for q in ("q05", "q50", "q95")])


@query("""SELECT event_type AS device, count(*) AS measurements, round(quantile_cont(value, 0.5), 8) AS median_ms, round(quantile_cont(value, 0.95), 8) AS p95_ms,
  quantile_cont(value, 0.95) >= quantile_cont(value, 0.5) AND quantile_cont(value, 0.5) > 0 AS plausible FROM events GROUP BY event_type""")
def latency_summary(v: Views):
    times = v.table("events").select(F.col("event_type").alias("device"), F.col("value").alias("ms"))
    return exact_quantiles(times, ["device"], "ms", {"median_ms": 0.5, "p95_ms": 0.95}).select(
        "device", F.col("n").alias("measurements"), F.round("median_ms", 8).alias("median_ms"), F.round("p95_ms", 8).alias("p95_ms"),
        ((F.col("p95_ms") >= F.col("median_ms")) & (F.col("median_ms") > 0)).alias("plausible"))


@query("""SELECT event_type AS device, count(*) AS measurements, round(quantile_cont(value, 0.05), 8) AS q05, round(quantile_cont(value, 0.5), 8) AS q50,
  round(quantile_cont(value, 0.98), 8) AS q98 FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def radix_quantiles(v: Views):
    out = selected_quantiles(v.table("events"), ["event_type"], "value", {"q05": 0.05, "q50": 0.5, "q98": 0.98})
    return out.select(F.col("event_type").alias("device"), F.col("n").alias("measurements"), *[F.round(q, 8).alias(q) for q in ("q05", "q50", "q98")])


@query("""WITH ranked AS (SELECT l_returnflag, l_extendedprice AS price, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) AS r,
    count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
  SELECT l_returnflag, n AS lines, greatest(1, floor(n * 0.01))::BIGINT AS top_k, round(avg(price), 4) AS mean FROM ranked WHERE r <= greatest(1, floor(n * 0.01)) GROUP BY l_returnflag, n""")
def radix_top_means(v: Views):
    out = top_means(v.table("lineitem"), ["l_returnflag"], "l_extendedprice", 0.01)
    return out.select("l_returnflag", F.col("n").alias("lines"), "top_k", F.round("mean", 4).alias("mean"))


@query(sql_more("conditions", f"""t AS (SELECT quantile_cont(score, 0.9) AS t FROM conditions WHERE condition = 'original' AND label = 0),
  p AS (SELECT a.condition, a.label, a.score, b.score AS base, t FROM conditions a LEFT JOIN conditions b ON a.group_id = b.group_id AND b.condition = 'original', t),
  c AS (SELECT condition, count(*) AS images, count(*) FILTER (base IS NULL) AS without_base, count(*) FILTER ((score >= t) <> (base >= t)) AS flips,
     count(*) FILTER (score >= t AND base < t) AS accepted_to_flagged, count(*) FILTER (score < t AND base >= t) AS flagged_to_accepted,
     round(avg(abs(score - base)), 6) AS mean_abs_change, {COUNTS_SQL.format(t='t')} FROM p GROUP BY condition),
  {curve_sql('conditions', 'condition')},
  m AS (SELECT condition, round(sum(pos * (N - fp + neg / 2)) / (max(P) * max(N)), 8) AS auroc, round(sum(pos * tp / (tp + fp)) / max(P), 8) AS ap FROM curve GROUP BY condition)
  SELECT condition, images, without_base, flips, accepted_to_flagged, flagged_to_accepted, mean_abs_change, {RATES_SQL}, auroc, ap FROM c JOIN m USING (condition)"""))
def stress_summary(v: Views):
    rows = v.conditions()
    frozen = rates.normal_threshold(rows.filter(F.col("condition") == "original"), 0.9).select("threshold").scalar()
    metrics = ranking.ranking_metrics(rows, ["condition"], source=rows.select("condition", "score")).select("condition", "auroc", "ap")
    return rates.stress_summary(rows, frozen).join(metrics, "condition").withColumns(
        {**r8("recall", "false_alarm_rate", "precision", "auroc", "ap"), "mean_abs_change": F.round("mean_abs_change", 6)})


@query(sql_more("conditions", """p AS (SELECT group_id, label, max(score) FILTER (condition = 'original') AS base, max(score) FILTER (condition = 'blur') AS blur,
    max(score) FILTER (condition = 'dark') AS dark, max(score) FILTER (condition = 'bright') AS bright, max(score) FILTER (condition = 'jpeg') AS jpeg
    FROM conditions GROUP BY ALL)
  SELECT count(*) AS normals, count(*) FILTER (blur > 2 * base) AS blur_shifted, count(*) FILTER (dark > 2 * base) AS dark_shifted,
    count(*) FILTER (bright > 2 * base) AS bright_shifted, count(*) FILTER (jpeg > 2 * base) AS jpeg_shifted FROM p WHERE label = 0"""))
def shift_count(v: Views):
    names = ["original", "blur", "dark", "bright", "jpeg"]
    wide = v.conditions().filter(F.col("label") == 0).groupBy("group_id").pivot("condition", names).agg(F.max("score"))
    return wide.agg(F.count(F.lit(1)).alias("normals"), *[
        F.count_if(F.col(c) > 2 * F.col("original")).alias(f"{c}_shifted") for c in names[1:]])


@query(sql("conditions", """SELECT a.group_id, a.condition, a.label, a.score, b.score AS original_score, a.score - b.score AS change
  FROM conditions a JOIN conditions b ON a.group_id = b.group_id AND b.condition = 'original' WHERE a.condition <> 'original'"""))
def paired_conditions(v: Views):
    rows = v.conditions()
    base = rows.filter(F.col("condition") == "original").select("group_id", F.col("score").alias("original_score"))
    return rows.filter(F.col("condition") != "original").join(base, "group_id").withColumn("change", F.col("score") - F.col("original_score"))


# --- families -------------------------------------------------------------------------------

FAMILY_SQL = """base AS (SELECT image, label, score, 'family' || (image % 5) AS family FROM predictions),
  members AS (SELECT family, label, score FROM base WHERE label = 1
    UNION ALL SELECT f.family, c.label, c.score FROM base c, (SELECT DISTINCT 'family' || i AS family FROM range(0, 5) t(i)) f WHERE c.label = 0)"""
FAMILIES = [f"family{i}" for i in range(5)]


def families(v: Views):
    """Anomalies of each family, with every clean row as control of every family."""
    base = v.predictions().select("image", "label", "score", F.concat(F.lit("family"), (F.col("image") % 5).cast("string")).alias("family"))
    declared = F.explode(F.array(*[F.lit(f) for f in FAMILIES]))
    clean = base.filter(F.col("label") == 0).withColumn("family", declared)
    return base.filter(F.col("label") == 1).unionByName(clean)


@query(sql_more("predictions", f"{FAMILY_SQL} SELECT family, count(*) FILTER (label = 0) AS clean_controls, count(*) FILTER (label = 1) AS defective FROM members GROUP BY family"))
def clean_controls(v: Views):
    return families(v).groupBy("family").agg(
        F.count_if(F.col("label") == 0).alias("clean_controls"), F.count_if(F.col("label") == 1).alias("defective"))


@query(sql_more("pixels", f"""ranked AS (SELECT image, score, row_number() OVER (PARTITION BY image ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY image) AS n FROM pixels WHERE valid),
  s AS (SELECT image, round(avg(score), 9) AS score FROM ranked WHERE r <= greatest(1, floor(n * 0.01)) GROUP BY image),
  l AS (SELECT image, (avg(label) >= 0.18)::INT AS label FROM pixels GROUP BY image),
  f AS (SELECT 'family' || i AS family FROM range(0, 5) t(i)),
  members AS (SELECT family, image, label, score FROM s JOIN l USING (image) JOIN f ON label = 0 OR family = 'family' || (image % 5)),
  a AS (SELECT d.family, avg(CASE WHEN d.score > c.score THEN 1.0 WHEN d.score = c.score THEN 0.5 ELSE 0 END) AS a
    FROM members d JOIN members c ON d.family = c.family AND d.label = 1 AND c.label = 0 GROUP BY d.family),
  member_pixels AS (SELECT family, p.label, p.score::FLOAT AS score FROM pixels p JOIN members m ON p.image = m.image WHERE p.valid),
  {curve_sql('member_pixels', 'family')},
  p AS (SELECT family, sum(pos * tp / (tp + fp)) / nullif(max(P), 0) AS p FROM curve GROUP BY family),
  h AS (SELECT family, 2 * a * p / (a + p) AS h FROM (SELECT DISTINCT family FROM members) LEFT JOIN a USING (family) LEFT JOIN p USING (family))
  SELECT round(avg(h), 8) AS macro_h, round(avg(h) FILTER (family < 'family3'), 8) AS old_macro_h, round(avg(h) FILTER (family >= 'family3'), 8) AS new_macro_h,
  count(*) AS families FROM h"""))
def family_macro(v: Views):
    """Mean over families of H from image AUROC and pixel AP; clean images and their pixels are controls of every family.

    Pixels become histograms before the clean ones are repeated per family.
    """
    pixels = v.pixels()
    labels = pixels.groupBy("image").agg((F.avg("label") >= 0.18).cast("int").alias("image_label"))
    own = F.when(F.col("image_label") == 1, F.array(F.concat(F.lit("family"), (F.col("image") % 5).cast("string"))))
    spread = F.explode(F.coalesce(own, F.array(*[F.lit(f) for f in FAMILIES])))
    images = (scoring.top_fraction_mean(pixels, ["image"]).withColumn("score", F.round("score", 9)).join(labels, "image")
              .select(spread.alias("family"), F.col("image_label").alias("label"), "score"))
    aurocs = ranking.ranking_metrics(images, ["family"]).select("family", "auroc")
    group = F.when(F.col("image_label") == 1, F.concat(F.lit("family"), (F.col("image") % 5).cast("string")))
    valid = pixels.filter("valid").join(labels, "image").select(group.alias("own"), F.col("score").cast("float").alias("score"), "label")
    hist = ranking.score_histogram(valid, ["own"])
    every = F.when(F.col("own").isNull(), F.array(*[F.lit(f) for f in FAMILIES])).otherwise(F.array("own"))
    hist = hist.withColumn("family", F.explode(every)).groupBy("family", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    aps = ranking.metrics_from_histogram(hist, ["family"], source=hist.select("family", "score")).select("family", "ap")
    scored = aurocs.join(aps, "family", "left").select("family", scalar.harmonic_mean(F.col("auroc"), F.col("ap")).alias("h"))
    old = F.col("family").isin(FAMILIES[:3])
    return scored.agg(F.round(F.avg("h"), 8).alias("macro_h"), F.round(F.avg(F.when(old, F.col("h"))), 8).alias("old_macro_h"),
                      F.round(F.avg(F.when(~old, F.col("h"))), 8).alias("new_macro_h"), F.count(F.lit(1)).alias("families"))


@query(sql_more("pixels", f"""runs AS (SELECT image % 3 AS run, image, valid, label, score FROM pixels),
  ranked AS (SELECT run, image, score, row_number() OVER (PARTITION BY image ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY image) AS n FROM runs WHERE valid),
  s AS (SELECT run, image, avg(score) AS score FROM ranked WHERE r <= greatest(1, floor(n * 0.01)) GROUP BY run, image),
  l AS (SELECT image, (avg(label) >= 0.18)::INT AS label FROM runs GROUP BY image),
  pairs AS (SELECT a.run, avg(CASE WHEN round(a.score, 9) > round(b.score, 9) THEN 1.0 WHEN round(a.score, 9) = round(b.score, 9) THEN 0.5 ELSE 0 END) AS auroc
    FROM (SELECT * FROM s JOIN l USING (image)) a JOIN (SELECT * FROM s JOIN l USING (image)) b ON a.run = b.run AND a.label = 1 AND b.label = 0 GROUP BY a.run),
  valid_pixels AS (SELECT run, label, score::FLOAT AS score FROM runs WHERE valid), {curve_sql('valid_pixels', 'run')},
  p AS (SELECT run, sum(pos * tp / (tp + fp)) / max(P) AS ap FROM curve GROUP BY run),
  c AS (SELECT run, count(*) AS images, sum(label)::BIGINT AS defective FROM s JOIN l USING (image) GROUP BY run)
  SELECT run, images, defective, round(auroc, 8) AS image_auroc, round(ap, 8) AS pixel_ap, round(2 * auroc * ap / (auroc + ap), 8) AS harmonic_mean
  FROM c LEFT JOIN pairs USING (run) JOIN p USING (run)"""))
def bank_score(v: Views):
    runs = v.pixels().withColumn("run", F.col("image") % 3)
    labels = runs.groupBy("image").agg((F.avg("label") >= 0.18).cast("int").alias("label"))
    images = scoring.top_fraction_mean(runs, ["run", "image"]).withColumn("score", F.round("score", 9)).join(labels, "image")
    image_metrics = ranking.ranking_metrics(images.select("run", "label", "score"), ["run"]).select(
        "run", (F.col("positives") + F.col("negatives")).alias("images"), F.col("positives").alias("defective"), "auroc")
    pixel = ranking.pixel_average_precision(runs, ["run"], no_positive="zero").select("run", "average_precision")
    return image_metrics.join(pixel, "run").select(
        "run", "images", "defective", F.round("auroc", 8).alias("image_auroc"), F.round("average_precision", 8).alias("pixel_ap"),
        F.round(scalar.harmonic_mean(F.col("auroc"), F.col("average_precision")), 8).alias("harmonic_mean"))
