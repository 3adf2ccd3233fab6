"""Registered queries: sources, record checks, digests, geometry and set operations."""

from pyspark.sql import functions as F

from gaugeframe.functions import arrays, scalar
from gaugeframe.operators import integrity, rates
from gaugeframe.plans.registry import query
from gaugeframe.runtime import scratch
from gaugeframe.sources import assets, evidence_files
from gaugeframe.views import SPLITS, Views, asset_path, sql, sql_draw, sql_more

PATH_SQL = "source || '/' || lpad(doc_id::VARCHAR, 9, '0')"


# --- sources and sinks ----------------------------------------------------------------------

@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS section,
  regexp_extract(url, '^https?://[^/]+/[^/]+/(\d+)', 1) AS stem FROM pages""")
def scan_assets(v: Views):
    return assets.parse_urls(v.table("pages").select("page_id", "url")).drop("url")


@query(sql("predictions", """SELECT sha256(category) AS checkpoint_sha256, 4000.0::DOUBLE AS threshold, image::VARCHAR AS image, category, defect, label, score,
  score >= 4000 AS predicted_defective FROM predictions"""))
def read_predictions(v: Views):
    saved = v.predictions().select(
        F.sha2("category", 256).alias("checkpoint_sha256"), F.lit(4000.0).alias("threshold"), F.col("image").cast("string").alias("image"),
        "category", "defect", "label", "score", (F.col("score") >= 4000).alias("predicted_defective"))
    path = scratch(v.spark, "evaluations")
    evidence_files.write_predictions(saved, path)
    return evidence_files.read_predictions(v.spark, path)


@query(sql("records", "SELECT split, count(*) AS images, sum(label)::BIGINT AS defective, min(path) AS first_path FROM records GROUP BY split"))
def write_manifest(v: Views):
    path = scratch(v.spark, "manifest")
    manifest = evidence_files.write_manifest(v.records(), path)
    return manifest.groupBy("split").agg(F.count(F.lit(1)).alias("images"), F.sum("label").alias("defective"), F.min("path").alias("first_path"))


@query(sql("records", "SELECT asset_id, path, category, label, split FROM records WHERE split IN ('validation', 'calibration')"))
def read_split(v: Views):
    records, path = v.records(), scratch(v.spark, "manifest")
    evidence_files.write_manifest(records, path)
    return evidence_files.read_manifest(v.spark, path, records, ["validation", "calibration"]).select(
        "asset_id", "path", "category", "label", "split")


@query(sql("pixels", """SELECT 'flag' || (image % 3) AS condition, label, count(*) AS pixels, round(sum(score::FLOAT::DOUBLE), 6) AS score_sum
  FROM pixels WHERE valid GROUP BY ALL"""))
def spool_scores(v: Views):
    path = scratch(v.spark, "spool")
    evidence_files.spool_scores(v.pixels().filter("valid").withColumn("condition", F.concat(F.lit("flag"), (F.col("image") % 3).cast("string"))), path)
    return evidence_files.read_spool(v.spark, path).groupBy("condition", "label").agg(
        F.count(F.lit(1)).alias("pixels"), F.round(F.sum(F.col("score").cast("double")), 6).alias("score_sum"))


METRIC_ROWS = """m AS (SELECT category, count(*) FILTER (score >= 4000 AND label = 1) AS tp, count(*) FILTER (score >= 4000 AND label = 0) AS fp,
  count(*) FILTER (score < 4000 AND label = 0) AS tn, count(*) FILTER (score < 4000 AND label = 1) AS fn FROM predictions GROUP BY category)"""


@query(sql_more("predictions", METRIC_ROWS + """ SELECT category, metric, value::DOUBLE AS value FROM (SELECT category, tp::DOUBLE AS tp, fp::DOUBLE AS fp, tn::DOUBLE AS tn, fn::DOUBLE AS fn,
   round(tp / nullif(tp + fn, 0), 8) AS recall, round(fp / nullif(fp + tn, 0), 8) AS false_alarm_rate,
   CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 8) END AS precision FROM m)
  UNPIVOT INCLUDE NULLS (value FOR metric IN (tp, fp, tn, fn, recall, false_alarm_rate, precision))"""))
def metrics_sink(v: Views):
    path = scratch(v.spark, "metrics")
    metrics = rates.confusion(v.predictions(), F.lit(4000.0), ["category"])
    evidence_files.write_metrics(metrics, path, ["category"])
    stored = v.spark.read.schema("category string, document string").parquet(path)
    wide = stored.select(F.from_json("document", metrics.schema).alias("m")).select("m.*")
    return evidence_files.long_metrics(wide, ["category"]).withColumn("value", F.round("value", 8))


# --- record projections and predicates ------------------------------------------------------

@query(sql_more("records", """s(split) AS (VALUES ('train'), ('validation'), ('calibration'), ('test')),
  c AS (SELECT split, count(*) AS images, count(DISTINCT defect) AS defects FROM records WHERE category = 'en' GROUP BY split)
  SELECT split, coalesce(images, 0) AS images, coalesce(defects, 0) AS defects, images IS NULL AS missing FROM s LEFT JOIN c USING (split)"""))
def category_slice(v: Views):
    required = v.spark.createDataFrame([(s,) for s in SPLITS], "split string")
    kept = v.records().filter(F.col("category") == "en")
    counts = (kept.groupBy("split", "defect").agg(F.count(F.lit(1)).alias("rows"))
              .groupBy("split").agg(F.sum("rows").alias("images"), F.count(F.lit(1)).alias("defects")))
    return required.join(counts, "split", "left").select(
        "split", F.coalesce("images", F.lit(0)).alias("images"), F.coalesce("defects", F.lit(0)).alias("defects"),
        F.col("images").isNull().alias("missing"))


@query(f"SELECT {PATH_SQL} AS path, sha256(text) AS content_hash, sha256('(' || n_chars || ', 1)' || text) AS sized_hash FROM documents")
def content_hash(v: Views):
    return v.table("documents").select(
        asset_path().alias("path"), scalar.content_hash(F.col("text")).alias("content_hash"),
        scalar.sized_content_hash(F.col("n_chars"), F.lit(1), F.col("text")).alias("sized_hash"))


DIGEST_NAMES = ["path", "category", "defect", "label", "content_hash", "split"]
DIGEST_SQL = "sha256(" + " || ".join(f"coalesce('{n}:' || length({n}::VARCHAR) || ':' || {n}::VARCHAR || ';', '{n}:-;')" for n in sorted(DIGEST_NAMES)) + ")"


@query(sql("records", f"SELECT path, {DIGEST_SQL} AS digest FROM records"))
def row_digest(v: Views):
    return v.records().select("path", scalar.row_digest(DIGEST_NAMES).alias("digest"))


@query(sql_more("records", f"""d AS (SELECT split, {DIGEST_SQL} AS d FROM records),
  s AS (SELECT split, count(*) AS rows, {', '.join(f"sum(('0x' || substr(d, {15 * i + 1}, 15))::UBIGINT) AS w{i}" for i in range(4))} FROM d GROUP BY split)
  SELECT split, rows, sha256(concat_ws('|', rows::VARCHAR, w0::HUGEINT::VARCHAR, w1::HUGEINT::VARCHAR, w2::HUGEINT::VARCHAR, w3::HUGEINT::VARCHAR)) AS digest FROM s"""))
def frame_digest(v: Views):
    return integrity.frame_digest(v.records(), DIGEST_NAMES, ["split"])


TAMPERED = "SELECT image, CASE WHEN image % 41 = 0 THEN NULL WHEN image % 43 = 0 THEN 'nan'::DOUBLE WHEN image % 47 = 0 THEN 'inf'::DOUBLE ELSE score END AS score, CASE WHEN image % 53 = 0 THEN 2 ELSE label END AS label FROM predictions"


@query(sql_more("predictions", f"""t AS ({TAMPERED}) SELECT image, reason FROM (SELECT image, CASE WHEN score IS NULL OR isnan(score) THEN 'not a number'
  WHEN isinf(score) THEN 'infinite' WHEN score < 0 OR score > 20000 THEN 'out of range' WHEN label NOT IN (0, 1) THEN 'label' END AS reason FROM t) WHERE reason IS NOT NULL"""))
def finite_range_filter(v: Views):
    image = F.col("image")
    score = (F.when(image % 41 == 0, F.lit(None).cast("double")).when(image % 43 == 0, F.lit(float("nan")))
             .when(image % 47 == 0, F.lit(float("inf"))).otherwise(F.col("score")))
    damaged = v.predictions().select("image", score.alias("score"), F.when(image % 53 == 0, 2).otherwise(F.col("label")).alias("label"))
    return integrity.out_of_range(damaged, "image", "score", "label", 0.0, 20000.0)


@query(f"""SELECT path, path LIKE '/%' OR list_contains(string_split(path, '/'), '..') AS unsafe FROM
  (SELECT CASE WHEN doc_id % 11 = 0 THEN 'bank/../' WHEN doc_id % 13 = 0 THEN '/' WHEN doc_id % 17 = 0 THEN 'a..b/' ELSE '' END || {PATH_SQL} AS path FROM documents)""")
def path_safety(v: Views):
    i = F.col("doc_id")
    prefix = F.when(i % 11 == 0, "bank/../").when(i % 13 == 0, "/").when(i % 17 == 0, "a..b/").otherwise("")
    return v.table("documents").select(F.concat(prefix, asset_path()).alias("path")).withColumn("unsafe", scalar.unsafe_path(F.col("path")))


@query(sql("uploads", """SELECT asset_id, CASE WHEN size_bytes > 10485760 THEN 'bytes' WHEN width::BIGINT * height > 20000000 THEN 'pixels'
  WHEN least(width, height) < 16 OR greatest(width, height) > 2048 THEN 'dimensions' END AS reason FROM uploads"""))
def size_limits(v: Views):
    return v.uploads().select("asset_id", scalar.size_reason(F.col("size_bytes"), F.col("width"), F.col("height")).alias("reason"))


@query(sql_more("uploads", """g AS (SELECT asset_id, width, height, least(256.0::DOUBLE / width, 640.0::DOUBLE / height) AS scale FROM uploads),
  r AS (SELECT *, greatest(1, round_even(width * scale, 0))::INT AS resized_width, greatest(1, round_even(height * scale, 0))::INT AS resized_height FROM g)
  SELECT asset_id, round(scale, 8) AS scale, resized_width, resized_height, ((256 - resized_width) // 2)::INT AS left_offset, ((640 - resized_height) // 2)::INT AS top_offset,
    (resized_width * resized_height)::BIGINT AS valid_area FROM r"""))
def letterbox_geometry(v: Views):
    geometry = scalar.letterbox(F.col("width"), F.col("height"), 256, 640)
    return v.uploads().select("asset_id", *[c.alias(n) for n, c in geometry.items()]).withColumn("scale", F.round("scale", 8))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '/elsewhere/' || {PATH_SQL} ELSE {PATH_SQL} END AS portable_path, doc_id % 17 = 0 AS leftover FROM documents""")
def portable_paths(v: Views):
    docs = v.table("documents").select("doc_id", asset_path().alias("path"))
    root = F.when(F.col("doc_id") % 17 == 0, "/elsewhere/").when(F.col("doc_id") % 5 == 0, "/data/run/").otherwise("/old/root/")
    used = docs.select("doc_id", F.concat(root, F.col("path")).alias("stored_path"))
    dictionary = docs.filter(F.col("doc_id") % 17 != 0).select(F.concat(F.lit("/old/root/"), "path").alias("local_path"), F.col("path").alias("relative_path"))
    return integrity.portable(used, dictionary, "stored_path", "/data/run/").select("doc_id", "portable_path", "leftover")


@query("""SELECT c_custkey AS record, f AS family_index, a AS attempt, 42 + c_custkey * 10000 + f * 100 + a AS seed
  FROM customer, range(0, 3) t(f), range(0, 2) u(a)""")
def derived_seeds(v: Views):
    family = F.posexplode(F.array(F.lit("scratch"), F.lit("warp"), F.lit("texture"))).alias("family_index", "family")
    rows = v.table("customer").select(F.col("c_custkey").alias("record"), family)
    rows = rows.withColumn("attempt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))))
    index = F.col("family_index").cast("bigint")
    return rows.select("record", index.alias("family_index"), "attempt", derived_seed(42, F.col("record"), index, F.col("attempt")).alias("seed"))


def derived_seed(seed: int, record, family, attempt):
    return F.lit(seed) + record * 10_000 + family * 100 + attempt


# --- array records --------------------------------------------------------------------------

def channel_values(v: Views):
    """Embeddings mapped into [0, 1] as channel values."""
    return v.table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") / 2 + 0.5).alias("values"))


VALUES_SQL = "values_ AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / 2 + 0.5) AS vals FROM embeddings)"


@query(f"""WITH {VALUES_SQL}, f AS (SELECT vec_id, vals, CASE WHEN {sql_draw('7-keep', 'vec_id')} / 4294967296.0::DOUBLE < 0.5 THEN 1.0::DOUBLE
    ELSE 0.75::DOUBLE + 0.5::DOUBLE * ({sql_draw('7-factor', 'vec_id')} / 4294967296.0::DOUBLE) END AS factor FROM values_)
  SELECT vec_id, round(factor, 8) AS factor, round(list_sum(list_transform(vals, lambda x: greatest(0.0::DOUBLE, least(1.0::DOUBLE, x * factor)))), 8) AS total,
    round(list_max(list_transform(vals, lambda x: least(1.0::DOUBLE, x * 1.2::DOUBLE))), 8) AS brightest FROM f""")
def brightness_variant(v: Views):
    drawn = channel_values(v).withColumn("drawn", arrays.drawn_factor(F.col("vec_id"), 7))
    return drawn.select(
        "vec_id", F.round("drawn", 8).alias("factor"),
        F.round(arrays.array_sum(arrays.scale_and_clip(F.col("values"), F.col("drawn"))), 8).alias("total"),
        F.round(F.array_max(arrays.scale_and_clip(F.col("values"), 1.2)), 8).alias("brightest"))


@query(f"""WITH {VALUES_SQL}, e AS (SELECT vec_id, unnest(vals) AS x, unnest(range(0, len(vals))) AS i FROM values_)
  SELECT vec_id, round(sum(greatest(0, least(1, x + 0.05::DOUBLE * sqrt(-2 * ln(({sql_draw('11-u', 'vec_id', 'i')} + 1) / 4294967297.0::DOUBLE))
    * cos(6.283185307179586::DOUBLE * ({sql_draw('11-v', 'vec_id', 'i')} / 4294967296.0::DOUBLE))))), 6) AS total FROM e GROUP BY vec_id""")
def noise_variant(v: Views):
    noisy = arrays.add_noise(F.col("values"), F.col("vec_id"), 0.05, 11)
    return channel_values(v).select("vec_id", F.round(arrays.array_sum(noisy), 6).alias("total"))


@query(f"""WITH {VALUES_SQL}, e AS (SELECT vec_id, unnest(vals) AS x, unnest(range(0, len(vals))) AS i FROM values_),
  p AS (SELECT vec_id, i // 4 AS p, max(abs(least(1.0::DOUBLE, x * 1.8::DOUBLE) - x * CASE WHEN x > 0.5 THEN 1.0::DOUBLE ELSE 1.8::DOUBLE END)) AS change FROM e GROUP BY ALL)
  SELECT vec_id, count(*) AS positions, count(*) FILTER (change > 1e-6) AS changed FROM p GROUP BY vec_id""")
def changed_mask(v: Views):
    before = F.transform("values", lambda x: x * F.when(x > 0.5, 1.0).otherwise(1.8))
    after = arrays.scale_and_clip(F.col("values"), 1.8)

    def cells(values):
        return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice(values, i * 4 + 1, F.lit(4)))
    flags = channel_values(v).select("vec_id", arrays.changed_positions(cells(before), cells(after)).alias("flags"))
    return flags.select("vec_id", F.size("flags").cast("bigint").alias("positions"), F.size(F.filter("flags", lambda x: x)).cast("bigint").alias("changed"))


@query("""WITH bins AS (SELECT i, floor(i * 64 / 10)::INT AS a, ceil((i + 1) * 64 / 10)::INT AS b FROM range(0, 10) t(i)),
  e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS pos FROM embeddings)
  SELECT vec_id, i AS slot, round(avg(x), 8) AS pooled, (SELECT round(avg(y.x), 8) FROM e y WHERE y.vec_id = e.vec_id AND y.pos // 16 = i % 4) AS channel_mean
  FROM e JOIN bins ON pos >= a AND pos < b GROUP BY vec_id, i""")
def pooled_embedding(v: Views):
    pooled = v.table("embeddings").select(
        "vec_id", arrays.adaptive_average(F.col("embedding"), 10).alias("pooled"), arrays.channel_means(F.col("embedding"), 4).alias("channels"))
    slots = pooled.select("vec_id", "channels", F.posexplode("pooled").alias("slot", "value"))
    return slots.select("vec_id", F.col("slot").cast("bigint").alias("slot"), F.round("value", 8).alias("pooled"),
                        F.round(F.get("channels", F.col("slot") % 4), 8).alias("channel_mean"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda z: 1 / (1 + exp(-z::DOUBLE)))) / 64, 8) AS mean_probability,
  round(list_sum(list_transform(range(1, 65), lambda i: abs(embedding[i]::DOUBLE - embedding[65 - i]::DOUBLE))) / 64, 8) AS mean_difference FROM embeddings""")
def score_map(v: Views):
    return v.table("embeddings").select(
        "vec_id", F.round(arrays.array_sum(F.transform("embedding", lambda z: arrays.sigmoid(z.cast("double")))) / 64, 8).alias("mean_probability"),
        F.round(arrays.mean_abs_difference(F.col("embedding"), F.reverse("embedding")), 8).alias("mean_difference"))


@query(sql_more("predictions", """m AS (SELECT category, avg(label) AS a, count(*) FILTER (label = 1 AND score > 4000) / greatest(1, count(*) FILTER (score > 4000)) AS b FROM predictions GROUP BY category)
  SELECT category, round(CASE WHEN a + b = 0 THEN 0 ELSE 2 * a * b / (a + b) END, 8) AS harmonic, a BETWEEN 0 AND 1 AND b BETWEEN 0 AND 1 AS valid FROM m"""))
def harmonic_mean(v: Views):
    m = v.predictions().groupBy("category").agg(
        F.avg("label").alias("a"),
        (F.count_if((F.col("label") == 1) & (F.col("score") > 4000)) / F.greatest(F.lit(1), F.count_if(F.col("score") > 4000))).alias("b"))
    a, b = F.col("a"), F.col("b")
    return m.select("category", F.round(scalar.harmonic_mean(a, b), 8).alias("harmonic"), (scalar.valid_unit(a) & scalar.valid_unit(b)).alias("valid"))


# --- joins of the audit ---------------------------------------------------------------------

@query(f"""SELECT path, CASE WHEN doc_id % 29 = 0 THEN 'missing' ELSE 'changed' END AS reason FROM
  (SELECT doc_id, {PATH_SQL} AS path FROM documents) WHERE doc_id % 29 = 0 OR doc_id % 23 = 0""")
def verify_content(v: Views):
    docs = v.table("documents").select("doc_id", asset_path().alias("path"), scalar.content_hash(F.col("text")).alias("content_hash"))
    stored = docs.select("path", F.when(F.col("doc_id") % 23 == 0, F.reverse("content_hash")).otherwise(F.col("content_hash")).alias("stored"))
    actual = docs.filter(F.col("doc_id") % 29 != 0)
    return integrity.changed_content(stored, actual, "path", "stored", "content_hash")


@query("""SELECT doc_id AS image, lang AS category FROM labels JOIN documents USING (doc_id) WHERE toxic = 1 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def pair_masks(v: Views):
    masks = v.table("labels").filter(F.col("quality") == 1).select(F.col("doc_id").alias("image"))
    defective = v.predictions().filter(F.col("label") == 1).select("image", "category")
    return integrity.unpaired(defective, masks, "image")


MASK_FILES = f"SELECT CASE WHEN doc_id % 19 = 0 THEN 'lost/' ELSE '' END || {PATH_SQL} AS path FROM labels JOIN documents USING (doc_id)"


@query(f"""SELECT path FROM ({MASK_FILES}) WHERE path NOT IN (SELECT {PATH_SQL} FROM documents)""")
def orphan_masks(v: Views):
    masks = mask_files(v)
    return integrity.outside_known(masks, [v.assets().select("path")], "path")


def mask_files(v: Views):
    lost = F.when(F.col("doc_id") % 19 == 0, "lost/").otherwise("")
    docs = v.table("documents").select("doc_id", "source")
    return v.table("labels").select("doc_id").join(docs, "doc_id").select(F.concat(lost, asset_path()).alias("path"))


@query(sql("uploads", """SELECT 'a' || asset_id AS image, 'size differs' AS reason FROM uploads WHERE asset_id % 31 = 0
  UNION ALL SELECT 's' || l_suppkey, CASE WHEN count(*) FILTER (l_partkey % 199 = 0) > 0 THEN 'not binary' ELSE 'empty' END
  FROM lineitem GROUP BY l_suppkey HAVING count(*) FILTER (l_partkey % 199 = 0) > 0 OR count(*) FILTER (l_quantity >= 50) = 0"""))
def pair_geometry(v: Views):
    images = v.uploads().select(F.concat(F.lit("a"), F.col("asset_id").cast("string")).alias("image"), "asset_id", "width", "height")
    masks = images.withColumn("width", F.when(F.col("asset_id") % 31 == 0, F.col("width") + 1).otherwise(F.col("width")))
    value = F.when(F.col("l_partkey") % 199 == 0, 128).when(F.col("l_quantity") >= 50, 255).otherwise(0)
    pixels = v.table("lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("image"), value.alias("value"))
    return integrity.geometry_violations(images, masks, "image").unionByName(integrity.mask_value_violations(pixels, "image", "value"))


@query("""WITH e AS (SELECT doc_id AS image, toxic AS label FROM labels WHERE doc_id % 7 <> 0),
  a AS (SELECT doc_id AS image, CASE WHEN doc_id % 17 = 0 THEN 1 - toxic ELSE toxic END AS label FROM labels WHERE doc_id % 11 <> 0
     UNION ALL SELECT doc_id, toxic FROM labels WHERE doc_id % 13 = 0 AND doc_id % 11 <> 0),
  ae AS (SELECT image, count(*) AS n, max(label) AS l FROM a GROUP BY image)
  SELECT coalesce(e.image, ae.image) AS image, CASE WHEN n IS NULL THEN 'missing' WHEN e.image IS NULL THEN 'foreign' WHEN n > 1 THEN 'duplicate' ELSE 'differs' END AS reason
  FROM e FULL JOIN ae ON e.image = ae.image WHERE n IS NULL OR e.image IS NULL OR n > 1 OR e.label <> l""")
def membership_exactly_once(v: Views):
    rows = v.table("labels").select(F.col("doc_id").alias("image"), F.col("toxic").alias("label"))
    i = F.col("image")
    present = rows.filter(i % 11 != 0)
    actual = present.withColumn("label", F.when(i % 17 == 0, 1 - F.col("label")).otherwise(F.col("label"))).unionByName(present.filter(i % 13 == 0))
    return integrity.membership(rows.filter(i % 7 != 0), actual, "image", "label")


@query(sql("records", """SELECT defect AS family, split FROM (SELECT DISTINCT defect FROM records), (VALUES ('train'), ('validation'), ('calibration'), ('test')) s(split)
  WHERE (defect, split) NOT IN (SELECT defect, split FROM records WHERE label = 1)"""))
def required_present(v: Views):
    records = v.records().select(F.col("defect").alias("family"), "split", "label")
    required = integrity.declared_grid(records.select("family").distinct(), "split", SPLITS)
    return integrity.missing_required(required, records.filter(F.col("label") == 1), ["family", "split"])


EVENT_TYPES = ("click", "view", "purchase", "refund", "error")


@query(f"""WITH c AS (SELECT user_id AS source, event_type AS condition, count(*) AS rows FROM events GROUP BY ALL),
  w AS (SELECT source, condition FROM (SELECT DISTINCT source FROM c), (VALUES {', '.join(f"('{t}')" for t in EVENT_TYPES)}) t(condition))
  SELECT source, condition, coalesce(rows, 0) AS rows, CASE WHEN rows IS NULL THEN 'missing' WHEN w.source IS NULL THEN 'undeclared' ELSE 'repeated' END AS reason
  FROM w FULL JOIN c USING (source, condition) WHERE rows IS NULL OR w.source IS NULL OR rows > 1""")
def complete_grid(v: Views):
    actual = v.table("events").select(F.col("user_id").alias("source"), F.col("event_type").alias("condition"))
    return integrity.grid_violations(actual, "source", "condition", EVENT_TYPES)


@query(f"""SELECT {PATH_SQL} || ' (copy)' AS copy, {PATH_SQL} AS original, doc_id % 49 <> 0 AND doc_id % 21 <> 0 AS identical FROM documents WHERE doc_id % 7 = 0""")
def copy_pairs(v: Views):
    docs = v.table("documents").select("doc_id", asset_path().alias("path"), scalar.content_hash(F.col("text")).alias("content_hash"))
    copies = docs.filter(F.col("doc_id") % 7 == 0).select(
        F.concat("path", F.lit(" (copy)")).alias("path"),
        F.when(F.col("doc_id") % 49 == 0, F.reverse("content_hash")).otherwise(F.col("content_hash")).alias("content_hash"))
    return integrity.copy_pairs(docs.filter(F.col("doc_id") % 21 != 0).select("path", "content_hash").unionByName(copies), "path", "content_hash")


# --- audit aggregations ---------------------------------------------------------------------

@query(sql("records", """SELECT split, category, defect, count(*) AS images, count(*) FILTER (label = 0) AS normal, count(*) FILTER (label = 1) AS defective
  FROM records GROUP BY GROUPING SETS ((split, category, defect), (split, category), (split))"""))
def split_counts(v: Views):
    return integrity.split_counts(v.records())


@query(sql_more("records", """e AS (SELECT category, count(*) + (category = 'de')::INT AS expected_images FROM records GROUP BY category UNION ALL SELECT 'it', 1),
  h AS (SELECT category, count(*) AS images, count(*) FILTER (split <> 'test' AND label = 0) AS a, count(*) FILTER (split = 'test' AND label = 0) AS b,
    count(*) FILTER (split = 'test' AND label = 1) AS c FROM records GROUP BY category),
  j AS (SELECT category, expected_images, coalesce(images, 0) AS images, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c FROM e LEFT JOIN h USING (category))
  SELECT category, images, expected_images, unnest(list_filter([CASE WHEN images <> expected_images THEN 'count differs' END, CASE WHEN a < 3 THEN 'too few normals' END,
    CASE WHEN b = 0 THEN 'no normal tests' END, CASE WHEN c = 0 THEN 'no defective tests' END], lambda x: x IS NOT NULL)) AS reason FROM j"""))
def expected_counts(v: Views):
    records = v.records()
    declared = records.groupBy("category").agg(
        (F.count(F.lit(1)) + F.when(F.col("category") == "de", 1).otherwise(0)).alias("expected_images"))
    extra = v.spark.createDataFrame([("it", 1)], "category string, expected_images bigint")
    return integrity.count_violations(records, declared.unionByName(extra))


@query(sql("records", """SELECT content_hash, array_to_string(list_sort(list_distinct(list(split))), ',') AS parts FROM records GROUP BY content_hash HAVING count(DISTINCT split) > 1"""))
def cross_split_leaks(v: Views):
    return integrity.shared_between(v.records(), "content_hash", "split").select("content_hash", F.array_join("parts", ",").alias("parts"))


# --- set operations -------------------------------------------------------------------------

@query(f"SELECT {PATH_SQL} AS path FROM documents UNION {MASK_FILES}")
def union_known(v: Views):
    return integrity.union_known([v.assets(), mask_files(v)], "path")


@query("""WITH a AS (SELECT doc_id AS image, toxic AS label FROM labels WHERE doc_id % 9 <> 0), b AS (SELECT doc_id AS image, CASE WHEN doc_id % 10 = 0 THEN 1 - toxic ELSE toxic END AS label FROM labels)
  SELECT image, label, 'first' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT image, label, 'second' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def same_records(v: Views):
    rows = v.table("labels").select(F.col("doc_id").alias("image"), F.col("toxic").alias("label"))
    second = rows.withColumn("label", F.when(F.col("image") % 10 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    return integrity.different_records(rows.filter(F.col("image") % 9 != 0), second)


@query(sql("records", """SELECT a.split AS left_part, b.split AS right_part, count(*) AS shared FROM (SELECT DISTINCT content_hash, split FROM records) a
  JOIN (SELECT DISTINCT content_hash, split FROM records) b ON a.content_hash = b.content_hash AND a.split < b.split GROUP BY ALL"""))
def pairwise_overlap(v: Views):
    return integrity.pairwise_overlap(v.records(), "content_hash", "split")


@query(f"""SELECT {PATH_SQL} AS image, lang AS category, n_chars AS n, NULL::VARCHAR AS role, 'documents' AS dataset FROM documents
  UNION ALL SELECT conv_id || '/' || turn, NULL, NULL, role, 'conversations' FROM conversations""")
def unify_records(v: Views):
    documents = v.table("documents").select(asset_path().alias("image"), F.col("lang").alias("category"), F.col("n_chars").alias("n"))
    turns = v.table("conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("image"), "role")
    return integrity.unify({"documents": documents, "conversations": turns}, ["documents", "conversations"])
