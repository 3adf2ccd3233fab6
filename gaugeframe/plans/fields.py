"""Registered queries: vectors, grids, the batch scorer and the stream."""

import numpy as np
from pyspark.sql import functions as F

from gaugeframe.functions.scalar import draw
from gaugeframe.operators import grids, rates, vectors
from gaugeframe.operators.batch_scoring import score_batch as run_scorer
from gaugeframe.plans.registry import query
from gaugeframe.runtime import scratch
from gaugeframe.schemas import DOCUMENT
from gaugeframe.streaming import decisions
from gaugeframe.views import Views, sql_draw, sql_more

NEIGHBOURS = """pairs AS (SELECT q.vec_id AS query_id, q.image, b.vec_id AS neighbour_id, list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - b.embedding[i]) ** 2)) AS distance
    FROM vectors q JOIN vectors b ON NOT q.is_bank AND b.is_bank),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM pairs)"""


def bank_and_queries(v: Views):
    rows = v.vectors()
    return rows.filter("is_bank"), rows.filter("NOT is_bank")


@query(sql_more("vectors", NEIGHBOURS + " SELECT query_id, rank::INT AS rank, neighbour_id, round(distance, 8) AS distance FROM ranked WHERE rank <= 3"))
def knn_exact(v: Views):
    bank, queries = bank_and_queries(v)
    return vectors.knn_exact(queries, bank, 3).select("query_id", "rank", "neighbour_id", F.round("distance", 8).alias("distance"))


@query()          # trained centres have no SQL form; a test measures the recall against the exact search
def knn_approx(v: Views):
    bank, queries = bank_and_queries(v)
    return vectors.knn_approx(queries, bank, 3).select("query_id", "rank", "neighbour_id", F.round("distance", 8).alias("distance"))


@query(sql_more("vectors", NEIGHBOURS + """, patches AS (SELECT query_id, image, avg(distance) AS s FROM ranked WHERE rank <= 3 GROUP BY ALL)
  SELECT image, round(max(s), 8) AS score, count(*) AS patches FROM patches GROUP BY image"""))
def patch_max(v: Views):
    bank, queries = bank_and_queries(v)
    return vectors.patch_max(vectors.knn_exact(queries, bank, 3), queries).withColumn("score", F.round("score", 8))


@query("""WITH RECURSIVE e AS (SELECT vec_id AS id, embedding FROM embeddings),
  d AS (SELECT a.id AS a, b.id AS b, sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]) ** 2))) AS dist FROM e a, e b),
  state AS (SELECT 0 AS step, a AS id, sqrt(sum(dist * dist)) AS val FROM d GROUP BY a
    UNION ALL SELECT s.step + 1, s.id, least(s.val, d.dist) FROM state s JOIN (SELECT id AS pick FROM state ORDER BY val DESC, id LIMIT 1) p ON true
      JOIN d ON d.a = s.id AND d.b = p.pick WHERE s.step < (SELECT floor(count(*) * 0.02) FROM e))
  SELECT step::INT AS pick, first(id ORDER BY val DESC, id) AS id FROM state WHERE step < (SELECT floor(count(*) * 0.02) FROM e) GROUP BY step""")
def farthest_point_coreset(v: Views):
    return vectors.farthest_point_coreset(v.table("embeddings"), 0.02)


@query(f"""WITH w AS (SELECT i, j, (2 * ({sql_draw(13, 'i', 'j')} / 4294967296.0::DOUBLE) - 1) / 8.0::DOUBLE AS weight FROM range(0, 128) a(i), range(0, 64) b(j)),
  e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS j FROM embeddings),
  p AS (SELECT vec_id, i, sum(weight * x) AS y FROM e JOIN w USING (j) GROUP BY ALL)
  SELECT vec_id, round(max(y) FILTER (i = 0), 8) AS first, round(max(y) FILTER (i = 127), 8) AS last, round(sum(y * y), 8) AS square FROM p GROUP BY vec_id""")
def random_projection(v: Views):
    projected = v.table("embeddings").select("vec_id", vectors.random_projection(F.col("embedding"), 64, 128, 13).alias("p"))
    return projected.select("vec_id", F.round(F.get("p", F.lit(0)), 8).alias("first"), F.round(F.get("p", F.lit(127)), 8).alias("last"),
                            F.round(F.aggregate("p", F.lit(0.0), lambda s, x: s + x * x), 8).alias("square"))


# --- grids ----------------------------------------------------------------------------------

@query(sql_more("grid", """k(o) AS (VALUES (0), (1), (2)), p AS (SELECT (floor((o + 0.5) * 8 / 3.0))::INT AS cell FROM k),
  i AS (SELECT kind, image, max((value > 0.3)::INT) AS label, max((value > 0.3 AND y IN (SELECT cell FROM p) AND x IN (SELECT cell FROM p))::INT) AS resized FROM grid GROUP BY ALL)
  SELECT kind, count(*) FILTER (label = 1) AS defective, count(*) FILTER (label = 1 AND resized = 0) AS vanished FROM i GROUP BY kind"""))
def vanishing_masks(v: Views):
    pixels = v.grid().withColumn("label", (F.col("value") > 0.3).cast("int"))
    return grids.vanishing_masks(pixels, ["kind"], (8, 8), (3, 3))


OPEN_SQL = """e AS (SELECT a.image, a.y, a.x, a.flag, min(b.flag) AS eroded FROM {src} a JOIN {src} b ON a.image = b.image AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL),
  opened AS (SELECT a.image, a.y, a.x, a.flag, a.eroded, max(b.eroded) AS opened FROM e a JOIN e b ON a.image = b.image AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL)"""


@query(sql_more("grid", "f AS (SELECT image, y, x, (value > -0.06)::INT AS flag FROM grid), " + OPEN_SQL.format(src="f") + " SELECT image, y, x, flag, eroded, opened FROM opened"))
def morphology_open(v: Views):
    flags = v.grid().select("image", "y", "x", (F.col("value") > -0.06).cast("int").alias("flag"))
    return grids.morphology_open(flags)


@query(sql_more("grid", """g AS (SELECT image, y, x, value, value * value AS second FROM grid),
  edge AS (SELECT g.* FROM g, (VALUES (1), (2), (3), (4)) s(side) WHERE (side = 1 AND x < 1) OR (side = 2 AND x >= 7) OR (side = 3 AND y < 1) OR (side = 4 AND y >= 7)),
  bg AS (SELECT image, quantile_disc(value, 0.5) AS b1, quantile_disc(second, 0.5) AS b2 FROM edge GROUP BY image),
  d AS (SELECT image, sqrt(((value - b1) ** 2 + (second - b2) ** 2) / 2) AS d FROM edge JOIN bg USING (image)),
  m AS (SELECT image, quantile_disc(d, 0.5) AS med, quantile_cont(d, 0.98) AS q98 FROM d GROUP BY image),
  a AS (SELECT image, quantile_disc(abs(d - med), 0.5) AS mad FROM d JOIN m USING (image) GROUP BY image),
  t AS (SELECT image, b1, b2, greatest(0.04, med + 6 * mad, q98) AS threshold FROM bg JOIN m USING (image) JOIN a USING (image)),
  f AS (SELECT image, y, x, (sqrt(((value - b1) ** 2 + (second - b2) ** 2) / 2) > threshold)::INT AS flag FROM g JOIN t USING (image)), """ + OPEN_SQL.format(src="f") + """
  SELECT image, round(any_value(threshold), 8) AS threshold, sum(flag)::BIGINT AS flagged, sum(opened)::BIGINT AS opened FROM opened JOIN t USING (image) GROUP BY image"""))
def robust_foreground(v: Views):
    pixels = v.grid().select("image", "y", "x", "value", (F.col("value") * F.col("value")).alias("second"))
    out = grids.robust_foreground(pixels, ["value", "second"], (8, 8))
    return out.groupBy("image").agg(F.round(F.max("threshold"), 8).alias("threshold"), F.sum("flag").alias("flagged"), F.sum("opened").alias("opened"))


@query(sql_more("grid", """g AS (SELECT *, x < 6 AND y > 0 AS valid FROM grid),
  s AS (SELECT image, count(*) FILTER (valid) AS valid_pixels, avg(value) FILTER (valid) AS mean, max(value) FILTER (valid) AS maximum FROM g GROUP BY image),
  b AS (SELECT image, y // 2 AS block_y, x // 2 AS block_x, avg(valid::INT) AS coverage, coalesce(sum(value) FILTER (valid) / nullif(count(*) FILTER (valid), 0), 0) AS block_mean FROM g GROUP BY ALL)
  SELECT image, valid_pixels, round(mean, 8) AS mean, round(maximum, 8) AS maximum, block_y::INT AS block_y, block_x::INT AS block_x, round(coverage, 8) AS coverage, round(block_mean, 8) AS block_mean FROM s JOIN b USING (image)"""))
def map_statistics(v: Views):
    pixels = v.grid().withColumn("valid", (F.col("x") < 6) & (F.col("y") > 0))
    whole = grids.map_statistics(pixels, "value")
    blocks = grids.block_means(pixels, "value", 2).withColumnRenamed("mean", "block_mean")
    return whole.join(blocks, "image").withColumns({c: F.round(c, 8) for c in ("mean", "maximum", "coverage", "block_mean")})


ALPHA_SQL = "CASE WHEN y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 THEN CASE WHEN y IN (2, 5) OR x IN (2, 5) THEN 0.3::DOUBLE ELSE 0.6::DOUBLE END ELSE 0.0::DOUBLE END"


@query(sql_more("grid", f"""g AS (SELECT image, y, x, value / 2 + 0.5::DOUBLE AS value, {ALPHA_SQL} AS alpha FROM grid),
  o AS (SELECT image, coalesce(lead(image) OVER (ORDER BY image), min(image) OVER ()) AS donor FROM (SELECT DISTINCT image FROM grid)),
  s AS (SELECT image, donor, {sql_draw('shift-y', 'image')} % 5 - 2 AS sy, {sql_draw('shift-x', 'image')} % 5 - 2 AS sx FROM o),
  r AS (SELECT s.image, (d.y + sy + 8) % 8 AS y, (d.x + sx + 8) % 8 AS x, d.value AS replacement FROM s JOIN g d ON d.image = s.donor),
  j AS (SELECT g.*, replacement FROM g JOIN r USING (image, y, x)),
  f AS (SELECT image, avg(value) FILTER (alpha > 0) - avg(replacement) FILTER (alpha > 0) AS shift FROM j GROUP BY image),
  b AS (SELECT image, value, value * (1 - alpha) + greatest(0, least(1, replacement + shift)) * alpha AS blended FROM j JOIN f USING (image))
  SELECT image, round(sum(blended), 6) AS total, round(max(abs(blended - value)), 8) AS largest_change, count(*) FILTER (abs(blended - value) > 1e-6) AS changed FROM b GROUP BY image"""))
def donor_blend(v: Views):
    from gaugeframe.operators.splits import next_donor
    y, x = F.col("y"), F.col("x")
    alpha = F.when(y.between(2, 5) & x.between(2, 5), F.when(y.isin(2, 5) | x.isin(2, 5), 0.3).otherwise(0.6)).otherwise(0.0)
    pixels = v.grid().select("image", "y", "x", (F.col("value") / 2 + 0.5).alias("value"), alpha.alias("alpha"))
    images = v.table("embeddings").select(F.col("vec_id").alias("image"))
    shifts = next_donor(images, [], "image").withColumns({
        "shift_y": draw("shift-y", F.col("image")) % 5 - 2, "shift_x": draw("shift-x", F.col("image")) % 5 - 2})
    out = grids.donor_blend(pixels, shifts, (8, 8))
    return out.groupBy("image").agg(F.round(F.sum("blended"), 6).alias("total"), F.round(F.max(F.abs(F.col("blended") - F.col("value"))), 8).alias("largest_change"),
                                    F.count_if("changed").alias("changed"))


# --- user jobs ------------------------------------------------------------------------------

def norm_scorer():
    def score(batch):
        return np.sqrt((np.stack(batch["embedding"].to_numpy()).astype(np.float64) ** 2).sum(1)) * batch["label"].to_numpy()
    return score


@query("""SELECT vec_id, label, round(score, 8) AS score, score >= 4 AS predicted_defective FROM
  (SELECT vec_id, label, label * sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AS score FROM embeddings WHERE label IN (1, 3, 5, 7, 9))""")
def score_batch(v: Views):
    scored = run_scorer(v.table("embeddings"), norm_scorer, 4.0, categories=[1, 3, 5, 7, 9], category="label", payload=("embedding",))
    return scored.withColumn("score", F.round("score", 8))


@query(sql_more("uploads predictions", """t AS (SELECT category, quantile_cont(score, 0.9) AS threshold FROM predictions WHERE label = 0 AND category <> 'de' GROUP BY category),
  a AS (SELECT asset_id, u.category, size_bytes, width, height, n_chars::DOUBLE AS score FROM uploads u JOIN documents d ON d.doc_id = u.asset_id)
  SELECT asset_id, category, CASE WHEN size_bytes > 10485760 THEN 'refused: bytes' WHEN width::BIGINT * height > 20000000 THEN 'refused: pixels'
    WHEN least(width, height) < 16 OR greatest(width, height) > 2048 THEN 'refused: dimensions' WHEN threshold IS NULL THEN 'refused: category'
    WHEN score >= threshold THEN 'defective' ELSE 'normal' END AS outcome FROM a LEFT JOIN t USING (category)"""))
def stream_decisions(v: Views):
    arrivals = decisions.read_arrivals(v.spark, f"{v.folder}/documents[.]parquet", DOCUMENT).select(
        F.col("doc_id").alias("asset_id"), F.col("lang").alias("category"), (F.col("n_chars") * 1024).alias("size_bytes"),
        (8 + (F.col("doc_id") * 7919) % 2600).cast("int").alias("width"), (8 + (F.col("doc_id") * 104729) % 9000).cast("int").alias("height"),
        F.col("n_chars").cast("double").alias("score"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 600).alias("arrived"))
    frozen = scratch(v.spark, "thresholds")
    rates.normal_threshold(v.predictions().filter(F.col("category") != "de"), 0.9, ["category"]).write.parquet(frozen)
    decided = decisions.decide(arrivals, v.spark.read.parquet(frozen)).select("asset_id", "category", "outcome", "arrived")
    path = scratch(v.spark, "decisions")
    decisions.drain_once(decided, "asset_id", "arrived", "1 hour", path, scratch(v.spark, "decisions-progress"))
    return v.spark.read.schema("asset_id long, category string, outcome string").parquet(f"{path}/decisions").drop("batch")
