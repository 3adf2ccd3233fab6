"""The evaluation data model as views over the given tables.

Every view exists twice: as a DataFrame here and as SQL text in ``SQL`` for the second engine.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.functions.scalar import content_hash, draw
from gaugeframe.operators.prefix import running_totals
from gaugeframe.runtime import tune

# Score factor and shift per stress condition (all scores stay whole numbers).
CONDITIONS = {"original": (10, 0, 1), "blur": (9, 37, 401), "dark": (8, 0, 1), "bright": (12, 0, 1), "jpeg": (10, 53, 599)}
SPLITS = ("train", "validation", "calibration", "test")


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def assets(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id").alias("asset_id"), asset_path().alias("path"), F.col("lang").alias("category"),
            F.col("source").alias("defect"), F.col("text").alias("content"),
            content_hash(F.col("text")).alias("content_hash"), F.col("n_chars").alias("n"))

    def records(self) -> DataFrame:
        docs = self.table("documents").withColumn("slot", draw("split", F.col("doc_id")) % 100)
        labels = self.table("labels").select("doc_id", F.col("toxic").alias("label"))
        split = (F.when(F.col("slot") < 56, "train").when(F.col("slot") < 68, "validation")
                 .when(F.col("slot") < 80, "calibration").otherwise("test"))
        return docs.join(labels, "doc_id", "left").select(
            F.col("doc_id").alias("asset_id"), asset_path().alias("path"), F.col("lang").alias("category"),
            F.col("source").alias("defect"), F.coalesce("label", F.lit(0)).alias("label"), split.alias("split"),
            content_hash(F.col("text")).alias("content_hash"), F.col("n_chars").alias("n"))

    def predictions(self) -> DataFrame:
        docs = self.table("documents").select("doc_id", "lang", "source", "n_chars")
        return self.table("labels").join(docs, "doc_id").select(
            F.col("doc_id").alias("image"), F.col("lang").alias("category"), F.col("source").alias("defect"),
            F.col("toxic").alias("label"), F.col("n_chars").cast("double").alias("score"))

    def pixels(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("image"), (F.col("l_tax") <= 0.07).alias("valid"),
            (F.col("l_discount") >= 0.09).cast("int").alias("label"),
            (F.floor(F.col("l_extendedprice") / 10) / 10000.0).alias("score"))

    def grid(self) -> DataFrame:
        """Embeddings read as 8 x 8 single-channel maps."""
        cells = self.table("embeddings").select(
            F.col("vec_id").alias("image"), F.col("label").alias("kind"), F.posexplode("embedding"))
        return cells.select(
            "image", "kind", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).alias("x"),
            F.col("col").cast("double").alias("value"))

    def conditions(self) -> DataFrame:
        variants = F.explode(F.array(*[
            F.struct(F.lit(name).alias("condition"), variant_score(*rule).alias("variant"))
            for name, rule in CONDITIONS.items()])).alias("v")
        return self.predictions().select("image", "label", "score", variants).select(
            F.col("image").alias("group_id"), F.col("v.condition").alias("condition"), "label",
            F.col("v.variant").alias("score"))

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            "vec_id", F.floor(F.col("vec_id") / 8).alias("image"), "embedding", (F.col("label") < 5).alias("is_bank"))

    def thumbs(self) -> DataFrame:
        """Per asset: a 64-bin letter histogram as thumbnail and a 72-bin one as grey grid."""
        docs = self.table("documents")
        return docs.select(
            asset_path().alias("path"), content_hash(F.col("text")).alias("content_hash"),
            letter_histogram(64)("text").alias("thumb"), letter_histogram(72)("text").alias("grey"))

    def uploads(self) -> DataFrame:
        """Declared sizes of arriving files."""
        return self.table("documents").select(
            F.col("doc_id").alias("asset_id"), F.col("lang").alias("category"),
            (F.col("n_chars") * 1024).alias("size_bytes"),
            (8 + (F.col("doc_id") * 7919) % 2600).cast("int").alias("width"),
            (8 + (F.col("doc_id") * 104729) % 9000).cast("int").alias("height"))

    def history(self) -> DataFrame:
        """One run per user, one epoch per event in the order of the event ids."""
        events = self.table("events").select(
            F.col("user_id").alias("run"), "event_id", F.col("value").alias("metric"), "event_type",
            F.lit(1).cast("bigint").alias("one"))
        numbered = running_totals(events, ["run"], ["event_id"], ["one"], source=events.select("run", "event_id"))
        return numbered.select("run", (F.col("one_before") + 1).alias("epoch"), "metric", "event_type")

    def candidates(self) -> DataFrame:
        return self.table("supplier").select(
            F.sha2(F.col("s_name").cast("binary"), 256).alias("checkpoint_sha256"), F.col("s_suppkey").alias("seed"),
            F.round((F.col("s_acctbal") + 1000) / 12000, 2).alias("validation_score"),
            (100 + (F.col("s_suppkey") * 7919) % 997).cast("double").alias("latency"),
            F.when(F.col("s_suppkey") % 5 == 0, "baseline").otherwise("joint").alias("kind"),
            F.col("s_nationkey").alias("category"))


def asset_path():
    return F.concat(F.col("source"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))


def variant_score(factor: int, step: int, modulus: int):
    whole = F.col("score") * factor
    return whole + (F.col("image") * step % modulus) * 20.0 if step else whole


def letter_histogram(bins: int):
    """Share of the whole text's characters in each code-point class."""
    @F.pandas_udf("array<double>")
    def histogram(texts: pd.Series) -> pd.Series:
        def one(text: str) -> np.ndarray:
            codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            return np.bincount(codes % bins, minlength=bins) / max(1, len(codes))
        return texts.map(one)
    return histogram


_PATH = "source || '/' || lpad(doc_id::VARCHAR, 9, '0')"
_HISTOGRAM = """
  (SELECT doc_id, list(coalesce(c, 0) / len ORDER BY slot) AS bins FROM
    (SELECT doc_id, slot, len FROM (SELECT doc_id, greatest(length(text), 1) AS len FROM documents), range(0, {bins}) r(slot))
    LEFT JOIN (SELECT doc_id, ascii(ch) % {bins} AS slot, count(*) AS c FROM
      (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ALL) USING (doc_id, slot)
   GROUP BY doc_id)"""


def sql_draw(seed, *parts: str) -> str:
    text = ", ".join([f"'{seed}'"] + [f"({p})::VARCHAR" for p in parts])
    return f"('0x' || substr(sha256(concat_ws('|', {text})), 1, 8))::UBIGINT::BIGINT"


def _sql_conditions() -> str:
    return " UNION ALL ".join(
        f"SELECT image AS group_id, '{name}' AS condition, label, score * {f}"
        + (f" + (image * {s} % {m}) * 20.0" if s else "") + " AS score FROM predictions"
        for name, (f, s, m) in CONDITIONS.items())


SQL = {
    "assets": f"SELECT doc_id AS asset_id, {_PATH} AS path, lang AS category, source AS defect, text AS content, "
              "sha256(text) AS content_hash, n_chars AS n FROM documents",
    "records": f"""SELECT doc_id AS asset_id, {_PATH} AS path, lang AS category, source AS defect,
        coalesce(toxic, 0) AS label,
        CASE WHEN slot < 56 THEN 'train' WHEN slot < 68 THEN 'validation' WHEN slot < 80 THEN 'calibration' ELSE 'test' END AS split,
        sha256(text) AS content_hash, n_chars AS n
        FROM (SELECT *, {sql_draw('split', 'doc_id')} % 100 AS slot FROM documents) LEFT JOIN labels USING (doc_id)""",
    "predictions": "SELECT doc_id AS image, lang AS category, source AS defect, toxic AS label, n_chars::DOUBLE AS score "
                   "FROM labels JOIN documents USING (doc_id)",
    "pixels": "SELECT l_suppkey AS image, l_tax <= 0.07 AS valid, (l_discount >= 0.09)::INT AS label, "
              "floor(l_extendedprice / 10) / 10000.0 AS score FROM lineitem",
    "grid": """SELECT image, kind, (pos // 8)::INT AS y, (pos % 8)::INT AS x, embedding[pos + 1]::DOUBLE AS value FROM
        (SELECT vec_id AS image, label AS kind, embedding, unnest(range(0, len(embedding))) AS pos FROM embeddings)""",
    "conditions": _sql_conditions(),
    "vectors": "SELECT vec_id, vec_id // 8 AS image, embedding, label < 5 AS is_bank FROM embeddings",
    "thumbs": f"""SELECT {_PATH} AS path, sha256(text) AS content_hash, a.bins AS thumb, b.bins AS grey
        FROM documents JOIN {_HISTOGRAM.format(bins=64)} a USING (doc_id) JOIN {_HISTOGRAM.format(bins=72)} b USING (doc_id)""",
    "uploads": """SELECT doc_id AS asset_id, lang AS category, n_chars * 1024 AS size_bytes,
        (8 + (doc_id * 7919) % 2600)::INT AS width, (8 + (doc_id * 104729) % 9000)::INT AS height FROM documents""",
    "history": """SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch,
        value AS metric, event_type FROM events""",
    "candidates": """SELECT sha256(s_name) AS checkpoint_sha256, s_suppkey AS seed, round((s_acctbal + 1000) / 12000, 2) AS validation_score,
        (100 + (s_suppkey * 7919) % 997)::DOUBLE AS latency, CASE WHEN s_suppkey % 5 = 0 THEN 'baseline' ELSE 'joint' END AS kind,
        s_nationkey AS category FROM supplier""",
}
_NEEDS = {"conditions": ["predictions"]}


def sql(names: str, body: str) -> str:
    """Put the named views in front of a query as common table expressions."""
    ordered: list[str] = []
    for name in names.split():
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in ordered) + "\n" + body.strip()


def sql_more(names: str, body: str) -> str:
    """Like ``sql`` for a body that continues the list of common table expressions."""
    return sql(names, "").rstrip() + ",\n" + body.strip()
