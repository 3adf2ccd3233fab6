"""The registered queries of the corpus operators and their SQL for the second engine."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm import (ball_codes, bpe, chat, exact_dedup, lattice_lm, mixing, near_dedup, quality, secrets, topk, toxicity, warc,
                            whitening)

# A conversation whose texts are made of control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, folder, "documents"), words=4, percent=80)


def op2_lattice_lm(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    return lattice_lm.lattice_scores(_read(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), held_out)


def op3_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _read(spark, folder, "embeddings").filter(topk.usable("embedding"))
    vectors = vectors.select("vec_id", topk.quantised("embedding").alias("terms"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    turns = _read(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_conversations(turns))


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_round_trip(_read(spark, folder, "pages"))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, folder, "documents"), keep="largest")


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.calibrated(_read(spark, folder, "documents"))


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(bpe.encode(_read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    return toxicity.grade(docs, toxicity.train(docs, _read(spark, folder, "labels")))


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Two versions through one ledger: half of the documents, then all of them, of which only unseen texts are scanned."""
    docs = _read(spark, folder, "documents")
    ledger = secrets.new_ledger_folder(spark)
    secrets.record(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0), ledger)
    return secrets.scan_into(docs, ledger)


def op11_ball_codes(spark: SparkSession, folder: str) -> DataFrame:
    return ball_codes.digests(_read(spark, folder, "embeddings").filter(topk.usable("embedding")))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(_read(spark, folder, "embeddings").filter(topk.usable("embedding")))


def op13_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, held_out = _read(spark, folder, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = quality.train(docs, _read(spark, folder, "labels").filter(~held_out))
    scored = quality.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, folder)


def _codes_sql() -> str:
    """Two rounds of exhaustive assignment and floored means; part and position count from 0."""
    nearest = """SELECT i, part, min(d * 64 + entry) % 64 AS entry, min(d) AS d FROM (
            SELECT i, p.part, entry, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
            FROM p JOIN {book} c ON p.part = c.part) GROUP BY i, part"""
    means = """SELECT part, entry, list(v ORDER BY k) AS x FROM (
            SELECT part, entry, k, floor(sum(v) / count(*))::BIGINT AS v
            FROM (SELECT a.part, a.entry, g.k, p.x[g.k + 1] AS v FROM {codes} a JOIN p ON a.i = p.i AND a.part = p.part, w, range(w.w) g(k)) GROUP BY part, entry, k)
            GROUP BY part, entry"""
    steps = []
    for n in range(3):
        steps.append(f"a{n} AS MATERIALIZED ({nearest.format(book=f'c{n}')})")
        if n < 2:
            steps.append(f"m{n} AS ({means.format(codes=f'a{n}')})")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m ON c.part = m.part AND c.entry = m.entry)")
    return f"""
        WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, vec_id, label,
                          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        w AS (SELECT max(len(x)) // 16 AS w FROM v),
        p AS MATERIALIZED (SELECT i, g.part, x[g.part * w.w + 1 : g.part * w.w + w.w] AS x FROM v, w, range(16) g(part)),
        c0 AS (SELECT part, i AS entry, x FROM p WHERE i < 64), {", ".join(steps)},
        e AS (SELECT i, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY i),
        h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2),
        l AS (SELECT label, sum(error)::BIGINT AS label_error FROM e JOIN v USING (i) GROUP BY label)
        SELECT vec_id, code, error, label_error, codebooks_sha256 FROM e JOIN v USING (i) JOIN l ON v.label IS NOT DISTINCT FROM l.label, h"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_near_dedup, op2_lattice_lm, op3_top_k, op4_chat_format, op5_warc, op6_exact_dedup, op7_mixing,
                            op8_bpe, op9_toxicity, op10_secrets, op11_ball_codes, op12_whitening, op13_quality, pipeline)}

ORACLES: dict[str, str] = {
    "op11_ball_codes": _codes_sql(),
    "op3_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS t FROM embeddings
                   WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.t, c.t), lambda p: p[1] * p[2]))::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM d JOIN g USING (text)""",
}
