"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by its content. The ledger lists which (blob, rule, version) triples were scanned
and what was found; a scan reads one representative text per unseen blob and joins the findings back
to every path that holds the blob. Only Spark functions run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.runtime import scratch, tune


@dataclass(frozen=True)
class Rule:
    """A pattern; ``group`` must be ``least`` long or the match is dropped. ``hints`` are lower-case strings of which
    any match holds one, or a pattern if ``hint_pattern``; they only save work."""
    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hints: tuple[str, ...] = ()
    hint_pattern: str | None = None


# The patterns and least lengths. A run shorter than its least length never holds a longer one, so
# the hex and access patterns ask for the length at once.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12,
         hints=("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 0, 18, hints=("akia",)),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16, hint_pattern=r"[0-9a-f]{16}"),
)
SPAN = "array<struct<start:bigint,no:int,end:bigint,kind:string>>"
SALTS = 16            # copies of one blob are dealt over this many tasks; only blobs with findings are repeated for it


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Spans of the leftmost non-overlapping matches: the gaps of a split and the matches alternate."""
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g).cast("bigint"))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda m: F.length(m).cast("bigint"))
    values = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda m: F.length(m))
    steps = F.zip_with(F.slice(gaps, 1, F.size(sizes)), sizes, lambda g, m: F.struct(g.alias("gap"), m.alias("size")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def add(acc: Column, step: Column) -> Column:
        begin = acc["at"] + step["gap"]
        end = begin + step["size"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("out"))

    placed = F.aggregate(steps, start, add, lambda acc: acc["out"])
    long_enough = F.filter(F.zip_with(placed, values, lambda p, v: F.struct(p.alias("p"), v.alias("v"))), lambda x: x["v"] >= rule.least)
    found = F.transform(long_enough, lambda x: F.struct(
        x["p"]["start"].alias("start"), F.lit(number).alias("no"), x["p"]["end"].alias("end"), F.lit(rule.kind).alias("kind")))
    if rule.hint_pattern:
        likely = F.regexp_like(text, F.lit(rule.hint_pattern))
    else:
        likely = F.lit(False)
        for hint in rule.hints:
            likely = likely | F.contains(F.lower(text), F.lit(hint))
    return F.when(likely, found).otherwise(F.array().cast(SPAN)).cast(SPAN)


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], f"blob binary, kind string, version int, spans {SPAN}")


def scan(documents: DataFrame, ledger: DataFrame, doc_id: str = "doc_id", text: str = "text",
         rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger entries (blob, kind, version, spans) for the blobs and rule versions that the ledger lacks.

    A null text is the empty blob. Each unseen blob is read from the row with its smallest id (null ids first), a
    rule runs on a blob once per version.
    """
    tune(documents.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    versions = documents.select(F.col(doc_id).alias("holder"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("blob"))
    holders = versions.groupBy("blob").agg(F.min(F.struct("holder")).alias("h")).select("blob", F.col("h.holder").alias("holder"))
    seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("done"))
    wanted = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    todo = (holders.join(seen, "blob", "left")
            .withColumn("todo", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>"))))
            .filter(F.size("todo") > 0).select("blob", "holder", "todo"))
    texts = documents.select(F.col(doc_id).alias("holder"), body.alias("body"))
    texts = texts.withColumn("blob", F.unhex(F.sha2(F.col("body").cast("binary"), 256)))
    todo = todo.toDF("__blob", "__holder", "todo").hint("shuffle_hash")
    same = F.col("holder").eqNullSafe(F.col("__holder")) & (F.col("blob") == F.col("__blob"))
    chosen = texts.join(todo, same).select("blob", "body", "todo")
    scanned = F.array(*[
        F.when(F.array_contains("todo", f"{r.kind}:{r.version}"), F.struct(
            F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), _spans(F.col("body"), r, i).alias("spans")))
        for i, r in enumerate(rules)])
    entries = chosen.select("blob", F.explode(F.array_compact(scanned)).alias("e")).select("blob", "e.*")
    return entries.dropDuplicates(["blob", "kind", "version"])


def findings(documents: DataFrame, ledger: DataFrame, doc_id: str = "doc_id", text: str = "text",
             rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<kind> per rule, base_sha256, spans: the ledger's findings at every document, one row per input row.

    Copies of a blob are salted by their id, so that no task gets all of them.
    """
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    hits = (ledger.filter(current & (F.size("spans") > 0)).groupBy("blob")
            .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("found"))
            .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    at = documents.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(body, 256)).alias("blob"), F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).alias("salt"))
    spans = F.coalesce("found", F.array().cast(SPAN))
    joined = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
    counts = [number(r.kind).alias(f"n_{r.kind}") for r in rules]
    return at.join(hits, ["blob", "salt"], "left").select("doc_id", *counts, F.sha2(joined.cast("binary"), 256).alias("base_sha256"), joined.alias("spans"))


def record(documents: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger under ``folder`` lacks, append it there and return the whole ledger.

    A version that changes no blob appends nothing.
    """
    spark = documents.sparkSession
    schema = empty_ledger(spark).schema
    old = spark.read.schema(schema).parquet(folder) if _exists(spark, folder) else empty_ledger(spark)
    scan(documents, old, doc_id, text, rules).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def scan_into(documents: DataFrame, folder: str | None = None, doc_id: str = "doc_id", text: str = "text",
              rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Record the documents in the ledger under ``folder`` and return the findings at every document.

    Without a folder a new ledger is kept in the shared folder for this run only. Empty input gives no rows.
    """
    ledger = record(documents, folder or new_ledger_folder(documents.sparkSession), doc_id, text, rules)
    return findings(documents, ledger, doc_id, text, rules)


def _exists(spark, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def new_ledger_folder(spark) -> str:
    return scratch(spark, "secret-ledger")
