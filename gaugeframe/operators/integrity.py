"""Audit operators. Each returns the violations; an empty result means the data passed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.scalar import row_digest, unsafe_path


def changed_content(stored: DataFrame, actual: DataFrame, key: str, stored_hash: str, actual_hash: str) -> DataFrame:
    """Stored hashes that no longer match, and records whose content is gone."""
    found = actual.select(key, F.col(actual_hash).alias("actual_hash"))
    joined = stored.select(key, F.col(stored_hash).alias("stored_hash")).join(found, key, "left")
    return joined.filter(~F.col("stored_hash").eqNullSafe(F.col("actual_hash"))).select(
        key, F.when(F.col("actual_hash").isNull(), "missing").otherwise("changed").alias("reason"))


def unpaired(records: DataFrame, partners: DataFrame, key: str) -> DataFrame:
    """Records that need a partner (a mask) and have none."""
    return records.join(partners.select(key).distinct(), key, "left_anti")


def outside_known(present: DataFrame, known: Sequence[DataFrame], key: str) -> DataFrame:
    """Present keys that belong to none of the known sets."""
    return present.join(union_known(known, key), key, "left_anti")


def union_known(sets: Sequence[DataFrame], key: str) -> DataFrame:
    union = sets[0].select(key)
    for more in sets[1:]:
        union = union.unionByName(more.select(key))
    return union.distinct()


def geometry_violations(images: DataFrame, masks: DataFrame, key: str) -> DataFrame:
    m = masks.select(key, F.col("width").alias("mask_width"), F.col("height").alias("mask_height"))
    return images.join(m, key).filter(
        (F.col("width") != F.col("mask_width")) | (F.col("height") != F.col("mask_height"))
    ).select(key, F.lit("size differs").alias("reason"))


def mask_value_violations(pixels: DataFrame, key: str, value: str) -> DataFrame:
    """Masks with values other than 0 and 255, and masks without a positive pixel."""
    checked = pixels.groupBy(key).agg(
        F.count_if(~F.col(value).isin(0, 255)).alias("odd"), F.max(value).alias("top"))
    reason = F.when(F.col("odd") > 0, "not binary").when(F.col("top") == 0, "empty")
    return checked.select(key, reason.alias("reason")).filter("reason IS NOT NULL")


def membership(expected: DataFrame, actual: DataFrame, key: str, compare: str) -> DataFrame:
    """Every expected key exactly once: missing, foreign, duplicated or differing rows."""
    want = expected.groupBy(key).agg(F.count(F.lit(1)).alias("expected_rows"), F.max(compare).alias("expected_value"))
    have = actual.groupBy(key).agg(F.count(F.lit(1)).alias("actual_rows"), F.max(compare).alias("actual_value"),
                                   F.min(compare).alias("actual_low"))
    reason = (F.when(F.col("actual_rows").isNull(), "missing").when(F.col("expected_rows").isNull(), "foreign")
              .when(F.col("actual_rows") > 1, "duplicate")
              .when(~F.col("expected_value").eqNullSafe(F.col("actual_value")), "differs"))
    return want.join(have, key, "full_outer").select(key, reason.alias("reason")).filter("reason IS NOT NULL")


def missing_required(required: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    return required.join(actual.select(*keys).distinct(), list(keys), "left_anti").select(*keys)


def declared_grid(sources: DataFrame, name: str, values: Sequence[str]) -> DataFrame:
    """Each source once per declared value; the list is literal, so no join is needed."""
    return sources.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def grid_violations(actual: DataFrame, source: str, condition: str, declared: Sequence[str]) -> DataFrame:
    """Sources lacking a declared condition, holding it twice, or holding an undeclared one."""
    cells = actual.groupBy(source, condition).agg(F.count(F.lit(1)).alias("rows"))
    wanted = declared_grid(cells.select(source).distinct(), condition, declared).withColumn("declared", F.lit(True))
    reason = (F.when(F.col("rows").isNull(), "missing").when(F.col("declared").isNull(), "undeclared")
              .when(F.col("rows") > 1, "repeated"))
    return (wanted.join(cells, [source, condition], "full_outer")
            .select(source, condition, F.coalesce("rows", F.lit(0)).alias("rows"), reason.alias("reason"))
            .filter("reason IS NOT NULL"))


def out_of_range(df: DataFrame, key: str, score: str, label: str, low: float, high: float) -> DataFrame:
    s = F.col(score)
    reason = (F.when(s.isNull() | F.isnan(s), "not a number").when(F.abs(s) == float("inf"), "infinite")
              .when(~s.between(low, high), "out of range").when(~F.coalesce(F.col(label).isin(0, 1), F.lit(False)), "label"))
    return df.select(key, reason.alias("reason")).filter("reason IS NOT NULL")


def split_counts(records: DataFrame) -> DataFrame:
    """Totals per split and details per category and defect in one pass."""
    return records.rollup("split", "category", "defect").agg(
        F.count(F.lit(1)).alias("images"), F.count_if(F.col("label") == 0).alias("normal"),
        F.count_if(F.col("label") == 1).alias("defective"), F.grouping_id().alias("level")
    ).filter(F.col("level") < 7).select("split", "category", "defect", "images", "normal", "defective")


def count_violations(records: DataFrame, expected: DataFrame, minimum_normals: int = 3) -> DataFrame:
    """Declared counts per category that do not hold, and too few examples of a kind."""
    have = records.groupBy("category").agg(
        F.count(F.lit(1)).alias("images"),
        F.count_if((F.col("split") != "test") & (F.col("label") == 0)).alias("training_normals"),
        F.count_if((F.col("split") == "test") & (F.col("label") == 0)).alias("test_normals"),
        F.count_if((F.col("split") == "test") & (F.col("label") == 1)).alias("test_defective"))
    joined = expected.join(have, "category", "left").fillna(0)
    reasons = F.array_compact(F.array(
        F.when(F.col("images") != F.col("expected_images"), F.lit("count differs")),
        F.when(F.col("training_normals") < minimum_normals, F.lit("too few normals")),
        F.when(F.col("test_normals") == 0, F.lit("no normal tests")),
        F.when(F.col("test_defective") == 0, F.lit("no defective tests"))))
    return joined.select("category", "images", "expected_images", F.explode(reasons).alias("reason"))


def shared_between(records: DataFrame, key: str, part: str) -> DataFrame:
    """Keys present in more than one part, with the parts (few and declared) in order."""
    return (records.select(key, part).distinct().groupBy(key)
            .agg(F.sort_array(F.collect_set(part)).alias("parts")).filter(F.size("parts") > 1))


def pairwise_overlap(records: DataFrame, key: str, part: str) -> DataFrame:
    """How many keys every pair of parts has in common."""
    shared = shared_between(records, key, part)
    first = shared.select(key, "parts", F.explode("parts").alias("left_part"))
    return (first.select("left_part", F.explode("parts").alias("right_part")).filter(F.col("left_part") < F.col("right_part"))
            .groupBy("left_part", "right_part").agg(F.count(F.lit(1)).alias("shared")))


def copy_pairs(files: DataFrame, name: str, hashed: str, suffix: str = r" \(copy\)") -> DataFrame:
    """Files named as copies, and whether they are byte-identical to their original."""
    copies = files.filter(F.col(name).rlike(suffix)).select(
        F.col(name).alias("copy"), F.col(hashed).alias("copy_hash"), F.regexp_replace(F.col(name), suffix, "").alias("original"))
    originals = files.select(F.col(name).alias("original"), F.col(hashed).alias("original_hash"))
    return copies.join(originals, "original", "left").select(
        "copy", "original", F.coalesce(F.col("copy_hash") == F.col("original_hash"), F.lit(False)).alias("identical"))


def different_records(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one run that the other lacks, counted with repetitions."""
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(
        b.exceptAll(a).withColumn("only_in", F.lit("second")))


def frame_digest(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One digest for a whole frame, whatever the order and partitioning of its rows.

    Four 60-bit words of every row digest are summed and hashed with the row count, so the work is
    a plain partial aggregation and any added, removed or edited row changes the result.
    """
    digest = row_digest(names)
    words = [F.conv(F.substring("__digest", 15 * i + 1, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = df.withColumn("__digest", digest).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(w).alias(f"__w{i}") for i, w in enumerate(words)])
    text = F.concat_ws("|", F.col("rows").cast("string"), *[F.col(f"__w{i}").cast("string") for i in range(4)])
    return sums.select(*keys, "rows", F.sha2(text, 256).alias("digest"))


def portable(df: DataFrame, dictionary: DataFrame, column: str, root: str) -> DataFrame:
    """Local paths replaced by manifest-relative ones; what stays absolute is marked."""
    joined = df.join(dictionary.select(F.col("local_path").alias(column), "relative_path"), column, "left")
    stripped = F.when(F.startswith(F.col(column), F.lit(root)), F.substr(F.col(column), F.lit(len(root) + 1))).otherwise(F.col(column))
    path = F.coalesce("relative_path", stripped)
    return joined.withColumn("portable_path", path).withColumn(
        "leftover", unsafe_path(path)).drop("relative_path")


def unify(frames: dict[str, DataFrame], known: Sequence[str]) -> DataFrame:
    """Record schemas of several datasets under one tag; an unknown tag is an error."""
    odd = sorted(set(frames) - set(known))
    if odd:
        raise ValueError(f"unsupported dataset schema: {odd}")
    out = None
    for tag, frame in frames.items():
        tagged = frame.withColumn("dataset", F.lit(tag))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
