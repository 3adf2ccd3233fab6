"""Differences of nested records: both sides are walked down together, level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.runtime import cut

CONTAINERS = ("OBJECT", "ARRAY")


def _kind(value: Column) -> Column:
    """The type name of a variant without its parameters; NULL where the value is absent, VOID for a JSON null."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _children(frontier: DataFrame, side: str) -> DataFrame:
    """(record, path, <side>) one level below; names are escaped as in JSON pointers, array elements go by position."""
    exploded = frontier.select("record", "path", F.col(side).alias("__v")).lateralJoin(
        frontier.sparkSession.tvf.variant_explode(F.col("__v").outer()))
    name = F.coalesce(F.replace(F.replace(F.col("key"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), F.col("pos").cast("string"))
    return exploded.select("record", F.concat("path", F.lit("/"), name).alias("path"), F.col("value").alias(side))


def nested_differences(declared: DataFrame, actual: DataFrame, key: str, record: str) -> DataFrame:
    """(key, path, declared, actual, reason) where JSON texts of the same key differ, at any depth.

    A difference is one row at the highest place it holds: an added or removed object is not repeated
    for its members, and a changed type ("type") ends the walk there. Equal parts are left at once,
    so a level carries only what leads to a difference; there are as many rounds as the records are
    deep. Keys must be unique on each side and not NULL. A NULL text counts as an absent record,
    a JSON null as a value. The path of the whole record is empty. Texts that are not JSON fail.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(key).alias("record"), F.lit("").alias("path"), F.parse_json(F.col(record)).alias(name))

    left, right, found = side(declared, "declared"), side(actual, "actual"), []
    while True:
        a, b = F.col("declared"), F.col("actual")
        both = a.isNotNull() & b.isNotNull()
        same_container = both & (_kind(a) == _kind(b)) & _kind(a).isin(*CONTAINERS)
        reason = (F.when(a.isNull(), "added").when(b.isNull(), "removed").when(_kind(a) != _kind(b), "type").when(~same_container, "changed"))
        level = left.join(right, ["record", "path"], "full_outer").filter(~F.to_json(a).eqNullSafe(F.to_json(b)))
        level = cut(level.withColumn("reason", reason))
        found.append(level.filter("reason IS NOT NULL").select(
            F.col("record").alias(key), "path", F.to_json(a).alias("declared"), F.to_json(b).alias("actual"), "reason"))
        deeper = level.filter("reason IS NULL")
        if deeper.isEmpty():
            return reduce(DataFrame.unionByName, found)
        left, right = _children(deeper, "declared"), _children(deeper, "actual")
