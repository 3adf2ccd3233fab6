"""Exact order statistics per group without a sort: counting passes over the bits of the values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.scalar import order_bits
from gaugeframe.runtime import cut

DIGIT = 16
PASSES = 64 // DIGIT
CELL_MASK = (1 << DIGIT) - 1


def value_histogram(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, rows, bits) of the values that are not NULL."""
    clean = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("value"))
    return clean.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("rows")).withColumn("bits", order_bits(F.col("value")))


def null_safe_join(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL names meet each other; the names of the left side stay."""
    other = right.withColumnsRenamed({n: f"__r_{n}" for n in names})
    condition = F.lit(True)
    for n in names:
        condition = condition & F.col(n).eqNullSafe(F.col(f"__r_{n}"))
    return left.join(other, condition, how).drop(*[f"__r_{n}" for n in names])


def _found(cells: Column, rank: Column) -> Column:
    """The cell that holds a rank, and the rank inside it; the state of the scan has a fixed size."""
    start = F.struct(rank.cast("bigint").alias("rest"), F.lit(None).cast("bigint").alias("digit"), F.lit(None).cast("double").alias("value"))

    def step(seen: Column, cell: Column) -> Column:
        return (F.when(seen["digit"].isNotNull(), seen)
                .when(seen["rest"] < cell["rows"], F.struct(seen["rest"].alias("rest"), cell["digit"].alias("digit"), cell["value"].alias("value")))
                .otherwise(F.struct((seen["rest"] - cell["rows"]).alias("rest"), seen["digit"].alias("digit"), seen["value"].alias("value"))))

    return F.aggregate(cells, start, step)


def select_ranks(hist: DataFrame, keys: Sequence[str], ranks: dict[str, Column]) -> DataFrame:
    """(keys, n, one column per rank): the values at ranks counted from 0, given as columns of the group size ``n``.

    Each pass counts the next 16 bits among the values that still share the bits found so far, so a
    group is at most 65,536 counts per pass wherever its values lie, and its rows are only ever
    summed. NULL keys form a group. Ranks outside a group give NULL; NaN is the largest value.
    """
    keys = list(keys)
    targets = None
    for turn in range(PASSES):
        shift = 64 - DIGIT * (turn + 1)
        digit = F.shiftright("bits", shift)
        rows = hist
        if turn:
            digit = digit.bitwiseAND(F.lit(CELL_MASK).cast("bigint"))
            open_cells = targets.select(*keys, "prefix").distinct()
            rows = null_safe_join(hist.withColumn("prefix", F.shiftright("bits", shift + DIGIT)), open_cells, [*keys, "prefix"], "left_semi")
        by = [*keys, "prefix"] if turn else keys
        counts = rows.groupBy(*by, digit.alias("digit")).agg(F.sum("rows").alias("rows"), F.max("value").alias("value"))
        cells = counts.groupBy(*by).agg(F.sum("rows").alias("__n"), F.array_sort(F.collect_list(F.struct("digit", "rows", "value"))).alias("__cells"))
        if turn:
            asked = null_safe_join(targets, cells.drop("__n"), by)
        else:
            wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items()])
            asked = cells.withColumnRenamed("__n", "n").withColumn("__wanted", F.explode(wanted)).select(
                *keys, "n", "__wanted.name", "__wanted.rank", F.lit(0).cast("bigint").alias("prefix"), "__cells")
        hit = asked.withColumn("__hit", _found(F.col("__cells"), F.col("rank")))
        prefix = F.shiftleft("prefix", DIGIT).bitwiseOR(F.col("__hit.digit")) if turn else F.col("__hit.digit")
        targets = hit.select(*keys, "n", "name", F.col("__hit.rest").alias("rank"), prefix.alias("prefix"), F.col("__hit.value").alias("value"))
    return targets.groupBy(*keys).agg(F.max("n").alias("n"), *[
        F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in ranks])


def selected_quantiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float], lower: Sequence[str] = ()) -> DataFrame:
    """(keys, n, quantiles): linear between the two values around each rank, or the lower one for names in ``lower``.

    NULL values are left out; a group without values gives no row.
    """
    n = F.col("n")
    place = {name: F.lit(q) * (n - 1) for name, q in points.items()}
    ranks = {}
    for name, at in place.items():
        ranks[f"__{name}_lo"] = F.floor(at)
        if name not in lower:
            ranks[f"__{name}_hi"] = F.least(F.floor(at) + 1, n - 1)
    found = select_ranks(cut(value_histogram(df, keys, value)), keys, ranks)

    def between(name: str) -> Column:
        low = F.col(f"__{name}_lo")
        return low if name in lower else low + (F.col(f"__{name}_hi") - low) * (place[name] - F.floor(place[name]))

    return found.select(*keys, "n", *[between(name).alias(name) for name in points])


def top_means(df: DataFrame, keys: Sequence[str], value: str, fraction: float) -> DataFrame:
    """(keys, n, top_k, mean) of the max(1, floor(fraction * n)) largest values per group.

    Values above the k-th largest are summed whole, the k-th value as often as is left to take.
    """
    keys = list(keys)
    hist = cut(value_histogram(df, keys, value))                # written once, read by every pass
    k = F.greatest(F.lit(1), F.floor(F.col("n") * fraction))
    edge = select_ranks(hist, keys, {"__edge": F.col("n") - k})
    if keys:
        above = null_safe_join(hist, edge, keys)
    else:
        above = hist.withColumn("__one", edge.select(F.struct("n", "__edge")).scalar()).select("*", "__one.*")
    higher = F.col("value") > F.col("__edge")
    sums = above.groupBy(*keys, "n", "__edge").agg(
        F.coalesce(F.sum(F.when(higher, F.col("value") * F.col("rows"))), F.lit(0.0)).alias("__sum"),
        F.coalesce(F.sum(F.when(higher, F.col("rows"))), F.lit(0)).alias("__rows"))
    rest = k - F.col("__rows")
    mean = (F.col("__sum") + F.when(rest > 0, F.col("__edge") * rest).otherwise(0.0)) / k
    return sums.select(*keys, "n", k.alias("top_k"), mean.alias("mean"))
