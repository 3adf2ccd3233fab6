"""Reproducible splits, batches, case banks and donors, all from hash order."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.scalar import draw
from gaugeframe.operators.prefix import hash_index, ordered_index


def order_digest(seed: int | str, *columns: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns]), 256)


def seeded_split(records: DataFrame, seed: int, validation: float = 0.15, calibration: float = 0.15,
                 category: str = "category", path: str = "path") -> DataFrame:
    """Cut each category in hash order: validation first, then calibration, the rest trains."""
    if not (0 < validation < 1 and 0 < calibration < 1 and validation + calibration < 1):
        raise ValueError("fractions must be positive with a sum below 1")
    numbered = hash_index(records, [category], order_digest(seed, F.col(category), F.col(path)), [path])
    n = F.col("n")
    first = F.greatest(F.lit(1), F.least(n - 2, F.bround(n * validation)))
    second = F.greatest(F.lit(1), F.least(n - first - 1, F.bround(n * calibration)))
    split = (F.when(F.col("idx") < first, "validation").when(F.col("idx") < first + second, "calibration").otherwise("train"))
    return numbered.withColumn("split", split).drop("idx", "n")


def _two_digits(n: Column) -> Column:
    """A count rounded down to its two leading digits."""
    step = F.pow(F.lit(10.0), F.greatest(F.floor(F.log10(F.greatest(n, F.lit(1)).cast("double"))) - 1, F.lit(0)))
    return (F.floor(n / step) * step).cast("bigint")


def allot(classes: Sequence[tuple[int, float, float]], shares: Sequence[float]) -> list[list[int]]:
    """How many groups of each class (count, normal rows and defective rows a group) go to each split.

    Classes are taken in the given order. What the earlier ones left each split short of its share, in both labels, is
    carried on: every split asks for the number of groups that best closes its own gap, and whole groups go to the largest requests.
    """
    totals = [max(1.0, sum(c[0] * c[1 + label] for c in classes)) for label in (0, 1)]
    gaps, out = [[0.0, 0.0] for _ in shares], []
    for count, *rows in classes:
        weights = [(rows[label] / totals[label], totals[label]) for label in (0, 1)]
        scale = max(1e-300, sum(w * w for w, _ in weights))
        for gap, share in zip(gaps, shares):
            for label in (0, 1):
                gap[label] += share * count * rows[label]
        asked = [max(0.0, sum(w * gap[label] / total for label, (w, total) in enumerate(weights)) / scale) for gap in gaps]
        fit = count / sum(asked) if sum(asked) else 0.0
        exact = [a * fit if fit else count * share for a, share in zip(asked, shares)]
        given = [math.floor(x + 1e-9) for x in exact]
        for place in sorted(range(len(shares)), key=lambda i: (round(given[i] - exact[i], 6), i))[:count - sum(given)]:
            given[place] += 1
        for gap, n in zip(gaps, given):
            for label in (0, 1):
                gap[label] -= n * rows[label]
        out.append(given)
    return out


def grouped_stratified_split(records: DataFrame, seed: int, group: str = "group", label: str = "label",
                             fractions: tuple[float, float] = (0.70, 0.85)) -> DataFrame:
    """Whole groups to train / validation / calibration, close to 70 / 15 / 15 for both labels.

    Groups with about the same numbers of normal and defective rows (to two digits) form a class. Classes are dealt from the largest groups
    to the smallest, each making up for what the earlier ones left a split short of in either label; inside a class hash order
    decides. Labels other than 0 and 1 are an error. The driver sees one row a class, whose number the two digits bound.
    """
    names = ("train", "validation", "calibration")
    shares = (fractions[0], fractions[1] - fractions[0], 1 - fractions[1])
    known = F.coalesce(F.col(label).isin(0, 1), F.lit(False))
    checked = records.withColumn(label, F.when(known, F.col(label)).otherwise(F.raise_error(F.lit("labels must be 0 or 1")).cast(records.schema[label].dataType)))
    groups = checked.groupBy(group).agg(F.count_if(F.col(label) == 0).alias("normal"), F.count_if(F.col(label) == 1).alias("defective"))
    groups = groups.withColumns({"__a": _two_digits(F.col("normal")), "__b": _two_digits(F.col("defective"))})
    rows = groups.groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("n"), F.sum("normal").alias("normal"), F.sum("defective").alias("defective")).collect()
    rows.sort(key=lambda r: (-(r["__a"] + r["__b"]), r["__a"]))
    counts = allot([(r["n"], r["normal"] / r["n"], r["defective"] / r["n"]) for r in rows], shares)
    limits = records.sparkSession.createDataFrame(
        [(r["__a"], r["__b"], c[0], c[0] + c[1]) for r, c in zip(rows, counts)], "__a long, __b long, __first long, __second long")
    placed = hash_index(groups, ["__a", "__b"], order_digest(seed, F.col(group)), [group]).join(limits, ["__a", "__b"])
    split = F.when(F.col("idx") < F.col("__first"), names[0]).when(F.col("idx") < F.col("__second"), names[1]).otherwise(names[2])
    return checked.join(placed.select(group, split.alias("split")), group)


def splits_without_both_labels(records: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    return (records.groupBy(split).agg(F.count_if(F.col(label) == 0).alias("normal"), F.count_if(F.col(label) == 1).alias("defective"))
            .filter((F.col("normal") == 0) | (F.col("defective") == 0)))


def balanced_batches(records: DataFrame, batch_size: int, seed: int, key: str, label: str = "label") -> DataFrame:
    """ceil(n / batch) batches, half of each label, drawn with replacement."""
    if batch_size < 2 or batch_size % 2:
        raise ValueError("balanced batches need an even size of at least 2")
    numbered = hash_index(records.select(key, label), [label], order_digest(seed, F.col(key)), [key])
    sizes = {r[label]: r["n"] for r in numbered.groupBy(label).agg(F.max("n").alias("n")).collect()}   # two labels
    if set(sizes) != {0, 1}:
        raise ValueError("balanced batches need both labels")
    batches = math.ceil(sum(sizes.values()) / batch_size)
    half = batch_size // 2
    slots = records.sparkSession.range(batches * batch_size).select(
        F.floor(F.col("id") / batch_size).alias("batch"), (F.col("id") % batch_size).cast("int").alias("slot"))
    wanted = slots.withColumn(label, F.when(F.col("slot") < half, 0).otherwise(1))
    count = F.when(F.col(label) == 0, F.lit(sizes[0])).otherwise(F.lit(sizes[1]))
    wanted = wanted.withColumn("idx", F.pmod(draw(f"{seed}-slot", F.col("batch"), F.col("slot")), count))
    return wanted.join(numbered.select(label, "idx", key), [label, "idx"]).select("batch", "slot", label, key)


def case_bank(sources: DataFrame, families: Sequence[str], seed: int, index: str) -> DataFrame:
    """Each source once clean and once per challenge family, with the seed of its first attempt."""
    challenges = F.array(*[F.struct(F.lit(-1).alias("no"), F.lit("clean").alias("family"))],
                         *[F.struct(F.lit(i).alias("no"), F.lit(name).alias("family")) for i, name in enumerate(families)])
    rows = sources.withColumn("case", F.explode(challenges))
    number = F.col("case.no").cast("bigint")
    return rows.select(*sources.columns, F.col("case.family").alias("family"),
                       F.when(number < 0, 0).otherwise(1).alias("label"),
                       F.when(number >= 0, F.lit(seed) + F.col(index) * 10_000 + number * 100).alias("seed"))


def first_nonempty(cases: DataFrame, positive: Column, keys: Sequence[str], limit: int = 64) -> DataFrame:
    """The smallest attempt below the limit whose mask is not empty; failures keep a NULL attempt.

    ``positive`` may use ``attempt``.
    """
    tried = cases.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(limit - 1))))
    return tried.groupBy(*keys).agg(F.min(F.when(positive, F.col("attempt"))).alias("attempt"))


def next_donor(records: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """Each record takes the next one of its category as donor; the last takes the first, a single one none (NULL)."""
    keys = list(keys)
    numbered = ordered_index(records.select(*keys, path), keys, [path])
    wanted = numbered.withColumn("__want", F.when(F.col("n") > 1, (F.col("idx") + 1) % F.col("n")))
    donors = numbered.select(*keys, F.col("idx").alias("__want"), F.col(path).alias("donor"))
    return wanted.join(donors, [*keys, "__want"], "left").select(*keys, F.col(path), "donor")


def random_donor(records: DataFrame, keys: Sequence[str], path: str, seed: int) -> DataFrame:
    """A drawn donor of the same category that is never the recipient itself; NULL for the only record of a category."""
    keys = list(keys)
    numbered = hash_index(records.select(*keys, path), keys, order_digest(seed, F.col(path)), [path])
    pick = F.pmod(draw(f"{seed}-donor", F.col(path)), F.greatest(F.col("n") - 1, F.lit(1)))
    wanted = numbered.withColumn("__want", F.when(F.col("n") > 1, pick + F.when(pick >= F.col("idx"), 1).otherwise(0)))
    donors = numbered.select(*keys, F.col("idx").alias("__want"), F.col(path).alias("donor"))
    return wanted.join(donors, [*keys, "__want"], "left").select(*keys, F.col(path), "donor")


def random_subset(records: DataFrame, fraction: float, seed: int, key: str) -> DataFrame:
    """int(n * fraction) rows without replacement."""
    if fraction >= 1:
        return records
    numbered = hash_index(records, [], order_digest(seed, F.col(key)), [key])
    return numbered.filter(F.col("idx") < F.floor(F.col("n") * fraction)).drop("idx", "n")
