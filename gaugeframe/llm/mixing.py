"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell of source, language and topic; the cells are raked to the marginal targets in
turn until every marginal fits. A cell's factor, scaled to a token budget, is the expected number of copies of its
documents: the whole part is sure, the remainder is a hash draw of seed and id. Only Spark functions run; cells never
meet on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.functions.scalar import draw, unit
from gaugeframe.llm.common import fresh
from gaugeframe.runtime import cut, tune

MARGINS = ("source", "lang", "topic")
TEMPERATURE = 0.7
CYCLES = 100
TOLERANCE = 1e-6
# Up to this many cells are raked in one row and broadcast to the documents; more are shuffled.
CELLS_PER_TASK = 50_000


def token_count(text: str = "text") -> Column:
    """Words between the bytes 20 and 09-0D; null and blank texts have none."""
    trimmed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("bigint")


def topic_of(text: str = "text") -> Column:
    """A coarse topic from the form of the text: table, symbols, notice, contact or prose."""
    body = F.coalesce(F.col(text), F.lit(""))
    return (F.when(body.contains(" | "), "table").when(body.contains("%%%") | body.contains("***"), "symbols")
            .when(F.lower(body).contains("license") | F.lower(body).contains("copyright"), "notice")
            .when(body.contains("@"), "contact").otherwise("prose"))


def tempered_targets(cells: DataFrame, margin: str, temperature: float = TEMPERATURE) -> DataFrame:
    """margin, target: shares of tokens raised to the temperature and scaled to one."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("tokens")).filter("tokens > 0")
    raised = sums.select(margin, F.pow("tokens", F.lit(temperature)).alias("raised"))
    total = raised.agg(F.sum("raised")).first()[0] or 1.0
    return raised.select(margin, (F.col("raised") / F.lit(total)).alias("target"))


def _tasks(cells: DataFrame) -> int:
    return 1 + cells.count() // CELLS_PER_TASK


def rake(cells: DataFrame, targets: dict[str, DataFrame], cycles: int = CYCLES, tolerance: float = TOLERANCE) -> DataFrame:
    """cells with ``factor``: the multiplier of a cell's tokens under which every marginal has its target share.

    A category without a target keeps its weight; a target without tokens is left out. Stops when no factor of a
    cycle differs from 1 by more than ``tolerance`` or after ``cycles``. Up to CELLS_PER_TASK cells are raked as arrays
    of one row in a single job; more by one join per margin and a checkpoint per cycle.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    tasks = _tasks(cells)
    current = cells.coalesce(tasks).withColumn("factor", F.lit(1.0))
    for margin, target in targets.items():
        goal = target.select(F.col(margin).alias("__goal"), (F.col("target") * F.lit(total)).alias(f"__{margin}"))
        current = current.join(goal, F.col(margin).eqNullSafe(F.col("__goal")), "left").drop("__goal")
    current = cut(current)
    rounds = _raked_arrays if tasks == 1 else _raked_joins
    return rounds(current, list(targets), cycles, tolerance).select(*cells.columns, "factor")


def _raked_arrays(cells: DataFrame, margins: list[str], cycles: int, tolerance: float) -> DataFrame:
    """All cycles as one expression on one row: the cells as an array, and for every margin the positions of each category."""
    one = cells.coalesce(1)
    order = Window.orderBy(*[F.col(c).asc_nulls_first() for c in cells.columns])
    placed = one.withColumn("__at", F.row_number().over(order) - 1)
    for m in margins:
        placed = placed.withColumn(f"__n_{m}", F.dense_rank().over(Window.orderBy(F.col(m).asc_nulls_first())) - 1)
    placed = cut(placed)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("margin"), F.col(f"__n_{m}").alias("category"), F.col(f"__{m}").alias("goal"))
                               for i, m in enumerate(margins)])).alias("of")
    members = (placed.select("__at", each).groupBy("of.margin", "of.category")
               .agg(F.collect_list("__at").alias("members"), F.first("of.goal").alias("goal")))
    categories = (members.groupBy("margin").agg(F.array_sort(F.collect_list(F.struct("category", "members", "goal"))).alias("categories"))
                  .agg(F.array_sort(F.collect_list(F.struct("margin", "categories"))).alias("margins")))
    row = placed.agg(F.array_sort(F.collect_list(F.struct("__at", *cells.columns, *[f"__n_{m}" for m in margins]))).alias("cells"))
    numbers = F.array(*[F.col(f"cells.__n_{m}") for m in margins])
    row = row.select("cells", numbers.alias("numbers"), F.col("cells.tokens").cast("array<double>").alias("tokens"),
                     categories.scalar().alias("margins"))
    row = cut(row)      # the lambdas below read these arrays as columns, not as expressions evaluated for every cell

    def fit(state: Column, margin: Column) -> Column:
        """The state after one margin: every category's cells multiplied by its target over its current tokens."""
        def step(category):
            now = F.aggregate(category["members"], F.lit(0.0), lambda s, at: s + F.get("tokens", at) * F.get(state["factors"], at))
            return F.coalesce(F.try_divide(category["goal"], now), F.lit(1.0))

        def apply(steps):
            own = F.get("numbers", margin["margin"])
            factors = F.transform(state["factors"], lambda f, at: f * F.get(steps, F.get(own, at)))
            off = F.greatest(state["off"], F.array_max(F.transform(steps, lambda s: F.abs(s - 1))))
            return F.struct(factors.alias("factors"), off.alias("off"))
        # A lambda over a list of one evaluates the steps once instead of once per cell.
        return F.get(F.transform(F.array(F.transform(margin["categories"], step)), apply), F.lit(0))

    def cycle(state: Column, _: Column) -> Column:
        fresh_state = F.struct(state["factors"].alias("factors"), F.lit(0.0).alias("off"))
        return F.when(state["off"] <= tolerance, state).otherwise(F.aggregate("margins", fresh_state, fit))

    start = F.struct(F.col("cells.factor").alias("factors"), F.lit(float("inf")).alias("off"))
    fitted = row.select("cells", F.aggregate(F.sequence(F.lit(1), F.lit(cycles)), start, cycle)["factors"].alias("factors"))
    out = fitted.select(F.explode(F.arrays_zip("cells", "factors")).alias("of"))
    return cut(out.select(*[F.col(f"of.cells.{c}").alias(c) for c in cells.columns if c != "factor"], F.col("of.factors").alias("factor")))


def _raked_joins(cells: DataFrame, margins: list[str], cycles: int, tolerance: float) -> DataFrame:
    """Cells summed per category first, so that a large category is no single group; every cycle ends in a checkpoint."""
    current = cells
    for _ in range(cycles):
        off = F.lit(0.0)
        for margin in margins:
            by = F.try_divide(F.first(f"__{margin}"), F.sum(F.col("tokens") * F.col("factor")))
            steps = current.groupBy(margin).agg(by.alias("__by")).filter("__by IS NOT NULL").select(F.col(margin).alias("__key"), "__by")
            current = current.join(steps, F.col(margin).eqNullSafe(F.col("__key")), "left")
            step = F.coalesce("__by", F.lit(1.0))
            current = current.withColumn("factor", F.col("factor") * step).withColumn(f"__off_{margin}", F.abs(step - 1)).drop("__key", "__by")
            off = F.greatest(off, F.col(f"__off_{margin}"))
        current = cut(current.withColumn("__off", off).drop(*[f"__off_{m}" for m in margins]))
        worst = current.agg(F.max("__off")).first()[0] or 0.0
        current = current.drop("__off")
        if worst <= tolerance:
            break
    return current


def _fitted(cells: DataFrame, targets: dict[str, DataFrame] | None, budget: int | None) -> DataFrame:
    """source, lang, topic, weight, expected of every cell; expected copies times tokens add up to the budget."""
    cells = cells.coalesce(_tasks(cells))
    fitted = rake(cells, targets or {m: tempered_targets(cells, m) for m in MARGINS})
    sums = fitted.agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("factor")).alias("raked")).first()
    scale = (sums["tokens"] if budget is None else budget) / sums["raked"] if sums["raked"] else 1.0
    filled = F.col("tokens") > 0
    return fitted.select(*MARGINS, F.when(filled, F.col("factor")).otherwise(F.lit(1.0)).alias("weight"),
                         F.when(filled, F.col("factor") * F.lit(scale)).otherwise(F.lit(1.0)).alias("expected"))


def _beside_cells(rows: DataFrame, cells: DataFrame, own: dict[str, str]) -> DataFrame:
    """rows with the columns of their cell; ``own`` names the column of the rows for each margin."""
    same = F.lit(True)
    for m in MARGINS:
        same = same & F.col(own[m]).eqNullSafe(F.col(f"__cell_{m}"))
    renamed = cells.withColumnsRenamed({m: f"__cell_{m}" for m in MARGINS})
    return rows.join(F.broadcast(renamed) if _tasks(cells) == 1 else renamed, same).drop(*[f"__cell_{m}" for m in MARGINS])


def _copies(doc_id: Column, expected: Column, seed: int) -> Column:
    whole = F.floor(expected)
    more = unit(draw(seed, F.coalesce(doc_id.cast("string"), F.lit("")))) < expected - whole
    return whole + more.cast("bigint")


def calibrated(docs: DataFrame, seed: int = 11, doc_id: str = "doc_id", text: str = "text", source: str = "source",
               lang: str = "lang", topic: Column | None = None, targets: dict[str, DataFrame] | None = None,
               budget: int | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, probability, kept, expected, copies, one row per input row.

    ``weight`` is the raked multiplier and ``expected`` that weight scaled so that expected tokens add up to ``budget``, by
    default the tokens of the input; they have the target marginals up to the tolerance of the raking. A rare cell above 1
    is repeated and does not lower the others. ``copies`` is the whole part of ``expected`` plus a hash draw of the remainder,
    ``kept`` says that there is a copy, ``probability`` how likely that is. Null source or language is a category of its own. Cells
    without tokens have weight 1 and are kept once, since they change no share. Rows with one id share one draw. Without
    targets the shares of tokens raised to TEMPERATURE are the targets. Empty input gives no rows.
    """
    tune(docs.sparkSession)
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(lang).alias("lang"),
                           (topic if topic is not None else topic_of(text)).alias("topic"), token_count(text).alias("tokens")))
    cells = cut(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")))
    weights = _fitted(cells, targets, budget)
    out = _beside_cells(rows, weights, {m: m for m in MARGINS}).withColumn("copies", _copies(F.col("doc_id"), F.col("expected"), seed))
    return out.select("doc_id", *MARGINS, "tokens", "weight", F.least(F.lit(1.0), "expected").alias("probability"),
                      (F.col("copies") > 0).alias("kept"), "expected", "copies")


def sample(docs: DataFrame, seed: int = 11, doc_id: str = "doc_id", text: str = "text", source: str = "source",
           lang: str = "lang", topic: Column | None = None, targets: dict[str, DataFrame] | None = None,
           budget: int | None = None) -> DataFrame:
    """Every row as often as ``calibrated`` has copies of it; columns stay as they are and texts are not shuffled."""
    tune(docs.sparkSession)
    form = topic if topic is not None else topic_of(text)
    cells = docs.select(F.col(source).alias("source"), F.col(lang).alias("lang"), form.alias("topic"), token_count(text).alias("tokens"))
    cells = cut(cells.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")))
    weights = _fitted(cells, targets, budget)
    own, expected, copy = fresh(docs, "__topic"), fresh(docs, "__expected"), fresh(docs, "__copy")
    rows = docs.withColumn(own, form)
    weights = weights.select(*MARGINS, F.col("expected").alias(expected))
    out = _beside_cells(rows, weights, {"source": source, "lang": lang, "topic": own})
    copies = _copies(F.col(doc_id), F.col(expected), seed).cast("int")
    return out.withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies))).drop(own, expected, copy)
