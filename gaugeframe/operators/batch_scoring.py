"""Apply a frozen scorer to many records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Scorer = Callable[[pd.DataFrame], np.ndarray]


def score_batch(records: DataFrame, build: Callable[[], Scorer], threshold: float, categories: list[str] | None = None,
                category: str = "category", payload: tuple[str, ...] = ()) -> DataFrame:
    """Score every record of the scorer's categories and decide at the frozen threshold. None means all; an empty list scores nothing.

    ``build`` runs once per task and returns a function from a batch to one score per row. Scores
    that are not finite or not aligned with the batch stop the job. Columns named in ``payload``
    are given to the scorer and left out of the result.
    """
    kept = records.filter(F.col(category).isin(*categories)) if categories is not None else records
    result = [f for f in kept.schema.fields if f.name not in payload]
    schema = T.StructType(result + [T.StructField("score", T.DoubleType()), T.StructField("predicted_defective", T.BooleanType())])
    names = [f.name for f in result]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = build()
        for batch in batches:
            scores = np.asarray(scorer(batch), dtype=np.float64)
            if scores.shape != (len(batch),) or not np.isfinite(scores).all():
                raise ValueError("the scorer must return one finite score per record")
            yield batch[names].assign(score=scores, predicted_defective=scores >= threshold)
    return kept.mapInPandas(run, schema)
