"""Exact top-k inner products by term-at-a-time accumulation.

Query rows and candidate rows are dealt into blocks. In a pair of blocks every query row walks its
non-zero terms and scatters weight times posting into one dense score array; the best k are
selected there, and the lists of all candidate blocks are merged per query.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.runtime import tune

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192


def quantised(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) per component as whole numbers."""
    return F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(vector: str) -> Column:
    """True for vectors without null or non-finite components; the empty vector is usable."""
    ends = (F.lit(float("inf")), F.lit(float("-inf")))
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | x.cast("double").isin(*ends))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def _postings(vectors: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """term -> (rows, weights) of the rows whose component is not zero."""
    lengths = np.fromiter(map(len, vectors), dtype=np.int64, count=len(vectors))
    flat = np.concatenate(vectors) if len(vectors) else np.empty(0, dtype=np.int64)
    rows = np.repeat(np.arange(len(vectors)), lengths)
    terms = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    there = np.flatnonzero(flat)
    order = there[np.argsort(terms[there], kind="stable")]
    cuts = np.flatnonzero(np.diff(terms[order])) + 1
    return {int(terms[part[0]]): (rows[part], flat[part]) for part in np.split(order, cuts) if len(part)}


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids, found by partition selection."""
    if len(scores) > k:
        floor = scores[np.argpartition(-scores, k - 1)[k - 1]]
        above, level = np.flatnonzero(scores > floor), np.flatnonzero(scores == floor)
        room = k - len(above)
        if len(level) > room:
            level = level[np.argpartition(ids[level], room - 1)[:room]]
        chosen = np.concatenate([above, level])
    else:
        chosen = np.arange(len(scores))
    return chosen[np.lexsort((ids[chosen], -scores[chosen]))]


def _search(k: int):
    def search(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        ids = candidates["vec_id"].to_numpy(dtype=np.int64)
        postings = _postings([np.asarray(v, dtype=np.int64) for v in candidates["terms"]])
        out = []
        for query_id, vector, copy in zip(queries["query_id"], queries["terms"], queries["copy"]):
            scores = np.zeros(len(ids), dtype=np.int64)
            for term, weight in enumerate(np.asarray(vector, dtype=np.int64).tolist()):
                if weight and term in postings:
                    rows, weights = postings[term]
                    scores[rows] += weight * weights
            other = np.flatnonzero(ids != query_id)
            best = other[best_of(scores[other], ids[other], k)]
            out.append(pd.DataFrame({"query_id": query_id, "copy": copy, "vec_id": ids[best], "score": scores[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "copy": [], "vec_id": [], "score": []})
    return search


def top_k(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", terms: str = "terms",
          query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows by integer inner product for each query row.

    ``terms`` holds whole numbers; components that a shorter vector lacks count as zero. Sums are 64-bit. Rows with a null id
    or vector take no part. Whole repeated rows count once; an id that occurs with different
    vectors gives one list per vector as a query and one candidate per vector. Ties go to the smaller
    id. A query with fewer than k other rows lists all.
    """
    tune(vectors.sparkSession)
    rows = (vectors.filter(F.col(vec_id).isNotNull() & F.col(terms).isNotNull())
            .select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(terms).alias("terms"), queries.alias("asks"))
            .dropDuplicates(["vec_id", "terms"]))
    rows = rows.withColumn("copy", F.xxhash64("vec_id", "terms"))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()
    query_blocks = max(1, math.ceil(sizes["q"] / query_block))
    candidate_blocks = max(1, math.ceil(sizes["n"] / candidate_block))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.col("copy"), F.lit(n)).cast("int")
    asked = rows.filter("asks").select(F.col("vec_id").alias("query_id"), "copy", "terms", place(query_blocks).alias("qb"),
                                       numbers(candidate_blocks).alias("cb"))
    offered = rows.select("vec_id", "terms", place(candidate_blocks).alias("cb"), numbers(query_blocks).alias("qb"))
    lists = (asked.groupBy("qb", "cb").cogroup(offered.groupBy("qb", "cb"))
             .applyInPandas(_search(k), "query_id bigint, copy bigint, vec_id bigint, score bigint"))
    order = Window.partitionBy("query_id", "copy").orderBy(F.col("score").desc(), "vec_id")
    return (lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
