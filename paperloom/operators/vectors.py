"""Exact nearest neighbours of a stated query set, in blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors of a block on either side.
BLOCK = 512


def _scores(v: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """A row for each query; larger is nearer."""
    if metric == "euclid":
        return -np.round(np.sqrt(((q[:, None, :] - v[None, :, :]) ** 2).sum(axis=2)), 6)
    dots = q @ v.T
    if metric == "dot":
        return np.round(dots, 5)
    norms = [np.sqrt((x * x).sum(axis=1)) + 1e-10 for x in (q, v)]
    return np.round(dots / (norms[0][:, None] * norms[1][None, :]), 5)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", skip: Callable[[np.ndarray, int], np.ndarray] | None = None, order: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """query_id, vec_id, score and rank of the k nearest vectors of every query; both sides have id and vec.

    Every pair of a block of vectors and a block of queries is one small matrix product, of which only the k best of each
    query are kept; ties go to the smaller id. ``skip(ids, query)`` marks vectors that take no place; ``order(ids, scores)``
    gives what ranks vectors in place of their scores, larger first.
    """
    n_v, n_q = (max(1, -(-side.count() // BLOCK)) for side in (vectors, queries))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = vectors.select("id", "vec", place(n_v).alias("vb")).select("*", every(n_q).alias("qb"))
    q = queries.select("id", "vec", place(n_q).alias("qb")).select("*", every(n_v).alias("vb"))

    def best(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(own) and len(asked):
            own = own.sort_values("id", ignore_index=True)
            ids = own["id"].to_numpy()
            scores = _scores(*(np.stack(side["vec"].to_numpy()).astype(np.float64) for side in (own, asked)), metric)
            for query, score in zip(asked["id"], scores if order is None else order(ids, scores)):
                at = np.arange(len(ids)) if skip is None else np.flatnonzero(~skip(ids, query))
                top = at[np.argsort(-score[at], kind="stable")[:k]]
                rows += zip([query] * len(top), ids[top], score[top])
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    found = v.groupBy("vb", "qb").cogroup(q.groupBy("vb", "qb")).applyInPandas(best, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
