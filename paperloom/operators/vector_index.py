"""An inverted-file index over vectors, searched exactly.

Centroids come from a bounded sample; every vector is assigned to the nearest one, and each list keeps the distance of its
farthest vector. By the triangle inequality a vector of a list is no nearer to a query than the centroid less that radius,
so a list is searched only where this leaves a chance. A search first looks into the nearest part, some thousand vectors of
neighbouring lists, and then into the lists that could still hold something better than what was found: recall is 1 whatever
the sample is. What is written and shuffled has a row for each query and part, not for each of its lists.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.operators.vectors import BLOCK, _scores
from paperloom.scratch import written

#: Bytes of vectors that centroids are fitted to; most lists; rounds of the fit.
SAMPLE_BYTES, MOST_LISTS, ROUNDS = 16 << 20, 1024, 6
#: Vectors of a part (neighbouring lists of a scope), and queries that a part is sent to at once.
PART, ASKED = 4096, 8192
#: Scores are rounded, and the dot product stands for the cosine of vectors whose length is 1 but for rounding.
SLACK = {"cosine": 2e-5, "dot": 1e-3}


@dataclass(frozen=True)
class VectorIndex:
    """vectors: id, vec, scope, list. cells: scope, list, n, radius, part. Centroids are at most MOST_LISTS."""

    vectors: DataFrame
    cells: DataFrame
    centroids: np.ndarray


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-30)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1)[None, :], 0))


def _few(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """BLOCK rows at a time, so that a task holds few distances to all centroids."""
    return (batch.slice(k, BLOCK) for batch in batches for k in range(0, batch.num_rows, BLOCK))


def _stack(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _fit(sample: np.ndarray, lists: int) -> np.ndarray:
    """Lloyd's rounds from evenly spaced vectors of the sample."""
    centroids = sample[np.linspace(0, len(sample) - 1, lists).astype(int)]
    for _ in range(ROUNDS):
        nearest = _distances(sample, centroids).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        n = np.bincount(nearest, minlength=lists)[:, None]
        centroids = np.where(n > 0, sums / np.maximum(n, 1), centroids)
    return centroids


def build_index(vectors: DataFrame) -> VectorIndex:
    """The index of vectors (id, vec, and scope if searches stay within one); rows without a vector are left out."""
    scope = F.col("scope").cast("string") if "scope" in vectors.columns else F.lit("")
    rows = vectors.where("vec is not null").select("id", "vec", scope.alias("scope"))
    n, width = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        return VectorIndex(rows.withColumn("list", F.lit(0)), rows.groupBy("scope").agg(F.lit(0).alias("list"), F.count("*").alias("n"), F.lit(0.0).alias("radius"), F.lit(0).alias("part")), np.zeros((1, 1)))
    most = max(1, SAMPLE_BYTES // (8 * width))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // most))) == 0).select("vec").limit(most).toPandas()["vec"]
    sample = _unit(np.stack(sample.to_numpy()).astype(np.float64)) if len(sample) else np.zeros((1, width))
    centroids = _fit(sample, max(1, min(MOST_LISTS, int(n**0.5), len(sample))))

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            x = _stack(batch.column(1), width)
            d = _distances(_unit(x), centroids)
            own = d.argmin(axis=1)
            far = np.where((x * x).sum(axis=1) > 0, d[np.arange(len(own)), own], np.inf)  # a vector of zeros has no direction: its list is always looked into
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(far)], names=["id", "vec", "scope", "list", "far"])

    kinds = dict(rows.dtypes)
    assigned = written(rows.mapInArrow(assign, f"id {kinds['id']}, vec {kinds['vec']}, scope string, list int, far double"))
    before = F.sum("n").over(Window.partitionBy("scope").orderBy("list").rowsBetween(Window.unboundedPreceding, -1))
    cells = assigned.groupBy("scope", "list").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    cells = written(cells.withColumn("part", F.floor(F.coalesce(before, F.lit(0)) / PART).cast("int")))
    return VectorIndex(assigned.drop("far"), cells, centroids)


def _asked(queries: DataFrame) -> DataFrame:
    """id, vec, scope and skip of the queries that have a vector."""
    scope = F.col("scope").cast("string") if "scope" in queries.columns else F.lit("")
    skip = F.col("skip") if "skip" in queries.columns else F.array().cast("array<bigint>")
    return queries.where("vec is not null").select("id", "vec", scope.alias("scope"), skip.alias("skip"))


def _reach(index: VectorIndex, asked: DataFrame) -> DataFrame:
    """asked (id, vec, scope, skip and others) with reach: the parts of a query's scope, nearest first.

    A part has near (least distance of a centroid), part, n, and lists with list, n and most (no score of the list is larger).
    """
    centroids, names = index.centroids, asked.columns

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            x = _stack(batch.column(1), centroids.shape[1])
            d = _distances(_unit(x), centroids)
            zero = pa.array((x * x).sum(axis=1) == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(d), pa.list_(pa.float64())), zero], names=[*names, "d", "zero"])

    kinds = ", ".join(f"{name} {kind}" for name, kind in asked.dtypes)
    measured = asked.mapInArrow(measure, f"{kinds}, d array<double>, zero boolean")
    parts = index.cells.groupBy("scope", "part").agg(F.sum("n").alias("n"), F.collect_list(F.struct("list", "n", "radius")).alias("lists"))
    spaces = parts.groupBy("scope").agg(F.collect_list(F.struct("part", "n", "lists")).alias("parts"))
    gap = lambda x: F.greatest(F.lit(0.0), F.get("d", x["list"]) - x["radius"])
    most = lambda x: F.when(F.col("zero"), 1.0).otherwise(1 - gap(x) * gap(x) / 2)
    lists = lambda p: F.transform(p["lists"], lambda x: F.struct(x["list"].alias("list"), x["n"].alias("n"), most(x).alias("most")))
    near = lambda p: F.array_min(F.transform(p["lists"], lambda x: F.get("d", x["list"])))
    reach = F.transform("parts", lambda p: F.struct(near(p).alias("near"), p["part"].alias("part"), p["n"].alias("n"), lists(p).alias("lists")))
    return measured.join(spaces, "scope").select(*names, F.array_sort(reach).alias("reach"))


def _probes(reach: DataFrame, parts: Column) -> DataFrame:
    """query_id, vec, skip, scope, part, n and lists (null: all of the part): a row for each of these parts that has lists."""
    rows = reach.select(F.col("id").alias("query_id"), "vec", "skip", "scope", F.explode(parts).alias("p"))
    return rows.select("query_id", "vec", "skip", "scope", "p.part", "p.n", "p.lists")


def _likely(parts: Column, least: Column) -> Column:
    """The parts that have lists with a chance of that score, with these lists only (null: all)."""

    def cut(p: Column) -> Column:
        able = F.filter(p["lists"], lambda x: x["most"] >= least)["list"]
        return F.struct(p["part"].alias("part"), p["n"].alias("n"), F.when(F.size(able) < F.size(p["lists"]), able).alias("lists"))

    return F.filter(F.transform(parts, cut), lambda p: p["lists"].isNull() | (F.size(p["lists"]) > 0))


def _wanted(lists: np.ndarray, asked: Iterable[Iterable[int] | None]) -> np.ndarray:
    """A row for each query, a column for each list: whether it is looked into."""
    return np.array([np.ones(len(lists), dtype=bool) if x is None else np.isin(lists, x) for x in asked])


def _best(own: pd.DataFrame, asked: pd.DataFrame, k: int | None, least: float | None, metric: str) -> list[tuple]:
    """(query_id, vec_id, score) of the k best vectors of the lists that each query looks into; own is in the order of lists."""
    x, y = (np.stack(side["vec"].to_numpy()).astype(np.float64) for side in (own, asked))
    ids, rows = own["id"].to_numpy(), []
    lists, start = np.unique(own["list"].to_numpy(), return_index=True)
    wanted = _wanted(lists, asked["lists"])
    sizes = np.diff(np.append(start, len(own)))
    looked = np.repeat(wanted, sizes, axis=1)
    if 4 * looked.sum() > looked.size:
        scores = _scores(x, y, metric)
    else:
        scores = np.zeros(looked.shape)
        for column, a, n in zip(wanted.T, start, sizes):
            scores[column, a : a + n] = _scores(x[a : a + n], y[column], metric)
    named = [s for s in asked["skip"] if s is not None and len(s)]
    columns = np.flatnonzero(np.isin(ids, np.concatenate(named))) if named else np.zeros(0, dtype=int)
    for query, skip, score, look in zip(asked["query_id"], asked["skip"], scores, looked):
        if len(columns) and skip is not None and len(skip):
            look[columns[np.isin(ids[columns], skip)]] = False
        at = np.flatnonzero(look if least is None else look & (score >= least))
        if k is not None and len(at) > 4 * k:
            last = np.partition(-score[at], k - 1)[k - 1]
            at = at if np.isnan(last) else at[-score[at] <= last]
        top = at[np.lexsort((ids[at], -score[at]))[: len(at) if k is None else k]]
        rows += zip([query] * len(top), ids[top], score[top])
    return rows


def _look(index: VectorIndex, probes: DataFrame, k: int | None, least: float | None, metric: str) -> DataFrame:
    """query_id, vec_id, score: of each query's lists, part by part, the k best (all, if k is None) with at least that score.

    A query is sent once to a part, however many of its lists it looks into, and a part once to each ASKED of its queries;
    BLOCK of them are compared at a time. A crowded list falls into blocks of its own.
    """
    plan = probes.groupBy("scope", "part").agg(F.count("*").alias("q"), F.first("n").alias("n"))
    plan = plan.select("scope", "part", F.ceil(F.col("n") / (2 * PART)).cast("int").alias("nb"), F.ceil(F.col("q") / ASKED).cast("int").alias("nq"))
    place = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["scope", "part", "vb", "qb"]
    v = index.vectors.join(index.cells.select("scope", "list", "part").join(plan, ["scope", "part"]), ["scope", "list"])
    v = v.select("id", "vec", "list", "scope", "part", place("id", "nb").alias("vb"), every("nq").alias("qb"))
    q = probes.join(plan, ["scope", "part"]).select("query_id", "vec", "skip", "lists", "scope", "part", place("query_id", "nq").alias("qb"), every("nb").alias("vb"))

    def best(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(own):
            own = own.sort_values("list", ignore_index=True, kind="stable")
            for at in range(0, len(asked), BLOCK):
                rows += _best(own, asked.iloc[at : at + BLOCK], k, least, metric)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    kinds = (dict(probes.dtypes)["query_id"], dict(index.vectors.dtypes)["id"])
    return v.groupBy(*key).cogroup(q.groupBy(*key)).applyInPandas(best, f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(index: VectorIndex, queries: DataFrame, k: int, least: float | None = None, metric: str = "cosine") -> DataFrame:
    """query_id, vec_id, score and rank of the k nearest vectors of each query (id, vec, and scope and skip if wanted).

    ``skip`` is an array of ids that take no place; ``least`` the smallest score that counts. Scores are rounded to five
    places; ties go to the smaller id.
    """
    asked = written(_asked(queries))
    need = k + F.greatest(F.lit(0), F.coalesce(F.size("skip"), F.lit(0)))
    before = lambda i: F.aggregate(F.slice("reach", 1, i), F.lit(0).cast("long"), lambda n, p: n + p["n"])
    first = F.filter("reach", lambda p, i: (i == 0) | (before(i) < need))  # the nearest part, and more where it holds too few
    whole = F.transform(first, lambda p: F.struct(p["part"].alias("part"), p["n"].alias("n"), F.lit(None).cast("array<int>").alias("lists")))
    early = written(_top(_look(index, written(_probes(_reach(index, asked), whole)), k, least, metric), k).drop("rank"))
    bar = early.groupBy(F.col("query_id").alias("id")).agg(F.min("score").alias("bar"), F.count("*").alias("held"))
    chance = F.when(F.coalesce("held", F.lit(0)) < k, F.lit(-2.0 if least is None else least)).otherwise(F.col("bar")) - SLACK[metric]
    rest = F.slice("reach", F.size(first) + 1, F.greatest(F.lit(0), F.size("reach") - F.size(first)))
    reach = _reach(index, asked.join(bar, "id", "left").select("id", "vec", "scope", "skip", chance.alias("chance")))
    late = _look(index, written(_probes(reach, _likely(rest, F.col("chance")))), k, least, metric)
    return _top(early.unionByName(late), k)


def search_range(index: VectorIndex, queries: DataFrame, least: float, metric: str = "cosine") -> DataFrame:
    """query_id, vec_id and score of all vectors with at least this score."""
    likely = _likely(F.col("reach"), F.lit(least - SLACK[metric]))
    return _look(index, written(_probes(_reach(index, _asked(queries)), likely)), None, least, metric)


def searched_share(index: VectorIndex, queries: DataFrame, least: float, metric: str = "cosine") -> DataFrame:
    """seen and whole: how many pairs of a range search are compared, and how many there are."""
    each = _reach(index, _asked(queries)).select(F.inline(F.flatten("reach.lists")))
    return each.agg(F.sum(F.when(F.col("most") + SLACK[metric] >= least, F.col("n")).otherwise(0)).alias("seen"), F.sum("n").alias("whole"))
