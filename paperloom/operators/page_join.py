"""Joins of points or intervals with intervals by bins, so that Spark joins on equal keys and compares within a bin only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pages (or characters) of a bin, unless the caller knows better.
WIDTH = 32


def _bin(x: Column, width: int) -> Column:
    return F.floor(x / width).cast("long")


def _bins(first: Column, last: Column, width: int) -> Column:
    """The bins of an interval; an empty one (last is first less 1) lies between two points and counts for both."""
    return F.explode(F.sequence(_bin(F.least(first, last), width), _bin(F.greatest(first, last), width)))


def in_ranges(points: DataFrame, spans: DataFrame, at: str = "page", width: int = WIDTH) -> DataFrame:
    """Every point (scope, ``at``) with every span of its scope (scope, first, last) that holds it; a point lies in one bin."""
    dealt = spans.withColumn("_bin", _bins(F.col("first"), F.col("last"), width))
    return points.withColumn("_bin", _bin(F.col(at), width)).join(dealt, ["scope", "_bin"]).where(F.col(at).between(F.col("first"), F.col("last"))).drop("_bin")


def overlapping(left: DataFrame, right: DataFrame, width: int = WIDTH) -> DataFrame:
    """Every left interval (scope, a_first, a_last) with every right one of its scope (scope, b_first, b_last) that it overlaps, once.

    Both may share several bins; the pair counts in the bin where their overlap begins.
    """
    a = left.withColumn("_bin", _bins(F.col("a_first"), F.col("a_last"), width))
    b = right.withColumn("_bin", _bins(F.col("b_first"), F.col("b_last"), width))
    both = a.join(b, ["scope", "_bin"]).where("a_first <= b_last and b_first <= a_last")
    return both.where(F.col("_bin") == _bin(F.greatest("a_first", "b_first"), width)).drop("_bin")
