"""Largest-remainder apportionment, for any number of totals at once: as a window, or within a row where groups are short and fixed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def largest_remainder(rows: DataFrame, group: Sequence[str], total: str, weight: str, order: str) -> DataFrame:
    """Add ``share``: whole shares of ``total`` by ``weight`` that add up to it in each group.

    What floors leave over goes to the largest fractions, ties by ``order``. A group without weight gets nothing.
    """
    own = Window.partitionBy(*group)
    sums = rows.withColumn("_all", F.sum(weight).over(own))
    raw = F.when(F.col("_all") > 0, F.col(total) * F.col(weight) / F.col("_all")).otherwise(0.0)
    floors = sums.withColumn("_raw", raw).withColumn("_floor", F.floor("_raw")).withColumn("_left", F.when(F.col("_all") > 0, F.col(total) - F.sum("_floor").over(own)).otherwise(0))
    rank = F.row_number().over(own.orderBy(F.desc(F.round(F.col("_raw") - F.col("_floor"), 9)), order))
    return floors.withColumn("share", F.col("_floor") + (rank <= F.col("_left")).cast("long")).drop("_all", "_raw", "_floor", "_left")


def shares_within(rows: DataFrame, total: Column, weights: Sequence[Column]) -> DataFrame:
    """Add ``shares``: what ``largest_remainder`` gives where a row is a group, with a place for each weight and ties by place.

    A null weight is no member of the group, and its place is null. Nothing is shuffled or sorted, so a task's memory does
    not depend on the rows.
    """
    places = range(len(weights))

    def added(columns: Sequence[Column]) -> Column:
        whole = F.coalesce(columns[0], F.lit(0))
        for c in columns[1:]:
            whole = whole + F.coalesce(c, F.lit(0))
        return whole

    # each step is a projection of its own, so that nothing is worked out twice
    known = rows.select("*", total.alias("_total"), *(w.alias(f"_w{k}") for k, w in enumerate(weights)))
    known = known.withColumn("_all", added([F.col(f"_w{k}") for k in places]))
    raw = known.withColumns({f"_raw{k}": F.when(F.col(f"_w{k}").isNotNull(), F.when(F.col("_all") > 0, F.col("_total") * F.col(f"_w{k}") / F.col("_all")).otherwise(0.0)) for k in places})
    floors = raw.withColumns({f"_floor{k}": F.floor(f"_raw{k}") for k in places})
    left = F.when(F.col("_all") > 0, F.col("_total") - added([F.col(f"_floor{k}") for k in places])).otherwise(0)
    parts = floors.withColumns({"_left": left} | {f"_part{k}": F.round(F.col(f"_raw{k}") - F.col(f"_floor{k}"), 9) for k in places})

    def before(j: int, k: int) -> Column:
        a, b = F.col(f"_part{j}"), F.col(f"_part{k}")
        return F.coalesce(a >= b if j < k else a > b, F.lit(False)).cast("int")

    share = lambda k: F.col(f"_floor{k}") + (added([before(j, k) for j in places if j != k] or [F.lit(0)]) < F.col("_left")).cast("long")
    return parts.select(*rows.columns, F.array(*map(share, places)).alias("shares"))
