"""Ranks, percent ranks and k-th values that stay parallel without a partition column.

A rank over a whole column is a running count over its distinct values: values are
counted first, the counts numbered by ranges, and rows join their value's rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialise


def value_ranks(df: DataFrame, value: str, descending: bool = True) -> DataFrame:
    """(value, n, before, total): how often each value occurs and how many values come before it.

    Range partitions are summed (a row each); their running sums offset the windows inside.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    key = F.col(value).desc() if descending else F.col(value).asc()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(counts.repartitionByRange(parts, key).withColumn("_p", F.spark_partition_id()))
    sums = ranged.groupBy("_p").agg(F.sum("n").alias("_s"), F.min(value).alias("_lo"))
    offsets = sums.select("_p", (F.sum("_s").over(W.orderBy("_p")) - F.col("_s")).alias("_o"), F.sum("_s").over(W.partitionBy(F.lit(1))).alias("total"))
    inside = F.sum("n").over(W.partitionBy("_p").orderBy(key)) - F.col("n")
    return ranged.withColumn("_i", inside).join(F.broadcast(offsets), "_p").select(value, "n", (F.col("_o") + F.col("_i")).alias("before"), "total")


def rank(df: DataFrame, value: str, to: str = "rank", descending: bool = True, average: bool = False, by: list[str] | None = None) -> DataFrame:
    """RANK.EQ, or RANK.AVG with `average`; within `by`, if given, by a window."""
    if by:
        w = W.partitionBy(*by).orderBy(F.col(value).desc() if descending else F.col(value).asc())
        first = F.rank().over(w).cast("double")
        out = first + (F.count(F.lit(1)).over(W.partitionBy(*by, value)) - 1) / 2 if average else first
        return df.withColumn(to, F.when(F.col(value).isNotNull(), out))
    ranks = value_ranks(df, value, descending)
    place = F.col("before") + (F.col("n") + 1) / 2 if average else (F.col("before") + 1).cast("double")
    return df.join(ranks.select(value, place.alias(to)), value, "left").select(*df.columns, to)


def truncate(x, digits: int):
    return F.floor(x * 10**digits + 1e-9) / 10**digits


def percent_rank(df: DataFrame, value: str, to: str = "percent_rank", exclusive: bool = False, digits: int = 3) -> DataFrame:
    """PERCENTRANK of every row's value among all, truncated to `digits`."""
    ranks = value_ranks(df, value, descending=False)
    inc = F.when(F.col("total") == 1, F.lit(1.0)).otherwise(F.col("before") / F.nullif(F.col("total") - 1, F.lit(0)))
    place = (F.col("before") + 1) / (F.col("total") + 1) if exclusive else inc
    return df.join(ranks.select(value, truncate(place, digits).alias(to)), value, "left").select(*df.columns, to)


def kth(df: DataFrame, value: str, k: float, largest: bool = True, by: list[str] | None = None, to: str = "kth") -> DataFrame:
    """LARGE and SMALL: k is rounded; a top-k over all rows, or row numbers within `by`. No row where there is no k-th value."""
    i = int(k + 0.5)
    key = F.col(value).desc() if largest else F.col(value).asc()
    rows = df.where(F.col(value).isNotNull())
    if by:
        w = W.partitionBy(*by).orderBy(key)
        return rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= i).where(F.col("_i") == i).select(*by, F.col(value).alias(to))
    top = rows.select(value).orderBy(key).limit(i)
    return top.agg(F.count(F.lit(1)).alias("_n"), (F.min(value) if largest else F.max(value)).alias(to)).where(F.col("_n") == i).select(to)


def trimmed_mean(df: DataFrame, value: str, share: float, by: list[str], to: str = "trimmed") -> DataFrame:
    """TRIMMEAN within `by`: as many values off both ends as half of share x n holds whole."""
    w = W.partitionBy(*by)
    at = df.where(F.col(value).isNotNull()).select(*by, value, F.row_number().over(w.orderBy(value)).alias("_i"), F.count(F.lit(1)).over(w).alias("_n"))
    cut = F.floor(F.col("_n") * share / 2)
    return at.where((F.col("_i") > cut) & (F.col("_i") <= F.col("_n") - cut)).groupBy(*by).agg(F.avg(value).alias(to))


def modes(df: DataFrame, value: str, by: list[str], order: str | None = None, to: str = "mode") -> DataFrame:
    """MODE.MULT: every commonest value that occurs twice or more; with `order`, MODE.SNGL: of ties the one that comes first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), *([F.min(order).alias("_o")] if order else []))
    if order:
        best = counts.where("n > 1").groupBy(*by).agg(F.max_by(value, F.struct("n", (-F.col("_o")).alias("o"))).alias(to))
        return best
    most = counts.groupBy(*by).agg(F.max("n").alias("_m")).where("_m > 1")
    return counts.join(most, by).where("n = _m").select(*by, F.col(value).alias(to), "n")


def average_deviation(df: DataFrame, value: str, by: list[str], to: str = "avedev") -> DataFrame:
    """AVEDEV in two aggregations, for groups of any size."""
    means = df.groupBy(*by).agg(F.avg(value).alias("_m"))
    return df.join(means, by).groupBy(*by).agg(F.avg(F.abs(F.col(value) - F.col("_m"))).alias(to))


def running(df: DataFrame, value: str, by: list[str], order: list[str], how: str = "sum", to: str = "running") -> DataFrame:
    """SCAN with an associative step: a running sum, product, maximum, minimum or count within `by`."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    f = {"sum": F.sum, "product": F.product, "max": F.max, "min": F.min, "count": F.count}[how]
    return df.withColumn(to, f(value).over(w))


def shifted(df: DataFrame, value: str, rows: int, by: list[str], order: list[str], to: str = "shifted") -> DataFrame:
    """A relative reference filled down: the value `rows` below (negative: above) in the group's order."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(to, F.lead(value, rows).over(w) if rows >= 0 else F.lag(value, -rows).over(w))


def moving(df: DataFrame, value: str, first: int, last: int, by: list[str], order: list[str], how: str = "avg", to: str = "moving") -> DataFrame:
    """An aggregate of OFFSET with constant bounds: rows from `first` to `last` relative to each row."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(first, last)
    return df.withColumn(to, getattr(F, how)(value).over(w))
