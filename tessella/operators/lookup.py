"""Lookups as joins: exact with the first or last match, as-of in both directions, and wildcard.

The table side is reduced to one row for each key before it is joined, so a lookup
never multiplies rows. As-of lookups are a union and a window over the key's group:
they sort each group once, with no range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .relational import canonical


def one_per_key(table: DataFrame, key: str, order: list[str], last: bool = False) -> DataFrame:
    """A row for each key without case: the first in `order`, or the last."""
    rest = [c for c in table.columns if c not in order]
    row = F.struct(*order, *rest)
    pick = F.max(row) if last else F.min(row)
    return table.where(F.col(key).isNotNull()).groupBy(canonical(table, key).alias("_k")).agg(pick.alias("_r"))


def lookup(left: DataFrame, needle: str, table: DataFrame, key: str, values: list[str], order: list[str] | None = None, last: bool = False, if_missing: dict | None = None) -> DataFrame:
    """XLOOKUP, VLOOKUP and INDEX/MATCH with an exact match: `left` with `values` of the first (or last) matching row."""
    side = one_per_key(table, key, order or [key], last)
    out = left.withColumn("_n", canonical(left, needle)).join(side, F.col("_n") == F.col("_k"), "left")
    miss = F.col("_k").isNull()
    cols = [F.when(miss, F.lit((if_missing or {}).get(v))).otherwise(F.col("_r")[v]).alias(v) if v in (if_missing or {}) else F.col("_r")[v].alias(v) for v in values]
    return out.select(*left.columns, *cols)


def match_position(left: DataFrame, needle: str, table: DataFrame, key: str, position: str, last: bool = False, to: str = "position") -> DataFrame:
    """XMATCH and MATCH(…, 0): the place of the first (or last) match, null where there is none."""
    return lookup(left, needle, table.withColumn(to, F.col(position)), key, [to], [position], last)


def as_of(left: DataFrame, needle: str, table: DataFrame, key: str, values: list[str], by: list[str] | None = None, forward: bool = False, order: str | None = None, first_tie: bool = False) -> DataFrame:
    """Approximate lookup: the row with the largest key not above the needle (forward: the smallest not below it).

    by: columns that must be equal; name one wherever the data allows, as a group is
    sorted by one task. Ties of keys go to the last row in `order`, or with
    first_tie to the first.
    """
    by = by or []
    tie = order or key
    pick = F.min(F.struct(tie, *values)) if first_tie else F.max(F.struct(tie, *values))
    side = table.where(F.col(key).isNotNull()).groupBy(*by, F.col(key).alias("_at")).agg(pick.alias("_v"))
    probe = left.select(*by, F.col(needle).alias("_at"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(side.schema["_v"].dataType).alias("_v"))
    both = probe.unionByName(side.select(*by, "_at", F.lit(None).cast(probe.schema["_l"].dataType).alias("_l"), "_v"))
    # Table rows come before needles of the same key, so that an equal key counts in either direction.
    rank = F.col("_l").isNotNull().cast("int")
    at = F.col("_at").desc() if forward else F.col("_at").asc()
    w = W.partitionBy(*by).orderBy(at, rank).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_f", F.last("_v", ignorenulls=True).over(w)).where(F.col("_l").isNotNull())
    missing = F.col("_at").isNull()
    return found.select(*[F.col("_l")[c].alias(c) for c in left.columns], *[F.when(~missing, F.col("_f")[v]).alias(v) for v in values])


def by_bands(left: DataFrame, needle: str, bands: list[tuple[float, object]], to: str) -> DataFrame:
    """LOOKUP in a short constant table of rising lower bounds: a CASE, no join."""
    out: Column | None = None
    for low, value in sorted(bands, reverse=True):
        out = F.when(F.col(needle) >= low, F.lit(value)) if out is None else out.when(F.col(needle) >= low, F.lit(value))
    return left.withColumn(to, out)


def wildcard_lookup(left: DataFrame, pattern: str, table: DataFrame, key: str, values: list[str], order: list[str], most_patterns: int = 1000) -> DataFrame:
    """XLOOKUP with match mode 2: patterns with `*` and `?` against keys; the first match in `order`.

    The distinct patterns must be few (`most_patterns`, checked): each is tested
    against each key where the keys stand, and only hits move.
    """
    from ..functions.texts import wildcard_regex

    own = left.select(F.lower(pattern).alias("_p")).distinct()
    if own.limit(most_patterns + 1).count() > most_patterns:
        raise ValueError(f"more than {most_patterns} distinct patterns; split the lookup or use exact keys")
    hits = table.join(F.broadcast(own), F.rlike(table[key], wildcard_regex(F.col("_p"), True)))
    best = hits.groupBy("_p").agg(F.min(F.struct(*order, *[v for v in values if v not in order])).alias("_r"))
    return left.join(best, F.lower(left[pattern]) == F.col("_p"), "left").select(*left.columns, *[F.col("_r")[v].alias(v) for v in values])


def semi(left: DataFrame, needle: str, table: DataFrame, key: str, anti: bool = False) -> DataFrame:
    """COUNTIF(keys, needle) > 0 as a semi join (= 0: anti)."""
    side = table.select(canonical(table, key).alias("_k"))
    return left.withColumn("_n", canonical(left, needle)).join(side, F.col("_n") == F.col("_k"), "left_anti" if anti else "left_semi").drop("_n")


def index(df: DataFrame, row: int, column: str | None, *order: Column) -> DataFrame:
    """INDEX: the row at a place in `order` (0: all rows), of one column or all."""
    from .relational import numbered

    picked = df if row == 0 else numbered(df, *order, to="_at").where(F.col("_at") == row - 1).drop("_at")
    return picked.select(column) if column else picked
