"""Cell-level operations on the long form (row, col, value): structure edits, cell diff and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS, MOST_COLS = 1_048_576, 16_384  # of a sheet (fixed values)


def insert(cells: DataFrame, axis: str, at: int, n: int = 1) -> DataFrame:
    """Insert n rows or columns before `at` (axis "row" or "col")."""
    return cells.withColumn(axis, F.when(F.col(axis) >= at, F.col(axis) + n).otherwise(F.col(axis)))


def delete(cells: DataFrame, axis: str, at: int, n: int = 1) -> DataFrame:
    """Delete n rows or columns from `at` on; what follows moves up."""
    kept = cells.where((F.col(axis) < at) | (F.col(axis) >= at + n))
    return kept.withColumn(axis, F.when(F.col(axis) >= at + n, F.col(axis) - n).otherwise(F.col(axis)))


def move_range(cells: DataFrame, top: int, left: int, bottom: int, right: int, rows: int, cols: int) -> DataFrame:
    """Move a block; what it lands on is replaced."""
    inside = F.col("row").between(top, bottom) & F.col("col").between(left, right)
    target = F.col("row").between(top + rows, bottom + rows) & F.col("col").between(left + cols, right + cols)
    moved = cells.where(inside).withColumn("row", F.col("row") + rows).withColumn("col", F.col("col") + cols)
    return cells.where(~inside & ~target).unionByName(moved)


def update(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited cells over `cells`; a null value clears its cell."""
    new = edits.select("row", "col", F.col("value").alias("_new"), F.lit(True).alias("_hit"))
    out = cells.join(new, ["row", "col"], "full").withColumn("value", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("value")))
    return out.where("value IS NOT NULL").drop("_new", "_hit")


def diff(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Cell diff by key: key columns, name, before, after and change (added, removed, changed), one row per differing cell."""
    cells = lambda df: df.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in columns])))
    a, b = cells(before).withColumnRenamed("v", "before").withColumn("_a", F.lit(True)), cells(after).withColumnRenamed("v", "after").withColumn("_b", F.lit(True))
    both = a.join(b, [*keys, "name"], "full").where(~F.col("before").eqNullSafe(F.col("after")))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return both.select(*keys, "name", "before", "after", change.alias("change"))


def validate(cells: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """Findings (code, row, col, detail): cells outside the grid, cells given twice, and merged ranges that overlap."""
    outside = cells.where((F.col("row") < 1) | (F.col("col") < 1) | (F.col("row") > MOST_ROWS) | (F.col("col") > MOST_COLS))
    found = outside.select(F.lit("cell_out_of_grid").alias("code"), "row", "col", F.lit(None).cast("string").alias("detail"))
    twice = cells.groupBy("row", "col").count().where("count > 1")
    found = found.unionByName(twice.select(F.lit("duplicate_cell").alias("code"), "row", "col", F.col("count").cast("string").alias("detail")))
    if merges is not None:
        covered = merges.select("ref", F.explode(F.sequence("top", "bottom")).alias("row"), "left", "right").select("ref", "row", F.explode(F.sequence("left", "right")).alias("col"))
        over = covered.groupBy("row", "col").agg(F.array_sort(F.collect_set("ref")).alias("refs")).where(F.size("refs") > 1)
        found = found.unionByName(over.groupBy("refs").agg(F.min("row").alias("row"), F.min("col").alias("col")).select(F.lit("overlapping_merge").alias("code"), "row", "col", F.array_join("refs", ",").alias("detail")))
    return found


def repair(cells: DataFrame, order: str) -> DataFrame:
    """Cells inside the grid, one for each place: the last in `order`."""
    inside = cells.where(F.col("row").between(1, MOST_ROWS) & F.col("col").between(1, MOST_COLS))
    best = inside.groupBy("row", "col").agg(F.max(F.struct(order, *[c for c in cells.columns if c not in ("row", "col", order)])).alias("_r"))
    return best.select("row", "col", *[F.col("_r")[c].alias(c) for c in cells.columns if c not in ("row", "col")])
