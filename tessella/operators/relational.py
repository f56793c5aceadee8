"""Relational forms of the array functions: filter, distinct, sort, slices, stacks, reshapes, pivots and text splits.

Rows have no order of their own, so what needs one takes the columns that give it.
Slices and numbering are top-k plans or a window over stated keys, never a sort of
everything in one task: `numbered` deals rows by range and offsets each range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialise


def canonical(df: DataFrame, name: str) -> Column:
    """Key of a cell for distinct and lookups: text without case."""
    return F.lower(F.col(name)) if dict(df.dtypes)[name] == "string" else F.col(name)


def numbered(df: DataFrame, *keys: Column, to: str = "row_id", parts: int | None = None) -> DataFrame:
    """Rows with their place (from 0) in the order of `keys`, in parallel.

    Rows are range-partitioned, sorted and written; each partition's count is a row of
    a small aggregate (one row a partition), whose running sum offsets the partitions.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    # Bounds of ranges come from a sample, so both reads below must be of the same run.
    tagged = materialise(ranged.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    counts = tagged.groupBy("_p").agg((F.max("_i") + 1).alias("_n"))
    offsets = counts.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_o"))
    return tagged.join(F.broadcast(offsets), "_p").withColumn(to, F.col("_o") + F.col("_i")).drop("_p", "_i", "_o")


def filter_rows(df: DataFrame, include: Column, if_empty: tuple | None = None) -> DataFrame:
    """FILTER; `if_empty` is the row given when nothing is kept."""
    kept = df.where(include)
    if if_empty is None:
        return kept
    none = df.sparkSession.createDataFrame([if_empty], df.schema)
    found = kept.limit(1).agg(F.count(F.lit(1)).alias("_n"))
    return kept.unionByName(none.join(F.broadcast(found), F.col("_n") == 0).drop("_n"))


def unique(df: DataFrame, by: list[str] | None = None, order: list[str] | None = None, exactly_once: bool = False) -> DataFrame:
    """UNIQUE: distinct rows without regard to case, the first in `order` standing for its group; or only rows that occur once."""
    by = by or df.columns
    keys = [canonical(df, c).alias(f"_k{i}") for i, c in enumerate(by)]
    first = F.min(F.struct(*(order or df.columns), *[c for c in df.columns if c not in (order or df.columns)])).alias("_r")
    groups = df.groupBy(*keys).agg(first, F.count(F.lit(1)).alias("_n"))
    kept = groups.where("_n = 1") if exactly_once else groups
    return kept.select(*[F.col("_r")[c].alias(c) for c in df.columns])


def sort_by(df: DataFrame, *keys: tuple[str, int]) -> DataFrame:
    """SORT and SORTBY: (column, 1 or -1) keys; text without case, blanks last either way."""
    order = [(canonical(df, c).asc_nulls_last() if way >= 0 else canonical(df, c).desc_nulls_last()) for c, way in keys]
    return df.orderBy(*order)


def take(df: DataFrame, n: int, *keys: tuple[str, int]) -> DataFrame:
    """TAKE: the first n rows in the order of (column, 1 or -1) keys, the last for negative n; a top-k, not a sort."""
    way = 1 if n >= 0 else -1
    return df.orderBy(*[F.col(c).asc() if w * way > 0 else F.col(c).desc() for c, w in keys]).limit(abs(n))


def drop(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """DROP: all but the first n rows in `order`; the last ones for negative n."""
    at = numbered(df, *order, to="_at")
    total = df.count() if n < 0 else 0
    return (at.where(F.col("_at") >= n) if n >= 0 else at.where(F.col("_at") < total + n)).drop("_at")


def choose_cols(df: DataFrame, *indices: int) -> DataFrame:
    """CHOOSECOLS: columns by place, negative from the end; a column chosen twice gets a suffix."""
    cols = df.columns
    seen: dict[str, int] = {}
    out = []
    for i in indices:
        if not 1 <= abs(i) <= len(cols):
            raise ValueError(f"no column {i}: #VALUE!")
        name = cols[i - 1] if i > 0 else cols[i]
        k = seen[name] = seen.get(name, -1) + 1
        out.append(F.col(name).alias(name if not k else f"{name}_{k}"))
    return df.select(*out)


def choose_rows(df: DataFrame, indices: list[int], *order: Column) -> DataFrame:
    """CHOOSEROWS: rows by place in `order`, in the list's order and as often as it names them."""
    at = numbered(df, *order, to="_at")
    total = df.count() if any(i < 0 for i in indices) else 0
    want = df.sparkSession.createDataFrame([(k, (i - 1) if i > 0 else total + i) for k, i in enumerate(indices)], "place int, _at long")
    return at.join(F.broadcast(want), "_at").drop("_at")


def expand(df: DataFrame, rows: int, pad: dict[str, object], *order: Column) -> DataFrame:
    """EXPAND: rows up to `rows`, padded with `pad` (null where it has nothing); fewer rows than there are is an error."""
    at = numbered(df, *order, to="_at")
    shape = df.sparkSession.range(rows).withColumnRenamed("id", "_at")
    out = shape.join(at.withColumn("_is", F.lit(True)), "_at", "left")
    return out.select("_at", *[F.when(F.col("_is"), F.col(c)).otherwise(F.lit(pad.get(c))).alias(c) for c in df.columns])


def vstack(*frames: DataFrame) -> DataFrame:
    """VSTACK: rows under rows by column place, narrower frames padded with null, each with its number."""
    width = max(len(f.columns) for f in frames)
    names = next(f.columns for f in frames if len(f.columns) == width)
    wide = [f.select(F.lit(i).alias("stack"), *[(F.col(f.columns[k]) if k < len(f.columns) else F.lit(None)).alias(names[k]) for k in range(width)]) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b), wide)


def hstack(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """HSTACK: rows side by side by place; the shorter side is padded with null."""
    a, b = numbered(left, *left_order, to="row_id"), numbered(right, *right_order, to="row_id")
    return a.join(b, "row_id", "full")


def to_column(df: DataFrame, columns: list[str], key: str, ignore_blank: bool = False, by_column: bool = False) -> DataFrame:
    """TOCOL: cells as rows (key, place, name, value); TOROW is the same relation read across."""
    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("name"), F.col(c).cast("double" if dict(df.dtypes)[c] != "string" else "string").alias("value")) for i, c in enumerate(columns)])
    out = df.select(F.col(key), F.inline(cells))
    return out.where("value IS NOT NULL") if ignore_blank else out


def wrap(df: DataFrame, value: str, width: int, *order: Column, pad=None, rows: bool = True) -> DataFrame:
    """WRAPROWS (or WRAPCOLS): a column wrapped into a grid `width` wide (or high)."""
    at = numbered(df, *order, to="_at")
    line, cell = F.floor(F.col("_at") / width), F.col("_at") % width
    if not rows:
        line, cell = cell, line
    grid = at.select(line.alias("line"), cell.cast("int").alias("cell"), F.col(value).alias("v"))
    if not rows:
        return grid
    out = grid.groupBy("line").agg(*[F.max(F.when(F.col("cell") == i, F.col("v"))).alias(f"c{i + 1}") for i in range(width)])
    return out.na.fill(pad) if pad is not None else out


def transpose(df: DataFrame, key: str, keys: list, value_columns: list[str]) -> DataFrame:
    """TRANSPOSE of a frame with named rows: a row per value column, a column for each of `keys`."""
    long = to_column(df, value_columns, key)
    return long.groupBy("name").agg(*[F.max(F.when(F.col(key) == k, F.col("value"))).alias(str(k)) for k in keys])


def text_split(df: DataFrame, text: str, column_delimiter: str, row_delimiter: str | None = None, ignore_empty: bool = False, width: int | None = None, pad: str | None = None) -> DataFrame:
    """TEXTSPLIT: a row for each piece (or line) with its place; with `width`, pieces as columns padded with `pad`."""
    quote = lambda d: "\\Q" + d + "\\E"
    cut = lambda c: F.filter(F.split(c, quote(column_delimiter), -1), lambda x: x != "") if ignore_empty else F.split(c, quote(column_delimiter), -1)
    if row_delimiter is not None:
        lines = F.split(F.col(text), quote(row_delimiter), -1)
        df = df.select("*", F.posexplode(F.filter(lines, lambda x: x != "") if ignore_empty else lines).alias("line", "_line"))
        source = F.col("_line")
    else:
        source = F.col(text)
    parts = df.withColumn("_parts", cut(source))
    if width is None:
        return parts.select(*[c for c in df.columns if c != "_line"], F.posexplode("_parts").alias("place", "piece"))
    return parts.select(*[c for c in df.columns if c != "_line"], *[F.coalesce(F.get("_parts", F.lit(i)), F.lit(pad)).alias(f"piece{i + 1}") for i in range(width)])


def text_join(df: DataFrame, by: list[str], value: str, delimiter: str, *order: Column, skip_empty: bool = True, to: str = "joined") -> DataFrame:
    """TEXTJOIN over rows in `order`; a group's text is one cell, so it must fit one."""
    rows = df.where(F.coalesce(F.col(value), F.lit("")) != "") if skip_empty else df
    pairs = F.array_sort(F.collect_list(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], F.coalesce(F.col(value), F.lit("")).alias("_v"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(pairs, lambda x: x["_v"]), delimiter).alias(to))


def pivot(df: DataFrame, rows: list[str], column: str, values: list, value: str, how: str = "sum", totals: bool = False) -> DataFrame:
    """Pivot with one aggregate; `values` are the columns, known beforehand so that one pass is enough. totals adds row and column totals."""
    agg = {"sum": F.sum, "average": F.avg, "count": F.count, "max": F.max, "min": F.min, "product": F.product, "stdev": F.stddev_samp, "stdevp": F.stddev_pop, "var": F.var_samp, "varp": F.var_pop, "countnums": F.count}[how]
    cells = [agg(F.when(F.col(column) == v, F.col(value))).alias(str(v)) for v in values]
    grouped = df.rollup(*rows) if totals else df.groupBy(*rows)
    return grouped.agg(*cells, *([agg(F.col(value)).alias("total")] if totals else []))


#: Function numbers of SUBTOTAL and AGGREGATE (fixed values).
NUMBERED = {1: "AVERAGE", 2: "COUNT", 3: "COUNTA", 4: "MAX", 5: "MIN", 6: "PRODUCT", 7: "STDEV.S", 8: "STDEV.P", 9: "SUM", 10: "VAR.S", 11: "VAR.P", 12: "MEDIAN", 13: "MODE.SNGL", 14: "LARGE", 15: "SMALL", 16: "PERCENTILE.INC", 17: "QUARTILE.INC", 18: "PERCENTILE.EXC", 19: "QUARTILE.EXC"}


def subtotal(df: DataFrame, by: list[str], number: int, value: str, to: str = "subtotal", grand_total: bool = True) -> DataFrame:
    """SUBTOTAL of each group and, by one ROLLUP, of all."""
    from ..functions import V, apply

    name = NUMBERED[number % 100]
    grouped = df.rollup(*by) if grand_total else df.groupBy(*by)
    return grouped.agg(apply(name, V(F.col(value), "n", ranged=True)).sql().alias(to))


def frequency(df: DataFrame, value: str, bins: list[float], to: str = "n") -> DataFrame:
    """FREQUENCY: a row for each bin (upper bound, inclusive) and one for what is above all, zero counts too."""
    edges = sorted(bins)
    place = reduce(lambda acc, kv: acc.when(F.col(value) <= kv[1], kv[0]), list(enumerate(edges))[1:], F.when(F.col(value) <= edges[0], 0)).otherwise(len(edges))
    counts = df.where(F.col(value).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    shape = df.sparkSession.createDataFrame([(i, float(e)) for i, e in enumerate(edges)] + [(len(edges), None)], "bin int, upper double")
    return shape.join(counts, "bin", "left").select("bin", "upper", F.coalesce("_n", F.lit(0)).cast("long").alias(to))


def sequence(spark, rows: int, cols: int = 1, start: float = 1, step: float = 1) -> DataFrame:
    """SEQUENCE as (row, col, value), made in parallel."""
    n = spark.range(rows * cols)
    return n.select(F.floor(F.col("id") / cols).alias("row"), (F.col("id") % cols).alias("col"), (F.lit(float(start)) + F.col("id") * float(step)).alias("value"))


def random_grid(spark, rows: int, cols: int = 1, low: float = 0, high: float = 1, whole: bool = False, seed: int | None = None) -> DataFrame:
    """RANDARRAY as (row, col, value)."""
    r = F.rand(seed) if seed is not None else F.rand()
    value = F.floor(r * (high - low + 1)) + low if whole else r * (high - low) + low
    return spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("row"), (F.col("id") % cols).alias("col"), value.cast("double").alias("value"))


def make_array(spark, rows: int, cols: int, body) -> DataFrame:
    """MAKEARRAY: `body(row, col)` of 1-based number columns, as (row, col, value)."""
    grid = sequence(spark, rows, cols).select((F.col("row") + 1).alias("row"), (F.col("col") + 1).alias("col"))
    return grid.select("row", "col", body(F.col("row").cast("double"), F.col("col").cast("double")).alias("value"))


def identity(spark, n: int) -> DataFrame:
    """MUNIT as (row, col, value)."""
    return make_array(spark, n, n, lambda i, j: (i == j).cast("double"))


def auto_filter(df: DataFrame, columns: dict[str, list]) -> DataFrame:
    """Value lists for columns, joined by AND; None in a list lets blanks through."""
    def one(name: str, values: list) -> Column:
        hit = F.coalesce(F.col(name).isin([v for v in values if v is not None]), F.lit(False))
        return hit | F.col(name).isNull() if None in values else hit

    return df.where(reduce(lambda a, b: a & b, [one(n, v) for n, v in columns.items()], F.lit(True)))


def skip_rows(df: DataFrame, skip: int | list[int], row: str = "row_id", limit: int | None = None) -> DataFrame:
    """Rows from `skip` on, or all but those that a list names, by their row number; then at most `limit` of them."""
    kept = df.where(F.col(row) >= skip) if isinstance(skip, int) else df.where(~F.col(row).isin(skip))
    return kept if limit is None else kept.orderBy(row).limit(limit)


def trim_tail(df: DataFrame, row: str = "row_id") -> DataFrame:
    """Rows up to the last that has anything but blanks."""
    blank = lambda c, t: F.coalesce(F.trim(c) == "", F.lit(True)) if t == "string" else c.isNull()
    empty = reduce(lambda a, b: a & b, [blank(F.col(c), t) for c, t in df.dtypes if c != row], F.lit(True))
    last = df.where(~empty).agg(F.max(row).alias("_last"))
    return df.join(F.broadcast(last), F.col(row) <= F.col("_last")).drop("_last")


def blank_to_null(df: DataFrame) -> DataFrame:
    """Text of white space alone as null."""
    return df.select(*[F.when(F.trim(c) != "", F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def observed_types(df: DataFrame) -> DataFrame:
    """(name, kind): the narrowest of int, float, boolean, date and string that takes every value of each text column, over all rows."""
    out = []
    for name, t in df.dtypes:
        if t != "string":
            continue
        c = F.trim(F.col(name))
        fits = lambda cond: F.bool_and(F.col(name).isNull() | cond)  # noqa: B023, E731
        kind = (
            F.when(F.count(name) == 0, "null").when(fits(c.rlike(r"^-?\d{1,18}$")), "int").when(fits(c.try_cast("double").isNotNull() & ~c.rlike("(?i)nan|inf")), "float")
            .when(fits(F.lower(c).isin("true", "false")), "boolean").when(fits(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & c.try_cast("date").isNotNull()), "date").otherwise("string")
        )
        out.append(F.struct(F.lit(name).alias("name"), kind.alias("kind")))
    return df.agg(F.array(*out).alias("r")).select(F.inline("r"))


def retyped(df: DataFrame) -> DataFrame:
    """Text columns cast to their observed types, so that no value turns into null."""
    to = {"int": "bigint", "float": "double", "boolean": "boolean", "date": "date"}
    kinds = {r["name"]: to[r["kind"]] for r in observed_types(df).collect() if r["kind"] in to}  # a row for each column
    return df.select(*[F.trim(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])


def cast_report(df: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """(key, name, detail): cells that would be null as the Spark types `kinds` asks for."""
    cells = F.array(*[F.when(F.col(c).isNotNull() & F.col(c).try_cast(k).isNull(), F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("detail"))) for c, k in kinds.items()])
    return df.select(key, F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("c")).select(key, "c.name", "c.detail")
