"""CSV and JSON with spreadsheet rules: nothing is inferred unless asked, and text that only looks like a number stays text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"', header: bool = True, infer: bool = False) -> DataFrame:
    """Every field as text; an unquoted empty field is null, a quoted one is "". With `infer`, columns of plain numbers become numbers."""
    raw = spark.read.option("sep", delimiter).option("quote", quote).option("escape", quote).option("header", header).option("multiLine", True).option("nullValue", None).option("emptyValue", "").option("inferSchema", False).csv(path)
    return promoted(raw) if infer else raw


def plain_number(c: Column) -> Column:
    """Text that can be read as a number without losing anything: no leading zeros, no signs of identifiers, at most 15 digits."""
    return c.rlike(r"^-?(?:0|[1-9]\d{0,14})(?:\.\d{1,15})?$") & (F.length(F.regexp_replace(c, r"[^\d]", "")) <= 15)


def promoted(df: DataFrame) -> DataFrame:
    """Columns whose every field is a plain number, cast; decided in one aggregation over all rows."""
    names = [n for n, t in df.dtypes if t == "string"]
    if not names:
        return df
    checks = [F.struct(F.bool_and(plain_number(F.col(f"`{n}`")) | F.col(f"`{n}`").isNull()).alias("n"), F.bool_and(~F.contains(F.col(f"`{n}`"), F.lit("."))).alias("i"), F.count(F.col(f"`{n}`")).alias("k")).alias(f"c{i}") for i, n in enumerate(names)]
    got = df.agg(*checks).first()
    kinds = {n: ("bigint" if got[f"c{i}"]["i"] else "double") for i, n in enumerate(names) if got[f"c{i}"]["n"] and got[f"c{i}"]["k"]}
    return df.select(*[F.col(f"`{n}`").cast(kinds[n]).alias(n) if n in kinds else F.col(f"`{n}`") for n in df.columns])


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, date_format: str = "yyyy-MM-dd", line_end: str = "\r\n") -> None:
    """Null as nothing, "" as two quotes; whole numbers without a point."""
    cols = [F.when(F.col(n) == F.floor(F.col(n)), F.col(n).cast("decimal(38,0)").cast("string")).otherwise(F.col(n).cast("string")).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes]
    df.select(*cols).write.option("sep", delimiter).option("header", header).option("nullValue", "").option("emptyValue", '""').option("dateFormat", date_format).option("lineSep", line_end).option("escape", '"').mode("overwrite").csv(path)


def read_json(spark: SparkSession, path: str, shape: str = "ndjson", multi_line: bool = False) -> DataFrame:
    """ndjson, records (an array of objects) or columns (an object of arrays). Integers beyond 2^53 stay text, nested values raw JSON."""
    if shape == "columns":
        text = spark.read.text(path, wholetext=True)
        cols = spark.read.option("primitivesAsString", True).option("multiLine", True).json(path).columns
        arrays = text.select(*[F.from_json(F.get_json_object("value", f"$.{c}"), "array<string>").alias(c) for c in cols])
        zipped = arrays.select(F.posexplode(F.arrays_zip(*cols)).alias("row_id", "r"))
        return typed_json(zipped.select("row_id", *[F.col("r")[c].alias(c) for c in cols]), cols)
    raw = spark.read.option("primitivesAsString", True).option("multiLine", shape == "records" or multi_line).json(path)
    flat = raw.select(*[F.to_json(n).alias(n) if t.startswith(("struct", "array", "map")) else F.col(f"`{n}`") for n, t in raw.dtypes])
    return typed_json(flat, flat.columns)


def typed_json(df: DataFrame, names: list[str]) -> DataFrame:
    """Numbers and booleans of text columns where every value is one; integers past 2^53 keep the column text."""
    checks = []
    for i, n in enumerate(names):
        c = F.col(f"`{n}`")
        ok = c.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$")
        safe = ~c.rlike(r"^-?\d+$") | (F.abs(c.try_cast("decimal(38,0)")) <= 2**53)
        checks.append(F.struct(F.bool_and(c.isNull() | (ok & safe)).alias("n"), F.bool_and(c.isNull() | c.isin("true", "false")).alias("b"), F.bool_and(c.isNull() | c.rlike(r"^-?\d+$")).alias("i"), F.count(c).alias("k")).alias(f"c{i}"))
    got = df.agg(*checks).first()
    kind = lambda g: None if not g["k"] else "boolean" if g["b"] else ("bigint" if g["i"] else "double") if g["n"] else None
    kinds = {n: kind(got[f"c{i}"]) for i, n in enumerate(names)}
    return df.select(*[F.col(f"`{n}`").cast(kinds[n]).alias(n) if kinds.get(n) else F.col(f"`{n}`") for n in df.columns])


def write_json(df: DataFrame, path: str, shape: str = "ndjson") -> None:
    """Every key on every record, null for blanks; integers past 2^53 as text, no infinities. records and columns are one document by nature."""
    safe = []
    for n, t in df.dtypes:
        c = F.col(f"`{n}`")
        if t == "double":
            safe.append(F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(n))
        elif t == "bigint":
            big = df.select(F.coalesce(F.max(F.abs(c)), F.lit(0)).alias("m")).first()["m"] > 2**53
            safe.append(c.cast("string").alias(n) if big else c)
        else:
            safe.append(c)
    out = df.select(*safe)
    if shape == "ndjson":
        out.write.option("ignoreNullFields", False).mode("overwrite").json(path)
        return
    row = F.to_json(F.struct(*[F.col(f"`{n}`") for n in out.columns]), {"ignoreNullFields": "false"})
    if shape == "records":
        doc = out.select(row.alias("r")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ","), F.lit("]")).alias("value"))
    else:
        doc = out.agg(F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.to_json(F.array(F.lit(n))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(n)))) - 2), F.lit(":"), F.to_json(F.transform(F.collect_list(F.struct(F.col(f"`{n}`").alias("v"))), lambda s: s["v"]), {"ignoreNullFields": "false"})) for n in out.columns]), F.lit("}")).alias("value"))
    doc.write.mode("overwrite").text(path)
