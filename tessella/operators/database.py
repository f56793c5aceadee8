"""Database functions: one aggregate over the rows that a criteria grid selects, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import V, apply
from .criteria import grid, kind

NAMES = {"DSUM": "SUM", "DAVERAGE": "AVERAGE", "DCOUNT": "COUNT", "DCOUNTA": "COUNTA", "DMAX": "MAX", "DMIN": "MIN", "DPRODUCT": "PRODUCT", "DSTDEV": "STDEV.S", "DSTDEVP": "STDEV.P", "DVAR": "VAR.S", "DVARP": "VAR.P"}


def field_of(df: DataFrame, field: str | int | None) -> str | None:
    """A field by header without case, or by place from 1."""
    if field is None:
        return None
    if isinstance(field, (int, float)):
        return df.columns[int(field) - 1]
    return {n.lower(): n for n in df.columns}[field.lower()]


def value(df: DataFrame, function: str, field: str | int | None, rows: list[dict[str, object]]) -> V:
    """The aggregate as a value; DGET wants exactly one matching record (#VALUE! for none, #NUM! for more)."""
    hit, name = grid(df, rows), field_of(df, field)
    function = function.upper()
    if function == "DGET":
        n = F.count_if(hit)
        return V(F.first(F.when(hit, F.col(name)), True), kind(df.schema[name].dataType), F.when(n == 0, F.lit("#VALUE!")).when(n > 1, F.lit("#NUM!")))
    if name is None:
        return V(F.count_if(hit).cast("double"))
    t = kind(df.schema[name].dataType)
    if function in ("DCOUNTA",):
        return V(F.count(F.when(hit, F.col(name))).cast("double"))
    numbers: Column = F.col(name).cast("double") if t == "n" else F.lit(None).cast("double")
    return apply(NAMES[function], V(F.when(hit, numbers), "n", ranged=True))


def database(df: DataFrame, calls: dict[str, tuple[str, str | int | None, list[dict[str, object]]]], by: list[str] | None = None) -> DataFrame:
    """Many database functions over one frame, fused into one aggregation: name -> (function, field, criteria rows)."""
    cols = [value(df, f, field, rows).sql().alias(name) for name, (f, field, rows) in calls.items()]
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)
