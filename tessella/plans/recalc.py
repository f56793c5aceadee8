"""Column-level recalculation: formulas that name each other, planned in dependency order.

Formulas of one level become one projection, so a plan has as many projections as
the longest chain of formulas. Nothing is guessed: formulas that do not parse, name
what is unknown, or sit on a cycle are reported and left out, with all that use them.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .compiler import row
from .parser import FormulaError, Name, parse, walk


@dataclass(frozen=True)
class Report:
    name: str
    status: str  # computed, fallback or cycle
    level: int | None = None
    detail: str = ""


def references(formula: str) -> set[str]:
    return {t.name.lower() for t in walk(parse(formula)) if isinstance(t, Name)}


def order(columns: list[str], formulas: dict[str, str]) -> tuple[list[list[str]], list[Report]]:
    """Levels of formulas that can be computed, and a report on each."""
    known, low = {c.lower() for c in columns}, {n.lower(): n for n in formulas}
    needs: dict[str, set[str]] = {}
    reports: dict[str, Report] = {}
    for name, f in formulas.items():
        try:
            needs[name] = {low.get(r, r) for r in references(f) if r in low or r not in known}
        except FormulaError as e:
            reports[name] = Report(name, "fallback", None, str(e))
    levels, done = [], set()
    while True:
        ready = sorted(n for n, d in needs.items() if n not in done and d <= done)
        if not ready:
            break
        levels.append(ready)
        done |= set(ready)
        for n in ready:
            reports[n] = Report(n, "computed", len(levels))
    left = {n: d for n, d in needs.items() if n not in done}
    for n in left:
        seen, todo = set(), list(left[n])
        while todo:
            x = todo.pop()
            if x in seen:
                continue
            seen.add(x)
            todo += left.get(x, ())
        unknown = sorted(x for x in seen if x not in formulas)
        cyclic = n in seen
        reports[n] = Report(n, "cycle" if cyclic else "fallback", None, "" if cyclic else f"needs {', '.join(unknown or sorted(left[n]))}")
    return levels, [reports[n] for n in formulas]


def recalculate(df: DataFrame, formulas: dict[str, str]) -> tuple[DataFrame, list[Report]]:
    """`df` with every formula that can be computed, errors as null, and the reports."""
    levels, reports = order(df.columns, formulas)
    for names in levels:
        df = df.select("*", *[row(df, formulas[n]).sql().alias(n) for n in names])
    return df, reports


def edges(spark, formulas: dict[str, str]) -> DataFrame:
    """(formula, needs) edges as a frame."""
    rows = [(n, r) for n, f in formulas.items() for r in sorted(references(f))]
    return spark.createDataFrame(rows, "formula string, needs string")


def reachable(graph: DataFrame, start: list[str], dependents: bool = False) -> DataFrame:
    """(name, depth): all that `start` needs, or with `dependents` all that need it, by joins until nothing is new.

    Each front is written, and every ten what is found, so plans stay short along a long chain.
    """
    source, target = ("needs", "formula") if dependents else ("formula", "needs")
    spark = graph.sparkSession
    found = spark.createDataFrame([(s,) for s in start], "name string").withColumn("depth", F.lit(0))
    edge = graph.select(F.lower(source).alias("a"), F.lower(target).alias("b"))
    front = found
    for step in count(1):
        front = materialise(front.join(edge, F.lower("name") == F.col("a")).select(F.col("b").alias("name")).distinct().join(found.select("name"), "name", "left_anti").withColumn("depth", F.lit(step)))
        if front.isEmpty():
            break
        found = found.unionByName(front)
        if step % 10 == 0:
            found = materialise(found)
    return found.where("depth > 0")
