"""Least squares, matrices and rates of cash flows for groups of rows.

Regressions need sums only, so a group of any size reduces to its normal equations
by built-in aggregates, and numpy solves one small system a group. Matrices are in
long form (i, j, value): products are a join and a sum. Inverses and determinants
take a whole matrix of bounded size per group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.finance import xirr

MOST_ORDER = 2000  # of a matrix that one task inverts


def normal_equations(df: DataFrame, y: str, xs: list[str], by: list[str], const: bool = True, logs: bool = False) -> DataFrame:
    """Per group: n, the sums of y and y squared, and the products of [xs, 1] with each other and with y."""
    target = F.ln(y) if logs else F.col(y)
    cols = [F.col(x).cast("double") for x in xs] + ([F.lit(1.0)] if const else [])
    ok = df.where(target.isNotNull() & F.lit(True)).dropna(subset=xs)
    grid = [F.sum(a * b).alias(f"p{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    right = [F.sum(a * target).alias(f"q{i}") for i, a in enumerate(cols)]
    return ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("sy"), F.sum(target * target).alias("syy"), *grid, *right)


def linest(df: DataFrame, y: str, xs: list[str], by: list[str], const: bool = True, logs: bool = False) -> DataFrame:
    """LINEST (LOGEST with `logs`) with statistics: coefficients by name, errors, r2, sey, f, df, ssreg, ssresid.

    by must name at least one column; a constant column makes one group of all.
    """
    k = len(xs) + const
    sums = normal_equations(df, y, xs, by, const, logs)
    names = [*xs, *(["intercept"] if const else [])]

    def solve(batches):
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                a = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
                q = np.array([r[f"q{i}"] for i in range(k)], float)
                w = np.linalg.lstsq(a, q, rcond=None)[0]
                rest = max(0.0, r["syy"] - w @ q)
                total = r["syy"] - (r["sy"] ** 2 / r["n"] if const else 0)
                freedom = r["n"] - k
                s2 = rest / freedom if freedom > 0 else np.nan
                err = np.sqrt(np.maximum(0, np.diag(np.linalg.pinv(a)) * s2))
                reg = total - rest
                coef = np.exp(w) if logs else w
                out.append({**{c: r[c] for c in by}, **dict(zip(names, coef, strict=True)), **{f"se_{n}": e for n, e in zip(names, err, strict=True)}, "r2": reg / total if total else 1.0, "sey": np.sqrt(s2), "f": reg / len(xs) / s2 if s2 else np.nan, "df": float(freedom), "ssreg": reg, "ssresid": rest})
            yield pd.DataFrame(out, columns=[*by, *names, *[f"se_{n}" for n in names], "r2", "sey", "f", "df", "ssreg", "ssresid"])

    kinds = dict(df.dtypes)
    doubles = [*names, *[f"se_{n}" for n in names], "r2", "sey", "f", "df", "ssreg", "ssresid"]
    return sums.mapInPandas(solve, ", ".join([f"`{c}` {kinds[c]}" for c in by] + [f"`{n}` double" for n in doubles]))


def trend(df: DataFrame, y: str, xs: list[str], by: list[str], new: DataFrame | None = None, const: bool = True, logs: bool = False, to: str = "fitted") -> DataFrame:
    """TREND (GROWTH with `logs`): fitted values for the rows of `new`, or of `df` itself."""
    fit = linest(df, y, xs, by, const, logs).select(*by, *[F.col(x).alias(f"_c{i}") for i, x in enumerate(xs)], (F.col("intercept") if const else F.lit(1.0 if logs else 0.0)).alias("_b"))
    rows = (new if new is not None else df).join(fit, by)
    value = F.col("_b")
    for i, x in enumerate(xs):
        value = value * F.pow(F.col(f"_c{i}"), F.col(x)) if logs else value + F.col(f"_c{i}") * F.col(x)
    return rows.withColumn(to, value).drop("_b", *[f"_c{i}" for i in range(len(xs))])


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """MMULT of long matrices (i, j, value)."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("value").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("value").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def outer(rows: DataFrame, cols: DataFrame, most: int = 10_000) -> DataFrame:
    """A column vector (i, value) times a row vector (j, value): (i, j, value). One side must be a short vector, which is checked, as it is sent everywhere."""
    short = cols.limit(most + 1).count() <= most
    if not short and rows.limit(most + 1).count() > most:
        raise ValueError(f"an outer product of two vectors of over {most} cells")
    a, b = rows.select("i", F.col("value").alias("x")), cols.select("j", F.col("value").alias("y"))
    pairs = a.join(F.broadcast(b), F.lit(True)) if short else b.join(F.broadcast(a), F.lit(True))
    return pairs.select("i", "j", (F.col("x") * F.col("y")).alias("value"))


def _dense(g: pd.DataFrame) -> np.ndarray:
    n = int(max(g["i"].max(), g["j"].max())) + 1
    if n > MOST_ORDER:
        raise ValueError(f"a matrix of order {n} is over the limit of {MOST_ORDER}")
    m = np.zeros((n, n))
    m[g["i"].to_numpy(), g["j"].to_numpy()] = g["value"]
    return m


def matrix_inverse(a: DataFrame, by: str) -> DataFrame:
    """MINVERSE of every long matrix (by, i, j, value); singular ones give no rows."""

    def inverse(g: pd.DataFrame) -> pd.DataFrame:
        m = _dense(g)
        if abs(np.linalg.det(m)) < 1e-300:
            return pd.DataFrame({by: [], "i": [], "j": [], "value": []})
        inv = np.linalg.inv(m)
        i, j = np.indices(inv.shape)
        return pd.DataFrame({by: g[by].iloc[0], "i": i.ravel(), "j": j.ravel(), "value": inv.ravel()})

    return a.groupBy(by).applyInPandas(inverse, f"`{by}` {dict(a.dtypes)[by]}, i long, j long, value double")


def matrix_determinant(a: DataFrame, by: str) -> DataFrame:
    """MDETERM of every long matrix (by, i, j, value)."""
    return a.groupBy(by).applyInPandas(lambda g: pd.DataFrame({by: [g[by].iloc[0]], "det": [float(np.linalg.det(_dense(g)))]}), f"`{by}` {dict(a.dtypes)[by]}, det double")


def npv(df: DataFrame, flow: str, by: list[str], order: list[str], rate: float, to: str = "npv") -> DataFrame:
    """NPV of each group's flows in order."""
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.where(F.col(flow).isNotNull()).withColumn("_k", k).groupBy(*by).agg(F.sum(F.col(flow) / F.pow(F.lit(1.0 + rate), F.col("_k"))).alias(to))


def xnpv(df: DataFrame, flow: str, date: str, by: list[str], rate: float, to: str = "xnpv") -> DataFrame:
    """XNPV: flows discounted by days from the group's first date."""
    first = df.groupBy(*by).agg(F.min(date).alias("_d"))
    return df.join(first, by).groupBy(*by).agg(F.sum(F.col(flow) / F.pow(F.lit(1.0 + rate), F.date_diff(date, "_d") / 365)).alias(to))


def mirr(df: DataFrame, flow: str, by: list[str], order: list[str], finance: float, reinvest: float, to: str = "mirr") -> DataFrame:
    """MIRR: null (#DIV/0!) where a group has no flow of one sign."""
    from pyspark.sql import Window as W

    at = df.where(F.col(flow).isNotNull()).withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*by)))
    v = F.col(flow)
    gains = F.sum(F.when(v > 0, v * F.pow(F.lit(1.0 + reinvest), F.col("_n") - 1 - F.col("_k"))))
    costs = F.sum(F.when(v < 0, -v / F.pow(F.lit(1.0 + finance), F.col("_k"))))
    return at.groupBy(*by).agg((F.pow(F.try_divide(gains, costs), F.try_divide(F.lit(1.0), F.max("_n") - 1)) - 1).alias(to))


def irr(df: DataFrame, flow: str, by: list[str], order: list[str], date: str | None = None, guess: float = 0.1, to: str = "irr") -> DataFrame:
    """IRR of each group's flows in order, or XIRR by `date`; null without a change of sign. A group's flows are one task's array."""
    when = F.date_diff(F.col(date), F.lit("1970-01-01").cast("date")).cast("double").alias("t") if date else F.lit(0.0).alias("t")
    rows = df.where(F.col(flow).isNotNull()).select(*by, F.struct(*order, F.col(flow).cast("double").alias("v"), when).alias("s"))
    arrays = rows.groupBy(*by).agg(F.array_sort(F.collect_list("s")).alias("a")).select(*by, F.transform("a", lambda s: s["v"]).alias("v"), F.transform("a", lambda s: s["t"]).alias("t"))

    def solve(batches):
        for b in batches:
            rates = []
            for v, t in zip(b["v"], b["t"], strict=True):
                v, t = np.asarray(v, float), np.asarray(t, float)
                rates.append(xirr(v, (t - t.min()) / 365 if date else np.arange(len(v), dtype=float), guess))
            yield pd.DataFrame({**{c: b[c] for c in by}, to: pd.Series(rates, dtype=object).where(~np.isnan(np.array(rates, float)), None)})

    kinds = dict(df.dtypes)
    return arrays.mapInPandas(solve, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], f"`{to}` double"]))
