"""The two criteria languages, compiled on the driver into filter columns that reach the scan.

`matches` is the language of the conditional aggregates (">5", "<>x", "ap*", "").
`grid` is that of the criteria grid: rows are alternatives, columns are joined by AND;
bare text matches by prefix there and numbers are never read from text.
"""

from __future__ import annotations

import datetime
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPERATORS = ("<>", "<=", ">=", "=", "<", ">")


def kind(t: T.DataType) -> str:
    """The worksheet type of a Spark type."""
    if isinstance(t, T.NumericType):
        return "n"
    if isinstance(t, T.BooleanType):
        return "b"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "d"
    return "t"


def split_operator(text: str) -> tuple[str, str]:
    op = next((o for o in _OPERATORS if text.startswith(o)), "")
    return op, text[len(op) :]


def as_number(text: str) -> float | None:
    try:
        return float(text[:-1]) / 100 if text.endswith("%") else float(text)
    except ValueError:
        return None


def as_date(text: str) -> datetime.date | None:
    m = re.fullmatch(r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})", text.strip())
    try:
        return datetime.date(*map(int, m.groups())) if m else None
    except ValueError:
        return None


def has_wildcard(text: str) -> bool:
    return bool(re.search(r"[*?~]", text))


def like(text: str) -> str:
    """A LIKE pattern with backslash escapes for `*`, `?` and the escape `~`."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "~" and i + 1 < len(text) and text[i + 1] in "*?~":
            i += 1
            out.append(text[i])
        else:
            out.append({"*": "%", "?": "_"}.get(c) or ("\\" + c if c in "%_\\" else c))
        i += 1
    return "".join(out)


def _compare(c: Column, op: str, value) -> Column:
    return {"=": c == value, "": c == value, "<>": c != value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op]


def matches(c: Column, t: str, criterion) -> Column:
    """Whether the cell of column `c` of worksheet type `t` ("n", "t", "b", "d") meets `criterion`; never null.

    Equality also takes a number written as text; `<>` takes everything else,
    blanks included; order comparisons take cells of the criterion's own type.
    """
    no, yes = F.lit(False), F.lit(True)
    if isinstance(criterion, bool):
        return F.coalesce(c == criterion, no) if t == "b" else no
    if isinstance(criterion, (int, float)):
        op, rest, number = "=", str(criterion), float(criterion)
    elif isinstance(criterion, (datetime.date, datetime.datetime)):
        return F.coalesce(c == F.lit(criterion), no) if t == "d" else no
    elif criterion is None or criterion == "":
        return c.isNull() | (c == "") if t == "t" else c.isNull()
    else:
        op, rest = split_operator(criterion)
        number = as_number(rest)
    if rest == "" and op in ("=", "<>"):
        blank = c.isNull()
        return blank if op == "=" else ~blank
    if t == "d" and (day := as_date(rest)):
        hit = _compare(c, op, F.lit(day))
    elif number is not None:
        if t == "n":
            hit = _compare(c, op, F.lit(number))
        elif t == "d":
            hit = _compare(F.date_diff(c.cast("date"), F.lit("1899-12-30").cast("date")), op, F.lit(number))
        elif t == "t" and op in ("", "="):
            hit = F.trim(c).try_cast("double") == number
        else:
            hit = yes if op == "<>" else no
    elif t == "b":
        want = {"true": True, "false": False}.get(rest.lower())
        hit = _compare(c, op, F.lit(want)) if want is not None and op in ("", "=", "<>") else (yes if op == "<>" else no)
    elif t != "t":
        hit = yes if op == "<>" else no
    elif op in ("", "=", "<>"):
        low = F.lower(c)
        same = low.like(like(rest.lower())) if has_wildcard(rest) else low == rest.lower()
        hit = ~same if op == "<>" else same
    else:
        hit = _compare(F.lower(c), op, F.lit(rest.lower()))
    if op == "<>":
        return F.coalesce(hit, yes)
    # Never null, and in a form that reaches the scan where the comparison does; text that is no number compares as null.
    return F.coalesce(hit, no) if t == "t" and number is not None else c.isNotNull() & hit


def all_of(df: DataFrame, pairs: list[tuple[str, object]]) -> Column:
    """(column name, criterion) pairs joined by AND."""
    return reduce(lambda a, b: a & b, [matches(F.col(n), kind(df.schema[n].dataType), k) for n, k in pairs], F.lit(True))


def grid_cell(c: Column, t: str, criterion) -> Column:
    """One cell of a criteria grid; a blank asks nothing."""
    if criterion is None or criterion == "":
        return F.lit(True)
    if isinstance(criterion, (bool, int, float)):
        want = {"b": bool, "n": (int, float)}.get(t)
        ok = want and isinstance(criterion, want) and not (t == "n" and isinstance(criterion, bool))
        return F.coalesce(c == criterion, F.lit(False)) if ok else F.lit(False)
    op, rest = split_operator(criterion)
    number = as_number(rest)
    if rest == "":
        return c.isNull() if op == "=" else c.isNotNull() if op == "<>" else F.lit(True)
    if number is not None and t == "n":
        hit = _compare(c, op, F.lit(number))
    elif t == "d" and (day := as_date(rest)):
        hit = _compare(c, op, F.lit(day))
    elif t == "t":
        low, text = F.lower(c), rest.lower()
        pattern = low.like(like(text) + ("" if op else "%")) if op in ("", "=", "<>") else None
        hit = _compare(low, op, F.lit(text)) if pattern is None else (~pattern if op == "<>" else pattern)
    else:
        hit = F.lit(op == "<>")
    return F.coalesce(hit, F.lit(op == "<>"))


def grid(df: DataFrame, rows: list[dict[str, object]]) -> Column:
    """OR over `rows` of AND over their cells; a header that names no column makes its row match nothing unless the cell is blank."""
    names = {n.lower(): n for n in df.columns}
    out = F.lit(False)
    for row in rows:
        cond = F.lit(True)
        for header, criterion in row.items():
            name = names.get(header.lower())
            if name is None:
                cond = cond & F.lit(criterion in (None, ""))
            else:
                cond = cond & grid_cell(F.col(name), kind(df.schema[name].dataType), criterion)
        out = out | cond
    return out
