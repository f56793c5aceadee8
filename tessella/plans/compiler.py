"""Formulas to column expressions.

`row(df, formula)` is a value for each row: names and A1 columns are the row's own
cells. `aggregate(df, formula)` is one value over rows: inside aggregating functions,
names are whole columns; many formulas fuse into one aggregation. Names of LET and
parameters of LAMBDA are expanded while planning. Text formats, criteria and other
constants are compiled on the driver, so what runs is built-in expressions.
"""

from __future__ import annotations

import datetime
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import REGISTRY, V, apply, error, lit
from ..functions.core import first_error, number, text
from ..functions.engineering import all_units
from ..functions.finance import xirr
from ..functions.logical import equal, same_type
from ..operators import criteria as C
from ..operators.relational import NUMBERED
from .parser import Array, Binary, Call, Err, FormulaError, Lit, Name, Ref, Unary, parse, reference
from .textformat import format_value, impossible

MOST_DEPTH = 128  # of nested calls of a LAMBDA

#: Functions that this module compiles itself, as they see their arguments' syntax.
SPECIAL: dict[str, object] = {}


def special(*names: str):
    def wrap(f):
        for n in names:
            SPECIAL[n] = f
        return f

    return wrap


class Lambda:
    def __init__(self, params: list[str], body, scope: dict):
        self.params, self.body, self.scope = params, body, scope


class ArrayValue:
    """A constant-shape array of values: rows of V."""

    def __init__(self, rows: list[list[V]]):
        self.rows = rows

    def flat(self) -> list[V]:
        return [v for r in self.rows for v in r]


class Compiler:
    def __init__(self, df: DataFrame, tables: dict[str, DataFrame] | None = None, scope: dict | None = None, depth: int = 0, grid: dict[tuple[int, int], object] | None = None):
        self.df, self.tables, self.scope, self.depth, self.grid = df, tables or {}, scope or {}, depth, grid
        self.names = {f.name.lower(): f for f in df.schema.fields}

    def with_scope(self, more: dict) -> Compiler:
        if self.depth >= MOST_DEPTH:
            raise FormulaError("calls nest too deeply: #NUM!")
        return Compiler(self.df, self.tables, {**self.scope, **more}, self.depth + 1, self.grid)

    def column(self, field) -> V:
        c, t = F.col(f"`{field.name}`"), C.kind(field.dataType)
        return V(c.cast("double") if t == "n" else c, t, source=field.name, ranged=True)

    def value(self, tree):
        """V, ArrayValue or Lambda of a tree; an array already made is itself."""
        if isinstance(tree, ArrayValue):
            return tree
        if isinstance(tree, Lit):
            return lit(tree.value)
        if isinstance(tree, Err):
            return error(tree.code)
        if isinstance(tree, Name):
            if tree.table is None and tree.name.lower() in self.scope:
                return self.scope[tree.name.lower()]
            field = self.names.get(tree.name.lower())
            return self.column(field) if field else error("#NAME?")
        if isinstance(tree, Ref) and self.grid is not None:
            return self.cells(tree)
        if isinstance(tree, Ref):
            fields = self.df.schema.fields
            if tree.left is None or tree.left != tree.right or tree.left > len(fields) or tree.sheet:
                return error("#REF!")
            return self.column(fields[tree.left - 1])
        if isinstance(tree, Array):
            return ArrayValue([[self.value(x) for x in r] for r in tree.rows])
        if isinstance(tree, Unary):
            return self.unary(tree)
        if isinstance(tree, Binary):
            return broadcast(lambda a, b: binary(tree.op, a, b), self.value(tree.a), self.value(tree.b))
        return self.call(tree)

    def cells(self, r: Ref):
        """Constant cells of the grid: one value, or an array; blanks are null."""
        rows, cols = [k[0] for k in self.grid], [k[1] for k in self.grid]
        top, bottom = r.top or 1, r.bottom or max(rows, default=1)
        left, right = r.left or 1, r.right or max(cols, default=1)
        name = lambda i, j: f"R{i}C{j}"
        one = lambda i, j: replace(lit(self.grid.get((i, j))), source=name(i, j))
        return one(top, left) if r.single else ArrayValue([[one(i, j) for j in range(left, right + 1)] for i in range(top, bottom + 1)])

    def unary(self, tree: Unary):
        x = self.value(tree.x)
        if tree.op in "+@":
            return x
        f = (lambda v: V(-number(v).v, "n", number(v).e)) if tree.op == "-" else (lambda v: V(number(v).v / 100, "n", number(v).e))
        return ArrayValue([[f(v) for v in r] for r in x.rows]) if isinstance(x, ArrayValue) else f(x)

    def call(self, tree: Call):
        name = tree.name
        if name == "":
            f = self.value(tree.args[0])
            return self.invoke(f, [self.value(a) for a in tree.args[1:]]) if isinstance(f, Lambda) else error("#VALUE!")
        if name.lower() in self.scope and isinstance(self.scope[name.lower()], Lambda):
            return self.invoke(self.scope[name.lower()], [self.value(a) for a in tree.args])
        if name in SPECIAL:
            return SPECIAL[name](self, *tree.args)
        if name not in REGISTRY:
            return error("#NAME?")
        args = [self.value(a) for a in tree.args]
        spec = REGISTRY[name]
        if spec.kind == "aggregate" and (any(isinstance(a, ArrayValue) for a in args) or not any(isinstance(a, V) and a.ranged for a in args)):
            return over_array(name, args)
        flat = [v for a in args for v in (a.flat() if isinstance(a, ArrayValue) else [a])] if spec.takes.endswith("+") else None
        if flat is None and any(isinstance(a, ArrayValue) for a in args):
            return broadcast(lambda *xs: apply(name, *xs), *args)
        return apply(name, *(flat if flat is not None else args))

    def invoke(self, f: Lambda, args: list):
        given = {p.lower(): (args[i] if i < len(args) else OMITTED) for i, p in enumerate(f.params)}
        if len(args) > len(f.params):
            return error("#VALUE!")
        return Compiler(self.df, self.tables, {**f.scope, **given}, self.depth + 1, self.grid).value(f.body) if self.depth < MOST_DEPTH else error("#NUM!")


OMITTED = object()  # an argument that was not given


def broadcast(f, *args):
    """f over values, element by element where some are arrays; a dimension of 1 repeats, others that end early give #N/A."""
    arrays = [a for a in args if isinstance(a, ArrayValue)]
    if not arrays:
        return f(*args)
    h, w = max(len(a.rows) for a in arrays), max(len(a.rows[0]) for a in arrays)

    def at(a, i, j):
        if not isinstance(a, ArrayValue):
            return a
        i, j = (0 if len(a.rows) == 1 else i), (0 if len(a.rows[0]) == 1 else j)
        return a.rows[i][j] if i < len(a.rows) and j < len(a.rows[0]) else error("#N/A")

    return ArrayValue([[f(*[at(a, i, j) for a in args]) for j in range(w)] for i in range(h)])


#: Aggregates that count text and booleans in ranges: text as 0, booleans as 0 and 1.
_LOOSE = {"AVERAGEA", "MAXA", "MINA", "STDEVA", "STDEVPA", "VARA", "VARPA"}


def over_array(name: str, args: list) -> V:
    """An aggregate of constant arrays: their elements become the rows of an inline table, which a scalar subquery aggregates.

    Arrays of one shape are columns side by side for functions of pairs; others are one
    column under another. In ranges, numbers alone count.
    """
    letters = REGISTRY[name].takes
    arrays = [a.flat() if isinstance(a, ArrayValue) else None for a in args]
    n = max((len(x) for x in arrays if x is not None), default=1)
    paired = len(letters.rstrip("+")) > 1 or (letters.endswith("+") and name in ("SUMPRODUCT",))
    if paired and any(len(x) != n for x in arrays if x is not None):
        return error("#VALUE!" if name == "SUMPRODUCT" else "#N/A")
    cols = [x if x is not None else [args[i]] * n for i, x in enumerate(arrays)] if paired else [[v for x, a in zip(arrays, args, strict=True) for v in (x or [a])]]
    scalars = {i for i, x in enumerate(arrays) if x is None}
    kind = lambda i: letters.rstrip("+")[min(i, len(letters.rstrip("+")) - 1)]

    def cell(v: V, i: int) -> Column:
        k = kind(i)
        if k == "t":
            return text(v).v
        if k == "*":
            return text(v).v if v.e is None else F.coalesce(text(v).v, v.e)
        if v.t == "d":
            return number(v).v
        if v.t == "n" or (i in scalars and paired) or (not paired and id(v) in loose):
            return number(v).v
        if name in _LOOSE:
            return F.lit(0.0) if v.t == "t" else number(v).v
        return F.lit(None).cast("double")

    loose = {id(a) for a in args if isinstance(a, V)}
    width = len(cols)
    table = F.arrays_zip(*[F.array(*[cell(v, i) for v in c]).alias(f"c{i}") for i, c in enumerate(cols)])
    errors = first_error(*[v.e for c in cols for v in c]) if name not in ("COUNT", "COUNTA", "COUNTBLANK") else None
    spark = SparkSession.getActiveSession()
    rows = spark.range(1).select(F.inline(table))
    rows = rows.toDF(*[f"c{i}" for i in range(width)])
    if paired and name not in ("SUMPRODUCT", "COUNT"):
        rows = rows.where(" AND ".join(f"c{i} IS NOT NULL" for i in range(width) if i not in scalars) or "TRUE")
    ready = [args[i] if paired and i in scalars else V(F.col(f"c{i}"), "t" if kind(i) in "t*" else "n", ranged=True) for i in range(width)]
    out = apply(name, *ready)
    got = rows.agg(F.struct(out.v.alias("v"), out.err().alias("e")).alias("r")).scalar()
    return V(got["v"], out.t, first_error(errors, got["e"]))


def binary(op: str, a: V, b: V) -> V:
    if op == "&":
        x, y = text(a), text(b)
        return V(F.concat(F.coalesce(x.v, F.lit("")), F.coalesce(y.v, F.lit(""))), "t", first_error(x.e, y.e))
    if op in ("=", "<>", "<", "<=", ">", ">="):
        return compare(op, a, b)
    x, y = number(a), number(b)
    e = first_error(x.e, y.e)
    if op == "+" and {a.t, b.t} == {"d", "n"}:
        d, n = (a, y) if a.t == "d" else (b, x)
        return V(F.date_add(d.v.cast("date"), F.floor(n.v).cast("int")), "d", e)
    if op == "-" and (a.t, b.t) == ("d", "n"):
        return V(F.date_sub(a.v.cast("date"), F.floor(y.v).cast("int")), "d", e)
    if op == "/":
        return V(F.try_divide(x.v, y.v), "n", first_error(e, F.when(y.v == 0, F.lit("#DIV/0!"))))
    out = {"+": lambda: x.v + y.v, "-": lambda: x.v - y.v, "*": lambda: x.v * y.v, "^": lambda: F.pow(x.v, y.v)}[op]()
    wild = F.when(F.isnan(out) | (F.abs(out) == float("inf")), F.lit("#NUM!")) if op in "^*" else None
    return V(out, "n", first_error(e, wild))


_RANK = {"n": 0, "d": 0, "t": 1, "b": 2}


def compare(op: str, a: V, b: V) -> V:
    """Numbers before text before booleans; text without case."""
    e = first_error(a.e, b.e)
    if _RANK[a.t] != _RANK[b.t]:
        x, y = F.lit(_RANK[a.t]), F.lit(_RANK[b.t])
    elif a.t == "t":
        x, y = F.lower(a.v), F.lower(b.v)
    elif a.t == "d" and b.t == "d":
        x, y = a.v, b.v
    else:
        x, y = number(a).v, number(b).v
    return V({"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "b", e)


# Functions that see their arguments' syntax.


def constant(tree):
    """The Python value of a constant tree, or a FormulaError."""
    if isinstance(tree, Lit):
        return tree.value
    if isinstance(tree, Unary) and tree.op in "+-" and isinstance(tree.x, Lit):
        return -tree.x.value if tree.op == "-" else tree.x.value
    if isinstance(tree, Call) and tree.name == "DATE" and all(isinstance(a, Lit) for a in tree.args):
        return datetime.date(*(int(a.value) for a in tree.args))
    if isinstance(tree, Binary) and tree.op == "&":
        return f"{_shown(constant(tree.a))}{_shown(constant(tree.b))}"
    raise FormulaError("a criterion must be a constant")


def _shown(x) -> str:
    return str(int(x)) if isinstance(x, float) and x == int(x) else str(x)


def condition(c: Compiler, range_, criterion) -> Column:
    v = c.value(range_)
    return C.matches(F.col(f"`{v.source}`") if v.source and c.grid is None else v.v, v.t, constant(criterion))


def _conditional(agg: str, c: Compiler, target, pairs) -> V:
    ranges = [(c.value(r), constant(k)) for r, k in zip(pairs[::2], pairs[1::2], strict=True)]
    if isinstance(ranges[0][0], ArrayValue):
        return _conditional_cells(agg, c, target, [(r.flat(), k) for r, k in ranges])
    cond = F.lit(True)
    for r, k in zip(pairs[::2], pairs[1::2], strict=True):
        cond = cond & condition(c, r, k)
    if target is None:
        return V(F.count_if(cond).cast("double"))
    v = c.value(target)
    values = v.v if v.t == "n" else F.lit(None).cast("double")
    return apply(agg, V(F.when(cond, values), "n", ranged=True))


def _conditional_cells(agg: str, c: Compiler, target, ranges: list) -> V:
    """The same over cells of a grid, each with a type of its own."""
    n = len(ranges[0][0])
    values = _array(c, target).flat() if target is not None else [lit(1)] * n
    if len(values) != n or any(len(r) != n for r, _ in ranges):
        return error("#VALUE!")
    kept = []
    for i in range(n):
        cond = F.lit(True)
        for r, k in ranges:
            cond = cond & (F.lit(k in (None, "") or (isinstance(k, str) and k.startswith("<>") and k != "<>")) if _is_blank(r[i]) else C.matches(r[i].v, r[i].t, k))
        kept.append(V(F.when(cond, values[i].v if values[i].t == "n" else F.lit(None).cast("double"))))
    return over_array({"COUNT": "COUNT"}.get(agg, agg), [ArrayValue([kept])])


def _is_blank(v: V) -> bool:
    return v is not None and v.source is not None and "CAST(NULL" in str(v.v)


special("SUMIFS")(lambda c, t, *p: _conditional("SUM", c, t, p))
special("COUNTIFS")(lambda c, *p: _conditional("COUNT", c, None, p))
special("AVERAGEIFS")(lambda c, t, *p: _conditional("AVERAGE", c, t, p))
special("MAXIFS")(lambda c, t, *p: _conditional("MAX", c, t, p))
special("MINIFS")(lambda c, t, *p: _conditional("MIN", c, t, p))
special("COUNTIF")(lambda c, r, k: _conditional("COUNT", c, None, (r, k)))
special("SUMIF")(lambda c, r, k, t=None: _conditional("SUM", c, t or r, (r, k)))
special("AVERAGEIF")(lambda c, r, k, t=None: _conditional("AVERAGE", c, t or r, (r, k)))


@special("SUBTOTAL")
def _subtotal(c, n, *ranges):
    return apply(NUMBERED[int(constant(n)) % 100], *[c.value(r) for r in ranges])


@special("AGGREGATE")
def _aggregate(c, n, option, target, *k):
    """Options 2, 3, 6 and 7 leave errors out, the others pass one on."""
    v = c.value(target)
    extra = [c.value(x) for x in k]
    out = apply(NUMBERED[int(constant(n))], V(v.v if v.e is None else F.when(v.e.isNull(), v.v), v.t, None, True), *extra)
    return out if int(constant(option)) in (2, 3, 6, 7) or v.e is None else V(out.v, out.t, first_error(F.max(v.e), out.e))


def _database(name: str):
    def build(c, db, field, grid):
        from ..operators.database import value

        rows = [[x.value if isinstance(x, Lit) else None for x in r] for r in grid.rows]
        records = [dict(zip(rows[0], r, strict=True)) for r in rows[1:]]
        return value(c.df, name, constant(field), records)

    return build


for _name in ("DSUM", "DAVERAGE", "DCOUNT", "DCOUNTA", "DMAX", "DMIN", "DPRODUCT", "DGET", "DSTDEV", "DSTDEVP", "DVAR", "DVARP"):
    SPECIAL[_name] = _database(_name)


@special("TEXT")
def _text(c, v, code):
    x = c.value(v)
    if impossible(str(constant(code))):
        return error("#VALUE!", "t")
    if x.t == "t":
        n = number(x)
        return V(F.coalesce(format_value(n.v, constant(code)), x.v), "t", x.e)
    n = number(x)
    out = format_value(n.v, constant(code))
    return V(out, "t", first_error(n.e, F.when(n.v.isNotNull() & out.isNull(), F.lit("#VALUE!"))))


@special("CONVERT")
def _convert(c, x, a, b):
    """Constant units become one factor while planning."""
    units = all_units()
    if isinstance(a, Lit) and isinstance(b, Lit) and a.value in units and b.value in units:
        (kind, f), (other, g) = units[a.value], units[b.value]
        n = number(c.value(x))
        return V(n.v * f / g, "n", n.e) if kind == other else error("#N/A")
    return apply("CONVERT", c.value(x), c.value(a), c.value(b))


@special("LET")
def _let(c, *args):
    for name, value in zip(args[:-1:2], args[1:-1:2], strict=True):
        c = c.with_scope({name.name.lower(): c.value(value)})
    return c.value(args[-1])


@special("LAMBDA")
def _lambda(c, *args):
    return Lambda([a.name for a in args[:-1]], args[-1], dict(c.scope))


@special("ISOMITTED")
def _isomitted(c, p):
    return V(F.lit(c.scope.get(p.name.lower()) is OMITTED), "b")


@special("MAP")
def _map(c, *args):
    f = c.value(args[-1])
    return broadcast(lambda *xs: c.invoke(f, list(xs)), *[c.value(a) for a in args[:-1]])


@special("REDUCE")
def _reduce(c, init, array, f):
    acc, f = c.value(init), c.value(f)
    for v in c.value(array).flat():
        acc = c.invoke(f, [acc, v])
    return acc


@special("SCAN")
def _scan(c, init, array, f):
    acc, f, rows = c.value(init), c.value(f), []
    for r in c.value(array).rows:
        out = []
        for v in r:
            acc = c.invoke(f, [acc, v])
            out.append(acc)
        rows.append(out)
    return ArrayValue(rows)


@special("BYROW")
def _byrow(c, array, f):
    f = c.value(f)
    return ArrayValue([[c.invoke(f, [ArrayValue([r])])] for r in c.value(array).rows])


@special("BYCOL")
def _bycol(c, array, f):
    """Over a constant array, or over all number columns of the frame for `*`-like names: one aggregate each."""
    f, a = c.value(f), c.value(array)
    return ArrayValue([[c.invoke(f, [ArrayValue([[r[j]] for r in a.rows])]) for j in range(len(a.rows[0]))]])


@special("MAKEARRAY")
def _makearray(c, rows, cols, f):
    f = c.value(f)
    return ArrayValue([[c.invoke(f, [lit(i + 1), lit(j + 1)]) for j in range(int(constant(cols)))] for i in range(int(constant(rows)))])


@special("SEQUENCE")
def _sequence(c, rows, cols=Lit(1.0), start=Lit(1.0), step=Lit(1.0)):
    r, k, s, d = (constant(x) for x in (rows, cols, start, step))
    return ArrayValue([[lit(float((1 if s is None else s) + (i * int(k or 1) + j) * (1 if d is None else d))) for j in range(int(k or 1))] for i in range(int(r))])


def _shape(rows: list[list[V]]) -> ArrayValue | V:
    return ArrayValue(rows) if rows and rows[0] else error("#CALC!")


def _array(c, tree) -> ArrayValue:
    v = c.value(tree)
    return v if isinstance(v, ArrayValue) else ArrayValue([[v]])


def _optional(tree, default):
    value = default if tree is None else constant(tree)
    return default if value is None else value


@special("TRANSPOSE")
def _transpose(c, a):
    return ArrayValue([list(r) for r in zip(*_array(c, a).rows, strict=True)])


@special("TAKE")
def _take(c, a, rows=None, cols=None):
    out = _array(c, a).rows
    cut = lambda xs, n: xs[: int(n)] if n > 0 else xs[int(n) :]
    out = cut(out, _optional(rows, len(out)))
    return _shape([cut(r, _optional(cols, len(r))) for r in out])


@special("DROP")
def _drop(c, a, rows=None, cols=None):
    cut = lambda xs, n: xs[int(n) :] if n >= 0 else xs[: int(n)]
    return _shape([cut(r, _optional(cols, 0)) for r in cut(_array(c, a).rows, _optional(rows, 0))])


@special("CHOOSECOLS")
def _choosecols(c, a, *ks):
    at = [int(constant(k)) for k in ks]
    return _shape([[r[k - 1] if k > 0 else r[k] for k in at] for r in _array(c, a).rows])


@special("CHOOSEROWS")
def _chooserows(c, a, *ks):
    rows = _array(c, a).rows
    return _shape([rows[int(constant(k)) - 1] if constant(k) > 0 else rows[int(constant(k))] for k in ks])


@special("EXPAND")
def _expand(c, a, rows=None, cols=None, pad=None):
    src = _array(c, a).rows
    h, w = int(_optional(rows, len(src))), int(_optional(cols, len(src[0])))
    fill = c.value(pad) if pad is not None else error("#N/A")
    return _shape([[src[i][j] if i < len(src) and j < len(src[0]) else fill for j in range(w)] for i in range(h)])


@special("HSTACK")
def _hstack(c, *parts):
    arrays = [_array(c, p).rows for p in parts]
    h = max(map(len, arrays))
    return _shape([[v for a in arrays for v in (a[i] if i < len(a) else [error("#N/A")] * len(a[0]))] for i in range(h)])


@special("VSTACK")
def _vstack(c, *parts):
    arrays = [_array(c, p).rows for p in parts]
    w = max(len(a[0]) for a in arrays)
    return _shape([r + [error("#N/A")] * (w - len(r)) for a in arrays for r in a])


@special("TOCOL")
def _tocol(c, a, ignore=None, by_column=None):
    rows = _array(c, a).rows
    flat = [r[j] for j in range(len(rows[0])) for r in rows] if _optional(by_column, False) else [v for r in rows for v in r]
    return _shape([[v] for v in flat])


@special("TOROW")
def _torow(c, a, ignore=None, by_column=None):
    return _shape([[r[0] for r in _tocol(c, a, ignore, by_column).rows]])


@special("WRAPROWS")
def _wraprows(c, a, n, pad=None):
    flat, k = _array(c, a).flat(), int(constant(n))
    fill = c.value(pad) if pad is not None else error("#N/A")
    flat += [fill] * (-len(flat) % k)
    return _shape([flat[i : i + k] for i in range(0, len(flat), k)])


@special("WRAPCOLS")
def _wrapcols(c, a, n, pad=None):
    return _shape([list(r) for r in zip(*_wraprows(c, a, n, pad).rows, strict=True)])


@special("MUNIT")
def _munit(c, n):
    k = int(constant(n))
    return _shape([[lit(float(i == j)) for j in range(k)] for i in range(k)])


@special("MMULT")
def _mmult(c, a, b):
    x, y = _array(c, a).rows, _array(c, b).rows
    if len(x[0]) != len(y):
        return error("#VALUE!")
    product = lambda i, j: sum((number(x[i][k]).v * number(y[k][j]).v for k in range(len(y))), F.lit(0.0))
    return _shape([[V(product(i, j)) for j in range(len(y[0]))] for i in range(len(x))])


@special("ROWS")
def _rows(c, a):
    v = c.value(a)
    return lit(len(v.rows)) if isinstance(v, ArrayValue) else V(F.count(F.lit(1)).cast("double")) if v.source else lit(1)


@special("COLUMNS")
def _columns(c, a):
    v = c.value(a)
    return lit(len(v.rows[0]) if isinstance(v, ArrayValue) else 1)


@special("COLUMN")
def _column(c, a=None):
    if isinstance(a, Ref):
        return lit(a.left or 1)
    return lit([f.name.lower() for f in c.df.schema.fields].index(a.name.lower()) + 1) if isinstance(a, Name) and a.name.lower() in c.names else error("#VALUE!")


@special("ROW")
def _row(c, a=None):
    if isinstance(a, Ref) and a.top:
        return lit(a.top)
    return V(F.col("row_id").cast("double") + 1) if "row_id" in c.names else error("#VALUE!")


@special("SHEET")
def _sheet(c, a=None):
    names = list(c.tables)
    return lit(names.index(a.sheet) + 1 if isinstance(a, Ref) and a.sheet in names else 1)


@special("SHEETS")
def _sheets(c, a=None):
    return lit(1 if a is not None else max(1, len(c.tables)))


@special("CELL")
def _cell(c, what, a=None):
    kind = str(constant(what)).lower()
    if kind == "col":
        return _column(c, a)
    if kind == "row":
        return _row(c, a)
    v = c.value(a) if a is not None else error("#VALUE!")
    if kind == "contents":
        return v
    if kind == "type":
        return V(F.when(v.v.isNull(), F.lit("b")).otherwise(F.lit("l" if v.t == "t" else "v")), "t", v.e)
    if kind == "address" and isinstance(a, Ref):
        return apply("ADDRESS", float(a.top), float(a.left))
    return error("#VALUE!", "t")


@special("INDEX")
def _index(c, a, row, col=None):
    """Of a constant array; an index may be a column."""
    rows = _array(c, a).rows
    if isinstance(row, Lit) and row.value and (col is None or (isinstance(col, Lit) and col.value)) and (len(rows[0]) == 1 or col is not None):
        i, j = int(row.value), int(col.value) if col is not None else 1
        return rows[i - 1][j - 1] if i <= len(rows) and j <= len(rows[0]) else error("#REF!")
    if col is None and len(rows) == 1:
        return _choose_at(c.value(row), rows[0])
    r = c.value(row)
    k = c.value(col) if col is not None else lit(1)
    return _choose_at(r, [_choose_at(k, x) for x in rows])


def _choose_at(i: V, values: list[V]) -> V:
    out = apply("CHOOSE", i, *values)
    return V(out.v, out.t, F.when(out.err() == "#VALUE!", F.lit("#REF!")).otherwise(out.err()))


def _search(c, needle, array, mode: int, last: bool = False) -> tuple[V, list[V], Column]:
    """Place of the needle in a constant vector: exact (0), largest not above (1), smallest not below (-1)."""
    n, values = c.value(needle), _array(c, array).flat()
    hits = [equal(n, v) if mode == 0 else compare("<=" if mode == 1 else ">=", v, n).v for v in values]
    order = list(enumerate(zip(hits, values, strict=True)))
    at = F.lit(None).cast("int")
    if mode == 0:
        for i, (h, _) in order if last else reversed(order):
            at = F.when(h, F.lit(i + 1)).otherwise(at)
        return n, values, at
    best = F.array(*[F.when(h, F.struct(number(v).v.alias("v") if n.t in "nd" else F.lower(text(v).v).alias("v"), F.lit(i + 1 if mode == 1 else -(i + 1)).alias("i"))) for i, (h, v) in order])
    kept = F.filter(best, lambda x: x.isNotNull())
    top = F.array_max(kept) if mode == 1 else F.array_min(kept)
    return n, values, F.abs(top["i"]).cast("int")


def _placed(n: V, at: Column) -> V:
    return V(at.cast("double"), "n", first_error(n.e, F.when(at.isNull(), F.lit("#N/A"))))


@special("MATCH")
def _match(c, needle, array, mode=Lit(1.0)):
    n, _, at = _search(c, needle, array, int(_optional(mode, 1)))
    return _placed(n, at)


@special("XMATCH")
def _xmatch(c, needle, array, mode=Lit(0.0), search=Lit(1.0)):
    n, _, at = _search(c, needle, array, -int(_optional(mode, 0)), _optional(search, 1) == -1)
    return _placed(n, at)


def _returned(n: V, at: Column, values: list[V], missing: V | None) -> V:
    out = apply("CHOOSE", V(at.cast("double")), *values)
    miss = missing or error("#N/A", out.t)
    (x, y), t = same_type([out, miss])
    return V(F.when(at.isNull(), y.v).otherwise(x.v), t, first_error(n.e, F.when(at.isNull(), y.err()).otherwise(x.err())))


@special("XLOOKUP")
def _xlookup(c, needle, look, result, missing=None, mode=Lit(0.0), search=Lit(1.0)):
    """In constant vectors; lookups into tables are joins, see `operators.lookup`."""
    n, _, at = _search(c, needle, look, -int(_optional(mode, 0)), _optional(search, 1) == -1)
    return _returned(n, at, _array(c, result).flat(), c.value(missing) if missing is not None and missing != Lit(None) else None)


@special("VLOOKUP")
def _vlookup(c, needle, table, col, approximate=Lit(True)):
    rows = _array(c, table).rows
    n, _, at = _search(c, needle, ArrayValue([[r[0]] for r in rows]), 1 if _optional(approximate, True) else 0)
    return _returned(n, at, [r[int(constant(col)) - 1] for r in rows], None)


@special("HLOOKUP")
def _hlookup(c, needle, table, row, approximate=Lit(True)):
    rows = _array(c, table).rows
    n, _, at = _search(c, needle, ArrayValue([rows[0]]), 1 if _optional(approximate, True) else 0)
    return _returned(n, at, rows[int(constant(row)) - 1], None)


@special("LOOKUP")
def _lookup(c, needle, look, result=None):
    n, values, at = _search(c, needle, look, 1)
    return _returned(n, at, _array(c, result).flat() if result is not None else values, None)


@special("FILTER")
def _filter(c, array, include, if_empty=None):
    """Rows of a constant array by a constant mask; frames are filtered by `operators.relational.filter_rows`."""
    rows, mask = _array(c, array).rows, [x.value for r in include.rows for x in r] if isinstance(include, Array) else None
    if mask is None:
        raise FormulaError("FILTER over columns is a frame operation: use filter_rows")
    kept = [r for r, m in zip(rows, mask, strict=True) if m]
    return ArrayValue(kept) if kept else (c.value(if_empty) if if_empty is not None else error("#CALC!"))


def _numbers(c, tree) -> Column:
    """The numbers of a constant array, as an array column."""
    return F.filter(F.array(*[v.v if v.t == "n" else F.lit(None).cast("double") for v in _array(c, tree).flat()]), lambda x: x.isNotNull())


def _frame_only(name: str, where: str):
    def build(c, *args):
        raise FormulaError(f"{name} over a column is a frame operation: use {where}")

    return build


def _rank(average: bool):
    def build(c, x, ref, order=Lit(0.0)):
        if not isinstance(c.value(ref), ArrayValue):
            raise FormulaError("a rank over a column is a frame operation: use operators.ranking.rank")
        n, xs = number(c.value(x)), _numbers(c, ref)
        up = bool(_optional(order, 0))
        before = F.size(F.filter(xs, lambda y: (y < n.v) if up else (y > n.v)))
        same = F.size(F.filter(xs, lambda y: y == n.v))
        return V((before + ((same + 1) / 2 if average else F.lit(1))).cast("double"), "n", first_error(n.e, F.when(same == 0, F.lit("#N/A"))))

    return build


special("RANK.EQ", "RANK")(_rank(False))
special("RANK.AVG")(_rank(True))


def _percentrank(exclusive: bool):
    def build(c, array, x, digits=Lit(3.0)):
        """Interpolated between neighbours, truncated to `digits`."""
        if not isinstance(c.value(array), ArrayValue):
            raise FormulaError("a percent rank over a column is a frame operation: use operators.ranking.percent_rank")
        xs, n, d = F.sort_array(_numbers(c, array)), number(c.value(x)), _optional(digits, 3)
        size = F.size(xs)
        below = F.size(F.filter(xs, lambda y: y < n.v))
        hit = F.array_contains(xs, n.v)
        a, b = F.try_element_at(xs, F.greatest(below, F.lit(1))), F.try_element_at(xs, F.least(below + 1, size))
        place = F.when(hit, below.cast("double")).otherwise(below - 1 + F.try_divide(n.v - a, b - a))
        share = (place + 1) / (size + 1) if exclusive else F.when(size == 1, F.lit(1.0)).otherwise(place / F.nullif(size - 1, F.lit(0)))
        out = F.floor(share * 10.0 ** int(d) + 1e-9) / 10.0 ** int(d)
        return V(out, "n", first_error(n.e, F.when((n.v < F.array_min(xs)) | (n.v > F.array_max(xs)) | (size == 0), F.lit("#N/A"))))

    return build


special("PERCENTRANK.INC", "PERCENTRANK")(_percentrank(False))
special("PERCENTRANK.EXC")(_percentrank(True))


@special("IRR")
def _irr(c, flows, guess=Lit(0.1)):
    return _solved(c, flows, None, _optional(guess, 0.1))


@special("XIRR")
def _xirr(c, flows, dates, guess=Lit(0.1)):
    return _solved(c, flows, dates, _optional(guess, 0.1))


def _solved(c, flows, dates, guess) -> V:
    @F.pandas_udf(DoubleType())
    def solve(v: pd.Series, t: pd.Series) -> pd.Series:
        out = [xirr(np.asarray(a, float), np.asarray(b, float), guess) for a, b in zip(v, t, strict=True)]
        return pd.Series(out, dtype=object).where(~np.isnan(np.array(out, float)), None)

    xs = _numbers(c, flows)
    times = F.transform(_numbers(c, dates), lambda d: (d - F.element_at(_numbers(c, dates), 1)) / 365) if dates is not None else F.transform(xs, lambda _, i: i.cast("double"))
    r = solve(xs, times)
    return V(r, "n", F.when(r.isNull(), F.lit("#NUM!")))


@special("MIRR")
def _mirr(c, flows, finance, reinvest):
    xs, f, r = _numbers(c, flows), number(c.value(finance)), number(c.value(reinvest))
    n = F.size(xs)
    part = lambda rate, sign, power: F.aggregate(F.transform(xs, lambda x, i: F.when(x * sign > 0, x * sign * F.pow(1 + rate, power(i))).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    gains, costs = part(r.v, 1.0, lambda i: n - 1 - i), part(f.v, -1.0, lambda i: -i)
    return V(F.pow(F.try_divide(gains, costs), F.try_divide(F.lit(1.0), n - 1)) - 1, "n", F.when((gains == 0) | (costs == 0) | (n < 2), F.lit("#DIV/0!")))


@special("FREQUENCY")
def _frequency(c, data, bins):
    if not isinstance(c.value(data), ArrayValue):
        raise FormulaError("FREQUENCY over a column is a frame operation: use operators.relational.frequency")
    xs, edges = _numbers(c, data), [number(v).v for v in _array(c, bins).flat()]
    lows = [F.lit(float("-inf")), *edges]
    return _shape([[V(F.size(F.filter(xs, _between(a, b))).cast("double"))] for a, b in zip(lows, edges, strict=False)] + [[V(F.size(F.filter(xs, _between(edges[-1], None))).cast("double"))]])


def _between(a: Column, b: Column | None):
    return (lambda x: x > a) if b is None else (lambda x: (x > a) & (x <= b))


def _sorted_rows(rows: list, keys: list, ways: list) -> list:
    if not all(isinstance(k, Lit) for col in keys for k in col):
        raise FormulaError("SORT over columns is a frame operation: use operators.relational.sort_by")
    rank = lambda x: (0, x, "") if isinstance(x, float) else (1, 0, x.lower()) if isinstance(x, str) else (2, int(x), "") if isinstance(x, bool) else (3, 0, "")
    order = list(range(len(rows)))
    for col, way in reversed(list(zip(keys, ways, strict=True))):
        order.sort(key=lambda i, col=col: rank(col[i].value), reverse=way < 0)
    return [rows[i] for i in order]


@special("SORT")
def _sort(c, array, index=Lit(1.0), order=Lit(1.0), by_col=None):
    rows = list(array.rows) if isinstance(array, Array) else None
    if rows is None:
        raise FormulaError("SORT over columns is a frame operation: use operators.relational.sort_by")
    k = int(_optional(index, 1)) - 1
    return _shape([[c.value(x) for x in r] for r in _sorted_rows(rows, [[r[k] for r in rows]], [_optional(order, 1)])])


@special("SORTBY")
def _sortby(c, array, *by):
    if not isinstance(array, Array) or not all(isinstance(b, Array) for b in by[::2]):
        raise FormulaError("SORTBY over columns is a frame operation: use operators.relational.sort_by")
    keys = [[x for r in b.rows for x in r] for b in by[::2]]
    ways = [_optional(w, 1) for w in by[1::2]]
    ways += [1] * (len(keys) - len(ways))
    return _shape([[c.value(x) for x in r] for r in _sorted_rows(list(array.rows), keys, ways)])


@special("UNIQUE")
def _unique(c, array, by_col=None, once=None):
    if not isinstance(array, Array):
        raise FormulaError("UNIQUE over columns is a frame operation: use operators.relational.unique")
    key = lambda r: tuple(x.value.lower() if isinstance(getattr(x, "value", None), str) else getattr(x, "value", x) for x in r)
    keys = [key(r) for r in array.rows]
    kept = [r for i, r in enumerate(array.rows) if (keys.count(keys[i]) == 1 if _optional(once, False) else keys.index(keys[i]) == i)]
    return _shape([[c.value(x) for x in r] for r in kept])


@special("RANDARRAY")
def _randarray(c, rows=Lit(1.0), cols=Lit(1.0), low=Lit(0.0), high=Lit(1.0), whole=Lit(False)):
    a, b, w = _optional(low, 0.0), _optional(high, 1.0), _optional(whole, False)
    one = lambda: V((F.floor(F.rand() * (b - a + 1)) + a if w else F.rand() * (b - a) + a).cast("double"))
    return _shape([[one() for _ in range(int(_optional(cols, 1)))] for _ in range(int(_optional(rows, 1)))])


@special("TEXTSPLIT")
def _textsplit(c, t, col, row=None, ignore=None, mode=None, pad=None):
    """Of a constant text; columns are split by operators.relational.text_split."""
    s, rows = constant(t), [constant(t)]
    if row is not None and constant(row) is not None:
        rows = s.split(constant(row))
    cells = [r.split(constant(col)) if constant(col) else [r] for r in rows]
    if _optional(ignore, False):
        cells = [[x for x in r if x] for r in cells]
    w = max(map(len, cells))
    fill = c.value(pad) if pad is not None else error("#N/A", "t")
    return _shape([[lit(x) for x in r] + [fill] * (w - len(r)) for r in cells])


@special("INDIRECT")
def _indirect(c, t, a1=None):
    """A reference or column name from constant text."""
    try:
        return c.value(parse(str(constant(t))))
    except FormulaError:
        return error("#REF!")


@special("OFFSET")
def _offset(c, ref, rows, cols, height=None, width=None):
    """Constant shifts of a grid reference; over columns use operators.ranking.shifted and moving."""
    if not isinstance(ref, Ref) or c.grid is None:
        raise FormulaError("OFFSET over a column is a frame operation: use operators.ranking.shifted or moving")
    r, k = int(constant(rows)), int(constant(cols))
    h, w = int(_optional(height, ref.bottom - ref.top + 1)), int(_optional(width, ref.right - ref.left + 1))
    top, left = ref.top + r, ref.left + k
    return error("#REF!") if top < 1 or left < 1 else c.value(Ref(top, left, top + h - 1, left + w - 1))


@special("MODE.MULT")
def _mode_mult(c, array):
    if not isinstance(c.value(array), ArrayValue):
        raise FormulaError("MODE.MULT over a column is a frame operation: use operators.ranking.modes")
    xs = _numbers(c, array)
    times = lambda x: F.size(F.filter(xs, lambda y: y == x))
    most = F.array_max(F.transform(xs, times))
    return V(F.sort_array(F.array_distinct(F.filter(xs, lambda x: (times(x) == most) & (most > 1)))), "a", F.when(most < 2, F.lit("#N/A")))


def _linear(name: str):
    return _frame_only(name, "operators.models.linest, trend")


for _name in ("LINEST", "LOGEST", "TREND", "GROWTH"):
    SPECIAL[_name] = _linear(_name)


def _numeric_matrix(c, tree):
    if not isinstance(tree, Array):
        raise FormulaError("a matrix of columns is a frame operation: use operators.models.matrix_inverse")
    return np.array([[x.value for x in r] for r in tree.rows], float)


@special("MDETERM")
def _mdeterm(c, a):
    m = _numeric_matrix(c, a)
    return lit(float(np.linalg.det(m))) if m.shape[0] == m.shape[1] else error("#VALUE!")


@special("MINVERSE")
def _minverse(c, a):
    m = _numeric_matrix(c, a)
    if m.shape[0] != m.shape[1]:
        return error("#VALUE!")
    return error("#NUM!") if abs(np.linalg.det(m)) < 1e-300 else _shape([[lit(float(x)) for x in r] for r in np.linalg.inv(m)])


def row(df: DataFrame, formula: str, tables: dict[str, DataFrame] | None = None) -> V:
    """The formula's value for each row of `df`."""
    out = Compiler(df, tables).value(parse(formula))
    return to_array(out) if isinstance(out, ArrayValue) else out


def to_array(a: ArrayValue) -> V:
    """A constant array as an array of arrays; errors are null in it."""
    values, t = same_type(a.flat())
    w = len(a.rows[0])
    rows = [F.array(*[v.sql() for v in values[i : i + w]]) for i in range(0, len(values), w)]
    return V(F.array(*rows), "a")


def with_formulas(df: DataFrame, **formulas: str) -> DataFrame:
    """`df` with a column for each formula, errors as null; all in one projection."""
    return df.select("*", *[row(df, f).sql().alias(n) for n, f in formulas.items()])


def aggregate(df: DataFrame, by: list[str] | None = None, **formulas: str) -> DataFrame:
    """A column for each formula over all rows, or over each group of `by`; all in one aggregation."""
    cols = [row(df, f).sql().alias(n) for n, f in formulas.items()]
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


def cells_of(context: dict[str, object]) -> dict[tuple[int, int], object]:
    """A1 names and values as (row, column) cells."""
    refs = {reference(k): v for k, v in context.items()}
    return {(r.top, r.left): float(v) if isinstance(v, int) and not isinstance(v, bool) else v for r, v in refs.items()}


def evaluate(spark, formula: str, context: dict[str, object] | None = None):
    """A formula over constant cells (A1 name -> value): its value, or its error code; an array as nested lists."""
    v = Compiler(spark.range(1).select(F.lit(1).alias("_one")), grid=cells_of(context or {})).value(parse(formula))
    v = to_array(v) if isinstance(v, ArrayValue) else number(v) if v.t == "d" else v
    got = spark.range(1).select(v.struct().alias("r")).first()["r"]
    return got["e"] if got["e"] is not None else got["v"]
