"""Worksheet values as pairs of Catalyst expressions, and the function registry.

A value is a column plus an error column (null: no error), so errors are data that
flow through whole-stage code, and no row ever raises. Static types: "n" number,
"t" text, "b" boolean, "d" date, "a" array, "z" complex (a struct of re and im).
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Error codes and their numbers (fixed values).
ERRORS = {"#NULL!": 1, "#DIV/0!": 2, "#VALUE!": 3, "#REF!": 4, "#NAME?": 5, "#NUM!": 6, "#N/A": 7, "#GETTING_DATA": 8, "#SPILL!": 9, "#CONNECT!": 10, "#BLOCKED!": 11, "#CALC!": 14}

EPOCH = "1899-12-30"  # serial 0 for every date after February 1900


@dataclass(frozen=True)
class V:
    """A worksheet value: column, type, error column (None where no error can arise), and whether it is a range."""

    v: Column
    t: str = "n"
    e: Column | None = None
    ranged: bool = False  # a column of values to aggregate, not one value
    source: str | None = None  # the column's name if it is a bare reference

    def struct(self) -> Column:
        return F.struct(F.when(self.err().isNull(), self.v).alias("v"), self.err().alias("e"))

    def sql(self) -> Column:
        """The value with errors as null."""
        return self.v if self.e is None else F.when(self.e.isNull(), self.v)

    def err(self) -> Column:
        return F.lit(None).cast("string") if self.e is None else self.e


def first_error(*errors: Column | None) -> Column | None:
    some = [e for e in errors if e is not None]
    return None if not some else some[0] if len(some) == 1 else F.coalesce(*some)


def lit(x) -> V:
    if isinstance(x, V):
        return x
    if x is None:
        return V(F.lit(None).cast("double"), "n")
    if isinstance(x, bool):
        return V(F.lit(x), "b")
    if isinstance(x, (int, float)):
        return V(F.lit(float(x)), "n")
    return V(F.lit(x), "t")


def error(code: str, t: str = "n") -> V:
    return V(F.lit(None).cast({"n": "double", "t": "string", "b": "boolean", "d": "date"}.get(t, "double")), t, F.lit(code))


def serial(d: Column) -> Column:
    return F.date_diff(d.cast("date"), F.lit(EPOCH).cast("date")).cast("double")


def from_serial(n: Column) -> Column:
    return F.date_add(F.lit(EPOCH).cast("date"), F.floor(n).cast("int"))


def general(n: Column) -> Column:
    """A number as text in General format: integers without a point, others with up to 15 significant digits."""
    whole = (F.floor(n) == n) & (F.abs(n) < 1e15)
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.15f", snap(n)), "0+$", ""), r"\.$", "")
    small = F.abs(n) < 1e-5
    sci = F.regexp_replace(F.regexp_replace(F.format_string("%.14E", n), r"\.?0+E", "E"), r"^([^.E]*)E", "$1E")
    digits = F.greatest(F.lit(0), 14 - F.floor(F.log10(F.abs(n))).cast("int"))
    short = F.regexp_replace(F.regexp_replace(F.bround(n.cast("decimal(38,18)"), 15).cast("string"), "0+$", ""), r"\.$", "")
    return F.when(n.isNull(), F.lit(None)).when(whole, n.cast("decimal(38,0)").cast("string")).when(small | (F.abs(n) >= 1e15), sci).when(digits > 15, short).otherwise(plain)


def snap(n: Column) -> Column:
    """`n` at 15 significant digits, which undoes the last bits of binary arithmetic."""
    e = F.floor(F.log10(F.abs(n)))
    up, down = F.pow(F.lit(10.0), 14 - e), F.pow(F.lit(10.0), e - 14)
    return F.when(n.isNull() | (n == 0) | (F.abs(n) < 1e-280), n).when(e <= 14, F.rint(n * up) / up).otherwise(F.rint(n / down) * down)


def number(x: V) -> V:
    """Coerced to a number; text that is no number is #VALUE!, a blank is 0 only where a function says so."""
    if x.t == "n":
        return x
    if x.t == "b":
        return V(x.v.cast("double"), "n", x.e, x.ranged, x.source)
    if x.t == "d":
        return V(serial(x.v), "n", x.e, x.ranged, x.source)
    if x.t == "t":
        n = F.trim(x.v).try_cast("double")
        pct = F.when(F.trim(x.v).rlike(r"^[-+]?[0-9.]+%$"), F.regexp_replace(F.trim(x.v), "%$", "").try_cast("double") / 100)
        n = F.coalesce(pct, n)
        return V(n, "n", first_error(x.e, F.when(x.v.isNotNull() & n.isNull(), F.lit("#VALUE!"))), x.ranged, x.source)
    return error("#VALUE!")


def text(x: V) -> V:
    if x.t == "t":
        return x
    if x.t == "b":
        return V(F.when(x.v, "TRUE").when(~x.v, "FALSE"), "t", x.e, x.ranged, x.source)
    n = number(x)
    return V(general(n.v), "t", n.e, x.ranged, x.source)


def boolean(x: V) -> V:
    if x.t == "b":
        return x
    if x.t == "t":
        low = F.lower(F.trim(x.v))
        return V(F.when(low == "true", True).when(low == "false", False), "b", first_error(x.e, F.when(x.v.isNotNull() & ~low.isin("true", "false"), F.lit("#VALUE!"))), x.ranged, x.source)
    n = number(x)
    return V(n.v != 0, "b", n.e, x.ranged, x.source)


def date(x: V) -> V:
    """Coerced to a date; numbers are serials, negative ones #NUM!."""
    if x.t == "d":
        return V(x.v.cast("date"), "d", x.e, x.ranged, x.source)
    if x.t == "t":
        d = F.coalesce(F.try_to_date(x.v, F.lit("yyyy-M-d")), F.try_to_date(x.v, F.lit("yyyy/M/d"))) if hasattr(F, "try_to_date") else F.coalesce(F.to_date(F.try_to_timestamp(x.v, F.lit("yyyy-M-d"))), F.to_date(F.try_to_timestamp(x.v, F.lit("yyyy/M/d"))))
        return V(d, "d", first_error(x.e, F.when(x.v.isNotNull() & d.isNull(), F.lit("#VALUE!"))), x.ranged, x.source)
    n = number(x)
    return V(from_serial(n.v), "d", first_error(n.e, F.when(n.v < 0, F.lit("#NUM!"))), x.ranged, x.source)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once however often the body names it; keeps expressions from growing exponentially."""
    return F.element_at(F.transform(F.array(value), body), 1)


COERCE = {"n": number, "t": text, "b": boolean, "d": date, "*": lambda x: x}


@dataclass
class Spec:
    """A registered function. kind: scalar (columns in, column out), aggregate (over rows), or plan (sees its parsed arguments)."""

    name: str
    kind: str
    build: Callable
    takes: str = ""
    gives: str = "n"
    least: int = 0
    most: int | None = None
    volatile: bool = False
    about: str = ""
    defaults: tuple = field(default_factory=tuple)


REGISTRY: dict[str, Spec] = {}


def register(names: str, kind: str, takes: str = "", gives: str = "n", least: int | None = None, most: int | None = -1, defaults: tuple = (), volatile: bool = False):
    """Decorator. names: the function and its aliases; takes: a type letter for each argument, the last repeating if it ends in "+"."""

    def wrap(build: Callable) -> Callable:
        fixed = takes.rstrip("+")
        lo = least if least is not None else len(fixed) - len(defaults)
        hi = None if takes.endswith("+") else (len(fixed) if most == -1 else most)
        for name in names.split():
            REGISTRY[name] = Spec(name, kind, build, takes, gives, lo, hi, volatile, (build.__doc__ or "").strip(), defaults)
        return build

    return wrap


def scalar(names: str, takes: str = "n", gives: str = "n", defaults: tuple = (), least: int | None = None, volatile: bool = False):
    """A function of columns. It returns a column, or a column and (condition, code) pairs; a number that is not finite is #NUM!."""
    return register(names, "scalar", takes, gives, least, defaults=defaults, volatile=volatile)


def aggregate(names: str, takes: str = "n", gives: str = "n", defaults: tuple = (), least: int | None = None):
    """A function of rows: it gets the columns of a group and returns an aggregate column, or one and (condition, code) pairs."""
    return register(names, "aggregate", takes, gives, least, defaults=defaults)


#: Functions that give finite numbers for finite arguments, so that no test for overflow is needed.
FINITE = set("ABS INT SIGN MOD QUOTIENT ROUND ROUNDUP ROUNDDOWN TRUNC MROUND EVEN ODD CEILING FLOOR CEILING.MATH FLOOR.MATH CEILING.PRECISE ISO.CEILING FLOOR.PRECISE SIN COS ATAN ATAN2 ASIN ACOS ACOT TANH SQRT SQRTPI LN LOG10 DEGREES RADIANS YEAR MONTH DAY WEEKDAY WEEKNUM ISOWEEKNUM DAYS DAYS360 DATEDIF YEARFRAC TIME LEN LENB FIND FINDB SEARCH SEARCHB CODE UNICODE BITAND BITOR BITXOR DELTA GESTEP BIN2DEC OCT2DEC HEX2DEC".split())


def finish(result, args: list[V], gives: str, finite: bool = False) -> V:
    checks: list = []
    if isinstance(result, tuple):
        result, checks = result[0], list(result[1:])
    if isinstance(result, V):  # such functions see whole values and decide themselves which errors count
        return V(result.v, result.t, first_error(*[F.when(c, F.lit(code)) for c, code in checks], result.e))
    own = None
    for cond, code in reversed(checks):
        own = F.when(cond, F.lit(code)).otherwise(own) if own is not None else F.when(cond, F.lit(code))
    wild = F.when(F.isnan(result) | (F.abs(result) == float("inf")), F.lit("#NUM!")) if gives == "n" and not finite else None
    return V(result, gives, first_error(*[a.e for a in args], own, wild))


def apply(name: str, *args) -> V:
    """The value of function `name` of V or plain Python arguments; a wrong count of arguments is #VALUE!."""
    spec = REGISTRY.get(name.upper())
    if spec is None:
        return error("#NAME?")
    given = [lit(a) for a in args]
    if len(given) < spec.least or (spec.most is not None and len(given) > spec.most):
        return error("#VALUE!")
    letters = spec.takes.rstrip("+")
    if spec.takes.endswith("+"):
        letters += letters[-1] * max(0, len(given) - len(letters))
    else:
        missing = len(letters) - len(given)
        given += [lit(d) for d in spec.defaults[len(spec.defaults) - missing :]] if missing > 0 else []
    ready = [COERCE[k](a) for k, a in zip(letters, given, strict=False)]
    if spec.kind == "aggregate":
        return _aggregated(spec, ready)
    if "V" in spec.gives:
        return finish(spec.build(*ready), ready, spec.gives)
    return finish(spec.build(*[a.v for a in ready]), ready, spec.gives, spec.name in FINITE)


def _aggregated(spec: Spec, args: list[V]) -> V:
    """In ranges, values that could not be coerced are left out; errors of the cells themselves are passed on by the first."""
    result = finish(spec.build(*[a.v if a.e is None else F.when(a.e.isNull(), a.v) for a in args]), [], spec.gives)
    return result


def call(name: str):
    """`call("SQRT")(column)`: the function as a plain column function with errors as null; types follow the declared ones."""

    @functools.wraps(apply)
    def run(*args) -> Column:
        spec = REGISTRY[name]
        letters = spec.takes.rstrip("+")
        kind = lambda i: (letters[min(i, len(letters) - 1)] if letters else "n").replace("*", "n")
        return apply(name, *[V(a, kind(i)) if isinstance(a, Column) else a for i, a in enumerate(args)]).sql()

    return run
