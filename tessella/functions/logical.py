"""Logic, error handling and type tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .core import ERRORS, V, boolean, error, first_error, number, register, scalar, text


def same_type(values: list[V]) -> tuple[list[V], str]:
    kinds = {v.t for v in values}
    if len(kinds) == 1:
        return values, values[0].t
    if kinds <= {"n", "b"}:
        return [number(v) for v in values], "n"
    if kinds <= {"n", "d"}:
        return [number(v) for v in values], "n"
    return [text(v) for v in values], "t"


def choose(cond: V, a: V, b: V) -> V:
    (x, y), t = same_type([a, b])
    c = F.coalesce(cond.v, F.lit(False))
    none = F.lit(None).cast("string")
    e = None
    if cond.e is not None or x.e is not None or y.e is not None:
        e = F.when(cond.err().isNotNull(), cond.err()).when(c, x.e if x.e is not None else none).otherwise(y.e if y.e is not None else none)
    return V(F.when(c, x.v).otherwise(y.v), t, e)


@register("IF", "scalar", "***", "V", least=2, defaults=(False,))
def _if(cond, a, b):
    return choose(error("#VALUE!", "b") if cond.t == "t" else boolean(cond), a, b)


@register("IFS", "scalar", "*+", "V", least=2)
def _ifs(*args):
    out = error("#N/A", args[1].t)
    for c, v in reversed(list(zip(args[::2], args[1::2], strict=True))):
        out = choose(boolean(c), v, out)
    return out


def equal(a: V, b: V):
    """Equality of the worksheet: text without case, different types never equal."""
    if {a.t, b.t} <= {"n", "d"}:
        return number(a).v == number(b).v
    if a.t == b.t == "t":
        return F.lower(a.v) == F.lower(b.v)
    return a.v == b.v if a.t == b.t else F.lit(False)


@register("SWITCH", "scalar", "*+", "V", least=3)
def _switch(e, *rest):
    pairs = list(zip(rest[::2], rest[1::2], strict=False))
    out = rest[-1] if len(rest) % 2 else error("#N/A", pairs[0][1].t)
    for k, v in reversed(pairs):
        out = choose(V(equal(e, k), "b", first_error(e.e, k.e)), v, out)
    return out


def _caught(v: V, alt: V, when) -> V:
    if v.e is None:
        return v
    (x, y), t = same_type([v, alt])
    hit = when(v.e)
    return V(F.when(hit, y.v).otherwise(x.v), t, F.when(hit, y.err()).otherwise(v.e))


@register("IFERROR", "scalar", "**", "V")
def _iferror(v, alt):
    return _caught(v, alt, lambda e: e.isNotNull())


@register("IFNA", "scalar", "**", "V")
def _ifna(v, alt):
    return _caught(v, alt, lambda e: e.eqNullSafe(F.lit("#N/A")))


@scalar("AND", "b+", "b", least=1)
def _and(*c):
    return reduce(lambda a, b: a & b, c)


@scalar("OR", "b+", "b", least=1)
def _or(*c):
    return reduce(lambda a, b: a | b, c)


@scalar("XOR", "b+", "b", least=1)
def _xor(*c):
    return sum((x.cast("int") for x in c), F.lit(0)) % 2 == 1


@scalar("NOT", "b", "b")
def _not(c):
    return ~c


@scalar("TRUE", "", "b", least=0)
def _true():
    return F.lit(True)


@scalar("FALSE", "", "b", least=0)
def _false():
    return F.lit(False)


@register("NA", "scalar", "", "V", least=0)
def _na():
    return error("#N/A")


def _test(name: str, f):
    register(name, "scalar", "*", "V")(lambda v: V(f(v), "b"))


_none = lambda v: v.e.isNull() if v.e is not None else F.lit(True)
_test("ISBLANK", lambda v: v.v.isNull() & _none(v))
_test("ISNUMBER", lambda v: (v.v.isNotNull() & _none(v)) if v.t in "nd" else F.lit(False))
_test("ISTEXT", lambda v: (v.v.isNotNull() & _none(v)) if v.t == "t" else F.lit(False))
_test("ISNONTEXT", lambda v: ~(v.v.isNotNull() & _none(v)) if v.t == "t" else F.lit(True))
_test("ISLOGICAL", lambda v: (v.v.isNotNull() & _none(v)) if v.t == "b" else F.lit(False))
_test("ISERROR", lambda v: v.err().isNotNull())
_test("ISERR", lambda v: v.err().isNotNull() & ~v.err().eqNullSafe(F.lit("#N/A")))
_test("ISNA", lambda v: v.err().eqNullSafe(F.lit("#N/A")))
_test("ISREF", lambda v: F.lit(v.source is not None))
_test("ISFORMULA", lambda v: F.lit(False))


@scalar("ISEVEN", "n", "b")
def _iseven(n):
    return F.floor(F.abs(n)) % 2 == 0


@scalar("ISODD", "n", "b")
def _isodd(n):
    return F.floor(F.abs(n)) % 2 == 1


@register("N", "scalar", "*", "V")
def _n(v):
    return V(F.lit(0.0)) if v.t == "t" else number(v)


@register("T", "scalar", "*", "V")
def _t(v):
    return v if v.t == "t" else V(F.lit(""), "t", v.e)


@register("TYPE", "scalar", "*", "V")
def _type(v):
    code = {"n": 1, "d": 1, "t": 2, "b": 4, "a": 64}[v.t]
    return V(F.when(v.err().isNotNull(), F.lit(16.0)).otherwise(F.lit(float(code))))


@register("ERROR.TYPE", "scalar", "*", "V")
def _error_type(v):
    n = F.coalesce(*[F.when(v.err() == k, F.lit(float(c))) for k, c in ERRORS.items()])
    return V(n, "n", F.when(v.err().isNull(), F.lit("#N/A")))


@register("CHOOSE", "scalar", "*+", "V", least=2)
def _choose(i, *rest):
    n = number(i)
    values, t = same_type(list(rest))
    at = F.floor(n.v)
    v, e = values[0].v, values[0].err()
    for k, x in enumerate(values[1:], 2):
        v, e = F.when(at == k, x.v).otherwise(v), F.when(at == k, x.err()).otherwise(e)
    return V(v, t, first_error(n.e, F.when((at < 1) | (at > len(values)), F.lit("#VALUE!")), e))


@register("HYPERLINK", "scalar", "**", "V", least=1, defaults=("",))
def _hyperlink(url, name):
    return name if name.source or name.t != "t" else V(F.when(name.v == "", url.v).otherwise(name.v), "t", first_error(url.e, name.e))


@register("IMAGE", "scalar", "*+", "V", least=1)
def _image(*_):
    """Pictures are no values."""
    return error("#VALUE!", "t")


@register("FORMULATEXT", "scalar", "*", "V")
def _formulatext(v):
    return error("#N/A" if v.source else "#VALUE!", "t")


@register("AREAS", "scalar", "*", "V")
def _areas(v):
    return V(F.lit(1.0)) if v.source else error("#VALUE!")


@register("INFO", "scalar", "t", "V")
def _info(_):
    return error("#N/A", "t")
