"""Arithmetic, trigonometry, rounding and number theory, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import aggregate, scalar, snap

NUM, DIV, VALUE, NA = "#NUM!", "#DIV/0!", "#VALUE!", "#N/A"


def _plain(names: str, f, guard=None):
    def build(x: Column):
        return (f(x), (guard(x), NUM)) if guard else f(x)

    scalar(names)(build)


for _name, _f in (("ABS", F.abs), ("EXP", F.exp), ("SIN", F.sin), ("COS", F.cos), ("TAN", F.tan), ("ATAN", F.atan), ("SINH", F.sinh), ("COSH", F.cosh), ("TANH", F.tanh), ("ASINH", F.asinh), ("DEGREES", F.degrees), ("RADIANS", F.radians), ("SIGN", F.signum), ("FISHERINV", F.tanh)):
    _plain(_name, _f)
_plain("INT", lambda x: F.floor(x).cast("double"))
_plain("SQRT", F.sqrt, lambda x: x < 0)
_plain("SQRTPI", lambda x: F.sqrt(x * math.pi), lambda x: x < 0)
_plain("LN", F.ln, lambda x: x <= 0)
_plain("LOG10", F.log10, lambda x: x <= 0)
_plain("ASIN", F.asin, lambda x: F.abs(x) > 1)
_plain("ACOS", F.acos, lambda x: F.abs(x) > 1)
_plain("ACOT", lambda x: math.pi / 2 - F.atan(x))
_plain("ACOSH", F.acosh, lambda x: x < 1)
_plain("ATANH FISHER", F.atanh, lambda x: F.abs(x) >= 1)
_plain("ACOTH", lambda x: 0.5 * F.ln(F.try_divide(x + 1, x - 1)), lambda x: F.abs(x) <= 1)
_plain("SEC", F.sec, lambda x: F.abs(x) >= 2**27)
_plain("SECH", lambda x: 1 / F.cosh(x))


@scalar("PI", "", least=0)
def _pi():
    return F.pi()


def _over(names: str, f):
    """The reciprocal of f(x), with zero as #DIV/0!."""

    @scalar(names)
    def build(x):
        return F.try_divide(F.lit(1.0), f(x)), (f(x) == 0, DIV), (F.abs(x) >= 2**27, NUM)


for _name, _f in (("CSC", F.sin), ("COT", F.tan), ("CSCH", F.sinh), ("COTH", F.tanh)):
    _over(_name, _f)


@scalar("ATAN2", "nn")
def _atan2(x, y):
    return F.atan2(y, x), ((x == 0) & (y == 0), DIV)


@scalar("LOG", "nn", defaults=(10,))
def _log(x, base):
    return F.try_divide(F.ln(x), F.ln(base)), ((x <= 0) | (base <= 0), NUM), (base == 1, DIV)


@scalar("MOD", "nn")
def _mod(n, d):
    return n - d * F.floor(F.try_divide(n, d)), (d == 0, DIV), (F.abs(n) >= 2.0**40, NUM)


@scalar("QUOTIENT", "nn")
def _quotient(n, d):
    q = F.try_divide(n, d)
    return F.signum(q) * F.floor(F.abs(q)), (d == 0, DIV)


@scalar("POWER", "nn")
def _power(b, e):
    return F.pow(b, e), ((b == 0) & (e == 0), NUM), ((b == 0) & (e < 0), DIV)


def _scaled(x: Column, d: Column, f) -> Column:
    """f over |x| scaled by 10^d, at 15 significant digits, with the sign put back."""
    scale = F.pow(F.lit(10.0), F.abs(_cut(d)))
    up = F.when(d >= 0, F.abs(x) * scale).otherwise(F.abs(x) / scale)
    whole = f(snap(up)).cast("double")
    return F.signum(x) * F.when(d >= 0, whole / scale).otherwise(whole * scale)


def _cut(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x))


@scalar("ROUND", "nn")
def _round(x, d):
    """Half away from zero."""
    return _scaled(x, _cut(d), lambda y: F.floor(y + 0.5))


@scalar("ROUNDUP", "nn")
def _roundup(x, d):
    return _scaled(x, _cut(d), F.ceil)


@scalar("ROUNDDOWN TRUNC", "nn", defaults=(0,))
def _rounddown(x, d):
    return _scaled(x, _cut(d), F.floor)


@scalar("MROUND", "nn")
def _mround(x, m):
    return F.when(m == 0, F.lit(0.0)).otherwise(m * F.floor(snap(F.try_divide(x, m)) + 0.5)), (F.signum(x) * F.signum(m) < 0, NUM)


@scalar("EVEN")
def _even(x):
    return F.signum(x) * F.ceil(F.abs(x) / 2) * 2


@scalar("ODD")
def _odd(x):
    return F.when(x == 0, F.lit(1.0)).otherwise(F.signum(x) * (F.ceil((F.abs(x) + 1) / 2) * 2 - 1))


@scalar("CEILING", "nn")
def _ceiling(x, s):
    """Away from zero if the signs agree; a negative number with a positive step goes up."""
    return F.when((s == 0) | (x == 0), F.lit(0.0)).otherwise(F.ceil(snap(F.try_divide(x, s))) * s), ((x > 0) & (s < 0), NUM)


@scalar("FLOOR", "nn")
def _floor(x, s):
    return F.when(x == 0, F.lit(0.0)).otherwise(F.floor(snap(F.try_divide(x, s))) * s), ((s == 0) & (x != 0), DIV), ((x > 0) & (s < 0), NUM)


@scalar("CEILING.MATH", "nnn", defaults=(1, 0))
def _ceiling_math(x, s, mode):
    q = snap(F.try_divide(x, F.abs(s)))
    return F.when(s == 0, F.lit(0.0)).otherwise(F.when((x < 0) & (mode != 0), F.floor(q)).otherwise(F.ceil(q)) * F.abs(s))


@scalar("FLOOR.MATH", "nnn", defaults=(1, 0))
def _floor_math(x, s, mode):
    q = snap(F.try_divide(x, F.abs(s)))
    return F.when(s == 0, F.lit(0.0)).otherwise(F.when((x < 0) & (mode != 0), F.ceil(q)).otherwise(F.floor(q)) * F.abs(s))


@scalar("CEILING.PRECISE ISO.CEILING", "nn", defaults=(1,))
def _ceiling_precise(x, s):
    return F.when(s == 0, F.lit(0.0)).otherwise(F.ceil(snap(F.try_divide(x, F.abs(s)))) * F.abs(s))


@scalar("FLOOR.PRECISE", "nn", defaults=(1,))
def _floor_precise(x, s):
    return F.when(s == 0, F.lit(0.0)).otherwise(F.floor(snap(F.try_divide(x, F.abs(s)))) * F.abs(s))


def product_to(lo: Column, hi: Column, term, most: int) -> Column:
    """The product of term(i) for lo <= i <= hi (1 if there is none); the range is cut at `most` terms, beyond which doubles overflow."""
    top = F.least(hi, lo + most)
    steps = F.when(hi >= lo, F.sequence(lo.cast("long"), top.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.lit(1.0), lambda acc, i: acc * term(i.cast("double")))


@scalar("FACT")
def _fact(n):
    return product_to(F.lit(2.0), F.floor(n), lambda i: i, 170), ((n < 0) | (n >= 171), NUM)


@scalar("FACTDOUBLE")
def _factdouble(n):
    m = F.floor(n)
    return product_to(F.lit(0.0), F.floor(m / 2) - 1, lambda i: F.greatest(m - 2 * i, F.lit(1.0)), 200), ((n < -1) | (n >= 301), NUM)


def combinations(n: Column, k: Column) -> Column:
    j = F.least(k, n - k)
    return F.floor(product_to(F.lit(1.0), j, lambda i: (n - j + i) / i, 1100) + 0.5).cast("double")


@scalar("COMBIN", "nn")
def _combin(n, k):
    a, b = F.floor(n), F.floor(k)
    return combinations(a, b), ((a < 0) | (b < 0) | (b > a), NUM)


@scalar("COMBINA", "nn")
def _combina(n, k):
    a, b = F.floor(n), F.floor(k)
    return F.when(b == 0, F.lit(1.0)).otherwise(combinations(a + b - 1, b)), ((a < 0) | (b < 0) | ((a == 0) & (b > 0)), NUM)


@scalar("PERMUT", "nn")
def _permut(n, k):
    a, b = F.floor(n), F.floor(k)
    return product_to(a - b + 1, a, lambda i: i, 1100), ((a < 0) | (b < 0) | (b > a), NUM)


@scalar("PERMUTATIONA", "nn")
def _permutationa(n, k):
    return F.pow(F.floor(n), F.floor(k)), ((n < 0) | (k < 0), NUM)


def _gcd2(a: Column, b: Column) -> Column:
    """Euclid's steps as a fold: at most 80 of them for numbers under 2^53."""
    pair = F.struct(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).cast("long").alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(80)), pair, step, lambda s: s["a"]).cast("double")


@scalar("GCD", "n+", least=1)
def _gcd(*n):
    out = F.floor(n[0])
    for x in n[1:]:
        out = _gcd2(out, F.floor(x))
    return (out.cast("double"), *[(x < 0, NUM) for x in n], *[(x >= 2.0**53, NUM) for x in n])


@scalar("LCM", "n+", least=1)
def _lcm(*n):
    out = F.floor(n[0]).cast("double")
    for x in n[1:]:
        y = F.floor(x).cast("double")
        out = F.when((out == 0) | (y == 0), F.lit(0.0)).otherwise(out / F.greatest(_gcd2(out, y), F.lit(1.0)) * y)
    return (out, *[(x < 0, NUM) for x in n])


@scalar("MULTINOMIAL", "n+", least=1)
def _multinomial(*n):
    total, out = F.floor(n[0]), F.lit(1.0)
    for x in n[1:]:
        total = total + F.floor(x)
        out = out * combinations(total, F.floor(x))
    return (out, *[(x < 0, NUM) for x in n])


@scalar("SERIESSUM", "nnnn+", least=4)
def _seriessum(x, n, m, *coefficients):
    return sum((c * F.pow(x, n + i * m) for i, c in enumerate(coefficients)), F.lit(0.0))


@scalar("RAND", "", least=0, volatile=True)
def _rand():
    return F.rand()


@scalar("RANDBETWEEN", "nn", volatile=True)
def _randbetween(lo, hi):
    a, b = F.round(lo), F.round(hi)
    return F.floor(F.rand() * (b - a + 1)) + a, (a > b, NUM)


@scalar("BASE", "nnn", "t", defaults=(0,))
def _base(n, radix, width):
    out = _radix_text(F.floor(n).cast("long"), F.floor(radix).cast("int"))
    return F.lpad(out, F.greatest(F.length(out), F.floor(width).cast("int")), "0"), ((n < 0) | (n >= 2.0**53) | (radix < 2) | (radix > 36) | (width < 0) | (width > 255), NUM)


_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _radix_text(n: Column, radix: Column) -> Column:
    """Digits of `n` by repeated division; 53 steps are enough for base 2."""
    safe = F.greatest(radix, F.lit(2))
    start = F.struct(n.alias("n"), F.lit("").alias("s"))
    step = lambda a, _: F.when((a["n"] == 0) & (a["s"] != ""), a).otherwise(F.struct(F.floor(a["n"] / safe).cast("long").alias("n"), F.concat(F.substring(F.lit(_DIGITS), (a["n"] % safe).cast("int") + 1, F.lit(1)), a["s"]).alias("s")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(54)), start, step, lambda a: a["s"])


@scalar("DECIMAL", "tn")
def _decimal(s, radix):
    t, r = F.upper(F.trim(s)), F.floor(radix)
    digit = lambda c: (F.instr(F.lit(_DIGITS), c) - 1).cast("double")
    value = F.aggregate(F.filter(F.split(t, ""), lambda c: c != ""), F.lit(0.0), lambda a, c: a * r + digit(c))
    bad = F.exists(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: (digit(c) < 0) | (digit(c) >= r))
    return value, (bad | (radix < 2) | (radix > 36), NUM)


#: Roman numerals of the classic form: value and sign (fixed values).
_ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]

#: Pairs that the more concise forms 1 to 4 allow in addition (fixed values).
_CONCISE = {1: [(45, "VL"), (95, "VC"), (450, "LD"), (950, "LM")], 2: [(49, "IL"), (99, "IC"), (490, "XD"), (990, "XM")], 3: [(495, "VD"), (995, "VM")], 4: [(499, "ID"), (999, "IM")]}


def _roman_of(n: Column, table: list) -> Column:
    start = F.struct(n.cast("int").alias("n"), F.lit("").alias("s"))
    steps = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in table])
    put = lambda a, x: F.struct((a["n"] % x["v"]).alias("n"), F.concat(a["s"], F.repeat(x["s"], F.floor(a["n"] / x["v"]).cast("int"))).alias("s"))
    return F.aggregate(steps, start, put, lambda a: a["s"])


@scalar("ROMAN", "nn", "t", defaults=(0,))
def _roman(n, form):
    out = _roman_of(n, _ROMAN)
    for k in range(1, 5):
        table = sorted([*_ROMAN, *[p for j in range(1, k + 1) for p in _CONCISE[j]]], reverse=True)
        out = F.when(F.floor(form) == k, _roman_of(n, table)).otherwise(out)
    return out, ((n < 0) | (n >= 4000), VALUE), ((form < 0) | (form > 4), VALUE)


@scalar("ARABIC", "t")
def _arabic(t):
    s = F.upper(F.trim(t))
    body = F.regexp_replace(s, "^-", "")
    worth = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}  # fixed values
    of = lambda c: F.coalesce(*[F.when(c == k, F.lit(float(v))) for k, v in worth.items()], F.lit(0.0))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("last"))
    fold = lambda a, c: F.struct((a["sum"] + F.when(of(c) < a["last"], -of(c)).otherwise(of(c))).alias("sum"), F.greatest(of(c), a["last"]).alias("last"))
    total = F.aggregate(F.reverse(F.filter(F.split(body, ""), lambda c: c != "")), start, fold, lambda a: a["sum"])
    return F.when(s.startswith("-"), -total).otherwise(total), (~body.rlike("^[IVXLCDM]*$"), VALUE)


# Aggregates over rows.


@aggregate("SUM")
def _sum(x):
    return F.coalesce(F.sum(x), F.lit(0.0))


@aggregate("PRODUCT")
def _product(x):
    return F.coalesce(F.product(x), F.lit(0.0))


@aggregate("AVERAGE AVERAGEA")
def _average(x):
    return F.avg(x), (F.count(x) == 0, DIV)


@aggregate("COUNT")
def _count(x):
    return F.count(x).cast("double")


@aggregate("COUNTA", "*")
def _counta(x):
    return F.count(x).cast("double")


@aggregate("COUNTBLANK", "t")
def _countblank(x):
    return F.count_if(x.isNull() | (x == "")).cast("double")


@aggregate("MIN MINA")
def _min(x):
    return F.coalesce(F.min(x), F.lit(0.0))


@aggregate("MAX MAXA")
def _max(x):
    return F.coalesce(F.max(x), F.lit(0.0))


@aggregate("SUMSQ")
def _sumsq(x):
    return F.coalesce(F.sum(x * x), F.lit(0.0))


@aggregate("SUMPRODUCT", "n+", least=1)
def _sumproduct(*cols):
    out = F.coalesce(cols[0], F.lit(0.0))
    for c in cols[1:]:
        out = out * F.coalesce(c, F.lit(0.0))
    return F.coalesce(F.sum(out), F.lit(0.0))


@aggregate("SUMX2MY2", "nn")
def _sumx2my2(x, y):
    return F.coalesce(F.sum(x * x - y * y), F.lit(0.0))


@aggregate("SUMX2PY2", "nn")
def _sumx2py2(x, y):
    return F.coalesce(F.sum(x * x + y * y), F.lit(0.0))


@aggregate("SUMXMY2", "nn")
def _sumxmy2(x, y):
    return F.coalesce(F.sum((x - y) * (x - y)), F.lit(0.0))
