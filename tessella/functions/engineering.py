"""Number bases, bits, complex numbers, units, error and Bessel functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import special
from .core import general, scalar

NUM, VALUE, NA = "#NUM!", "#VALUE!", "#N/A"

_BASE = {"BIN": (2, 9, 10), "OCT": (8, 29, 10), "HEX": (16, 39, 10)}  # radix, bits of a positive number, digits


def _read(t: Column, kind: str) -> tuple[Column, Column]:
    """Two's complement text of ten digits as a number, and where it is none."""
    radix, bits, digits = _BASE[kind]
    s = F.upper(F.trim(t))
    ok = s.rlike({"BIN": "^[01]{0,10}$", "OCT": "^[0-7]{0,10}$", "HEX": "^[0-9A-F]{0,10}$"}[kind])
    n = F.coalesce(F.conv(F.when(ok & (s != ""), s), radix, 10).cast("long"), F.lit(0))
    return F.when(n >= 2**bits, n - radix**digits).otherwise(n), ~ok


def _write(n: Column, kind: str, places: Column):
    radix, bits, digits = _BASE[kind]
    whole = F.floor(n).cast("long")
    s = F.conv(F.when(whole < 0, whole + radix**digits).otherwise(whole).cast("string"), 10, radix)
    k = F.floor(places).cast("int")
    wide = F.when((whole < 0) | places.isNull(), s).otherwise(F.lpad(s, F.greatest(k, F.length(s)), "0"))
    return wide, (whole < -(2**bits)) | (whole >= 2**bits) | (places.isNotNull() & ((k < 1) | (k > 10) | ((whole >= 0) & (k < F.length(s)))))


def _bases() -> None:
    for kind in _BASE:

        @scalar(f"DEC2{kind}", "nn", "t", defaults=(None,))
        def to(n, places, kind=kind):
            out, bad = _write(n, kind, places)
            return out, (bad, NUM)

        @scalar(f"{kind}2DEC", "t")
        def back(t, kind=kind):
            n, bad = _read(t, kind)
            return n.cast("double"), (bad, NUM)

        for other in _BASE:
            if other != kind:

                @scalar(f"{kind}2{other}", "tn", "t", defaults=(None,))
                def across(t, places, kind=kind, other=other):
                    n, bad = _read(t, kind)
                    out, wide = _write(n, other, places)
                    return out, (bad, NUM), (wide, NUM)


_bases()

_LIMIT = 2.0**48


def _bits(name: str, f) -> None:
    @scalar(name, "nn")
    def build(a, b):
        bad = (a < 0) | (b < 0) | (a >= _LIMIT) | (b >= _LIMIT) | (F.floor(a) != a) | (F.floor(b) != b)
        return f(a.cast("long"), b.cast("long")).cast("double"), (bad, NUM)


_bits("BITAND", lambda a, b: a.bitwiseAND(b))
_bits("BITOR", lambda a, b: a.bitwiseOR(b))
_bits("BITXOR", lambda a, b: a.bitwiseXOR(b))


def _shift(name: str, sign: int) -> None:
    @scalar(name, "nn")
    def build(n, s):
        k = sign * F.floor(s)
        out = F.floor(n * F.pow(F.lit(2.0), k))
        return out.cast("double"), ((n < 0) | (n >= _LIMIT) | (F.floor(n) != n) | (F.abs(s) > 53), NUM), (out >= _LIMIT, NUM)


_shift("BITLSHIFT", 1)
_shift("BITRSHIFT", -1)


@scalar("DELTA", "nn", defaults=(0,))
def _delta(a, b):
    return (a == b).cast("double")


@scalar("GESTEP", "nn", defaults=(0,))
def _gestep(n, step):
    return (n >= step).cast("double")


def _distinct(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where each combination of numbers (bit for bit) comes first, and which combination each row has."""
    code, _ = pd.factorize(cols[0].view(np.int64))
    for a in cols[1:]:
        own, values = pd.factorize(a.view(np.int64))
        code, _ = pd.factorize(code * len(values) + own)
    first = np.empty(code.max() + 1, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return first, code


def arrow(f, n: int):
    """An Arrow batch function of n number columns, computed once for equal arguments; nulls and failures become null."""

    @F.pandas_udf(DoubleType())
    def run(*cols: pd.Series) -> pd.Series:
        x = [c.to_numpy(float, na_value=np.nan) for c in cols]
        ok = ~np.any([np.isnan(a) for a in x], axis=0)
        out = np.full(len(x[0]), np.nan)
        if ok.any():
            x = [a[ok] for a in x]
            first, code = _distinct(x)
            with np.errstate(all="ignore"):
                out[ok] = f(*[a[first] for a in x])[code]
        return pd.Series(np.where(np.isfinite(out), out, np.nan)).astype(object).where(np.isfinite(out), None)

    return run


def numeric(names: str, f, n: int, guard=None, defaults: tuple = ()):
    """Register an Arrow function; guard gives where it is #NUM!, and a null for whole arguments is #NUM! too."""
    run = arrow(f, n)

    def build(*args):
        whole = args[0].isNotNull()
        for a in args[1:]:
            whole = whole & a.isNotNull()
        # Outside the guard the arguments are not computed with.
        bad = guard(*args) if guard else F.lit(False)
        out = run(*[F.when(~bad, a) for a in args])
        return out, (bad, NUM), (whole & out.isNull(), NUM)

    scalar(names, "n" * n, defaults=defaults)(build)


numeric("ERF.PRECISE", special.erf, 1)
numeric("ERFC ERFC.PRECISE", special.erfc, 1)


@scalar("ERF", "nn", defaults=(None,))
def _erf(lo, hi):
    e = arrow(special.erf, 1)
    return F.when(hi.isNull(), e(lo)).otherwise(e(hi) - e(lo)), ((lo < 0) | F.coalesce(hi < 0, F.lit(False)), NUM)


_order = lambda x, n: n < 0
numeric("BESSELJ", lambda x, n: special.bessel_j(x, np.floor(n)), 2, _order)
numeric("BESSELI", lambda x, n: special.bessel_i(x, np.floor(n)), 2, _order)
numeric("BESSELK", lambda x, n: special.bessel_k(x, np.floor(n)), 2, lambda x, n: (n < 0) | (x <= 0))
numeric("BESSELY", lambda x, n: special.bessel_y(x, np.floor(n)), 2, lambda x, n: (n < 0) | (x <= 0))

# Complex numbers: text at the edges, a pair of columns inside.

_COMPLEX = r"^\s*(?:([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)(?![\d.eE]*[ij]))?\s*(?:([-+]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)?)([ij]))?\s*$"


class Z:
    """A complex value as columns of its parts and suffix."""

    def __init__(self, re: Column, im: Column, suffix: Column | None = None):
        self.re, self.im, self.suffix = re, im, F.lit("i") if suffix is None else suffix

    def __add__(self, o):
        return Z(self.re + o.re, self.im + o.im, self.suffix)

    def __sub__(self, o):
        return Z(self.re - o.re, self.im - o.im, self.suffix)

    def __mul__(self, o):
        return Z(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re, self.suffix)

    def over(self, o):
        d = o.re * o.re + o.im * o.im
        return Z(F.try_divide(self.re * o.re + self.im * o.im, d), F.try_divide(self.im * o.re - self.re * o.im, d), self.suffix)

    def abs(self):
        return F.hypot(self.re, self.im)

    def arg(self):
        return F.atan2(self.im, self.re)


def read_complex(t: Column) -> tuple[Z, Column]:
    part = lambda k: F.regexp_extract(t, _COMPLEX, k)
    im = F.when(part(3) == "", F.lit(0.0)).when(part(2).isin("", "+"), F.lit(1.0)).when(part(2) == "-", F.lit(-1.0)).otherwise(part(2).try_cast("double"))
    re = F.when(part(1) == "", F.lit(0.0)).otherwise(part(1).try_cast("double"))
    ok = t.rlike(_COMPLEX) & (F.trim(t) != "")
    return Z(F.when(ok, re), F.when(ok, im), F.when(part(3) == "j", F.lit("j")).otherwise(F.lit("i"))), ~ok


def write_complex(z: Z) -> Column:
    """Text as in 3+4i: no zero part, no 1 before the suffix."""
    im = F.when(z.im == 1, F.lit("")).when(z.im == -1, F.lit("-")).otherwise(general(z.im))
    tail = F.concat(im, z.suffix)
    return F.when(z.im == 0, general(z.re)).when(z.re == 0, tail).otherwise(F.concat(general(z.re), F.when(z.im > 0, F.lit("+")).otherwise(F.lit("")), tail))


@scalar("COMPLEX", "nnt", "t", defaults=("i",))
def _complex(re, im, suffix):
    return write_complex(Z(re, im, suffix)), (~suffix.isin("i", "j"), VALUE)


def _part(name: str, f, guard=None) -> None:
    @scalar(name, "t")
    def build(t):
        z, bad = read_complex(t)
        return (f(z), (bad, NUM), *([(guard(z), "#DIV/0!")] if guard else []))


_part("IMREAL", lambda z: z.re)
_part("IMAGINARY", lambda z: z.im)
_part("IMABS", Z.abs)
_part("IMARGUMENT", Z.arg, lambda z: (z.re == 0) & (z.im == 0))

_exp = lambda z: Z(F.exp(z.re) * F.cos(z.im), F.exp(z.re) * F.sin(z.im), z.suffix)
_ln = lambda z: Z(F.ln(z.abs()), z.arg(), z.suffix)
_scale = lambda z, k: Z(z.re * k, z.im * k, z.suffix)
_sin = lambda z: Z(F.sin(z.re) * F.cosh(z.im), F.cos(z.re) * F.sinh(z.im), z.suffix)
_cos = lambda z: Z(F.cos(z.re) * F.cosh(z.im), -F.sin(z.re) * F.sinh(z.im), z.suffix)
_sinh = lambda z: Z(F.sinh(z.re) * F.cos(z.im), F.cosh(z.re) * F.sin(z.im), z.suffix)
_cosh = lambda z: Z(F.cosh(z.re) * F.cos(z.im), F.sinh(z.re) * F.sin(z.im), z.suffix)
_inverse = lambda z: Z(F.lit(1.0), F.lit(0.0), z.suffix).over(z)


def _polar_power(z: Z, k: Column) -> Z:
    r, a = F.pow(z.abs(), k), z.arg() * k
    return Z(r * F.cos(a), r * F.sin(a), z.suffix)


def _map(name: str, f, zero: str | None = None) -> None:
    @scalar(name, "t", "t")
    def build(t):
        z, bad = read_complex(t)
        out = f(z)
        return (write_complex(out), (bad, NUM), *([((z.re == 0) & (z.im == 0), zero)] if zero else []), (out.re.isNull() | F.isnan(out.re) | F.isnan(out.im), NUM))


_map("IMCONJUGATE", lambda z: Z(z.re, -z.im, z.suffix))
_map("IMSQRT", lambda z: _polar_power(z, F.lit(0.5)))
_map("IMEXP", _exp)
_map("IMLN", _ln, NUM)
_map("IMLOG10", lambda z: _scale(_ln(z), 0.4342944819032518), NUM)
_map("IMLOG2", lambda z: _scale(_ln(z), 1.4426950408889634), NUM)
_map("IMSIN", _sin)
_map("IMCOS", _cos)
_map("IMTAN", lambda z: _sin(z).over(_cos(z)))
_map("IMSINH", _sinh)
_map("IMCOSH", _cosh)
_map("IMCOT", lambda z: _cos(z).over(_sin(z)), NUM)
_map("IMCSC", lambda z: _inverse(_sin(z)), NUM)
_map("IMCSCH", lambda z: _inverse(_sinh(z)), NUM)
_map("IMSEC", lambda z: _inverse(_cos(z)))
_map("IMSECH", lambda z: _inverse(_cosh(z)))


@scalar("IMPOWER", "tn", "t")
def _impower(t, n):
    z, bad = read_complex(t)
    zero = (z.re == 0) & (z.im == 0)
    return F.when(zero, F.lit("0")).otherwise(write_complex(_polar_power(z, n))), (bad, NUM), (zero & (n <= 0), NUM)


def _fold(name: str, takes: str, f) -> None:
    @scalar(name, takes, "t", least=len(takes.rstrip("+")))
    def build(*ts):
        zs = [read_complex(t) for t in ts]
        out = zs[0][0]
        for z, _ in zs[1:]:
            out = f(out, z)
        suffix = F.when(F.greatest(F.lit(0), *[(z.suffix == "j").cast("int") for z, _ in zs]) == 1, F.lit("j")).otherwise(F.lit("i"))
        return (write_complex(Z(out.re, out.im, suffix)), *[(bad, NUM) for _, bad in zs], (out.re.isNull(), NUM))


_fold("IMSUM", "t+", Z.__add__)
_fold("IMPRODUCT", "t+", Z.__mul__)
_fold("IMSUB", "tt", Z.__sub__)
_fold("IMDIV", "tt", Z.over)

#: Units by kind, as multiples of the kind's base unit (fixed values); those in METRIC take decimal prefixes.
UNITS = {
    "mass": {"g": 1.0, "sg": 14593.90293720636, "lbm": 453.59237, "u": 1.66053906660e-24, "ozm": 28.349523125, "grain": 0.06479891, "cwt": 45359.237, "uk_cwt": 50802.34544, "stone": 6350.29318, "ton": 907184.74, "uk_ton": 1016046.9088},
    "length": {"m": 1.0, "mi": 1609.344, "Nmi": 1852.0, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "ang": 1e-10, "ell": 1.143, "ly": 9.46073047258080e15, "parsec": 3.08567758149137e16, "pc": 3.08567758149137e16, "Pica": 0.0254 / 72, "pica": 0.0254 / 6, "survey_mi": 1609.347218694438},
    "time": {"sec": 1.0, "s": 1.0, "mn": 60.0, "min": 60.0, "hr": 3600.0, "day": 86400.0, "d": 86400.0, "yr": 31557600.0},
    "pressure": {"Pa": 1.0, "p": 1.0, "atm": 101325.0, "at": 101325.0, "mmHg": 133.322, "psi": 6894.757293168361, "Torr": 101325 / 760},
    "force": {"N": 1.0, "dyn": 1e-5, "dy": 1e-5, "lbf": 4.4482216152605, "pond": 0.00980665},
    "energy": {"J": 1.0, "e": 1e-7, "c": 4.184, "cal": 4.1868, "eV": 1.602176634e-19, "ev": 1.602176634e-19, "HPh": 2684519.537696173, "hh": 2684519.537696173, "Wh": 3600.0, "wh": 3600.0, "flb": 1.3558179483314, "BTU": 1055.05585262, "btu": 1055.05585262},
    "power": {"W": 1.0, "w": 1.0, "HP": 745.6998715822702, "h": 745.6998715822702, "PS": 735.49875},
    "magnetism": {"T": 1.0, "ga": 1e-4},
    "volume": {"l": 1.0, "L": 1.0, "lt": 1.0, "tsp": 0.00492892159375, "tspm": 0.005, "tbs": 0.01478676478125, "oz": 0.0295735295625, "cup": 0.2365882365, "pt": 0.473176473, "us_pt": 0.473176473, "uk_pt": 0.56826125, "qt": 0.946352946, "uk_qt": 1.1365225, "gal": 3.785411784, "uk_gal": 4.54609, "m3": 1000.0, "m^3": 1000.0, "in3": 0.016387064, "ft3": 28.316846592, "yd3": 764.554857984, "barrel": 158.987294928, "bushel": 35.23907016688},
    "area": {"m2": 1.0, "m^2": 1.0, "ha": 10000.0, "ar": 100.0, "uk_acre": 4046.8564224, "us_acre": 4046.872609874252, "in2": 0.00064516, "ft2": 0.09290304, "yd2": 0.83612736, "mi2": 2589988.110336, "Morgen": 2500.0},
    "information": {"bit": 1.0, "byte": 8.0},
    "speed": {"m/s": 1.0, "m/sec": 1.0, "m/h": 1 / 3600, "m/hr": 1 / 3600, "mph": 0.44704, "kn": 1852 / 3600, "admkn": 0.514773333333333},
}
METRIC = {"g", "u", "m", "ang", "ly", "parsec", "pc", "sec", "s", "Pa", "p", "atm", "at", "mmHg", "N", "dyn", "dy", "pond", "J", "e", "c", "cal", "eV", "ev", "Wh", "wh", "W", "w", "T", "ga", "l", "L", "lt", "bit", "byte", "m/s", "m/sec"}
PREFIXES = {"Y": 1e24, "Z": 1e21, "E": 1e18, "P": 1e15, "T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "e": 10.0, "da": 10.0, "d": 0.1, "c": 0.01, "m": 1e-3, "u": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15, "a": 1e-18, "z": 1e-21, "y": 1e-24}  # fixed values
BINARY = {"Yi": 2.0**80, "Zi": 2.0**70, "Ei": 2.0**60, "Pi": 2.0**50, "Ti": 2.0**40, "Gi": 2.0**30, "Mi": 2.0**20, "ki": 2.0**10}
#: Temperatures as scale and zero in kelvin (fixed values).
DEGREES = {"C": (1.0, 273.15), "cel": (1.0, 273.15), "K": (1.0, 0.0), "kel": (1.0, 0.0), "F": (5 / 9, 459.67 * 5 / 9), "fah": (5 / 9, 459.67 * 5 / 9), "Rank": (5 / 9, 0.0), "Reau": (1.25, 273.15)}


def all_units() -> dict[str, tuple[str, float]]:
    """Every unit with its kind and factor, prefixes multiplied out; a plain unit wins over a prefixed one of the same name."""
    out: dict[str, tuple[str, float]] = {}
    for kind, units in UNITS.items():
        for name, factor in units.items():
            if name in METRIC:
                for p, k in {**PREFIXES, **(BINARY if kind == "information" else {})}.items():
                    out.setdefault(p + name, (kind, factor * k))
    return out | {name: (kind, f) for kind, units in UNITS.items() for name, f in units.items()}


@scalar("CONVERT", "ntt")
def _convert(x, a, b):
    units = all_units()
    keys, kinds, factors = (F.array(*map(F.lit, z)) for z in zip(*[(n, k, f) for n, (k, f) in units.items()], strict=True))
    at = lambda u, what: F.try_element_at(what, F.nullif(F.array_position(keys, u), F.lit(0)).cast("int"))
    heat = lambda u, k: F.coalesce(*[F.when(u == n, F.lit(v[k])) for n, v in DEGREES.items()])
    warm = (x * heat(a, 0) + heat(a, 1) - heat(b, 1)) / heat(b, 0)
    plain = F.when(at(a, kinds) == at(b, kinds), x * at(a, factors) / at(b, factors))
    out = F.coalesce(warm, plain)
    return out, (out.isNull() & x.isNotNull(), NA)
