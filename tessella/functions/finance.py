"""Financial functions: closed forms as column expressions, folds over periods, and Arrow functions for iterative rates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import aggregate, let, scalar
from .dates import days360, year_fraction
from .engineering import numeric

NUM, DIV, VALUE = "#NUM!", "#DIV/0!", "#VALUE!"


def growth(r: Column, n: Column) -> Column:
    return F.pow(1 + r, n)


def annuity(r: Column, n: Column, when: Column) -> Column:
    """Worth at the end of n payments of 1; payments at a period's start count one period more."""
    return F.when(r == 0, n).otherwise((1 + r * when) * F.try_divide(growth(r, n) - 1, r))


def future(r, n, pmt, pv, when):
    return -(pv * growth(r, n) + pmt * annuity(r, n, when))


def payment(r, n, pv, fv, when):
    return -F.try_divide(pv * growth(r, n) + fv, annuity(r, n, when))


def _when(t: Column) -> Column:
    return F.when(t != 0, 1.0).otherwise(0.0)


@scalar("FV", "nnnnn", defaults=(0, 0))
def _fv(r, n, pmt, pv, t):
    return future(r, n, pmt, pv, _when(t))


@scalar("PV", "nnnnn", defaults=(0, 0))
def _pv(r, n, pmt, fv, t):
    return -F.try_divide(fv + pmt * annuity(r, n, _when(t)), growth(r, n))


@scalar("PMT", "nnnnn", defaults=(0, 0))
def _pmt(r, n, pv, fv, t):
    return payment(r, n, pv, fv, _when(t)), (n == 0, NUM)


def interest(r, per, n, pv, fv, t):
    """Interest in period per: on the balance before it, discounted if payments come first."""
    w = _when(t)
    pmt = payment(r, n, pv, fv, w)
    owed = future(r, per - 1, pmt, pv, w) * r
    return F.when(w == 1, F.when(per == 1, F.lit(0.0)).otherwise((future(r, per - 2, pmt, pv, w) - pmt) * r)).otherwise(owed)


@scalar("IPMT", "nnnnnn", defaults=(0, 0))
def _ipmt(r, per, n, pv, fv, t):
    return interest(r, per, n, pv, fv, t), ((per < 1) | (per > n), NUM)


@scalar("PPMT", "nnnnnn", defaults=(0, 0))
def _ppmt(r, per, n, pv, fv, t):
    return payment(r, n, pv, fv, _when(t)) - interest(r, per, n, pv, fv, t), ((per < 1) | (per > n), NUM)


@scalar("NPER", "nnnnn", defaults=(0, 0))
def _nper(r, pmt, pv, fv, t):
    k = pmt * (1 + r * _when(t))
    out = F.when(r == 0, -F.try_divide(pv + fv, pmt)).otherwise(F.try_divide(F.ln(F.try_divide(k - fv * r, k + pv * r)), F.ln(1 + r)))
    return out, (out.isNull(), NUM)


def _cumulative(part):
    def build(r, n, pv, a, b, t):
        lo, hi = F.ceil(a).cast("long"), F.floor(b).cast("long")
        total = F.aggregate(F.sequence(lo, F.greatest(hi, lo)), F.lit(0.0), lambda acc, k: acc + part(r, k.cast("double"), n, pv, F.lit(0.0), t))
        return total, ((r <= 0) | (n <= 0) | (pv <= 0) | (a < 1) | (b < a) | (b > n) | ~t.isin(0, 1), NUM)

    return build


scalar("CUMIPMT", "nnnnnn")(_cumulative(interest))
scalar("CUMPRINC", "nnnnnn")(_cumulative(lambda r, k, n, pv, fv, t: payment(r, n, pv, fv, _when(t)) - interest(r, k, n, pv, fv, t)))


@scalar("FVSCHEDULE", "nn+", least=2)
def _fvschedule(p, *rates):
    for r in rates:
        p = p * (1 + F.coalesce(r, F.lit(0.0)))
    return p


@scalar("NPV", "nn+", least=2)
def _npv(r, *flows):
    out, k = F.lit(0.0), 0
    for v in flows:
        k += 1
        out = out + F.try_divide(F.coalesce(v, F.lit(0.0)), growth(r, F.lit(float(k))))
    return out, (r == -1, DIV)


@scalar("RRI", "nnn")
def _rri(n, pv, fv):
    return F.pow(F.try_divide(fv, pv), F.try_divide(F.lit(1.0), n)) - 1, ((n <= 0) | (pv == 0), NUM)


@scalar("PDURATION", "nnn")
def _pduration(r, pv, fv):
    return (F.ln(fv) - F.ln(pv)) / F.ln(1 + r), ((r <= 0) | (pv <= 0) | (fv <= 0), NUM)


@scalar("ISPMT", "nnnn")
def _ispmt(r, per, n, pv):
    return pv * r * (F.try_divide(per, n) - 1), (n == 0, DIV)


@scalar("SLN", "nnn")
def _sln(cost, salvage, life):
    return F.try_divide(cost - salvage, life), (life == 0, DIV)


@scalar("SYD", "nnnn")
def _syd(cost, salvage, life, per):
    return (cost - salvage) * (life - per + 1) * 2 / (life * (life + 1)), ((life <= 0) | (per < 1) | (per > life), NUM)


@scalar("DB", "nnnnn", defaults=(12,))
def _db(cost, salvage, life, per, month):
    rate = F.round(1 - F.pow(F.try_divide(salvage, cost), F.try_divide(F.lit(1.0), life)), 3)
    first = cost * rate * month / 12
    lost = lambda k: first + (cost - first) * (1 - F.pow(1 - rate, k))  # noqa: E731  after the first period and k more
    p = F.floor(per)
    mid = (cost - lost(p - 2)) * rate
    last = (cost - lost(p - 2)) * rate * (12 - month) / 12
    out = F.when(p == 1, first).when(p == F.floor(life) + 1, last).otherwise(mid)
    return F.when(cost == 0, F.lit(0.0)).otherwise(out), ((cost < 0) | (salvage < 0) | (life <= 0) | (per < 1) | (month < 1) | (month > 12) | (p > F.floor(life) + F.when(month < 12, 1).otherwise(0)), NUM)


@scalar("DDB", "nnnnn", defaults=(2,))
def _ddb(cost, salvage, life, per, factor):
    """What the declining balance loses in the period, never under the salvage value."""
    rate = F.least(factor / life, F.lit(1.0))
    book = lambda k: F.greatest(cost * F.pow(1 - rate, k), F.least(salvage, cost))
    before = F.when(per <= 1, cost).otherwise(book(per - 1))
    return F.greatest(before - book(per), F.lit(0.0)), ((cost < 0) | (salvage < 0) | (life <= 0) | (per < 1) | (per > life) | (factor <= 0), NUM)


def _vdb(cost, salvage, life, start, end, factor, stay):
    """Period by period over part periods; straight line from where it loses more, unless `stay`."""
    out = np.zeros(len(cost))
    for i in range(len(cost)):
        c, s, n, a, b, f = cost[i], salvage[i], life[i], start[i], end[i], factor[i]
        book, total, straight = c, 0.0, False
        for k in range(int(np.ceil(b))):
            decline = min(max(book - s, 0.0), book * f / n)
            line = max(book - s, 0.0) / (n - k) if n > k else max(book - s, 0.0)
            straight = straight or (not stay[i] and line > decline)
            loss = line if straight and not stay[i] else decline
            part = min(b, k + 1) - max(a, k)
            total += loss * max(0.0, part)
            book -= loss
        out[i] = total
    return out


numeric("VDB", _vdb, 7, lambda c, s, n, a, b, f, z: (c < 0) | (s < 0) | (n <= 0) | (a < 0) | (b < a) | (b > n) | (f <= 0), defaults=(2, 0))


@scalar("EFFECT", "nn")
def _effect(r, n):
    k = F.floor(n)
    return F.pow(1 + r / k, k) - 1, ((r <= 0) | (n < 1), NUM)


@scalar("NOMINAL", "nn")
def _nominal(r, n):
    k = F.floor(n)
    return k * (F.pow(1 + r, 1 / k) - 1), ((r <= 0) | (n < 1), NUM)


def _digits(frac: Column) -> Column:
    return F.pow(F.lit(10.0), F.ceil(F.log10(F.floor(frac))))


@scalar("DOLLARDE", "nn")
def _dollarde(x, frac):
    whole = F.signum(x) * F.floor(F.abs(x))
    return whole + (x - whole) * _digits(frac) / F.floor(frac), (frac < 0, NUM), ((frac >= 0) & (frac < 1), DIV)


@scalar("DOLLARFR", "nn")
def _dollarfr(x, frac):
    whole = F.signum(x) * F.floor(F.abs(x))
    return whole + (x - whole) * F.floor(frac) / _digits(frac), (frac < 0, NUM), ((frac >= 0) & (frac < 1), DIV)


# Securities. Settlement before maturity and a basis of 0 to 4 are asked of all.


def _order(s: Column, m: Column, basis: Column):
    return ((s >= m) | (basis < 0) | (basis >= 5), NUM)


@scalar("DISC", "ddnnn", defaults=(0,))
def _disc(s, m, pr, red, basis):
    return (red - pr) / red / year_fraction(s, m, basis), _order(s, m, basis), ((pr <= 0) | (red <= 0), NUM)


@scalar("INTRATE", "ddnnn", defaults=(0,))
def _intrate(s, m, inv, red, basis):
    return (red - inv) / inv / year_fraction(s, m, basis), _order(s, m, basis), ((inv <= 0) | (red <= 0), NUM)


@scalar("RECEIVED", "ddnnn", defaults=(0,))
def _received(s, m, inv, disc, basis):
    return inv / (1 - disc * year_fraction(s, m, basis)), _order(s, m, basis), ((inv <= 0) | (disc <= 0), NUM)


@scalar("PRICEDISC", "ddnnn", defaults=(0,))
def _pricedisc(s, m, disc, red, basis):
    return red - disc * red * year_fraction(s, m, basis), _order(s, m, basis), ((disc <= 0) | (red <= 0), NUM)


@scalar("YIELDDISC", "ddnnn", defaults=(0,))
def _yielddisc(s, m, pr, red, basis):
    return (red / pr - 1) / year_fraction(s, m, basis), _order(s, m, basis), ((pr <= 0) | (red <= 0), NUM)


def _bill(s: Column, m: Column):
    return F.date_diff(m, s).cast("double"), ((s >= m) | (m > F.add_months(s, 12)), NUM)


@scalar("TBILLPRICE", "ddn")
def _tbillprice(s, m, d):
    n, bad = _bill(s, m)
    return 100 * (1 - d * n / 360), bad, (d <= 0, NUM)


@scalar("TBILLYIELD", "ddn")
def _tbillyield(s, m, pr):
    n, bad = _bill(s, m)
    return (100 - pr) / pr * 360 / n, bad, (pr <= 0, NUM)


@scalar("TBILLEQ", "ddn")
def _tbilleq(s, m, d):
    n, bad = _bill(s, m)
    short = 365 * d / (360 - d * n)
    price = (100 - d * 100 * n / 360) / 100
    days = F.when(n == 366, F.lit(366.0)).otherwise(F.lit(365.0))
    x = n / days
    long = (-2 * x + 2 * F.sqrt(x * x - (2 * x - 1) * (1 - 1 / price))) / (2 * x - 1)
    return F.when(n <= 182, short).otherwise(long), bad, (d <= 0, NUM)


def _months_back(m: Column, k: Column) -> Column:
    """k months before maturity; the end of a month stays the end."""
    d = F.add_months(m, -k)
    return F.when(m == F.last_day(m), F.last_day(d)).otherwise(d)


def coupons(s: Column, m: Column, freq: Column, body) -> Column:
    """`body` of a struct: coupons after settlement (n), the last coupon date up to it (pcd) and the next one after it (ncd)."""
    step = (12 / F.floor(freq)).cast("int")
    months = (F.year(m) - F.year(s)) * 12 + F.month(m) - F.month(s)
    k = F.floor(months / F.nullif(step, F.lit(0))).cast("int")
    return let(
        F.struct(k.alias("k"), step.alias("step")),
        lambda x: let(
            F.struct(F.when(_months_back(m, x["k"] * x["step"]) > s, x["k"] + 1).otherwise(x["k"]).alias("n"), x["step"].alias("step")),
            lambda y: let(F.struct(y["n"].alias("n"), _months_back(m, y["n"] * y["step"]).alias("pcd"), _months_back(m, (y["n"] - 1) * y["step"]).alias("ncd")), body),
        ),
    )


def _freq(f: Column):
    return (~F.floor(f).isin(1, 2, 4), NUM)


def _days(a: Column, b: Column, basis: Column) -> Column:
    k = F.floor(basis)
    return F.when(k == 0, days360(a, b, F.lit(False))).when(k == 4, days360(a, b, F.lit(True))).otherwise(F.date_diff(b, a).cast("double"))


def period(s, m, freq, basis, body):
    """`body` of a struct: days in the coupon period (e), from its start to settlement (a), from there to the next coupon (d); coupons left (n)."""
    k, f = F.floor(basis), F.floor(freq)

    def inner(c):
        e = F.when(k == 1, F.date_diff(c["ncd"], c["pcd"]).cast("double")).when(k == 3, 365 / f).otherwise(360 / f)
        a = _days(c["pcd"], s, basis)
        return let(
            F.struct(e.alias("e"), a.alias("a"), c["ncd"].alias("ncd"), c["n"].alias("n")),
            lambda x: let(F.struct(x["e"].alias("e"), x["a"].alias("a"), F.when(k.isin(0, 4), x["e"] - x["a"]).otherwise(F.date_diff(x["ncd"], s).cast("double")).alias("d"), x["n"].cast("double").alias("n")), body),
        )

    return coupons(s, m, freq, inner)


for _name, _at in (("COUPDAYS", "e"), ("COUPDAYBS", "a"), ("COUPDAYSNC", "d"), ("COUPNUM", "n")):
    scalar(_name, "ddnn", defaults=(0,))((lambda at: lambda s, m, f, b: (period(s, m, f, b, lambda p: p[at]), _order(s, m, b), _freq(f)))(_at))
for _name, _at in (("COUPPCD", "pcd"), ("COUPNCD", "ncd")):
    scalar(_name, "ddnn", "d", defaults=(0,))((lambda at: lambda s, m, f, b: (coupons(s, m, f, lambda c: c[at]), _order(s, m, b), _freq(f)))(_at))


def clean_price(p, rate, yld, red, f):
    """Discounted redemption and coupons less accrued interest, in the period struct `p`."""
    c, q, first = 100 * rate / f, 1 + yld / f, p["d"] / p["e"]
    coupons_ = F.aggregate(F.sequence(F.lit(0), F.greatest(p["n"] - 1, F.lit(0)).cast("int")), F.lit(0.0), lambda acc, k: acc + c / F.pow(q, k + first))
    long = red / F.pow(q, p["n"] - 1 + first) + coupons_ - c * p["a"] / p["e"]
    short = (red + c) / (1 + first * yld / f) - c * p["a"] / p["e"]
    return F.when(p["n"] <= 1, short).otherwise(long)


@scalar("PRICE", "ddnnnnn", defaults=(0,))
def _price(s, m, rate, yld, red, f, basis):
    return period(s, m, f, basis, lambda p: clean_price(p, rate, yld, red, F.floor(f))), _order(s, m, basis), _freq(f), ((rate < 0) | (yld < 0) | (red <= 0), NUM)


def _np_price(e, a, dsc, n, rate, yld, red, f):
    c, q, first = 100 * rate / f, 1 + yld / f, dsc / e
    with np.errstate(all="ignore"):
        v = 1 / q
        sums = np.where(np.abs(q - 1) < 1e-12, n, (1 - v**n) / np.where(np.abs(1 - v) < 1e-15, 1, 1 - v))
        long = red * v ** (n - 1 + first) + c * v**first * sums - c * a / e
        short = (red + c) / (1 + first * yld / f) - c * a / e
    return np.where(n <= 1, short, long)


def solve_falling(f, target, lo=-0.99, hi=10.0, steps=200):
    """x where the falling f reaches target, by bisection."""
    a, b = np.full(len(target), lo), np.full(len(target), hi)
    for _ in range(steps):
        mid = (a + b) / 2
        above = f(mid) > target
        a, b = np.where(above, mid, a), np.where(above, b, mid)
    return (a + b) / 2


from .engineering import arrow  # noqa: E402

_yield_of = arrow(lambda e, a, dsc, n, rate, pr, red, f: solve_falling(lambda y: _np_price(e, a, dsc, n, rate, y, red, f), pr), 8)


@scalar("YIELD", "ddnnnnn", defaults=(0,))
def _yield(s, m, rate, pr, red, f, basis):
    # The Arrow function cannot stand inside a lambda, so the period's parts come out as one struct first.
    p = period(s, m, f, basis, lambda p: p)
    return _yield_of(p["e"], p["a"], p["d"], p["n"], rate, pr, red, F.floor(f)), _order(s, m, basis), _freq(f), ((rate < 0) | (pr <= 0) | (red <= 0), NUM)


def macaulay(s, m, cpn, yld, freq, basis):
    f = F.floor(freq)
    c, q = 100 * cpn / f, 1 + yld / f

    def body(p):
        first = p["d"] / p["e"]
        flow = lambda k: F.when(k == p["n"] - 1, c + 100).otherwise(c) / F.pow(q, k + first)
        sums = F.aggregate(F.sequence(F.lit(0), F.greatest(p["n"] - 1, F.lit(0)).cast("int")), F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("t")), lambda acc, k: F.struct((acc["w"] + flow(k)).alias("w"), (acc["t"] + flow(k) * (k + first)).alias("t")))
        return let(sums, lambda x: x["t"] / x["w"] / f)

    return period(s, m, freq, basis, body)


@scalar("DURATION", "ddnnnn", defaults=(0,))
def _duration(s, m, c, y, f, basis):
    return macaulay(s, m, c, y, f, basis), _order(s, m, basis), _freq(f), ((c < 0) | (y < 0), NUM)


@scalar("MDURATION", "ddnnnn", defaults=(0,))
def _mduration(s, m, c, y, f, basis):
    return macaulay(s, m, c, y, f, basis) / (1 + y / F.floor(f)), _order(s, m, basis), _freq(f), ((c < 0) | (y < 0), NUM)


@scalar("ACCRINT", "dddnnnnn", defaults=(0, 1))
def _accrint(issue, first, settle, rate, par, freq, basis, method):
    """From issue (or, if method is 0 and the first coupon is past, from it) to settlement."""
    start = F.when((method == 0) & (settle > first), first).otherwise(issue)
    return par * rate * year_fraction(start, settle, basis), ((issue >= settle) | (rate <= 0) | (par <= 0), NUM), _freq(freq)


@scalar("ACCRINTM", "ddnnn", defaults=(0,))
def _accrintm(issue, settle, rate, par, basis):
    return par * rate * year_fraction(issue, settle, basis), ((issue >= settle) | (rate <= 0) | (par <= 0), NUM)


@scalar("PRICEMAT", "dddnnn", defaults=(0,))
def _pricemat(s, m, issue, rate, yld, basis):
    dim, dsm, a = year_fraction(issue, m, basis), year_fraction(s, m, basis), year_fraction(issue, s, basis)
    return (100 + dim * rate * 100) / (1 + dsm * yld) - a * rate * 100, _order(s, m, basis), ((rate < 0) | (yld < 0), NUM)


@scalar("YIELDMAT", "dddnnn", defaults=(0,))
def _yieldmat(s, m, issue, rate, pr, basis):
    dim, dsm, a = year_fraction(issue, m, basis), year_fraction(s, m, basis), year_fraction(issue, s, basis)
    paid = pr / 100 + a * rate
    return (1 + dim * rate - paid) / paid / dsm, _order(s, m, basis), ((rate < 0) | (pr <= 0), NUM)


@scalar("AMORLINC", "nddnnnn", defaults=(0,))
def _amorlinc(cost, bought, first, salvage, per, rate, basis):
    each, head = cost * rate, cost * rate * year_fraction(bought, first, basis)
    full = F.floor((cost - salvage - head) / each)
    p = F.floor(per)
    return F.when(p == 0, head).when(p <= full, each).when(p == full + 1, cost - salvage - each * full - head).otherwise(F.lit(0.0)), ((bought > first) | (cost < salvage) | (per < 0) | (rate <= 0), NUM)


def _odd_first(s, m, issue, first, rate, yld, red, freq, basis):
    """Price with an odd first period, measured in quasi-coupon periods counted back from the first coupon."""
    f = F.floor(freq)
    step = (12 / f).cast("int")
    e = F.when(F.floor(basis) == 1, F.date_diff(first, _months_back(first, step)).cast("double")).when(F.floor(basis) == 3, 365 / f).otherwise(360 / f)
    q, c = 1 + yld / f, 100 * rate / f
    parts = let(e, lambda x: F.struct((_days(issue, first, basis) / x).alias("dfc"), (_days(issue, s, basis) / x).alias("a"), (_days(s, first, basis) / x).alias("d"), F.round(F.months_between(m, first) / step).alias("n")))

    def body(p):
        rest = F.aggregate(F.sequence(F.lit(1), F.greatest(p["n"], F.lit(1)).cast("int")), F.lit(0.0), lambda acc, k: acc + F.when(k <= p["n"], c / F.pow(q, k + p["d"])).otherwise(0.0))
        return red / F.pow(q, p["n"] + p["d"]) + c * p["dfc"] / F.pow(q, p["d"]) + rest - c * p["a"]

    return let(parts, body)


def _odd_last(s, m, last, rate, yld, red, freq, basis):
    f = F.floor(freq)
    step = (12 / f).cast("int")
    e = F.when(F.floor(basis) == 1, F.date_diff(F.add_months(last, step), last).cast("double")).when(F.floor(basis) == 3, 365 / f).otherwise(360 / f)
    dc, a, ds = _days(last, m, basis) / e, _days(last, s, basis) / e, _days(s, m, basis) / e
    return dc, a, ds, f


@scalar("ODDFPRICE", "ddddnnnnn", defaults=(0,))
def _oddfprice(s, m, issue, first, rate, yld, red, f, basis):
    return _odd_first(s, m, issue, first, rate, yld, red, f, basis), ((issue >= s) | (s >= first) | (first >= m) | (rate < 0) | (yld < 0) | (red <= 0), NUM), _freq(f)


@scalar("ODDFYIELD", "ddddnnnnn", defaults=(0,))
def _oddfyield(s, m, issue, first, rate, pr, red, f, basis):
    """Bisection as a fold of fixed length over the falling price."""
    box = F.struct(F.lit(-0.9).alias("a"), F.lit(10.0).alias("b"))

    def halve(x, _):
        mid = (x["a"] + x["b"]) / 2
        above = _odd_first(s, m, issue, first, rate, mid, red, f, basis) > pr
        return F.struct(F.when(above, mid).otherwise(x["a"]).alias("a"), F.when(above, x["b"]).otherwise(mid).alias("b"))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(60)), box, halve, lambda x: (x["a"] + x["b"]) / 2)
    return out, ((issue >= s) | (s >= first) | (first >= m) | (rate < 0) | (pr <= 0) | (red <= 0), NUM), _freq(f)


@scalar("ODDLPRICE", "dddnnnnn", defaults=(0,))
def _oddlprice(s, m, last, rate, yld, red, freq, basis):
    dc, a, ds, f = _odd_last(s, m, last, rate, yld, red, freq, basis)
    return (red + dc * 100 * rate / f) / (1 + ds * yld / f) - a * 100 * rate / f, ((last >= s) | (s >= m) | (rate < 0) | (yld < 0) | (red <= 0), NUM), _freq(freq)


@scalar("ODDLYIELD", "dddnnnnn", defaults=(0,))
def _oddlyield(s, m, last, rate, pr, red, freq, basis):
    dc, a, ds, f = _odd_last(s, m, last, rate, F.lit(0.0), red, freq, basis)
    paid = pr + a * 100 * rate / f
    return (red + dc * 100 * rate / f - paid) / paid * f / ds, ((last >= s) | (s >= m) | (rate < 0) | (pr <= 0) | (red <= 0), NUM), _freq(freq)


def _rate(n, pmt, pv, fv, when, guess):
    """Newton steps on the annuity equation, from the guess."""
    r = guess.astype(float)
    for _ in range(100):
        def f(x):
            g = np.exp(n * np.log1p(x))
            a = np.where(np.abs(x) < 1e-11, n, (1 + x * when) * (g - 1) / np.where(np.abs(x) < 1e-11, 1, x))
            return pv * g + pmt * a + fv

        h = 1e-7 * np.maximum(1.0, np.abs(r))
        slope = (f(r + h) - f(r - h)) / (2 * h)
        step = f(r) / slope
        r = np.maximum(r - step, -0.999999)
        if np.all(~np.isfinite(step) | (np.abs(step) < 1e-13)):
            break
    return np.where(np.abs(f(r)) < 1e-6 * np.maximum(1.0, np.abs(pv) + np.abs(fv) + np.abs(pmt) * n), r, np.nan)


numeric("RATE", _rate, 6, lambda n, *_: n <= 0, defaults=(0, 0, 0.1))


def xirr(values: np.ndarray, times: np.ndarray, guess: float = 0.1) -> float:
    """The rate at which flows at `times` (in periods from the first) are worth nothing; NaN without a change of sign."""
    if not ((values > 0).any() and (values < 0).any()):
        return float("nan")
    worth = lambda r: float((values / (1 + r) ** times).sum())
    grid = np.concatenate([np.linspace(-0.99, 1.0, 200), np.geomspace(1.01, 1e6, 60)])
    with np.errstate(all="ignore"):
        w = np.array([worth(r) for r in grid])
    cross = np.flatnonzero(np.sign(w[:-1]) * np.sign(w[1:]) <= 0)
    if not len(cross):
        return float("nan")
    k = cross[np.argmin(np.abs(grid[cross] - guess))]
    a, b, fa = grid[k], grid[k + 1], w[k]
    for _ in range(200):
        mid = (a + b) / 2
        fm = worth(mid)
        a, b, fa = (mid, b, fm) if np.sign(fm) == np.sign(fa) else (a, mid, fa)
    return (a + b) / 2


@aggregate("XNPV", "nnd")
def _xnpv(rate, v, d):
    """Each group's flows; the earliest date is the start."""
    first = F.min(d)
    flows = F.collect_list(F.struct(v.alias("v"), d.alias("d")))
    return F.aggregate(flows, F.lit(0.0), lambda a, x: a + x["v"] / F.pow(1 + F.max(rate), F.date_diff(x["d"], first) / 365)), ((F.max(rate) <= -1), NUM)
