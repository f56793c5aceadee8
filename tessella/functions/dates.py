"""Dates and times. Dates are Spark dates inside and serial numbers only where a formula asks for a number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import EPOCH, V, date, first_error, number, register, scalar

VALUE, NUM = "#VALUE!", "#NUM!"


def _int(x: Column) -> Column:
    return F.floor(x).cast("int")


def _cut(x: Column) -> Column:
    return (F.signum(x) * F.floor(F.abs(x))).cast("int")


@scalar("DATE", "nnn", "d")
def _date(y, m, d):
    year = F.when(y < 1900, _int(y) + 1900).otherwise(_int(y))
    first = F.add_months(F.make_date(F.greatest(F.least(year, F.lit(9999)), F.lit(1)), F.lit(1), F.lit(1)), _int(m) - 1)
    out = F.date_add(first, _int(d) - 1)
    return out, ((y < 0) | (y >= 10_000), NUM), (out < F.lit("1899-12-31").cast("date"), NUM)


@scalar("DATEVALUE", "t", "d")
def _datevalue(t):
    s = F.replace(F.trim(t), F.lit("/"), F.lit("-"))
    out = F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), s.try_cast("date"))
    return out, (out.isNull() & t.isNotNull(), VALUE)


@scalar("TODAY", "", "d", least=0, volatile=True)
def _today():
    return F.current_date()


@register("NOW", "scalar", "", "V", least=0, volatile=True)
def _now():
    now = F.current_timestamp()
    return V(F.date_diff(now.cast("date"), F.lit(EPOCH).cast("date")) + (F.hour(now) * 3600 + F.minute(now) * 60 + F.second(now)) / 86400.0, "n")


for _name, _f in (("YEAR", F.year), ("MONTH", F.month), ("DAY", F.dayofmonth), ("ISOWEEKNUM", F.weekofyear)):
    scalar(_name, "d")((lambda f: lambda d: f(d).cast("double"))(_f))


def _seconds(n: Column) -> Column:
    return F.floor((n - F.floor(n)) * 86400 + 0.5) % 86400


def _clock(name: str, f) -> None:
    @register(name, "scalar", "*", "V")
    def build(x):
        if x.source and x.t == "d":
            return V(f(F.hour(x.v) * 3600 + F.minute(x.v) * 60 + F.second(x.v)).cast("double"), "n", x.e)
        n = number(x)
        return V(f(_seconds(n.v)).cast("double"), "n", first_error(n.e, F.when(n.v < 0, F.lit(NUM))))


_clock("HOUR", lambda s: F.floor(s / 3600))
_clock("MINUTE", lambda s: F.floor(s / 60) % 60)
_clock("SECOND", lambda s: s % 60)


@scalar("TIME", "nnn")
def _time(h, m, s):
    return (_cut(h) / 24.0 + _cut(m) / 1440.0 + _cut(s) / 86400.0) % 1, ((h < 0) | (m < 0) | (s < 0), NUM)


@scalar("WEEKDAY", "dn", defaults=(1,))
def _weekday(d, kind):
    k = F.floor(kind)
    out = F.when(k == 1, F.dayofweek(d)).when(k == 2, F.weekday(d) + 1).when(k == 3, F.weekday(d))
    return out.cast("double"), (~k.isin(1, 2, 3), NUM)


@scalar("WEEKNUM", "dn", defaults=(1,))
def _weeknum(d, kind):
    k = F.floor(kind).cast("int")
    starts = F.when(k.isin(1, 17), 6).when(k.isin(2, 11), 0).otherwise(k - 11)  # 0: weeks start on Monday
    jan1 = F.trunc(d, "year")
    offset = (F.weekday(jan1) - starts + 7) % 7
    out = F.floor((F.dayofyear(d) - 1 + offset) / 7) + 1
    return F.when(k == 21, F.weekofyear(d)).otherwise(out).cast("double"), (~k.isin(1, 2, 11, 12, 13, 14, 15, 16, 17, 21), NUM)


@scalar("EDATE", "dn", "d")
def _edate(d, n):
    return F.add_months(d, _cut(n))


@scalar("EOMONTH", "dn", "d")
def _eomonth(d, n):
    return F.last_day(F.add_months(d, _cut(n)))


@scalar("DAYS", "dd")
def _days(end, start):
    return F.date_diff(end, start).cast("double")


def ymd(d: Column) -> tuple[Column, Column, Column]:
    return F.year(d), F.month(d), F.dayofmonth(d)


def days360(a: Column, b: Column, european: Column) -> Column:
    """30/360 days; the US rule moves the end of February and the 31st."""
    (y1, m1, d1), (y2, m2, d2) = ymd(a), ymd(b)
    last = lambda d: d == F.last_day(d)
    feb1, feb2 = (m1 == 2) & last(a), (m2 == 2) & last(b)
    us1 = F.when(feb1 | (d1 == 31), 30).otherwise(d1)
    us2 = F.when(feb1 & feb2, 30).when((d2 == 31) & (us1 >= 30), 30).otherwise(d2)
    e1, e2 = F.least(d1, F.lit(30)), F.least(d2, F.lit(30))
    return ((y2 - y1) * 360 + (m2 - m1) * 30 + F.when(european, e2 - e1).otherwise(us2 - us1)).cast("double")


@scalar("DAYS360", "ddb", defaults=(False,))
def _days360(a, b, european):
    (y1, m1, d1), (y2, m2, d2) = ymd(a), ymd(b)
    s = F.when((d1 == 31) | (a == F.last_day(a)) & (m1 == 2), 30).otherwise(d1)
    same = (d2 == 31) & (s < 30)
    us = (y2 - y1) * 360 + F.when(same, m2 + 1 - m1).otherwise(m2 - m1) * 30 + F.when(same, 1).when(d2 == 31, 30).otherwise(d2) - s
    eu = (y2 - y1) * 360 + (m2 - m1) * 30 + F.least(d2, F.lit(30)) - F.least(d1, F.lit(30))
    return F.when(european, eu).otherwise(us).cast("double")


def year_days_actual(a: Column, b: Column) -> Column:
    """Mean length of the years that an actual/actual fraction from a to b is counted in."""
    y1, y2 = F.year(a), F.year(b)
    leap = lambda y: ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    within_year = b <= F.add_months(a, 12)
    feb29 = lambda y: F.make_date(y, F.lit(3), F.lit(1))
    has = (leap(y1) & (a < feb29(y1)) & (b >= F.date_sub(feb29(y1), 1))) | (leap(y2) & (b >= F.date_sub(feb29(y2), 1)) & (a < feb29(y2)))
    short = F.when((y1 == y2) & leap(y1), 366.0).when((y1 == y2), 365.0).when(has, 366.0).otherwise(365.0)
    span = F.date_diff(F.make_date(y2 + 1, F.lit(1), F.lit(1)), F.make_date(y1, F.lit(1), F.lit(1))) / (y2 - y1 + 1)
    return F.when(within_year, short).otherwise(span)


def year_fraction(start: Column, end: Column, basis: Column) -> Column:
    a, b, k = F.least(start, end), F.greatest(start, end), F.floor(basis)
    days = F.date_diff(b, a).cast("double")
    return F.when(k == 0, days360(a, b, F.lit(False)) / 360).when(k == 1, days / year_days_actual(a, b)).when(k == 2, days / 360).when(k == 3, days / 365).when(k == 4, days360(a, b, F.lit(True)) / 360)


@scalar("YEARFRAC", "ddn", defaults=(0,))
def _yearfrac(a, b, basis):
    return year_fraction(a, b, basis), ((basis < 0) | (basis >= 5), NUM)


@scalar("DATEDIF", "ddt")
def _datedif(a, b, unit):
    u = F.upper(unit)
    (y1, m1, d1), (y2, m2, d2) = ymd(a), ymd(b)
    months = (y2 - y1) * 12 + (m2 - m1) - F.when(d2 < d1, 1).otherwise(0)
    back = F.add_months(F.trunc(b, "month"), -1)
    md = F.when(d2 >= d1, d2 - d1).otherwise(F.date_diff(b, F.date_add(back, d1 - 1)))
    turned = F.add_months(a, (y2 - y1) * 12)
    yd = F.when(turned <= b, F.date_diff(b, turned)).otherwise(F.date_diff(b, F.add_months(a, (y2 - y1 - 1) * 12)))
    out = F.when(u == "D", F.date_diff(b, a)).when(u == "M", months).when(u == "Y", F.floor(months / 12)).when(u == "YM", months % 12).when(u == "MD", md).when(u == "YD", yd)
    return out.cast("double"), (a > b, NUM), (~u.isin("D", "M", "Y", "YM", "MD", "YD"), NUM)


#: Weekend numbers 1 to 7 and 11 to 17 as masks from Monday (fixed values).
WEEKENDS = {1: "0000011", 2: "1000001", 3: "1100000", 4: "0110000", 5: "0011000", 6: "0001100", 7: "0000110", 11: "0000001", 12: "1000000", 13: "0100000", 14: "0010000", 15: "0001000", 16: "0000100", 17: "0000010"}


def _mask(weekend: V) -> tuple[Column, Column]:
    """A seven-character mask from Monday on, and where it is not one."""
    named = reduce(lambda acc, kv: acc.when(F.floor(number(weekend).v) == kv[0], F.lit(kv[1])), list(WEEKENDS.items())[1:], F.when(F.floor(number(weekend).v) == 1, F.lit(WEEKENDS[1]))) if weekend.t != "t" else weekend.v
    return named, ~F.coalesce(named.rlike("^[01]{7}$") & (named != "1111111"), F.lit(False))


def working_days(a: Column, b: Column, mask: Column, holidays: Column) -> Column:
    """Days from a to b inclusive that are neither weekend nor holiday, a <= b: whole weeks in closed form, at most six days one by one."""
    off = F.length(F.replace(mask, F.lit("0"), F.lit("")))
    n = F.date_diff(b, a) + 1
    weeks = F.floor(n / 7)
    rest = F.filter(F.sequence(F.lit(0), F.lit(5)), lambda i: i < n - weeks * 7)
    open_day = lambda d: F.substring(mask, F.weekday(d) + 1, F.lit(1)) == "0"
    more = F.size(F.filter(rest, lambda i: open_day(F.date_add(a, i))))
    shut = F.size(F.filter(F.array_distinct(holidays), lambda h: h.between(a, b) & open_day(h)))
    return weeks * (7 - off) + more - shut


def _holidays(rest: list[V]) -> Column:
    return F.array(*[date(h).v for h in rest]).cast("array<date>") if rest else F.array().cast("array<date>")


def _networkdays(a: V, b: V, mask: Column, bad: Column | None, rest: list[V]) -> V:
    lo, hi = F.least(a.v, b.v), F.greatest(a.v, b.v)
    out = working_days(lo, hi, mask, _holidays(rest)) * F.when(a.v <= b.v, 1).otherwise(-1)
    return V(out.cast("double"), "n", first_error(a.e, b.e, *[h.e for h in rest], F.when(bad, F.lit(VALUE)) if bad is not None else None))


@register("NETWORKDAYS", "scalar", "ddd+", "V", least=2)
def _networkdays_plain(a, b, *rest):
    return _networkdays(a, b, F.lit(WEEKENDS[1]), None, list(rest))


@register("NETWORKDAYS.INTL", "scalar", "dd*d+", "V", least=2)
def _networkdays_intl(a, b, weekend=None, *rest):
    mask, bad = _mask(weekend) if weekend is not None else (F.lit(WEEKENDS[1]), None)
    return _networkdays(a, b, mask, bad, list(rest))


def _workday(a: V, n: V, mask: Column, bad: Column | None, rest: list[V]) -> V:
    """Whole weeks in closed form, then day by day: a bounded search over at most two weeks and the holidays' days."""
    step = F.signum(n.v).cast("int")
    todo = F.floor(F.abs(n.v)).cast("int")
    per_week = 7 - F.length(F.replace(mask, F.lit("0"), F.lit("")))
    holidays = _holidays(rest)
    weeks = F.greatest(F.floor((todo - 1) / per_week) - 1, F.lit(0)).cast("int")
    jump = F.date_add(a.v, (weeks * 7 * step).cast("int"))
    open_day = lambda d: (F.substring(mask, F.weekday(d) + 1, F.lit(1)) == "0")
    shut = F.size(F.filter(F.array_distinct(holidays), lambda h: F.when(step >= 0, (h > a.v) & (h <= jump)).otherwise((h < a.v) & (h >= jump)) & open_day(h)))
    left = todo - weeks * per_week + shut
    span = 21 + 7 * (1 + len(rest))
    days = F.transform(F.sequence(F.lit(1), F.lit(span)), lambda i: F.date_add(jump, (i * step).cast("int")))
    good = F.filter(days, lambda d: open_day(d) & ~F.coalesce(F.array_contains(holidays, d), F.lit(False)))
    out = F.when(todo == 0, a.v).otherwise(F.try_element_at(good, left))
    return V(out, "d", first_error(a.e, n.e, F.when(bad, F.lit(VALUE)) if bad is not None else None))


@register("WORKDAY", "scalar", "dnd+", "V", least=2)
def _workday_plain(a, n, *rest):
    return _workday(a, n, F.lit(WEEKENDS[1]), None, list(rest))


@register("WORKDAY.INTL", "scalar", "dn*d+", "V", least=2)
def _workday_intl(a, n, weekend=None, *rest):
    mask, bad = _mask(weekend) if weekend is not None else (F.lit(WEEKENDS[1]), None)
    return _workday(a, n, mask, bad, list(rest))
