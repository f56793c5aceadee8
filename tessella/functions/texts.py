"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import V, aggregate, first_error, register, scalar, text
from .maths import _scaled

VALUE, NUM, NA = "#VALUE!", "#NUM!", "#N/A"
MOST = 32_767  # characters of a cell (fixed value)


@scalar("LEFT LEFTB", "tn", "t", defaults=(1,))
def _left(t, n):
    return F.substring(t, F.lit(1), F.floor(n).cast("int")), (n < 0, VALUE)


@scalar("RIGHT RIGHTB", "tn", "t", defaults=(1,))
def _right(t, n):
    k = F.least(F.floor(n).cast("int"), F.length(t))
    return F.substring(t, F.length(t) - k + 1, k), (n < 0, VALUE)


@scalar("MID MIDB", "tnn", "t")
def _mid(t, start, n):
    return F.substring(t, F.floor(start).cast("int"), F.floor(n).cast("int")), ((start < 1) | (n < 0), VALUE)


@scalar("LEN LENB", "t")
def _len(t):
    """UTF-16 units, so a character beyond the basic plane counts twice."""
    return (F.octet_length(F.encode(t, "UTF-16BE")) / 2).cast("double")


@scalar("TRIM", "t", "t")
def _trim(t):
    return F.trim(F.regexp_replace(t, " +", " "))


@scalar("CLEAN", "t", "t")
def _clean(t):
    return F.regexp_replace(t, r"[\x00-\x1F]", "")


scalar("UPPER", "t", "t")(F.upper)
scalar("LOWER", "t", "t")(F.lower)


@scalar("PROPER", "t", "t")
def _proper(t):
    """A letter after anything but a letter is upper case."""
    runs = F.regexp_extract_all(t, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def _found(at: Column):
    return at.cast("double"), (at == 0, VALUE)


@scalar("FIND FINDB", "ttn", defaults=(1,))
def _find(sub, t, start):
    s = F.floor(start).cast("int")
    at = F.instr(F.substring(t, s, F.length(t)), sub)
    return F.when(at > 0, at + s - 1).otherwise(F.lit(0)).cast("double"), ((start < 1) | (start > F.length(t) + 1), VALUE), (at == 0, VALUE)


def wildcard_regex(pattern: Column, whole: bool) -> Column:
    """A Java pattern for `*`, `?` and the escape `~`; everything else stands for itself, without case."""
    quoted = F.regexp_replace(pattern, r"([\\.\[\]{}()+^$|])", r"\\$1")
    kept = F.replace(F.replace(F.replace(quoted, F.lit("~~"), F.lit("\x01")), F.lit("~*"), F.lit("\x02")), F.lit("~?"), F.lit("\x03"))
    wild = F.replace(F.replace(kept, F.lit("*"), F.lit(".*" if whole else ".*?")), F.lit("?"), F.lit("."))
    back = F.replace(F.replace(F.replace(wild, F.lit("\x01"), F.lit("~")), F.lit("\x02"), F.lit(r"\*")), F.lit("\x03"), F.lit(r"\?"))
    return F.concat(F.lit("(?is)^" if whole else "(?is)"), back, F.lit("$" if whole else ""))


@scalar("SEARCH SEARCHB", "ttn", defaults=(1,))
def _search(sub, t, start):
    s = F.floor(start).cast("int")
    at = F.regexp_instr(F.substring(t, s, F.length(t)), wildcard_regex(sub, False))
    return (at + s - 1).cast("double"), ((start < 1) | (start > F.length(t) + 1), VALUE), (at == 0, VALUE)


@register("SUBSTITUTE", "scalar", "tttn", "V", defaults=(None,))
def _substitute(t, old, new, nth):
    every = F.when(F.length(old.v) == 0, t.v).otherwise(F.replace(t.v, old.v, new.v))
    parts = F.split(t.v, F.concat(F.lit("\\Q"), old.v, F.lit("\\E")), -1)
    k = F.floor(nth.v).cast("int")
    head = F.aggregate(F.slice(parts, F.lit(2), F.greatest(k - 1, F.lit(0))), F.element_at(parts, 1), lambda a, x: F.concat(a, old.v, x))
    tail = F.aggregate(F.slice(parts, k + 2, F.greatest(F.size(parts) - k - 1, F.lit(0))), F.try_element_at(parts, k + 1), lambda a, x: F.concat(a, old.v, x))
    one = F.when((F.size(parts) <= k) | (F.length(old.v) == 0), t.v).otherwise(F.concat(head, new.v, tail))
    return V(F.when(nth.v.isNull(), every).otherwise(one), "t", first_error(t.e, old.e, new.e, nth.e, F.when(nth.v < 1, F.lit(VALUE))))


@scalar("REPLACE REPLACEB", "tnnt", "t")
def _replace(t, start, n, new):
    s, k = F.floor(start).cast("int"), F.floor(n).cast("int")
    return F.concat(F.substring(t, F.lit(1), s - 1), new, F.substring(t, s + k, F.greatest(F.length(t), F.lit(1)))), ((start < 1) | (n < 0), VALUE)


_HALF = "".join(map(chr, range(0x21, 0x7F)))
_FULL = "".join(map(chr, range(0xFF01, 0xFF5F)))


@scalar("ASC", "t", "t")
def _asc(t):
    return F.translate(t, _FULL + "　", _HALF + " ")


@scalar("DBCS", "t", "t")
def _dbcs(t):
    return F.translate(t, _HALF + " ", _FULL + "　")


@scalar("VALUE", "t")
def _value(t):
    s = F.trim(t)
    pct = F.when(s.rlike(r"^[-+]?[\d,.]+%$"), F.regexp_replace(s, "[,%]", "").try_cast("double") / 100)
    plain = F.when(s.rlike(r"^[-+]?(\d{1,3}(,\d{3})+(\.\d*)?|\d*\.?\d*([eE][-+]?\d+)?)$"), F.replace(s, F.lit(","), F.lit("")).try_cast("double"))
    day = F.when(s.rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$"), F.date_diff(F.replace(s, F.lit("/"), F.lit("-")).try_cast("date"), F.lit("1899-12-30").cast("date")).cast("double"))
    out = F.coalesce(plain, pct, day, time_fraction(s))
    return out, (out.isNull() & t.isNotNull(), VALUE)


def time_fraction(s: Column) -> Column:
    """H:MM[:SS] with AM or PM as a fraction of a day; null for other text."""
    p = r"^(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?\s*([AaPp][Mm])?$"
    part = lambda k: F.regexp_extract(s, p, k).try_cast("double")
    half = F.upper(F.regexp_extract(s, p, 4))
    h = F.when(half == "AM", part(1) % 12).when(half == "PM", part(1) % 12 + 12).otherwise(part(1))
    return F.when(s.rlike(p) & (part(2) < 60), ((h * 3600 + part(2) * 60 + F.coalesce(part(3), F.lit(0.0))) / 86400) % 1)


@scalar("TIMEVALUE", "t")
def _timevalue(t):
    out = time_fraction(F.trim(t))
    return out, (out.isNull() & t.isNotNull(), VALUE)


@scalar("NUMBERVALUE", "ttt", defaults=(".", ","))
def _numbervalue(t, dec, group):
    s = F.regexp_replace(t, r"\s", "")
    n_pct = F.length(s) - F.length(F.rtrim(s, F.lit("%")))
    body = F.replace(F.rtrim(s, F.lit("%")), F.substring(group, 1, 1), F.lit(""))
    out = F.replace(body, F.substring(dec, 1, 1), F.lit(".")).try_cast("double") / F.pow(F.lit(100.0), n_pct)
    return F.when(s == "", F.lit(0.0)).otherwise(out), (out.isNull() & t.isNotNull() & (s != ""), VALUE)


@scalar("CONCATENATE CONCAT", "t+", "t", least=1)
def _concatenate(*t):
    joined = F.concat(*[F.coalesce(x, F.lit("")) for x in t])
    return joined, (F.length(joined) > MOST, VALUE)


@register("TEXTJOIN", "scalar", "tbt+", "V", least=3)
def _textjoin(delim, skip, *t):
    """Over scalars; a range joins its rows in order, see `operators.relational.text_join`."""
    parts = F.array(*[F.coalesce(x.v, F.lit("")) for x in t])
    kept = F.when(skip.v, F.filter(parts, lambda x: x != "")).otherwise(parts)
    joined = F.aggregate(F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 1, F.lit(0))), F.coalesce(F.try_element_at(kept, F.lit(1)), F.lit("")), lambda a, x: F.concat(a, delim.v, x))
    return V(joined, "t", first_error(delim.e, skip.e, *[x.e for x in t], F.when(F.length(joined) > MOST, F.lit(VALUE))))


@scalar("REPT", "tn", "t")
def _rept(t, n):
    k = F.floor(n).cast("int")
    return F.when(k * F.length(t) <= MOST, F.repeat(t, k)), ((n < 0) | (k * F.length(t) > MOST), VALUE)


@scalar("EXACT", "tt", "b")
def _exact(a, b):
    return a == b


@scalar("CHAR", "n", "t")
def _char(n):
    return F.decode(F.unhex(F.lpad(F.hex(F.floor(n).cast("long")), 2, "0")), "ISO-8859-1"), ((n < 1) | (n >= 256), VALUE)


@scalar("UNICHAR", "n", "t")
def _unichar(n):
    k = F.floor(n).cast("long")
    return F.decode(F.unhex(F.lpad(F.hex(k), 8, "0")), "UTF-32"), ((n < 1) | (n >= 1_114_112) | k.between(0xD800, 0xDFFF), VALUE)


def code_point(t: Column) -> Column:
    return F.conv(F.hex(F.encode(F.substring(t, 1, 1), "UTF-32")), 16, 10).cast("double")


@scalar("CODE UNICODE", "t")
def _code(t):
    return code_point(t), (F.length(t) == 0, VALUE)


def _delimited(after: bool):
    def build(t, delim, n, mode, end, missing):
        """Text before or after the n-th delimiter, counted from the end if n < 0."""
        s, d = t.v, delim.v
        fold = mode.v != 0
        quoted = F.concat(F.when(fold, F.lit("(?i)")).otherwise(F.lit("")), F.lit("\\Q"), d, F.lit("\\E"))
        parts = F.split(s, quoted, -1)
        k, size = F.floor(n.v).cast("int"), F.size(parts)
        # The n-th delimiter starts where the first n parts and n - 1 delimiters end.
        at = F.when(k > 0, k).otherwise(size + k)
        length = lambda upto: F.aggregate(F.slice(parts, F.lit(1), F.greatest(upto, F.lit(0))), F.lit(0), lambda a, x: a + F.length(x))
        start = length(at) + (at - 1) * F.length(d)
        found = (at >= 1) & (at < size) & (F.length(d) > 0)
        at_end = (end.v != 0) & F.when(k > 0, at == size).otherwise(at == 0)
        if after:
            hit, edge = F.substring(s, start + F.length(d) + 1, F.greatest(F.length(s), F.lit(1))), F.when(k > 0, F.lit("")).otherwise(s)
        else:
            hit, edge = F.substring(s, F.lit(1), start), F.when(k > 0, s).otherwise(F.lit(""))
        empty = F.length(d) == 0
        edge = F.when(empty, F.when((k > 0) == F.lit(after), s).otherwise(F.lit(""))).otherwise(edge)
        out = F.when(found, hit).when(at_end | empty, edge).otherwise(missing.v)
        lost = ~found & ~at_end & ~empty & missing.v.isNull()
        return V(out, "t", first_error(t.e, delim.e, n.e, F.when((k == 0) | (F.abs(n.v) > F.length(s)), F.lit(VALUE)), F.when(lost, F.lit(NA))))

    return build


register("TEXTBEFORE", "scalar", "ttnnnt", "V", defaults=(1, 0, 0, None))(_delimited(False))
register("TEXTAFTER", "scalar", "ttnnnt", "V", defaults=(1, 0, 0, None))(_delimited(True))


def grouped(n: Column, decimals: Column, commas: Column | bool = True) -> Column:
    """A number with a fixed count of decimals (rounded half away from zero) and thousands separators; negative counts round left of the point."""
    d = F.floor(decimals).cast("int")
    r = _scaled(n, d, lambda y: F.floor(y + 0.5))
    keep = F.greatest(d, F.lit(0))
    with_commas = F.element_at(F.array(*[F.format_number(r.cast("decimal(38,10)"), k) for k in range(11)]), F.least(keep, F.lit(10)) + 1)
    return with_commas if commas is True else F.when(commas, with_commas).otherwise(F.replace(with_commas, F.lit(","), F.lit("")))


@scalar("FIXED", "nnb", "t", defaults=(2, False))
def _fixed(n, d, plain):
    return grouped(n, d, ~plain), (d >= 128, VALUE)


CURRENCY = "₹ "  # of the default locale (fixed value)


@scalar("DOLLAR", "nn", "t", defaults=(2,))
def _dollar(n, d):
    body = grouped(F.abs(n), d)
    return F.when(n < 0, F.concat(F.lit("-" + CURRENCY), body)).otherwise(F.concat(F.lit(CURRENCY), body))


@register("VALUETOTEXT", "scalar", "*n", "V", defaults=(0,))
def _valuetotext(v, fmt):
    t = text(v)
    strict = F.concat(F.lit('"'), F.replace(t.v, F.lit('"'), F.lit('""')), F.lit('"')) if v.t == "t" else t.v
    shown = F.when(fmt.v == 1, strict).otherwise(t.v)
    return V(F.coalesce(v.err(), shown), "t", F.when(~fmt.v.isin(0, 1), F.lit(VALUE)))


@scalar("ENCODEURL", "t", "t")
def _encodeurl(t):
    """RFC 3986."""
    return F.replace(F.replace(F.replace(F.url_encode(t), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


@scalar("ADDRESS", "nnnbt", "t", defaults=(1, True, ""))
def _address(row, col, kind, a1, sheet):
    k, r, c = F.floor(kind), F.floor(row).cast("long"), F.floor(col).cast("long")
    letters = column_letters(c)
    a = F.concat(F.when(k.isin(1, 3), F.lit("$")).otherwise(F.lit("")), letters, F.when(k.isin(1, 2), F.lit("$")).otherwise(F.lit("")), r.cast("string"))
    rc = lambda n, x, absolute: F.concat(F.lit(n), F.when(absolute, x.cast("string")).otherwise(F.concat(F.lit("["), x.cast("string"), F.lit("]"))))
    r1c1 = F.concat(rc("R", r, k.isin(1, 2)), rc("C", c, k.isin(1, 3)))
    plain = sheet.rlike(r"^[A-Za-z_][A-Za-z0-9_.]*$")
    prefix = F.when(sheet == "", F.lit("")).when(plain, F.concat(sheet, F.lit("!"))).otherwise(F.concat(F.lit("'"), F.replace(sheet, F.lit("'"), F.lit("''")), F.lit("'!")))
    return F.concat(prefix, F.when(a1, a).otherwise(r1c1)), ((row < 1) | (row > 1_048_576) | (col < 1) | (col > 16_384) | ~k.between(1, 4), VALUE)


def column_letters(n: Column) -> Column:
    """A, B … Z, AA …: up to three letters."""
    letter = lambda k: F.char(k.cast("int") + 65)
    a, b, c = n - 1, F.floor((n - 27) / 26), F.floor((n - 703) / 676)
    return F.concat(F.when(n > 702, letter(c % 26)).otherwise(F.lit("")), F.when(n > 26, letter(b % 26)).otherwise(F.lit("")), letter(a % 26))


_THAI = "ศูนย์ หนึ่ง สอง สาม สี่ ห้า หก เจ็ด แปด เก้า".split()  # digits 0 to 9 (fixed values)
_THAI_PLACE = ["", "สิบ", "ร้อย", "พัน", "หมื่น", "แสน"]  # units to hundred thousands (fixed values)
_CHINESE = {1: ("〇一二三四五六七八九", "十百千", "万亿"), 2: ("零壹贰叁肆伍陆柒捌玖", "拾佰仟", "万亿")}  # digits, places, groups (fixed values)


def _thai_group(digits: Column, more: Column) -> Column:
    """Up to six digits in words; `more` tells whether other digits precede them."""
    d = lambda k: F.substring(digits, k, 1)
    words = []
    for k in range(6):
        place = 5 - k
        name = F.element_at(F.array(*map(F.lit, _THAI)), d(k + 1).cast("int") + 1)
        if place == 1:
            name = F.when(d(k + 1) == "1", F.lit("")).when(d(k + 1) == "2", F.lit("ยี่")).otherwise(name)
        if place == 0:
            before = more | (F.substring(digits, 1, 5) != "00000")
            name = F.when((d(k + 1) == "1") & before, F.lit("เอ็ด")).otherwise(name)
        words.append(F.when(d(k + 1) == "0", F.lit("")).otherwise(F.concat(name, F.lit(_THAI_PLACE[place]))))
    return F.concat(*words)


def thai_words(n: Column) -> Column:
    """A whole number under 10^18 in Thai words."""
    s = F.lpad(n.cast("decimal(18,0)").cast("string"), 18, "0")
    high, mid, low = F.substring(s, 1, 6), F.substring(s, 7, 6), F.substring(s, 13, 6)
    zero = "000000"
    a = F.when(high == zero, F.lit("")).otherwise(F.concat(_thai_group(high, F.lit(False)), F.lit("ล้าน")))
    b = _thai_group(mid, high != zero)
    million = F.when((high == zero) & (mid == zero), F.lit("")).otherwise(F.concat(a, b, F.lit("ล้าน")))
    return F.when(n == 0, F.lit(_THAI[0])).otherwise(F.concat(million, _thai_group(low, (high != zero) | (mid != zero))))


@scalar("BAHTTEXT", "n", "t")
def _bahttext(n):
    cents = F.floor(F.abs(n) * 100 + 0.5)
    baht, satang = F.floor(cents / 100), cents % 100
    tail = F.when(satang == 0, F.lit("ถ้วน")).otherwise(F.concat(thai_words(satang), F.lit("สตางค์")))
    head = F.when((baht == 0) & (satang > 0), F.lit("")).otherwise(F.concat(thai_words(baht), F.lit("บาท")))
    return F.concat(F.when(n < 0, F.lit("ลบ")).otherwise(F.lit("")), head, tail), (F.abs(n) >= 1e15, VALUE)


def _chinese(n: Column, kind: int) -> Column:
    """Sixteen digits from the left: a zero is said once inside a number, each group of four has its unit."""
    digits, places, groups = _CHINESE[kind]
    names = F.array(*map(F.lit, digits))
    units = F.array(*map(F.lit, ["", *places]))
    of_group = F.array(*map(F.lit, ["", groups[0], groups[1], groups[0] + groups[1]]))
    s = F.lpad(n.cast("decimal(16,0)").cast("string"), 16, "0")
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("gap"))

    def step(a, k):
        d = F.substring(s, k + 1, F.lit(1))
        said = F.concat(a["out"], F.when(a["gap"] & (a["out"] != ""), F.lit(digits[0])).otherwise(F.lit("")), F.element_at(names, d.cast("int") + 1), F.element_at(units, (15 - k) % 4 + 1))
        now = F.when(d == "0", a["out"]).otherwise(said)
        ends = ((15 - k) % 4 == 0) & (F.substring(s, k - 2, F.lit(4)) != "0000")
        return F.struct(F.when(ends, F.concat(now, F.element_at(of_group, F.floor((15 - k) / 4).cast("int") + 1))).otherwise(now).alias("out"), (d == "0").alias("gap"))

    return F.when(n == 0, F.lit(digits[0])).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(15)), start, step, lambda a: a["out"]))


@scalar("NUMBERSTRING", "nn", "t")
def _numberstring(n, kind):
    whole = F.floor(n + 0.5)
    digits = "〇一二三四五六七八九"
    plain = F.translate(whole.cast("decimal(16,0)").cast("string"), "0123456789", digits)
    return F.when(kind == 1, _chinese(whole, 1)).when(kind == 2, _chinese(whole, 2)).otherwise(plain), ((n < 0) | (n >= 1e16) | ~F.floor(kind).isin(1, 2, 3), NUM)


@aggregate("ARRAYTOTEXT", "tn", "t", defaults=(0,))
def _arraytotext(t, strict):
    return F.array_join(F.collect_list(F.coalesce(t, F.lit(""))), ", ")
