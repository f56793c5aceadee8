"""Number formats compiled on the driver: a constant format code becomes one column expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.core import general
from ..functions.maths import _scaled

_DATE = re.compile(r"(?i)\[?(?:yyyy|yyy|yy|y|mmmmm|mmmm|mmm|mm|m|dddd|ddd|dd|d|hh|h|ss|s|am/pm|a/p)\]?")
_DATE_PIECE = re.compile(r'(?i)"[^"]*"|\\.|yyyy|yyy|yy|y|mmmmm|mmmm|mmm|mm|m|dddd|ddd|dd|d|hh|h|ss|s|am/pm|a/p|.')


def sections(code: str) -> list[str]:
    return re.findall(r'(?:"[^"]*"|\\.|[^;"\\])+|(?<=;)(?=;|$)', code) or [""]


def is_date(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code)
    return bool(re.search(r"(?i)[ymdhs]", bare)) and not re.search(r"[0#?]", bare)


def _literal(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", re.sub(r'"([^"]*)"', r"\1", re.sub(r"_.|\*.|\[[^\]]*\]", "", text)))


def number_section(n: Column, code: str) -> Column:
    """A section with digit places: decimals, thousands, percent, scaling commas, exponent and literal text around."""
    m = re.search(r"[0#?][0#?,.]*(?:[eE][+-]0+)?|\.[0#?]+", code)
    if not m:
        return F.lit(_literal(code))
    body, head, tail = m.group(), code[: m.start()], code[m.end() :]
    percent = re.sub(r'"[^"]*"|\\.', "", code).count("%")
    x = n * F.lit(100.0**percent) if percent else n
    sci = re.search(r"[eE]([+-])(0+)$", body)
    if sci:
        places = len(re.search(r"\.([0#?]*)", body).group(1)) if "." in body else 0
        raw = F.format_string(f"%.{places}E", x)
        mantissa, power = F.substring_index(raw, "E", 1), F.substring_index(raw, "E", -1).cast("int")
        sign = F.when(power < 0, F.lit("-")).otherwise(F.lit("+" if sci[1] == "+" else ""))
        out = F.concat(mantissa, F.lit("E"), sign, F.lpad(F.abs(power).cast("string"), len(sci[2]), "0"))
        return F.concat(F.lit(_literal(head)), out, F.lit(_literal(tail)))
    scale = len(body) - len(body.rstrip(","))
    body = body.rstrip(",")
    if scale:
        x = x / F.lit(1000.0**scale)
    whole, _, frac = body.partition(".")
    r = _scaled(x, F.lit(float(len(frac))), lambda y: F.floor(y + 0.5))
    text = F.format_number(F.abs(r).cast("decimal(38,15)"), len(frac))
    ints, decs = F.substring_index(text, ".", 1), F.substring_index(text, ".", -1)
    if "," not in whole:
        ints = F.replace(ints, F.lit(","), F.lit(""))
    least = whole.replace(",", "").count("0")
    ints = F.when(ints == "0", F.lit("")).otherwise(ints) if least == 0 else F.lpad(ints, F.greatest(F.length(ints), F.lit(least)), F.lit("0"))
    if frac:
        keep = len(frac.rstrip("#"))
        tailing = F.regexp_replace(F.substring(decs, F.lit(keep + 1), F.lit(len(frac))), "0+$", "")
        decs = F.concat(F.substring(decs, F.lit(1), F.lit(keep)), tailing)
        out = F.concat(ints, F.lit("."), decs)
    else:
        out = ints
    return F.concat(F.lit(_literal(head)), out, F.lit(_literal(tail)))


def date_section(d: Column, seconds: Column, code: str) -> Column:
    """A date and time section; m after an hour or before seconds is minutes."""
    pieces = _DATE_PIECE.findall(re.sub(r"\[[^\]]*\]", "", code))
    low = [p.lower() for p in pieces]
    half = any(p in ("am/pm", "a/p") for p in low)
    units = [p for p in low if re.fullmatch(r"y+|m+|d+|h+|s+", p)]
    hour = F.floor(seconds / 3600)
    shown = F.when(hour % 12 == 0, 12).otherwise(hour % 12) if half else hour
    pad = lambda c, k: F.lpad(c.cast("string"), k, "0")
    out, seen = [], -1
    for p, piece in zip(low, pieces, strict=True):
        if not re.fullmatch(r"y+|m+|d+|h+|s+|am/pm|a/p", p):
            out.append(F.lit(_literal(piece)))
            continue
        if p in ("am/pm", "a/p"):
            out.append(F.when(hour < 12, F.lit("AM" if p == "am/pm" else "A")).otherwise(F.lit("PM" if p == "am/pm" else "P")))
            continue
        seen += 1
        minutes = p in ("m", "mm") and ((seen > 0 and units[seen - 1][0] == "h") or (seen + 1 < len(units) and units[seen + 1][0] == "s"))
        if minutes:
            c = F.floor(seconds / 60) % 60
            out.append(pad(c, 2) if p == "mm" else c.cast("string"))
        else:
            out.append(
                {
                    "yyyy": lambda: pad(F.year(d), 4), "yyy": lambda: pad(F.year(d), 4), "y": lambda: pad(F.year(d) % 100, 2), "yy": lambda: pad(F.year(d) % 100, 2), "mmmmm": lambda: F.left(F.date_format(d, "MMMM"), F.lit(1)), "mmmm": lambda: F.date_format(d, "MMMM"),
                    "mmm": lambda: F.date_format(d, "MMM"), "mm": lambda: pad(F.month(d), 2), "m": lambda: F.month(d).cast("string"), "dddd": lambda: F.date_format(d, "EEEE"), "ddd": lambda: F.date_format(d, "EEE"),
                    "dd": lambda: pad(F.dayofmonth(d), 2), "d": lambda: F.dayofmonth(d).cast("string"), "hh": lambda: pad(shown, 2), "h": lambda: shown.cast("string"), "ss": lambda: pad(seconds % 60, 2), "s": lambda: (seconds % 60).cast("string"),
                }[p]()
            )
    return F.concat(*out) if out else F.lit("")


def impossible(code: str) -> bool:
    """Whether a section mixes digit places with date letters outside quotes, which no value fits."""
    bare = [re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|[eE][+-]', "", p) for p in sections(code)]
    return any(re.search(r"[0#?]", b) and re.search(r"(?i)[ymdhs]", b) for b in bare)


def format_value(n: Column, code: str, text: Column | None = None) -> Column:
    """TEXT: sections for positive, negative, zero and text values; General where the code says so."""
    if code.strip().lower() in ("general", ""):
        return general(n) if code.strip() else F.lit("")
    parts = sections(code)
    # Whole seconds first, so that what rounds up to midnight is the next day; serials under 60 count from a day later.
    total = F.floor(n * 86400 + 0.5)
    day = F.floor(total / 86400).cast("int")
    d = F.date_add(F.lit("1899-12-30").cast("date"), F.when(day < 60, day + 1).otherwise(day))
    seconds = total - F.floor(total / 86400) * 86400

    def one(x: Column, part: str) -> Column:
        if is_date(part):
            return F.when(n >= 0, F.when(day == 0, F.lit("1900-01-00") if part.lower() == "yyyy-mm-dd" else date_section(d, seconds, part)).otherwise(date_section(d, seconds, part)))
        return number_section(x, part) if part.lower() != "general" else general(x)

    minus = F.concat(F.lit("-"), one(F.abs(n), parts[0])) if not is_date(parts[0]) else one(n, parts[0])
    negative = one(F.abs(n), parts[1]) if len(parts) > 1 else minus
    zero = one(n, parts[2]) if len(parts) > 2 else one(n, parts[0])
    return F.when(n < 0, negative).when(n == 0, zero).otherwise(one(n, parts[0]))
