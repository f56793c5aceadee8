"""Properties over generated inputs: wildcards, column letters, number text, and the parser's precedence."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.operators import criteria
from tessella.plans import compiler
from tessella.plans.parser import column_number, parse, reference, translate
from tessella.sources.workbook_writer import letters

words = st.text(alphabet="abAB*?~.%_\\ ", max_size=6)


def wild(pattern: str, text: str) -> bool:
    """An independent matcher by recursion."""
    if not pattern:
        return not text
    if pattern[0] == "~" and len(pattern) > 1 and pattern[1] in "*?~":
        return text[:1] == pattern[1] and wild(pattern[2:], text[1:])
    if pattern[0] == "*":
        return any(wild(pattern[1:], text[i:]) for i in range(len(text) + 1))
    return bool(text) and (pattern[0] == "?" or pattern[0] == text[0]) and wild(pattern[1:], text[1:])


def test_like_is_the_wildcard_language(spark):
    pairs = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(words, words)
    def collect(p, t):
        pairs.append((p.lower(), t.lower()))

    collect()
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(pairs)], "i int, t string")
    cond = F.coalesce(*[F.when(F.col("i") == i, F.col("t").like(criteria.like(p))) for i, (p, _) in enumerate(pairs[:150])], F.lit(None))
    got = {r["i"]: r["m"] for r in rows.where(F.col("i") < 150).select("i", cond.alias("m")).collect()}
    assert got == {i: wild(p, t) for i, (p, t) in enumerate(pairs[:150])}


@given(st.integers(1, 16_384))
@settings(database=None)
def test_column_letters(n):
    assert column_number(letters(n)) == n


@given(st.integers(1, 1000), st.integers(1, 300), st.integers(-5, 50), st.integers(-5, 50))
@settings(database=None)
def test_translation_moves_references(row, col, down, right):
    text = translate(f"={letters(col)}{row}", down, right)
    if row + down < 1 or col + right < 1:
        assert text == "=#REF!"
    else:
        r = reference(text[1:])
        assert (r.top, r.left) == (row + down, col + right)
        assert translate(text, -down, -right) == f"={letters(col)}{row}"


def test_arithmetic_like_python(spark):
    formulas = []

    @settings(max_examples=80, deadline=None, database=None)
    @given(st.lists(st.tuples(st.integers(1, 9), st.sampled_from("+-*/")), min_size=1, max_size=6), st.integers(1, 9))
    def collect(parts, last):
        formulas.append("".join(f"{n}{op}" for n, op in parts) + str(last))

    collect()
    df = spark.range(1)
    row = df.select(*[compiler.row(df, "=" + f).sql().alias(f"c{i}") for i, f in enumerate(formulas)]).first()
    for i, f in enumerate(formulas):
        assert abs(row[f"c{i}"] - eval(f)) < 1e-9 * max(1, abs(eval(f)))  # noqa: S307


def test_parser_takes_what_it_should():
    assert repr(parse("=1+2*3")) == repr(parse("=1+(2*3)")) and repr(parse("=-2^2")) == repr(parse("=(-2)^2"))
    assert re.match("Call", repr(parse('=_xlfn.XLOOKUP(A1,B:B,C:C,"none",0,-1)')))
