import datetime

import pytest
from pyspark.sql import functions as F

from tessella.operators import criteria, database, editing, lookup, models, ranking, relational
from tessella.plans import recalc


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame([("7", 7.0), ("x", 1.0), ("", None), (None, -3.0), ("Apple", 2.5), ("ap*", 0.0)], "t string, n double")


@pytest.mark.parametrize(("column", "criterion", "n"), [("t", 7, 1), ("t", "=7", 1), ("t", "<>7", 6), ("t", "", 2), ("t", "ap*", 2), ("t", "ap~*", 1), ("t", "apple", 1), ("t", ">a", 3), ("n", ">0", 3), ("n", "<>0", 5), ("n", "", 1), ("n", "abc", 0), ("n", "=", 1), ("n", "<>", 5)])
def test_criteria(mixed, column, criterion, n):
    assert mixed.where(criteria.all_of(mixed, [(column, criterion)])).count() == n


def test_criteria_grid_is_another_language(mixed):
    hits = lambda rows: mixed.where(criteria.grid(mixed, rows)).count()
    assert hits([{"t": "ap"}]) == 2  # bare text is a prefix
    assert hits([{"t": "=ap"}]) == 0
    assert hits([{"n": ">2"}, {"t": "x"}]) == 3
    assert hits([{"nope": "1"}]) == 0 and hits([{"n": ""}]) == 6


def test_dget(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0)], "k string, v double")
    code = lambda rows: df.agg(database.value(df, "DGET", "v", rows).struct().alias("r")).first()["r"]
    assert code([{"k": "a"}])["v"] == 1.0
    assert code([{"k": "z"}])["e"] == "#VALUE!" and code([{"k": "b"}])["e"] == "#NUM!"


def test_lookup_first_last_and_missing(spark):
    left = spark.createDataFrame([("A",), ("z",), (None,)], "k string")
    table = spark.createDataFrame([("a", 1, "one"), ("a", 2, "two"), (None, 3, "null")], "key string, row int, v string")
    first = {r["k"]: r["v"] for r in lookup.lookup(left, "k", table, "key", ["v"], ["row"], if_missing={"v": "none"}).collect()}
    assert first == {"A": "one", "z": "none", None: "none"}
    assert lookup.lookup(left, "k", table, "key", ["v"], ["row"], last=True).where("k = 'A'").first()["v"] == "two"


def test_as_of_ties_and_edges(spark):
    left = spark.createDataFrame([(1, 5.0), (2, 0.5), (3, None), (4, 3.0)], "id int, at double")
    table = spark.createDataFrame([(1.0, 1, "a"), (3.0, 2, "b"), (3.0, 3, "c"), (None, 4, "n")], "key double, row int, v string")
    got = lambda **k: {r["id"]: r["v"] for r in lookup.as_of(left, "at", table, "key", ["v"], order="row", **k).collect()}
    assert got() == {1: "c", 2: None, 3: None, 4: "c"}
    assert got(first_tie=True)[1] == "b"
    assert got(forward=True) == {1: None, 2: "a", 3: None, 4: "c"}


def test_numbered_is_dense(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    rows = relational.numbered(df, F.col("k")).collect()
    assert all(r["k"] == r["row_id"] for r in rows)


def test_filter_if_empty(spark):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    assert relational.filter_rows(df, F.col("i") > 5, (0, "none")).collect() == [(0, "none")]
    assert relational.filter_rows(df, F.col("i") == 1, (0, "none")).collect() == [(1, "a")]


def test_unique_ignores_case(spark):
    df = spark.createDataFrame([(1, "b"), (2, "B"), (3, "a")], "i int, s string")
    assert sorted(relational.unique(df, ["s"], ["i"]).collect()) == [(1, "b"), (3, "a")]
    assert relational.unique(df, ["s"], ["i"], exactly_once=True).collect() == [(3, "a")]


def test_rank_matches_window(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 101).cast("double").alias("v"))
    from pyspark.sql import Window as W

    want = sorted(df.select("v", F.rank().over(W.orderBy(F.desc("v"))).cast("double").alias("rank")).collect())
    assert sorted(ranking.rank(df, "v").collect()) == want


def test_linest_two_regressors(spark):
    df = spark.createDataFrame([("g", 1.0 + 2 * a - 3 * b, float(a), float(b)) for a in range(5) for b in range(4)], "g string, y double, a double, b double")
    r = models.linest(df, "y", ["a", "b"], ["g"]).first()
    assert round(r["a"], 9) == 2 and round(r["b"], 9) == -3 and round(r["intercept"], 9) == 1 and round(r["r2"], 9) == 1


def test_inverse_and_determinant(spark):
    m = spark.createDataFrame([("m", 0, 0, 1.0), ("m", 0, 1, 2.0), ("m", 1, 0, 3.0), ("m", 1, 1, 4.0)], "id string, i long, j long, value double")
    assert round(models.matrix_determinant(m, "id").first()["det"], 9) == -2
    product = models.matrix_product(m, models.matrix_inverse(m, "id"))
    assert {(r["i"], r["j"]): round(r["value"], 9) + 0 for r in product.collect()} == {(0, 0): 1, (0, 1): 0, (1, 0): 0, (1, 1): 1}


def test_xirr(spark):
    d = datetime.date
    flows = [(-10000.0, d(2008, 1, 1)), (2750.0, d(2008, 3, 1)), (4250.0, d(2008, 10, 30)), (3250.0, d(2009, 2, 15)), (2750.0, d(2009, 4, 1))]
    df = spark.createDataFrame([("a", *f) for f in flows] + [("b", 1.0, d(2020, 1, 1))], "k string, v double, d date")
    got = {r["k"]: r["irr"] for r in models.irr(df, "v", ["k"], ["d"], date="d").collect()}
    assert round(got["a"], 6) == 0.373363 and got["b"] is None


def test_editing(spark):
    cells = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 1, "c")], "row long, col long, value string")
    assert sorted(r["row"] for r in editing.delete(cells, "row", 2).collect()) == [1, 2]
    moved = editing.move_range(cells, 1, 1, 1, 1, 2, 0).collect()
    assert sorted((r["row"], r["value"]) for r in moved) == [(2, "b"), (3, "a")]
    edits = spark.createDataFrame([(1, 1, None), (9, 9, "new")], "row long, col long, value string")
    assert sorted(r["value"] for r in editing.update(cells, edits).collect()) == ["b", "c", "new"]
    merges = spark.createDataFrame([("A1:B2", 1, 2, 1, 2), ("B2:C3", 2, 3, 2, 3)], "ref string, top int, bottom int, left int, right int")
    assert [r["code"] for r in editing.validate(cells, merges).collect()] == ["overlapping_merge"]
    assert editing.repair(cells.unionByName(cells).withColumn("n", F.monotonically_increasing_id()), "n").count() == 3


def test_recalculation_reports(spark):
    df = spark.createDataFrame([(2.0,)], "x double")
    out, reports = recalc.recalculate(df, {"c": "=b+1", "b": "=x*2", "p": "=q", "q": "=p", "u": "=missing+1", "v": "=u", "bad": "=1+"})
    assert out.first()["c"] == 5.0
    assert {r.name: r.status for r in reports} == {"c": "computed", "b": "computed", "p": "cycle", "q": "cycle", "u": "fallback", "v": "fallback", "bad": "fallback"}
    graph = recalc.edges(spark, {"c": "=b+1", "b": "=x*2"})
    assert {(r["name"], r["depth"]) for r in recalc.reachable(graph, ["c"]).collect()} == {("b", 1), ("x", 2)}


def test_reachable_follows_a_long_chain(spark):
    graph = spark.createDataFrame([(f"f{k}", f"f{k + 1}") for k in range(104)] + [("f104", "f103")], "formula string, needs string").coalesce(1)
    assert {(r["name"], r["depth"]) for r in recalc.reachable(graph, ["f0"]).collect()} == {(f"f{k}", k) for k in range(1, 105)}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert ranking.rank(df, "v").count() == 0
    assert relational.unique(df).count() == 0
    assert relational.numbered(df, F.col("k")).count() == 0
    assert lookup.as_of(df, "v", df.toDF("k2", "v2"), "v2", ["k2"]).count() == 0


def test_numbering_is_of_one_run(spark):
    """Enough rows that the bounds of ranges are sampled, not exact."""
    df = spark.range(300_000).select(((F.col("id") * 48_271) % 299_993).alias("k"), "id")
    rows = relational.numbered(df, F.col("k"), F.col("id"), parts=7)
    s = rows.agg(F.countDistinct("row_id").alias("d"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi")).first()
    assert tuple(s) == (300_000, 0, 299_999)
    from pyspark.sql import Window as W

    ordered = rows.withColumn("before", F.lag("k").over(W.orderBy("row_id")))
    assert ordered.where("before > k").count() == 0
