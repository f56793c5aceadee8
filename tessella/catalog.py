"""Every query that the engine registers, with its SQL for an independent engine.

A query is (frames of its tables) -> DataFrame; the SQL answers the same question in
plain terms. Sums of doubles are rounded on both sides, as their order is free.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_functions
from .operators import criteria, database, editing, lookup, models, ranking, relational
from .plans import compiler, recalc
from .sources import delimited, workbook, workbook_writer
from .storage import shared_dir
from .streaming import windows

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(*tables: str, sql: str | None = None):
    """Register a function of the frames of `tables` under its own name."""

    def wrap(f: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return wrap


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | catalog_functions.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | catalog_functions.oracle_sql()


def _r(c, digits: int = 4):
    return F.round(c, digits)


# Aggregation.


@query("lineitem", sql="SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, CAST(count(*) AS DOUBLE) AS n_rows FROM lineitem GROUP BY ALL")
def pricing_summary(li):
    out = compiler.aggregate(li, ["l_returnflag", "l_linestatus"], sum_qty="=SUM(l_quantity)", sum_price="=SUM(l_extendedprice)", revenue="=SUMPRODUCT(l_extendedprice, 1-l_discount)", avg_disc="=AVERAGE(l_discount)", n_rows="=COUNT(l_quantity)")
    return out.select("l_returnflag", "l_linestatus", _r("sum_qty", 2).alias("sum_qty"), _r("sum_price", 2).alias("sum_price"), _r("revenue", 2).alias("revenue"), _r("avg_disc", 6).alias("avg_disc"), "n_rows")


@query("lineitem", sql="""SELECT round(sum(l_extendedprice) FILTER (l_returnflag = 'R' AND l_quantity > 25), 2) AS s, CAST(count(*) FILTER (l_linestatus ILIKE 'o%') AS DOUBLE) AS c,
 round(avg(l_discount) FILTER (l_quantity <= 10), 6) AS a, max(l_tax) FILTER (l_returnflag <> 'A') AS mx, min(l_extendedprice) FILTER (l_shipdate >= DATE '1998-01-01') AS mn FROM lineitem""")
def conditional_aggregates(li):
    out = compiler.aggregate(li, s='=SUMIFS(l_extendedprice, l_returnflag, "r", l_quantity, ">25")', c='=COUNTIF(l_linestatus, "o*")', a='=AVERAGEIFS(l_discount, l_quantity, "<=10")', mx='=MAXIFS(l_tax, l_returnflag, "<>A")', mn='=MINIFS(l_extendedprice, l_shipdate, ">="&"1998-01-01")')
    return out.select(_r("s", 2).alias("s"), "c", _r("a", 6).alias("a"), "mx", "mn")


@query("customer", sql="""SELECT c_nationkey, CAST(count(*) FILTER (c_mktsegment ILIKE 'b%ing') AS DOUBLE) AS n_wild, round(coalesce(sum(c_acctbal) FILTER (c_acctbal > 0), 0), 2) AS positive FROM customer GROUP BY 1""")
def criteria_wildcard_by_group(c):
    out = compiler.aggregate(c, ["c_nationkey"], n_wild='=COUNTIF(c_mktsegment, "b*ing")', positive='=SUMIF(c_acctbal, ">0")')
    return out.select("c_nationkey", "n_wild", _r("positive", 2).alias("positive"))


@query("part", sql="""WITH m AS (SELECT * FROM part WHERE (p_size > 40 AND lower(p_brand) LIKE 'brand#1%') OR (p_retailprice < 950))
SELECT round(sum(p_retailprice), 2) AS d_sum, round(avg(p_retailprice), 4) AS d_avg, CAST(count(p_size) AS DOUBLE) AS d_count, CAST(max(p_size) AS DOUBLE) AS d_max, min(p_retailprice) AS d_min, round(stddev_samp(p_retailprice), 4) AS d_std, round(var_pop(p_retailprice), 4) AS d_varp FROM m""")
def database_functions(p):
    grid = [{"p_size": ">40", "p_brand": "Brand#1"}, {"p_retailprice": "<950"}]
    out = database.database(p, {"d_sum": ("DSUM", "p_retailprice", grid), "d_avg": ("DAVERAGE", "P_RETAILPRICE", grid), "d_count": ("DCOUNT", "p_size", grid), "d_max": ("DMAX", "p_size", grid), "d_min": ("DMIN", "p_retailprice", grid), "d_std": ("DSTDEV", "p_retailprice", grid), "d_varp": ("DVARP", "p_retailprice", grid)})
    return out.select(_r("d_sum", 2).alias("d_sum"), _r("d_avg").alias("d_avg"), "d_count", "d_max", "d_min", _r("d_std").alias("d_std"), _r("d_varp").alias("d_varp"))


@query("nation", sql="SELECT n_regionkey AS v FROM nation WHERE lower(n_name) = (SELECT lower(min(n_name)) FROM nation)")
def database_get(n):
    name = n.agg(F.min("n_name")).first()[0]
    return n.agg(database.value(n, "DGET", "n_regionkey", [{"n_name": f"={name}"}]).sql().alias("v"))


@query("lineitem", sql="""SELECT l_returnflag, round(median(l_extendedprice), 4) AS med, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(stddev_samp(l_extendedprice), 3) AS sd, round(var_pop(l_quantity), 6) AS vp,
 round(skewness(l_extendedprice), 6) AS skew, round(kurtosis(l_quantity), 6) AS kurt, round(exp(avg(ln(l_quantity))), 6) AS geo, round(count(*) / sum(1 / l_quantity), 6) AS har, round(var_pop(l_quantity) * count(*), 2) AS devsq FROM lineitem GROUP BY 1""")
def statistics_by_group(li):
    out = compiler.aggregate(li, ["l_returnflag"], med="=MEDIAN(l_extendedprice)", p90="=PERCENTILE.INC(l_extendedprice, 0.9)", q1="=QUARTILE.INC(l_extendedprice, 1)", sd="=STDEV.S(l_extendedprice)", vp="=VAR.P(l_quantity)", skew="=SKEW(l_extendedprice)", kurt="=KURT(l_quantity)", geo="=GEOMEAN(l_quantity)", har="=HARMEAN(l_quantity)", devsq="=DEVSQ(l_quantity)")
    digits = {"med": 4, "p90": 4, "q1": 4, "sd": 3, "devsq": 2}
    return out.select("l_returnflag", *[_r(c, digits.get(c, 6)).alias(c) for c in out.columns[1:]])


@query("lineitem", sql="""SELECT l_linestatus, round(corr(l_extendedprice, l_quantity), 8) AS r, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS icept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2,
 round(covar_pop(l_extendedprice, l_quantity), 4) AS cp, round(covar_samp(l_extendedprice, l_quantity), 4) AS cs, round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ** 2 / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2)), 4) AS se,
 round(regr_intercept(l_extendedprice, l_quantity) + 30 * regr_slope(l_extendedprice, l_quantity), 4) AS fc FROM lineitem GROUP BY 1""")
def regression_statistics(li):
    f = "l_extendedprice, l_quantity"
    out = compiler.aggregate(li, ["l_linestatus"], r=f"=CORREL({f})", slope=f"=SLOPE({f})", icept=f"=INTERCEPT({f})", r2=f"=RSQ({f})", cp=f"=COVARIANCE.P({f})", cs=f"=COVARIANCE.S({f})", se=f"=STEYX({f})", fc=f"=FORECAST.LINEAR(30, {f})")
    digits = {"r": 8, "r2": 8, "slope": 6}
    return out.select("l_linestatus", *[_r(c, digits.get(c, 4)).alias(c) for c in out.columns[1:]])


@query("lineitem", sql="""SELECT l_linenumber, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS icept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(count(*) - 2 AS DOUBLE) AS df FROM lineitem GROUP BY 1""")
def linest_by_group(li):
    out = models.linest(li, "l_extendedprice", ["l_quantity"], ["l_linenumber"])
    return out.select("l_linenumber", _r("l_quantity").alias("slope"), _r("intercept", 3).alias("icept"), _r("r2", 6).alias("r2"), "df")


@query("lineitem", sql="""SELECT l_orderkey, l_linenumber, round(i + s * l_quantity, 2) AS fitted FROM lineitem JOIN (SELECT l_returnflag AS f, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem GROUP BY 1) ON f = l_returnflag""")
def trend_fitted(li):
    return models.trend(li, "l_extendedprice", ["l_quantity"], ["l_returnflag"]).select("l_orderkey", "l_linenumber", _r("fitted", 2).alias("fitted"))


@query("lineitem", sql="""WITH p AS (SELECT n, CASE WHEN upper IS NULL THEN NULL ELSE upper END AS upper, bin FROM (SELECT CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 25 THEN 1 WHEN l_quantity <= 40 THEN 2 ELSE 3 END AS bin, count(*) AS n FROM lineitem GROUP BY 1) JOIN (VALUES (0, 10.0::DOUBLE), (1, 25.0::DOUBLE), (2, 40.0::DOUBLE), (3, NULL::DOUBLE)) t(b, upper) ON b = bin) SELECT bin, upper, n FROM p""")
def frequency_bins(li):
    return relational.frequency(li, "l_quantity", [10, 25, 40])


@query("orders", sql="""SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS f, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS o, round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS p, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def pivot_with_totals(o):
    out = relational.pivot(o, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], "o_totalprice", totals=True)
    return out.select("o_orderpriority", _r("F", 2).alias("f"), _r("O", 2).alias("o"), _r("P", 2).alias("p"), _r("total", 2).alias("total"))


@query("orders", sql="SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS s, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_totals(o):
    return o.cube("o_orderstatus", "o_orderpriority").agg(_r(F.sum("o_totalprice"), 2).alias("s"), F.count(F.lit(1)).alias("n"))


@query("lineitem", sql="SELECT l_shipdate >= DATE '1997-01-01' AS late, round(max(l_extendedprice), 2) AS subtotal FROM lineitem GROUP BY ROLLUP (l_shipdate >= DATE '1997-01-01')")
def subtotal_rollup(li):
    rows = li.withColumn("late", F.col("l_shipdate") >= F.lit("1997-01-01").cast("date"))
    return relational.subtotal(rows, ["late"], 4, "l_extendedprice").select("late", _r("subtotal", 2).alias("subtotal"))


@query("orders", sql="SELECT o_custkey, string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS joined FROM orders GROUP BY 1")
def textjoin_by_group(o):
    return relational.text_join(o, ["o_custkey"], "o_orderstatus", ",", F.col("o_orderkey"))


# Lookups and joins.


@query("orders", "customer", sql="SELECT o_orderkey, c_name, coalesce(c_mktsegment, 'none') AS c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def xlookup_exact(o, c):
    return lookup.lookup(o, "o_custkey", c, "c_custkey", ["c_name", "c_mktsegment"], if_missing={"c_mktsegment": "none"}).select("o_orderkey", "c_name", "c_mktsegment")


@query("customer", "orders", sql="SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) ON o_custkey = c_custkey AND r = 1")
def xlookup_last(c, o):
    return lookup.lookup(c, "c_custkey", o, "o_custkey", ["o_orderkey", "o_totalprice"], ["o_orderkey"], last=True).select("c_custkey", "o_orderkey", "o_totalprice")


@query("nation", "region", sql="SELECT n_name, r_regionkey + 1 AS position FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def match_position(n, r):
    return lookup.match_position(n, "n_regionkey", r.withColumn("pos", F.col("r_regionkey") + 1), "r_regionkey", "pos").select("n_name", "position")


@query("events", sql="""SELECT a.event_id, b.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, max_by(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def asof_backward(e):
    got = lookup.as_of(e.where("event_type = 'purchase'"), "ts", e.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"), F.col("value").alias("last_value")), "click_ts", ["last_value"], ["user_id"], order="click_id")
    return got.select("event_id", "last_value")


@query("events", sql="""SELECT a.event_id, b.value AS next_value FROM (SELECT * FROM events WHERE event_type = 'view') a ASOF LEFT JOIN (SELECT user_id, ts, min_by(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts <= b.ts""")
def asof_forward(e):
    got = lookup.as_of(e.where("event_type = 'view'"), "ts", e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("buy_ts"), F.col("event_id").alias("buy_id"), F.col("value").alias("next_value")), "buy_ts", ["next_value"], ["user_id"], forward=True, order="buy_id", first_tie=True)
    return got.select("event_id", "next_value")


@query("part", sql="SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'xl' WHEN p_size >= 25 THEN 'l' WHEN p_size >= 10 THEN 'm' WHEN p_size >= 0 THEN 's' END AS band FROM part")
def lookup_bands(p):
    return lookup.by_bands(p, "p_size", [(0, "s"), (10, "m"), (25, "l"), (40, "xl")], "band").select("p_partkey", "band")


@query("region", "nation", sql="SELECT r_name, min(n_name) AS n_name FROM region LEFT JOIN nation ON lower(n_name) LIKE lower(left(r_name, 1)) || '%' GROUP BY 1")
def wildcard_lookup(r, n):
    own = r.withColumn("pattern", F.concat(F.left("r_name", F.lit(1)), F.lit("*")))
    return lookup.wildcard_lookup(own, "pattern", n, "n_name", ["n_name"], ["n_name"]).select("r_name", "n_name")


@query("customer", "orders", sql="SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def countif_semi(c, o):
    return lookup.semi(c, "c_custkey", o, "o_custkey").select("c_custkey")


@query("customer", "orders", sql="SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def countif_anti(c, o):
    return lookup.semi(c, "c_custkey", o.where("o_totalprice > 300000"), "o_custkey", anti=True).select("c_custkey")


@query("lineitem", "orders", "customer", "nation", sql="SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= DATE '1997-01-01' GROUP BY 1")
def lookup_chain_revenue(li, o, c, n):
    rows = li.join(o.where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("date")), li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return compiler.aggregate(rows, ["n_name"], revenue="=SUMPRODUCT(l_extendedprice, 1-l_discount)").select("n_name", _r("revenue", 2).alias("revenue"))


@query("lineitem", sql="SELECT a.i AS i, b.j AS j, round(sum(a.v * b.v), 2) AS value FROM (SELECT l_linenumber AS i, l_suppkey % 20 AS k, sum(l_tax) AS v FROM lineitem GROUP BY 1, 2) a JOIN (SELECT l_suppkey % 20 AS k, l_linenumber AS j, sum(l_tax) AS v FROM lineitem GROUP BY 1, 2) b ON a.k = b.k GROUP BY 1, 2")
def matrix_product(li):
    cells = li.groupBy(F.col("l_linenumber").alias("i"), (F.col("l_suppkey") % 20).alias("j")).agg(F.sum("l_tax").alias("value"))
    other = cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")
    return models.matrix_product(cells, other).select("i", "j", _r("value", 2).alias("value"))


# Filters, slices, sets and reshapes.


@query("part", sql="SELECT p_partkey, p_name FROM part WHERE p_size > 45 AND p_retailprice < 1000")
def filter_rows(p):
    return relational.filter_rows(p.select("p_partkey", "p_name", "p_size", "p_retailprice"), criteria.all_of(p, [("p_size", ">45"), ("p_retailprice", "<1000")])).select("p_partkey", "p_name")


@query("customer", sql="SELECT min(c_mktsegment) AS c_mktsegment, c_nationkey FROM customer GROUP BY lower(c_mktsegment), c_nationkey")
def unique_rows(c):
    return relational.unique(c.select("c_mktsegment", "c_nationkey"))


@query("orders", sql="SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 1")
def unique_exactly_once(o):
    return relational.unique(o.select("o_custkey"), exactly_once=True)


@query("orders", sql="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def take_first(o):
    return relational.take(o.select("o_orderkey", "o_totalprice"), 25, ("o_totalprice", -1), ("o_orderkey", 1))


@query("orders", sql="SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 10")
def take_last(o):
    return relational.take(o.select("o_orderkey"), -10, ("o_orderkey", 1))


@query("orders", sql="SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 100")
def drop_rows(o):
    return relational.drop(o.select("o_orderkey"), 100, F.col("o_orderkey"))


@query("part", sql="SELECT p_brand, p_partkey, p_retailprice FROM part")
def choose_columns(p):
    return relational.choose_cols(p, 3, 1, -1)


@query("orders", sql="SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS n FROM orders) WHERE r IN (1, 5) OR r = n")
def choose_rows(o):
    return relational.choose_rows(o.select("o_orderkey"), [1, 5, -1], F.col("o_orderkey")).select("o_orderkey")


@query("customer", "supplier", sql="SELECT 0 AS stack, c_custkey AS key, c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT 1, s_suppkey, s_name, NULL FROM supplier")
def vstack_rows(c, s):
    return relational.vstack(c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")), s.select("s_suppkey", "s_name"))


@query("nation", "region", sql="SELECT coalesce(a.row_id, b.row_id) AS row_id, n_name, r_name FROM (SELECT row_number() OVER (ORDER BY n_name) - 1 AS row_id, n_name FROM nation) a FULL JOIN (SELECT row_number() OVER (ORDER BY r_name) - 1 AS row_id, r_name FROM region) b ON a.row_id = b.row_id")
def hstack_columns(n, r):
    return relational.hstack(n.select("n_name"), r.select("r_name"), [F.col("n_name")], [F.col("r_name")])


@query("customer", "supplier", sql="SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_keys(c, s):
    return c.select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey"))


@query("orders", "customer", sql="SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def except_keys(o, c):
    return c.select(F.col("c_custkey").alias("k")).subtract(o.where("o_totalprice > 300000").select("o_custkey"))


@query("lineitem", sql="SELECT l_orderkey, place, name, value FROM (SELECT l_orderkey, 0 AS place, 'l_quantity' AS name, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, 1, 'l_tax', l_tax FROM lineitem)")
def to_column(li):
    return relational.to_column(li, ["l_quantity", "l_tax"], "l_orderkey")


@query("nation", sql="SELECT CAST(floor((r - 1) / 5) AS BIGINT) AS line, max(n_name) FILTER ((r - 1) % 5 = 0) AS c1, max(n_name) FILTER ((r - 1) % 5 = 1) AS c2, max(n_name) FILTER ((r - 1) % 5 = 2) AS c3, max(n_name) FILTER ((r - 1) % 5 = 3) AS c4, max(n_name) FILTER ((r - 1) % 5 = 4) AS c5 FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS r FROM nation) GROUP BY 1")
def wrap_rows(n):
    return relational.wrap(n, "n_name", 5, F.col("n_name"))


@query("lineitem", sql="SELECT 'q' AS name, sum(l_quantity) FILTER (l_returnflag = 'A') AS \"A\", sum(l_quantity) FILTER (l_returnflag = 'N') AS \"N\", sum(l_quantity) FILTER (l_returnflag = 'R') AS \"R\" FROM lineitem")
def transpose_totals(li):
    totals = li.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("q"))
    return relational.transpose(totals, "l_returnflag", ["A", "N", "R"], ["q"])


@query("part", sql="SELECT p_partkey, CAST(i - 1 AS INTEGER) AS place, w AS piece FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)")
def text_split(p):
    return relational.text_split(p.select("p_partkey", "p_name"), "p_name", " ").select("p_partkey", "place", "piece")


@query("nation", sql="SELECT CAST(i - 1 AS BIGINT) AS _at, n_name FROM range(1, 31) t(i) LEFT JOIN (SELECT n_name, row_number() OVER (ORDER BY n_name) AS r FROM nation) ON r = i")
def expand_rows(n):
    return relational.expand(n.select("n_name"), 30, {}, F.col("n_name"))


@query("region", sql="SELECT CAST(i AS BIGINT) AS row, CAST(j AS BIGINT) AS col, CAST(5 + (i * 4 + j) * 2 AS DOUBLE) AS value FROM range(3) a(i), range(4) b(j)")
def sequence_grid(r):
    return relational.sequence(r.sparkSession, 3, 4, 5, 2)


@query("customer", sql="SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3)")
def auto_filter(c):
    return relational.auto_filter(c, {"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": [1, 2, 3, None]}).select("c_custkey")


@query("orders", sql="SELECT o_orderkey AS row_id FROM orders WHERE o_orderkey >= 50 ORDER BY 1 LIMIT 20")
def skip_and_limit(o):
    return relational.skip_rows(o.select(F.col("o_orderkey").alias("row_id")), 50, limit=20)


@query("part", sql="SELECT p_partkey, CASE WHEN p_partkey <= (SELECT max(p_partkey) FROM part WHERE p_size > 25 AND p_partkey <= 150) AND p_size > 25 THEN p_name END AS p_name FROM part WHERE p_partkey <= (SELECT max(p_partkey) FROM part WHERE p_size > 25 AND p_partkey <= 150)")
def trim_blank_tail(p):
    """Names blanked where the size is small and after row 150: rows after the last name left go."""
    rows = p.select("p_partkey", F.when(F.col("p_size") <= 25, " ").when(F.col("p_partkey") > 150, "").otherwise(F.col("p_name")).alias("p_name"))
    return relational.blank_to_null(relational.trim_tail(rows, "p_partkey"))


@query("part", sql="SELECT 'p_name' AS name, 'string' AS kind UNION ALL SELECT 'size', 'int' UNION ALL SELECT 'price', 'float' UNION ALL SELECT 'big', 'boolean' UNION ALL SELECT 'day', 'date'")
def infer_schema(p):
    text = p.select("p_name", F.col("p_size").cast("string").alias("size"), F.col("p_retailprice").cast("string").alias("price"), (F.col("p_size") > 20).cast("string").alias("big"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).cast("string").alias("day"))
    return relational.observed_types(text)


@query("events", sql="SELECT event_id, 'value' AS name, event_type AS detail FROM events WHERE event_id % 10 = 0")
def cast_report(e):
    mixed = e.select("event_id", F.when(F.col("event_id") % 10 == 0, F.col("event_type")).otherwise(F.col("value").cast("string")).alias("value"))
    return relational.cast_report(mixed, "event_id", {"value": "double"})


@query("nation", "region", sql="SELECT n_nationkey AS i, r_regionkey AS j, CAST(n_nationkey * (r_regionkey + 1) AS DOUBLE) AS value FROM nation, region")
def outer_product(n, r):
    return models.outer(n.select(F.col("n_nationkey").alias("i"), F.col("n_nationkey").cast("double").alias("value")), r.select(F.col("r_regionkey").alias("j"), (F.col("r_regionkey") + 1).cast("double").alias("value")))


@query("orders", sql="SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS moving FROM orders")
def offset_frame(o):
    return ranking.moving(o, "o_totalprice", -1, 1, ["o_custkey"], ["o_orderdate", "o_orderkey"], how="sum").select("o_orderkey", _r("moving", 2).alias("moving"))


@query("orders", sql="SELECT o_custkey, round(pow(sum(CASE WHEN v > 0 THEN v * pow(1.12, n - 1 - k) END) / sum(CASE WHEN v < 0 THEN -v / pow(1.1, k) END), 1 / nullif(max(n) - 1, 0)) - 1, 6) AS mirr FROM (SELECT o_custkey, CASE WHEN k = 0 THEN -o_totalprice ELSE o_totalprice END AS v, k, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)) GROUP BY 1")
def mirr_by_customer(o):
    from pyspark.sql import Window as W

    first = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) == 1
    flows = o.withColumn("flow", F.when(first, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")))
    return models.mirr(flows, "flow", ["o_custkey"], ["o_orderdate", "o_orderkey"], 0.1, 0.12).select("o_custkey", _r("mirr", 6).alias("mirr"))


@query("lineitem", sql="SELECT l_linenumber, round(exp(regr_slope(ln(l_extendedprice), l_quantity)), 8) AS base, round(exp(regr_intercept(ln(l_extendedprice), l_quantity)), 3) AS scale FROM lineitem GROUP BY 1")
def logest_by_group(li):
    out = models.linest(li, "l_extendedprice", ["l_quantity"], ["l_linenumber"], logs=True)
    return out.select("l_linenumber", _r("l_quantity", 8).alias("base"), _r("intercept", 3).alias("scale"))


@query("lineitem", sql="WITH s AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1) SELECT l_returnflag, round(v[CAST(floor(0.3 * (len(v) + 1)) AS BIGINT)] + (0.3 * (len(v) + 1) - floor(0.3 * (len(v) + 1))) * (v[CAST(floor(0.3 * (len(v) + 1)) AS BIGINT) + 1] - v[CAST(floor(0.3 * (len(v) + 1)) AS BIGINT)]), 4) AS p30 FROM s")
def percentile_exclusive(li):
    out = compiler.aggregate(li, ["l_returnflag"], p30="=PERCENTILE.EXC(l_extendedprice, 0.3)")
    return out.select("l_returnflag", _r("p30").alias("p30"))


@query("lineitem", sql="SELECT CAST(sum(l_quantity * l_discount) AS DOUBLE) IS NOT NULL AS some, round(sum(l_quantity * l_quantity), 2) AS sq, round(sum(l_quantity * l_quantity - l_tax * l_tax), 2) AS d, round(sum(l_quantity * l_quantity + l_tax * l_tax), 2) AS s, round(sum((l_quantity - l_tax) * (l_quantity - l_tax)), 2) AS q FROM lineitem")
def sums_of_squares(li):
    out = compiler.aggregate(li, some="=ISNUMBER(SUMPRODUCT(l_quantity,l_discount))", sq="=SUMSQ(l_quantity)", d="=SUMX2MY2(l_quantity,l_tax)", s="=SUMX2PY2(l_quantity,l_tax)", q="=SUMXMY2(l_quantity,l_tax)")
    return out.select("some", *[_r(c, 2).alias(c) for c in ("sq", "d", "s", "q")])


# Order statistics and running values.


@query("part", sql="SELECT p_partkey, CAST(rank() OVER (ORDER BY p_retailprice DESC) AS DOUBLE) AS rank FROM part")
def rank_eq(p):
    return ranking.rank(p.select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", "rank")


@query("part", sql="SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS rank FROM part")
def rank_avg_by_group(p):
    return ranking.rank(p, "p_size", descending=False, average=True, by=["p_brand"]).select("p_partkey", "rank")


@query("part", sql="SELECT p_partkey, floor(percent_rank() OVER (ORDER BY p_retailprice) * 1000 + 1e-9) / 1000 AS percent_rank FROM part")
def percentrank_inc(p):
    return ranking.percent_rank(p.select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", "percent_rank")


@query("part", sql="SELECT p_partkey, floor(rank() OVER (ORDER BY p_size) / (count(*) OVER () + 1) * 1000 + 1e-9) / 1000 AS percent_rank FROM part")
def percentrank_exc(p):
    return ranking.percent_rank(p.select("p_partkey", "p_size"), "p_size", exclusive=True).select("p_partkey", "percent_rank")


@query("orders", sql="SELECT min(o_totalprice) AS kth FROM (SELECT o_totalprice FROM orders ORDER BY 1 DESC LIMIT 7)")
def large_k(o):
    return ranking.kth(o, "o_totalprice", 7)


@query("orders", sql="SELECT o_orderpriority, o_totalprice AS kth FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS r FROM orders) WHERE r = 3")
def small_k_by_group(o):
    return ranking.kth(o, "o_totalprice", 3, largest=False, by=["o_orderpriority"])


@query("lineitem", sql="SELECT l_returnflag, round(avg(l_extendedprice), 4) AS trimmed FROM (SELECT l_returnflag, l_extendedprice, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_extendedprice)) WHERE i > floor(n * 0.1 / 2) AND i <= n - floor(n * 0.1 / 2) GROUP BY 1")
def trimmed_mean(li):
    return ranking.trimmed_mean(li, "l_extendedprice", 0.1, ["l_returnflag"]).select("l_returnflag", _r("trimmed").alias("trimmed"))


@query("part", sql="SELECT p_brand, p_size AS mode, n FROM (SELECT *, max(n) OVER (PARTITION BY p_brand) AS m FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2)) WHERE n = m AND m > 1")
def mode_multiple(p):
    return ranking.modes(p, "p_size", ["p_brand"])


@query("part", sql="SELECT p_brand, p_size AS mode FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, min(p_partkey)) AS r, count(*) AS n FROM part GROUP BY 1, 2) WHERE r = 1 AND n > 1")
def mode_single(p):
    return ranking.modes(p, "p_size", ["p_brand"], order="p_partkey")


@query("lineitem", sql="SELECT l_returnflag, round(avg(abs(l_quantity - m)), 6) AS avedev FROM lineitem JOIN (SELECT l_returnflag AS f, avg(l_quantity) AS m FROM lineitem GROUP BY 1) ON f = l_returnflag GROUP BY 1")
def average_deviation(li):
    return ranking.average_deviation(li, "l_quantity", ["l_returnflag"]).select("l_returnflag", _r("avedev", 6).alias("avedev"))


@query("orders", sql="SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def running_total(o):
    return ranking.running(o, "o_totalprice", ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", _r("running", 2).alias("running"))


@query("orders", sql="SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS delta FROM orders")
def relative_reference(o):
    at = ranking.shifted(o, "o_totalprice", -1, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return at.select("o_orderkey", _r(F.col("o_totalprice") - F.col("shifted"), 2).alias("delta"))


@query("events", sql="SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving FROM events")
def moving_average(e):
    return ranking.moving(e, "value", -2, 0, ["user_id"], ["ts", "event_id"]).select("event_id", _r("moving", 6).alias("moving"))


# Row formulas.


@query("lineitem", sql="""SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, l_quantity - 7 * floor(l_quantity / 7) AS md, ceil(l_extendedprice / 50) * 50 AS ceil50, floor(l_extendedprice / 50) * 50 AS floor50, trunc(l_extendedprice / 100) AS quot,
 round(sqrt(l_quantity), 8) AS rt, round(ln(l_extendedprice), 8) AS lg, round(sin(l_quantity), 8) AS sn, round(atan2(l_tax, l_quantity), 8) AS at2, sign(l_discount - 0.05) AS sg, CASE WHEN l_quantity % 2 = 0 THEN l_quantity ELSE l_quantity + 1 END AS ev, round(degrees(l_tax), 8) AS dg FROM lineitem""")
def math_functions(li):
    out = compiler.with_formulas(li.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_quantity"), charge="=l_extendedprice*(1-l_discount)*(1+l_tax)", md="=MOD(l_quantity,7)", ceil50="=CEILING(l_extendedprice,50)", floor50="=FLOOR(l_extendedprice,50)", quot="=QUOTIENT(l_extendedprice,100)", rt="=SQRT(l_quantity)", lg="=LN(l_extendedprice)", sn="=SIN(l_quantity)", at2="=ATAN2(l_quantity,l_tax)", sg="=SIGN(ROUND(l_discount-0.05,6))", ev="=EVEN(l_quantity)", dg="=DEGREES(l_tax)")
    r8 = {"rt", "lg", "sn", "at2", "dg"}
    names = ["charge", "md", "ceil50", "floor50", "quot", "rt", "lg", "sn", "at2", "sg", "ev", "dg"]
    return out.select("l_orderkey", "l_linenumber", *[_r(n, 8).alias(n) if n in r8 else _r(n, 6).alias(n) if n == "charge" else F.col(n) for n in names])


_SQL["math_functions"] = _SQL["math_functions"].replace("sign(l_discount - 0.05) AS sg", "CAST(sign(round(l_discount - 0.05, 6)) AS DOUBLE) AS sg").replace("trunc(l_extendedprice / 100) AS quot", "CAST(trunc(l_extendedprice / 100) AS DOUBLE) AS quot")


@query("part", sql="""SELECT p_partkey, upper(p_name) AS up, length(p_name)::DOUBLE AS n, left(p_name, 4) AS l4, right(p_name, 3) AS r3, substring(p_name, 2, 5) AS m, replace(p_name, 'a', '@') AS sub, CASE WHEN instr(p_name, ' ') > 0 THEN instr(p_name, ' ')::DOUBLE END AS sp, repeat('*', p_size % 5) AS st, p_brand || '-' || p_size AS cc, lower(p_type) = lower('STANDARD') AS eq,
 CASE WHEN instr(p_name, ' ') > 0 THEN split_part(p_name, ' ', 1) END AS before, CASE WHEN instr(p_name, ' ') > 0 THEN substring(p_name, instr(p_name, ' ') + 1) END AS after, ascii(p_name)::DOUBLE AS code FROM part""")
def text_functions(p):
    out = compiler.with_formulas(p.select("p_partkey", "p_name", "p_brand", "p_size", "p_type"), up="=UPPER(p_name)", n="=LEN(p_name)", l4="=LEFT(p_name,4)", r3="=RIGHT(p_name,3)", m="=MID(p_name,2,5)", sub='=SUBSTITUTE(p_name,"a","@")', sp='=FIND(" ",p_name)', st='=REPT("*",MOD(p_size,5))', cc='=p_brand&"-"&p_size', eq='=p_type="standard"', before='=TEXTBEFORE(p_name," ")', after='=TEXTAFTER(p_name," ")', code="=CODE(p_name)")
    return out.drop("p_name", "p_brand", "p_size", "p_type")


@query("orders", sql="""SELECT o_orderkey, year(d)::DOUBLE AS y, month(d)::DOUBLE AS m, day(d)::DOUBLE AS dd, (d + INTERVAL 3 MONTH)::DATE AS ed, last_day(d + INTERVAL 1 MONTH) AS em, isodow(d)::DOUBLE AS wd, weekofyear(d)::DOUBLE AS iso, date_diff('day', d, DATE '2002-01-01')::DOUBLE AS days,
 (SELECT count(*) FROM range(d::TIMESTAMP, d::TIMESTAMP + INTERVAL 31 DAY, INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6)::DOUBLE AS nwd, strftime(d, '%Y-%m-%d') AS tx, date_diff('day', DATE '1899-12-30', d)::DOUBLE AS serial, datesub('month', d, DATE '2002-01-01')::DOUBLE AS months FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)""")
def date_functions(o):
    src = o.select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    out = compiler.with_formulas(src, y="=YEAR(d)", m="=MONTH(d)", dd="=DAY(d)", ed="=EDATE(d,3)", em="=EOMONTH(d,1)", wd="=WEEKDAY(d,2)", iso="=ISOWEEKNUM(d)", days="=DAYS(DATE(2002,1,1),d)", nwd="=NETWORKDAYS(d,d+30)", tx='=TEXT(d,"yyyy-mm-dd")', serial="=N(d)", months='=DATEDIF(d,DATE(2002,1,1),"m")')
    return out.drop("d")


@query("lineitem", sql="""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'bulk' WHEN l_quantity > 20 THEN 'mid' ELSE 'small' END AS size, CASE l_returnflag WHEN 'A' THEN 1.0::DOUBLE WHEN 'R' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS flag, coalesce(l_extendedprice / nullif(l_linenumber - 1, 0), -1) AS safe, (l_discount > 0.05 AND l_tax > 0.02) AS both, (l_discount > 0.08 OR l_tax > 0.06) AS either FROM lineitem""")
def logical_functions(li):
    out = compiler.with_formulas(li.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_extendedprice", "l_discount", "l_tax"), size='=IFS(l_quantity>40,"bulk",l_quantity>20,"mid",TRUE,"small")', flag='=SWITCH(l_returnflag,"A",1,"R",2,0)', safe="=IFERROR(l_extendedprice/(l_linenumber-1),-1)", both="=AND(l_discount>0.05,l_tax>0.02)", either="=OR(l_discount>0.08,l_tax>0.06)")
    return out.select("l_orderkey", "l_linenumber", "size", "flag", "safe", "both", "either")


@query("customer", sql="""SELECT c_custkey, round(-c_acctbal * 0.01 * power(1.01, 24) / (power(1.01, 24) - 1), 4) AS pmt, round(-(c_acctbal * power(1.005, 12)), 4) AS fv, round(c_acctbal / power(1.03, 5), 4) AS pv, round((c_acctbal - 100) / 5, 4) AS sln, round((c_acctbal - 100) * 5 * 2 / 30, 4) AS syd, round(power(1 + 0.06 / 12, 12) - 1, 8) AS eff FROM customer""")
def finance_functions(c):
    out = compiler.with_formulas(c.select("c_custkey", "c_acctbal"), pmt="=PMT(0.01,24,c_acctbal)", fv="=FV(0.005,12,0,c_acctbal)", pv="=PV(0.03,5,0,-c_acctbal)", sln="=SLN(c_acctbal,100,5)", syd="=SYD(c_acctbal,100,5,1)", eff="=EFFECT(0.06,12)")
    return out.select("c_custkey", *[_r(n, 8 if n == "eff" else 4).alias(n) for n in ("pmt", "fv", "pv", "sln", "syd", "eff")])


@query("orders", sql="SELECT o_custkey, round(sum(o_totalprice / power(1.05, r)), 2) AS npv FROM (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) GROUP BY 1")
def npv_by_customer(o):
    return models.npv(o, "o_totalprice", ["o_custkey"], ["o_orderdate", "o_orderkey"], 0.05).select("o_custkey", _r("npv", 2).alias("npv"))


@query("orders", sql="SELECT o_custkey, round(sum(o_totalprice / power(1.05, date_diff('day', f, o_orderdate::DATE) / 365)), 2) AS xnpv FROM orders JOIN (SELECT o_custkey AS c, min(o_orderdate)::DATE AS f FROM orders GROUP BY 1) ON c = o_custkey GROUP BY 1")
def xnpv_by_customer(o):
    return models.xnpv(o, "o_totalprice", "o_orderdate", ["o_custkey"], 0.05).select("o_custkey", _r("xnpv", 2).alias("xnpv"))


@query("orders")
def irr_by_customer(o):
    """Every customer's first order as the cost of the later ones; no SQL solves for a rate."""
    from pyspark.sql import Window as W

    first = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) == 1
    flows = o.withColumn("flow", F.when(first, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")))
    return models.irr(flows, "flow", ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", _r("irr", 6).alias("irr"))


@query("part", sql="""SELECT p_partkey, format('{:b}', p_size) AS bin, upper(format('{:x}', p_size)) AS hex, (p_size & 12)::DOUBLE AS band, (p_size | 3)::DOUBLE AS bor, xor(p_size, 5)::DOUBLE AS bx, (p_size << 2)::DOUBLE AS sh, round(p_retailprice * 0.3048, 6) AS metres, round((p_size - 32) * 5 / 9, 6) AS celsius, (p_size = 25)::INT::DOUBLE AS del FROM part""")
def engineering_functions(p):
    out = compiler.with_formulas(p.select("p_partkey", "p_size", "p_retailprice"), bin="=DEC2BIN(p_size)", hex="=DEC2HEX(p_size)", band="=BITAND(p_size,12)", bor="=BITOR(p_size,3)", bx="=BITXOR(p_size,5)", sh="=BITLSHIFT(p_size,2)", metres='=CONVERT(p_retailprice,"ft","m")', celsius='=CONVERT(p_size,"F","C")', **{"del": "=DELTA(p_size,25)"})
    return out.select("p_partkey", "bin", "hex", "band", "bor", "bx", "sh", _r("metres", 6).alias("metres"), _r("celsius", 6).alias("celsius"), "del")


@query("part", sql="SELECT p_partkey, round(0.5 * exp(-0.5 * p_size), 10) AS ex, round(1 - exp(-power(p_size / 30.0, 1.5)), 8) AS wb, round((p_size - 25) / 14.0, 8) AS z, round(exp(-power((p_size - 25) / 14.0, 2) / 2) / (14 * sqrt(2 * pi())), 10) AS nd, round(lgamma(p_size), 6) AS lg FROM part")
def distribution_functions(p):
    out = compiler.with_formulas(p.select("p_partkey", "p_size"), ex="=EXPON.DIST(p_size,0.5,FALSE)", wb="=WEIBULL.DIST(p_size,1.5,30,TRUE)", z="=STANDARDIZE(p_size,25,14)", nd="=NORM.DIST(p_size,25,14,FALSE)", lg="=GAMMALN(p_size)")
    return out.select("p_partkey", _r("ex", 10).alias("ex"), _r("wb", 8).alias("wb"), _r("z", 8).alias("z"), _r("nd", 10).alias("nd"), _r("lg", 6).alias("lg"))


@query("part", sql="SELECT p_partkey, CAST(p_size * p_size + 2 * p_size + 1 AS DOUBLE) AS poly, CAST((p_size + 1) + (p_size + 2) + (p_size + 3) AS DOUBLE) AS folded, CASE WHEN p_size < 10 THEN 'low' WHEN p_size < 30 THEN 'mid' ELSE 'high' END AS level FROM part")
def lambda_functions(p):
    out = compiler.with_formulas(p.select("p_partkey", "p_size"), poly="=LET(x,p_size,f,LAMBDA(a,a*a),f(x)+2*x+1)", folded="=REDUCE(0,{1,2,3},LAMBDA(acc,v,acc+p_size+v))", level='=VLOOKUP(p_size,{0,"low";10,"mid";30,"high"},2)')
    return out.select("p_partkey", "poly", "folded", "level")


@query("lineitem", sql="SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net, round(l_extendedprice * (1 - l_discount) * l_tax, 6) AS tax, round(l_extendedprice * (1 - l_discount) + l_extendedprice * (1 - l_discount) * l_tax, 6) AS gross FROM lineitem")
def recalculation(li):
    out, _ = recalc.recalculate(li.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax"), {"gross": "=net+tax", "tax": "=net*l_tax", "net": "=l_extendedprice*(1-l_discount)"})
    return out.select("l_orderkey", "l_linenumber", _r("net", 6).alias("net"), _r("tax", 6).alias("tax"), _r("gross", 6).alias("gross"))


@query("events", sql="SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(e):
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# Editing, diff, validation.


@query("part", sql="""SELECT p_partkey, name, before, after, change FROM (SELECT p_partkey, 'p_name' AS name, p_name AS before, CASE WHEN p_partkey % 7 = 0 THEN upper(p_name) ELSE p_name END AS after, 'changed' AS change FROM part WHERE p_partkey % 11 <> 0) WHERE before <> after
 UNION ALL SELECT p_partkey, 'p_name', p_name, NULL, 'removed' FROM part WHERE p_partkey % 11 = 0""")
def cell_diff(p):
    before = p.select("p_partkey", "p_name")
    after = before.where("p_partkey % 11 <> 0").withColumn("p_name", F.when(F.col("p_partkey") % 7 == 0, F.upper("p_name")).otherwise(F.col("p_name")))
    return editing.diff(before, after, ["p_partkey"], ["p_name"])


@query("part", sql="SELECT CASE WHEN p_partkey >= 100 THEN p_partkey + 5 ELSE p_partkey END AS row, 1 AS col, p_brand AS value FROM part WHERE p_partkey < 50 OR p_partkey >= 60")
def structure_edit(p):
    cells = p.select(F.col("p_partkey").alias("row"), F.lit(1).alias("col"), F.col("p_brand").alias("value"))
    shifted = editing.insert(cells, "row", 100, 5)
    return shifted.where("row < 50 OR row >= 60")


@query("lineitem", sql="SELECT 'duplicate_cell' AS code, l_orderkey AS row, l_linenumber AS col, CAST(count(*) AS VARCHAR) AS detail FROM lineitem GROUP BY 2, 3 HAVING count(*) > 1 UNION ALL SELECT 'cell_out_of_grid', l_orderkey, l_linenumber, NULL FROM lineitem WHERE l_orderkey < 1 OR l_orderkey > 1048576")
def validate_cells(li):
    return editing.validate(li.select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col")))


# Windows over time, alike for tables and streams.


@query("events", sql="SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_window(e):
    return windows.tumbling(e, "ts", "1 hour", ["event_type"], F.count(F.lit(1)).alias("n"), _r(F.sum("value")).alias("total"))


@query("events", sql="""SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 2 HOUR AS window_end, count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, s""")
def session_windows(e):
    return windows.sessions(e, "ts", "2 hours", ["user_id"], F.count(F.lit(1)).alias("n"))


@query("events", sql="SELECT w AS window_start, w + INTERVAL 2 HOUR AS window_end, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1")
def sliding_window(e):
    return windows.sliding(e, "ts", "2 hours", "1 hour", [], F.count(F.lit(1)).alias("n"))


# Sources and sinks: a table written to the shared folder and scanned back.

_PARTS = "SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part"


def _back(df: DataFrame) -> DataFrame:
    return df.select(F.col("p_partkey").cast("long"), "p_name", F.col("p_size").cast("long"), F.col("p_retailprice").cast("double"))


def _target(df: DataFrame, tag: str) -> str:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return f"{path}/{tag}"


@query("part", sql=_PARTS)
def csv_round_trip(p):
    path = _target(p, "csv")
    delimited.write_csv(p.select("p_partkey", "p_name", "p_size", "p_retailprice"), path)
    return _back(delimited.read_csv(p.sparkSession, path, infer=True))


@query("part", sql=_PARTS)
def json_round_trip(p):
    path = _target(p, "json")
    delimited.write_json(p.select("p_partkey", "p_name", "p_size", "p_retailprice"), path)
    return _back(delimited.read_json(p.sparkSession, path))


@query("part", sql=_PARTS)
def sheet_round_trip(p):
    """Workbooks written by the executors, and scanned by a task each."""
    path = _target(p, "books").removeprefix("file://").removeprefix("file:")
    workbook_writer.write_parts(p.select("p_partkey", "p_name", "p_size", "p_retailprice"), path).count()
    workbook.register(p.sparkSession)
    return _back(workbook.load_sheet(p.sparkSession, path))
