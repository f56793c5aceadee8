"""Queries of worksheet functions, family by family, each formula with the SQL that says the same in plain terms.

A family is a table's rows with a column for each formula. The SQL never calls a
function of the same kind: distributions are power series, inverses must give back what
they were made of, bonds are sums of discounted flows. Numbers are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import compiler

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: Tables as the formulas see them: key, columns of the frame, columns in SQL.
PART = ("part", "p_partkey", {"s": "cast(p_size as double)", "v": "p_retailprice", "k": "cast(p_partkey as double)", "name": "p_name", "brand": "p_brand", "kind": "p_type"})
ORDERS = ("orders", "o_orderkey", {"d": "cast(o_orderdate as date)", "n": "cast(o_orderkey % 97 as double)", "price": "o_totalprice"})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def family(name: str, source: tuple, entries: list[tuple[str, str, str]], digits: int = 8) -> None:
    """Register a query of `entries` (column, formula, SQL). A column whose name ends in _t is text, in _b boolean, in _d a date, others numbers."""
    table, key, columns = source
    kind = lambda n: n[-2:] if n[-2:] in ("_t", "_b", "_d") else ""
    shown = {"": lambda n: F.round(F.col(n).cast("double"), digits).alias(n), "_t": F.col, "_b": F.col, "_d": F.col}
    said = {"": lambda n, sql: f"round(CAST({sql} AS DOUBLE), {digits}) + 0 AS {n}", "_t": lambda n, sql: f"{sql} AS {n}", "_b": lambda n, sql: f"{sql} AS {n}", "_d": lambda n, sql: f"CAST({sql} AS DATE) AS {n}"}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, *[F.expr(e).alias(n) for n, e in columns.items()])
        out = compiler.with_formulas(df, **{n: f"={formula}" for n, formula, _ in entries})
        return out.select(key, *[shown[kind(n)](n) for n, _, _ in entries])

    run.__name__, run.__doc__ = name, ", ".join(formula for _, formula, _ in entries)
    _QUERIES[name] = run
    inner = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    _SQL[name] = f"SELECT {key}, {', '.join(said[kind(n)](n, sql) for n, _, sql in entries)} FROM (SELECT {key}, {inner} FROM {table})"


def series(term: str, n: int = 160, first: int = 0) -> str:
    return f"list_sum(list_transform(range({first}, {n}), lambda i: {term}))"


def norm_cdf(x: str) -> str:
    """1/2 + phi(x) (x + x^3/3 + x^5/15 + ...)."""
    return f"(0.5 + sign({x}) * exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {series(f'exp((2 * i + 1) * ln(greatest(abs({x}), 1e-300)) + i * ln(2) + lgamma(i + 1) - lgamma(2 * i + 2))', 90)})"


def norm_pdf(x: str) -> str:
    return f"(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()))"


def gamma_p(a: str, x: str) -> str:
    return f"({series(f'exp(-({x}) + (({a}) + i) * ln({x}) - lgamma(({a}) + i + 1))', 220)})"


def beta_i(x: str, a: str, b: str) -> str:
    return f"({series(f'exp(({a}) * ln({x}) + ({b}) * ln(1 - ({x})) + lgamma(({a}) + ({b}) + i) - lgamma(({a}) + 1 + i) - lgamma({b}) + i * ln({x}))', 400)})"


# Mathematics.

family("trigonometry", PART, [
    ("abs_", "ABS(s-25)", "abs(s - 25)"), ("acos_", "ACOS(s/60)", "acos(s / 60)"), ("acosh_", "ACOSH(s+1)", "ln(s + 1 + sqrt((s + 1) * (s + 1) - 1))"),
    ("acot_", "ACOT(s)", "atan(1 / s)"), ("acoth_", "ACOTH(s+1)", "ln((s + 2) / s) / 2"), ("asin_", "ASIN(s/60)", "asin(s / 60)"), ("asinh_", "ASINH(s)", "ln(s + sqrt(s * s + 1))"),
    ("atan_", "ATAN(s)", "atan(s)"), ("atan2_", "ATAN2(s,v)", "atan2(v, s)"), ("atanh_", "ATANH(s/60)", "ln((60 + s) / (60 - s)) / 2"), ("cos_", "COS(s)", "cos(s)"), ("cosh_", "COSH(s/10)", "(exp(s / 10) + exp(-s / 10)) / 2"),
    ("cot_", "COT(s)", "cos(s) / sin(s)"), ("coth_", "COTH(s/10)", "(exp(s / 10) + exp(-s / 10)) / (exp(s / 10) - exp(-s / 10))"), ("csc_", "CSC(s)", "1 / sin(s)"), ("csch_", "CSCH(s/10)", "2 / (exp(s / 10) - exp(-s / 10))"),
    ("sec_", "SEC(s)", "1 / cos(s)"), ("sech_", "SECH(s/10)", "2 / (exp(s / 10) + exp(-s / 10))"), ("sin_", "SIN(s)", "sin(s)"), ("sinh_", "SINH(s/10)", "(exp(s / 10) - exp(-s / 10)) / 2"),
    ("tan_", "TAN(s)", "sin(s) / cos(s)"), ("tanh_", "TANH(s/10)", "1 - 2 / (exp(s / 5) + 1)"), ("rad_", "RADIANS(s)", "s * pi() / 180"), ("deg_", "DEGREES(s/10)", "s * 18 / pi()"), ("pi_", "PI()*s", "3.141592653589793 * s"),
    ("exp_", "EXP(s/10)", "power(2.718281828459045, s / 10)"), ("log_", "LOG(s+1,3)", "ln(s + 1) / ln(3)"), ("log10_", "LOG10(s)", "ln(s) / ln(10)"), ("power_", "POWER(s,1.5)", "s * sqrt(s)"), ("sqrtpi_", "SQRTPI(s)", "sqrt(s * pi())"),
    ("phi_", "PHI(s/20)", norm_pdf("(s / 20)")), ("gauss_", "GAUSS(s/20)", norm_cdf("(s / 20)") + " - 0.5"),
], 7)

family("whole_numbers", PART, [
    ("fact_", "FACT(MOD(s,13))", "list_aggregate(list_concat([1], range(1, CAST(s AS INTEGER) % 13 + 1)), 'product')"), ("factdouble_", "FACTDOUBLE(MOD(s,13))", "list_aggregate(list_concat([1], range(CAST(s AS INTEGER) % 13, 0, -2)), 'product')"),
    ("combin_", "COMBIN(s+5,3)", "(s + 5) * (s + 4) * (s + 3) / 6"), ("combina_", "COMBINA(s,3)", "(s + 2) * (s + 1) * s / 6"), ("permut_", "PERMUT(s+3,2)", "(s + 3) * (s + 2)"), ("permutationa_", "PERMUTATIONA(s,3)", "s * s * s"),
    ("gcd_", "GCD(s,12,18)", "gcd(CAST(s AS BIGINT), 6)"), ("lcm_", "LCM(s,4,6)", "lcm(CAST(s AS BIGINT), 12)"), ("int_", "INT(0-s/7)", "floor(-s / 7)"), ("odd_", "ODD(s)", "CASE WHEN s % 2 = 1 THEN s ELSE s + 1 END"), ("even_", "EVEN(0-s)", "CASE WHEN s % 2 = 0 THEN -s ELSE -s - 1 END"),
    ("multinomial_", "MULTINOMIAL(s,2,1)", "(s + 3) * (s + 2) * (s + 1) / 2"), ("seriessum_", "SERIESSUM(s/10,0,1,{1,2,3})", "1 + 2 * s / 10 + 3 * s * s / 100"),
    ("roundup_", "ROUNDUP(PI()*s,2)", "ceil(pi() * s * 100) / 100"), ("rounddown_", "ROUNDDOWN(0-PI()*s,2)", "-floor(pi() * s * 100) / 100"), ("trunc_", "TRUNC(0-PI()*s,3)", "-floor(pi() * s * 1000) / 1000"), ("round_", "ROUND(PI()*s,2)", "floor(pi() * s * 100 + 0.5) / 100"),
    ("mround_", "MROUND(s,4)", "floor(s / 4 + 0.5) * 4"), ("ceiling_", "CEILING(s,6)", "ceil(s / 6) * 6"), ("floor_", "FLOOR(s,6)", "floor(s / 6) * 6"), ("ceilingmath_", "CEILING.MATH(0-s,6)", "-floor(s / 6) * 6"), ("floormath_", "FLOOR.MATH(0-s,6)", "-ceil(s / 6) * 6"), ("ceilingprecise_", "CEILING.PRECISE(s,6)", "ceil(s / 6) * 6"),
    ("floorprecise_", "FLOOR.PRECISE(0-s,6)", "-ceil(s / 6) * 6"), ("isoceiling_", "ISO.CEILING(s,6)", "ceil(s / 6) * 6"), ("sign_", "SIGN(s-25)", "CASE WHEN s > 25 THEN 1 WHEN s < 25 THEN -1 ELSE 0 END"), ("quotient_", "QUOTIENT(0-s,7)", "-floor(s / 7)"), ("mod_", "MOD(0-s,7)", "-s + 7 * ceil(s / 7)"),
    ("bitand_", "BITAND(s,12)", "CAST(s AS BIGINT) & 12"), ("bitor_", "BITOR(s,12)", "CAST(s AS BIGINT) | 12"), ("bitxor_", "BITXOR(s,12)", "xor(CAST(s AS BIGINT), 12)"), ("bitlshift_", "BITLSHIFT(s,3)", "s * 8"), ("bitrshift_", "BITRSHIFT(s,1)", "floor(s / 2)"),
    ("delta_", "DELTA(s,5)", "CASE WHEN s = 5 THEN 1 ELSE 0 END"), ("gestep_", "GESTEP(s,25)", "CASE WHEN s >= 25 THEN 1 ELSE 0 END"),
])

_TENS, _ONES = "['', 'X', 'XX', 'XXX', 'XL', 'L']", "['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX']"
_B = lambda n, base: f"upper(to_base(CAST({n} AS BIGINT), {base}))"

family("number_bases", PART, [
    ("base_t", "BASE(k,7)", _B("k", 7)), ("decimal_", "DECIMAL(BASE(k,7),7)", "k"), ("roman_t", "ROMAN(s)", f"({_TENS})[CAST(floor(s / 10) AS INTEGER) + 1] || ({_ONES})[CAST(s AS INTEGER) % 10 + 1]"), ("arabic_", "ARABIC(ROMAN(s))", "s"),
    ("dec2bin_t", "DEC2BIN(s)", _B("s", 2)), ("dec2bin_neg_t", "DEC2BIN(0-s)", _B("1024 - s", 2)), ("dec2hex_t", "DEC2HEX(k)", _B("k", 16)), ("dec2oct_t", "DEC2OCT(k)", _B("k", 8)), ("bin2dec_", "BIN2DEC(DEC2BIN(0-s))", "-s"), ("hex2dec_", "HEX2DEC(DEC2HEX(0-k))", "-k"), ("oct2dec_", "OCT2DEC(DEC2OCT(k))", "k"),
    ("bin2hex_t", "BIN2HEX(DEC2BIN(s))", _B("s", 16)), ("bin2oct_t", "BIN2OCT(DEC2BIN(s))", _B("s", 8)), ("hex2bin_t", "HEX2BIN(DEC2HEX(s))", _B("s", 2)), ("hex2oct_t", "HEX2OCT(DEC2HEX(s))", _B("s", 8)), ("oct2bin_t", "OCT2BIN(DEC2OCT(s))", _B("s", 2)), ("oct2hex_t", "OCT2HEX(DEC2OCT(s))", _B("s", 16)),
    ("convert_", 'CONVERT(s,"in","cm")', "s * 2.54"), ("convert_temp", 'CONVERT(s,"C","F")', "s * 9 / 5 + 32"),
])


# Distributions as power series, and inverses by what they undo.

_X = "(s / 20)"
family("normal_and_relatives", PART, [
    ("normsdist_", "NORMSDIST(s/20)", norm_cdf(_X)), ("norm_s_dist", "NORM.S.DIST(s/20,TRUE)", norm_cdf(_X)), ("norm_s_pdf", "NORM.S.DIST(s/20,FALSE)", norm_pdf(_X)), ("norm_dist", "NORM.DIST(v,950,40,TRUE)", norm_cdf("((v - 950) / 40)")), ("normdist_", "NORMDIST(v,950,40,FALSE)", norm_pdf("((v - 950) / 40)") + " / 40"),
    ("norm_inv", "NORM.INV(NORM.DIST(v,950,40,TRUE),950,40)", "v"), ("norminv_", "NORMINV(NORMDIST(v,950,40,TRUE),950,40)", "v"), ("norm_s_inv", "NORM.S.INV(NORM.S.DIST(s/20,TRUE))", _X), ("normsinv_", "NORMSINV(NORMSDIST(s/20))", _X),
    ("lognorm_dist", "LOGNORM.DIST(s,2,0.8,TRUE)", norm_cdf("((ln(s) - 2) / 0.8)")), ("lognorm_pdf", "LOGNORM.DIST(s,2,0.8,FALSE)", norm_pdf("((ln(s) - 2) / 0.8)") + " / (0.8 * s)"), ("lognormdist_", "LOGNORMDIST(s,2,0.8)", norm_cdf("((ln(s) - 2) / 0.8)")),
    ("lognorm_inv", "LOGNORM.INV(LOGNORM.DIST(s,2,0.8,TRUE),2,0.8)", "s"), ("loginv_", "LOGINV(LOGNORMDIST(s,2,0.8),2,0.8)", "s"), ("erf_", "ERF(s/40)", f"2 * {norm_cdf('(s / 40 * sqrt(2))')} - 1"), ("erf_two", "ERF(s/80,s/40)", f"2 * ({norm_cdf('(s / 40 * sqrt(2))')} - {norm_cdf('(s / 80 * sqrt(2))')})"),
    ("erf_precise", "ERF.PRECISE(s/40)", f"2 * {norm_cdf('(s / 40 * sqrt(2))')} - 1"), ("erfc_", "ERFC(s/40)", f"2 - 2 * {norm_cdf('(s / 40 * sqrt(2))')}"), ("erfc_precise", "ERFC.PRECISE(s/40)", f"2 - 2 * {norm_cdf('(s / 40 * sqrt(2))')}"),
    ("standardize_", "STANDARDIZE(v,950,40)", "(v - 950) / 40"), ("confidence_norm", "CONFIDENCE.NORM(2-2*NORM.S.DIST(s/20,TRUE),3,16)", f"{_X} * 3 / 4"), ("confidence_", "CONFIDENCE(2-2*NORM.S.DIST(s/20,TRUE),3,16)", f"{_X} * 3 / 4"),
    ("fisher_", "FISHER(s/60)", "ln((60 + s) / (60 - s)) / 2"), ("fisherinv_", "FISHERINV(s/20)", "1 - 2 / (exp(s / 10) + 1)"),
], 6)

_GAMMA_PDF = "exp(1.5 * ln(s / 5) - s / 10 - lgamma(2.5) - 2.5 * ln(2))"
family("gamma_and_chi_squared", PART, [
    ("gamma_", "GAMMA(s/10+0.3)", "exp(lgamma(s / 10 + 0.3))"), ("gammaln_", "GAMMALN(s)", "coalesce(list_sum(list_transform(range(1, CAST(s AS INTEGER)), lambda i: ln(i))), 0)"), ("gammaln_precise", "GAMMALN.PRECISE(s+0.5)", "lgamma(s + 0.5)"),
    ("gamma_dist", "GAMMA.DIST(s/5,2.5,2,TRUE)", gamma_p("2.5", "s / 10")), ("gammadist_", "GAMMADIST(s/5,2.5,2,FALSE)", _GAMMA_PDF), ("gamma_inv", "GAMMA.INV(GAMMA.DIST(s/5,2.5,2,TRUE),2.5,2)", "s / 5"), ("gammainv_", "GAMMAINV(GAMMADIST(s/5,2.5,2,TRUE),2.5,2)", "s / 5"),
    ("chisq_dist", "CHISQ.DIST(s/5,7,TRUE)", gamma_p("3.5", "s / 10")), ("chisq_pdf", "CHISQ.DIST(s/5,7,FALSE)", "exp(2.5 * ln(s / 5) - s / 10 - 3.5 * ln(2) - lgamma(3.5))"), ("chisq_dist_rt", "CHISQ.DIST.RT(s/5,7)", "1 - " + gamma_p("3.5", "s / 10")), ("chidist_", "CHIDIST(s/5,4)", "exp(-s / 10) * (1 + s / 10)"),
    ("chisq_inv", "CHISQ.INV(CHISQ.DIST(s/5,7,TRUE),7)", "s / 5"), ("chisq_inv_rt", "CHISQ.INV.RT(CHISQ.DIST.RT(s/5,7),7)", "s / 5"), ("chiinv_", "CHIINV(CHIDIST(s/5,7),7)", "s / 5"),
    ("expon_dist", "EXPON.DIST(s/10,0.4,TRUE)", "1 - exp(-s / 25)"), ("expondist_", "EXPONDIST(s/10,0.4,FALSE)", "0.4 * exp(-s / 25)"), ("weibull_dist", "WEIBULL.DIST(s/10,1.5,3,TRUE)", "1 - exp(-power(s / 30, 1.5))"), ("weibull_", "WEIBULL(s/10,1.5,3,FALSE)", "0.5 * sqrt(s / 30) * exp(-power(s / 30, 1.5))"),
    ("poisson_dist", "POISSON.DIST(MOD(s,12),s/10,TRUE)", "list_sum(list_transform(range(0, CAST(s AS INTEGER) % 12 + 1), lambda i: exp(i * ln(s / 10) - s / 10 - lgamma(i + 1))))"), ("poisson_", "POISSON(MOD(s,12),s/10,FALSE)", "exp((s % 12) * ln(s / 10) - s / 10 - lgamma(s % 12 + 1))"),
], 6)

_Y = "(s / 70)"
_TT = "(s * s / 400 / (6 + s * s / 400))"  # T of 6 degrees is F(x) = 1/2 + I(x^2 / (6 + x^2), 1/2, 3) / 2, a series that converges fast
_FF = "(4 * s / 20 / (4 * s / 20 + 9))"
_T_PDF = "exp(lgamma(3.5) - lgamma(3) - 0.5 * ln(6 * pi()) - 3.5 * ln(1 + s * s / 2400))"
_F_PDF = "exp(lgamma(6.5) - lgamma(2) - lgamma(4.5) + 2 * ln(4) + 4.5 * ln(9) + ln(s / 20) - 6.5 * ln(9 + 4 * s / 20))"
_BIN = lambda k, n, p: f"exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1) + ({k}) * ln({p}) + ({n} - ({k})) * ln(1 - ({p})))"
_HYP = lambda k: f"exp(lgamma(11) - lgamma({k} + 1) - lgamma(11 - {k}) + lgamma(s + 11) - lgamma(8 - {k} + 1) - lgamma(s + 3 + {k}) - (lgamma(s + 21) - lgamma(9) - lgamma(s + 13)))"
family("beta_distribution", PART, [
    ("beta_dist", "BETA.DIST(s/70,2.5,1.5,TRUE)", beta_i(_Y, "2.5", "1.5")), ("beta_pdf", "BETA.DIST(s/70,2.5,1.5,FALSE)", f"exp(1.5 * ln{_Y} + 0.5 * ln(1 - {_Y}) + lgamma(4) - lgamma(2.5) - lgamma(1.5))"), ("betadist_", "BETADIST(s/70,2.5,1.5)", beta_i(_Y, "2.5", "1.5")), ("beta_wide", "BETA.DIST(1+s/35,2.5,1.5,TRUE,1,3)", beta_i(_Y, "2.5", "1.5")),
], 6)

family("t_distribution", PART, [
    ("t_dist", "T.DIST(s/20,6,TRUE)", f"0.5 + {beta_i(_TT, '0.5', '3')} / 2"), ("t_pdf", "T.DIST(s/20,6,FALSE)", _T_PDF), ("t_dist_rt", "T.DIST.RT(s/20,1)", "0.5 - atan(s / 20) / pi()"), ("t_dist_2t", "T.DIST.2T(s/20,2)", "1 - (s / 20) / sqrt(2 + s * s / 400)"), ("tdist_", "TDIST(s/20,1,2)", "1 - 2 * atan(s / 20) / pi()"),
], 6)

family("f_distribution", PART, [
    ("f_dist", "F.DIST(s/20,4,9,TRUE)", beta_i(_FF, "2", "4.5")), ("f_pdf", "F.DIST(s/20,4,9,FALSE)", _F_PDF), ("f_dist_rt", "F.DIST.RT(s/20,4,9)", "1 - " + beta_i(_FF, "2", "4.5")), ("fdist_", "FDIST(s/20,2,2)", "1 / (1 + s / 20)"),
], 6)

family("counting_distributions", PART, [
    ("binom_dist", "BINOM.DIST(MOD(s,9),12,s/70,TRUE)", f"list_sum(list_transform(range(0, CAST(s AS INTEGER) % 9 + 1), lambda i: {_BIN('i', '12', _Y)}))"), ("binomdist_", "BINOMDIST(MOD(s,9),12,s/70,FALSE)", _BIN("(s % 9)", "12", _Y)), ("binom_range", "BINOM.DIST.RANGE(12,s/70,3,5)", f"list_sum(list_transform(range(3, 6), lambda i: {_BIN('i', '12', _Y)}))"),
    ("binom_inv", "BINOM.INV(12,s/70,0.6)", f"len(list_filter(range(0, 13), lambda j: list_sum(list_transform(range(0, j + 1), lambda i: {_BIN('i', '12', _Y)})) < 0.6))"), ("critbinom_", "CRITBINOM(12,s/70,0.25)", f"len(list_filter(range(0, 13), lambda j: list_sum(list_transform(range(0, j + 1), lambda i: {_BIN('i', '12', _Y)})) < 0.25))"),
    ("negbinom_dist", "NEGBINOM.DIST(MOD(s,9),4,0.3,TRUE)", "list_sum(list_transform(range(0, CAST(s AS INTEGER) % 9 + 1), lambda i: exp(lgamma(i + 4) - lgamma(i + 1) - lgamma(4) + 4 * ln(0.3) + i * ln(0.7))))"), ("negbinomdist_", "NEGBINOMDIST(MOD(s,9),4,0.3)", "exp(lgamma(s % 9 + 4) - lgamma(s % 9 + 1) - lgamma(4) + 4 * ln(0.3) + (s % 9) * ln(0.7))"),
    ("hypgeom_dist", "HYPGEOM.DIST(3,8,10,s+20,TRUE)", f"list_sum(list_transform(range(0, 4), lambda i: {_HYP('i')}))"), ("hypgeomdist_", "HYPGEOMDIST(3,8,10,s+20)", _HYP("3")),
], 6)


# Finance.

_G = lambda r, n: f"power(1 + {r}, {n})"
_LOAN = f"(v * 0.01 * {_G('0.01', 24)} / ({_G('0.01', 24)} - 1))"  # the payment of a loan of v over 24 months at 1%
_OWED = lambda p: f"(v * {_G('0.01', p)} - {_LOAN} * ({_G('0.01', p)} - 1) / 0.01)"
_M = "(CAST(s AS INTEGER) % 24 + 1)"
_LEFT = lambda n: f"(v * power(0.8, {n}))"  # declining balance of 10 years at 2 / 10
family("loans_and_depreciation", PART, [
    ("pmt_", "PMT(0.01,24,v)", f"-{_LOAN}"), ("pmt_due", "PMT(0.01,24,v,0,1)", f"-{_LOAN} / 1.01"), ("ipmt_", "IPMT(0.01,MOD(s,24)+1,24,v)", f"-0.01 * {_OWED(f'({_M} - 1)')}"), ("ppmt_", "PPMT(0.01,MOD(s,24)+1,24,v)", f"-({_LOAN} - 0.01 * {_OWED(f'({_M} - 1)')})"), ("cumipmt_", "CUMIPMT(0.01,24,v,1,MOD(s,24)+1,0)", f"-({_M} * {_LOAN} - (v - {_OWED(_M)}))"), ("cumprinc_", "CUMPRINC(0.01,24,v,1,MOD(s,24)+1,0)", f"-(v - {_OWED(_M)})"),
    ("fv_", "FV(0.01,s,0-10,0-v)", f"v * {_G('0.01', 's')} + 10 * ({_G('0.01', 's')} - 1) / 0.01"), ("pv_", "PV(0.01,s,0-10)", f"10 * (1 - {_G('0.01', '-s')}) / 0.01"), ("nper_", "NPER(0.01,0-PMT(0.01,s+1,v),0-v)", "s + 1"), ("rate_", "RATE(24,PMT(s/1000,24,v),v)", "s / 1000"), ("ispmt_", "ISPMT(0.01,MOD(s,24),24,v)", "-v * 0.01 * (1 - (s % 24) / 24)"),
    ("effect_", "EFFECT(s/100,4)", f"{_G('s / 400', 4)} - 1"), ("nominal_", "NOMINAL(EFFECT(s/100,4),4)", "s / 100"), ("rri_", "RRI(s,v,v*2)", "power(2, 1 / s) - 1"), ("pduration_", "PDURATION(s/100,v,v*2)", "ln(2) / ln(1 + s / 100)"), ("fvschedule_", "FVSCHEDULE(v,{0.01,0.02,0.03})", "v * 1.01 * 1.02 * 1.03"), ("npv_", "NPV(s/100,v,v,v)", " + ".join(f"v / {_G('s / 100', i)}" for i in (1, 2, 3))),
    ("sln_", "SLN(v,100,s)", "(v - 100) / s"), ("syd_", "SYD(v,100,10,MOD(s,10)+1)", "(v - 100) * (10 - s % 10) / 55"), ("ddb_", "DDB(v,0,10,MOD(s,10)+1)", f"{_LEFT('(s % 10)')} * 0.2"), ("db_", "DB(v,100,10,MOD(s,10)+1)", "v * power(1 - round(1 - power(100 / v, 0.1), 3), s % 10) * round(1 - power(100 / v, 0.1), 3)"), ("vdb_", "VDB(v,0,10,0,MOD(s,5)+1)", f"v - {_LEFT('(s % 5 + 1)')}"),
    ("dollarde_", "DOLLARDE(s+0.05,8)", "s + 0.5 / 8"), ("dollarfr_", "DOLLARFR(s+0.0625,8)", "s + 0.05"),
], 6)

_S, _E = "DATE(2024,1,15)", "DATE(2024,1,15)+s*5"  # settlement, and maturity at 5 days for each unit of s
_DAYS = "(s * 5)"
_FLOWS = lambda y: f"(list_sum(list_transform(range(1, 11), lambda i: 2.5 / power(1 + ({y}) / 2, i))) + 100 / power(1 + ({y}) / 2, 10))"
_TIMES = lambda y: f"((list_sum(list_transform(range(1, 11), lambda i: i / 2.0 * 2.5 / power(1 + ({y}) / 2, i))) + 5 * 100 / power(1 + ({y}) / 2, 10)) / {_FLOWS(y)})"
_BOND = f"{_S},DATE(2029,1,15)"
_YLD = "(s / 1000)"
family("securities", PART, [
    ("disc_", f"DISC({_S},{_E},97,100,2)", f"0.03 * 360 / {_DAYS}"), ("intrate_", f"INTRATE({_S},{_E},v,v*1.02,2)", f"0.02 * 360 / {_DAYS}"), ("received_", f"RECEIVED({_S},{_E},v,0.05,2)", f"v / (1 - 0.05 * {_DAYS} / 360)"), ("pricedisc_", f"PRICEDISC({_S},{_E},0.05,100,3)", f"100 - 100 * 0.05 * {_DAYS} / 365"), ("yielddisc_", f"YIELDDISC({_S},{_E},97,100,3)", f"3 / 97 * 365 / {_DAYS}"),
    ("tbillprice_", f"TBILLPRICE({_S},{_E},0.05)", f"100 * (1 - 0.05 * {_DAYS} / 360)"), ("tbillyield_", f"TBILLYIELD({_S},{_E},97)", f"3 / 97 * 360 / {_DAYS}"), ("tbilleq_", f"TBILLEQ({_S},{_S}+MOD(s,30)*5+20,0.05)", "365 * 0.05 / (360 - 0.05 * (s % 30 * 5 + 20))"), ("accrintm_", f"ACCRINTM({_S},{_E},0.06,v,3)", f"v * 0.06 * {_DAYS} / 365"),
    ("price_", f"PRICE({_BOND},0.05,s/1000,100,2,0)", _FLOWS(_YLD)), ("duration_", f"DURATION({_BOND},0.05,s/1000,2,0)", _TIMES(_YLD)), ("mduration_", f"MDURATION({_BOND},0.05,s/1000,2,0)", f"{_TIMES(_YLD)} / (1 + {_YLD} / 2)"),
    ("pricemat_", f"PRICEMAT({_S},{_S}+360,{_S}-100,0.05,s/1000,2)", f"100 * (1 + 460 / 360.0 * 0.05) / (1 + {_YLD}) - 100 * 100 / 360.0 * 0.05"), ("yieldmat_", f"YIELDMAT({_S},{_S}+360,{_S}-100,0.05,PRICEMAT({_S},{_S}+360,{_S}-100,0.05,s/1000,2),2)", _YLD),
    ("coupnum_", f"COUPNUM(DATE(2024,1,20),EDATE({_S},s*6),2,0)", "s"), ("couppcd_d", "COUPPCD(DATE(2024,1,20),EDATE(DATE(2024,1,15),s*6),2,0)", "DATE '2024-01-15'"), ("coupncd_d", "COUPNCD(DATE(2024,1,20),EDATE(DATE(2024,1,15),s*6),2,0)", "DATE '2024-07-15'"), ("coupdaybs_", "COUPDAYBS(DATE(2024,1,15)+MOD(s,28),DATE(2029,1,15),2,1)", "s % 28"), ("coupdaysnc_", "COUPDAYSNC(DATE(2024,1,15)+MOD(s,28),DATE(2029,1,15),2,1)", "182 - s % 28"), ("coupdays_", "COUPDAYS(DATE(2024,1,15)+MOD(s,28),DATE(2029,1,15),2,1)", "182"),
    ("oddlyield_", "ODDLYIELD(DATE(2024,2,1),DATE(2024,6,15),DATE(2024,1,15),0.05,ODDLPRICE(DATE(2024,2,1),DATE(2024,6,15),DATE(2024,1,15),0.05,s/1000,100,2,0),100,2,0)", _YLD),
], 6)


# Dates.

_LATE = "CAST(d + CAST(n * 10 AS INTEGER) AS DATE)"
_END = "CAST(d + CAST(n AS INTEGER) AS DATE)"
_WORK = lambda a, z, off: f"len(list_filter(range(0, date_diff('day', {a}, {z}) + 1), lambda i: isodow({a} + CAST(i AS INTEGER)) NOT IN ({off})))"
_30 = lambda a, z: f"(360 * (year({z}) - year({a})) + 30 * (month({z}) - month({a})) + least(day({z}), 30) - least(day({a}), 30))"
family("calendar", ORDERS, [
    ("date_d", "DATE(YEAR(d),MONTH(d)+3,DAY(d))", "CAST(make_date(year(d), month(d), 1) + INTERVAL 3 MONTH AS DATE) + CAST(day(d) - 1 AS INTEGER)"), ("days_", "DAYS(d+n,d)", "n"), ("days360_", "DAYS360(d,d+n,TRUE)", _30("d", _END)), ("edate_d", "EDATE(d,5)", "d + INTERVAL 5 MONTH"), ("eomonth_d", "EOMONTH(d,2)", "last_day(CAST(d + INTERVAL 2 MONTH AS DATE))"),
    ("weeknum_", "WEEKNUM(d)", "floor((dayofyear(d) + dayofweek(make_date(year(d), 1, 1)) - 1) / 7) + 1"), ("weeknum_mon", "WEEKNUM(d,2)", "floor((dayofyear(d) + isodow(make_date(year(d), 1, 1)) - 2) / 7) + 1"), ("isoweeknum_", "ISOWEEKNUM(d)", "weekofyear(d)"), ("weekday_", "WEEKDAY(d)", "dayofweek(d) + 1"), ("weekday_mon", "WEEKDAY(d,3)", "isodow(d) - 1"),
    ("networkdays_", "NETWORKDAYS(d,d+n)", _WORK("d", _END, "6, 7")), ("networkdays_intl", "NETWORKDAYS.INTL(d,d+n,7)", _WORK("d", _END, "5, 6")), ("networkdays_mask", 'NETWORKDAYS.INTL(d,d+n,"1000001")', _WORK("d", _END, "1, 7")),
    ("workday_d", "WORKDAY(d,n+1)", "d + CAST(list_filter(range(1, 200), lambda j: isodow(d + CAST(j AS INTEGER)) NOT IN (6, 7))[CAST(n AS INTEGER) + 1] AS INTEGER)"), ("workday_intl_d", "WORKDAY.INTL(d,n+1,11)", "d + CAST(list_filter(range(1, 200), lambda j: isodow(d + CAST(j AS INTEGER)) <> 7)[CAST(n AS INTEGER) + 1] AS INTEGER)"),
    ("datedif_m", 'DATEDIF(d,d+n*10,"m")', f"12 * (year({_LATE}) - year(d)) + month({_LATE}) - month(d) - CASE WHEN day({_LATE}) < day(d) THEN 1 ELSE 0 END"), ("datedif_days", 'DATEDIF(d,d+n,"d")', "n"), ("yearfrac_2", "YEARFRAC(d,d+n,2)", "n / 360"), ("yearfrac_3", "YEARFRAC(d,d+n,3)", "n / 365"), ("yearfrac_4", "YEARFRAC(d,d+n,4)", _30("d", _END) + " / 360.0"),
    ("datevalue_d", 'DATEVALUE(TEXT(d,"yyyy-mm-dd"))', "d"), ("text_t", 'TEXT(d,"dddd d mmmm yyyy")', "strftime(d, '%A %-d %B %Y')"), ("time_", "TIME(n,n,n)", "((n * 3661) % 86400) / 86400"), ("timevalue_", 'TIMEVALUE("13:30")+n', "0.5625 + n"), ("hour_", "HOUR(n/24+0.01)", "n % 24"), ("minute_", "MINUTE(n/1440+0.0001)", "n % 60"), ("second_", "SECOND(n/86400)", "n % 60"), ("year_", "YEAR(d+n)", f"year({_END})"), ("month_", "MONTH(d+n)", f"month({_END})"), ("day_", "DAY(d+n)", f"day({_END})"),
])


# Text, logic and information.

family("texts", PART, [
    ("lenb_", "LENB(name)", "length(name)"), ("leftb_t", "LEFTB(name,3)", "left(name, 3)"), ("rightb_t", "RIGHTB(name,3)", "right(name, 3)"), ("midb_t", "MIDB(name,2,4)", "substring(name, 2, 4)"), ("findb_", 'FINDB(" ",name)', "instr(name, ' ')"), ("searchb_", 'SEARCHB("E",name&"e")', "instr(name || 'e', 'e')"), ("replaceb_t", 'REPLACEB(name,2,3,"-")', "left(name, 1) || '-' || substring(name, 5)"),
    ("asc_t", "ASC(DBCS(name))", "name"), ("char_t", "CHAR(s+64)", "chr(CAST(s AS INTEGER) + 64)"), ("code_", "CODE(brand)", "66"), ("unichar_t", "UNICHAR(s+945)", "chr(CAST(s AS INTEGER) + 945)"), ("unicode_", "UNICODE(UNICHAR(s+945))", "s + 945"), ("clean_t", "CLEAN(name&CHAR(7)&CHAR(10))", "name"), ("concat_t", 'CONCAT(brand,"/",s)', "brand || '/' || CAST(s AS INTEGER)"), ("concatenate_t", "CONCATENATE(brand,name)", "brand || name"),
    ("fixed_t", "FIXED(v*10,0)", "format('{:,}', CAST(floor(v * 10 + 0.5) AS BIGINT))"), ("exact_b", "EXACT(kind,UPPER(kind))", "kind = upper(kind)"), ("numbervalue_", 'NUMBERVALUE("1.234,5"&s,",",".")', "CAST('1234.5' || CAST(s AS INTEGER) AS DOUBLE)"), ("proper_t", "PROPER(name)", "array_to_string(list_transform(string_split(name, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"),
    ("replace_t", 'REPLACE(name,1,2,"#")', "'#' || substring(name, 3)"), ("rept_t", 'REPT("ab",MOD(s,4))', "repeat('ab', CAST(s AS INTEGER) % 4)"), ("substitute_t", 'SUBSTITUTE(name,"e","EE",1)', "CASE WHEN instr(name, 'e') = 0 THEN name ELSE left(name, instr(name, 'e') - 1) || 'EE' || substring(name, instr(name, 'e') + 1) END"), ("t_t", "T(name)", "name"), ("text_t", 'TEXT(v,"0.00")', "format('{:.2f}', v)"), ("textafter_t", 'TEXTAFTER(name," ")', "split_part(name, ' ', 2)"), ("textbefore_t", 'TEXTBEFORE(name," ")', "split_part(name, ' ', 1)"),
    ("trim_t", 'TRIM("  "&name&"   x ")', "name || ' x'"), ("upper_t", "UPPER(name)", "upper(name)"), ("lower_t", "LOWER(brand)", "lower(brand)"), ("value_", 'VALUE(s&"%")', "s / 100"), ("valuetotext_t", "VALUETOTEXT(name,1)", "'\"' || name || '\"'"), ("encodeurl_t", 'ENCODEURL(brand&" ")', "replace(brand, '#', '%23') || '%20'"), ("len_", "LEN(name)", "length(name)"), ("mid_t", "MID(name,3,2)", "substring(name, 3, 2)"), ("left_t", "LEFT(name)", "left(name, 1)"), ("right_t", "RIGHT(name,2)", "right(name, 2)"), ("find_", 'FIND("g",name&"g")', "instr(name || 'g', 'g')"), ("search_", 'SEARCH("?g",name&"xg")', "CASE WHEN instr(substring(name || 'xg', 2), 'g') > 0 THEN instr(substring(name || 'xg', 2), 'g') END"),
])

family("logic_and_information", PART, [
    ("and_b", "AND(s>10,v<950)", "s > 10 AND v < 950"), ("or_b", "OR(s>40,v<910)", "s > 40 OR v < 910"), ("xor_b", "XOR(s>25,v<950)", "(s > 25) <> (v < 950)"), ("not_b", "NOT(s>25)", "s <= 25"), ("true_b", "TRUE()", "TRUE"), ("false_b", "FALSE()", "FALSE"), ("if_", "IF(s>25,s,0-s)", "CASE WHEN s > 25 THEN s ELSE -s END"), ("ifs_", "IFS(s>40,3,s>20,2,TRUE,1)", "CASE WHEN s > 40 THEN 3 WHEN s > 20 THEN 2 ELSE 1 END"), ("switch_", "SWITCH(MOD(s,4),0,10,1,20,99)", "CASE CAST(s AS INTEGER) % 4 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 99 END"), ("choose_", "CHOOSE(MOD(s,3)+1,s,v,7)", "CASE CAST(s AS INTEGER) % 3 WHEN 0 THEN s WHEN 1 THEN v ELSE 7 END"),
    ("iferror_", "IFERROR(LN(s-25),0-1)", "CASE WHEN s > 25 THEN ln(s - 25) ELSE -1 END"), ("ifna_", "IFNA(MATCH(s,{1,2,3},0),9)", "CASE WHEN s <= 3 THEN s ELSE 9 END"), ("iserr_b", "ISERR(LN(s-25))", "s <= 25"), ("iserror_b", "ISERROR(1/(s-25))", "s = 25"), ("isna_b", "ISNA(MATCH(s,{1,2,3},0))", "s > 3"), ("iseven_b", "ISEVEN(s)", "s % 2 = 0"), ("isodd_b", "ISODD(s)", "s % 2 = 1"), ("islogical_b", "ISLOGICAL(s>5)", "TRUE"), ("isnontext_b", "ISNONTEXT(name)", "FALSE"), ("isnumber_b", "ISNUMBER(SQRT(s-25))", "s >= 25"), ("istext_b", "ISTEXT(name)", "TRUE"), ("isblank_b", "ISBLANK(name)", "FALSE"),
    ("n_", "N(s>25)", "CASE WHEN s > 25 THEN 1 ELSE 0 END"), ("type_", "TYPE(name)", "2"), ("errortype_", "ERROR.TYPE(1/(s-s))", "2"), ("let_", "LET(a,s,b,a*a,a+b)", "s + s * s"), ("lookup_", "LOOKUP(s,{0,20,40},{1,2,3})", "CASE WHEN s >= 40 THEN 3 WHEN s >= 20 THEN 2 ELSE 1 END"), ("hlookup_", "HLOOKUP(s,{0,20,40;1,2,3},2)", "CASE WHEN s >= 40 THEN 3 WHEN s >= 20 THEN 2 ELSE 1 END"), ("vlookup_", "VLOOKUP(s,{0,1;20,2;40,3},2)", "CASE WHEN s >= 40 THEN 3 WHEN s >= 20 THEN 2 ELSE 1 END"), ("xlookup_", "XLOOKUP(s,{10,20,30},{1,2,3},0)", "CASE s WHEN 10 THEN 1 WHEN 20 THEN 2 WHEN 30 THEN 3 ELSE 0 END"), ("match_", "MATCH(s,{0,20,40},1)", "CASE WHEN s >= 40 THEN 3 WHEN s >= 20 THEN 2 ELSE 1 END"), ("xmatch_", "XMATCH(s,{0,20,60},1)", "CASE WHEN s <= 20 THEN 2 ELSE 3 END"), ("index_", "INDEX({5,6,7},MOD(s,3)+1)", "5 + CAST(s AS INTEGER) % 3"), ("address_t", "ADDRESS(s,2,4)", "'B' || CAST(s AS INTEGER)"),
    ("reduce_", "REDUCE(s,{1,2,3},LAMBDA(a,b,a*2+b))", "((s * 2 + 1) * 2 + 2) * 2 + 3"), ("lambda_", "LAMBDA(x,x*x+1)(s)", "s * s + 1"),
])
