"""Distributions (Arrow functions over numpy) and statistical aggregates (built-in aggregates and their compositions)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import special as sp
from .core import aggregate, scalar
from .engineering import arrow, numeric

NUM, DIV, NA = "#NUM!", "#DIV/0!", "#N/A"


def _pick(cum, cdf, pdf):
    return np.where(cum != 0, cdf, pdf)


# Distributions. Guards are over columns, bodies over arrays.

numeric("NORM.DIST NORMDIST", lambda x, m, s, c: _pick(c, sp.norm_cdf((x - m) / s), np.exp(-(((x - m) / s) ** 2) / 2) / (s * math.sqrt(2 * math.pi))), 4, lambda x, m, s, c: s <= 0)
numeric("NORM.INV NORMINV", lambda p, m, s: m + s * sp.norm_inv(p), 3, lambda p, m, s: (p <= 0) | (p >= 1) | (s <= 0))
numeric("NORM.S.DIST", lambda z, c: _pick(c, sp.norm_cdf(z), np.exp(-z * z / 2) / math.sqrt(2 * math.pi)), 2)
numeric("NORMSDIST", sp.norm_cdf, 1)
numeric("NORM.S.INV NORMSINV", sp.norm_inv, 1, lambda p: (p <= 0) | (p >= 1))
numeric("GAUSS", lambda z: sp.norm_cdf(z) - 0.5, 1)
numeric("LOGNORM.DIST", lambda x, m, s, c: _pick(c, sp.norm_cdf((np.log(x) - m) / s), np.exp(-(((np.log(x) - m) / s) ** 2) / 2) / (x * s * math.sqrt(2 * math.pi))), 4, lambda x, m, s, c: (x <= 0) | (s <= 0))
numeric("LOGNORMDIST", lambda x, m, s: sp.norm_cdf((np.log(x) - m) / s), 3, lambda x, m, s: (x <= 0) | (s <= 0))
numeric("LOGNORM.INV LOGINV", lambda p, m, s: np.exp(m + s * sp.norm_inv(p)), 3, lambda p, m, s: (p <= 0) | (p >= 1) | (s <= 0))
numeric("BINOM.DIST BINOMDIST", lambda k, n, p, c: _pick(c, sp.binom_cdf(np.floor(k), np.floor(n), p), sp.binom_pmf(np.floor(k), np.floor(n), p)), 4, lambda k, n, p, c: (k < 0) | (F.floor(k) > F.floor(n)) | (p < 0) | (p > 1))
numeric("POISSON.DIST POISSON", lambda x, m, c: _pick(c, sp.gamma_p_q(np.floor(x) + 1, m)[1], np.exp(np.where(m > 0, np.floor(x) * np.log(np.where(m > 0, m, 1)), np.where(np.floor(x) > 0, -np.inf, 0)) - m - sp.lgamma(np.floor(x) + 1))), 3, lambda x, m, c: (x < 0) | (m < 0))
numeric("T.DIST", lambda x, d, c: _pick(c, sp.t_cdf(x, np.floor(d)), np.exp(sp.lgamma((np.floor(d) + 1) / 2) - sp.lgamma(np.floor(d) / 2)) / np.sqrt(np.floor(d) * math.pi) * (1 + x * x / np.floor(d)) ** (-(np.floor(d) + 1) / 2)), 3, lambda x, d, c: d < 1)
numeric("T.DIST.2T", lambda x, d: 2 * sp.t_tail(x, np.floor(d)), 2, lambda x, d: (x < 0) | (d < 1))
numeric("T.DIST.RT", lambda x, d: sp.t_tail(x, np.floor(d)), 2, lambda x, d: d < 1)
numeric("TDIST", lambda x, d, t: np.floor(t) * sp.t_tail(x, np.floor(d)), 3, lambda x, d, t: (x < 0) | (d < 1) | ~F.floor(t).isin(1, 2))
numeric("T.INV", lambda p, d: sp.t_inv(p, np.floor(d)), 2, lambda p, d: (p <= 0) | (p >= 1) | (d < 1))
numeric("T.INV.2T TINV", lambda p, d: -sp.t_inv(p / 2, np.floor(d)), 2, lambda p, d: (p <= 0) | (p > 1) | (d < 1))
numeric("CHISQ.DIST", lambda x, d, c: _pick(c, sp.gamma_p_q(np.floor(d) / 2, x / 2)[0], np.exp((np.floor(d) / 2 - 1) * np.log(np.where(x > 0, x, 1)) - x / 2 - np.floor(d) / 2 * math.log(2) - sp.lgamma(np.floor(d) / 2)) * np.where(x > 0, 1, np.where(np.floor(d) == 2, 1, 0))), 3, lambda x, d, c: (x < 0) | (d < 1))
numeric("CHISQ.DIST.RT CHIDIST", lambda x, d: sp.gamma_p_q(np.floor(d) / 2, x / 2)[1], 2, lambda x, d: (x < 0) | (d < 1))
numeric("CHISQ.INV", lambda p, d: sp.invert(lambda x: sp.gamma_p_q(np.floor(d) / 2, x / 2)[0], p, 0.0, np.maximum(d, 1.0)), 2, lambda p, d: (p < 0) | (p >= 1) | (d < 1))
numeric("CHISQ.INV.RT CHIINV", lambda p, d: sp.invert(lambda x: -sp.gamma_p_q(np.floor(d) / 2, x / 2)[1], -p, 0.0, np.maximum(d, 1.0)), 2, lambda p, d: (p <= 0) | (p > 1) | (d < 1))
numeric("F.DIST", lambda x, a, b, c: _pick(c, sp.f_cdf(x, np.floor(a), np.floor(b)), np.exp(sp.lgamma((np.floor(a) + np.floor(b)) / 2) - sp.lgamma(np.floor(a) / 2) - sp.lgamma(np.floor(b) / 2) + np.floor(a) / 2 * np.log(np.floor(a) / np.floor(b)) + (np.floor(a) / 2 - 1) * np.log(np.where(x > 0, x, 1)) - (np.floor(a) + np.floor(b)) / 2 * np.log1p(np.floor(a) * x / np.floor(b)))), 4, lambda x, a, b, c: (x < 0) | (a < 1) | (b < 1))
numeric("F.DIST.RT FDIST", lambda x, a, b: sp.f_tail(x, np.floor(a), np.floor(b)), 3, lambda x, a, b: (x < 0) | (a < 1) | (b < 1))
numeric("F.INV", lambda p, a, b: sp.invert(lambda x: sp.f_cdf(x, np.floor(a), np.floor(b)), p, 0.0, np.ones(len(p))), 3, lambda p, a, b: (p < 0) | (p >= 1) | (a < 1) | (b < 1))
numeric("F.INV.RT FINV", lambda p, a, b: sp.invert(lambda x: -sp.f_tail(x, np.floor(a), np.floor(b)), -p, 0.0, np.ones(len(p))), 3, lambda p, a, b: (p <= 0) | (p > 1) | (a < 1) | (b < 1))
numeric("GAMMA", sp.gamma, 1, lambda x: (x == 0) | ((x < 0) & (F.floor(x) == x)))
numeric("GAMMALN GAMMALN.PRECISE", sp.lgamma, 1, lambda x: x <= 0)
numeric("GAMMA.DIST GAMMADIST", lambda x, a, b, c: _pick(c, sp.gamma_p_q(a, x / b)[0], np.exp((a - 1) * np.log(np.where(x > 0, x, 1)) - x / b - a * np.log(b) - sp.lgamma(a)) * np.where(x > 0, 1, np.where(a == 1, 1, 0))), 4, lambda x, a, b, c: (x < 0) | (a <= 0) | (b <= 0))
numeric("GAMMA.INV GAMMAINV", lambda p, a, b: b * sp.invert(lambda x: sp.gamma_p_q(a, x)[0], p, 0.0, np.maximum(a, 1.0)), 3, lambda p, a, b: (p < 0) | (p >= 1) | (a <= 0) | (b <= 0))
_beta_pdf = lambda y, a, b, lo, hi: np.exp(sp.lgamma(a + b) - sp.lgamma(a) - sp.lgamma(b) + (a - 1) * np.log(y) + (b - 1) * np.log1p(-y)) / (hi - lo)
numeric("BETA.DIST", lambda x, a, b, c, lo, hi: _pick(c, sp.beta_i((x - lo) / (hi - lo), a, b), _beta_pdf((x - lo) / (hi - lo), a, b, lo, hi)), 6, lambda x, a, b, c, lo, hi: (a <= 0) | (b <= 0) | (x < lo) | (x > hi) | (lo == hi), defaults=(0, 1))
numeric("BETADIST", lambda x, a, b, lo, hi: sp.beta_i((x - lo) / (hi - lo), a, b), 5, lambda x, a, b, lo, hi: (a <= 0) | (b <= 0) | (x < lo) | (x > hi) | (lo == hi), defaults=(0, 1))
numeric("BETA.INV BETAINV", lambda p, a, b, lo, hi: lo + (hi - lo) * sp.invert(lambda y: sp.beta_i(y, a, b), p, 0.0, np.ones(len(p))), 5, lambda p, a, b, lo, hi: (a <= 0) | (b <= 0) | (p <= 0) | (p >= 1) | (lo >= hi), defaults=(0, 1))


def _hyper_pmf(k, n, big_k, big_n):
    ok = (k >= np.maximum(0, n + big_k - big_n)) & (k <= np.minimum(n, big_k))
    kk = np.where(ok, k, np.maximum(0, n + big_k - big_n))
    return np.where(ok, np.exp(sp.log_choose(big_k, kk) + sp.log_choose(big_n - big_k, n - kk) - sp.log_choose(big_n, n)), 0.0)


def _hyper(k, n, big_k, big_n, c):
    k, n, big_k, big_n = (np.floor(x) for x in (k, n, big_k, big_n))
    cdf, asked = np.zeros(len(k)), np.asarray(c, bool)
    if asked.any():
        lowest = np.maximum(0, n + big_k - big_n)
        for j in range(int((k - lowest)[asked].max()) + 1):
            cdf += np.where(lowest + j <= k, _hyper_pmf(lowest + j, n, big_k, big_n), 0.0)
    return _pick(c, cdf, _hyper_pmf(k, n, big_k, big_n))


_hyper_bad = lambda k, n, kk, nn, *_: (k < 0) | (n <= 0) | (kk <= 0) | (nn <= 0) | (n > nn) | (kk > nn) | (k > n) | (k > kk) | (k < n + kk - nn)
numeric("HYPGEOM.DIST", _hyper, 5, _hyper_bad)
numeric("HYPGEOMDIST", lambda k, n, kk, nn: _hyper_pmf(*(np.floor(x) for x in (k, n, kk, nn))), 4, _hyper_bad)
_negbinom = lambda f, s, p: np.exp(sp.log_choose(f + s - 1, f) + s * np.log(p) + np.where(f > 0, f * np.log1p(-p), 0))
numeric("NEGBINOM.DIST", lambda f, s, p, c: _pick(c, sp.beta_i(p, np.floor(s), np.floor(f) + 1), _negbinom(np.floor(f), np.floor(s), p)), 4, lambda f, s, p, c: (f < 0) | (s < 1) | (p <= 0) | (p > 1))
numeric("NEGBINOMDIST", lambda f, s, p: _negbinom(np.floor(f), np.floor(s), p), 3, lambda f, s, p: (f < 0) | (s < 1) | (p <= 0) | (p > 1))


def _binom_inv(n, p, a):
    """The smallest k with cdf >= a, by bisection over whole numbers."""
    n = np.floor(n)
    lo, hi = np.full(len(n), -1.0), n.copy()
    for _ in range(64):
        wide = np.flatnonzero(hi - lo > 1)
        if not len(wide):
            break
        mid = np.floor((lo[wide] + hi[wide]) / 2)
        under = sp.binom_cdf(mid, n[wide], p[wide]) < a[wide]
        lo[wide], hi[wide] = np.where(under, mid, lo[wide]), np.where(under, hi[wide], mid)
    return hi


numeric("BINOM.INV CRITBINOM", _binom_inv, 3, lambda n, p, a: (n < 0) | (p < 0) | (p > 1) | (a < 0) | (a > 1))
_range = arrow(lambda n, p, a, b: sp.binom_cdf(np.floor(b), np.floor(n), p) - sp.binom_cdf(np.floor(a) - 1, np.floor(n), p), 4)


@scalar("BINOM.DIST.RANGE", "nnnn", defaults=(None,))
def _binom_range(n, p, a, b):
    top = F.coalesce(b, a)
    return _range(n, p, a, top), ((n < 0) | (p < 0) | (p > 1) | (a < 0) | (a > n) | (top < a) | (top > n), NUM)


numeric("CONFIDENCE.NORM CONFIDENCE", lambda a, s, n: -sp.norm_inv(a / 2) * s / np.sqrt(np.floor(n)), 3, lambda a, s, n: (a <= 0) | (a >= 1) | (s <= 0) | (n < 1))
numeric("CONFIDENCE.T", lambda a, s, n: -sp.t_inv(a / 2, np.floor(n) - 1) * s / np.sqrt(np.floor(n)), 3, lambda a, s, n: (a <= 0) | (a >= 1) | (s <= 0) | (n < 2))


@scalar("EXPON.DIST EXPONDIST", "nnn")
def _expon(x, rate, cum):
    return F.when(cum != 0, 1 - F.exp(-rate * x)).otherwise(rate * F.exp(-rate * x)), ((x < 0) | (rate <= 0), NUM)


@scalar("WEIBULL.DIST WEIBULL", "nnnn")
def _weibull(x, a, b, cum):
    body = F.exp(-F.pow(x / b, a))
    return F.when(cum != 0, 1 - body).otherwise(a / F.pow(b, a) * F.pow(x, a - 1) * body), ((x < 0) | (a <= 0) | (b <= 0), NUM)


@scalar("PHI")
def _phi(x):
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


@scalar("STANDARDIZE", "nnn")
def _standardize(x, m, s):
    return F.try_divide(x - m, s), (s <= 0, NUM)


# Aggregates.


@aggregate("MEDIAN")
def _median(x):
    return F.median(x), (F.count(x) == 0, NUM)


def _few(n: int, code: str = DIV):
    return lambda x: (F.count(x) < n, code)


for _names, _f, _least in (("STDEV.S STDEV STDEVA", F.stddev_samp, 2), ("STDEV.P STDEVP STDEVPA", F.stddev_pop, 1), ("VAR.S VAR VARA", F.var_samp, 2), ("VAR.P VARP VARPA", F.var_pop, 1), ("SKEW.P", F.skewness, 3)):
    aggregate(_names)((lambda f, n: lambda x: (f(x), _few(n)(x)))(_f, _least))


@aggregate("DEVSQ")
def _devsq(x):
    return F.var_pop(x) * F.count(x), (F.count(x) == 0, NUM)


@aggregate("AVEDEV")
def _avedev(x):
    """One pass: the values of a group meet in a histogram of distinct values, see `operators.ranking.average_deviation` for large groups."""
    seen = F.collect_list(x)
    mean = F.aggregate(seen, F.lit(0.0), lambda a, v: a + v) / F.size(seen)
    return F.aggregate(seen, F.lit(0.0), lambda a, v: a + F.abs(v - mean)) / F.size(seen), (F.count(x) == 0, NUM)


@aggregate("SKEW")
def _skew(x):
    n = F.count(x)
    return F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)), (n < 3, DIV)


@aggregate("KURT")
def _kurt(x):
    n = F.count(x)
    return ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)), (n < 4, DIV)


@aggregate("GEOMEAN")
def _geomean(x):
    return F.exp(F.avg(F.ln(x))), ((F.min(x) <= 0) | (F.count(x) == 0), NUM)


@aggregate("HARMEAN")
def _harmean(x):
    return F.count(x) / F.sum(F.try_divide(F.lit(1.0), x)), ((F.min(x) <= 0) | (F.count(x) == 0), NUM)


@aggregate("MODE.SNGL MODE")
def _mode(x):
    """The commonest value; of ties the smallest, as rows have no order in a group."""
    return F.mode(x, True), (F.count(x) - F.count_distinct(x) == 0, NA)


@aggregate("PERCENTILE.INC PERCENTILE", "nn")
def _percentile(x, k):
    return F.percentile(x, k), ((F.count(x) == 0), NUM)


@aggregate("QUARTILE.INC QUARTILE", "nn")
def _quartile(x, q):
    return F.percentile(x, F.floor(q) / 4), (F.count(x) == 0, NUM)


def exclusive(x: Column, k: Column):
    """The (n + 1) p rule, as an inclusive percentile at ((n + 1) p - 1) / (n - 1) over the group's sorted values."""
    s = F.sort_array(F.collect_list(x))
    n = F.size(s)
    at = k * (n + 1)
    low = F.floor(at).cast("int")
    a, b = F.try_element_at(s, F.greatest(low, F.lit(1))), F.try_element_at(s, F.least(low + 1, F.greatest(n, F.lit(1))))
    return a + (at - low) * (b - a), ((at < 1) | (at > n), NUM)


@aggregate("PERCENTILE.EXC", "nn")
def _percentile_exc(x, k):
    return exclusive(x, k)


@aggregate("QUARTILE.EXC", "nn")
def _quartile_exc(x, q):
    return exclusive(x, F.floor(q) / 4)


def _nth(x: Column, k: Column, asc: bool):
    s = F.sort_array(F.collect_list(x), asc)
    i = F.floor(k + 0.5).cast("int")
    return F.try_element_at(s, F.greatest(i, F.lit(1))), ((i < 1) | (i > F.size(s)), NUM)


@aggregate("LARGE", "nn")
def _large(x, k):
    return _nth(x, k, False)


@aggregate("SMALL", "nn")
def _small(x, k):
    return _nth(x, k, True)


@aggregate("TRIMMEAN", "nn")
def _trimmean(x, p):
    s = F.sort_array(F.collect_list(x))
    cut = F.floor(F.size(s) * p / 2).cast("int")
    kept = F.slice(s, cut + 1, F.greatest(F.size(s) - 2 * cut, F.lit(0)))
    return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, v: a + v), F.size(kept)), ((p < 0) | (p >= 1) | (F.size(s) == 0), NUM)


@aggregate("CORREL PEARSON", "nn")
def _correl(a, b):
    return F.corr(a, b), (F.coalesce(F.var_pop(a) * F.var_pop(b), F.lit(0.0)) == 0, DIV)


@aggregate("RSQ", "nn")
def _rsq(y, x):
    return F.pow(F.corr(y, x), 2), (F.coalesce(F.var_pop(y) * F.var_pop(x), F.lit(0.0)) == 0, DIV)


@aggregate("SLOPE", "nn")
def _slope(y, x):
    return F.regr_slope(y, x), (F.coalesce(F.regr_sxx(y, x), F.lit(0.0)) == 0, DIV)


@aggregate("INTERCEPT", "nn")
def _intercept(y, x):
    return F.regr_intercept(y, x), (F.coalesce(F.regr_sxx(y, x), F.lit(0.0)) == 0, DIV)


@aggregate("STEYX", "nn")
def _steyx(y, x):
    n = F.regr_count(y, x)
    rest = F.regr_syy(y, x) - F.try_divide(F.pow(F.regr_sxy(y, x), 2), F.regr_sxx(y, x))
    return F.sqrt(F.try_divide(F.greatest(rest, F.lit(0.0)), n - 2)), ((n < 3) | (F.coalesce(F.regr_sxx(y, x), F.lit(0.0)) == 0), DIV)


@aggregate("FORECAST.LINEAR FORECAST", "nnn")
def _forecast(at, y, x):
    return F.regr_intercept(y, x) + F.regr_slope(y, x) * F.max(at), (F.coalesce(F.regr_sxx(y, x), F.lit(0.0)) == 0, DIV)


@aggregate("COVARIANCE.P COVAR", "nn")
def _covariance_p(a, b):
    return F.covar_pop(a, b), (F.regr_count(a, b) == 0, DIV)


@aggregate("COVARIANCE.S", "nn")
def _covariance_s(a, b):
    return F.covar_samp(a, b), (F.regr_count(a, b) < 2, DIV)


@aggregate("PROB", "nnnn", defaults=(None,))
def _prob(x, p, lo, hi):
    total = F.sum(p)
    inside = F.when(hi.isNull(), x == lo).otherwise(x.between(lo, hi))
    return F.coalesce(F.sum(F.when(inside, p)), F.lit(0.0)), ((F.abs(total - 1) > 1e-9) | (F.min(p) < 0) | (F.max(p) > 1), NUM)


_upper_normal = arrow(lambda z: 0.5 * sp.erfc(z / math.sqrt(2)), 1)
_chi_tail = arrow(lambda x, d: sp.gamma_p_q(d / 2, x / 2)[1], 2)
_t_two = arrow(lambda t, d: 2 * sp.t_tail(np.abs(t), d), 2)
_f_two = arrow(lambda f, a, b: 2 * np.minimum(sp.f_cdf(f, a, b), sp.f_tail(f, a, b)), 3)


@aggregate("Z.TEST ZTEST", "nnn", defaults=(None,))
def _z_test(x, mu, sigma):
    sd = F.coalesce(F.max(sigma), F.stddev_samp(x))
    return _upper_normal(F.try_divide(F.avg(x) - F.max(mu), F.try_divide(sd, F.sqrt(F.count(x))))), (F.count(x) == 0, NA), (F.coalesce(sd, F.lit(0.0)) == 0, DIV)


@aggregate("F.TEST FTEST", "nn")
def _f_test(a, b):
    return _f_two(F.try_divide(F.var_samp(a), F.var_samp(b)), F.count(a) - 1, F.count(b) - 1), ((F.count(a) < 2) | (F.count(b) < 2) | (F.coalesce(F.var_samp(a) * F.var_samp(b), F.lit(0.0)) == 0), DIV)


@aggregate("T.TEST TTEST", "nnnn")
def _t_test(a, b, tails, kind):
    d = a - b
    n1, n2, v1, v2 = F.count(a), F.count(b), F.var_samp(a), F.var_samp(b)
    k = F.floor(F.max(kind))
    paired = F.try_divide(F.avg(d), F.sqrt(F.try_divide(F.var_samp(d), F.count(d))))
    pooled = F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2)
    equal = F.try_divide(F.avg(a) - F.avg(b), F.sqrt(pooled * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))))
    s1, s2 = F.try_divide(v1, n1), F.try_divide(v2, n2)
    welch = F.try_divide(F.avg(a) - F.avg(b), F.sqrt(s1 + s2))
    freedom = F.try_divide(F.pow(s1 + s2, 2), F.try_divide(s1 * s1, n1 - 1) + F.try_divide(s2 * s2, n2 - 1))
    t = F.when(k == 1, paired).when(k == 2, equal).when(k == 3, welch)
    df = F.when(k == 1, F.count(d) - 1).when(k == 2, n1 + n2 - 2).when(k == 3, freedom).cast("double")
    return _t_two(t, df) * F.floor(F.max(tails)) / 2, (~F.floor(F.max(tails)).isin(1, 2) | ~k.isin(1, 2, 3), NUM), (t.isNull(), DIV)


@aggregate("CHISQ.TEST CHITEST", "nn")
def _chisq_test(actual, expected):
    """Over one row or column of cells: the degrees of freedom are the cells less one."""
    x = F.sum(F.try_divide(F.pow(actual - expected, 2), expected))
    return _chi_tail(x, F.count(expected) - 1), (F.min(expected) < 1, NUM), (F.count(expected) < 2, NA)
