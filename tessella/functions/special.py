"""Special functions in numpy, for the Arrow functions of distributions, which Catalyst lacks.

Incomplete gamma and beta by series and continued fractions (the textbook forms),
inverses by bracketed bisection with Newton steps, Bessel functions by integrals.
All work on whole arrays, with NaN where a value does not exist.
"""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.frompyfunc(math.lgamma, 1, 1)
_erf, _erfc = np.frompyfunc(math.erf, 1, 1), np.frompyfunc(math.erfc, 1, 1)


def lgamma(x):
    x = np.asarray(x, float)
    ok = np.isfinite(x) & ~((x <= 0) & (x == np.floor(x)))
    return np.where(ok, np.asarray(_lgamma(np.where(ok, x, 1.0)), float), np.nan)


def gamma(x):
    x = np.asarray(x, float)
    sign = np.where((x < 0) & (np.floor(x) % 2 != 0), -1.0, 1.0)
    return sign * np.exp(lgamma(x)) if np.any(x != np.floor(x)) else np.round(sign * np.exp(lgamma(x)))


def erf(x):
    return np.asarray(_erf(np.asarray(x, float)), float)


def erfc(x):
    return np.asarray(_erfc(np.asarray(x, float)), float)


def norm_cdf(z):
    return 0.5 * erfc(-np.asarray(z, float) / math.sqrt(2))


def gamma_p_q(a, x):
    """Regularised lower and upper incomplete gamma functions."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    a, x = a.copy(), x.copy()
    bad = ~(a > 0) | ~(x >= 0)
    a[bad], x[bad] = 1.0, 1.0
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(np.where(x > 0, x, 1.0)) - x - lgamma(a))
        low = x < a + 1
        term = np.where(low, 1 / a, 0.0)
        total, n = term.copy(), a.copy()
        for _ in range(2000):
            n = n + 1
            term = term * x / n
            total = total + term
            if not np.any(np.abs(term) > np.abs(total) * 1e-17):
                break
        tiny = 1e-300
        b = x + 1 - a
        c, d = np.full_like(x, 1 / tiny), 1 / np.where(b == 0, tiny, b)
        h = d.copy()
        for i in range(1, 2000):
            an = -i * (i - a)
            b = b + 2
            d = an * d + b
            d = np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            d = 1 / d
            step = d * c
            h = np.where(low, h, h * step)
            if not np.any(~low & (np.abs(step - 1) > 1e-16)):
                break
        p = np.where(low, front * total, 1 - front * h)
        q = np.where(low, 1 - front * total, front * h)
    p, q = np.where(x == 0, 0.0, p), np.where(x == 0, 1.0, q)
    return np.where(bad, np.nan, p), np.where(bad, np.nan, q)


def _beta_fraction(x, a, b):
    """The continued fraction of beta_i. A row leaves once both steps of a round are 1 up to rounding, whose last bits may swing for ever."""
    tiny, left = 1e-300, np.arange(len(x))
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    out = h.copy()
    for m in range(1, 2000):
        open_ = np.zeros(len(x), bool)
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
            open_ |= np.abs(step - 1) > 5e-16
        out[left] = h
        if not open_.all():
            left, x, a, b, c, d, h = (y[open_] for y in (left, x, a, b, c, d, h))
            if not len(left):
                break
    return out


def beta_i(x, a, b):
    """Regularised incomplete beta function."""
    x, a, b = (y.copy() for y in np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float), np.asarray(b, float)))
    bad = ~(a > 0) | ~(b > 0) | ~(x >= 0) | ~(x <= 1)
    x[bad], a[bad], b[bad] = 0.5, 1.0, 1.0
    flip = x > (a + 1) / (a + b + 2)
    xx, aa, bb = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    with np.errstate(all="ignore"):
        front = np.exp(lgamma(aa + bb) - lgamma(aa) - lgamma(bb) + aa * np.log(np.where(xx > 0, xx, 1.0)) + bb * np.log1p(-np.where(xx < 1, xx, 0.0))) / aa
        h = _beta_fraction(xx.ravel(), aa.ravel(), bb.ravel()).reshape(xx.shape)
        part = np.where(xx <= 0, 0.0, front * h)
    return np.where(bad, np.nan, np.where(flip, 1 - part, part))


def invert(f, p, lo, hi, steps: int = 200):
    """x in [lo, hi] with f(x) = p for rising f, by bisection; hi doubles first while f(hi) < p."""
    p = np.asarray(p, float)
    lo, hi = np.broadcast_to(np.asarray(lo, float), p.shape).copy(), np.broadcast_to(np.asarray(hi, float), p.shape).copy()
    for _ in range(1100):
        short = f(hi) < p
        if not np.any(short & (hi < 1e300)):
            break
        hi = np.where(short, hi * 2, hi)
    for _ in range(steps):
        mid = 0.5 * (lo + hi)
        under = f(mid) < p
        lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
    return 0.5 * (lo + hi)


def t_cdf(t, df):
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    tail = 0.5 * beta_i(df / (df + t * t), df / 2, 0.5)
    return np.where(t > 0, 1 - tail, tail)


def t_tail(t, df):
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    tail = 0.5 * beta_i(df / (df + t * t), df / 2, 0.5)
    return np.where(t > 0, tail, 1 - tail)


def f_cdf(x, d1, d2):
    x = np.asarray(x, float)
    return beta_i(d1 * x / (d1 * x + d2), np.asarray(d1, float) / 2, np.asarray(d2, float) / 2)


def f_tail(x, d1, d2):
    x = np.asarray(x, float)
    return beta_i(d2 / (d1 * x + d2), np.asarray(d2, float) / 2, np.asarray(d1, float) / 2)


def norm_inv(p):
    from statistics import NormalDist

    inv = NormalDist().inv_cdf
    p = np.asarray(p, float)
    return np.array([inv(float(x)) if 0 < x < 1 else np.nan for x in p.ravel()]).reshape(p.shape)


def t_inv(p, df):
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    low = np.minimum(p, 1 - p)
    x = invert(lambda t: -t_tail(t, df), -low, np.zeros(p.shape), np.ones(p.shape))
    return np.where(p == 0.5, 0.0, np.where(p < 0.5, -x, x))


def log_choose(n, k):
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def binom_pmf(k, n, p):
    with np.errstate(all="ignore"):
        out = np.exp(log_choose(n, k) + np.where(k > 0, k * np.log(p), 0) + np.where(n - k > 0, (n - k) * np.log1p(-p), 0))
    return np.where((k < 0) | (k > n), 0.0, out)


def binom_cdf(k, n, p):
    k, n, p = (np.asarray(x, float) for x in np.broadcast_arrays(k, n, p))
    out, inside = np.where(k >= n, 1.0, 0.0), ~((k < 0) | (k >= n))
    out[inside] = beta_i(1 - p[inside], n[inside] - k[inside], k[inside] + 1)
    return out


def _grid(m: int):
    x, w = np.polynomial.legendre.leggauss(m)
    return (x + 1) / 2, w / 2


_X, _W = _grid(400)


def bessel_j(x, n):
    t = np.pi * _X
    return (np.cos(n[:, None] * t - x[:, None] * np.sin(t)) * _W).sum(1)


def bessel_i(x, n):
    t = np.pi * _X
    return (np.exp(x[:, None] * np.cos(t)) * np.cos(n[:, None] * t) * _W).sum(1)


def bessel_k(x, n):
    top = np.arccosh(1 + 750 / np.maximum(x, 1e-300))
    t = top[:, None] * _X
    return (np.exp(-x[:, None] * np.cosh(t)) * np.cosh(n[:, None] * t) * _W).sum(1) * top


def bessel_y(x, n):
    t = np.pi * _X
    first = (np.sin(x[:, None] * np.sin(t) - n[:, None] * t) * _W).sum(1)
    top = np.arcsinh(750 / np.maximum(x, 1e-300))
    s = top[:, None] * _X
    with np.errstate(over="ignore"):
        second = ((np.exp(n[:, None] * s) + np.exp(-n[:, None] * s) * np.cos(n * np.pi)[:, None]) * np.exp(-x[:, None] * np.sinh(s)) * _W).sum(1) * top / np.pi
    return first - second
