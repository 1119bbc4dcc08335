"""Tail probabilities as vectorised functions over already aggregated rows.

Each call sees one number triple per group, never the group's rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def betainc(a, b, x):
    """Regularised incomplete beta I_x(a, b), by its continued fraction."""
    a, b, x = np.broadcast_arrays(*[np.asarray(v, float) for v in (a, b, x)])
    x = np.clip(x, 0.0, 1.0)
    swap = x > (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    tiny = 1e-300
    safe = np.clip(xx, tiny, 1.0)
    log_front = (_lgamma(aa + bb) - _lgamma(aa) - _lgamma(bb) + aa * np.log(safe)
                 + bb * np.log1p(-np.minimum(xx, 1.0 - 1e-16)))
    c = np.ones_like(xx)
    d = 1.0 - (aa + bb) * xx / (aa + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 2000):
        m2 = 2 * m
        for num in (m * (bb - m) * xx / ((aa + m2 - 1) * (aa + m2)),
                    -(aa + m) * (aa + bb + m) * xx / ((aa + m2) * (aa + m2 + 1))):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    else:
        if not np.all(np.abs(step - 1.0) < 1e-9):
            raise ArithmeticError("the incomplete beta function did not converge")
    front = np.exp(log_front) * h / aa
    front = np.where(xx <= 0.0, 0.0, front)
    return np.clip(np.where(swap, 1.0 - front, front), 0.0, 1.0)


def beta_quantile(q, a, b):
    """x with I_x(a, b) = q, by bisection."""
    q, a, b = np.broadcast_arrays(*[np.asarray(v, float) for v in (q, a, b)])
    lo, hi = np.zeros_like(q), np.ones_like(q)
    for _ in range(80):
        mid = (lo + hi) / 2.0
        below = betainc(a, b, mid) < q
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2.0


def binomial_upper(k, n, p):
    """P(X >= k)."""
    k, n, p = (np.asarray(v, float) for v in (k, n, p))
    inside = betainc(np.maximum(k, 1.0), np.maximum(n - k + 1.0, 0.5), p)
    return np.where(n <= 0, 1.0, np.where(k <= 0, 1.0, inside))


def normal_sf(z):
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2.0))


def t_two_sided(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def _rank_sum_tail(n: int, w: float) -> float:
    """P(W+ >= w) for n untied signed ranks."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for r in range(1, n + 1):
        ways[r:] = ways[r:] + ways[:-r].copy()
    return float(ways[int(math.ceil(w)):].sum() / 2.0 ** n)


@lru_cache(maxsize=None)
def _partition_differences(parts: int) -> tuple[int, tuple[tuple[int, ...], ...]]:
    """Sums of i * a_i up to x (i = 1..parts, a_i >= 0) are a polynomial of degree ``parts`` on each residue of x
    modulo the least common multiple: the period, and for each residue the forward differences at its first values."""
    period = math.lcm(*range(1, parts + 1))
    count = [1] * (period * (parts + 1))  # a slack of any size: sums up to x
    for i in range(1, parts + 1):
        for x in range(i, len(count)):
            count[x] += count[x - i]
    out = []
    for residue in range(period):
        row, first = count[residue::period], []
        while row:
            first.append(row[0])
            row = [b - a for a, b in zip(row, row[1:])]
        out.append(tuple(first))
    return period, tuple(out)


def _sums_up_to(parts: int, x: int) -> int:
    if x < 0:
        return 0
    period, rows = _partition_differences(parts)
    return sum(d * math.comb(x // period, j) for j, d in enumerate(rows[x % period]))


def _u_tail(n1: int, n2: int, u: float) -> float:
    """P(U >= u) for untied samples, in whole numbers to the last division.

    By symmetry it is the share of arrangements with U up to n1 n2 - u. Their numbers by U are the coefficients of the
    product of (1 - q^(n2 + i)) / (1 - q^i) over the smaller sample: a signed sum over the subsets of its numerators of
    sums of 1..n1, each a polynomial value. Memory depends on the smaller sample alone.
    """
    n1, n2 = min(n1, n2), max(n1, n2)
    terms = {0: 1}
    for i in range(1, n1 + 1):
        for shift, sign in list(terms.items()):
            terms[shift + n2 + i] = terms.get(shift + n2 + i, 0) - sign
    most = n1 * n2 - math.ceil(u)
    return sum(sign * _sums_up_to(n1, most - shift) for shift, sign in terms.items()) / math.comb(n1 + n2, n1)


# The rule by which a p-value is exact: untied, and at most so many values (of the smaller sample for U).
EXACT_SIGNED = 50
EXACT_U = 8


@F.pandas_udf(T.DoubleType())
def binom_test(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """One-sided exact binomial p-value, alternative greater."""
    return pd.Series(binomial_upper(k, n, p))


@F.pandas_udf(T.DoubleType())
def binom_low(k: pd.Series, n: pd.Series, tail: pd.Series) -> pd.Series:
    """Clopper-Pearson lower limit leaving ``tail`` below it."""
    k, n = k.to_numpy(float), n.to_numpy(float)
    q = beta_quantile(tail, np.maximum(k, 0.5), n - k + 1.0)
    return pd.Series(np.where(k <= 0, 0.0, q))


@F.pandas_udf(T.DoubleType())
def binom_high(k: pd.Series, n: pd.Series, tail: pd.Series) -> pd.Series:
    """Clopper-Pearson upper limit leaving ``tail`` above it."""
    k, n = k.to_numpy(float), n.to_numpy(float)
    q = beta_quantile(1.0 - tail.to_numpy(float), k + 1.0, np.maximum(n - k, 0.5))
    return pd.Series(np.where(k >= n, 1.0, q))


@F.pandas_udf(T.DoubleType())
def t_test_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of a t statistic."""
    t, df = t.to_numpy(float), df.to_numpy(float)
    out = t_two_sided(np.nan_to_num(t), np.maximum(np.nan_to_num(df), 1.0))
    return pd.Series(np.where(np.isnan(t) | ~(df > 0), np.nan, out)).astype(object).where(
        ~(np.isnan(t) | ~(df > 0)), None)


@F.pandas_udf(T.DoubleType())
def wilcoxon_p(w: pd.Series, n: pd.Series, tie_term: pd.Series, zeros: pd.Series,
               alternative: pd.Series) -> pd.Series:
    """Signed-rank p: exact for up to 50 untied non-zero values, else normal."""
    out = []
    for wi, ni, ti, zi, alt in zip(w, n, tie_term, zeros, alternative):
        if ni is None or ni != ni or ni < 1:
            out.append(1.0)
            continue
        ni = int(ni)
        if ni <= EXACT_SIGNED and ti == 0 and zi == 0:
            up = _rank_sum_tail(ni, wi)
            down = _rank_sum_tail(ni, ni * (ni + 1) / 2 - wi)
        else:
            se = math.sqrt(ni * (ni + 1.0) * (2 * ni + 1) / 24.0 - ti / 48.0)
            if se == 0:
                out.append(1.0)
                continue
            z = (wi - ni * (ni + 1) / 4.0) / se
            up, down = float(normal_sf(z)), float(normal_sf(-z))
        out.append(up if alt == "greater" else down if alt == "less" else min(1.0, 2 * min(up, down)))
    return pd.Series(out, dtype=float)


@F.pandas_udf(T.DoubleType())
def mann_whitney_p(u: pd.Series, n1: pd.Series, n2: pd.Series, tie_term: pd.Series,
                   alternative: pd.Series) -> pd.Series:
    """U p-value: exact when one side has at most 8 values and nothing ties, else
    normal with tie and continuity correction."""
    out = []
    for ui, a, b, ti, alt in zip(u, n1, n2, tie_term, alternative):
        if not (a > 0 and b > 0):
            out.append(None)
            continue
        a, b = int(a), int(b)
        if min(a, b) <= EXACT_U and ti == 0:
            up, down = _u_tail(a, b, ui), _u_tail(a, b, a * b - ui)
        else:
            n = a + b
            se = math.sqrt(a * b / 12.0 * ((n + 1) - ti / (n * (n - 1.0))))
            if se == 0:
                out.append(1.0)
                continue
            mid = a * b / 2.0
            up = float(normal_sf((ui - mid - 0.5) / se))
            down = float(normal_sf((mid - ui - 0.5) / se))
        out.append(up if alt == "greater" else down if alt == "less" else min(1.0, 2 * min(up, down)))
    return pd.Series(out, dtype="float64")
