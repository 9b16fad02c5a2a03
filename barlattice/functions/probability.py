"""Distribution functions Spark has no built-in for.

They run as Arrow-batched pandas functions on already aggregated rows (one row per stream, fold
or strategy), never on bars. Formulas: complementary error function by its standard series
(math.erfc), normal quantile by Wichura's AS 241, Student-t tail by the continued fraction of the
incomplete beta function (Lentz), unit-root p-value by MacKinnon's published polynomials.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_cdf = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2.0)), otypes=[float])

# AS 241 (PPND16) rational coefficients, highest power first.
_CENTRE_NUM = [
    2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
    13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608,
]
_CENTRE_DEN = [
    5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
    5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0,
]
_MID_NUM = [
    7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177,
    1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055,
    4.6303378461565452959, 1.42343711074968357734,
]
_MID_DEN = [
    1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966,
    0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494,
    2.05319162663775882187, 1.0,
]
_FAR_NUM = [
    2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386,
    0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358,
    5.4637849111641143699, 6.6579046435011037772,
]
_FAR_DEN = [
    2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5,
    7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531,
    0.59983220655588793769, 1.0,
]


def norm_cdf_np(z: np.ndarray) -> np.ndarray:
    return _cdf(np.asarray(z, dtype=float))


def norm_ppf_np(p: np.ndarray) -> np.ndarray:
    p = np.asarray(p, dtype=float)
    q = p - 0.5
    with np.errstate(all="ignore"):
        r = 0.180625 - q * q
        centre = q * np.polyval(_CENTRE_NUM, r) / np.polyval(_CENTRE_DEN, r)
        tail = np.sqrt(-np.log(np.minimum(p, 1.0 - p)))
        mid = np.polyval(_MID_NUM, tail - 1.6) / np.polyval(_MID_DEN, tail - 1.6)
        far = np.polyval(_FAR_NUM, tail - 5.0) / np.polyval(_FAR_DEN, tail - 5.0)
    outer = np.sign(q) * np.where(tail <= 5.0, mid, far)
    out = np.where(np.abs(q) <= 0.425, centre, outer)
    out = np.where(p == 0.0, -np.inf, np.where(p == 1.0, np.inf, out))
    return np.where((p < 0.0) | (p > 1.0), np.nan, out)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-16):
            break
    return h


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def t_two_sided_np(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) for Student's t with ``df`` degrees of freedom."""
    t, df = np.broadcast_arrays(np.asarray(t, dtype=float), np.asarray(df, dtype=float))
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & (df > 0)
    out[np.isinf(t) & (df > 0)] = 0.0
    if not ok.any():
        return out
    tt, v = t[ok], df[ok]
    a, b = v / 2.0, np.full_like(v, 0.5)
    x = v / (v + tt * tt)
    with np.errstate(all="ignore"):
        front = np.exp(
            _lgamma(a + b) - _lgamma(a) - _lgamma(b)
            + a * np.log(x) + b * np.log1p(-x)
        )
        direct = front * _beta_fraction(a, b, x) / a
        mirror = 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b
    res = np.where(x < (a + 1.0) / (a + b + 2.0), direct, mirror)
    out[ok] = np.where(tt == 0.0, 1.0, np.clip(res, 0.0, 1.0))
    return out


# MacKinnon (1994) surface for one variable, constant, no trend.
_ADF_MAX, _ADF_MIN, _ADF_STAR = 2.74, -18.83, -1.61
_ADF_SMALL = [0.038269, 1.4412, 2.1659]
_ADF_LARGE = [-0.010368, -0.12745, 0.93202, 1.7339]


def normal_cdf(z: Column) -> Column:
    """Normal distribution function in column arithmetic: its power series, to double precision."""
    x = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    series = F.aggregate(F.sequence(F.lit(100), F.lit(1), F.lit(-1)), F.lit(1.0), lambda held, k: 1.0 + held * x * x / (2 * k + 1))
    return F.lit(0.5) + x * F.exp(-x * x / 2) / F.lit(math.sqrt(2 * math.pi)) * series


def _polynomial(coefficients: list[float], x: Column) -> Column:
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + F.lit(c)
    return out


def adf_p(tau: Column) -> Column:
    """p-value of the unit-root statistic with a constant, in column arithmetic."""
    z = F.when(tau <= _ADF_STAR, _polynomial(_ADF_SMALL, tau)).otherwise(_polynomial(_ADF_LARGE, tau))
    return F.when(tau > _ADF_MAX, 1.0).when(tau < _ADF_MIN, 0.0).when(tau.isNotNull(), normal_cdf(z))


def _null(values: np.ndarray) -> pd.Series:
    return pd.Series(values, dtype="float64").where(~np.isnan(values), None)


@F.pandas_udf(T.DoubleType())
def norm_cdf(z: pd.Series) -> pd.Series:
    v = z.to_numpy(dtype=float, na_value=np.nan)
    return _null(np.where(np.isnan(v), np.nan, norm_cdf_np(np.nan_to_num(v))))


@F.pandas_udf(T.DoubleType())
def norm_ppf(p: pd.Series) -> pd.Series:
    return _null(norm_ppf_np(p.to_numpy(dtype=float, na_value=np.nan)))


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return _null(
        t_two_sided_np(
            t.to_numpy(dtype=float, na_value=np.nan), df.to_numpy(dtype=float, na_value=np.nan)
        )
    )
