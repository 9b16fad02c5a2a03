"""Kalman filter of a random-walk intercept and slope, in pieces that can be run side by side.

What a stretch of observations does to any state before it is held by five parts: the state x0 before
it has the likelihood of a normal with information (J, e), and given x0 the state after it is normal
with mean A x0 + b and covariance C. An observation adds to all five in closed form, and a stretch
turns the mean and covariance before it into those after it. 2x2 matrices are written out, and symmetric
ones have three numbers, so that every number may be an array over many stretches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

STATE = "a double, b double, p double, c double, d double"
_PARTS = ("a11", "a12", "a21", "a22", "b1", "b2", "c11", "c12", "c22", "e1", "e2", "j11", "j12", "j22")
SUMMARY = ", ".join(f"{n} double" for n in _PARTS)
_NEUTRAL = dict.fromkeys(_PARTS, 0.0) | {"a11": 1.0, "a22": 1.0}


def begin(_: pd.Series) -> dict:
    """Intercept 0 and slope 1 with unit covariance."""
    return {"a": 0.0, "b": 1.0, "p": 1.0, "c": 0.0, "d": 1.0}


def _grow(s: dict, x: np.ndarray, y: np.ndarray, q_var: float, r_var: float) -> dict:
    """The stretch ``s`` with one more observation y = intercept + slope * x."""
    c11, c12, c22 = s["c11"] + q_var, s["c12"], s["c22"] + q_var
    u, v = c11 + x * c12, c12 + x * c22
    gain = u + x * v + r_var
    err = y - s["b1"] - s["b2"] * x
    h1, h2 = s["a11"] + x * s["a21"], s["a12"] + x * s["a22"]  # the observation in terms of x0
    k1, k2 = u / gain, v / gain
    return {
        "a11": s["a11"] - k1 * h1, "a12": s["a12"] - k1 * h2, "a21": s["a21"] - k2 * h1, "a22": s["a22"] - k2 * h2,
        "b1": s["b1"] + k1 * err, "b2": s["b2"] + k2 * err,
        "c11": c11 - k1 * u, "c12": c12 - k1 * v, "c22": c22 - k2 * v,
        "e1": s["e1"] + h1 * err / gain, "e2": s["e2"] + h2 * err / gain,
        "j11": s["j11"] + h1 * h1 / gain, "j12": s["j12"] + h1 * h2 / gain, "j22": s["j22"] + h2 * h2 / gain,
    }


def _step(s: dict, x: np.ndarray, y: np.ndarray, q_var: float, r_var: float) -> dict:
    """The state after one observation."""
    p, c, d = s["p"] + q_var, s["c"], s["d"] + q_var
    u, v = p + x * c, c + x * d
    gain = u + x * v + r_var
    err = y - s["a"] - s["b"] * x
    return {"a": s["a"] + u * err / gain, "b": s["b"] + v * err / gain,
            "p": p - u * u / gain, "c": c - u * v / gain, "d": d - v * v / gain}


def advance(s: dict, t: pd.Series | dict) -> dict:
    """The state after a stretch: x0 is judged by the stretch's information, then carried through it."""
    p, c, d = s["p"], s["c"], s["d"]
    # M = I + P J
    m11, m12 = 1.0 + p * t["j11"] + c * t["j12"], p * t["j12"] + c * t["j22"]
    m21, m22 = c * t["j11"] + d * t["j12"], 1.0 + c * t["j12"] + d * t["j22"]
    det = m11 * m22 - m12 * m21
    w1, w2 = s["a"] + p * t["e1"] + c * t["e2"], s["b"] + c * t["e1"] + d * t["e2"]
    x1, x2 = (m22 * w1 - m12 * w2) / det, (m11 * w2 - m21 * w1) / det
    s11, s12, s22 = (m22 * p - m12 * c) / det, (m22 * c - m12 * d) / det, (m11 * d - m21 * c) / det
    g11, g12 = t["a11"] * s11 + t["a12"] * s12, t["a11"] * s12 + t["a12"] * s22
    g21, g22 = t["a21"] * s11 + t["a22"] * s12, t["a21"] * s12 + t["a22"] * s22
    return {
        "a": t["a11"] * x1 + t["a12"] * x2 + t["b1"], "b": t["a21"] * x1 + t["a22"] * x2 + t["b2"],
        "p": g11 * t["a11"] + g12 * t["a12"] + t["c11"], "c": g11 * t["a21"] + g12 * t["a22"] + t["c12"],
        "d": g21 * t["a21"] + g22 * t["a22"] + t["c22"],
    }


def _observed(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    scale = rows["_f"].to_numpy()
    return rows["x"].to_numpy() / scale, rows["y"].to_numpy() / scale


def _stretches(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As many stretches as each has rows, side by side: arrays (row, stretch). The rest is left over."""
    side = int(len(x) ** 0.5)
    return x[:side * side].reshape(side, side).T, y[:side * side].reshape(side, side).T


def _grown(x: np.ndarray, y: np.ndarray, q_var: float, r_var: float) -> dict:
    held = {n: np.full(x.shape[1], v) for n, v in _NEUTRAL.items()}
    for xi, yi in zip(x, y):
        held = _grow(held, xi, yi, q_var, r_var)
    return held


def _after(t: dict, u: dict) -> dict:
    """One stretch for ``t`` followed by ``u``."""
    # N = (I + C J')^-1, what the second stretch makes of the uncertainty of the first
    n11, n12 = 1.0 + t["c11"] * u["j11"] + t["c12"] * u["j12"], t["c11"] * u["j12"] + t["c12"] * u["j22"]
    n21, n22 = t["c12"] * u["j11"] + t["c22"] * u["j12"], 1.0 + t["c12"] * u["j12"] + t["c22"] * u["j22"]
    det = n11 * n22 - n12 * n21
    n11, n12, n21, n22 = n22 / det, -n12 / det, -n21 / det, n11 / det
    f11, f12 = n11 * t["a11"] + n12 * t["a21"], n11 * t["a12"] + n12 * t["a22"]
    f21, f22 = n21 * t["a11"] + n22 * t["a21"], n21 * t["a12"] + n22 * t["a22"]
    carried = advance({"a": t["b1"], "b": t["b2"], "p": t["c11"], "c": t["c12"], "d": t["c22"]}, u)
    r1 = u["e1"] - u["j11"] * t["b1"] - u["j12"] * t["b2"]
    r2 = u["e2"] - u["j12"] * t["b1"] - u["j22"] * t["b2"]
    # A' N' (.) with N' the transpose, as J and C are symmetric
    g11, g12 = f11 * u["j11"] + f21 * u["j12"], f11 * u["j12"] + f21 * u["j22"]
    g21, g22 = f12 * u["j11"] + f22 * u["j12"], f12 * u["j12"] + f22 * u["j22"]
    return {
        "a11": u["a11"] * f11 + u["a12"] * f21, "a12": u["a11"] * f12 + u["a12"] * f22,
        "a21": u["a21"] * f11 + u["a22"] * f21, "a22": u["a21"] * f12 + u["a22"] * f22,
        "b1": carried["a"], "b2": carried["b"], "c11": carried["p"], "c12": carried["c"], "c22": carried["d"],
        "e1": t["e1"] + f11 * r1 + f21 * r2, "e2": t["e2"] + f12 * r1 + f22 * r2,
        "j11": t["j11"] + g11 * t["a11"] + g12 * t["a21"], "j12": t["j12"] + g11 * t["a12"] + g12 * t["a22"],
        "j22": t["j22"] + g21 * t["a12"] + g22 * t["a22"],
    }


def summarise(rows: pd.DataFrame, q_var: float, r_var: float) -> dict:
    """The block as one stretch."""
    x, y = _observed(rows)
    xs, ys = _stretches(x, y)
    each = _grown(xs, ys, q_var, r_var)
    whole = {n: float(v) for n, v in _NEUTRAL.items()}
    for i in range(xs.shape[1]):
        whole = _after(whole, {n: each[n][i] for n in _PARTS})
    for xi, yi in zip(x[xs.size:], y[xs.size:]):
        whole = _grow(whole, xi, yi, q_var, r_var)
    return whole


def run(rows: pd.DataFrame, state: dict, last: bool, q_var: float, r_var: float) -> pd.DataFrame:
    """The slope before each row; null at the first row of a pair, whose time is ``_start``."""
    x, y = _observed(rows)
    xs, ys = _stretches(x, y)
    each = _grown(xs, ys, q_var, r_var)
    held, starts = state, []
    for i in range(xs.shape[1]):
        starts.append(held)
        held = advance(held, {n: each[n][i] for n in _PARTS})
    beta = np.empty(len(x))
    side = {n: np.array([s[n] for s in starts]) for n in state}
    before = np.empty(xs.shape)
    for i, (xi, yi) in enumerate(zip(xs, ys)):
        before[i] = side["b"]
        side = _step(side, xi, yi, q_var, r_var)
    beta[:xs.size] = before.T.reshape(-1)
    for i in range(xs.size, len(x)):
        beta[i] = held["b"]
        held = _step(held, x[i], y[i], q_var, r_var)
    out = rows[["pair_id", "ts"]].assign(beta=beta)
    out.loc[(rows["ts"] == rows["_start"]).to_numpy(), "beta"] = np.nan
    return out
