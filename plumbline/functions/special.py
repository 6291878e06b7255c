"""Normal and Student-t distributions in numpy: only what the tail estimates need."""

from __future__ import annotations

import math

import numpy as np

_erfc = np.frompyfunc(math.erfc, 1, 1)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(-np.asarray(x, float) / math.sqrt(2.0)).astype(float)


_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def lgamma(x: np.ndarray) -> np.ndarray:
    return np.asarray(_lgamma(np.asarray(x, float)), float)


def incomplete_beta(a: float | np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by Lentz's continued fraction; ``a`` may go with x."""
    x = np.clip(np.asarray(x, float), 0.0, 1.0)
    a, x = np.broadcast_arrays(np.asarray(a, float), x)
    flip = x > (a + 1) / (a + b + 2)
    out = np.full(x.shape, np.nan)
    for swap in (False, True):
        own = (flip == swap) & ~np.isnan(x) & ~np.isnan(a)
        p, q = (np.full(int(own.sum()), float(b)), a[own]) if swap else (a[own], np.full(int(own.sum()), float(b)))
        z = 1 - x[own] if swap else x[own]
        if not len(z):
            continue
        c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        h = d.copy()
        for m in range(1, 400):
            for top in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + top * d
                d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
                c = 1 + top / c
                c = np.where(np.abs(c) < 1e-300, 1e-300, c)
                h *= c * d
            if np.all(np.abs(c * d - 1) < 1e-15):
                break
        with np.errstate(divide="ignore"):
            front = np.exp(p * np.log(z) + q * np.log1p(-z) + lgamma(p + q) - lgamma(p) - lgamma(q)) / p
        value = np.where(z <= 0, 0.0, front * h)
        out[own] = 1 - value if swap else value
    return out


def student_cdf(x: np.ndarray, df: float | np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    tail = 0.5 * incomplete_beta(np.asarray(df, float) / 2, 0.5, df / (df + x * x))
    return np.where(x > 0, 1 - tail, tail)


def tail(z: np.ndarray, df: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(distribution function, density) at z: normal, or Student's with degrees of freedom per column."""
    if df is None:
        return normal_cdf(z), np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    front = np.exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / np.sqrt(df * math.pi)
    return student_cdf(z, df), front * np.exp(-(df + 1) / 2 * np.log1p(z * z / df))


def student_logpdf(z: np.ndarray, df: float) -> np.ndarray:
    return math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * np.log(1 + z * z / df)


def digamma(x: float) -> float:
    """By recurrence to x >= 12, then the asymptotic series."""
    below = 0.0
    while x < 12:
        below, x = below + 1 / x, x + 1
    r = 1 / (x * x)
    return math.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132)))) - below


def trigamma(x: float) -> float:
    """By recurrence to x >= 12, then the asymptotic series."""
    below = 0.0
    while x < 12:
        below, x = below + 1 / (x * x), x + 1
    r = 1 / (x * x)
    return below + 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * 5 / 66))))


def student_profile(x: np.ndarray, n: np.ndarray, df: float, location: float, scale: float, tolerance: float = 1e-10) -> tuple[float, float]:
    """(location, scale) of the best fit with given degrees of freedom, from the given start.

    Newton steps where the likelihood is concave and they are short; reweighting, which always climbs, elsewhere.
    """
    for _ in range(500):
        z = (x - location) / scale
        square = z * z
        w = n / (df + square) * (df + 1)
        wz = w * z
        h = w * (df - square) / (df + square)  # slope of weight times z
        zh = z * h
        g1, g2 = wz.sum(), wz @ z - n.sum()
        a, b, c = h.sum(), (wz + zh).sum(), z @ (wz + zh)
        skew = zh.sum()
        det = a * c - skew * b
        if a > 0 and det > 0 and max(abs(c * g1 - skew * g2), abs(a * g2 - b * g1)) < 0.3 * det:
            step, log_step = (c * g1 - skew * g2) / det, (a * g2 - b * g1) / det
            location, scale = location + scale * step, scale * math.exp(log_step)
        else:
            mass = w.sum()
            step = g1 / mass
            # dividing by the weights' sum (not the count) is the faster form of the same fixed point
            ratio = max(math.sqrt(max(0.0, wz @ z / mass - step * step)), 1e-300)
            log_step = math.log(ratio)
            location, scale = location + scale * step, max(scale * ratio, 1e-300)
        if abs(step) <= tolerance and abs(log_step) <= tolerance:
            break
    return location, scale


def fit_student(x: np.ndarray, n: np.ndarray, low: float, high: float, edge: float) -> tuple[str | None, float, float, float]:
    """(failure code, df, location, scale) of the maximum-likelihood fit with low <= df <= high.

    The likelihood is profiled over log df, each fit starting from its neighbour's: a coarse grid finds the
    best interval, bisection with secant steps the root of the profile's slope in it. A maximum at a bound
    is a failure, not a fit.
    """
    order = np.argsort(x)
    x, n = x[order], n[order].astype(float)
    total = n.sum()
    location = float(x[np.searchsorted(np.cumsum(n), total / 2)])
    mean = (n * x).sum() / total
    spread = math.sqrt((n * (x - mean) ** 2).sum() / max(1.0, total - 1))
    grid = np.linspace(math.log(low), math.log(high), 17)
    fits, scores = [], []
    for u in grid[::-1]:  # from the nearly normal end, where the start is good
        location, spread = student_profile(x, n, math.exp(u), location, spread, 1e-4)
        fits.insert(0, (location, spread))
        scores.insert(0, float((n @ student_logpdf((x - location) / spread, math.exp(u))) / total - math.log(spread)))
    best = int(np.argmax(scores))
    location, spread = fits[best]

    def slope(u: float) -> float:
        nonlocal location, spread
        df = math.exp(u)
        location, spread = student_profile(x, n, df, location, spread)
        z = ((x - location) / spread) ** 2
        return digamma((df + 1) / 2) - digamma(df / 2) - 1 / df + float(n @ ((df + 1) * z / (df * (df + z)) - np.log(1 + z / df))) / total

    i, j = max(0, best - 1), min(len(grid) - 1, best + 1)
    fa, fb = slope(grid[i]), slope(grid[j])
    while fa <= 0 and i > 0:  # where the likelihood is flat, the grid may be off by some steps
        i, j, fb = i - 1, i, fa
        fa = slope(grid[i])
    while fb >= 0 and j < len(grid) - 1:
        i, j, fa = j, j + 1, fb
        fb = slope(grid[j])
    if fa <= 0 or fb >= 0:
        u = grid[i] if fa <= 0 else grid[j]
    else:
        u = root(slope, grid[i], fa, grid[j], fb, 1e-10)
    df = math.exp(u)
    location, scale = student_profile(x, n, df, location, spread)
    if not all(map(math.isfinite, (df, location, scale, *scores))):
        return "STUDENT_T_FIT_NONCONVERGENCE", df, location, scale
    if scale <= 1e-12:
        return "PARAMETRIC_DEGENERATE_SCALE", df, location, scale
    if df - low <= edge or high - df <= edge:
        return "STUDENT_T_DF_BOUNDARY", df, location, scale
    return None, df, location, scale


def _brackets(f, low: float, f_low: float, high: float, f_high: float, tolerance: float):
    """Ever smaller (low, high) around a change of sign, by secant steps (Illinois) held inside the bracket.

    A step within the tolerance of an end is moved off it by half the tolerance, so that the bracket closes
    from both sides; every fourth step halves the bracket.
    """
    step, side = 0, 0
    while high - low > tolerance:
        step += 1
        mid = low + (high - low) / 2
        if step % 4 and f_high != f_low:
            at = high - f_high * (high - low) / (f_high - f_low)
            if math.isfinite(at):
                mid = min(max(at, low + tolerance / 2), high - tolerance / 2)
        if not low < mid < high:  # neighbouring numbers
            break
        value = f(mid)
        if (value > 0) == (f_high > 0):
            high, f_high = mid, value
            f_low, side = f_low / (2 if side > 0 else 1), 1
        else:
            low, f_low = mid, value
            f_high, side = f_high / (2 if side < 0 else 1), -1
        yield low, high


def root(f, low: float, f_low: float, high: float, f_high: float, tolerance: float) -> float:
    """Where f changes sign between low and high."""
    for low, high in _brackets(f, low, f_low, high, f_high, tolerance):  # noqa: B020
        pass
    return low + (high - low) / 2


def largest_shift(risk, alpha: float, most: float, tolerance: float = 1e-9) -> tuple[float, float, bool, bool]:
    """(shift, risk at 0, baseline feasible, right-censored): the largest shift with risk <= alpha."""
    base = risk(0.0)
    if base > alpha:
        return 0.0, base, False, False
    top = risk(most)
    if top <= alpha:
        return most, base, True, True
    low = 0.0
    for low, _ in _brackets(lambda s: risk(s) - alpha, 0.0, base - alpha, most, top - alpha, tolerance):
        pass
    return low, base, True, False
