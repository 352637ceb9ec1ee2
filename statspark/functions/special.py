"""Distribution functions on the driver, with the standard library and numpy only."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def norm_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        for _ in range(10_000):
            n += 1
            term *= x / n
            total += term
            if term < total * 1e-17:
                break
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        step = c * d
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return h * scale


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_i(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + numerator / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            h *= step
        if abs(step - 1) < 1e-16:
            break
    return front * h / a


def t_sf(t: float, df: float) -> float:
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    half = 0.5 * beta_i(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


def t_ppf(p: float, df: float) -> float:
    low, high = -1.0, 1.0
    while t_sf(high, df) > 1 - p:
        high *= 2
    while t_sf(low, df) < 1 - p:
        low *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_sf(mid, df) > 1 - p else (low, mid)
    return (low + high) / 2


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def poisson_pmf(k: np.ndarray, rate: float) -> np.ndarray:
    logs = np.array([math.lgamma(v + 1) for v in k])
    return np.exp(k * math.log(rate) - rate - logs)


def poisson_sf(k: int, rate: float) -> float:
    """P(X > k)."""
    return 1.0 - gamma_q(k + 1, rate)


def tail(z: float, alternative: str) -> float:
    """p value of a standard normal statistic."""
    if alternative == "greater":
        return norm_sf(z)
    if alternative == "less":
        return norm_cdf(z)
    return min(1.0, 2 * norm_sf(abs(z)))


def t_tail(t: float, df: float, alternative: str) -> float:
    if alternative == "greater":
        return t_sf(t, df)
    if alternative == "less":
        return 1 - t_sf(t, df)
    return min(1.0, 2 * t_sf(abs(t), df))


def corrected_skewness(g1: float | None, n: int) -> float | None:
    return None if g1 is None or n < 3 else g1 * math.sqrt(n * (n - 1)) / (n - 2)


def corrected_kurtosis(g2: float | None, n: int) -> float | None:
    return None if g2 is None or n < 4 else ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))


def dagostino(g1: float, g2: float, n: int) -> tuple[float, float]:
    """K squared and its p value from population skewness and excess kurtosis (D'Agostino 1970; Anscombe and Glynn 1983)."""
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (beta - 1)) - 1
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    expected = 3 * (n - 1) / (n + 1)
    variance = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (g2 + 3 - expected) / math.sqrt(variance)
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + math.sqrt(1 + 4 / s**2))
    z2 = ((1 - 2 / (9 * a)) - math.cbrt((1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4))))) / math.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return k2, math.exp(-k2 / 2)


def _poly(coefficients: list[float], x: float) -> float:
    return sum(c * x**k for k, c in enumerate(coefficients))


def _royston(n: int, square: float) -> tuple[float, float, float]:
    """Weights of the two outermost values of more than five, and the divisor of the other normal scores; ``square``: sum of the squared scores."""
    m = [norm_ppf((i - 0.375) / (n + 0.25)) for i in (1, 2)]
    root, small = math.sqrt(square), 1 / math.sqrt(n)
    # Royston's polynomials.
    first = _poly([0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056], small) - m[0] / root
    second = _poly([0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633], small) - m[1] / root
    return first, second, math.sqrt((square - 2 * m[0] ** 2 - 2 * m[1] ** 2) / (1 - 2 * first**2 - 2 * second**2))


def shapiro(sample: np.ndarray) -> tuple[float, float]:
    """Shapiro-Wilk W and p by Royston's approximation (1995)."""
    x = np.sort(sample)
    n = len(x)
    half = n // 2
    if n == 3:
        a = np.array([math.sqrt(0.5)])
    else:
        m = np.array([norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, half + 1)])
        square = 2 * float(m @ m)
        if n > 5:
            first, second, scale = _royston(n, square)
            a = np.concatenate([[first, second], -m[2:] / scale])
        else:
            first = _poly([0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056], 1 / math.sqrt(n)) - m[0] / math.sqrt(square)
            scale = math.sqrt((square - 2 * m[0] ** 2) / (1 - 2 * first**2))
            a = np.concatenate([[first], -m[1:] / scale])
    spread = x[::-1][:half] - x[:half]
    centred = x - x.mean()
    w = min(1.0, float(a @ spread) ** 2 / float(centred @ centred))
    return w, shapiro_p(w, n)


def shapiro_from_sums(n: int, square: float, product: float, outer: float, inner: float, spread: float) -> tuple[float, float]:
    """W and p of more than five values from sums: squared normal scores, scores times values, the gaps of the outermost and the next pair, squared deviations."""
    first, second, scale = _royston(n, square)
    rest = product + norm_ppf(0.625 / (n + 0.25)) * outer + norm_ppf(1.625 / (n + 0.25)) * inner
    w = min(1.0, (first * outer + second * inner + rest / scale) ** 2 / spread)
    return w, shapiro_p(w, n)


def shapiro_p(w: float, n: int) -> float:
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1:
        return 1.0
    y, log_n = math.log(1 - w), math.log(n)
    if n <= 11:
        top = _poly([-2.273, 0.459], n)
        if y >= top:
            return 1e-99
        y = -math.log(top - y)
        mean = _poly([0.5440, -0.39978, 0.025054, -6.714e-4], n)
        sd = math.exp(_poly([1.3822, -0.77857, 0.062767, -0.0020322], n))
    else:
        mean = _poly([-1.5861, -0.31082, -0.083751, 0.0038915], log_n)
        sd = math.exp(_poly([-0.4803, -0.082676, 0.0030302], log_n))
    return norm_sf((y - mean) / sd)


# Levels and asymptotic critical values of the normality test with estimated mean and variance.
ANDERSON_LEVELS = (0.15, 0.10, 0.05, 0.025, 0.01)
ANDERSON_CRITICAL = (0.576, 0.656, 0.787, 0.918, 1.092)


def anderson_critical(n: int) -> list[float]:
    return [round(c / (1 + 4 / n - 25 / n / n), 3) for c in ANDERSON_CRITICAL]


def anderson_p(statistic: float, n: int) -> float:
    """p interpolated between the levels, held at the outer ones."""
    return float(np.interp(statistic, anderson_critical(n), ANDERSON_LEVELS))


def weighted_inversions(ranks: np.ndarray, weights: np.ndarray) -> int:
    """Sum of weight products over pairs i before j with ranks[i] > ranks[j], one bit of the rank at a time."""
    ranks, weights = ranks.astype(np.int64), weights.astype(np.int64)
    total = 0
    for bit in reversed(range(int(ranks.max(initial=0)).bit_length())):
        group = ranks >> (bit + 1)
        order = np.argsort(group, kind="stable")
        ranks, weights, group = ranks[order], weights[order], group[order]
        one = (ranks >> bit & 1).astype(bool)
        ones = np.cumsum(np.where(one, weights, 0))
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        before = np.repeat(np.concatenate([[0], ones])[starts], np.diff(np.append(starts, len(group))))
        total += int(((ones - before) * weights)[~one].sum())
    return total


def kendall_exact_p(n: int, discordant: int, alternative: str) -> float:
    """Null distribution of the number of discordant pairs without ties, by its recurrence."""
    most = n * (n - 1) // 2
    ways = np.zeros(most + 1)
    ways[0] = 1.0
    for k in range(2, n + 1):
        sums = np.cumsum(ways)
        shifted = np.concatenate([np.zeros(k), sums[:-k]]) if k <= most else np.zeros(most + 1)
        ways = (sums - shifted) / k
    low = float(ways[: discordant + 1].sum())
    high = float(ways[discordant:].sum())
    if alternative == "greater":
        return min(1.0, low)
    if alternative == "less":
        return min(1.0, high)
    return min(1.0, 2 * min(low, high))
