"""Tail probabilities of the test statistics, from public formulas."""

from __future__ import annotations

import math


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - scale * total
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided, by Student's t with n - 2 degrees."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    nu = n - 2
    t2 = r * r * nu / (1 - r * r)
    return beta_share(nu / 2, 0.5, nu / (nu + t2))


def normal_p(z: float | None) -> float | None:
    return None if z is None else math.erfc(abs(z) / math.sqrt(2))


def chi2_p(x: float | None, dof: int) -> float | None:
    return None if x is None or dof < 1 else upper_gamma(dof / 2, x / 2)
