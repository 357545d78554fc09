"""Distribution functions of t, F, chi-square and the normal, on NumPy and math alone."""

from __future__ import annotations

from itertools import accumulate
from math import erf, exp, inf, lgamma, log, sqrt


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny, c, d, out = 1e-300, 1.0, 0.0, 1.0
    for i in range(500):
        m = i // 2
        if i == 0:
            k = 1.0
        elif i % 2 == 0:
            k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + k * d or tiny)
        c = 1 + k / c or tiny
        out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * (out - 1)


def gammainc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = out = 1 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            out += term
            if term < out * 1e-16:
                break
        return out * exp(a * log(x) - x - lgamma(a))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b)
        c = b + k / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - exp(a * log(x) - x - lgamma(a)) * h


def f_cdf(x: float, a: float, b: float) -> float:
    return betainc(a / 2, b / 2, a * x / (a * x + b)) if x > 0 else 0.0


def t_two_sided(t: float, df: float) -> float:
    return betainc(df / 2, 0.5, df / (df + t * t))


def chi2_cdf(x: float, k: float) -> float:
    return gammainc(k / 2, x / 2)


def normal_cdf(x: float) -> float:
    return (1 + erf(x / sqrt(2))) / 2


def quantile(cdf, p: float) -> float:
    low, high = 0.0, 1.0
    while cdf(high) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return (low + high) / 2


def chi2_quantile(p: float, k: float) -> float:
    return quantile(lambda x: chi2_cdf(x, k), p)


def f_quantile(p: float, a: float, b: float) -> float:
    return quantile(lambda x: f_cdf(x, a, b), p)


def adjust(p, method: str = "bonferroni") -> list[float]:
    """p values adjusted for their number: holm, hochberg, hommel, bonferroni, BH (or fdr), BY or none."""
    n, order = len(p), sorted(range(len(p)), key=lambda i: p[i])
    up = [p[i] for i in order]
    if method == "none":
        out = up
    elif method == "bonferroni":
        out = [n * x for x in up]
    elif method == "holm":
        out = list(accumulate(((n - k) * x for k, x in enumerate(up)), max))
    elif method in ("hochberg", "BH", "fdr", "BY"):
        scale = sum(1 / k for k in range(1, n + 1)) if method == "BY" else 1.0
        factor = (lambda k: n - k) if method == "hochberg" else lambda k: scale * n / (k + 1)
        out = list(accumulate((factor(k) * up[k] for k in reversed(range(n))), min))[::-1]
    elif method == "hommel":
        # The closure of Simes tests: the worst set of each size holds a value and the largest of the others.
        out = list(up)
        for m in range(1, n + 1):
            top = up[n - m :]
            simes = min(m * x / (k + 1) for k, x in enumerate(top))
            others = min((m * x / (k + 2) for k, x in enumerate(top[1:])), default=inf)
            out = [max(v, simes if k >= n - m else min(m * up[k], others)) for k, v in enumerate(out)]
    else:
        raise ValueError(f"no adjustment named {method}")
    back = [0.0] * n
    for k, i in enumerate(order):
        back[i] = min(1.0, out[k])
    return back
