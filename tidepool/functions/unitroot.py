"""Response surfaces for unit-root statistics (MacKinnon 1994 and 2010) and small linear algebra."""

from __future__ import annotations

import math

import numpy as np

# Fixed values of the published response surfaces, by number of series and deterministic terms: coefficients of the
# polynomials in tau for small and large p, and where they meet.
SMALL_P = {(1, "c"): (2.1659, 1.4412, 0.038269), (2, "c"): (2.92, 1.5012, 0.039796), (2, "ct"): (3.6646, 1.5419, 0.036448), (2, "n"): (1.9129, 1.3857, 0.035322)}
LARGE_P = {(1, "c"): (1.7339, 0.93202, -0.12745, -0.010368), (2, "c"): (2.1945, 0.64695, -0.29198, -0.042377), (2, "ct"): (2.85, 0.5272, -0.36622, -0.051695), (2, "n"): (1.5578, 0.8558, -0.2083, -0.033549)}
MEET = {(1, "c"): -1.61, (2, "c"): -2.62, (2, "ct"): -3.19, (2, "n"): -1.53}
# Critical values at 1, 5 and 10 %: coefficients of 1, 1/T, 1/T^2, 1/T^3.
CRITICAL = {
    (1, "c"): ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.040), (-2.56677, -1.5384, -2.809, 0.0)),
    (2, "c"): ((-3.89644, -10.9519, -22.527, 0.0), (-3.33613, -6.1101, -6.823, 0.0), (-3.04445, -4.2412, -2.720, 0.0)),
    (2, "ct"): ((-4.32762, -15.4387, -35.679, 0.0), (-3.78057, -9.5106, -12.074, 0.0), (-3.49631, -7.0815, -7.538, 21.892)),
}


def valid_range(key: tuple[int, str]) -> tuple[float, float]:
    """Where the polynomials turn: p is 0 below the vertex of the one for small p, 1 above the peak of the other."""
    _, b, c = SMALL_P[key]
    _, d, e, f = LARGE_P[key]
    return -b / (2 * c), (-e - math.sqrt(e * e - 3 * d * f)) / (3 * f)


def p_value(tau: float, series: int, trend: str) -> float:
    key = (series, trend)
    if key not in SMALL_P:
        raise ValueError(f"no p-values for {series} series with trend {trend!r}")
    low, high = valid_range(key)
    if tau < low:
        return 0.0
    if tau > high:
        return 1.0
    c = SMALL_P[key] if tau <= MEET[key] else LARGE_P[key]
    x = sum(a * tau**i for i, a in enumerate(c))
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def critical_values(series: int, trend: str, n: int) -> dict[str, float]:
    rows = CRITICAL.get((series, trend))
    return {k: sum(a / n**i for i, a in enumerate(r)) if r else math.nan for k, r in zip(("1%", "5%", "10%"), rows or (None,) * 3)}


def solve(gram: np.ndarray, columns: list[int], target: int, n: int):
    """Least squares from a matrix of sums of products: coefficients, their standard errors, sum of squared residuals."""
    xx, xy = gram[np.ix_(columns, columns)], gram[columns, target]
    inverse = np.linalg.pinv(xx, hermitian=True)
    b = inverse @ xy
    ssr = max(float(gram[target, target] - xy @ b), 0.0)
    return b, np.sqrt(np.maximum(np.diag(inverse) * ssr / max(n - len(columns), 1), 0)), ssr


def aic(ssr: float, n: int, k: int) -> float:
    return n * (math.log(2 * math.pi) + math.log(max(ssr, 1e-300) / n) + 1) + 2 * k
