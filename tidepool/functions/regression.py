"""Closed forms of two-variable regressions, as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ols(y: str, x: str) -> dict[str, Column]:
    """Intercept, slope and R squared of y on x over pairs without nulls; null for a constant x."""
    return {"alpha": F.regr_intercept(y, x), "beta": F.regr_slope(y, x), "r_squared": F.regr_r2(y, x)}


def tls(y: str, x: str) -> dict[str, Column]:
    """Total least squares (both sides with errors): the direction of largest variance; R squared by vertical residuals."""
    pair = F.col(y).isNotNull() & F.col(x).isNotNull()
    py, px = F.when(pair, F.col(y)), F.when(pair, F.col(x))
    syy, sxx, sxy = F.var_samp(py), F.var_samp(px), F.covar_samp(py, px)
    beta = F.when(sxy != 0, (syy - sxx + F.sqrt((syy - sxx) * (syy - sxx) + 4 * sxy * sxy)) / (2 * sxy)).when(syy < sxx, 0.0)
    r2 = 1 - F.try_divide(syy - 2 * beta * sxy + beta * beta * sxx, syy)
    return {"alpha": F.avg(py) - beta * F.avg(px), "beta": beta, "r_squared": r2}
