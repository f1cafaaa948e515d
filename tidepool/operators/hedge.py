"""Hedge ratios: y ~ alpha + beta * x."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import rolling_moments, with_index
from ..functions.regression import ols, tls
from .clean import nan_to_null
from .spread import compute_spread

METHODS = {"ols": ols, "tls": tls}


@dataclass
class HedgeRatio:
    alpha: float
    beta: float
    residuals: DataFrame
    r_squared: float


def hedge_table(df: DataFrame, y: str = "y", x: str = "x", method: str = "ols", partition_cols: Sequence[str] = ()) -> DataFrame:
    """alpha, beta and r_squared of each series in one aggregate, over pairs of which neither is missing (null or NaN)."""
    if method not in METHODS:
        raise ValueError(f"method {method!r} is none of {sorted(METHODS)}")
    return nan_to_null(df, [y, x]).groupBy(*partition_cols).agg(*[c.alias(n) for n, c in METHODS[method](y, x).items()])


def estimate_hedge_ratio(df: DataFrame, y: str = "y", x: str = "x", method: str = "ols") -> HedgeRatio:
    """Of one series; the residuals stay a lazy frame (df with a column ``residual``)."""
    r = hedge_table(df, y, x, method).first()
    nan = float("nan")
    alpha, beta = nan if r.alpha is None else r.alpha, nan if r.beta is None else r.beta
    return HedgeRatio(alpha, beta, compute_spread(df, y, x, beta, alpha, "residual"), nan if r.r_squared is None else r.r_squared)


def rolling_hedge_ratio(df: DataFrame, window: int, *, y: str = "y", x: str = "x", order_col: str = "ts", partition_cols: Sequence[str] = ()) -> DataFrame:
    """df with the slope (``beta``) and intercept (``alpha``) over the trailing window; null unless it is full and x varies."""

    d = with_index(nan_to_null(df, [y, x]), order_col, partition_cols)
    d = rolling_moments(d, [y, x], window, partition_cols, pairs=[(y, x)])
    beta = F.try_divide(f"_cov_{y}_{x}", f"_var_{x}")
    d = d.withColumn("beta", beta).withColumn("alpha", F.col(f"_mean_{y}") - F.col("beta") * F.col(f"_mean_{x}"))
    return d.drop(*[f"_{kind}_{c}" for kind in ("mean", "var") for c in (y, x)], f"_cov_{y}_{x}")
