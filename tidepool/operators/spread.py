"""Spreads and z-scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import join_on, rolling_moments, with_index
from .clean import nan_to_null


def compute_spread(df: DataFrame, y: str = "y", x: str = "x", beta=1.0, alpha=0.0, name: str = "spread") -> DataFrame:
    """y - alpha - beta * x, null where y or x is missing (null or NaN); alpha and beta are numbers or names of columns."""
    of = lambda v: F.col(v) if isinstance(v, str) else F.lit(float(v))
    df = nan_to_null(df, [y, x])
    return df.withColumn(name, F.col(y) - of(alpha) - of(beta) * F.col(x))


def compute_spread_aligned(y: DataFrame, x: DataFrame, beta: float, alpha: float = 0.0, *, order_col: str = "ts", value: str = "value") -> DataFrame:
    """As compute_spread for two separate series: times of either side stay, null where the other is missing."""
    joined = y.select(order_col, F.col(value).alias("y")).join(x.select(order_col, F.col(value).alias("x")), order_col, "full_outer")
    return compute_spread(joined, "y", "x", beta, alpha).select(order_col, "spread")


def zscore(df: DataFrame, window: int | None = None, *, value: str = "spread", name: str = "z", order_col: str = "ts", partition_cols: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """(value - mean) / sample deviation over the trailing ``window`` rows, or over the whole series if window is None.

    Null where the window isn't full, a value in it is missing (null or NaN), or it doesn't vary.
    """
    df = nan_to_null(df, [value])
    if window is None:
        stats = df.groupBy(*partition_cols).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
        joined = join_on(df, stats, partition_cols) if partition_cols else df.crossJoin(F.broadcast(stats))  # one row
        return joined.withColumn(name, F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))).drop("_m", "_s")

    d = rolling_moments(with_index(df, order_col, partition_cols, rows=rows), [value], window, partition_cols, rows)
    z = F.try_divide(F.col(value) - F.col(f"_mean_{value}"), F.sqrt(f"_var_{value}"))
    return d.withColumn(name, z).drop(f"_mean_{value}", f"_var_{value}")
