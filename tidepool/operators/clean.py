"""Cleaning of price panels: one row a time, nulls for what isn't a price, bounded forward fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordered import INDEX, windowed, with_index


def price_columns(df: DataFrame, order_col: str, partition_cols: Sequence[str] = (), others: Sequence[str] = ()) -> list[str]:
    skip = {order_col, INDEX, *partition_cols, *others}
    return [f.name for f in df.schema if f.name not in skip and isinstance(f.dataType, T.NumericType)]


def nan_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """In this library a missing value is null; NaN, which Spark sorts and compares as a number, goes at the boundary."""
    return df.withColumns({c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols})


def dedup_first(df: DataFrame, order_col: str = "ts", partition_cols: Sequence[str] = (), seq_col: str | None = None) -> DataFrame:
    """The first row of each time by ``seq_col``; without it, by the other columns' values, so that the choice is fixed."""
    by = [seq_col] if seq_col else sorted(c for c in df.columns if c not in (order_col, *partition_cols))
    w = Window.partitionBy(*partition_cols, order_col).orderBy(*by) if by else Window.partitionBy(*partition_cols, order_col).orderBy(order_col)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def mask_prices(df: DataFrame, cols: Sequence[str], min_price: float = 0.0) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) > min_price, F.col(c)) for c in cols})


def forward_fill(df: DataFrame, cols: Sequence[str], limit: int, order_col: str = "ts", partition_cols: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Nulls take the last value of at most ``limit`` rows before."""
    if limit < 1:
        raise ValueError("ffill_limit must be at least 1")
    d = with_index(df, order_col, partition_cols, rows=rows)
    fill = lambda c: lambda w: F.last(c, ignorenulls=True).over(w.rowsBetween(-limit, 0))
    out = windowed(d, {f"_f_{c}": fill(c) for c in cols}, limit, partition_cols, rows)
    return out.withColumns({c: F.col(f"_f_{c}") for c in cols}).drop(*[f"_f_{c}" for c in cols])


def align_and_clean(df: DataFrame, dropna: bool = True, ffill_limit: int = 2, min_price: float = 0.0, *, order_col: str = "ts", partition_cols: Sequence[str] = (), seq_col: str | None = None, cols: Sequence[str] | None = None) -> DataFrame:
    """One row a time (the first), prices not above ``min_price`` to null, bounded forward fill, rows with nulls dropped.

    The steps run in this order, so a bad first duplicate isn't replaced by a good second. Sort the result where order
    matters: rows carry their time.
    """
    cols = list(cols or price_columns(df, order_col, partition_cols, [seq_col] if seq_col else []))
    one = dedup_first(df, order_col, partition_cols, seq_col)
    kept = mask_prices(nan_to_null(one, cols), cols, min_price).select(*partition_cols, order_col, *cols)
    out = forward_fill(kept, cols, ffill_limit, order_col, partition_cols).drop(INDEX)
    return out.na.drop("any", subset=cols) if dropna else out


def log_prices(df: DataFrame, *, order_col: str = "ts", partition_cols: Sequence[str] = (), cols: Sequence[str] | None = None) -> DataFrame:
    """Natural logarithm of every price column; null where there is no positive price."""
    cols = list(cols or price_columns(df, order_col, partition_cols))
    return df.withColumns({c: F.when(F.col(c) > 0, F.log(c)) for c in cols})
