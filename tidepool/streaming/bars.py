"""Bars from a stream of ticks or finer bars: the batch resampling under a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.continuous import resample


def stream_bars(bars: DataFrame, every: str = "5 minutes", late: str = "10 minutes", *, ts: str = "ts_event", keys: Sequence[str] = ("product", "contract")) -> DataFrame:
    """Coarser bars, each given once no row of it can come any more that is less than ``late`` behind."""
    return resample(bars.withWatermark(ts, late), every, ts=ts, keys=keys)
