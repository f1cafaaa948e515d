"""Positions from z-scores: enter beyond ``entry``, leave inside ``exit``, stand aside after ``stop``.

With exit <= entry each row with abs(z) < exit leaves the machine flat whatever came before. Such rows cut the series
into stretches; within one, the first row beyond ``stop`` and the first beyond ``entry`` decide everything. So a running
maximum, an aggregate per stretch and a join give all positions. With exit > entry the machine is run in blocks: each
block as a map from the state before it to the state after it, the maps chained (one row a block), then each block again
from its known start.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import INDEX, ROWS, cumulative, join_on, one_block, staged, with_index

FLAT, LONG, SHORT, STOPPED = range(4)
POSITION = np.array([0, 1, -1, 0])


def generate_signals(df: DataFrame, entry: float = 2.0, exit: float = 0.5, stop: float | None = 4.0, *, z: str = "z", name: str = "position", order_col: str = "ts", partition_cols: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """df with the position (-1, 0, 1) held after each row; a missing z holds what was held. All comparisons are strict."""
    d = with_index(df, order_col, partition_cols, rows=rows).withColumn("_z", F.when(~F.isnan(F.col(z).cast("double")), F.col(z).cast("double")))
    if exit > entry:
        return _by_blocks(d, entry, exit, stop, name, partition_cols).drop("_z")
    if not one_block(rows):
        d = staged(d)  # which is read four times from here on
    size = F.abs("_z")
    at = F.col(INDEX)
    d = cumulative(d, {"_seg": (F.when(size < exit, at), "max")}, partition_cols, rows).withColumn("_seg", F.coalesce("_seg", F.lit(-1)))
    beyond = (F.col("_z") > entry) | (F.col("_z") < -entry)
    keys = [*partition_cols, "_seg"]
    if one_block(rows):
        upto = Window.partitionBy(*keys).orderBy(INDEX).rowsBetween(Window.unboundedPreceding, 0)
        halt = F.max(F.when(size > stop, True)).over(upto) if stop is not None else F.lit(None).cast("boolean")
        go = F.first(F.when(beyond, F.when(F.col("_z") > entry, -1).otherwise(1)), ignorenulls=True).over(upto)
        return d.withColumn(name, F.when(halt, 0).otherwise(F.coalesce(go, F.lit(0))).cast("int")).drop("_z", "_seg")
    halted = F.min(F.when(size > stop, at)) if stop is not None else F.lit(None).cast("long")
    first = d.groupBy(*keys).agg(halted.alias("_stop"), F.min(F.when(beyond, at)).alias("_go"), F.min_by(F.when(F.col("_z") > entry, -1).otherwise(1), F.when(beyond, at)).alias("_dir"))
    d = join_on(d, first, keys)
    position = F.when(F.col("_stop") <= at, 0).when(F.col("_go") <= at, F.col("_dir")).otherwise(0)
    return d.withColumn(name, position.cast("int")).drop("_z", "_seg", "_stop", "_go", "_dir")


def step(state: int, z: float, entry: float, exit: float, stop: float | None) -> int:
    """The state after a row."""
    if z != z:
        return state
    if state == STOPPED:
        if abs(z) >= exit:
            return STOPPED
        state = FLAT
    if stop is not None and abs(z) > stop:
        return STOPPED
    if state == FLAT:
        return SHORT if z > entry else LONG if z < -entry else FLAT
    return FLAT if abs(z) < exit else state


def row_maps(z: np.ndarray, entry: float, exit: float, stop: float | None) -> np.ndarray:
    """For each row, the state after it by the state before it: step() of all rows at once."""
    size = np.abs(z)
    flat = np.where(z > entry, SHORT, np.where(z < -entry, LONG, FLAT))
    held = [np.where(size < exit, FLAT, state) for state in (LONG, SHORT)]
    maps = np.stack([flat, *held, flat], axis=1)
    if stop is not None:
        maps[size > stop] = STOPPED
    maps[size >= exit, STOPPED] = STOPPED
    maps[np.isnan(z)] = np.arange(4)
    return maps.astype(np.int8)


def composed(maps: np.ndarray) -> np.ndarray:
    """Each row's map after those of all rows before it, in as many passes as the number of rows has binary digits."""
    out, reach = maps.copy(), 1
    while reach < len(out):
        out[reach:] = np.take_along_axis(out[reach:], out[:-reach].astype(np.int64), axis=1)
        reach *= 2
    return out


def _by_blocks(d: DataFrame, entry: float, exit: float, stop: float | None, name: str, partition_cols: Sequence[str]) -> DataFrame:
    keys = [*partition_cols, "_b"]
    d = d.withColumn("_b", F.floor(F.col(INDEX) / ROWS))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(*keys).schema)

    def prefixes(pdf: pd.DataFrame) -> np.ndarray:
        return composed(row_maps(pdf["_z"].to_numpy(float), entry, exit, stop))

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[keys].iloc[:1].assign(to=[prefixes(pdf.sort_values(INDEX))[-1].tolist()])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_b")
        after = composed(np.stack(pdf["to"].to_numpy()))[:, FLAT]
        return pdf[keys].assign(_start=np.concatenate([[FLAT], after[:-1]]))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(INDEX)
        return pdf.assign(**{name: POSITION[prefixes(pdf)[:, int(pdf["_start"].iloc[0])]]}).drop(columns=["_b", "_start"])

    maps = d.select(*keys, INDEX, "_z").groupBy(*keys).applyInPandas(summary, f"{kinds}, to array<int>")
    starts = maps.groupBy(*partition_cols).applyInPandas(chain, f"{kinds}, _start int")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.drop("_b").schema) + f", `{name}` int"
    return join_on(d, starts, keys).groupBy(*keys).applyInPandas(fill, schema)
