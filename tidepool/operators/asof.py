"""Joins in time: the row last known at each time, and the interval that a time lies in.

Both sides are merged in order of time, once; what is known is carried forward within blocks of rows and from block to
block. No row of one side is compared with more than its neighbours, whatever the sides' sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import INDEX, cumulative, with_index


def asof_join(left: DataFrame, right: DataFrame, on: str = "ts", keys: Sequence[str] = (), *, exact: bool = True, seen: str | None = None) -> DataFrame:
    """left with right's other columns as they were last known: of its latest row at or before (``exact=False``: before)
    the time ``on``, within equal keys (null keys are equal). ``seen`` names a column for that row's time.

    Of right's rows of one time the largest counts, column by column in their order; right's rows without a time don't.
    Left's rows all stay, each once, with nulls where nothing is known; right's columns must not be left's.
    """
    keys = list(keys)
    added = [c for c in right.columns if c not in (on, *keys)]
    clash = set(added) & set(left.columns)
    if clash:
        raise ValueError(f"both sides have columns {sorted(clash)}")
    own = F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_own")
    # a column that is in both structs keeps them from being empty, and a null struct apart from one of nulls
    known = F.struct(F.col(on).alias("_at"), *[F.col(f"`{c}`") for c in added]).alias("_known")
    first, second = (0, 1) if exact else (1, 0)
    a = left.select(*keys, on, F.lit(second).alias("_side"), own)
    b = right.filter(F.col(on).isNotNull()).select(*keys, on, F.lit(first).alias("_side"), known)
    both = with_index(a.unionByName(b, allowMissingColumns=True), on, keys, ["_side", "_known"])
    both = cumulative(both, {"_last": (F.when(F.col("_known").isNotNull(), F.struct(INDEX, "_known")), "max")}, keys).filter(F.col("_side") == second)
    last = F.col("_last._known")
    return both.select("_own.*", *[last[c].alias(c) for c in added], *([last["_at"].alias(seen)] if seen else []))


def interval_join(left: DataFrame, right: DataFrame, on: str = "ts", keys: Sequence[str] = (), *, start: str = "start", end: str = "end") -> DataFrame:
    """left with the columns of the interval [start, end) of right that its time lies in; nulls where it lies in none.

    Intervals of one key must not overlap (of two that do, the one that begins later counts). A null end is open.
    """
    added = [c for c in right.columns if c not in keys]
    out = asof_join(left, right.withColumn(on, F.col(start)), on, keys)
    inside = F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(on) < F.col(end)))
    return out.withColumns({c: F.when(inside, F.col(c)) for c in added if c not in (start, end)} | {"_in": inside}).withColumns({c: F.when(F.col("_in"), F.col(c)) for c in (start, end)}).drop("_in")
