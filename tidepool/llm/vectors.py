"""Vectors in DataFrames: which take part, classes of equal ones, and groups of rows inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists (no nulls) as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def packed(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.ascontiguousarray(rows, np.float64)], pa.binary())


def unpacked(cells) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.float64).reshape(len(cells), -1)


def groups(batches, keys: list[str], columns: list[str]):
    """Runs of equal keys of a sorted partition: (key values, an array for each column); a run may go over several batches."""
    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        get = lambda c, b=batch: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
        k, v = [get(c) for c in keys], [get(c) for c in columns]
        new = np.zeros(batch.num_rows, bool)
        for c in k:
            new[1:] |= c[1:] != c[:-1]
        at = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for s, e in zip(at, at[1:]):
            key = tuple(c[s].item() for c in k)
            if key != last and held:
                yield (last, *(np.concatenate(x) for x in zip(*held)))
                held = []
            last = key
            held.append([c[s:e] for c in v])
    if held:
        yield (last, *(np.concatenate(x) for x in zip(*held)))


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
