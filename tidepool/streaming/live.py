"""Z-scores and positions of a stream: what zscore() and generate_signals() give for the whole table, row by row.

Each series keeps its last values, the state of the position machine and the rows that an earlier one may still precede.
These are sorted and given by bounded pieces, so that a task's memory doesn't grow with them.
Rows are given in order of time once the watermark has passed them, so that neither the order of arrival nor the cut into
micro-batches nor a restart from the checkpoint changes the result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.signals import FLAT, POSITION, step

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Keep the state of streams that start from now on in RocksDB, which arbitrary state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


ROW = np.dtype([("at", "<i8"), ("v", "<f8")])
PIECE = 8192
RUN = 32 * PIECE


def in_order(parts: list[np.ndarray]) -> np.ndarray:
    """All rows by time, those of one time by value, missing ones last."""
    rows = np.concatenate(parts) if parts else np.empty(0, ROW)
    return rows[np.lexsort((rows["v"], rows["at"]))]


class Machine(StatefulProcessor):
    """Of one series: pending rows (time in microseconds, value; missing: NaN), the last values and the machine's state.

    Rows wait in sorted runs, which the state holds in pieces: a task sorts RUN rows at a time, and to give rows in order it
    holds one piece of each run, however many rows of a series a micro-batch brings or a watermark passes.
    """

    def __init__(self, keys: list[str], window: int, entry: float, exit: float, stop: float | None):
        self.keys, self.window, self.rule = keys, window, (entry, exit, stop)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getMapState("pieces", "run long, place long", "packed binary")
        self.runs = handle.getValueState("runs", "runs array<array<long>>")  # of each: number, next piece, end of pieces, first time
        self.held = handle.getValueState("held", "last array<double>, state int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs, new, n = self.waiting(), [], 0
        for pdf in rows:
            part = np.empty(len(pdf), ROW)
            part["at"], part["v"] = pdf["at_us"].astype("int64"), pdf["v_now"].astype(float)
            new.append(part)
            n += len(part)
            if n >= RUN:
                self.add(runs, new)
                new, n = [], 0
        if n:
            self.add(runs, new)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.wait(runs)
        return iter(())

    def waiting(self) -> list[list[int]]:
        return [list(r) for r in self.runs.get()[0]] if self.runs.exists() else []

    def wait(self, runs: list[list[int]]) -> None:
        """Keep the runs, and come back once the watermark has passed the first row of them."""
        if runs:
            self.runs.update((runs,))
            self.handle.registerTimer(-(-min(r[3] for r in runs) // 1000))
        else:
            self.runs.clear()

    def add(self, runs: list[list[int]], new: list[np.ndarray]) -> None:
        """One run more, of new rows and of the shortest runs that fit in with them."""
        n = sum(map(len, new))
        runs.sort(key=lambda r: r[1] - r[2])
        while runs and n + PIECE * (runs[-1][2] - runs[-1][1]) <= RUN:
            short = runs.pop()
            while short[1] < short[2]:
                new.append(self.take(short))
                n += len(new[-1])
        rows = in_order(new)
        number = max((r[0] for r in runs), default=-1) + 1
        starts = range(0, n, PIECE)
        for place, i in enumerate(starts):
            self.pieces.updateValue((number, place), (rows[i : i + PIECE].tobytes(),))
        runs.append([number, 0, len(starts), int(rows["at"][0])])

    def take(self, run: list[int]) -> np.ndarray:
        """The run's next piece, which leaves the state; none, if there is no more."""
        if run[1] == run[2]:
            return np.empty(0, ROW)
        place = (run[0], run[1])
        rows = np.frombuffer(bytes(self.pieces.getValue(place)[0]), ROW)
        self.pieces.removeKey(place)
        run[1] += 1
        return rows

    def due(self, runs: list[list[int]], upto: int) -> Iterator[np.ndarray]:
        """Rows of all runs up to a time, in order and some at a time; runs and state then have what is left."""
        heads = [self.take(r) for r in runs]
        more = True
        while more:
            # nothing that isn't loaded comes before the end of the first piece to end
            ends = [(h["at"][-1], bool(np.isnan(h["v"][-1])), h["v"][-1]) for r, h in zip(runs, heads) if r[1] < r[2] and h["at"][-1] <= upto]
            more = bool(ends)
            at, _, v = min(ends) if more else (upto, True, np.nan)
            cuts = []
            for h in heads:
                low, high = np.searchsorted(h["at"], at, "left"), np.searchsorted(h["at"], at, "right")
                cuts.append(low + np.searchsorted(h["v"][low:high], v, "right"))
            rows = in_order([h[:c] for h, c in zip(heads, cuts)])
            heads = [h[c:] if c < len(h) else self.take(r) for r, h, c in zip(runs, heads, cuts)]
            for i in range(0, len(rows), PIECE):
                yield rows[i : i + PIECE]
        left = [(r, h) for r, h in zip(runs, heads) if len(h)]
        for r, h in left:
            r[1] -= 1
            r[3] = int(h["at"][0])
            self.pieces.updateValue((r[0], r[1]), (h.tobytes(),))
        runs[:] = [r for r, _ in left]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = 1000 * max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        last, state = self.held.get() if self.held.exists() else ([], FLAT)
        last, runs = np.array(last, float), self.waiting()
        for rows in self.due(runs, upto):
            z = self.scores(last, rows["v"])
            states = []
            for x in z.tolist():
                state = step(state, x, *self.rule)
                states.append(state)
            last = np.concatenate([last, rows["v"]])[-self.window + 1 :] if self.window > 1 else last
            yield pd.DataFrame({k: [x] * len(rows) for k, x in zip(self.keys, key)} | {"at_us": rows["at"], "v_now": rows["v"], "z": z, "position": POSITION[states]})
        self.held.update((last.tolist(), int(state)))
        self.wait(runs)

    def scores(self, last: np.ndarray, v: np.ndarray) -> np.ndarray:
        """z of each value of v, which follow upon the last ones; NaN where it is missing."""
        both, z, w = np.concatenate([last, v]), np.full(len(v), np.nan), self.window
        if w > 1 and len(both) >= w:
            frames = np.lib.stride_tricks.sliding_window_view(both, w)
            first, size = len(v) - len(frames), max(1, RUN // w)
            for i in range(0, len(frames), size):
                f = frames[i : i + size]
                with np.errstate(divide="ignore", invalid="ignore"):
                    found = (f[:, -1] - f.mean(axis=1)) / f.std(axis=1, ddof=1)
                    z[first + i : first + i + len(f)] = np.where(f.max(axis=1) > f.min(axis=1), found, np.nan)
        return z

    def close(self) -> None:
        pass


def live_signals(stream: DataFrame, window: int, entry: float = 2.0, exit: float = 0.5, stop: float | None = 4.0, *, value: str = "spread", ts: str = "ts", keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """keys, ts, value, z and position of each row of stream(keys, ts timestamp, value), in order of time within a series.

    A row is given once the watermark (``late`` behind the latest time seen) has reached it; rows that come behind the
    watermark are left out, as in every query with one. Missing values (null, NaN) make z null and keep the position, as
    in a table. Rows of one time go by their values, missing ones last. Null keys are a series of their own.
    """
    if window < 1:
        raise ValueError("a window has one row or more")
    use_state_store(stream.sparkSession)
    keys = list(keys)
    v = F.col(value).cast("double")
    at = F.col(ts).cast("timestamp")
    clock = F.timestamp_millis(F.ceil(F.unix_micros(at) / 1000))  # watermarks are in milliseconds
    rows = stream.select(*keys, clock.alias("clock"), F.unix_micros(at).alias("at_us"), F.coalesce(v, F.lit(float("nan"))).alias("v_now")).withWatermark("clock", late)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema]
    schema = ", ".join([*kinds, "at_us long, v_now double, z double, position int"])
    found = rows.groupBy(*keys).transformWithStateInPandas(Machine(keys, window, entry, exit, stop), schema, "Append", "EventTime")
    return found.select(*keys, F.timestamp_micros("at_us").alias(ts), F.col("v_now").alias(value), "z", "position")
