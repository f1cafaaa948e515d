"""Rolling moments, maps of the position machine and selection of order statistics against plain versions."""

import datetime as dt
import math
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tidepool as tp
from tidepool.functions import ordered, selection
from tidepool.operators.backtest import describe, split_point
from tidepool.operators.signals import FLAT, composed, row_maps, step


@pytest.mark.parametrize("offset", [0.0, 1e8])
@pytest.mark.parametrize("window, rows", [(1, None), (2, None), (7, None), (7, 400), (45, None)])
def test_rolling_moments_are_those_of_each_frame(spark, monkeypatch, offset, window, rows):
    monkeypatch.setattr(ordered, "ROWS", 500 if rows else 64)
    r = random.Random(window)
    level, made = 0.0, []
    for i in range(200):
        level = r.choice([level, level, level + r.gauss(0, 1)])  # with runs of equal values
        made.append((i, None if 100 < i < 103 else offset + level, offset * 2 + (level if r.random() < 0.5 else r.gauss(0, 1))))
    d = spark.createDataFrame([(k, *x) for k in ("a", None) for x in made], "k string, idx long, y double, x double")
    how = dict(order_col="idx", partition_cols=["k"])
    z = {(x.k, x.idx): x for x in tp.zscore(d, window, value="y", rows=rows, **how).collect()}
    h = {(x.k, x.idx): x for x in tp.rolling_hedge_ratio(d, window, **how).collect()}
    f = pd.DataFrame(made, columns=["idx", "y", "x"]).astype(float)
    y, x = f.y - offset, f.x - 2 * offset
    deviation = [np.std(y[max(0, i - window + 1) : i + 1], ddof=1) if i >= window - 1 > 0 and not y[max(0, i - window + 1) : i + 1].isna().any() else math.nan for i in range(200)]
    for i in range(200):
        frame = slice(max(0, i - window + 1), i + 1)
        full = i >= window - 1 and not y[frame].isna().any()
        for k in ("a", None):
            if not full or window == 1 or y[frame].nunique() == 1:
                assert z[k, i].z is None
            else:
                assert z[k, i].z == pytest.approx((y[i] - y[frame].mean()) / deviation[i], abs=1e-9 if not offset else 1e-6)
            if full and window > 1 and x[frame].nunique() > 1:
                beta = np.cov(y[frame], x[frame])[0, 1] / np.var(x[frame], ddof=1)
                assert h[k, i].beta == pytest.approx(beta, abs=1e-9 if not offset else 1e-6)
                assert h[k, i].alpha == pytest.approx(f.y[frame].mean() - beta * f.x[frame].mean(), rel=1e-6, abs=1e-9)
            else:
                assert h[k, i].beta is None


def test_a_wide_window_costs_no_more_than_a_narrow_one(spark):
    d = ordered.staged(ordered.with_index(spark.range(60_000).select(F.col("id").alias("idx"), F.randn(1).alias("spread")), "idx"))
    took = {}
    for window in (60, 5000, 60, 5000):
        began = time.perf_counter()
        tp.zscore(d, window, order_col="idx").write.format("noop").mode("overwrite").save()
        took[window] = time.perf_counter() - began
    assert took[5000] < 2.5 * took[60] + 1


@pytest.mark.parametrize("entry, exit, stop", [(1.0, 1.5, 3.0), (2.0, 0.5, None), (0.5, 2.0, 2.5), (1.0, 1.0, 1.0)])
def test_composed_maps_are_the_machine(entry, exit, stop):
    r = random.Random(8)
    for n in (1, 2, 7, 64, 301):
        z = np.array([r.choice([math.nan, r.gauss(0, 2), entry, -entry, exit, stop or 5.0]) for _ in range(n)])
        got = composed(row_maps(z, entry, exit, stop))
        for start in range(4):
            state, want = start, []
            for v in z:
                state = step(state, v, entry, exit, stop)
                want.append(state)
            assert got[:, start].tolist() == want
    assert FLAT == 0


@pytest.mark.parametrize("small, cuts", [(8192, 64), (4, 3), (30, 8)])
def test_selected_ranks_are_those_of_a_sort(spark, monkeypatch, small, cuts):
    monkeypatch.setattr(selection, "SMALL", small)
    monkeypatch.setattr(selection, "CUTS", cuts)
    r = random.Random(4)
    made = {"spread": [r.gauss(0, 1) for _ in range(300)], "ties": [float(r.choice([1, 1, 1, 1, 2, 7, 1e9])) for _ in range(250)], None: [5.0] * 60, "one": [3.0]}
    values = spark.createDataFrame([(k, v) for k, s in made.items() for v in s], "key string, v double")
    wanted = {k: sorted({0, len(s) - 1, len(s) // 2, *(r.randrange(len(s)) for _ in range(5))}) for k, s in made.items()}
    got = selection.ranked_values(values, wanted, {k: (len(s), min(s), max(s)) for k, s in made.items()})
    assert got == {(k, i): sorted(made[k])[i] for k, ranks in wanted.items() for i in ranks}
    with pytest.raises(ValueError):
        selection.ranked_values(values, {"one": [1]}, {"one": (1, 3.0, 3.0)})


@pytest.mark.parametrize("small", [8192, 5])
def test_summaries_and_splits(spark, monkeypatch, small):
    monkeypatch.setattr(selection, "SMALL", small)
    rng = np.random.default_rng(3)
    f = pd.DataFrame({"a": rng.normal(size=170), "b": rng.integers(0, 4, 170).astype(float)})
    f.loc[[3, 8], "a"] = np.nan
    d = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i) if i else None, *map(float, row), None) for i, row in enumerate(f.to_numpy())], "ts timestamp_ntz, a double, b double, empty double")
    got = {r.column: r for r in describe(d, ["a", "b", "empty"]).collect()}
    for c in ("a", "b"):
        assert [got[c][k] for k in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")] == pytest.approx(f[c].describe().tolist())
    assert tuple(got["empty"]) == ("empty", 0, *[None] * 7)
    for share in (0.01, 0.5, 0.7, 0.999):
        at = d.select(split_point(d, share)).first()[0]
        assert at == dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * int(170 * share))
    assert d.select(split_point(d, 0.001)).first()[0] is None  # the row without a time comes first
