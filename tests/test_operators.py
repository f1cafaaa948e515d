"""Literal cases, statistical recovery and edge cases of the time-series operators."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tidepool as tp
from tidepool.functions import ordered
from tidepool.operators.signals import FLAT, POSITION, step

DAY = dt.datetime(2024, 1, 1)


def series(spark, values, name="value", order="idx"):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], f"{order} long, {name} double")


def values(df, name, order="idx"):
    return [r[name] for r in df.orderBy(order).collect()]


def panel(spark, es, nq, days=None):
    days = days or [d.to_pydatetime() for d in pd.bdate_range("2024-01-01", periods=len(es))]
    return spark.createDataFrame([(t, i, e, n) for i, (t, e, n) in enumerate(zip(days, es, nq))], "ts timestamp_ntz, seq long, ES double, NQ double")


def test_spread(spark):
    d = spark.createDataFrame([(10.0, 3.0), (20.0, 5.0)], "y double, x double")
    assert [r.spread for r in tp.compute_spread(d, beta=2.0, alpha=1.0).collect()] == [3.0, 9.0]


@pytest.mark.parametrize(
    "z, how, want",
    [
        ([0, -2.1, -1, 0.4, 0, 2.1, 1, -0.3, 4.1, 3, -0.2, -2.5], {}, [0, 1, 1, 0, 0, -1, -1, 0, 0, 0, 0, 1]),
        ([-2.5, None, float("nan"), 0.1], {}, [1, 1, 1, 0]),
        ([2.5, 5, 0], {"stop": None}, [-1, -1, 0]),
        ([2.0, -2.0, 2.1, 0.5, 4.0, 0.49], {}, [0, 0, -1, -1, -1, 0]),
        ([], {}, []),
    ],
)
def test_signals_literal(spark, z, how, want):
    got = tp.generate_signals(series(spark, z, "z"), order_col="idx", **how)
    assert values(got, "position") == want


@pytest.mark.parametrize("entry, exit, stop", [(2.0, 0.5, 4.0), (1.0, 1.0, None), (1.0, 1.5, 3.0), (0.5, 2.0, 2.5)])
def test_signals_are_those_of_the_machine(spark, monkeypatch, entry, exit, stop):
    monkeypatch.setattr("tidepool.operators.signals.ROWS", 40)
    monkeypatch.setattr(ordered, "ROWS", 40)
    r = random.Random(7)
    rows, want = [], {}
    for key in range(6):
        state = FLAT
        for i in range(150):
            z = None if r.random() < 0.1 else r.choice([r.gauss(0, 2), entry, -entry, exit, stop or 5.0])
            rows.append((key, i, z))
            state = step(state, float("nan") if z is None else z, entry, exit, stop)
            want[key, i] = int(POSITION[state])
    d = spark.createDataFrame(rows, "key long, idx long, z double")
    got = tp.generate_signals(d, entry, exit, stop, order_col="idx", partition_cols=["key"]).collect()
    assert {(x.key, x.idx): x.position for x in got} == want


def test_zscore(spark):
    z = values(tp.zscore(series(spark, range(100)), 10, value="value", order_col="idx"), "z")
    assert z[:9] == [None] * 9 and all(v is not None for v in z[9:])
    x = np.random.default_rng(0).normal(5, 2, 5000)
    full = np.array(values(tp.zscore(series(spark, x), value="value", order_col="idx"), "z"))
    assert abs(full.mean()) < 1e-10 and abs(full.std(ddof=1) - 1) < 1e-10
    gap = values(tp.zscore(series(spark, [1, 2, None, 4, 5, 7, 7, 7, 7]), 3, value="value", order_col="idx"), "z")
    assert [v is None for v in gap] == [True, True, True, True, True, False, False, True, True]


def test_backtest_literal(spark):
    d = spark.createDataFrame([(0, 0.0, 1.0), (1, 1.0, 1.0), (2, 3.0, 1.0), (3, 2.0, -1.0), (4, 2.0, -1.0)], "idx long, spread double, position double")
    r = tp.backtest_spread(d, cost_per_unit=0.1, lag=1, order_col="idx")
    assert values(r.table, "pnl") == pytest.approx([-0.1, 1, 2, -1.2, 0]) and r.trades == 2
    assert values(r.equity, "equity") == pytest.approx([-0.1, 0.9, 2.9, 1.7, 1.7])
    d = spark.createDataFrame([(0, 0.0, 0.0), (1, 2.0, 1.0), (2, 1.0, 1.0)], "idx long, spread double, position double")
    assert values(tp.backtest_spread(d, lag=0, order_col="idx").table, "pnl") == [0, 2, -1]
    apart = tp.backtest_spread(d.select("idx", "spread"), d.filter("idx = 1").select("idx", "position"), lag=1, order_col="idx")
    assert values(apart.table, "position") == [0, 1, 0] and values(apart.table, "pnl") == [0, 0, -1]
    with pytest.raises(ValueError):
        tp.backtest_spread(d, lag=-1, order_col="idx")


def test_metrics(spark):
    m = tp.performance_metrics(series(spark, [1, -0.5, 2, -1, 0.5], "pnl"), order_col="idx").first()
    p = np.array([1, -0.5, 2, -1, 0.5])
    assert (m.total_pnl, m.n_periods, m.max_drawdown) == (2, 5, 1) and m.hit_rate == pytest.approx(0.6)
    assert m.sharpe == pytest.approx(p.mean() / p.std(ddof=1) * math.sqrt(252))
    assert tp.performance_metrics(series(spark, [1, 1, 1], "pnl"), order_col="idx").first().sharpe == 0
    assert tuple(tp.performance_metrics(series(spark, [], "pnl"), order_col="idx").first()) == (0.0, 0.0, 0.0, 0.0, 0)
    assert tp.performance_metrics(series(spark, [-3, 1], "pnl"), order_col="idx").first().max_drawdown == 0


def test_clean(spark):
    days = [*(d.to_pydatetime() for d in pd.bdate_range("2024-01-01", periods=4)), DAY]
    d = tp.align_and_clean(panel(spark, [100.0, -1.0, 102.0, 103.0, 100.0], [50.0, 51.0, 0.0, 53.0, 50.0], days), seq_col="seq")
    assert [(r.ES, r.NQ) for r in d.orderBy("ts").collect()] == [(100, 50), (100, 51), (102, 51), (103, 53)]
    d = tp.align_and_clean(panel(spark, [100.0, None, float("nan"), None, None, 105.0], [50.0] * 6), seq_col="seq")
    assert [r.ES for r in d.orderBy("ts").collect()] == [100, 100, 100, 105]
    bad_first = tp.align_and_clean(panel(spark, [-1.0, 7.0], [1.0, 1.0], [DAY, DAY]), seq_col="seq", dropna=False)
    assert [tuple(r)[1:] for r in bad_first.collect()] == [(None, 1.0)]
    logs = tp.log_prices(panel(spark, [100.0, 0.0], [50.0, 51.0]), cols=["ES", "NQ"]).orderBy("ts").collect()
    assert math.exp(logs[0].ES) == pytest.approx(100) and logs[1].ES is None


def test_ordered_blocks_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS", 16)
    r = random.Random(1)
    rows = [(k, DAY + dt.timedelta(hours=3 * i), None if r.random() < 0.2 else r.gauss(0, 1)) for k in range(3) for i in range(120)]
    r.shuffle(rows)
    d = ordered.with_index(spark.createDataFrame(rows, "k long, ts timestamp_ntz, v double"), "ts", ["k"])
    d = ordered.windowed(d, {"m": lambda w: F.max("v").over(ordered.rolling(w, 9))}, 8, ["k"])
    d = ordered.cumulative(d, {"s": (F.col("v"), "sum"), "top": (F.col("v"), "max")}, ["k"])
    got = {(x.k, x[ordered.INDEX]): x for x in d.collect()}
    for k in range(3):
        own = [v for _, _, v in sorted((x for x in rows if x[0] == k), key=lambda x: x[1])]
        for i in range(120):
            frame, upto = [v for v in own[max(0, i - 8) : i + 1] if v is not None], [v for v in own[: i + 1] if v is not None]
            x = got[k, i]
            assert x.v == own[i] and x.m == (max(frame) if frame else None)
            assert (x.s, x.top) == ((pytest.approx(sum(upto)), max(upto)) if upto else (None, None))


def test_counted_frames_give_the_same(spark):
    r = random.Random(3)
    rows = [(k, i, None if r.random() < 0.1 else r.gauss(0, 2.5), r.gauss(0, 1)) for k in range(3) for i in range(80)]
    d = spark.createDataFrame(rows, "k long, idx long, z double, spread double")
    how = dict(order_col="idx", partition_cols=["k"])

    def made(n, exit, stop):
        s = tp.generate_signals(d, 2.0, exit, stop, rows=n, **how)
        t = tp.backtest_table(tp.zscore(s, 7, name="zz", rows=n, **how), 0.1, 2, rows=n, **how)
        m = tp.performance_metrics(t, equity="equity", trades="is_trade", rows=n, **how)
        o = tp.ou_table(d, rows=n, **how)
        rounded = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in df.collect()), key=str)
        return rounded(t.select("k", "idx", "zz", "position", "pnl", "equity", "is_trade")), rounded(m), rounded(o)

    for exit, stop in ((0.5, 4.0), (1.0, None), (2.5, 3.0)):
        assert made(None, exit, stop) == made(240, exit, stop)


def test_ou(spark):
    p = tp.OUParams(0.2, 0.0, 1.0, 1.0)
    assert p.half_life == pytest.approx(math.log(2) / 0.2)
    assert tp.OUParams(0.0, 0, 1, 1).half_life == math.inf and math.isnan(tp.OUParams(-1.0, 0, 1, 1).stationary_std)
    fit = tp.fit_ou(tp.simulate_ou(spark, p, 20_000, seed=0), value="x", order_col="idx")
    assert fit.theta == pytest.approx(0.2, rel=0.25) and fit.sigma == pytest.approx(1, rel=0.25) and abs(fit.mu) < 0.2
    with pytest.raises(ValueError):
        tp.fit_ou(series(spark, range(5)), value="value", order_col="idx")
    walk = tp.fit_ou(series(spark, np.random.default_rng(0).normal(size=5000).cumsum()), value="value", order_col="idx")
    assert math.isnan(walk.theta) or walk.theta >= 0


def test_ou_without_mean_reversion(spark):
    e = np.random.default_rng(2).normal(size=300)
    swing = np.zeros(300)
    for t in range(1, 300):
        swing[t] = -0.5 * swing[t - 1] + e[t]
    fit = tp.fit_ou(series(spark, swing), value="value", order_col="idx")
    assert math.isnan(fit.theta) and fit.half_life == math.inf and math.isnan(fit.stationary_std)
    grown = tp.fit_ou(series(spark, 1.05 ** np.arange(60)), value="value", order_col="idx")
    assert grown.theta == 0 and math.isnan(grown.mu) and grown.half_life == math.inf
    flat = tp.ou_table(series(spark, [3.0] * 20), value="value", order_col="idx").first()
    assert flat.theta is None and flat.n_obs == 20


@pytest.fixture(scope="module")
def logs(spark):
    d = tp.log_prices(tp.generate_synthetic_pair(spark, 3000, seed=0, sigma_spread=0.05), cols=["ES", "NQ"])
    return ordered.staged(d.select("ts", F.col("ES").alias("y"), F.col("NQ").alias("x")))


def test_cointegration(logs):
    r = tp.engle_granger(logs)
    assert r.pvalue < 0.05 and r.is_cointegrated
    ols, tls = tp.estimate_hedge_ratio(logs), tp.estimate_hedge_ratio(logs, method="tls")
    assert abs(ols.beta - 1.3) < 0.1 and ols.r_squared > 0.9 and abs(tls.beta - ols.beta) < 0.1
    assert tp.adf_test(ols.residuals, value="residual")["pvalue"] < 0.05
    with pytest.raises(ValueError):
        tp.estimate_hedge_ratio(logs, method="wls")


def test_unit_root_regression(spark):
    from tidepool.operators.unitroot import dickey_fuller

    v = np.random.default_rng(3).normal(size=400).cumsum()
    v -= v.mean()
    d = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], f"{ordered.INDEX} long, v double")
    stat, lags = dickey_fuller(d, 400, True, 2, None)
    dy = np.diff(v)
    x = np.column_stack([np.ones(397), v[2:-1], dy[1:-1], dy[:-2]])
    b, ssr, *_ = np.linalg.lstsq(x, dy[2:], rcond=None)
    se = math.sqrt(ssr[0] / (397 - 4) * np.linalg.inv(x.T @ x)[1, 1])
    assert lags == 2 and stat == pytest.approx(b[1] / se, rel=1e-8)


def plain_dickey_fuller(v, lags, constant, most):
    """t-ratio of the level and AIC of a regression with ``lags`` lagged differences, over the rows that ``most`` leave."""
    dy = np.diff(v)
    n = len(dy) - most
    cols = [v[most : most + n], *(dy[most - i : most - i + n] for i in range(1, lags + 1))]
    x = np.column_stack([*([np.ones(n)] if constant else []), *cols])
    y = dy[most:]
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    ssr = ((y - x @ b) ** 2).sum()
    at = int(constant)
    se = math.sqrt(ssr / (n - x.shape[1]) * np.linalg.inv(x.T @ x)[at, at])
    return b[at] / se, n * (math.log(2 * math.pi) + math.log(ssr / n) + 1) + 2 * x.shape[1]


def plain_auto(v, constant):
    """The lag order with the least AIC, all compared over the same rows, then fitted over all rows it leaves."""
    n = len(v)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - int(constant) - 1)
    best = min(range(most + 1), key=lambda p: plain_dickey_fuller(v, p, constant, most)[1])
    return plain_dickey_fuller(v, best, constant, best)[0], best


@pytest.mark.parametrize("kind", ["walk", "ar1", "ar3"])
def test_adf_chooses_its_lags_as_a_plain_search(spark, kind):
    from tidepool.functions.unitroot import p_value
    from tidepool.operators.unitroot import dickey_fuller

    rng = np.random.default_rng(8)
    e = rng.normal(size=300)
    v = e.cumsum() if kind == "walk" else np.zeros(300)
    for t in range(3, 300):
        if kind != "walk":
            v[t] = 0.8 * v[t - 1] + e[t] if kind == "ar1" else 0.5 * v[t - 1] + 0.2 * v[t - 2] - 0.4 * v[t - 3] + e[t]
    want, lags = plain_auto(v, True)
    got = tp.adf_test(series(spark, v), value="value", order_col="idx")
    assert got["statistic"] == pytest.approx(want, rel=1e-7) and got["pvalue"] == pytest.approx(p_value(want, 1, "c"))
    d = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v - v.mean())], f"{ordered.INDEX} long, v double")
    assert dickey_fuller(d, 300, True)[1] == lags
    assert (got["pvalue"] < 0.05) == got["is_stationary"] and (got["is_stationary"] or kind == "walk")


@pytest.mark.parametrize("trend", ["n", "c", "ct"])
def test_engle_granger_is_a_plain_one(spark, trend):
    rng = np.random.default_rng(9)
    x = 5 + rng.normal(size=250).cumsum()
    y = 1.5 * x + 2 + rng.normal(size=250)
    cols = {"n": [x], "c": [x, np.ones(250)], "ct": [x, np.ones(250), np.arange(1, 251)]}[trend]
    b, *_ = np.linalg.lstsq(np.column_stack(cols), y, rcond=None)
    want, _ = plain_auto(y - np.column_stack(cols) @ b, False)
    got = tp.engle_granger(spark.createDataFrame([(i, float(a), float(c)) for i, (a, c) in enumerate(zip(y, x))], "idx long, y double, x double"), trend=trend, order_col="idx")
    assert got.statistic == pytest.approx(want, rel=1e-6) and got.is_cointegrated == (got.pvalue < 0.05)
    assert got.is_cointegrated or trend == "n"  # without a constant, the level of x stays in the residuals


def test_p_values_at_published_quantiles():
    """The critical values of long samples have about their own p-values."""
    from tidepool.functions.unitroot import critical_values, p_value

    for key in ((1, "c"), (2, "c"), (2, "ct")):
        for level, value in critical_values(*key, 10**9).items():
            assert p_value(value, *key) == pytest.approx(float(level.rstrip("%")) / 100, rel=0.12)


def test_rolling_hedge(spark):
    d = tp.log_prices(tp.generate_synthetic_pair(spark, 1000, seed=0, sigma_spread=0.05), cols=["ES", "NQ"])
    rows = tp.rolling_hedge_ratio(d, 250, y="ES", x="NQ").orderBy("ts").collect()
    assert all(r.beta is None for r in rows[:249]) and abs(rows[-1].beta - 1.3) < 0.2


def test_walk_forward(spark):
    prices = ordered.staged(tp.generate_synthetic_pair(spark, 2000, seed=0, sigma_spread=0.05, sigma_common=0.02))
    r = tp.walk_forward_backtest(prices)
    assert set(r) == {"hedge", "ou", "train", "test", "spread", "zscore"}
    assert (r["train"].table.count(), r["test"].table.count()) == (1400, 600) and abs(r["hedge"].beta - 1.3) < 0.15
    assert r["test"].metrics["n_periods"] == 600


def test_split(spark):
    d = tp.generate_synthetic_pair(spark, 100)
    a, b = tp.train_test_split_by_date(d, 0.7)
    at = b.agg(F.min("ts")).first()[0]
    c, e = tp.train_test_split_by_date(d, str(at))
    assert [x.count() for x in (a, b, c, e)] == [70, 30, 70, 30]
    with pytest.raises(ValueError):
        tp.train_test_split_by_date(d, 1.5)
    with pytest.raises(TypeError):
        tp.train_test_split_by_date(d, 1)


def test_sources(spark):
    d = tp.generate_synthetic_pair(spark, 500, seed=0).toPandas()
    assert d.shape == (500, 3) and (d[["ES", "NQ"]] > 0).all().all()
    calls = []

    def fetch(spark, tickers, **_):
        calls.append(tickers)
        if tickers is tp.DEFAULT_TICKERS:
            raise RuntimeError("no")
        return spark.createDataFrame([(DAY, 1.0, 2.0)], "ts timestamp_ntz, ES double, NQ double")

    assert tp.load_prices(spark, "yfinance", fetchers={"yfinance": fetch}).count() == 1
    assert calls == [tp.DEFAULT_TICKERS, tp.PROXY_TICKERS]

    def fail(*_, **__):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError, match="generate_synthetic_pair"):
        tp.load_prices(spark, "yfinance", fetchers={"yfinance": fail})
    with pytest.raises(ValueError):
        tp.load_prices(spark, "other")


def test_stream_bars(spark, tmp_path):
    from tidepool.streaming.bars import stream_bars

    rows = [(DAY + dt.timedelta(minutes=m), "p", "X", float(m), float(m), float(m), float(m), 1) for m in range(60)]
    schema = "ts_event timestamp, product string, contract string, open double, high double, low double, close double, volume long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = stream_bars(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("bars5").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.ts_event - DAY).seconds // 60: (r.open, r.close, r.volume) for r in spark.table("bars5").collect()}
    assert got[0] == (0.0, 4.0, 5) and len(got) >= 9


def test_p_values_far_out():
    from tidepool.functions.unitroot import SMALL_P, p_value, valid_range

    for key in SMALL_P:
        assert [p_value(t, *key) for t in (-math.inf, -50.0, -25.0)] == [0, 0, 0] and p_value(math.inf, *key) == p_value(5.0, *key) == 1
        low, high = valid_range(key)
        steps = [p_value(low + (high - low) * k / 400, *key) for k in range(401)]
        assert steps == sorted(steps) or max(a - b for a, b in zip(steps, steps[1:])) < 2e-3  # but for where the branches meet


@pytest.mark.parametrize("trend", ["n", "c", "ct"])
def test_clear_and_perfect_cointegration(spark, trend):
    rng = np.random.default_rng(4)
    x = 5 + rng.normal(size=2500).cumsum()
    pair = lambda y: spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x))], "idx long, y double, x double")
    near = tp.engle_granger(pair(1.5 * x + (0 if trend == "n" else 2) + rng.normal(size=2500)), trend=trend, order_col="idx")
    assert near.statistic < -20 and near.pvalue == 0 and near.is_cointegrated
    same = tp.engle_granger(pair(1.5 * x + (0 if trend == "n" else 2)), trend=trend, order_col="idx")
    assert same.statistic == -math.inf and same.pvalue == 0 and same.is_cointegrated


def test_many_unit_roots_are_those_of_each(spark, monkeypatch):
    monkeypatch.setattr("tidepool.operators.unitroot.ROWS", 64)
    rng = np.random.default_rng(5)
    made = {"walk": rng.normal(size=300).cumsum(), "noise": rng.normal(size=150), None: np.convolve(rng.normal(size=420), [1, 0.5, 0.3], "valid").cumsum(), "short": rng.normal(size=2), "flat": np.ones(50)}
    rows = [(k, i, float(v)) for k, s in made.items() for i, v in enumerate(s)] + [("noise", 500, None), ("noise", 501, math.nan)]
    random.Random(0).shuffle(rows)
    d = spark.createDataFrame(rows, "name string, idx long, v double")
    got = {r.name: r for r in tp.adf_many(d, ["name"], value="v", order_col="idx").collect()}
    assert set(got) == set(made) and got["flat"].statistic is None and got["short"].statistic is None
    for k in ("walk", "noise", None):
        want, lags = plain_auto(made[k] - made[k].mean(), True)
        assert got[k].statistic == pytest.approx(want, rel=1e-7) and got[k].lags == lags and got[k].n == len(made[k]) and got[k].rejected == (got[k].pvalue < 0.05)


def test_many_pairs_are_those_of_each(spark):
    rng = np.random.default_rng(6)
    rows, apart = [], {}
    for k, name in enumerate(["a", None, "c"]):
        x = rng.normal(0, 0.02, 400 + 40 * k).cumsum()
        y = 0.5 + 1.2 * x + np.convolve(rng.normal(0, 0.02, len(x) + 9), np.ones(10) / 3, "valid")
        apart[name] = list(zip(np.exp(y).tolist(), np.exp(x).tolist()))
        rows += [(name, i, *v) for i, v in enumerate(apart[name])]
    d = spark.createDataFrame(rows, "name string, idx long, y double, x double")
    many = tp.walk_forward_many(d, ["name"], split=0.6, z_window=20, cost_per_unit=0.001, order_col="idx")
    hedge, ou = ({r.name: r for r in many[part].collect()} for part in ("hedge", "ou"))
    metrics = {(r.name, r.part): r for r in many["metrics"].collect()}
    table = many["table"].collect()
    egs = {r.name: r for r in tp.engle_granger_many(d, ["name"], order_col="idx").collect()}
    for name in ("a", None):
        one = spark.createDataFrame([(i, *v) for i, v in enumerate(apart[name])], "idx long, y double, x double")
        single = tp.walk_forward_backtest(one, "y", "x", 0.6, 20, cost_per_unit=0.001, order_col="idx")
        assert hedge[name].beta == pytest.approx(single["hedge"].beta) and ou[name].theta == pytest.approx(single["ou"].theta)
        for part in ("train", "test"):
            m = single[part].metrics | {"trades": single[part].trades}
            assert {k: metrics[name, part][k] for k in m} == {k: pytest.approx(v) for k, v in m.items()}
            own = {r.idx: r.pnl for r in table if r.name == name and r.part == part}
            assert own == {r.idx: pytest.approx(r.pnl) for r in single[part].table.collect()}
        alone = tp.engle_granger(one, order_col="idx")
        assert egs[name].statistic == pytest.approx(alone.statistic) and egs[name].rejected == alone.is_cointegrated
    assert len(table) == len(rows) and sum(r.trades for r in metrics.values()) > 0


def test_null_keys_are_keys(spark):
    rows = [(k, i, math.sin(i) + (i % 7) / 5, float(i % 3)) for k in ("a", None) for i in range(30)]
    d = spark.createDataFrame(rows, "k string, idx long, spread double, position double")
    how = dict(order_col="idx", partition_cols=["k"])
    for rows_ in (None, 60):
        z = tp.zscore(d, 3, rows=rows_, **how)
        s = tp.generate_signals(z.drop("position"), 1.0, 0.5, 1.4, rows=rows_, **how)
        t = tp.backtest_table(s, rows=rows_, **how).collect()
        by = {k: sorted((r.idx, r.z, r.position, r.equity) for r in t if r.k == k and r.z is not None) for k in ("a", None)}
        assert len(t) == 60 and by["a"] == by[None] and len(by["a"]) == 28
    assert tp.generate_signals(z.drop("position"), 1.0, 1.2, **how).count() == tp.zscore(d, **how).filter("z is not null").count() == 60


def test_nan_is_as_null(spark):
    r = random.Random(9)
    rows = [(i, r.gauss(0, 1), r.gauss(0, 1), r.choice([-1.0, 0.0, 1.0])) for i in range(40)]
    at = {3: 1, 11: 2, 12: 1, 20: 3, 31: 2}
    frame = lambda gap: spark.createDataFrame([tuple(gap if at.get(i) == c else v for c, v in enumerate(row)) for i, row in enumerate(rows)], "idx long, y double, x double, position double")
    found = []
    for gap in (None, math.nan):
        whole = frame(gap).withColumn("_i", F.col("idx"))
        d = whole.drop("position")  # which the other operators leave alone
        made = [tp.compute_spread(d, beta=0.5), tp.zscore(d.drop("x"), value="y", order_col="idx"), tp.zscore(d.drop("x"), 4, value="y", order_col="idx"), tp.hedge_table(d), tp.hedge_table(d, method="tls"), tp.rolling_hedge_ratio(d, 6, order_col="idx"), tp.backtest_table(whole.drop("x"), 0.1, spread="y", order_col="idx")]
        found.append([sorted((tuple(x) for x in m.collect()), key=lambda x: str(x[0])) for m in made])
    assert found[0] == found[1] and not any(isinstance(v, float) and math.isnan(v) for m in found[1] for row in m for v in row)
