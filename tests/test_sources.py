"""Vendor downloads with stand-in clients, seeded generators against plain numpy, bar tables and their manifest."""

import datetime as dt
import hashlib
import json
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tidepool as tp
from tidepool.operators import continuous
from tidepool.sources import bars, prices

DAY = dt.datetime(2024, 1, 1)


def rows_of(df):
    return [tuple(r) for r in df.orderBy("ts").collect()]


def vendor(fields, zone=None, several=True, fail=None):
    """A download() that gives two days of each ticker, in columns (field, ticker) or plain ones."""

    def download(tickers, start, end, interval, auto_adjust, progress):
        (ticker,) = tickers
        assert (start, end, interval, auto_adjust, progress) == ("2024-01-01", None, "1d", False, False)
        if fail and ticker in fail:
            raise OSError("no answer")
        base = {"ES=F": 10.0, "NQ=F": 20.0, "SPY": 1.0, "QQQ": 2.0}[ticker]
        index = pd.DatetimeIndex([DAY, DAY + dt.timedelta(days=1)], tz=zone)
        names = pd.MultiIndex.from_product([fields, [ticker]]) if several else list(fields)
        return pd.DataFrame([[base + i for i in range(len(fields))], [np.nan, *[base + 5 + i for i in range(1, len(fields))]]], index=index, columns=names)

    return download


@pytest.mark.parametrize("several", [True, False])
@pytest.mark.parametrize("zone", [None, "America/New_York"])
def test_yfinance_takes_adjusted_closes(spark, several, zone):
    got = tp.fetch_yfinance(spark, tp.DEFAULT_TICKERS, "2024-01-01", download=vendor(["Adj Close", "Close"], zone, several))
    assert got.columns == ["ts", "ES", "NQ"] and rows_of(got) == [(DAY, 10.0, 20.0)]  # the second day has no adjusted close


def test_yfinance_takes_closes_where_there_are_no_adjusted_ones(spark):
    got = tp.fetch_yfinance(spark, {"A": "SPY"}, "2024-01-01", download=vendor(["Open", "Close"]))
    assert rows_of(got) == [(DAY, 2.0), (DAY + dt.timedelta(days=1), 7.0)]


def test_yfinance_gives_an_empty_panel_for_no_rows(spark):
    got = tp.fetch_yfinance(spark, tp.DEFAULT_TICKERS, "2024-01-01", download=lambda *_, **__: pd.DataFrame())
    assert got.columns == ["ts", "ES", "NQ"] and got.count() == 0


def test_fallback_goes_on_after_a_failing_download(spark):
    got = tp.load_prices(spark, "yfinance", "2024-01-01", download=vendor(["Close", "x"], fail={"NQ=F"}))
    assert rows_of(got)[0] == (DAY, 1.0, 2.0)
    with pytest.raises(RuntimeError, match="generate_synthetic_pair"):
        tp.load_prices(spark, "yfinance", "2024-01-01", download=vendor(["Close"], fail={"NQ=F", "QQQ"}))


def test_spans_of_a_range():
    assert prices.date_spans("2024-01-01", None, None) == [("2024-01-01", None)]
    assert prices.date_spans("2024-01-01", "2024-01-10", 4) == [("2024-01-01", "2024-01-05"), ("2024-01-05", "2024-01-09"), ("2024-01-09", "2024-01-10")]
    assert prices.date_spans("2024-01-01", "2024-01-05", 4) == [("2024-01-01", "2024-01-05")]
    assert prices.date_spans("2024-01-01", None, 10_000)[-1] == ("2024-01-01", None)
    with pytest.raises(ValueError):
        prices.date_spans("2024-01-01", None, 0)


def flaky(folder, fail_first):
    """read(symbol, from, to): a row a day, after having failed ``fail_first`` times for each part, half-way through."""

    def read(symbol, start, end):
        mark = f"{folder}/{symbol}-{start}"
        tries = int(open(mark).read()) if os.path.exists(mark) else 0
        with open(mark, "w") as f:
            f.write(str(tries + 1))
        day, stop = dt.datetime.fromisoformat(start), dt.datetime.fromisoformat(end)
        for n in range((stop - day).days):
            if tries < fail_first and n == (stop - day).days // 2:
                raise OSError("connection lost")
            yield day + dt.timedelta(days=n), symbol, "close", float((day + dt.timedelta(days=n)).toordinal())

    return read


def test_a_vendor_that_fails_once_a_part_gives_all_rows(spark, tmp_path):
    got = prices.vendor_rows(spark, ["a", "b"], flaky(tmp_path, 1), "2024-01-01", "2024-02-15", days=10, pause=0.01)
    days = [DAY + dt.timedelta(days=n) for n in range(45)]
    assert sorted((r.ts, r.ticker, r.value) for r in got.collect()) == sorted((d, t, float(d.toordinal())) for d in days for t in "ab")
    assert len(os.listdir(tmp_path)) == 10
    with pytest.raises(Exception, match="connection lost"):
        prices.vendor_rows(spark, ["c"], flaky(tmp_path, 9), "2024-01-01", "2024-01-05", attempts=2, pause=0.01)


def test_a_restarted_vendor_stream_gives_no_row_twice(spark, tmp_path):
    (tmp_path / "marks").mkdir()
    clock = str(tmp_path / "today")
    until = lambda: open(clock).read()

    def run(today):
        (tmp_path / "today").write_text(today)
        stream = prices.stream_vendor(spark, ["a", "b"], flaky(str(tmp_path / "marks"), 1), "2024-01-01", until, pause=0.01)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted((r.ts, r.ticker) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for today in ("2024-01-08", "2024-01-08", "2024-01-20"):
        days = (dt.date.fromisoformat(today) - DAY.date()).days
        assert run(today) == sorted((DAY + dt.timedelta(days=n), t) for n in range(days) for t in "ab")


class Client:
    def __init__(self, key):
        assert key == "secret"
        self.timeseries = self

    def get_range(self, dataset, symbols, schema, start, end, stype_in):
        assert (dataset, schema, stype_in) == ("GLBX.MDP3", "ohlcv-1d", "continuous")
        self.symbol = symbols[0]
        return self

    def to_df(self):
        if self.symbol == "bad":
            raise OSError("not entitled")
        index = pd.DatetimeIndex([DAY, DAY, DAY + dt.timedelta(days=1)], tz="UTC", name="ts_event")
        base = 10.0 if self.symbol.startswith("ES") else 20.0
        return pd.DataFrame({"symbol": self.symbol, "close": [base, base + 2, base + 3], "volume": 1}, index=index)


def test_databento(spark, monkeypatch):
    for name in ("DATABENTO_API_KEY", "DATABENTO_DATASET"):
        monkeypatch.delenv(name, raising=False)
    symbols = {"ES": "ES.v.0", "NQ": "NQ.v.0"}
    with pytest.raises(RuntimeError, match="DATABENTO_API_KEY"):
        tp.fetch_databento(spark, symbols, "2024-01-01", None, client=Client)
    got = tp.load_prices(spark, "databento", "2024-01-01", symbols=symbols, api_key="secret", client=Client)
    assert rows_of(got) == [(DAY, 11.0, 21.0), (DAY + dt.timedelta(days=1), 13.0, 23.0)]
    with pytest.raises(RuntimeError, match="no bars"):
        tp.fetch_databento(spark, {"ES": "bad"}, "2024-01-01", None, api_key="secret", client=Client)
    with pytest.raises(ValueError, match="symbols"):
        tp.load_prices(spark, "databento")


def test_missing_packages_are_named(spark, monkeypatch):
    monkeypatch.setattr(prices.importlib.util, "find_spec", lambda name: None)
    with pytest.raises(ImportError, match="yfinance"):
        tp.fetch_yfinance(spark, tp.DEFAULT_TICKERS, "2024-01-01")
    with pytest.raises(ImportError, match="databento"):
        tp.fetch_databento(spark, {"ES": "ES.v.0"}, "2024-01-01", None, api_key="k")


def test_synthetic_pair_is_what_numpy_draws(spark):
    got = tp.generate_synthetic_pair(spark, 300, seed=11).toPandas().sort_values("ts")
    rng = np.random.default_rng(11)
    x = np.log(100.0) + rng.normal(0, 0.01, 300).cumsum()
    e = rng.normal(0, math.sqrt(2 * 0.05), 300)
    s = np.zeros(300)
    for t in range(1, 300):
        s[t] = s[t - 1] - 0.05 * s[t - 1] + e[t]
    assert np.allclose(got.NQ, np.exp(x), rtol=1e-12) and np.allclose(np.log(got.ES), 100 + 1.3 * x + s, rtol=1e-12)
    assert list(got.ts) == list(pd.bdate_range("2018-01-01", periods=300))


def test_ou_path_is_what_numpy_draws(spark):
    got = tp.simulate_ou(spark, tp.OUParams(0.3, 2.0, 0.7, 0.5), 200, x0=1.0, seed=5, paths=3).toPandas()
    e = np.random.default_rng(5).normal(0.0, 0.7 * math.sqrt((1 - math.exp(-0.3)) / 0.6), 200)
    x = [1.0]
    for t in range(1, 200):
        x.append(2.0 + (x[-1] - 2.0) * math.exp(-0.15) + e[t])
    assert np.allclose(got[got.path == 0].sort_values("idx").x, x, rtol=1e-12)
    assert len(got) == 600 and not np.allclose(got[got.path == 1].x, got[got.path == 2].x)


def test_bar_tables_keep_other_days(spark, tmp_path):
    path = f"file://{tmp_path}/bars"
    row = lambda day, minute, price: (DAY + dt.timedelta(days=day, minutes=minute), "s", "p", "X", price)
    schema = "ts_event timestamp_ntz, source string, product string, contract string, close double"
    bars.write_bars(spark.createDataFrame([row(d, m, float(m)) for d in range(3) for m in range(50)], schema), path)
    bars.write_bars(spark.createDataFrame([row(1, 0, 99.0)], schema), path)
    days = {r["date"]: (r.n, r.top) for r in bars.read_bars(spark, path).groupBy("date").agg(F.count("*").alias("n"), F.max("close").alias("top")).collect()}
    assert days == {(DAY + dt.timedelta(days=d)).date(): v for d, v in ((0, (50, 49.0)), (1, (1, 99.0)), (2, (50, 49.0)))}
    facts = json.loads(bars.manifest(spark, path, source="s", symbols=["X"]))
    assert facts["row_count"] == 101 and sum(f["rows"] for f in facts["files"]) == 101 and facts["source"] == "s"
    for f in facts["files"]:
        with open(f["path"].removeprefix("file://"), "rb") as file:
            assert f["sha256"] == hashlib.sha256(file.read()).hexdigest()
    assert facts["dataset_id"] == json.loads(bars.manifest(spark, path, source="s", symbols=["X"]))["dataset_id"]


BARS = "ts_event timestamp_ntz, source string, product string, contract string, close double"
bar = lambda day, minute, price, contract="X", source="s": (DAY + dt.timedelta(days=day, minutes=minute), source, "p", contract, price)


def test_merged_bars_have_each_key_once(spark, tmp_path):
    path = f"file://{tmp_path}/bars"
    first = [bar(d, m, 1.0, c) for d in range(3) for m in range(20) for c in "XY"]
    second = [bar(d, m, 2.0) for d in (1, 4) for m in range(10, 30)] + [bar(1, 10, 0.5), bar(2, 5, 3.0, "Y", "other")]
    for rows in (first, second, second, first[:5] + first[:5]):
        bars.merge_bars(spark.createDataFrame(rows, BARS), path)
    got = {(r.source, r.contract, r.ts_event): r.close for r in bars.read_bars(spark, path).collect()}
    want = {(s, c, t): v for t, s, _, c, v in first} | {(s, c, t): v for t, s, _, c, v in second if v != 0.5} | {(s, c, t): v for t, s, _, c, v in first[:5]}
    assert got == want and bars.read_bars(spark, path).count() == len(want)
    bars.write_bars(spark.createDataFrame([bar(9, 0, 1.0), bar(9, 0, 4.0)], BARS), path)
    assert bars.read_bars(spark, path).filter("date = '2024-01-10'").collect()[0].close == 4.0


def test_a_merge_that_fails_leaves_the_table(spark, tmp_path):
    path = f"file://{tmp_path}/bars"
    bars.merge_bars(spark.createDataFrame([bar(d, m, 1.0) for d in range(2) for m in range(20)], BARS), path)
    before = sorted(map(tuple, bars.read_bars(spark, path).collect()))
    bad = spark.createDataFrame([bar(d, m, 2.0) for d in range(3) for m in range(20)], BARS)
    bad = bad.withColumn("close", F.when((F.dayofmonth("ts_event") == 2) & (F.minute("ts_event") == 7), F.raise_error(F.lit("disk full")).cast("double")).otherwise(F.col("close")))
    with pytest.raises(Exception, match="disk full"):
        bars.merge_bars(bad, path)
    assert sorted(map(tuple, bars.read_bars(spark, path).collect())) == before


def test_manifests_name_each_kind_of_damage(spark, tmp_path):
    path = f"file://{tmp_path}/bars"
    bars.write_bars(spark.createDataFrame([bar(d, m, float(m), c) for d in range(4) for m in range(5) for c in ("X", "a b")], BARS), path)
    digest = bars.write_manifest(spark, path, f"file://{tmp_path}/m1")
    assert bars.write_manifest(spark, path, f"file://{tmp_path}/m2") == digest
    assert bars.compare_manifests(spark, f"file://{tmp_path}/m1", f"file://{tmp_path}/m2").count() == 0
    tree = {r.prefix: r for r in spark.read.parquet(f"file://{tmp_path}/m1/tree").collect()}
    assert (tree[""].files, tree[""].rows) == (8, 40) and tree[""].digest == digest
    files = sorted(p for p in (tmp_path / "bars").rglob("*.parquet"))
    gone, cut = files[0], files[1]
    gone.unlink()
    bars.write_bars(spark.createDataFrame([bar(9, 0, 1.0)], BARS), path)
    new = spark.createDataFrame([bar(0, m, 7.0) for m in range(3)], BARS).drop("source", "product", "contract").coalesce(1)
    new.write.parquet(f"file://{tmp_path}/one")
    (part,) = (tmp_path / "one").glob("part-*")
    cut.write_bytes(part.read_bytes())
    (cut.parent / f".{cut.name}.crc").unlink(missing_ok=True)
    assert bars.write_manifest(spark, path, f"file://{tmp_path}/m3") != digest
    found = {r.path: (r.change, r.detail) for r in bars.compare_manifests(spark, f"file://{tmp_path}/m1", f"file://{tmp_path}/m3").collect()}
    inside = lambda p: str(p.relative_to(tmp_path / "bars"))
    assert found.pop(inside(gone)) == ("missing", None) and found.pop(inside(cut)) == ("changed", "rows, size, sha256")
    assert [v for v in found.values()] == [("extra", None)] and "date=2024-01-10" in next(iter(found))


# ---- continuous series


@pytest.fixture(scope="module")
def rolled(spark):
    """Two contracts over forty sessions with one roll in the last week of the first."""
    first = dt.date(2024, 1, 1)
    days = [d.date() for d in pd.bdate_range(first, periods=40)]
    rng = np.random.default_rng(1)
    close = {"A": 100 + rng.normal(0, 1, 40).cumsum(), "B": 103 + rng.normal(0, 1, 40).cumsum()}
    rows = [("P", d, c, float(close[c][i]), float(10 if (c == "A") == (i < 24) else 5)) for i, d in enumerate(days) for c in "AB"]
    sessions = spark.createDataFrame(rows, "product string, session_date date, contract string, close double, volume double")
    contracts = spark.createDataFrame([("P", "A", days[29], 50.0), ("P", "B", days[39] + dt.timedelta(days=90), 50.0)], "product string, contract string, last_trade_date date, multiplier_usd double")
    active = continuous.active_contracts(sessions, contracts)
    return days, close, sessions, contracts, active, continuous.roll_calendar(active, sessions)


def test_adjusted_series_move_as_their_contracts(rolled):
    days, close, sessions, contracts, active, rolls = rolled
    (roll,) = rolls.collect()
    at = days.index(roll.roll_session_date)
    assert at == 25 and continuous.check_rolls(rolls, contracts).count() == 0
    for kind in ("panama", "ratio"):
        made = continuous.continuous(sessions, active, rolls, kind)
        assert continuous.broken_steps(made, kind).count() == 0
        spoilt = made.withColumn("adjusted", F.col("adjusted") + F.when(F.col("session_date") == days[10], 0.5).otherwise(0.0))
        assert {r.session_date for r in continuous.broken_steps(spoilt, kind).collect()} == {days[10], days[11]}
    made = continuous.continuous(sessions, active, rolls, "panama").orderBy("session_date").collect()
    assert made[0].adjusted - made[0].close == pytest.approx(roll.panama_offset)  # the gaps are what the two differ by
    assert made[at].adjusted - made[at - 1].adjusted == pytest.approx(close["B"][at] - close["B"][at - 1])


def test_as_of_series_do_not_look_ahead(rolled):
    days, _, sessions, contracts, _, _ = rolled
    early = sessions.filter(F.col("session_date") <= days[27])
    active = continuous.active_contracts(early, contracts)
    alone = continuous.continuous(early, active, continuous.roll_calendar(active, early), "panama")
    _, _, _, _, whole, rolls = rolled
    asof = continuous.continuous(sessions, whole, rolls, "panama", asof=str(days[27]))
    key = lambda df: sorted((r.session_date, r.contract, r.adjusted) for r in df.collect())
    assert key(alone) == key(asof) and len(key(asof)) == 28


def test_buy_and_hold_earns_what_its_contracts_earn(rolled):
    _, _, sessions, contracts, active, rolls = rolled
    held = active.select("product", "session_date", "contract", F.lit(1.0).alias("position"))
    pnl = continuous.contract_pnl(held, sessions, contracts).agg(F.sum("pnl")).first()[0]
    made = continuous.continuous(sessions, active, rolls, "panama").orderBy("session_date").collect()
    assert pnl == pytest.approx(50 * (made[-1].adjusted - made[0].adjusted))


def test_joint_rolls_are_clipped_by_the_guards(spark):
    d = dt.date
    rolls = spark.createDataFrame([("P", d(2024, 3, 4), "A"), ("Q", d(2024, 3, 13), "A")], "product string, roll_session_date date, from_contract string")
    contracts = spark.createDataFrame([("P", "A", d(2024, 3, 15)), ("Q", "A", d(2024, 3, 22))], "product string, contract string, last_trade_date date")
    assert continuous.joint_rolls(rolls).first().joint_roll_session_date == d(2024, 3, 13)
    assert continuous.joint_rolls(rolls, contracts=contracts).first().joint_roll_session_date == d(2024, 3, 11)  # the first expiry week's Monday


def test_ties_in_time_are_numbered_alike(spark):
    """Rows of one time in any order of arrival give the same positions."""
    rows = [(DAY + dt.timedelta(hours=i // 3), float(z)) for i, z in enumerate([0, -2.5, 1, 2.1, 0.2, 0, 3, -3, 5, 1, 0.1, -2.2])]
    got = {tuple(sorted((r.ts, r.z, r.position) for r in tp.generate_signals(spark.createDataFrame(some, "ts timestamp_ntz, z double").repartition(n)).collect())) for some, n in ((rows, 1), (rows[::-1], 3), (rows[5:] + rows[:5], 2))}
    assert len(got) == 1
