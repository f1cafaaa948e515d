"""As-of and interval joins, intraday bars in roll epochs, and the invariants of rolls."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidepool.functions import ordered
from tidepool.operators import continuous
from tidepool.operators.asof import asof_join, interval_join

DAY = dt.date(2024, 1, 1)


def plain_asof(left, right, exact):
    out = []
    for k, t, n in left:
        known = [r for r in right if r[0] == k and r[1] is not None and t is not None and (r[1] < t or (exact and r[1] == t))]
        best = max(known, key=lambda r: (r[1], r[2] is not None, r[2] or 0), default=None)
        out.append((k, t, n, best and best[2], best and best[1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("rows", [8192, 12])
def test_asof_join_is_a_plain_one(spark, monkeypatch, exact, rows):
    monkeypatch.setattr(ordered, "ROWS", rows)
    r = random.Random(2)
    time = lambda: r.choice([None, *range(-30, 90)])
    left = [(r.choice(["a", "b", None, "only left"]), time(), n) for n in range(150)] * 2
    right = [(r.choice(["a", "b", None, "only right"]), time(), r.choice([None, 1.5, r.random()])) for _ in range(80)]
    right += right[:9]
    a = spark.createDataFrame(left, "k string, t long, n long")
    b = spark.createDataFrame(right, "k string, t long, v double")
    got = asof_join(a, b, "t", ["k"], exact=exact, seen="at").collect()
    assert sorted(map(tuple, got), key=str) == plain_asof(left, right, exact)
    assert asof_join(a, b.limit(0), "t", ["k"]).filter("v is null").count() == 300 and asof_join(a.limit(0), b, "t", ["k"]).count() == 0
    with pytest.raises(ValueError):
        asof_join(a, b.withColumnRenamed("v", "n"), "t", ["k"])


def test_asof_join_on_timestamps_without_keys(spark):
    a = spark.sql("SELECT timestamp_ntz'2024-01-01 10:00:00' + make_interval(0,0,0,0,0,0,id * 7000) AS ts, id FROM range(40)")
    b = spark.sql("SELECT timestamp_ntz'2024-01-01 12:00:00' + make_interval(0,0,0,0,0,0,id * 20000) AS ts, id AS price FROM range(9)")
    got = [r.price for r in asof_join(a, b).orderBy("id").collect()]
    assert got == [None if 7000 * i < 7200 else min(8, (7000 * i - 7200) // 20000) for i in range(40)]


def test_interval_join(spark):
    spans = [("a", 0, 5, "x"), ("a", 5, 9, "y"), ("a", 20, None, "z"), (None, 2, 3, "n")]
    times = [(k, t) for k in ("a", None, "b") for t in (None, -1, 0, 4, 5, 8, 9, 19, 20, 99, 2)]
    got = interval_join(spark.createDataFrame(times, "k string, ts long"), spark.createDataFrame(spans, "k string, start long, end long, name string"), keys=["k"]).collect()
    inside = lambda k, t: next((s[3] for s in spans if s[0] == k and t is not None and s[1] <= t and (s[2] is None or t < s[2])), None)
    assert len(got) == len(times) and all(r.name == inside(r.k, r.ts) and (r.start is None) == (r.name is None) for r in got)


@pytest.fixture(scope="module")
def market(spark):
    """Three contracts of two products with drifting closes, and one bar every six hours."""
    r = random.Random(11)
    sessions, bars = [], []
    for p in ("ES", "NQ"):
        for c in range(3):
            close = 100.0 + 7 * c
            for d in range(90):
                day = DAY + dt.timedelta(days=d)
                volume = 1000 - abs(d - 15 - 30 * c) * 10 + r.randrange(5)
                for q in range(4):
                    close += r.gauss(0, 1)
                    bars.append((p, f"{p}{c}", dt.datetime.combine(day, dt.time(6 * q)), close))
                if not (c == 1 and d % 17 == 3):
                    sessions.append((p, day, f"{p}{c}", close, float(volume)))
    contracts = [(p, f"{p}{c}", DAY + dt.timedelta(days=32 + 30 * c)) for p in ("ES", "NQ") for c in range(3)]
    s = ordered.staged(spark.createDataFrame(sessions, "product string, session_date date, contract string, close double, volume double"))
    c = spark.createDataFrame(contracts, "product string, contract string, last_trade_date date")
    active = ordered.staged(continuous.active_contracts(s, c))
    rolls = ordered.staged(continuous.roll_calendar(active, s))
    return s, c, active, rolls, spark.createDataFrame(bars, "product string, contract string, ts_event timestamp_ntz, close double")


def test_intraday_bars_follow_the_front_contract(market):
    sessions, _, active, rolls, bars = market
    assert rolls.count() == 4
    for adjust in ("none", "panama", "ratio"):
        daily = {(r.product, r.session_date): r for r in continuous.continuous(sessions, active, rolls, adjust).collect()}
        got = continuous.intraday(bars, rolls, adjust).collect()
        assert len(got) == 2 * 90 * 4
        last = {(r.product, r.ts_event.date()): r for r in sorted(got, key=lambda r: r.ts_event)}
        assert all(last[k].contract == r.contract and last[k].adjusted == pytest.approx(r.adjusted) for k, r in daily.items())
    until = DAY + dt.timedelta(days=40)
    early = continuous.intraday(bars, rolls, "panama", asof=str(until)).collect()
    known = continuous.epochs(rolls, "panama", asof=str(until)).count()
    assert max(r.ts_event for r in early).date() == until and known == 4
    later = continuous.intraday(bars, rolls, opens="INTERVAL 12 HOURS").collect()
    firsts = {(r.product, r.contract): min(x.ts_event for x in later if (x.product, x.contract) == (r.product, r.contract)) for r in later}
    assert {t.hour for (p, c), t in firsts.items() if not c.endswith("0")} == {12}


def test_invariants_hold_and_breaches_are_named(market):
    sessions, contracts, active, rolls, _ = market
    for adjust in ("panama", "ratio"):
        series = ordered.staged(continuous.continuous(sessions, active, rolls, adjust))
        assert continuous.gap_accounts(series, rolls, adjust).count() == 0 and continuous.broken_steps(series, adjust).count() == 0
        bent = rolls.withColumns({"panama_offset": F.col("panama_offset") + (F.col("product") == "NQ").cast("double"), "ratio_factor": F.col("ratio_factor") * F.when(F.col("product") == "NQ", 1.1).otherwise(1.0)})
        assert [r.product for r in continuous.gap_accounts(series, bent, adjust).collect()] == ["NQ"]
    series = ordered.staged(continuous.continuous(sessions, active, rolls, "panama"))
    assert continuous.phantom_pnl(series, sessions).count() == 0
    raw = continuous.phantom_pnl(continuous.continuous(sessions, active, rolls, "none"), sessions).collect()
    assert {(r.product, r.session_date) for r in raw} <= {(r.product, r.roll_session_date) for r in rolls.collect()} and raw
    asof = str(DAY + dt.timedelta(days=50))
    assert all(continuous.look_ahead(sessions, contracts, asof, rule).count() == 0 for rule in ("v", "c", "fixed_k"))


def test_guards_hold_without_a_product_of_dates(market):
    sessions, contracts, active, _, _ = market
    plan = active._jdf.queryExecution().toString() + continuous.active_contracts(sessions, contracts)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    last = {r.contract: r.last_trade_date for r in contracts.collect()}
    for r in active.collect():
        monday = last[r.contract] - dt.timedelta(days=last[r.contract].weekday())
        assert r.session_date < monday or r.contract.endswith("2")


def test_bars_of_one_time_open_and_close_alike(spark):
    rows = [("p", "X", dt.datetime(2024, 1, 1, 10, 0), float(v), 9.0, 0.0, float(v), 1, s) for v, s in ((5, 2), (3, 1), (8, 3))]
    schema = "product string, contract string, ts_event timestamp_ntz, open double, high double, low double, close double, volume long, seq long"
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame(order, schema)
        by_value, by_seq = continuous.resample(d).first(), continuous.resample(d, tiebreak=["seq"]).first()
        assert (by_value.open, by_value.close, by_seq.open, by_seq.close, by_seq.volume) == (3, 8, 3, 8, 3)
