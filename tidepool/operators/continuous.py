"""Bars by contract and continuous series: resampling, sessions, rolls, adjustment. (Designed, not in use anywhere yet.)

Prices are stored per contract and unadjusted; a continuous series is made from a roll calendar and a kind of adjustment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordered import INDEX, cumulative, join_on, staged, windowed, with_index
from .asof import asof_join

ZONE = "America/New_York"

BARS = T.StructType([
    T.StructField("ts_event", T.TimestampNTZType(), False), T.StructField("ts_recv", T.TimestampNTZType()), T.StructField("source", T.StringType()),
    T.StructField("product", T.StringType(), False), T.StructField("contract", T.StringType(), False), T.StructField("instrument_id", T.LongType()),
    *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")], T.StructField("volume", T.LongType()),
    T.StructField("interval", T.StringType()), T.StructField("session_date", T.DateType()), T.StructField("is_rth", T.BooleanType()),
])
CONTRACTS = T.StructType([
    T.StructField("product", T.StringType(), False), T.StructField("contract", T.StringType(), False), T.StructField("month_code", T.StringType()), T.StructField("year", T.ShortType()),
    T.StructField("first_trade_date", T.DateType()), T.StructField("last_trade_date", T.DateType()), T.StructField("expiration_ts", T.TimestampNTZType()),
    *[T.StructField(c, T.DoubleType()) for c in ("multiplier_usd", "tick_size", "tick_value_usd")],
    *[T.StructField(c, T.StringType()) for c in ("exchange", "currency", "source")], T.StructField("asof", T.DateType()),
])


def fixed_point(column: str, scale: float = 1e-9) -> Column:
    """Integer prices in units of ``scale`` as doubles."""
    return F.col(column).cast("double") * scale


def quarterly_contracts(spark: SparkSession, product: str, first_year: int, last_year: int, *, multiplier_usd: float, tick_size: float, exchange: str = "XCME", currency: str = "USD", source: str = "calendar") -> DataFrame:
    """The contracts of a product that expires on the third Friday of March, June, September and December, as CONTRACTS:
    named by product, month code (H, M, U, Z) and two digits of the year; they expire at 9:30 New York time, given in UTC."""
    year, quarter = F.floor(F.col("id") / 4).cast("int"), (F.col("id") % 4).cast("int")
    d = spark.range(4 * first_year, 4 * (last_year + 1)).select(year.alias("y"), quarter.alias("q"))
    third = F.date_add(F.next_day(F.date_sub(F.make_date("y", 3 * (F.col("q") + 1), F.lit(1)), 1), "FR"), 14)
    d = d.withColumns({"code": F.substring(F.lit("HMUZ"), F.col("q") + 1, F.lit(1)), "last": third})
    made = {
        "product": F.lit(product), "contract": F.concat(F.lit(product), "code", F.lpad((F.col("y") % 100).cast("string"), 2, "0")), "month_code": F.col("code"), "year": F.col("y"),
        "last_trade_date": F.col("last"), "expiration_ts": F.to_utc_timestamp(F.col("last").cast("timestamp_ntz") + F.expr("INTERVAL '9:30' HOUR TO MINUTE"), ZONE),
        "multiplier_usd": F.lit(multiplier_usd), "tick_size": F.lit(tick_size), "tick_value_usd": F.lit(multiplier_usd * tick_size), "exchange": F.lit(exchange), "currency": F.lit(currency), "source": F.lit(source),
    }
    return d.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CONTRACTS])


def duplicate_bars(bars: DataFrame, key: Sequence[str] = ("product", "contract", "ts_event")) -> DataFrame:
    """Keys that occur more than once, and how often; a sound bar table gives none."""
    return bars.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def resample(bars: DataFrame, every: str = "5 minutes", *, ts: str = "ts_event", keys: Sequence[str] = ("product", "contract"), tiebreak: Sequence[str] = ()) -> DataFrame:
    """Open, high, low, close and volume of coarser bars, named by the time they open.

    Of bars of one time, the first and last by ``tiebreak`` (a sequence number, say) open and close; without it, by values.
    """
    values = ("open", "high", "low", "close", "volume")
    first = F.struct(F.col(ts), *[F.col(c) for c in (tiebreak or values)])  # of bars of one time, all their values decide
    return bars.groupBy(*keys, F.window(ts, every).alias("w")).agg(
        F.min_by("open", first).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", first).alias("close"), F.sum("volume").alias("volume"),
    ).select(*keys, F.col("w.start").alias(ts), *values)


def with_sessions(bars: DataFrame, *, ts: str = "ts_event") -> DataFrame:
    """session_date (days end at 17:00 New York time; Saturday and Sunday count to Monday) and is_rth (9:30 to 16:00)."""
    local = F.from_utc_timestamp(F.col(ts).cast("timestamp"), ZONE)
    day = F.to_date(local + F.expr("INTERVAL 7 HOURS"))
    ahead = F.when(F.weekday(day) == 5, 2).when(F.weekday(day) == 6, 1).otherwise(0)
    minute = F.hour(local) * 60 + F.minute(local)
    return bars.withColumns({"session_date": F.date_add(day, ahead), "is_rth": (minute >= 570) & (minute < 960)})


def legs(bars: DataFrame, left: str, right: str, *, ts: str = "ts_event", value: str = "close") -> DataFrame:
    """Times that both products have, with either's value."""
    side = lambda p: bars.filter(F.col("product") == p).select(ts, F.col(value).alias(p))
    return side(left).join(side(right), ts)


def daily(bars: DataFrame) -> DataFrame:
    """One row for each product, session and contract: last close and volume."""
    return bars.groupBy("product", "session_date", "contract").agg(F.max_by("close", "ts_event").alias("close"), F.sum("volume").alias("volume"))


def business_days_before(n: int, column: str = "last_trade_date") -> Column:
    """The date ``n`` business days before a date."""
    return F.expr(f"date_sub({column}, {n} + 2 * cast(({n} + 4 - least(weekday({column}), 4)) div 5 as int))")


def monday_of(column: str = "last_trade_date") -> Column:
    return F.date_sub(column, F.weekday(column))


def active_contracts(sessions: DataFrame, contracts: DataFrame, rule: str = "v", *, first_roll_days: int = 10, k: int = 5) -> DataFrame:
    """(product, session_date, rank, contract, _i): the front contract, its rank in order of expiry, and the session's place.

    sessions(product, session_date, contract, volume[, open_interest]); contracts(product, contract, last_trade_date). By rule ``v`` or ``n`` the contract with the largest volume or open interest of
    the *session before*, never going back; by ``c`` from the Monday of the expiry week on, and by ``fixed_k`` from k
    business days before expiry on, the next one. In any case not before ``first_roll_days`` business days and not after
    that Monday.
    """
    if rule not in ("v", "n", "c", "fixed_k"):
        raise ValueError(f"unknown roll rule {rule!r}")
    keys = ["product"]
    order = Window.partitionBy("product").orderBy("last_trade_date", "contract")  # one row a contract
    ranked = contracts.select("product", "contract", "last_trade_date", F.row_number().over(order).cast("long").alias("rank"), F.count("*").over(Window.partitionBy("product")).alias("last"))
    monday, back = monday_of(), business_days_before
    dates = {"low": monday, "high": back(first_roll_days), **{"c": {"rank": monday}, "fixed_k": {"rank": F.least(back(k), monday)}}.get(rule, {})}
    # from each of a contract's dates on, the next one's rank: merged with the sessions in order of time
    steps = ranked.select("product", F.explode(F.array(*[F.struct(date.alias("session_date"), *[F.when(F.lit(name == n), F.col("rank") + 1).alias(n) for n in dates]) for name, date in dates.items()])).alias("s")).select("product", "s.*", F.lit(0).alias("_side"))
    if "rank" in dates:
        days = sessions.select("product", "session_date").distinct()
    else:
        measure = "volume" if rule == "v" else "open_interest"
        days = join_on(sessions, ranked.select("product", "contract", "rank"), ["product", "contract"]).groupBy("product", "session_date").agg(F.max_by("rank", F.struct(F.col(measure), -F.col("rank"))).alias("best"))
    # a row a session, written when first numbered, as it is read twice at every step from here on
    both = staged(with_index(staged(days.withColumn("_side", F.lit(1)).unionByName(steps, allowMissingColumns=True)), "session_date", keys, ["_side"]))
    d = cumulative(both, {n: (F.col(n), "max") for n in dates}, keys).filter("_side = 1").drop(INDEX, "_side")
    d = d.withColumns({n: F.coalesce(n, F.lit(1)) for n in dates})
    d = staged(with_index(staged(d), "session_date", keys))
    if "rank" not in dates:
        d = windowed(d, {"prior": lambda w: F.lag("best").over(w)}, 1, keys)
        clipped = F.least(F.greatest(F.coalesce("prior", F.lit(1)), "low"), "high")
        d = cumulative(d, {"rank": (clipped, "max")}, keys)
    last = ranked.groupBy("product").agg(F.max("last").alias("last"))
    d = join_on(d, last, keys).withColumn("rank", F.least("rank", "last"))
    return join_on(d.select("product", "session_date", "rank", INDEX), ranked.select("product", "rank", "contract"), ["product", "rank"])


def roll_calendar(active: DataFrame, sessions: DataFrame) -> DataFrame:
    """A row for each change of contract: its session, both contracts, and offset and ratio of their closes the session before."""
    d = windowed(with_index(active, "session_date", ["product"]), {"from_contract": lambda w: F.lag("contract").over(w), "decided": lambda w: F.lag("session_date").over(w)}, 1, ["product"])
    rolls = d.filter(F.col("contract") != F.col("from_contract")).select("product", F.col("session_date").alias("roll_session_date"), "from_contract", F.col("contract").alias("to_contract"), "decided")
    closes = join_on(rolls, sessions.select("product", F.col("session_date").alias("decided"), "contract", "close"), ["product", "decided"], "left")
    close = lambda side: F.max(F.when(F.col("contract") == F.col(f"{side}_contract"), F.col("close"))).alias(f"{side}_close")
    rolls = closes.groupBy("product", "roll_session_date", "from_contract", "to_contract").agg(close("from"), close("to"))
    return rolls.select("product", "roll_session_date", "from_contract", "to_contract", (F.col("to_close") - F.col("from_close")).alias("panama_offset"), F.try_divide("to_close", "from_close").alias("ratio_factor"))


def joint_rolls(rolls: DataFrame, quarter: Column | None = None, *, contracts: DataFrame | None = None, first_roll_days: int = 10) -> DataFrame:
    """For each quarter the later of the products' roll sessions.

    With contracts(product, contract, last_trade_date), the date is clipped by the guards of all contracts that are left:
    not before the last first day on which one may be rolled, and not after the first Monday of an expiry week.
    """
    q = quarter if quarter is not None else F.concat(F.year("roll_session_date"), F.lit("Q"), F.quarter("roll_session_date"))
    joint = F.max("roll_session_date")
    if contracts is not None:
        rolls = rolls.join(contracts.select("product", F.col("contract").alias("from_contract"), "last_trade_date"), ["product", "from_contract"], "left")
        joint = F.least(F.greatest(joint, F.max(business_days_before(first_roll_days))), F.min(monday_of()))  # nulls are skipped
    return rolls.groupBy(q.alias("quarter")).agg(joint.alias("joint_roll_session_date"), F.count("*").alias("n"))


def epochs(rolls: DataFrame, adjust: str = "none", *, asof: str | None = None, forward: bool = False) -> DataFrame:
    """(product, contract, since, shift): from which session each contract is the front one (null: from the first), and what
    its closes are shifted by (``ratio``: their logarithms). Of products without rolls there is no row: no shift.

    Windows range over the rolls of a product, a handful a year.
    """
    if adjust not in ("none", "panama", "ratio"):
        raise ValueError(f"unknown adjustment {adjust!r}")
    if asof is not None:
        rolls = rolls.filter(F.col("roll_session_date") <= asof)
    step = F.coalesce({"none": F.lit(0.0), "panama": F.col("panama_offset"), "ratio": F.log("ratio_factor")}[adjust], F.lit(0.0))
    by = Window.partitionBy("product")
    upto = by.orderBy("roll_session_date").rowsBetween(Window.unboundedPreceding, 0)
    d = rolls.select("product", "roll_session_date", "from_contract", "to_contract", F.sum(step).over(upto).alias("passed"), F.sum(step).over(by).alias("total"), F.row_number().over(by.orderBy("roll_session_date")).alias("n"))
    none = F.lit(None).cast("date")
    here = F.struct(F.col("to_contract").alias("contract"), F.col("roll_session_date").cast("date").alias("since"), F.col("passed").alias("passed"))
    before = F.struct(F.col("from_contract").alias("contract"), none.alias("since"), F.lit(0.0).alias("passed"))
    d = d.select("product", "total", F.explode(F.when(F.col("n") == 1, F.array(before, here)).otherwise(F.array(here))).alias("e"))
    return d.select("product", "e.contract", "e.since", (-F.col("e.passed") if forward else F.col("total") - F.col("e.passed")).alias("shift"))


def _shifted(adjust: str) -> Column:
    shift = F.coalesce("shift", F.lit(0.0))
    return F.col("close") * F.exp(shift) if adjust == "ratio" else F.col("close") + shift


def continuous(sessions: DataFrame, active: DataFrame, rolls: DataFrame, adjust: str = "none", *, asof: str | None = None, forward: bool = False) -> DataFrame:
    """(product, session_date, contract, close, adjusted) of the front contract in each session.

    ``panama`` adds the offsets, ``ratio`` multiplies by the ratios, of all later rolls (``forward``: takes off those of
    earlier ones, so that history never changes). With ``asof``, neither rolls nor sessions after that date exist. As the
    front contract never goes back, a contract has one shift.
    """
    if asof is not None:
        active = active.filter(F.col("session_date") <= asof)
    d = join_on(active.select("product", "session_date", "contract"), sessions.select("product", "session_date", "contract", "close"), ["product", "session_date", "contract"])
    d = join_on(d, epochs(rolls, adjust, asof=asof, forward=forward).select("product", "contract", "shift"), ["product", "contract"], "left")
    return d.select("product", "session_date", "contract", "close", _shifted(adjust).alias("adjusted"))


def intraday(bars: DataFrame, rolls: DataFrame, adjust: str = "none", *, ts: str = "ts_event", opens: str = "INTERVAL 0 HOURS", asof: str | None = None, forward: bool = False) -> DataFrame:
    """(product, ts, contract, close, adjusted): the bars of the contract that is the front one at their time, adjusted as by
    continuous().

    Bars of any width are merged with the rolls in order of time; a roll takes effect at its session's date plus ``opens``.
    Bars of products without rolls don't occur; with ``asof``, neither rolls nor bars after the end of that date exist.
    """
    kind = bars.schema[ts].dataType
    spans = epochs(rolls, adjust, asof=asof, forward=forward)
    since = F.coalesce(F.col("since").cast("timestamp_ntz") + F.expr(opens), F.lit("0001-01-01").cast("timestamp_ntz")).cast(kind)
    spans = spans.select("product", since.alias(ts), F.col("contract").alias("front"), "shift")
    if asof is not None:
        bars = bars.filter(F.to_date(ts) <= asof)
    d = asof_join(bars.select("product", ts, "contract", "close"), spans, ts, ["product"]).filter(F.col("contract") == F.col("front"))
    return d.select("product", ts, "contract", "close", _shifted(adjust).alias("adjusted"))


def mask_roll_days(z: DataFrame, rolls: DataFrame, *, name: str = "z", order_col: str = "session_date") -> DataFrame:
    """z as null on roll sessions, so that positions hold there."""
    days = rolls.select(F.col("roll_session_date").alias(order_col), F.lit(True).alias("_roll")).distinct()
    return z.join(days, order_col, "left").withColumn(name, F.when(F.col("_roll").isNull(), F.col(name))).drop("_roll")


def contract_pnl(held: DataFrame, sessions: DataFrame, contracts: DataFrame, roll_cost: float = 0.0) -> DataFrame:
    """held(product, session_date, contract, position) to pnl: position before x change of the contract's own close x
    multiplier, less ``roll_cost`` a unit where a held position changes contract."""
    d = held.join(sessions.select("product", "session_date", "contract", "close"), ["product", "session_date", "contract"])
    own = windowed(with_index(sessions.select("product", "contract", "session_date", F.col("close").alias("c")), "session_date", ["product", "contract"]), {"before": lambda w: F.lag("c").over(w)}, 1, ["product", "contract"])
    d = d.join(own.select("product", "contract", "session_date", "before"), ["product", "contract", "session_date"])
    d = windowed(with_index(d, "session_date", ["product"]), {"was": lambda w: F.lag("position").over(w), "old": lambda w: F.lag("contract").over(w)}, 1, ["product"])
    d = d.join(contracts.select("product", "contract", "multiplier_usd"), ["product", "contract"])
    rolled = F.when(F.col("old") != F.col("contract"), F.abs(F.coalesce("was", F.lit(0.0)))).otherwise(0.0)
    pnl = F.coalesce(F.col("was") * (F.col("close") - F.col("before")), F.lit(0.0)) * F.col("multiplier_usd") - roll_cost * rolled
    return d.select("product", "session_date", "contract", "position", pnl.alias("pnl")).drop(INDEX)


def fit_by_epoch(df: DataFrame, y: str, x: str, epoch: str = "contract") -> DataFrame:
    """Hedge ratio of each contract's own stretch."""
    return df.groupBy(epoch).agg(F.regr_intercept(y, x).alias("alpha"), F.regr_slope(y, x).alias("beta"), F.regr_r2(y, x).alias("r_squared"), F.regr_count(y, x).alias("n"))


def half_spread(quotes: DataFrame, keys: Sequence[str] = ("product",)) -> DataFrame:
    """Mean half spread of quotes(bid, ask) with a positive spread."""
    return quotes.groupBy(*keys).agg(F.avg(F.when(F.col("ask") > F.col("bid"), (F.col("ask") - F.col("bid")) / 2)).alias("half_spread"), F.count("*").alias("n"))


def check_rolls(rolls: DataFrame, contracts: DataFrame, first_roll_days: int = 10) -> DataFrame:
    """Rolls outside of the guard (too early, or after the Monday of the expiry week), or without prices on both sides."""
    d = rolls.join(contracts.select("product", F.col("contract").alias("from_contract"), "last_trade_date"), ["product", "from_contract"])
    early, late = F.col("roll_session_date") < business_days_before(first_roll_days), F.col("roll_session_date") > monday_of()
    return d.filter(early | late | F.col("panama_offset").isNull())


def broken_steps(series: DataFrame, adjust: str = "panama", tolerance: float = 1e-6) -> DataFrame:
    """Sessions of continuous() on which the adjusted price moves otherwise than the contract's own, although the contract
    is the one of the session before: differences for ``panama``, differences of logarithms for ``ratio``."""
    of = (lambda c: F.log(c)) if adjust == "ratio" else (lambda c: F.col(c))
    step = lambda c: lambda w: of(c) - F.lag(of(c)).over(w)
    d = windowed(with_index(series, "session_date", ["product"]), {"own": step("close"), "moved": step("adjusted"), "was": lambda w: F.lag("contract").over(w)}, 1, ["product"])
    return d.filter((F.col("was") == F.col("contract")) & (F.abs(F.col("own") - F.col("moved")) > tolerance)).drop(INDEX, "was")


def gap_accounts(series: DataFrame, rolls: DataFrame, adjust: str = "panama", tolerance: float = 1e-6) -> DataFrame:
    """Products of a continuous() series (not ``forward``) whose first bar is shifted by something else than all rolls' gaps:
    (product, shifted, gaps), sums for ``panama`` and logarithms for ``ratio``."""
    first = series.groupBy("product").agg(F.min_by(F.struct("close", "adjusted"), "session_date").alias("f"))
    step, shifted = (F.log("ratio_factor"), F.log("f.adjusted") - F.log("f.close")) if adjust == "ratio" else (F.col("panama_offset"), F.col("f.adjusted") - F.col("f.close"))
    gaps = rolls.groupBy("product").agg(F.sum(step).alias("gaps"))
    d = join_on(first, gaps, ["product"], "left").select("product", shifted.alias("shifted"), F.coalesce("gaps", F.lit(0.0)).alias("gaps"))
    return d.filter(F.abs(F.col("shifted") - F.col("gaps")) > tolerance)


def look_ahead(sessions: DataFrame, contracts: DataFrame, asof: str, rule: str = "v", **how) -> DataFrame:
    """Sessions up to ``asof`` whose front contract would have been another one had later sessions not been there:
    (product, session_date, contract, then). A rule that looks only back gives none."""
    now = active_contracts(sessions, contracts, rule, **how).filter(F.col("session_date") <= asof)
    then = active_contracts(sessions.filter(F.col("session_date") <= asof), contracts, rule, **how).select("product", "session_date", F.col("contract").alias("then"))
    d = join_on(now.select("product", "session_date", "contract"), then, ["product", "session_date"], "left")
    return d.filter(~F.col("contract").eqNullSafe(F.col("then")))


def phantom_pnl(series: DataFrame, sessions: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Sessions on which holding one unit of a ``panama`` series earns other than the contract it stands for did:
    (product, session_date, contract, moved, earned). Sessions in which that contract has no close before are left out."""
    own = windowed(with_index(sessions.select("product", "contract", "session_date", "close"), "session_date", ["product", "contract"]), {"earned": lambda w: F.col("close") - F.lag("close").over(w), "before": lambda w: F.lag("session_date").over(w)}, 1, ["product", "contract"])
    d = windowed(with_index(series, "session_date", ["product"]), {"moved": lambda w: F.col("adjusted") - F.lag("adjusted").over(w), "_before": lambda w: F.lag("session_date").over(w)}, 1, ["product"])
    d = join_on(d.select("product", "session_date", "contract", "moved", "_before"), own.select("product", "session_date", "contract", "earned", "before"), ["product", "session_date", "contract"])
    return d.filter((F.col("before") == F.col("_before")) & (F.abs(F.col("moved") - F.col("earned")) > tolerance)).drop("before", "_before")
