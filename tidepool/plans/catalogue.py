"""All queries of the library over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import unitroot as ur
from ..functions.ordered import INDEX, shared_folder, staged
from ..operators import backtest as bt
from ..operators import clean, continuous, unitroot
from ..operators.hedge import estimate_hedge_ratio, hedge_table, rolling_hedge_ratio
from ..operators.ou import OUParams, ou_table, simulate_ou
from ..operators.signals import generate_signals
from ..operators.spread import compute_spread, compute_spread_aligned, zscore
from ..operators.unitroot import adf_test, dickey_fuller, engle_granger
from ..sources import bars
from ..sources.prices import generate_synthetic_pair, normalise_panel, pivot_panel
from ..streaming.live import live_signals
from . import panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ENTRY, EXIT, STOP = 2.0, 0.5, 4.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def rounded_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """To 4 digits. Means of a few prices in cents often end in an exact 5 there, so all are moved off such ties first."""
    return df.withColumns({c: F.round(F.col(c) + 1e-6, 4) for c in cols})


def mean_sql(column: str) -> str:
    return f"round({column} + CAST(1e-6 AS DOUBLE), 4)"


def one_row(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))


# ---- SQL building blocks

RAW = """raw AS (
  SELECT * FROM (SELECT CAST(l_shipdate AS DATE) AS ts, avg(l_extendedprice) FILTER (l_returnflag = 'A') AS a,
    avg(l_extendedprice) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) WHERE a IS NOT NULL OR r IS NOT NULL)"""
PAIR = RAW + """,
fil AS (SELECT ts, last_value(a IGNORE NULLS) OVER f AS a, last_value(r IGNORE NULLS) OVER f AS r FROM raw
  WINDOW f AS (ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
cl AS (SELECT * FROM fil WHERE a IS NOT NULL AND r IS NOT NULL),
st AS (SELECT avg(a) AS ma, stddev_samp(a) AS sa, avg(r) AS mr, stddev_samp(r) AS sr FROM cl),
zz AS (SELECT ts, (a - ma) / sa AS za, (r - mr) / sr AS zr FROM cl, st),
wk AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i,
    CAST(0.05 AS DOUBLE) * avg(za) OVER (ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS e,
    sum(zr) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS walk FROM zz),
xx AS (SELECT ts, i, e, ln(CAST(100 AS DOUBLE)) + CAST(0.01 AS DOUBLE) * walk AS x FROM wk),
pair AS (SELECT ts, i, x, 2 + CAST(1.3 AS DOUBLE) * x + e AS y FROM xx)"""
CUT = "cut AS (SELECT CAST(floor(CAST(0.7 AS DOUBLE) * count(*)) AS BIGINT) AS k FROM pair)"
WALK = PAIR + ",\n" + CUT + """,
h AS (SELECT regr_intercept(y, x) AS alpha, regr_slope(y, x) AS beta, regr_r2(y, x) AS r2 FROM pair, cut WHERE i < k),
s AS (SELECT ts, i, y - alpha - beta * x AS spread FROM pair, h)"""
ZROLL = """z AS (SELECT ts, i, spread, CASE WHEN i >= 59 THEN (spread - avg(spread) OVER f) / nullif(stddev_samp(spread) OVER f, 0) END AS z FROM s
  WINDOW f AS (ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"""


def positions_sql(source: str, part: str = "", order: str = "ts", entry=ENTRY, exit_=EXIT, stop=STOP) -> str:
    p = f"PARTITION BY {part} " if part else ""
    q = f"{part}, " if part else ""
    halt = f"max(CASE WHEN abs(z) > {stop} THEN 1 ELSE 0 END) OVER w" if stop is not None else "0"
    return f"""g AS (SELECT *, sum(CASE WHEN abs(z) < {exit_} THEN 1 ELSE 0 END) OVER ({p}ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS seg FROM {source}),
pos AS (SELECT *, CASE WHEN {halt} = 1 THEN 0 ELSE coalesce(first_value(CASE WHEN z > {entry} THEN -1 WHEN z < -{entry} THEN 1 END IGNORE NULLS) OVER w, 0) END AS position
  FROM g WINDOW w AS (PARTITION BY {q}seg ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def backtest_sql(source: str, lag: int = 1, cost: float = 0.0) -> str:
    return f"""b0 AS (SELECT ts, spread, position, spread - lag(spread) OVER o AS ds, lag(position, {lag}) OVER o AS held, coalesce(lag(position) OVER o, 0) AS prev
  FROM {source} WINDOW o AS (ORDER BY ts)),
b1 AS (SELECT *, coalesce(coalesce(held, 0) * ds, 0) - {cost}::DOUBLE * abs(position - prev) AS pnl, CASE WHEN position <> prev AND position <> 0 THEN 1 ELSE 0 END AS is_trade FROM b0),
b2 AS (SELECT *, sum(pnl) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM b1)"""


METRICS = """m0 AS (SELECT *, max(equity) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM b2)
SELECT round(coalesce(sum(pnl), 0), 6) AS total_pnl, round(CASE WHEN stddev_samp(pnl) > 0 THEN avg(pnl) / stddev_samp(pnl) * sqrt(CAST(252 AS DOUBLE)) ELSE 0 END, 6) AS sharpe,
  round(coalesce(max(peak - equity), 0), 6) AS max_drawdown, round(coalesce(avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE WHEN pnl < 0 THEN 0.0::DOUBLE END), 0), 6) AS hit_rate,
  count(*) AS n_periods, CAST(coalesce(sum(is_trade), 0) AS BIGINT) AS trades FROM m0"""


# ---- panels and cleaning


@query(f'WITH {RAW} SELECT ts, {mean_sql("a")} AS "A", {mean_sql("r")} AS "R" FROM raw')
def panel_pivot(spark, sf):
    bars = panel.long_bars(spark, sf)
    wide = pivot_panel(bars, {"A": "A", "R": "R"}, time="ts")
    return rounded_means(wide.withColumn("ts", F.col("ts").cast("date")), ["A", "R"])


@query(f"WITH {RAW} SELECT CAST(ts AS DATE) AS ts, {mean_sql('a')} AS left_leg, CAST(NULL AS DOUBLE) AS nothing, {mean_sql('r')} AS right_leg FROM raw")
def project_missing(spark, sf):
    return rounded_means(normalise_panel(panel.raw_panel(spark, sf), {"left_leg": "a", "nothing": "absent", "right_leg": "r"}), ["left_leg", "right_leg"])


TICKS = "t AS (SELECT CAST(l_shipdate AS DATE) AS ts, l_orderkey * 10 + l_linenumber AS seq, l_extendedprice AS price, l_quantity AS qty FROM lineitem)"


def _ticks(spark, sf):
    t = panel.read(spark, sf, "lineitem")
    return t.select(F.col("l_shipdate").cast("date").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"))


FIRST = TICKS + ", u AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY ts ORDER BY seq) = 1)"


@query(f"WITH {FIRST} SELECT ts, seq, price, qty FROM u")
def dedup_first(spark, sf):
    return clean.dedup_first(_ticks(spark, sf), seq_col="seq")


@query(f"WITH {TICKS} SELECT ts, seq, CASE WHEN price > 20000 THEN price END AS price, CASE WHEN qty > 20000 THEN qty END AS qty FROM t")
def mask_price(spark, sf):
    return clean.mask_prices(_ticks(spark, sf), ["price", "qty"], 20000.0)


MASKED = FIRST + ", v AS (SELECT ts, CASE WHEN price > 20 THEN price END AS price, CASE WHEN qty > 20 THEN qty END AS qty FROM u)"
FILLED = MASKED + """, f AS (SELECT ts, last_value(price IGNORE NULLS) OVER w AS price, last_value(qty IGNORE NULLS) OVER w AS qty FROM v
  WINDOW w AS (ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {FILLED} SELECT ts, price, qty FROM f")
def ffill_limit(spark, sf):
    d = clean.mask_prices(clean.dedup_first(_ticks(spark, sf), seq_col="seq").drop("seq"), ["price", "qty"], 20.0)
    return clean.forward_fill(d, ["price", "qty"], 2).drop(INDEX)


@query(f"WITH {FILLED} SELECT ts, price, qty FROM f WHERE price IS NOT NULL AND qty IS NOT NULL")
def align_and_clean(spark, sf):
    return clean.align_and_clean(_ticks(spark, sf), min_price=20.0, seq_col="seq")


@query(f"WITH {PAIR} SELECT ts, round(y, 6) AS y, round(x, 6) AS x FROM pair")
def synthetic_panel(spark, sf):
    return rounded(panel.pair(spark, sf).select("ts", "y", "x"), ["y", "x"])


@query(f"WITH {RAW} SELECT ts, round(CASE WHEN a > 0 THEN ln(a) END, 6) AS a, round(CASE WHEN r > 0 THEN ln(r) END, 6) AS r FROM raw")
def log_prices(spark, sf):
    return rounded(clean.log_prices(panel.raw_panel(spark, sf)), ["a", "r"])


# ---- spreads


@query(f"WITH {PAIR} SELECT ts, round(y - CAST(2 AS DOUBLE) - CAST(1.25 AS DOUBLE) * x, 6) AS spread FROM pair")
def spread(spark, sf):
    return rounded(compute_spread(panel.pair(spark, sf), beta=1.25, alpha=2.0).select("ts", "spread"), ["spread"])


@query(f"""WITH {RAW} SELECT coalesce(p.ts, q.ts) AS ts, round(p.a - 1 - CAST(0.5 AS DOUBLE) * q.r, 6) AS spread
FROM (SELECT ts, a FROM raw WHERE a > 30000) p FULL JOIN (SELECT ts, r FROM raw WHERE r > 30000) q ON p.ts = q.ts""")
def spread_aligned(spark, sf):
    d = panel.raw_panel(spark, sf)
    left, right = d.filter("a > 30000").select("ts", F.col("a").alias("value")), d.filter("r > 30000").select("ts", F.col("r").alias("value"))
    return rounded(compute_spread_aligned(left, right, 0.5, 1.0), ["spread"])


@query(f"WITH {WALK} SELECT ts, round((spread - avg(spread) OVER ()) / stddev_samp(spread) OVER (), 6) AS z FROM s")
def zscore_full(spark, sf):
    return rounded(zscore(_spread(spark, sf)).select("ts", "z"), ["z"])


@query(f"WITH {WALK}, {ZROLL} SELECT ts, round(z, 6) AS z FROM z")
def zscore_rolling(spark, sf):
    d, n = _counted_spread(spark, sf)
    return rounded(zscore(d, 60, rows=n).select("ts", "z"), ["z"])


def _spread(spark, sf) -> DataFrame:
    """ts, y, x and the spread by the hedge ratio of the first 70 % of rows."""
    return _counted_spread(spark, sf)[0]


def _counted_spread(spark, sf) -> tuple[DataFrame, int]:
    d = panel.pair(spark, sf)
    n = d.count()
    h = estimate_hedge_ratio(d.filter(F.col(INDEX) < int(n * 0.7)))
    return compute_spread(d, beta=h.beta, alpha=h.alpha), n


# ---- hedge ratios


@query(f"WITH {PAIR} SELECT round(regr_intercept(y, x), 6) AS alpha, round(regr_slope(y, x), 6) AS beta, round(regr_r2(y, x), 6) AS r_squared FROM pair")
def hedge_ols(spark, sf):
    return rounded(hedge_table(panel.pair(spark, sf)), ["alpha", "beta", "r_squared"])


@query(f"""WITH {PAIR}, m AS (SELECT var_samp(y) AS syy, var_samp(x) AS sxx, covar_samp(y, x) AS sxy, avg(y) AS my, avg(x) AS mx FROM pair),
b AS (SELECT *, (syy - sxx + sqrt((syy - sxx) * (syy - sxx) + 4 * sxy * sxy)) / (2 * sxy) AS beta FROM m)
SELECT round(my - beta * mx, 6) AS alpha, round(beta, 6) AS beta, round(1 - (syy - 2 * beta * sxy + beta * beta * sxx) / syy, 6) AS r_squared FROM b""")
def hedge_tls(spark, sf):
    return rounded(hedge_table(panel.pair(spark, sf), method="tls"), ["alpha", "beta", "r_squared"])


@query(f"WITH {PAIR}, h AS (SELECT regr_intercept(y, x) AS alpha, regr_slope(y, x) AS beta FROM pair) SELECT ts, round(y - alpha - beta * x, 6) AS residual FROM pair, h")
def hedge_residuals(spark, sf):
    return rounded(estimate_hedge_ratio(panel.pair(spark, sf)).residuals.select("ts", "residual"), ["residual"])


@query(f"""WITH {PAIR}, b AS (SELECT *, CASE WHEN i >= 249 THEN covar_samp(y, x) OVER f / nullif(var_samp(x) OVER f, 0) END AS beta, avg(y) OVER f AS my, avg(x) OVER f AS mx FROM pair
  WINDOW f AS (ORDER BY ts ROWS BETWEEN 249 PRECEDING AND CURRENT ROW)) SELECT ts, round(my - beta * mx, 5) AS alpha, round(beta, 5) AS beta FROM b""")
def rolling_hedge(spark, sf):
    return rounded(rolling_hedge_ratio(panel.pair(spark, sf), 250).select("ts", "alpha", "beta"), ["alpha", "beta"], 5)


# ---- mean reversion


@query(f"""WITH {WALK}, l AS (SELECT spread AS x1, lag(spread) OVER (ORDER BY ts) AS x0 FROM s),
f AS (SELECT regr_slope(x1, x0) AS b, regr_intercept(x1, x0) AS a, regr_sxx(x1, x0) AS sxx, regr_syy(x1, x0) AS syy, regr_sxy(x1, x0) AS sxy, regr_count(x1, x0) AS m, count(*) AS n_obs FROM l),
p AS (SELECT *, -ln(b) AS theta, sqrt((syy - sxy * sxy / sxx) / (m - 1)) * sqrt(-2 * ln(b) / (1 - b * b)) AS sigma FROM f)
SELECT round(theta, 6) AS theta, round(a / (1 - b), 6) AS mu, round(sigma, 6) AS sigma, round(ln(CAST(2 AS DOUBLE)) / theta, 6) AS half_life, round(sigma / sqrt(2 * theta), 6) AS stationary_std, round(b, 6) AS b, n_obs FROM p""")
def ou_fit(spark, sf):
    d, n = _counted_spread(spark, sf)
    return rounded(ou_table(d, rows=n), ["theta", "mu", "sigma", "half_life", "stationary_std", "b"])


@query()
def ou_simulate(spark, sf):
    return simulate_ou(spark, OUParams(0.2, 0.0, 1.0, 1.0), 2000, seed=0, paths=4)


@query()
def synthetic_pair(spark, sf):
    return generate_synthetic_pair(spark, pairs=4)


# ---- signals


@query(f"WITH {WALK}, {ZROLL}, {positions_sql('z')} SELECT ts, CAST(position AS INTEGER) AS position FROM pos")
def signals(spark, sf):
    d, n = _counted_spread(spark, sf)
    return generate_signals(zscore(d, 60, rows=n), rows=n).select("ts", "position")


@query(f"WITH {WALK}, {ZROLL}, {positions_sql('z', stop=None, entry=1.5)} SELECT ts, CAST(position AS INTEGER) AS position FROM pos")
def signals_nostop(spark, sf):
    return generate_signals(zscore(_spread(spark, sf), 60), entry=1.5, stop=None).select("ts", "position")


@query(f"""WITH RECURSIVE {WALK}, {ZROLL.replace('z AS (', 'z AS MATERIALIZED (', 1)},
st0(i, state) AS (SELECT CAST(-1 AS BIGINT), 0 UNION ALL
  SELECT z.i, CASE WHEN z.z IS NULL THEN state WHEN state = 9 AND abs(z.z) >= 1.5 THEN 9 WHEN abs(z.z) > 3 THEN 9
    WHEN state IN (0, 9) THEN CASE WHEN z.z > 1 THEN -1 WHEN z.z < -1 THEN 1 ELSE 0 END
    WHEN abs(z.z) < 1.5 THEN 0 ELSE state END
  FROM st0 JOIN z ON z.i = st0.i + 1)
SELECT ts, CASE WHEN state = 9 THEN 0 ELSE state END AS position FROM st0 JOIN z USING (i)""")
def signals_fold(spark, sf):
    return generate_signals(zscore(_spread(spark, sf), 60), 1.0, 1.5, 3.0).select("ts", "position")


EVENTS = "s AS (SELECT event_type, ts, value AS spread FROM events)"
ZMANY = """z AS (SELECT event_type, ts, spread, CASE WHEN count(spread) OVER f = 20 THEN (spread - avg(spread) OVER f) / nullif(stddev_samp(spread) OVER f, 0) END AS z FROM s
  WINDOW f AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {EVENTS}, {ZMANY}, {positions_sql('z', 'event_type', entry=1.5, stop=2.5)} SELECT event_type, ts, round(z, 6) AS z, CAST(position AS INTEGER) AS position FROM pos")
def signals_many(spark, sf):
    d = panel.read(spark, sf, "events").select("event_type", "ts", F.col("value").alias("spread"))
    z = zscore(d, 20, partition_cols=["event_type"])
    return rounded(generate_signals(z, 1.5, 0.5, 2.5, partition_cols=["event_type"]).select("event_type", "ts", "z", "position"), ["z"])


@query(f"WITH {EVENTS}, {ZMANY}, {positions_sql('z', 'event_type', entry=1.5, stop=2.5)} SELECT event_type, ts, round(z, 6) AS z, CAST(position AS INTEGER) AS position FROM pos")
def live_signals_many(spark, sf):
    """As signals_many, by a stream over the events into a table, until all that there is has been read."""
    source = panel.read(spark, sf, "events").select("event_type", "ts", F.col("value").alias("spread"))
    folder = shared_folder(spark)
    # a pattern, as Spark takes the table itself, one file or a folder, only so
    stream = spark.readStream.schema(panel.read(spark, sf, "events").schema).parquet(f"{sf}/[e]vents.parquet").select("event_type", F.to_timestamp("ts").alias("ts"), F.col("value").alias("spread"))
    found = live_signals(stream, 20, 1.5, 0.5, 2.5, keys=["event_type"], late="0 seconds")
    q = found.writeStream.format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{folder}/table").select("event_type", F.col("ts").cast(source.schema["ts"].dataType).alias("ts"), "z", "position")
    return rounded(out, ["z"])


# ---- backtests

BASE = f"WITH {WALK}, {ZROLL}, {positions_sql('z')}"


def _signals(spark, sf):
    d, n = _counted_spread(spark, sf)
    return staged(generate_signals(zscore(d, 60, rows=n), rows=n).select("ts", "spread", "position", INDEX)), n


@query(f"{BASE}, {backtest_sql('pos', cost=0.001)} SELECT ts, CAST(position AS DOUBLE) AS position, CASE WHEN abs(pnl) < 5e-7 THEN 0 ELSE round(pnl, 6) END AS pnl, CASE WHEN abs(equity) < 5e-7 THEN 0 ELSE round(equity, 6) END AS equity, is_trade FROM b2")
def backtest_pnl(spark, sf):
    d, n = _signals(spark, sf)
    return rounded(bt.backtest_spread(d, cost_per_unit=0.001, rows=n).table.select("ts", "position", "pnl", "equity", "is_trade"), ["pnl", "equity"])


@query(f"{BASE}, {backtest_sql('pos', lag=0)} SELECT ts, CAST(position AS DOUBLE) AS position, CASE WHEN abs(pnl) < 5e-7 THEN 0 ELSE round(pnl, 6) END AS pnl, CASE WHEN abs(equity) < 5e-7 THEN 0 ELSE round(equity, 6) END AS equity, is_trade FROM b2")
def backtest_lag0(spark, sf):
    d, n = _signals(spark, sf)
    return rounded(bt.backtest_spread(d, lag=0, rows=n).table.select("ts", "position", "pnl", "equity", "is_trade"), ["pnl", "equity"])


@query(f"{BASE}, {backtest_sql('pos', cost=0.001)}, {METRICS}")
def metrics(spark, sf):
    d, n = _signals(spark, sf)
    return _with_trades(bt.backtest_table(d, 0.001, rows=n), n)


def _with_trades(table: DataFrame, rows: int | None) -> DataFrame:
    out = bt.performance_metrics(table, equity="equity", trades="is_trade", rows=rows)
    return rounded(out, ["total_pnl", "sharpe", "max_drawdown", "hit_rate"])


@query(f"""WITH {RAW}, n AS (SELECT CAST(floor(count(*) * CAST(0.7 AS DOUBLE)) AS BIGINT) AS k FROM raw), d AS (SELECT ts AS start FROM (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM raw), n WHERE i = k)
SELECT CASE WHEN ts < start THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(ts) AS first, max(ts) AS last FROM raw, d GROUP BY 1""")
def split_fraction(spark, sf):
    return _parts(*bt.train_test_split_by_date(panel.raw_panel(spark, sf), 0.7))


@query(f"WITH {RAW} SELECT CASE WHEN ts < DATE '1995-06-01' THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(ts) AS first, max(ts) AS last FROM raw GROUP BY 1")
def split_date(spark, sf):
    return _parts(*bt.train_test_split_by_date(panel.raw_panel(spark, sf), "1995-06-01"))


def _parts(train: DataFrame, test: DataFrame) -> DataFrame:
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


TEST = "tst AS (SELECT pos.* FROM pos, cut WHERE i >= k)"


@query(f"{BASE}, {TEST}, {backtest_sql('tst', cost=0.001)} SELECT ts, CAST(position AS DOUBLE) AS position, CASE WHEN abs(pnl) < 5e-7 THEN 0 ELSE round(pnl, 6) END AS pnl, CASE WHEN abs(equity) < 5e-7 THEN 0 ELSE round(equity, 6) END AS equity FROM b2")
def walk_forward_test(spark, sf):
    r = bt.walk_forward_backtest(panel.pair(spark, sf).select("ts", "ES", "NQ", INDEX), cost_per_unit=0.001)
    return rounded(r["test"].table.select("ts", "position", "pnl", "equity"), ["pnl", "equity"])


@query(f"{BASE}, {TEST}, {backtest_sql('tst')}, {METRICS}")
def walk_forward_metrics(spark, sf):
    r = bt.walk_forward_backtest(panel.pair(spark, sf).select("ts", "ES", "NQ", INDEX))
    return _with_trades(r["test"].table, r["test"].rows)


@query(f"{BASE}, trn AS (SELECT pos.* FROM pos, cut WHERE i < k), {backtest_sql('trn')}, {METRICS}")
def walk_forward_train_metrics(spark, sf):
    r = bt.walk_forward_backtest(panel.pair(spark, sf).select("ts", "ES", "NQ", INDEX))
    return _with_trades(r["train"].table, r["train"].rows)


MANY = """fl AS (SELECT CAST(l_shipdate AS DATE) AS ts, l_returnflag AS flag, avg(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2),
li AS (SELECT CAST(l_shipdate AS DATE) AS ts, CAST(l_linenumber AS BIGINT) AS line, avg(l_extendedprice) AS x FROM lineitem GROUP BY 1, 2),
pair AS (SELECT flag, line, ts, ln(y) AS y, ln(x) AS x, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY flag, line) AS n FROM fl JOIN li USING (ts) WINDOW w AS (PARTITION BY flag, line ORDER BY ts)),
h AS (SELECT flag, line, regr_intercept(y, x) AS alpha, regr_slope(y, x) AS beta, regr_r2(y, x) AS r2 FROM pair WHERE i < CAST(floor(CAST(0.7 AS DOUBLE) * n) AS BIGINT) GROUP BY 1, 2),
s AS (SELECT flag, line, ts, i, n, y - alpha - beta * x AS spread FROM pair JOIN h USING (flag, line)),
z AS (SELECT *, CASE WHEN i >= 59 THEN (spread - avg(spread) OVER f) / nullif(stddev_samp(spread) OVER f, 0) END AS z FROM s
  WINDOW f AS (PARTITION BY flag, line ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"""
MANY_BACKTEST = f"""WITH {MANY}, {positions_sql('z', 'flag, line')},
c AS (SELECT *, CASE WHEN i < CAST(floor(CAST(0.7 AS DOUBLE) * n) AS BIGINT) THEN 'train' ELSE 'test' END AS part FROM pos),
b0 AS (SELECT *, spread - lag(spread) OVER o AS ds, lag(position) OVER o AS held, coalesce(lag(position) OVER o, 0) AS prev FROM c WINDOW o AS (PARTITION BY flag, line, part ORDER BY ts)),
b1 AS (SELECT *, coalesce(coalesce(held, 0) * ds, 0) - CAST(0.001 AS DOUBLE) * abs(position - prev) AS pnl, CASE WHEN position <> prev AND position <> 0 THEN 1 ELSE 0 END AS is_trade FROM b0),
b2 AS (SELECT *, sum(pnl) OVER (PARTITION BY flag, line, part ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM b1)"""


def _many(spark, sf):
    return bt.walk_forward_many(panel.many_pairs(spark, sf), ["flag", "line"], cost_per_unit=0.001)


@query(MANY_BACKTEST + METRICS.replace("m0 AS", ", m0 AS", 1).replace("OVER (ORDER BY", "OVER (PARTITION BY flag, line, part ORDER BY").replace("SELECT round", "SELECT flag, line, part, round", 1) + " GROUP BY flag, line, part")
def walk_forward_many(spark, sf):
    return rounded(_many(spark, sf)["metrics"], ["total_pnl", "sharpe", "max_drawdown", "hit_rate"])


@query(f"""WITH {MANY}, l AS (SELECT flag, line, spread AS x1, lag(spread) OVER (PARTITION BY flag, line ORDER BY ts) AS x0 FROM s WHERE i < CAST(floor(CAST(0.7 AS DOUBLE) * n) AS BIGINT)),
f AS (SELECT flag, line, regr_slope(x1, x0) AS b, regr_intercept(x1, x0) AS a, count(*) AS n_obs FROM l GROUP BY 1, 2)
SELECT flag, line, round(h.alpha, 6) AS alpha, round(h.beta, 6) AS beta, round(h.r2, 6) AS r_squared, round(CASE WHEN b > 0 AND b < 1 THEN -ln(b) WHEN b >= 1 THEN 0 END, 6) AS theta, round(CASE WHEN b > 0 AND b < 1 THEN a / (1 - b) END, 6) AS mu, n_obs
FROM f JOIN h USING (flag, line)""")
def fit_many(spark, sf):
    r = _many(spark, sf)
    return rounded(r["hedge"].join(r["ou"], ["flag", "line"]).select("flag", "line", "alpha", "beta", "r_squared", "theta", "mu", "n_obs"), ["alpha", "beta", "r_squared", "theta", "mu"])


# ---- unit roots

# Normal distribution function by its series, and the published polynomials of p-values.
NORMAL = "CASE WHEN x < -8 THEN 0 WHEN x > 8 THEN 1 ELSE CAST(0.5 AS DOUBLE) + exp(-x * x / 2) / sqrt(2 * pi()) * list_reduce(list_transform(range(1, 120), lambda k: CAST(k AS DOUBLE)), lambda s, k: x * (1 + x * s / (2 * (120 - k) + 1)), x / 239) END"


def _p_sql(series: int, trend: str) -> str:
    low, high = ur.valid_range((series, trend))
    poly = lambda c: " + ".join(f"CAST({v!r} AS DOUBLE) * pow(statistic, {i})" for i, v in enumerate(c))
    x = f"CASE WHEN statistic < {low} THEN -99 WHEN statistic > {high} THEN 99 WHEN statistic <= {ur.MEET[series, trend]} THEN {poly(ur.SMALL_P[series, trend])} ELSE {poly(ur.LARGE_P[series, trend])} END"
    return f"SELECT *, round({NORMAL}, 6) AS pvalue FROM (SELECT *, {x} AS x FROM f)"


@query(f"""WITH v AS (SELECT event_type AS product, ts, sum(value - 50) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS v FROM events),
l AS (SELECT product, v - lag(v) OVER w AS dy, lag(v) OVER w AS x FROM v WINDOW w AS (PARTITION BY product ORDER BY ts)),
m AS (SELECT product, regr_slope(dy, x) AS b, regr_syy(dy, x) AS syy, regr_sxy(dy, x) AS sxy, regr_sxx(dy, x) AS sxx, regr_count(dy, x) AS k, count(*) AS n FROM l GROUP BY 1),
f AS (SELECT product, b / sqrt((syy - sxy * sxy / sxx) / (k - 2) / sxx) AS statistic, n FROM m)
SELECT product, round(statistic, 6) AS statistic, pvalue, pvalue < 0.05 AS rejected, n FROM ({_p_sql(1, 'c')})""")
def adf_many(spark, sf):
    found = unitroot.adf_many(panel.walks(spark, sf), ["product"], value="v", maxlag=0, autolag=None)
    return rounded(found.select("product", "statistic", "pvalue", "rejected", "n"), ["statistic", "pvalue"])


@query(f"""WITH {MANY}, w AS (SELECT flag, line, ts, i, sum(y - x) OVER o AS y, sum(x) OVER o AS x FROM (SELECT flag, line, ts, i, y - avg(y) OVER (PARTITION BY flag, line) AS y, x - avg(x) OVER (PARTITION BY flag, line) AS x FROM pair) WINDOW o AS (PARTITION BY flag, line ORDER BY ts ROWS UNBOUNDED PRECEDING)),
g AS (SELECT flag, line, regr_intercept(y, x) AS alpha, regr_slope(y, x) AS beta FROM w GROUP BY 1, 2), u AS (SELECT flag, line, ts, y - alpha - beta * x AS u FROM w JOIN g USING (flag, line)),
l AS (SELECT flag, line, u - lag(u) OVER o AS dy, lag(u) OVER o AS x FROM u WINDOW o AS (PARTITION BY flag, line ORDER BY ts)),
m AS (SELECT flag, line, sum(x * dy) AS xy, sum(x * x) AS xx, sum(dy * dy) AS yy, count(dy) AS k, count(*) AS n FROM (SELECT flag, line, x, dy FROM l WHERE x IS NOT NULL UNION ALL SELECT flag, line, NULL, NULL FROM l WHERE x IS NULL) GROUP BY 1, 2),
f AS (SELECT flag, line, xy / xx / sqrt((yy - xy * xy / xx) / (k - 1) / xx) AS statistic, n FROM m)
SELECT flag, line, round(statistic, 5) AS statistic, pvalue, pvalue < 0.05 AS rejected, n FROM ({_p_sql(2, 'c')})""")
def eg_many(spark, sf):
    found = unitroot.engle_granger_many(panel.many_walks(spark, sf), ["flag", "line"], maxlag=0, autolag=None)
    return rounded(rounded(found.select("flag", "line", "statistic", "pvalue", "rejected", "n"), ["statistic"], 5), ["pvalue"])


@query(f"""WITH {WALK}, l AS (SELECT spread - lag(spread) OVER (ORDER BY ts) AS dy, lag(spread) OVER (ORDER BY ts) AS x FROM s),
f AS (SELECT regr_slope(dy, x) AS b, regr_syy(dy, x) AS syy, regr_sxy(dy, x) AS sxy, regr_sxx(dy, x) AS sxx, regr_count(dy, x) AS n FROM l)
SELECT round(b / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 6) AS statistic FROM f""")
def adf_lag0(spark, sf):
    s = _spread(spark, sf)
    d = s.select(INDEX, (F.col("spread") - s.agg(F.avg("spread")).first()[0]).alias("v"))
    return one_row(spark, statistic=round(dickey_fuller(d, d.count(), True, 0, None)[0], 6))


@query(f"""WITH {PAIR}, h AS (SELECT regr_intercept(y, x) AS alpha, regr_slope(y, x) AS beta FROM pair), s AS (SELECT ts, y - alpha - beta * x AS u FROM pair, h),
l AS (SELECT u - lag(u) OVER (ORDER BY ts) AS dy, lag(u) OVER (ORDER BY ts) AS x FROM s),
f AS (SELECT sum(x * dy) AS xy, sum(x * x) AS xx, sum(dy * dy) AS yy, count(dy) AS n FROM l WHERE x IS NOT NULL)
SELECT round(xy / xx / sqrt((yy - xy * xy / xx) / (n - 1) / xx), 5) AS statistic FROM f""")
def eg_lag0(spark, sf):
    return one_row(spark, statistic=round(engle_granger(panel.pair(spark, sf), maxlag=0, autolag=None).statistic, 5))


@query()
def adf_auto(spark, sf):
    r = adf_test(_spread(spark, sf))
    return one_row(spark, statistic=r["statistic"], pvalue=r["pvalue"], is_stationary=r["is_stationary"], crit_5=r["critical_values"]["5%"])


@query()
def eg_auto(spark, sf):
    r = engle_granger(panel.pair(spark, sf))
    return one_row(spark, statistic=r.statistic, pvalue=r.pvalue, is_cointegrated=r.is_cointegrated, crit_5=r.critical_values["5%"])


# ---- summaries


def _describe_sql(c: str) -> str:
    kinds = {"mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})", "p25": f"quantile_cont({c}, 0.25)", "p50": f"quantile_cont({c}, 0.5)", "p75": f"quantile_cont({c}, 0.75)", "max": f"max({c})"}
    return f"SELECT '{c}' AS \"column\", count({c}) AS count, " + ", ".join(f"{mean_sql(v)} AS {k}" for k, v in kinds.items()) + " FROM raw"


@query(f"WITH {RAW} {_describe_sql('a')} UNION ALL {_describe_sql('r')}")
def describe(spark, sf):
    return rounded_means(bt.describe(panel.raw_panel(spark, sf), ["a", "r"]), ["mean", "std", "min", "p25", "p50", "p75", "max"])


@query(f"WITH {RAW} SELECT ts, {mean_sql('a')} AS a, {mean_sql('r')} AS r FROM raw ORDER BY ts DESC LIMIT 5")
def tail(spark, sf):
    return rounded_means(bt.tail(panel.raw_panel(spark, sf)), ["a", "r"])


# ---- bars and rolls (extensions)

BAR5 = "SELECT event_type AS product, 'X' AS contract, time_bucket(INTERVAL 5 MINUTE, ts) AS ts_event, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume FROM events GROUP BY 1, 3"


@query(BAR5)
def resample_5m(spark, sf):
    return continuous.resample(panel.events(spark, sf))


LOCAL = "SELECT ts AS ts_event, event_type, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS l FROM events"


@query(f"""WITH t AS ({LOCAL}), d AS (SELECT *, CAST(l + INTERVAL 7 HOUR AS DATE) AS day FROM t)
SELECT event_type AS product, ts_event, CAST(day + CASE isodow(day) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS DATE) AS session_date,
  hour(l) * 60 + minute(l) >= 570 AND hour(l) * 60 + minute(l) < 960 AS is_rth FROM d""")
def sessions(spark, sf):
    return continuous.with_sessions(panel.events(spark, sf)).select("product", "ts_event", "session_date", "is_rth")


HOURS = "h AS (SELECT event_type, date_trunc('hour', ts) AS ts_event, arg_max(value, ts) AS close FROM events GROUP BY 1, 2)"


@query(f"WITH {HOURS} SELECT a.ts_event, a.close AS click, b.close AS view FROM h a JOIN h b USING (ts_event) WHERE a.event_type = 'click' AND b.event_type = 'view'")
def leg_join(spark, sf):
    return continuous.legs(continuous.resample(panel.events(spark, sf), "1 hour"), "click", "view")


SESS = "se AS (SELECT CAST(l_shipdate AS DATE) AS session_date, 'C' || l_linenumber AS contract, l_linenumber AS rank, avg(l_extendedprice) AS close, sum(l_quantity) AS volume, count(*) AS open_interest FROM lineitem GROUP BY 1, 2, 3)"
RANKS = """ct AS (SELECT contract, row_number() OVER (ORDER BY contract) AS r, CAST(DATE '1992-06-19' + INTERVAL 1 YEAR * row_number() OVER (ORDER BY contract) AS DATE) AS last FROM (SELECT DISTINCT contract FROM se)),
gd AS (SELECT contract, r, CAST(last - CAST(isodow(last) - 1 AS INTEGER) AS DATE) AS closes,
  CAST(last - CAST(10 + 2 * ((10 + 4 - least(isodow(last) - 1, 4)) // 5) AS INTEGER) AS DATE) AS opens FROM ct),
dy AS (SELECT session_date, coalesce(max(CASE WHEN session_date >= closes THEN r + 1 END), 1) AS low, coalesce(max(CASE WHEN session_date >= opens THEN r + 1 END), 1) AS high, max(r) AS mx
  FROM (SELECT DISTINCT session_date FROM se), gd GROUP BY 1),
be AS (SELECT session_date, r FROM (SELECT session_date, r, row_number() OVER (PARTITION BY session_date ORDER BY volume DESC, r) AS n FROM se JOIN ct USING (contract)) WHERE n = 1),
pr AS (SELECT session_date, least(greatest(coalesce(lag(be.r) OVER (ORDER BY session_date), 1), low), high) AS c, mx FROM be JOIN dy USING (session_date)),
ac AS (SELECT session_date, least(max(c) OVER (ORDER BY session_date ROWS UNBOUNDED PRECEDING), mx) AS r FROM pr),
af AS (SELECT session_date, r, contract FROM ac JOIN ct USING (r))"""
ROLLS = """ch AS (SELECT session_date, contract, lag(contract) OVER (ORDER BY session_date) AS prev, lag(session_date) OVER (ORDER BY session_date) AS decided FROM af),
ro AS (SELECT c.session_date AS roll_session_date, prev AS from_contract, c.contract AS to_contract, t.close - f.close AS panama_offset, t.close / f.close AS ratio_factor
  FROM ch c LEFT JOIN se f ON f.session_date = decided AND f.contract = prev LEFT JOIN se t ON t.session_date = decided AND t.contract = c.contract WHERE prev <> c.contract)"""


def _rolls(spark, sf, rule="v"):
    s = staged(panel.contract_sessions(spark, sf))
    active = staged(continuous.active_contracts(s, panel.contract_list(spark, sf), rule))
    return s, active, staged(continuous.roll_calendar(active, s))  # a handful of rows


@query(f"WITH {SESS}, {RANKS} SELECT session_date, contract, CAST(r AS INTEGER) AS rank FROM af")
def front_contracts(spark, sf):
    return _rolls(spark, sf)[1].select("session_date", "contract", F.col("rank").cast("int").alias("rank"))


FRONT = "SELECT session_date, contract, CAST(r AS INTEGER) AS rank FROM af"
BY_INTEREST = RANKS.replace("ORDER BY volume DESC", "ORDER BY open_interest DESC")


def _dated_ranks(day: str) -> str:
    """As RANKS, by a rule that knows the day of each roll."""
    return RANKS[: RANKS.index("dy AS (")] + f"""af AS (SELECT session_date, r, contract FROM
  (SELECT session_date, least(coalesce(max(CASE WHEN session_date >= {day} THEN r + 1 END), 1), max(r)) AS r FROM (SELECT DISTINCT session_date FROM se), gd JOIN ct USING (contract, r) GROUP BY 1) JOIN ct USING (r))"""


def _front(spark, sf, rule):
    return _rolls(spark, sf, rule)[1].select("session_date", "contract", F.col("rank").cast("int").alias("rank"))


@query(f"WITH {SESS}, {BY_INTEREST} {FRONT}")
def front_by_interest(spark, sf):
    return _front(spark, sf, "n")


@query(f"WITH {SESS}, {_dated_ranks('closes')} {FRONT}")
def front_by_calendar(spark, sf):
    return _front(spark, sf, "c")


@query(f"WITH {SESS}, {_dated_ranks('least(closes, CAST(last - CAST(5 + 2 * ((5 + 4 - least(isodow(last) - 1, 4)) // 5) AS INTEGER) AS DATE))')} {FRONT}")
def front_by_fixed_k(spark, sf):
    return _front(spark, sf, "fixed_k")


@query(f"WITH {SESS}, {RANKS}, {ROLLS} SELECT roll_session_date, from_contract, to_contract, round(panama_offset, 6) AS panama_offset, round(ratio_factor, 6) AS ratio_factor FROM ro")
def roll_calendar(spark, sf):
    return rounded(_rolls(spark, sf)[2].drop("product"), ["panama_offset", "ratio_factor"])


@query(f"WITH {SESS}, {RANKS}, {ROLLS} SELECT year(roll_session_date) || 'Q' || quarter(roll_session_date) AS quarter, max(roll_session_date) AS joint_roll_session_date, count(*) AS n FROM ro GROUP BY 1")
def joint_rolls(spark, sf):
    return continuous.joint_rolls(_rolls(spark, sf)[2])


@query(f"""WITH {SESS}, {RANKS}, {ROLLS} SELECT year(roll_session_date) || 'Q' || quarter(roll_session_date) AS quarter,
  least(greatest(max(roll_session_date), max(opens)), min(closes)) AS joint_roll_session_date, count(*) AS n FROM ro JOIN gd ON from_contract = contract GROUP BY 1""")
def joint_rolls_clipped(spark, sf):
    return continuous.joint_rolls(_rolls(spark, sf)[2], contracts=panel.contract_list(spark, sf))


def _adjusted_sql(kind: str) -> str:
    step, tail_ = ("panama_offset", "f.close + coalesce((SELECT sum(panama_offset) FROM ro WHERE roll_session_date > f.session_date), 0)") if kind == "panama" else ("ratio_factor", "f.close * exp(coalesce((SELECT sum(ln(ratio_factor)) FROM ro WHERE roll_session_date > f.session_date), 0))")
    return f"WITH {SESS}, {RANKS}, {ROLLS}, f AS (SELECT a.session_date, a.contract, s.close FROM af a JOIN se s USING (session_date, contract)) SELECT session_date, contract, {mean_sql('close')} AS close, {mean_sql(tail_)} AS adjusted FROM f"


def _adjusted(spark, sf, kind):
    return rounded_means(continuous.continuous(*_rolls(spark, sf), kind).drop("product"), ["close", "adjusted"])


@query(_adjusted_sql("panama"))
def panama(spark, sf):
    return _adjusted(spark, sf, "panama")


@query(_adjusted_sql("ratio"))
def ratio(spark, sf):
    return _adjusted(spark, sf, "ratio")


@query(f"WITH {SESS}, {RANKS} SELECT session_date, contract, {mean_sql('s.close')} AS close, {mean_sql('s.close')} AS adjusted FROM af a JOIN se s USING (session_date, contract)")
def unadjusted(spark, sf):
    return _adjusted(spark, sf, "none")


ASOF = "1995-03-31"
FRONT_CLOSE = "f AS (SELECT a.session_date, a.contract, s.close FROM af a JOIN se s USING (session_date, contract))"


@query(f"""WITH {SESS}, {RANKS}, {ROLLS}, {FRONT_CLOSE} SELECT session_date, contract, {mean_sql('close')} AS close,
  {mean_sql(f"f.close + coalesce((SELECT sum(panama_offset) FROM ro WHERE roll_session_date > f.session_date AND roll_session_date <= DATE '{ASOF}'), 0)")} AS adjusted
  FROM f WHERE session_date <= DATE '{ASOF}'""")
def panama_asof(spark, sf):
    return rounded_means(continuous.continuous(*_rolls(spark, sf), "panama", asof=ASOF).drop("product"), ["close", "adjusted"])


@query(f"""WITH {SESS}, {RANKS}, {ROLLS}, {FRONT_CLOSE} SELECT session_date, contract, {mean_sql('close')} AS close,
  {mean_sql('f.close - coalesce((SELECT sum(panama_offset) FROM ro WHERE roll_session_date <= f.session_date), 0)')} AS adjusted FROM f""")
def panama_forward(spark, sf):
    return rounded_means(continuous.continuous(*_rolls(spark, sf), "panama", forward=True).drop("product"), ["close", "adjusted"])


TYPES = """tk AS (SELECT 'P' AS product, event_type AS contract, ts, value FROM events),
hb AS (SELECT contract, time_bucket(INTERVAL 1 HOUR, ts) AS ts_event, arg_max(value, ts) AS close FROM tk GROUP BY 1, 2),
se AS (SELECT CAST(ts AS DATE) AS session_date, contract, arg_max(value, ts) AS close, count(*) AS volume FROM tk GROUP BY 1, 2)"""
TYPE_RANKS = RANKS.replace("DATE '1992-06-19' + INTERVAL 1 YEAR", "DATE '2024-01-04' + INTERVAL 6 DAY")


@query(f"""WITH {TYPES}, {TYPE_RANKS}, {ROLLS}, fr AS (SELECT contract AS front, min(session_date) AS since, max(r) AS r FROM af GROUP BY 1),
ep AS (SELECT front, CASE WHEN since = (SELECT min(since) FROM fr) THEN DATE '0001-01-01' ELSE since END AS since,
  lead(since) OVER (ORDER BY r) AS until, coalesce((SELECT sum(panama_offset) FROM ro WHERE roll_session_date > since), 0) AS shift FROM fr)
SELECT hb.contract, ts_event, round(close, 6) AS close, round(close + shift, 6) AS adjusted FROM hb JOIN ep ON contract = front AND ts_event >= since AND (until IS NULL OR ts_event < until)""")
def panama_intraday(spark, sf):
    ticks = panel.read(spark, sf, "events").select(F.lit("P").alias("product"), F.col("event_type").alias("contract"), F.col("ts").alias("ts_event"), *[F.col("value").alias(c) for c in ("open", "high", "low", "close")], F.lit(1).cast("long").alias("volume"))
    hours = continuous.resample(ticks, "1 hour")
    sessions_ = staged(continuous.daily(ticks.withColumn("session_date", F.to_date("ts_event"))))
    contracts = panel.numbered(ticks.select("contract").distinct(), "DATE'2024-01-04'", "INTERVAL 6 DAYS")
    active = staged(continuous.active_contracts(sessions_, contracts))
    rolls = staged(continuous.roll_calendar(active, sessions_))
    return rounded(continuous.intraday(hours, rolls, "panama").select("contract", "ts_event", "close", "adjusted"), ["close", "adjusted"])


@query(f"""WITH {SESS}, {RANKS}, {ROLLS}, {FRONT_CLOSE} SELECT session_date,
  CASE WHEN session_date NOT IN (SELECT roll_session_date FROM ro) THEN {mean_sql('close')} END AS z FROM f""")
def roll_mask(spark, sf):
    s, active, rolls = _rolls(spark, sf)
    z = continuous.continuous(s, active, rolls).select("session_date", F.col("close").alias("z"))
    return rounded_means(continuous.mask_roll_days(z, rolls), ["z"])


@query("""SELECT l_returnflag AS product, round(avg(CASE WHEN l_tax > l_discount THEN l_extendedprice * (l_tax - l_discount) / 2 END), 4) AS half_spread, count(*) AS n FROM lineitem GROUP BY 1""")
def half_spread(spark, sf):
    t = panel.read(spark, sf, "lineitem")
    quotes = t.select(F.col("l_returnflag").alias("product"), (F.col("l_extendedprice") * F.col("l_discount")).alias("bid"), (F.col("l_extendedprice") * F.col("l_tax")).alias("ask"))
    return rounded(continuous.half_spread(quotes), ["half_spread"], 4)


@query("SELECT l_orderkey AS id, l_linenumber AS line, round(CAST(CAST(l_extendedprice * 1000000000 AS BIGINT) AS DOUBLE) * 1e-9, 4) AS price FROM lineitem")
def fixed_point(spark, sf):
    t = panel.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.round(F.col("l_extendedprice") * 1e9).cast("long").alias("price"))
    return rounded(t.withColumn("price", continuous.fixed_point("price")), ["price"], 4)


@query("""WITH m AS (SELECT CAST(y AS INTEGER) AS y, q, make_date(y, 3 * (q + 1), 1) AS d FROM range(2016, 2031) a(y), range(4) b(q)),
e AS (SELECT *, CAST(d + CAST((12 - isodow(d)) % 7 + 14 AS INTEGER) AS DATE) AS last_trade_date FROM m)
SELECT 'ES' || substr('HMUZ', q + 1, 1) || lpad(CAST(y % 100 AS VARCHAR), 2, '0') AS contract, y AS year, last_trade_date,
  (CAST(last_trade_date AS TIMESTAMP) + INTERVAL 570 MINUTE) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' AS expiration_ts, CAST(12.5 AS DOUBLE) AS tick_value_usd FROM e""")
def contract_table(spark, sf):
    d = continuous.quarterly_contracts(spark, "ES", 2016, 2030, multiplier_usd=50.0, tick_size=0.25)
    return d.select("contract", F.col("year").cast("int").alias("year"), "last_trade_date", "expiration_ts", "tick_value_usd")


@query("""SELECT l_returnflag AS product, 'C' || l_linenumber AS contract, CAST(l_shipdate AS DATE) AS ts_event, count(*) AS n FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def duplicate_bars(spark, sf):
    t = panel.read(spark, sf, "lineitem")
    return continuous.duplicate_bars(t.select(F.col("l_returnflag").alias("product"), panel.contract_name().alias("contract"), F.col("l_shipdate").cast("date").alias("ts_event")))


@query("""WITH b AS (SELECT l_returnflag AS product, 'C' || l_linenumber AS contract, CAST(l_shipdate AS DATE) AS day, l_extendedprice AS close, l_quantity AS volume, l_quantity FROM lineitem),
pt AS (SELECT product, contract, day, 1 AS part, max(struct_pack(close := close, volume := CAST(volume AS BIGINT))) AS m FROM b WHERE l_quantity <= 30 GROUP BY 1, 2, 3
  UNION ALL SELECT product, contract, day, 2, max(struct_pack(close := close, volume := CAST(volume AS BIGINT))) FROM b WHERE l_quantity > 20 GROUP BY 1, 2, 3)
SELECT product, contract, CAST(day AS TIMESTAMP) AS ts_event, m.close AS close, m.volume AS volume FROM pt QUALIFY row_number() OVER (PARTITION BY product, contract, day ORDER BY part DESC) = 1""")
def merged_bars(spark, sf):
    """Two overlapping batches of bars with repeated keys, the second one merged twice, read back from the table."""
    t = panel.read(spark, sf, "lineitem")
    bars_ = t.select(F.col("l_shipdate").cast("timestamp_ntz").alias("ts_event"), F.col("l_returnflag").alias("product"), panel.contract_name().alias("contract"), F.col("l_extendedprice").cast("double").alias("close"), F.col("l_quantity").cast("long").alias("volume"))
    folder = shared_folder(spark)
    for part in ("volume <= 30", "volume > 20", "volume > 20"):
        bars.merge_bars(bars_.filter(part), folder, ("product", "contract"))
    return bars.read_bars(spark, folder).select("product", "contract", "ts_event", "close", "volume")


@query(f"""WITH {SESS}, {RANKS}, own AS (SELECT contract, session_date, close, lag(close) OVER (PARTITION BY contract ORDER BY session_date) AS before FROM se),
hd AS (SELECT a.session_date, a.contract, close, before, lag(a.contract) OVER (ORDER BY a.session_date) AS old FROM af a JOIN own USING (session_date, contract))
SELECT session_date, contract, {mean_sql("CASE WHEN old IS NULL THEN 0 ELSE coalesce((close - before), 0) * 50 END - CASE WHEN old <> contract THEN CAST(2.5 AS DOUBLE) ELSE 0 END")} AS pnl FROM hd""")
def contract_pnl(spark, sf):
    s, active, _ = _rolls(spark, sf)
    contracts = panel.contract_list(spark, sf).withColumn("multiplier_usd", F.lit(50.0))
    held = active.select("product", "session_date", "contract", F.lit(1.0).alias("position"))
    return rounded_means(continuous.contract_pnl(held, s, contracts, 2.5).select("session_date", "contract", "pnl"), ["pnl"])


@query(f"""WITH {SESS}, {RANKS}, q AS (SELECT session_date, avg(close) AS y FROM se GROUP BY 1), j AS (SELECT a.contract, q.y, s.close AS x FROM af a JOIN se s USING (session_date, contract) JOIN q USING (session_date))
SELECT contract, round(regr_intercept(y, x), 4) AS alpha, round(regr_slope(y, x), 6) AS beta, round(regr_r2(y, x), 6) AS r_squared, CAST(regr_count(y, x) AS BIGINT) AS n FROM j GROUP BY 1""")
def fit_by_contract(spark, sf):
    s, active, _ = _rolls(spark, sf)
    d = active.join(s.drop("volume"), ["product", "session_date", "contract"]).join(s.groupBy("session_date").agg(F.avg("close").alias("y")), "session_date")
    return rounded(rounded(continuous.fit_by_epoch(d, "y", "close"), ["alpha"], 4), ["beta", "r_squared"])
