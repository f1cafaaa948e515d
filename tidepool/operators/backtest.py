"""Backtests of positions on a spread, their metrics, and out-of-sample evaluation."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import INDEX, cumulative, join_on, staged, windowed, with_index
from ..functions.selection import ranked_values
from .clean import log_prices, nan_to_null
from .hedge import HedgeRatio, hedge_table
from .ou import LEAST, OUParams, ou_table
from .signals import generate_signals
from .spread import compute_spread, zscore


@dataclass
class BacktestResult:
    """``table`` has position, pnl and equity for each row; metrics and trades are computed from it, once, when asked for."""

    table: DataFrame
    order_col: str = "ts"
    rows: int | None = None  # of the table, or more, if known

    @property
    def positions(self) -> DataFrame:
        return self.table.select(self.order_col, "position")

    @property
    def pnl(self) -> DataFrame:
        return self.table.select(self.order_col, "pnl")

    @property
    def equity(self) -> DataFrame:
        return self.table.select(self.order_col, "equity")

    @cached_property
    def _summary(self) -> dict:
        return performance_metrics(self.table, order_col=self.order_col, equity="equity", trades="is_trade", rows=self.rows).first().asDict()

    @property
    def trades(self) -> int:
        return self._summary["trades"]

    @property
    def metrics(self) -> dict:
        return {k: v for k, v in self._summary.items() if k != "trades"}


def performance_metrics(df: DataFrame, periods_per_year: int = 252, *, pnl: str = "pnl", order_col: str = "ts", partition_cols: Sequence[str] = (), equity: str | None = None, trades: str | None = None, rows: int | None = None) -> DataFrame:
    """total_pnl, sharpe, max_drawdown, hit_rate, n_periods of each series; with ``trades``, the sum of that column, too.

    Missing pnl is dropped. The drawdown's first peak is the first equity, not 0; a pnl without spread has sharpe 0; the
    hit rate is over non-zero pnl. An empty single series gives zeros. ``equity`` names the running sum of a pnl without
    missing values in an indexed frame, as backtest_table() makes them; otherwise it is computed.
    """
    v = F.col(pnl).cast("double")
    counted = [F.col(trades).alias("_trades")] if trades else []
    if equity:
        d = df.select(*partition_cols, INDEX, v.alias("_pnl"), F.col(equity).alias("_equity"), *counted)
    else:
        d = df.select(*partition_cols, order_col, F.when(~F.isnan(v), v).alias("_pnl"), *counted).filter("_pnl is not null")
        d = cumulative(staged(with_index(d, order_col, partition_cols, rows=rows)), {"_equity": (F.col("_pnl"), "sum")}, partition_cols, rows)
    d = cumulative(d, {"_peak": (F.col("_equity"), "max")}, partition_cols, rows)
    s = d.groupBy(*partition_cols).agg(
        F.coalesce(F.sum("_pnl"), F.lit(0.0)).alias("total_pnl"), F.avg("_pnl").alias("m"), F.stddev_samp("_pnl").alias("s"),
        F.coalesce(F.max(F.col("_peak") - F.col("_equity")), F.lit(0.0)).alias("max_drawdown"),
        F.coalesce(F.avg(F.when(F.col("_pnl") != 0, (F.col("_pnl") > 0).cast("double"))), F.lit(0.0)).alias("hit_rate"), F.count("*").alias("n_periods"),
        *([F.coalesce(F.sum("_trades"), F.lit(0)).alias("trades")] if trades else []),
    )
    sharpe = F.when(F.col("s") > 0, F.col("m") / F.col("s") * math.sqrt(periods_per_year)).otherwise(0.0)
    return s.select(*partition_cols, "total_pnl", sharpe.alias("sharpe"), "max_drawdown", "hit_rate", "n_periods", *(["trades"] if trades else []))


def backtest_table(df: DataFrame, cost_per_unit: float = 0.0, lag: int = 1, *, spread: str = "spread", position: str = "position", order_col: str = "ts", partition_cols: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """df with position (missing: 0; null and NaN are missing, also in the spread), pnl, equity and is_trade.

    pnl is the position ``lag`` rows ago times the spread's change, less cost times the change of position (charged at
    once; the first row from 0). A trade is a change to a position other than 0. A frame that is indexed already isn't
    written anew.
    """
    if lag < 0:
        raise ValueError("lag must not be negative: it would look ahead")
    d = df if INDEX in df.columns else staged(with_index(df, order_col, partition_cols, rows=rows))
    d = nan_to_null(d.withColumn("position", F.col(position)), [spread, "position"]).withColumn("position", F.coalesce("position", F.lit(0.0)))
    d = windowed(d, {"_ds": lambda w: F.col(spread) - F.lag(spread).over(w), "_held": lambda w: F.lag("position", lag).over(w), "_prev": lambda w: F.coalesce(F.lag("position").over(w), F.lit(0.0))}, max(lag, 1), partition_cols, rows)
    moved = F.col("position") - F.col("_prev")
    d = d.withColumn("pnl", F.coalesce(F.coalesce("_held", F.lit(0.0)) * F.col("_ds"), F.lit(0.0)) - cost_per_unit * F.abs(moved))
    d = d.withColumn("is_trade", ((moved != 0) & (F.col("position") != 0)).cast("int")).drop("_ds", "_held", "_prev")
    return cumulative(d, {"equity": (F.col("pnl"), "sum")}, partition_cols, rows)


def backtest_spread(spread: DataFrame, positions: DataFrame | None = None, cost_per_unit: float = 0.0, lag: int = 1, *, order_col: str = "ts", rows: int | None = None) -> BacktestResult:
    """Of spread(ts, spread) with positions(ts, position), joined on time, or with its own column ``position``."""
    if positions is not None:
        spread = spread.drop("position").join(positions.select(order_col, "position"), order_col, "left")
    return BacktestResult(backtest_table(spread, cost_per_unit, lag, order_col=order_col, rows=rows), order_col, rows)


def split_point(df: DataFrame, split: str | float, order_col: str = "ts"):
    """The first time of the test part: a date given as text, or that of row int(n * fraction) in order of time."""
    if isinstance(split, str):
        return F.lit(split).cast(df.schema[order_col].dataType)
    if not isinstance(split, float):
        raise TypeError(f"split is a {type(split).__name__}; a date as text or a fraction as float is needed")
    if not 0.0 < split < 1.0:
        raise ValueError(f"a fraction between 0 and 1 splits the rows, not {split}")
    kind = df.schema[order_col].dataType
    times = df.select(F.lit(0).alias("key"), F.col(order_col).alias("v"))
    n, known, low, high = times.agg(F.count("*"), F.count("v"), F.min("v"), F.max("v")).first()
    at = int(n * split) - (n - known)  # rows without a time come first
    return F.lit(ranked_values(times.filter("v is not null"), {0: [at]}, {0: (known, low, high)})[0, at] if 0 <= at < known else None).cast(kind)


def train_test_split_by_date(df: DataFrame, split: str | float, *, order_col: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rows before the split, and from it on; rows that share the split's time all go to the test part."""
    at = split_point(df, split, order_col)
    return df.filter(F.col(order_col) < at), df.filter(F.col(order_col) >= at)


def _walk(base: DataFrame, keys: list[str], y: str, x: str, at: DataFrame, z_window, entry, exit, stop, order_col: str, rows: int | None = None):
    """Hedge ratios and OU fits (rows a pair) of the train parts, and the staged signals of the whole with their ``part``.

    ``base`` is indexed; ``at``(keys, _at) has the first time of each pair's test part. All parameters are joined, as rows.
    """
    logs = log_prices(base.select(*keys, order_col, INDEX, y, x), order_col=order_col, partition_cols=keys, cols=[y, x])
    time = F.col(order_col)
    logs = join_on(logs, at, keys).withColumn("part", F.when(time < F.col("_at"), "train").when(time >= F.col("_at"), "test")).drop("_at")
    hedge = hedge_table(logs.filter("part = 'train'"), y, x, partition_cols=keys)
    spread = compute_spread(join_on(logs, hedge.select(*keys, F.col("alpha").alias("_alpha"), F.col("beta").alias("_beta")), keys), y, x, "_beta", "_alpha")
    spread = spread.select(*keys, order_col, INDEX, "part", "spread")
    ou = ou_table(spread.filter("part = 'train'").drop(INDEX), order_col=order_col, partition_cols=keys, rows=rows)
    z = zscore(spread, z_window, order_col=order_col, partition_cols=keys, rows=rows)
    return hedge, ou, staged(generate_signals(z, entry, exit, stop, order_col=order_col, partition_cols=keys, rows=rows))


def walk_forward_backtest(prices: DataFrame, y_col: str = "ES", x_col: str = "NQ", split: str | float = 0.7, z_window: int | None = 60, entry: float = 2.0, exit: float = 0.5, stop: float | None = 4.0, cost_per_unit: float = 0.0, *, order_col: str = "ts") -> WalkForward:
    """Hedge ratio and OU fit on the train part; spread, z-score and signals on the whole; backtests of either part.

    Signals run across the split, so a position can be carried into the test part; its first row then pays the entry cost
    and counts as a trade, and earns nothing on that bar, as each part's lags start anew. z_window=None looks ahead.
    """
    base = prices if INDEX in prices.columns else staged(with_index(prices.select(order_col, y_col, x_col), order_col))
    n = base.count()
    if isinstance(split, float) and 0.0 < split < 1.0:
        if int(n * split) < LEAST:
            raise ValueError(f"a fit needs {LEAST} values or more, there are {int(n * split)}")
        at = base.filter(F.col(INDEX) == int(n * split)).select(F.col(order_col).alias("_at"))  # joined, not looked up
    else:
        at = base.sparkSession.range(1).select(split_point(base, split, order_col).alias("_at"))
    hedge, ou, signals = _walk(base, [], y_col, x_col, at, z_window, entry, exit, stop, order_col, n)
    value = lambda v: math.nan if v is None else v

    def fitted() -> tuple[HedgeRatio, OUParams]:
        r = hedge.crossJoin(ou).first()
        if r.n_obs < LEAST:
            raise ValueError(f"a fit needs {LEAST} values or more, there are {r.n_obs}")
        logs = log_prices(base.select(order_col, INDEX, y_col, x_col), order_col=order_col, cols=[y_col, x_col]).crossJoin(F.broadcast(at)).filter(F.col(order_col) < F.col("_at")).drop("_at")
        residuals = compute_spread(logs, y_col, x_col, value(r.beta), value(r.alpha), "residual")
        return HedgeRatio(value(r.alpha), value(r.beta), residuals, value(r.r_squared)), OUParams(value(r.theta), value(r.mu), value(r.sigma), 1.0)

    part = lambda name: backtest_spread(signals.filter(F.col("part") == name).drop("part"), cost_per_unit=cost_per_unit, order_col=order_col, rows=n)
    return WalkForward(
        fitted, train=lambda: part("train"), test=lambda: part("test"), spread=lambda: signals.select(order_col, "spread"), zscore=lambda: signals.select(order_col, "z"),
    )


class WalkForward(Mapping):
    """hedge, ou, train, test, spread and zscore, each made when first asked for."""

    def __init__(self, fitted: Callable[[], tuple], **makers: Callable):
        self.fitted, self.makers, self.made = fitted, makers, {}

    def __getitem__(self, name: str):
        if name not in self.made:
            if name in ("hedge", "ou"):
                self.made["hedge"], self.made["ou"] = self.fitted()
            else:
                self.made[name] = self.makers[name]()
        return self.made[name]

    def __iter__(self):
        return iter(["hedge", "ou", *self.makers])

    def __len__(self) -> int:
        return 2 + len(self.makers)


def walk_forward_many(prices: DataFrame, partition_cols: Sequence[str], y_col: str = "y", x_col: str = "x", split: str | float = 0.7, z_window: int | None = 60, entry: float = 2.0, exit: float = 0.5, stop: float | None = 4.0, cost_per_unit: float = 0.0, *, order_col: str = "ts") -> dict[str, DataFrame]:
    """As walk_forward_backtest, of many pairs of prices(partition_cols, ts, y, x) in one plan.

    ``hedge`` and ``ou`` have a row a pair, ``table`` (spread, z, position, pnl, equity, is_trade) and ``metrics`` those of
    either part, told apart by ``part``. A fraction splits each pair by its own rows. Pairs with too few rows for a fit
    have nulls; null keys are keys; prices that aren't positive are missing; a null time belongs to neither part.
    """
    keys = list(partition_cols)
    base = staged(with_index(prices.select(*keys, order_col, y_col, x_col), order_col, keys))
    if isinstance(split, str):
        at = base.select(*keys).distinct().withColumn("_at", F.lit(split).cast(base.schema[order_col].dataType))
    elif not isinstance(split, float):
        raise TypeError(f"split is a {type(split).__name__}; a date as text or a fraction as float is needed")
    elif not 0.0 < split < 1.0:
        raise ValueError(f"a fraction between 0 and 1 splits the rows, not {split}")
    else:
        sizes = base.groupBy(*keys).agg(F.count("*").alias("_n"))
        at = join_on(base, sizes, keys).filter(F.col(INDEX) == (F.col("_n") * F.lit(split)).cast("long")).select(*keys, F.col(order_col).alias("_at"))
    hedge, ou, signals = _walk(base, keys, y_col, x_col, at, z_window, entry, exit, stop, order_col)
    parts = [*keys, "part"]
    table = backtest_table(signals.filter("part is not null"), cost_per_unit, order_col=order_col, partition_cols=parts)
    metrics = performance_metrics(table, order_col=order_col, partition_cols=parts, equity="equity", trades="is_trade")
    return {"hedge": hedge, "ou": ou, "table": table.drop(INDEX), "metrics": metrics}


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles (exact, interpolated) and max of values that aren't missing: one row for each column.

    One aggregate gives the counts, from which the ranks follow; their values are selected (functions.selection).
    """
    d = nan_to_null(df.select(*cols), cols)
    kinds = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    s = d.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in kinds.items()]).first()
    long = d.select(F.explode(F.array(*[F.struct(F.lit(i).alias("key"), F.col(c).alias("v")) for i, c in enumerate(cols)])).alias("x")).select("x.*").filter("v is not null")
    quartile = lambda i, share: (s[f"count{i}"] - 1) * share
    wanted = {i: [r for share in (0.25, 0.5, 0.75) for r in (math.floor(quartile(i, share)), math.ceil(quartile(i, share)))] for i in range(len(cols)) if s[f"count{i}"]}
    found = ranked_values(long, wanted, {i: (s[f"count{i}"], s[f"min{i}"], s[f"max{i}"]) for i in wanted})

    def row(i, c):
        def value(share):
            if not s[f"count{i}"]:
                return None
            low, high = found[i, math.floor(quartile(i, share))], found[i, math.ceil(quartile(i, share))]
            return low + (high - low) * (quartile(i, share) - math.floor(quartile(i, share)))

        return c, s[f"count{i}"], s[f"mean{i}"], s[f"std{i}"], s[f"min{i}"], value(0.25), value(0.5), value(0.75), s[f"max{i}"]

    return df.sparkSession.createDataFrame([row(i, c) for i, c in enumerate(cols)], "column string, count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double")


def tail(df: DataFrame, n: int = 5, order_col: str = "ts") -> DataFrame:
    """The last n rows by time."""
    return df.orderBy(F.desc(order_col)).limit(n)
