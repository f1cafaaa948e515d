"""Augmented Dickey-Fuller and Engle-Granger tests, of one series or of many in one plan.

Sums of products are the only thing that the data are read for. Each task walks its blocks of rows (with the few rows
before a block that lags need) and adds up one matrix a series; the matrices' packed upper triangles are summed by place.
Lag orders are nested, so each is solved from a leading part of its series' matrix. The order chosen is fitted over the
rows that it leaves, which are those of the matrix and a few at the head of the series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import INDEX, ROWS, join_on, staged, with_index
from ..functions.unitroot import aic, critical_values, p_value, solve

NEARLY_ONE = 1 - 100 * math.sqrt(np.finfo(float).eps)  # R squared from which residuals are rounding errors
RESULT = "statistic double, pvalue double, lags int, n long, crit_1 double, crit_5 double, crit_10 double, rejected boolean"


@dataclass
class CointegrationResult:
    statistic: float
    pvalue: float
    critical_values: dict[str, float]
    is_cointegrated: bool
    alpha_level: float


def most_lags(n: Column, constant: bool) -> Column:
    """The usual largest lag order for n values; negative if they are too few."""
    return F.least(F.ceil(12 * F.pow(n / 100.0, F.lit(0.25))), F.floor(n / 2) - int(constant) - 1).cast("int")


def design(v: np.ndarray, first: int, lags: int, constant: bool) -> np.ndarray:
    """Rows (constant, level before, lagged differences, difference) for v[first:]; each row needs lags + 1 values before it."""
    dy = np.diff(v)
    at = np.arange(first, len(v))
    columns = [v[at - 1], *(dy[at - 1 - i] for i in range(1, lags + 1)), dy[at - 1]]
    return np.column_stack(([np.ones(len(at))] if constant else []) + columns)


def packed_sums(d: DataFrame, keys: Sequence[str], constant: bool, block: int) -> DataFrame:
    """keys, place, value: sums of products by place of the packed upper triangle, and (place -1) how many rows there were.

    d(keys, _i, v, most) is indexed. A block comes with copies of the ``most`` + 1 rows before it.
    """
    home = F.floor(F.col(INDEX) / block)
    reach = F.col(INDEX) % block >= block - F.col("most") - 1
    d = d.withColumn("_b", F.explode(F.when(reach, F.array(home, home + 1)).otherwise(F.array(home))))
    d = d.repartition(*keys, "_b").sortWithinPartitions(*keys, "_b", INDEX).select(*keys, "_b", INDEX, "most", "v")
    names = list(keys)

    def run(batches):
        held: dict = {"series": None, "block": None, "rows": [], "sum": None, "n": 0}

        def close_block():
            if held["rows"]:
                index, v = np.array([r[0] for r in held["rows"]]), np.array([r[1] for r in held["rows"]])
                first = max(held["most"] + 1, held["block"] * block) - index[0]
                if first < len(v):
                    x = design(v, first, held["most"], constant)
                    held["sum"] = x.T @ x if held["sum"] is None else held["sum"] + x.T @ x
                    held["n"] += len(x)
            held["rows"] = []

        def close_series():
            close_block()
            if held["sum"] is None:
                return None
            values = np.append(held["n"], held["sum"][np.triu_indices(len(held["sum"]))])
            keys_ = [pa.array([k] * len(values), t) for k, t in zip(held["series"], held["types"])]
            held["sum"], held["n"] = None, 0
            return pa.RecordBatch.from_arrays([*keys_, pa.array(np.arange(-1, len(values) - 1), pa.int32()), pa.array(values)], [*names, "place", "value"])

        for batch in batches:
            held["types"] = [f.type for f in batch.schema][: len(names)]
            for *series, b, index, most, v in zip(*(c.to_pylist() for c in batch.columns)):
                if series != held["series"]:
                    if held["series"] is not None and (out := close_series()):
                        yield out
                    held.update(series=series, block=b, most=most)
                elif b != held["block"]:
                    close_block()
                    held["block"] = b
                held["rows"].append((index, v))
        if held["series"] is not None and (out := close_series()):
            yield out

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in d.select(*keys).schema)
    return d.mapInArrow(run, f"{kinds}place int, value double").groupBy(*keys, "place").agg(F.sum("value").alias("value"))


def choose(gram: np.ndarray, m: int, head: np.ndarray, most: int, constant: bool, auto: bool) -> tuple[float, int]:
    """t-ratio of the level, and the lag order: the one with the least AIC over common rows, or ``most``."""
    fixed, target = 1 + constant, len(gram) - 1
    best = most
    if auto:
        best = min(range(most + 1), key=lambda p: aic(solve(gram, list(range(fixed + p)), target, m)[2], m, fixed + p))
    columns = [*range(fixed + best), target]
    final, n = gram[np.ix_(columns, columns)], m
    if best < most:
        x = design(head, best + 1, best, constant)  # rows that only longer lags leave out
        final, n = final + x.T @ x, n + len(x)
    b, se, _ = solve(final, list(range(fixed + best)), fixed + best, n)
    at = fixed - 1
    return (float(b[at] / se[at]) if se[at] else math.copysign(math.inf, b[at])), best


def _checked(maxlag: int | None, autolag: str | None) -> None:
    if autolag is not None and autolag.lower() != "aic":
        raise ValueError("autolag must be 'aic' or None")
    if maxlag is not None and not 0 <= maxlag < ROWS // 2:
        raise ValueError(f"maxlag must be from 0 to {ROWS // 2 - 1}")


def unit_roots(d: DataFrame, keys: Sequence[str], constant: bool, autolag: str | None, *, series: int, trend: str, alpha: float) -> DataFrame:
    """A row a series of d(keys, _i, v, most, n), v centred: RESULT. Series too short or constant have a null statistic."""
    keys = list(keys)
    able = d.filter("most >= 0")
    sums = packed_sums(able, keys, constant, ROWS)
    # a row a series of a few hundred numbers each, and the first values of the series
    grams = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("sums"))
    heads = able.filter(F.col(INDEX) <= F.col("most")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(INDEX, "v"))).alias("head"))
    whole = d.groupBy(*keys).agg(F.max("most").alias("most"), F.coalesce(F.max("n"), F.lit(0)).alias("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    rows = join_on(join_on(whole, grams, keys, "left"), heads, keys, "left") if keys else whole.crossJoin(grams).crossJoin(heads)  # of one row each

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                stat, lags = None, None
                if r.sums is not None and len(r.sums) > 1 and r.low != r.high:
                    place = len(r.sums) - 1
                    k = int((math.isqrt(8 * place + 1) - 1) // 2)
                    gram = np.zeros((k, k))
                    gram[np.triu_indices(k)] = [s["value"] for s in r.sums[1:]]
                    gram = gram + np.triu(gram, 1).T
                    stat, lags = choose(gram, int(r.sums[0]["value"]), np.array([h["v"] for h in r.head]), int(r.most), constant, autolag is not None)
                if stat is None:
                    out.append((None, None, None, r.n, None, None, None, None))
                    continue
                p = p_value(stat, series, trend)
                crit = critical_values(series, trend, int(r.n) - 1 - (lags if series == 1 else 0))
                out.append((stat, p, lags, r.n, *(None if math.isnan(c) else c for c in crit.values()), p < alpha))
            found = pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"lags": "Int32", "n": "int64", "rejected": "boolean"})
            yield pd.concat([pdf[keys].reset_index(drop=True), found], axis=1)

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in d.select(*keys).schema)
    return rows.mapInPandas(run, kinds + RESULT)


def dickey_fuller(d: DataFrame, n: int, constant: bool, maxlag: int | None = None, autolag: str | None = "aic") -> tuple[float, int]:
    """t-ratio of the level, and the lags used, for d(_i, v) of n rows, v centred."""
    most = F.lit(maxlag) if maxlag is not None else most_lags(F.lit(n), constant)
    r = unit_roots(d.select(INDEX, "v", most.alias("most"), F.lit(n).cast("long").alias("n")), [], constant, autolag, series=1, trend="c", alpha=0.05).first()
    if r is None or r.statistic is None:
        raise ValueError("sample size is too short for the test")
    return r.statistic, r.lags


def adf_many(df: DataFrame, partition_cols: Sequence[str], alpha: float = 0.05, *, value: str = "spread", order_col: str = "ts", maxlag: int | None = None, autolag: str | None = "aic") -> DataFrame:
    """A test of each series for a unit root, with a constant: partition_cols and RESULT (``rejected``: stationary).

    Missing values (null, NaN) are dropped first. A constant or too short series has nulls in place of a statistic.
    """
    _checked(maxlag, autolag)
    keys, v = list(partition_cols), F.col(value).cast("double")
    d = df.select(*keys, order_col, F.when(~F.isnan(v), v).alias("v")).filter("v is not null")
    d = staged(with_index(d, order_col, keys))
    facts = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("v").alias("_mean"))
    d = join_on(d, facts, keys)
    most = F.lit(maxlag) if maxlag is not None else most_lags(F.col("n"), True)
    return unit_roots(d.select(*keys, INDEX, (F.col("v") - F.col("_mean")).alias("v"), most.alias("most"), "n"), keys, True, autolag, series=1, trend="c", alpha=alpha)


def adf_test(df: DataFrame, alpha: float = 0.05, *, value: str = "spread", order_col: str = "ts") -> dict:
    """Null: a unit root. With a constant, lags by AIC; missing values are dropped first; a constant series raises."""
    r = adf_many(df, [], alpha, value=value, order_col=order_col).first()
    if r is None or r.statistic is None:
        raise ValueError("Invalid input, x is constant or too short")
    return {"statistic": r.statistic, "pvalue": r.pvalue, "critical_values": critical_values(1, "c", r.n - 1 - r.lags), "is_stationary": r.rejected}


def residuals_of(df: DataFrame, keys: Sequence[str], trend: str, y: str, x: str, order_col: str) -> DataFrame:
    """keys, _i, v (residual of y on x and the terms of ``trend``), n, bad (missing values) and r_squared of each series."""
    keys = list(keys)
    d = df.select(*keys, order_col, F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"))
    missing = F.col("y").isNull() | F.col("x").isNull() | F.isnan("y") | F.isnan("x")
    d = staged(with_index(d, order_col, keys))
    facts = d.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(missing).alias("bad"), F.avg("y").alias("_my"), F.avg("x").alias("_mx"))
    d = join_on(d, facts, keys)
    centre = 0.0 if trend == "n" else 1.0  # with a constant, centring changes nothing but the rounding
    time = (2 * F.col(INDEX) + 1 - F.col("n")) / F.col("n")  # centred, too
    d = d.select(*keys, INDEX, "n", "bad", (F.col("y") - centre * F.col("_my")).alias("y"), (F.col("x") - centre * F.col("_mx")).alias("x"), (time if trend == "ct" else F.lit(0.0)).alias("t"))
    sums = {f"_{a}{b}": F.sum(F.col(a) * F.col(b)) for a, b in ("xx", "xt", "tt", "xy", "ty", "yy")}
    g = d.groupBy(*keys).agg(*[c.alias(k) for k, c in sums.items()])
    xx, xt, tt, xy, ty, yy = (F.col(k) for k in sums)
    if trend == "ct":
        det = xx * tt - xt * xt
        bx, bt = F.try_divide(xy * tt - ty * xt, det), F.try_divide(ty * xx - xy * xt, det)
    else:
        bx, bt = F.try_divide(xy, xx), F.lit(0.0)
    g = g.withColumns({"_bx": F.coalesce(bx, F.lit(0.0)), "_bt": F.coalesce(bt, F.lit(0.0))})
    left = F.greatest(yy - F.col("_bx") * xy - F.col("_bt") * ty, F.lit(0.0))
    g = g.select(*keys, "_bx", "_bt", F.coalesce(1 - F.try_divide(left, yy), F.lit(1.0)).alias("r_squared"))
    d = join_on(d, g, keys)
    return d.select(*keys, INDEX, (F.col("y") - F.col("_bx") * F.col("x") - F.col("_bt") * F.col("t")).alias("v"), "n", "bad", "r_squared")


def engle_granger_many(df: DataFrame, partition_cols: Sequence[str], alpha: float = 0.05, trend: str = "c", maxlag: int | None = None, autolag: str | None = "aic", *, y: str = "y", x: str = "x", order_col: str = "ts") -> DataFrame:
    """A cointegration test of each pair: partition_cols, RESULT (``rejected``: cointegrated), r_squared and bad.

    Residuals of y on x (and constant, trend), then a unit-root test without constant. A pair with missing values (their
    number: ``bad``) or too few rows has nulls; where x explains y but for rounding, the statistic is -inf and p is 0.
    """
    if trend not in ("n", "c", "ct"):
        raise ValueError(f"trend {trend!r} isn't available: n, c, ct are")
    _checked(maxlag, autolag)
    keys = list(partition_cols)
    d = staged(residuals_of(df, keys, trend, y, x, order_col))
    sound = (F.col("bad") == 0) & (F.col("r_squared") < NEARLY_ONE)
    most = F.lit(maxlag) if maxlag is not None else most_lags(F.col("n"), False)
    found = unit_roots(d.filter(sound).select(*keys, INDEX, "v", most.alias("most"), "n"), keys, False, autolag, series=2, trend=trend, alpha=alpha)
    pairs = d.groupBy(*keys).agg(F.max("bad").alias("bad"), F.max("r_squared").alias("r_squared"), F.max("n").alias("_n"))
    out = join_on(pairs, found, keys, "left") if keys else pairs.join(found, how="left")
    perfect = (F.col("bad") == 0) & (F.col("r_squared") >= NEARLY_ONE)
    collinear = {"statistic": F.lit(-math.inf), "pvalue": F.lit(0.0), "rejected": F.lit(0.0 < alpha)}
    out = out.withColumn("n", F.col("_n")).withColumns({c: F.when(perfect, v).otherwise(F.col(c)) for c, v in collinear.items()})
    return out.select(*keys, *[c.split()[0] for c in RESULT.split(", ")], "r_squared", "bad")


def engle_granger(df: DataFrame, alpha: float = 0.05, trend: str = "c", maxlag: int | None = None, autolag: str | None = "aic", *, y: str = "y", x: str = "x", order_col: str = "ts") -> CointegrationResult:
    """Null: no cointegration. As engle_granger_many, of one pair; missing values raise."""
    r = engle_granger_many(df, [], alpha, trend, maxlag, autolag, y=y, x=x, order_col=order_col).first()
    if r is None or r.bad or not r.n:
        raise ValueError("the series hold missing values or none")
    if r.statistic is None:
        raise ValueError("sample size is too short for the test")
    return CointegrationResult(r.statistic, r.pvalue, critical_values(2, trend, r.n - 1), r.rejected, alpha)
