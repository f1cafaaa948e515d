"""The price pair that the queries work on, made from the tables lineitem and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordered import INDEX, cumulative, rolling, staged, windowed, with_index
from ..operators.clean import forward_fill


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "lineitem")
    return t.select(F.col("l_shipdate").cast("date").alias("ts"), F.col("l_returnflag").alias("symbol"), F.col("l_extendedprice").alias("close"))


def raw_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, a, r): mean prices of return flags A and R by day, with gaps."""
    return long_bars(spark, sf_dir).groupBy("ts").pivot("symbol", ["A", "R"]).agg(F.avg("close")).select("ts", F.col("A").alias("a"), F.col("R").alias("r")).na.drop("all", subset=["a", "r"])


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, y, x, ES, NQ): logs and prices of a cointegrated pair (slope 1.3) that follows from the raw panel."""
    raw = staged(raw_panel(spark, sf_dir))
    n = raw.count()
    d = forward_fill(raw, ["a", "r"], 2, rows=n).drop(INDEX).na.drop("any", subset=["a", "r"])
    s = d.agg(F.avg("a").alias("ma"), F.stddev_samp("a").alias("sa"), F.avg("r").alias("mr"), F.stddev_samp("r").alias("sr"))
    d = d.crossJoin(F.broadcast(s))  # one row
    d = d.select("ts", ((F.col("a") - F.col("ma")) / F.col("sa")).alias("za"), ((F.col("r") - F.col("mr")) / F.col("sr")).alias("zr"))
    d = with_index(d, "ts", rows=n)
    d = windowed(d, {"e": lambda w: 0.05 * F.avg("za").over(rolling(w, 20))}, 19, rows=n)
    d = cumulative(d, {"walk": (F.col("zr"), "sum")}, rows=n)
    d = d.withColumn("x", F.log(F.lit(100.0)) + 0.01 * F.col("walk")).withColumn("y", 2 + 1.3 * F.col("x") + F.col("e"))
    return staged(d.select("ts", "y", "x", F.exp("y").alias("ES"), F.exp("x").alias("NQ"), INDEX))


def many_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(flag, line, ts, y, x): mean prices by day of each return flag and of each line number, paired with each other."""
    t = read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("ts"), F.col("l_returnflag").alias("flag"), F.col("l_linenumber").cast("long").alias("line"), "l_extendedprice")
    side = lambda key, name: t.groupBy("ts", key).agg(F.avg("l_extendedprice").alias(name))
    return side("flag", "y").join(side("line", "x"), "ts").select("flag", "line", "ts", "y", "x")


def many_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(flag, line, ts, y, x): running sums of the centred logs of many_pairs; y's of y less x."""
    d = many_pairs(spark, sf_dir).withColumns({"y": F.log("y"), "x": F.log("x")})
    keys = ["flag", "line"]
    d = d.join(d.groupBy(*keys).agg(F.avg("y").alias("my"), F.avg("x").alias("mx")), keys)
    d = with_index(d.select(*keys, "ts", (F.col("y") - F.col("my")).alias("sy"), (F.col("x") - F.col("mx")).alias("sx")), "ts", keys)
    return cumulative(d, {"y": (F.col("sy") - F.col("sx"), "sum"), "x": (F.col("sx"), "sum")}, keys).select(*keys, "ts", "y", "x")


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product, ts, v): running sums of the events' values less 50, by type."""
    t = read(spark, sf_dir, "events").select(F.col("event_type").alias("product"), "ts", (F.col("value") - 50).alias("step"))
    return cumulative(with_index(t, "ts", ["product"]), {"v": (F.col("step"), "sum")}, ["product"]).select("product", "ts", "v")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: (ts_event, product, contract, open, high, low, close, volume)."""
    t = read(spark, sf_dir, "events")
    return t.select(F.col("ts").alias("ts_event"), F.col("event_type").alias("product"), F.lit("X").alias("contract"), *[F.col("value").alias(c) for c in ("open", "high", "low", "close")], F.lit(1).cast("long").alias("volume"))


def contract_name():
    return F.concat(F.lit("C"), F.col("l_linenumber").cast("string"))


def contract_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily closes and volumes of seven 'contracts' of one product: the line numbers."""
    t = read(spark, sf_dir, "lineitem")
    return t.groupBy(F.lit("P").alias("product"), F.col("l_shipdate").cast("date").alias("session_date"), contract_name().alias("contract")).agg(F.avg("l_extendedprice").alias("close"), F.sum("l_quantity").cast("double").alias("volume"), F.count("*").alias("open_interest"))


def contract_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts in order of name, each expiring a year after the one before."""
    t = read(spark, sf_dir, "lineitem").select(contract_name().alias("contract")).distinct()
    n = F.row_number().over(Window.orderBy("contract"))  # a handful of rows
    return t.select(F.lit("P").alias("product"), "contract", n.alias("n")).withColumn("last_trade_date", F.expr("add_months(DATE'1992-06-19', 12 * n)")).drop("n")


def numbered(contracts: DataFrame, first: str, step: str) -> DataFrame:
    """contracts(contract) of product P in order of name, expiring at ``first`` plus 1, 2, ... times ``step``."""
    n = F.row_number().over(Window.orderBy("contract"))  # a handful of rows
    return contracts.select(F.lit("P").alias("product"), "contract", n.alias("n")).withColumn("last_trade_date", F.expr(f"cast({first} + n * {step} AS date)")).drop("n")
