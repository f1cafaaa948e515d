"""Ordered computations over long series without putting a series into one task.

``with_index`` numbers the rows of each series in two levels: rows within a stretch of time, and stretches (one row each)
among themselves. ``windowed`` evaluates frames that reach back a bounded number of rows in blocks of rows, each block
with a copy of the rows just before it. ``cumulative`` sums within blocks and adds the totals of earlier blocks (one row
each). These are lazy and exact; no window ranges over more than a block of rows, or over one row a block.

Who has counted a frame can say so (``rows``): one of at most ROWS rows is a single block, and plain windows do. A wrong
count costs time, not results: a null key is a key like any other, here and there.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDEX = "_i"
ROWS = 8192


def staged(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the folder that driver and executors share, deleted when the application ends.

    For what is read several times: indexes and running sums read their input twice, so plans of several steps would
    otherwise double with each.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """A new name in the folder that driver and executors share (spark.checkpoint.dir), deleted when the application ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder}/stage-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left joined with right where all keys are equal, null keys to each other, too; right's own copies of the keys go.

    Without keys, right is one row, which goes to all of left.
    """
    if not keys:
        return left.crossJoin(F.broadcast(right))
    right = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys])
    return left.join(right, same, how).drop(*[f"_on_{k}" for k in keys])  # a semi or anti join has none of them


def _stretch(df: DataFrame, order_col: str) -> Column:
    kind = df.schema[order_col].dataType
    if isinstance(kind, T.DateType):
        key = F.floor(F.unix_date(F.col(order_col)) / 256)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        key = F.unix_date(F.to_date(order_col))
    else:
        key = F.floor(F.col(order_col) / ROWS)
    return F.coalesce(key.cast("long"), F.lit(-(1 << 62)))


def one_block(rows: int | None) -> bool:
    return rows is not None and rows <= ROWS


def with_index(df: DataFrame, order_col: str = "ts", partition_cols: Sequence[str] = (), tiebreak: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """df with its 0-based place in each series as column ``_i``; a frame that has it already stays as it is.

    Rows of one time are told apart by ``tiebreak`` and then by a hash of all columns, so that numbering the same rows
    again gives the same numbers.
    """
    if INDEX in df.columns:
        return df
    whole = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, T.MapType)])
    if one_block(rows):
        return df.withColumn(INDEX, (F.row_number().over(Window.partitionBy(*partition_cols).orderBy(order_col, *tiebreak, whole)) - 1).cast("long"))
    keys = [*partition_cols, "_k"]
    d = df.withColumn("_k", _stretch(df, order_col))
    counts = d.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*partition_cols).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order_col, *tiebreak, whole))
    d = join_on(d.withColumn("_r", place), first, keys)
    return d.withColumn(INDEX, F.col("_first") + F.col("_r") - 1).drop("_k", "_r", "_first")


Columns = dict[str, Callable[[WindowSpec], Column]]


def windowed(df: DataFrame, columns: Columns | Sequence[Columns], before: int, partition_cols: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """df (indexed) with columns made by functions of an ordered window; their frames reach back at most ``before`` rows.

    Of several groups of columns, each can use those of the groups before it.
    """
    groups = [columns] if isinstance(columns, dict) else columns
    if one_block(rows):
        w = Window.partitionBy(*partition_cols).orderBy(INDEX)
        return reduce(lambda d, made: d.withColumns({name: make(w) for name, make in made.items()}), groups, df)
    size = max(ROWS, 4 * before)
    home = F.floor(F.col(INDEX) / size)
    reach = F.col(INDEX) % size >= size - before
    d = df.withColumn("_b", F.explode(F.when(reach, F.array(home, home + 1)).otherwise(F.array(home))))
    w = Window.partitionBy(*partition_cols, "_b").orderBy(INDEX)
    d = reduce(lambda d, made: d.withColumns({name: make(w) for name, make in made.items()}), groups, d)
    return d.filter(F.col("_b") == home).drop("_b")


def rolling_moments(df: DataFrame, cols: Sequence[str], window: int, partition_cols: Sequence[str] = (), rows: int | None = None, pairs: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """df (indexed) with ``_mean_<col>``, ``_var_<col>`` and ``_cov_<a>_<b>`` over the trailing ``window`` rows, null unless the
    frame is full and none of ``cols`` is missing in it.

    Frames are differences of running sums, so that a row costs the same whatever the window. The sums are of values less
    their block's mean, which keeps large offsets from cancelling; a frame of equal values has a variance of exactly 0.
    """
    whole = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    products = [(c, c) for c in cols] + list(pairs)
    centred = lambda c: F.col(c) - F.col(f"_c_{c}")
    there = reduce(and_, [F.col(c).isNotNull() for c in cols])
    first = {f"_c_{c}": lambda w, c=c: F.avg(c).over(whole(w)) for c in cols} | {f"_d_{c}": lambda w, c=c: (F.col(c) != F.lag(c).over(w)).cast("long") for c in cols}
    terms = {"n": there.cast("long")} | {f"s_{c}": centred(c) for c in cols} | {f"p_{a}_{b}": centred(a) * centred(b) for a, b in products} | {f"d_{c}": F.col(f"_d_{c}") for c in cols}
    second = {f"_u_{name}": lambda w, term=term: F.sum(F.coalesce(term, F.lit(0))).over(upto(w)) for name, term in terms.items()}
    back = lambda name: window - 1 if name.startswith("d_") else window  # noqa: E731  # a change lies between two rows of the frame
    since = lambda name: lambda w: F.col(f"_u_{name}") - F.coalesce(F.lag(f"_u_{name}", back(name)).over(w), F.lit(0))
    third = {f"_f_{name}": since(name) for name in terms if window > 1 or not name.startswith("d_")}
    d = windowed(df, [first, second, third], window - 1, partition_cols, rows)
    f, n = (lambda name: F.col(f"_f_{name}")), float(window)
    full_ = f("n") == window

    def covariance(a, b):
        if window < 2:
            return F.lit(None).cast("double")
        value = (f(f"p_{a}_{b}") - f(f"s_{a}") * f(f"s_{b}") / n) / (n - 1)
        still = (f(f"d_{a}") == 0) | (f(f"d_{b}") == 0)
        return F.when(full_ & still, 0.0).when(full_, F.greatest(value, F.lit(0.0)) if a == b else value)

    made = {f"_mean_{c}": F.when(full_, F.col(f"_c_{c}") + f(f"s_{c}") / n) for c in cols} | {f"_var_{c}": covariance(c, c) for c in cols} | {f"_cov_{a}_{b}": covariance(a, b) for a, b in pairs}
    return d.select(*df.columns, *[c.alias(name) for name, c in made.items()])


def cumulative(df: DataFrame, columns: dict[str, tuple[Column, str]], partition_cols: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """df (indexed) with running sums, maxima or minima (nulls skipped), given as name: (column, "sum" | "max" | "min")."""
    of = {"sum": F.sum, "max": F.max, "min": F.min}
    if one_block(rows):
        whole = Window.partitionBy(*partition_cols).orderBy(INDEX).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: of[how](c).over(whole) for n, (c, how) in columns.items()})
    both = {"sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), "max": F.greatest, "min": F.least}
    keys = [*partition_cols, "_b"]
    d = df.withColumn("_b", F.floor(F.col(INDEX) / ROWS)).withColumns({f"_v_{n}": c for n, (c, _) in columns.items()})
    totals = d.groupBy(*keys).agg(*[of[how](f"_v_{n}").alias(f"_t_{n}") for n, (_, how) in columns.items()])
    before = Window.partitionBy(*partition_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, *[of[how](f"_t_{n}").over(before).alias(f"_p_{n}") for n, (_, how) in columns.items()])
    upto = Window.partitionBy(*keys).orderBy(INDEX).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"_l_{n}": of[how](f"_v_{n}").over(upto) for n, (_, how) in columns.items()})
    d = join_on(d, totals, keys)
    d = d.withColumns({n: both[how](F.col(f"_p_{n}"), F.col(f"_l_{n}")) for n, (_, how) in columns.items()})
    return d.drop("_b", *[f"_{x}_{n}" for n in columns for x in "vlp"])


def rolling(w: WindowSpec, window: int) -> WindowSpec:
    return w.rowsBetween(-(window - 1), 0)
