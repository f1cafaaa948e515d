"""Reading tables, shared scratch tables and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset and
    Spark runs in this one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def settle(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors.

    The table is deleted when the application ends, or by discard().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidepool-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    place, files = _hadoop(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that settle() wrote; only for those that no result still reads.

    The shuffle files of the jobs that made them go, too: Spark deletes these once the driver's heap is collected, which
    without a nudge may be long after.
    """
    for t in tables:
        place, files = _hadoop(t.sparkSession, t.settled_at)
        files.delete(place, True)
    tables[0].sparkSession._jvm.System.gc()


def join_side(df: DataFrame) -> DataFrame:
    """An aggregate that is about to be joined on its own key.

    Dealing it out anew costs little (it has one row a key) and lets AQE split a skewed key on the other side,
    which it can't while the join reuses the aggregate's own partitioning.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): (node, component), component being the smallest node reachable.

    Alternating large-star and small-star rounds. Every step is a minimum per node and a join, so that no node's
    neighbours are gathered in one place; each round ends in a table in the shared folder. Nodes without an edge to
    another node don't appear.
    """
    pair = lambda df: df.filter("u != v").distinct()
    now = settle(pair(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))))
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(now)
    while before[0]:  # the rounds settle by themselves, in about the square of the logarithm of the longest way
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = pair(both.join(join_side(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = settle(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(join_side(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, settle(pair(small.unionByName(least.select("u", F.col("m").alias("v")))))
        discard(last, large)
        after = mark(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
