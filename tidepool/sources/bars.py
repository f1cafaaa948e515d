"""Bar tables on disk: Hive-partitioned, zstd-compressed Parquet with one row a key, and manifests of what was written."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import join_on

KEY = ("product", "contract", "ts_event")
LEAF = 4  # hexadecimal digits of a path's digest that name a leaf of the hash tree
PARTITIONS = ("source", "product", "contract", "date")


def one_per_key(bars: DataFrame, key=KEY) -> DataFrame:
    """Of the rows of a key the largest, column by column in their order, so that the choice doesn't hang on the order of rows."""
    rest = [c for c in bars.columns if c not in key]
    return bars.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_bar")).select(*key, "_bar.*").select(*bars.columns) if rest else bars.distinct()


def _dated(bars: DataFrame, partitions) -> DataFrame:
    return bars.withColumn("date", F.to_date("ts_event")) if "date" in partitions and "date" not in bars.columns else bars


def write_bars(bars: DataFrame, path: str, partitions=PARTITIONS, key=KEY) -> None:
    """One folder for each source, product, contract and date, rows in order of time within their files, one row a key.

    Folders that these bars belong to are replaced, all others stay. Spark cuts a folder's rows into several files where
    they are many. Each source has its own keys.
    """
    named = _dated(bars, partitions)
    key = [*(["source"] if "source" in partitions and "source" not in key else []), *key]
    dealt = one_per_key(named, key).hint("rebalance", *[F.col(c) for c in partitions]).sortWithinPartitions(*partitions, "ts_event")
    dealt.write.partitionBy(*partitions).options(compression="zstd", partitionOverwriteMode="dynamic").mode("overwrite").parquet(path)


def merge_bars(bars: DataFrame, path: str, partitions=PARTITIONS, key=KEY) -> None:
    """Put bars into a table (or a new one): a row replaces the one of the same key, all others stay, each key once.

    Only the folders that these bars belong to are read and written. They are written beside the old ones and take their
    places when all tasks are done: a run that fails leaves the table as it was. One writer at a time.
    """
    spark, new = bars.sparkSession, _dated(bars, partitions)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        key_ = [*(["source"] if "source" in partitions and "source" not in key else []), *key]
        new = one_per_key(new, key_)
        old = spark.read.schema(new.schema).parquet(path)
        touched = join_on(old, new.select(*partitions).distinct(), partitions, "left_semi")
        new = join_on(touched, new.select(*key_), key_, "left_anti").unionByName(new)
    write_bars(new, path, partitions, key)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def file_digests(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """(path, size, sha256) of the files of paths(path), URIs as Spark gives them, each read in blocks by the task that has its row."""

    def run(batches):
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                system, at = pa.fs.FileSystem.from_uri(path)
                digest, size = hashlib.sha256(), 0
                with system.open_input_stream(at) as f:
                    while block := f.read(1 << 20):
                        digest.update(block)
                        size += len(block)
                out.append((path, size, digest.hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["path", "size", "sha256"])

    return paths.select("path").mapInArrow(run, "path string, size long, sha256 string")


def manifest(spark: SparkSession, path: str, **facts) -> str:
    """JSON with the given facts, each file's rows and digest, and the row count; dataset_id follows from the facts.

    One entry a file comes to the driver, as the manifest is one text.
    """
    rows = spark.read.parquet(path).groupBy(F.input_file_name().alias("path")).agg(F.count("*").alias("rows"))
    files = rows.join(file_digests(spark, rows), "path").withColumn("path", F.url_decode("path")).orderBy("path").collect()
    name = hashlib.sha256(json.dumps(facts, sort_keys=True, default=str).encode()).hexdigest()[:12]
    listed = [{"path": r.path, "rows": r.rows, "sha256": r.sha256} for r in files]
    return json.dumps({"dataset_id": facts.get("dataset_id", f"bars-{name}"), **facts, "files": listed, "row_count": sum(r.rows for r in files)}, indent=1, default=str)


def _relative(spark: SparkSession, path: str, column: Column) -> Column:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri().getPath().rstrip("/")
    return F.regexp_replace(F.url_decode(column), "^.*?" + "".join(c if c.isalnum() or c in "/_-" else f"\\{c}" for c in root) + "/", "")


def file_table(spark: SparkSession, path: str) -> DataFrame:
    """(path within the table, rows, size, sha256) of each file of a bar table; files without rows have none."""
    rows = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"))
    return join_on(rows, file_digests(spark, rows), ["path"]).withColumn("path", _relative(spark, path, F.col("path")))


def _leaf() -> Column:
    return F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, LEAF)


def hash_tree(files: DataFrame) -> DataFrame:
    """(prefix, digest, files, rows, size): a leaf for each beginning of a path's digest, a node for each shorter beginning.

    A node's digest is that of its children's, so that tables with the same digest at the empty prefix hold the same files.
    """
    entry = F.concat_ws(" ", "path", F.col("rows").cast("string"), F.col("size").cast("string"), "sha256")
    join = lambda c: F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(c))).cast("binary"), 256).alias("digest")
    level = files.groupBy(_leaf().alias("prefix")).agg(join(entry), F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("size").alias("size"))
    out = level
    for digits in range(LEAF - 1, -1, -1):
        level = level.groupBy(F.substring("prefix", 1, digits).alias("prefix")).agg(join(F.concat("prefix", "digest")), *[F.sum(c).alias(c) for c in ("files", "rows", "size")])
        out = out.unionByName(level)
    return out


def write_manifest(spark: SparkSession, path: str, to: str) -> str:
    """Write a bar table's files and hash tree as two tables in the folder ``to``; returns the digest of the whole.

    To the driver comes that digest, however many files there are.
    """
    file_table(spark, path).withColumn("leaf", _leaf()).repartitionByRange(F.col("leaf")).sortWithinPartitions("leaf", "path").write.mode("overwrite").parquet(f"{to}/files")
    hash_tree(spark.read.parquet(f"{to}/files").drop("leaf")).coalesce(1).write.mode("overwrite").parquet(f"{to}/tree")  # at most 69,905 nodes
    whole = spark.read.parquet(f"{to}/tree").filter("prefix = ''").first()
    return whole.digest if whole else hashlib.sha256(b"").hexdigest()


def compare_manifests(spark: SparkSession, old: str, new: str) -> DataFrame:
    """(path, change, detail) of files that differ between two written manifests: ``missing``, ``extra`` or ``changed``.

    Only files below leaves whose digests differ are compared.
    """
    leaves = lambda at: spark.read.parquet(f"{at}/tree").filter(F.length("prefix") == LEAF).select("prefix", "digest")
    a, b = leaves(old), leaves(new).withColumnRenamed("digest", "now")
    differ = a.join(b, "prefix", "full_outer").filter(~F.col("digest").eqNullSafe(F.col("now"))).select(F.col("prefix").alias("leaf"))
    side = lambda at, name: spark.read.parquet(f"{at}/files").join(differ, "leaf", "left_semi").select("path", F.struct("rows", "size", "sha256").alias(name))
    both = side(old, "was").join(side(new, "now"), "path", "full_outer").filter(~F.col("was").eqNullSafe(F.col("now")))
    change = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "extra").otherwise("changed")
    what = F.concat_ws(", ", *[F.when(~F.col(f"was.{c}").eqNullSafe(F.col(f"now.{c}")), F.lit(c)) for c in ("rows", "size", "sha256")])
    return both.select("path", change.alias("change"), F.when(change == "changed", what).alias("detail"))
