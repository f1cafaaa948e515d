"""A corpus pipeline: toxicity filter, SimHash near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one gets it as Parquet. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import packing, similar_texts, suffix_dedup, toxicity
from tidepool.llm.common import discard, settle, table


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of their own labels finds toxic go."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows that links of five-word Jaccard similarity 0.8 or more connect, the one with the smallest doc_id stays.

    Each row is a document of its own: of rows that repeat a doc_id or have none, only near copies go."""
    return similar_texts.drop_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes or more that also stand elsewhere are cut from the texts; every document stays."""
    return suffix_dedup.remove_repeats(docs)


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts in windows of token ids: each piece's ids, and their CRC-32."""
    return packing.pack_documents(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("toxicity", toxic_documents), ("simhash", near_duplicates), ("suffix", repeated_passages), ("packing", packed_windows)]
ORACLE_SQL = None  # SQL expresses none of the stages; tests/llm holds the whole against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
