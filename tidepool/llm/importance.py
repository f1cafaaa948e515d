"""Importance resampling towards a target corpus: hashed word features, one weight a different text, Gumbel noise a document.

Identical texts are collapsed by grouping the full text. Features and the weight are computed once for each different text;
corpus counts are its counts times its copies; weights go back to documents by the text's SHA-256, and only then the noise
of each document is added, so that copies differ in noise alone.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_side, settle, table
from .vectors import parts

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall  # of texts whose A-Z are lower-cased
KNOWN = 1 << 18  # features whose buckets a task keeps in mind


class Buckets(dict):
    """Bucket of a feature's UTF-8 bytes."""

    def __init__(self, number: int):
        super().__init__()
        self.number = number

    def __missing__(self, feature: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[feature] = bucket = zlib.crc32(feature.encode()) % self.number
        return bucket


def features(text: str, most_words: int, buckets: Buckets) -> tuple[int, list[int]]:
    """Number of words, and the bucket of each run of 1 to ``most_words`` words, repeats included."""
    words = WORD(text.encode().lower().decode())
    out = list(map(buckets.__getitem__, words))
    for n in range(2, most_words + 1):
        out += [buckets[" ".join(words[i : i + n])] for i in range(len(words) - n + 1)]
    return len(words), out


def collapsed(texts: DataFrame, most_words: int, buckets: int) -> DataFrame:
    """key (SHA-256), copies, n_words and features (packed bucket numbers) of each different text; null is an empty text."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    names = ["key", "copies", "n_words", "features"]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        known = Buckets(buckets)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # few texts at a time, as each can be long
                part, out = batch.slice(at, 64), []
                for text, copies in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    n, found = features(text, most_words, known)
                    out.append((hashlib.sha256(text.encode()).digest(), copies, n, np.array(found, kind).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    once = texts.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("copies"))
    return once.mapInArrow(run, "key binary, copies long, n_words long, features binary")


def _unpack(buckets: int, cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, "<u2" if buckets <= 1 << 16 else "<u4")


def bucket_counts(once: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts, copies included: to the driver come at most ``buckets`` rows."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for copies, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                total += copies * np.bincount(_unpack(buckets, cell.as_py()), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = once.select("copies", "features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares), a bucket: add-one counts, in doubles."""
    b, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    ratio = [(float(t) + 1) * (s_all + b) / ((float(s) + 1) * (t_all + b)) for s, t in zip(raw.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def text_weights(once: DataFrame, gain: np.ndarray) -> DataFrame:
    """key, n_words, n_features and weight (floored mean gain; 0 without features) of each different text."""
    buckets = len(gain)

    def run(batches):
        for batch in batches:
            found = [_unpack(buckets, cell.as_py()) for cell in batch.column(2)]
            weight = [int(gain[f].sum()) // len(f) if len(f) else 0 for f in found]
            columns = [batch.column(0), batch.column(1), pa.array(map(len, found), pa.int64()), pa.array(weight, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_words", "n_features", "weight"])

    return once.select("key", "n_words", "features").mapInArrow(run, "key binary, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths from the document's id alone; a null id counts as an empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """df with its 1-based ``place`` in the given order: ranges of rows, sorted and numbered each, then the ranges' sizes."""
    dealt = df.repartitionByRange(parts(df), *order).sortWithinPartitions(*order)
    rows = settle(dealt.withColumn("_at", F.monotonically_increasing_id()))
    piece, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(piece.alias("_piece")).agg(F.count("*").alias("_n"))  # a row a partition
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    out = rows.withColumn("_piece", piece).join(F.broadcast(first), "_piece")
    return out.withColumn("place", F.col("_first") + row + 1).drop("_at", "_piece", "_first")


def importance(docs: DataFrame, target: DataFrame, keep: Sequence[str] = ("doc_id",), *, most_words: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: str = "2024") -> DataFrame:
    """row (struct of the columns ``keep``), n_words, n_features, weight, score and rank for each row of docs(doc_id, text).

    Of the N rows with at least ``least_words`` words the floor(percent * N / 100) of highest score are drawn and ranked;
    ties go to smaller doc_ids (null last), then to fewer features; other rows have a null rank. Null and empty texts have
    no words and weight 0; texts of any length are read whole; repeated rows are drawn each, with equal noise; extra
    columns don't matter, whatever their names; an empty table gives an empty result, and an empty target has no counts:
    rare words weigh more. ``target`` needs a column ``text``.
    """
    once = settle(collapsed(docs.select("text"), most_words, buckets))
    goal = collapsed(target.select("text"), most_words, buckets)
    gain = gains(bucket_counts(once, buckets), bucket_counts(goal, buckets))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("doc_id").alias("_id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("key"))
    scored = rows.join(join_side(text_weights(once, gain)), "key").drop("key").withColumn("score", F.col("weight") + noise(F.col("_id"), seed))
    scored = settle(scored)
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    ranked = in_order(able, F.desc("score"), F.asc_nulls_last("_id"), F.asc("n_features"), F.asc("weight"))
    ranked = ranked.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["row", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(rest.select(*columns))


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of docs, all their columns."""
    return importance(docs, target, docs.columns, **options).filter("rank is not null").select("row.*")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH bits AS (SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
words AS (SELECT doc_id, NULL AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT NULL, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
each AS (SELECT doc_id, item, unnest(w) AS word FROM words),
hashes AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM each)),
bucket AS (SELECT word, xor(list_reduce([4294967295] || list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM hashes, bits),
counts AS (SELECT b.bucket, count(*) FILTER (e.item IS NULL) AS s, count(*) FILTER (e.item IS NOT NULL) AS t FROM each e JOIN bucket b USING (word) GROUP BY ALL),
total AS (SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(sum(t) AS DOUBLE) AS t_all FROM counts),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS g FROM counts, total),
weights AS (SELECT e.doc_id, count(*) AS n, CAST(floor(CAST(sum(g) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM each e JOIN bucket USING (word) JOIN gain USING (bucket) WHERE e.item IS NULL GROUP BY e.doc_id),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM documents LEFT JOIN weights USING (doc_id)),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 10 * count(*) OVER () // 100 AS drawn FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM scored LEFT JOIN able USING (doc_id)
"""
