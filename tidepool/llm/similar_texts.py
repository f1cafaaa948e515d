"""Near copies by exact Jaccard similarity of word shingles, for the pipeline's SimHash stage.

SimHash alone can't reach a similarity of 0.8: there two texts differ in about 10 of 64 bits, where an index by blocks of
bits no longer separates. So SimHash links and equal keys of banded min-hashes are candidates only. Each candidate is
compared by its whole sets of shingles; what shares a key and isn't yet joined after that is compared pair by pair.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, discard, join_side, settle
from .vectors import groups, parts

BANDS, ROWS = 24, 4  # a pair of similarity 0.8 shares no key at odds of (1 - 0.8^4)^24, about 3 in a million


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of a text's different word shingles; words and short texts as in simhash.fingerprint."""
    found = (text or "").encode().lower().split()
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined)] if found else [], np.uint64)
    stop = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    start = [0, *stop[:-words].tolist()]
    return np.unique(np.array([digest(joined[a : b - 1]) for a, b in zip(start, stop[words - 1 :].tolist())], np.uint64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band: the hash of ROWS minima, each over the shingles under another hash function."""
    if not len(shingles):
        return np.zeros(BANDS, np.int64)
    rng = np.random.default_rng(5)
    times, plus = (rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(shingles), 1024):
        x = shingles[at : at + 1024, None] * (2 * times + np.uint64(1)) + plus
        least = np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(m.tobytes()) for m in least.reshape(BANDS, ROWS)], np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both) >= least


def signatures(rows: DataFrame, words: int, size: int = 256) -> DataFrame:
    """row, same (128-bit digest of the set of shingles), fp (SimHash) and bands of each of rows(row, text)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                texts = part.column(1).to_pylist()
                sets = [shingle_set(t, words) for t in texts]
                fp = simhash.fingerprint(texts, words).view(np.int64)
                same = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
                bands = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), same, pa.array(fp), bands], ["row", "same", "fp", "bands"])

    return rows.select("row", "text").mapInArrow(run, "row long, same binary, fp long, bands array<long>")


def sets_of(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles) for wanted(node, row)."""

    def run(batches):
        for batch in batches:
            sets = pa.array([shingle_set(t, words).tobytes() for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["node", "shingles"])

    return rows.select("row", "text").join(wanted, "row").select("node", "text").mapInArrow(run, "node long, shingles binary")


def true_links(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of pairs(a, b) whose sets are similar."""
    names = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set"))

    def run(batches):
        for batch in batches:
            fits = [similar(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64), least) for a, b in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    both = join_side(pairs).join(names("a"), "a").join(names("b"), "b")
    return both.select("a", "b", "a_set", "b_set").mapInArrow(run, "a long, b long")


def rest_links(members: DataFrame, least: float, hot: int) -> DataFrame:
    """Links between the components of each bucket: members(band, key, node, component, shingles).

    All pairs of a bucket that nothing joins yet are compared. A bucket of more than ``hot`` members is cut into slices,
    each pair of slices in a task of its own.
    """
    names = ["band", "key", "i", "j"]
    size = members.groupBy("band", "key").agg(F.count("*").alias("size"))
    rows = members.join(join_side(size), ["band", "key"])
    slices = F.ceil(F.col("size") / hot).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), slices).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), slices - 1)))
    rows = rows.select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "shingles")
    dealt = rows.repartition(parts(rows), *names).sortWithinPartitions(*names)

    def run(batches):
        for key, own, node, component, shingles in groups(batches, names, ["own", "node", "component", "shingles"]):
            sets = [np.frombuffer(s, np.uint64) for s in shingles]
            root, left, out = component.copy(), own == key[2], []
            for n in range(len(node)):
                apart = root[n + 1 :] != root[n]
                if key[2] != key[3]:
                    apart &= left[n + 1 :] != left[n]
                for m in (np.flatnonzero(apart) + n + 1).tolist():
                    if root[m] != root[n] and similar(sets[n], sets[m], least):
                        out.append((node[n], node[m]))
                        root[root == root[m]] = root[n]
            if out:
                a, b = np.array(out, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.select(*names, "own", "node", "component", "shingles").mapInArrow(run, "a long, b long")


def drop_near_copies(docs: DataFrame, words: int = 5, least: float = 0.8, hot: int = 512) -> DataFrame:
    """The rows of docs(doc_id, text, ...) without near copies: one row of each component of links.

    Rows link if the Jaccard similarity of their sets of ``words``-word shingles is at least ``least``; texts without
    words are alike. Each row is a node of its own, whether its doc_id is null or repeated: of a component the row with
    the smallest doc_id stays (null last; of equal ones that with the smallest hash of its text). All columns stay. Texts of any length are
    read whole; an empty table gives an empty result.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    numbered = settle(docs.select(F.struct(*columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "zstd")
    rows = numbered.select("row", "doc.text")
    named = numbered.select("row", F.struct(F.col("doc.doc_id").isNull().alias("nameless"), "doc.doc_id", F.xxhash64("doc.text").alias("hash"), "row").alias("name"))
    found = settle(signatures(rows, words))
    one = found.join(named, "row").groupBy("same").agg(F.min("name").alias("best"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    classes = settle(one.drop("same").withColumn("node", F.monotonically_increasing_id()))
    discard(found)
    keys = classes.select("node", F.posexplode(F.concat("bands", F.array("fp"))).alias("band", "key"))
    sizes = keys.groupBy("band", "key").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    buckets = settle(keys.join(join_side(sizes), ["band", "key"]))
    bits = simhash.links(classes.groupBy("fp").agg(F.min("node").alias("node")))
    stars = buckets.filter("node != first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    pairs = settle(stars.unionByName(bits.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct())
    ends = buckets.select("node").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    sets = settle(sets_of(rows, classes.join(ends, "node").select("node", "best.row"), words))
    links = settle(true_links(pairs, sets, least))
    known = components(links)
    placed = settle(buckets.drop("first").join(known, "node", "left").withColumn("component", F.coalesce("component", "node")))
    split = placed.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("band", "key")
    open_ = placed.join(join_side(split), ["band", "key"]).join(sets, "node")
    links = links.unionByName(settle(rest_links(open_, least, hot)))
    joined = components(links)
    discard(buckets, pairs, sets, placed)
    grouped = classes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    kept = grouped.groupBy("component").agg(F.min("best").alias("best")).select("best.row")
    return numbered.join(kept, "row").select("doc.*")
