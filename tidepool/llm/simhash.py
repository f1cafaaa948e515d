"""Operator 6: SimHash near-duplicates by a Gray-order hierarchical index.

Equal fingerprints are one class. Two fingerprints that differ in at most ``most`` of 64 bits agree wholly on at least
two of ``most + 2`` blocks of bits, so classes are dealt out by each pair of blocks. Within such a bucket the
fingerprints are sorted by Gray rank and indexed: a node stands for a run of neighbours and keeps the bits on which all of
them agree, less those its parent keeps already. A search adds up the differences from node to node and drops a whole group once they exceed the limit.
Only links that join two components of a bucket leave it (a spanning forest, never all pairs).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, join_side, settle, table
from .vectors import groups, parts

FAN = 16


def fingerprint(texts: list[str | None], words: int = 4, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text: a bit is set if it is in over half of the hashes of its word shingles (repeats count).

    Words are runs without ASCII white space, A-Z lower-cased; a text with fewer words is one shingle; without: zero.
    """
    hashes, ends, digest = [], [0], xxhash.xxh64_intdigest
    for text in texts:
        found = (text or "").encode().lower().split()
        joined = b" ".join(found)
        if len(found) <= words:
            hashes += [digest(joined, seed)] if found else []
        else:
            stop = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
            start = [0, *stop[: -words].tolist()]
            hashes += [digest(joined[a : b - 1], seed) for a, b in zip(start, stop[words - 1 :].tolist())]
        ends.append(len(hashes))
    h, n = np.array(hashes, np.uint64), np.diff(ends)
    out = np.zeros(len(texts), np.uint64)
    # sums of 4 bits at a time in 16-bit lanes; runs of at most 60,000 hashes, so that no lane overflows
    cuts = np.unique(np.concatenate([np.array(ends[:-1], np.int64), *[np.arange(a, b, 60_000) for a, b in zip(ends, ends[1:]) if b - a > 60_000]])) if len(h) else []
    cuts = [c for c in cuts if c < len(h)]
    if not cuts:
        return out
    owner = np.searchsorted(ends, cuts, side="right") - 1
    for shift in range(16):
        lanes = np.add.reduceat((h >> np.uint64(shift)) & np.uint64(0x0001000100010001), cuts)
        for lane in range(4):
            count = np.bincount(owner, (lanes >> np.uint64(16 * lane)) & np.uint64(0xFFFF), len(texts)).astype(np.int64)
            out |= (2 * count > n).astype(np.uint64) << np.uint64(16 * lane + shift)
    return out


def fingerprints(docs: DataFrame, words: int = 4, rows: int = 256) -> DataFrame:
    """(doc_id, fp long) for each row of docs(doc_id, text)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                fp = fingerprint(part.column(1).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Fingerprints in Gray order under levels of nodes; ``fps`` is the sorted array, ``order`` the places in the input."""

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps = fps[self.order]
        level = [(self.fps, np.full(len(fps), ~np.uint64(0)))]  # value and agreed bits, leaves first
        while len(level[-1][0]) > FAN:
            value, agreed = level[-1]
            at = np.arange(0, len(value), FAN)
            both, either = np.bitwise_and.reduceat(value, at), np.bitwise_or.reduceat(value, at)
            level.append((both, ~(both ^ either) & np.bitwise_and.reduceat(agreed, at)))
        self.levels = []  # top first: value and the agreed bits that the parent doesn't hold
        for n, (value, agreed) in enumerate(level):
            above = np.repeat(level[n + 1][1], FAN)[: len(value)] if n + 1 < len(level) else np.uint64(0)
            self.levels.insert(0, (value, agreed & ~above))

    def within(self, fp: np.uint64, most: int) -> np.ndarray:
        """Places (in ``fps``) of all fingerprints that differ from fp in at most ``most`` bits."""
        at, differ = np.arange(len(self.levels[0][0])), 0
        for n, (value, own) in enumerate(self.levels):
            differ = differ + np.bitwise_count((value[at] ^ fp) & own[at]).astype(np.int64)
            near = differ <= most
            at, differ = at[near], differ[near]
            if n + 1 < len(self.levels):
                below = len(self.levels[n + 1][0])
                at = (at[:, None] * FAN + np.arange(FAN)).ravel()
                differ = np.repeat(differ, FAN)
                at, differ = at[at < below], differ[at < below]
        return at


def forest(fps: np.ndarray, most: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join what links of at most ``most`` differing bits connect; with ``left`` (booleans), only links between its two sides count."""
    if len(fps) < 2:
        return []
    index = GrayIndex(fps)
    group = np.arange(len(fps))  # by place in Gray order
    side = None if left is None else left[index.order]
    out = []
    for q in range(len(fps)):
        if side is not None and not side[q]:
            continue
        near = index.within(index.fps[q], most)
        near = near[near > q] if side is None else near[~side[near]]
        near = near[group[near] != group[q]]
        while len(near):
            j = near[0]
            out.append((int(index.order[q]), int(index.order[j])))
            group[group == group[j]] = group[q]
            near = near[group[near] != group[q]]
    return out


def links(classes: DataFrame, most: int = 4, hot: int = 4096) -> DataFrame:
    """Links (a, b) between the ``node``s of classes(fp, node), fp distinct, that connect all whose fp differ in <= most bits.

    A bucket of more than ``hot`` fingerprints is cut into slices by hash and handled as blocks of two slices each, in
    different tasks; nothing is left out.
    """
    blocks = most + 2
    edge = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << edge[i + 1]) - (1 << edge[i])) for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = [signed(block[i] | block[j]) for i, j in combinations(range(blocks), 2)]
    keys = F.array(*[F.struct(F.lit(n).alias("combo"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for n, m in enumerate(masks)])
    rows = settle(classes.select("fp", "node", F.explode(keys).alias("k")).select("fp", "node", "k.combo", "k.key"))
    size = rows.groupBy("combo", "key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(join_side(size), ["combo", "key"])  # whoever is alone in a bucket has no link there
    slices = F.ceil(F.col("n") / hot).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), slices).cast("int")
    other = F.explode(F.sequence(F.lit(0), slices - 1))
    rows = rows.select("fp", "node", "combo", "key", own.alias("own"), other.alias("other"))
    rows = rows.select("fp", "node", "combo", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    dealt = rows.repartition(parts(rows), "combo", "key", "i", "j").sortWithinPartitions("combo", "key", "i", "j")
    names = ["combo", "key", "i", "j"]

    def run(batches):
        for keys, fp, node, own in groups(batches, names, ["fp", "node", "own"]):
            fps = fp.view(np.uint64)
            left = own == keys[2] if keys[2] != keys[3] else None
            found = forest(fps, most, left)
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    return dealt.select(*names, "fp", "node", "own").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, most: int = 4) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable by links of at most ``most`` differing bits) for each row.

    Null and empty texts, and texts of white space alone, have fingerprint zero and link like any other; texts of any
    length are read whole; repeated rows each get a row; a row with null doc_id links nothing but gets the component of
    its fingerprint (null if no row has a doc_id); other columns are ignored; an empty table gives an empty result.
    """
    fps = settle(fingerprints(docs, words))
    classes = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(classes.filter("node is not null"), most))
    named = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
