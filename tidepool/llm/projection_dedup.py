"""Operator 9: embedding near-duplicates by sorted projection passes.

Each pass hashes a vector, less the mean of a sample, to the signs of random projections, sorts all vectors by them and
compares each with a bounded window of those before it, also across the borders of tasks. How many passes are needed for
a stated chance of missing a lone pair is measured on the sample: pairs of just the least similarity are laid into it, and
their distance in the order is carried to the table's size. Rows travel as half-precision sketches; pairs whose sketches
leave doubt are verified by the original vectors. Verified pairs of all passes are united. A window can't hold a large
group whole, so within each component found, all pairs are then compared in blocks: links that the windows missed are
counted, too.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, join_side, settle, table
from .vectors import groups, matrix, packed, parts, unpacked, usable

BITS = 63
DOUBT = 0.0012  # more than half precision can change an inner product of unit vectors (2**-10, and what is below its range)
TOGETHER = 24  # passes that are sorted at once


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no norm overflows
    return x / np.linalg.norm(x, axis=1)[:, None]


def key_of(units: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The signs of BITS projections as one whole number."""
    return (units @ planes > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def planes_of(seed: int, size: int, number: int) -> np.ndarray:
    return np.random.default_rng([seed, size, number]).standard_normal((size, BITS))


def passes_needed(sample: np.ndarray, rows: int, least: float, window: int, miss: float, seed: int = 0) -> tuple[int, float]:
    """Passes after which a pair of similarity ``least`` among ``rows`` vectors like the sample's is missed at odds of at
    most ``miss``, and the chance of one pass.

    Each test pair is a vector of the sample and one turned from it towards another, so it lies where the vectors are.
    """
    if rows <= window or len(sample) < 2:
        return 1, 1.0
    rng = np.random.default_rng([seed, 7])
    units = unit_rows(sample)
    a, b = rng.integers(0, len(units), (2, 512))
    x, way = units[a], units[b] - (units[a] * units[b]).sum(axis=1)[:, None] * units[a]
    fine = np.linalg.norm(way, axis=1) > 1e-6
    if not fine.any():
        return 1, 1.0
    x, way = x[fine], unit_rows(way[fine])
    y = least * x + math.sqrt(1 - least * least) * way
    mean = units.mean(axis=0)
    apart = []
    for number in range(12):
        planes = planes_of(seed + 1, units.shape[1], number)
        order = np.sort(key_of(units - mean, planes))
        apart.append(np.abs(np.searchsorted(order, key_of(x - mean, planes)) - np.searchsorted(order, key_of(y - mean, planes))))
    apart = np.concatenate(apart)
    steps = np.array([4, 8, 16, 32, 64, 128])
    near = np.array([max((apart <= s).mean(), 1e-4) for s in steps])
    reach = window * len(units) / rows  # the window in places of the sample
    power = max(0.0, np.polyfit(np.log(steps), np.log(near), 1)[0])  # a shared prefix grows by its logarithm
    chance = float((apart <= reach).mean()) if reach >= 4 else float(near[0] * (reach / 4) ** power)
    chance = min(max(chance, 1e-4), 0.999)
    return max(4, math.ceil(math.log(miss) / math.log(1 - chance))), chance


def sort_keys(named: DataFrame, numbers: range, means: dict[int, np.ndarray], seed: int) -> DataFrame:
    """(pass, size, key, node, x): a row for each vector and pass; x is its unit vector in half precision."""
    names = ["pass", "size", "key", "node", "x"]

    def run(batches):
        planes: dict[int, list] = {}
        for batch in batches:
            sizes = np.array(pa.compute.list_value_length(batch.column(1)))
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                for some in np.array_split(at, -(-len(at) * d // (1 << 20))):
                    x = unit_rows(matrix(batch.column(1).take(pa.array(some))))
                    if d not in planes:
                        planes[d] = [planes_of(seed, d, n) for n in numbers]
                    node = batch.column(0).take(pa.array(some))
                    sketch = pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())
                    centred = x - means.get(d, 0.0)
                    for n, p in zip(numbers, planes[d]):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), n, np.int32)), pa.array(np.full(len(x), d, np.int32)), pa.array(key_of(centred, p)), node, sketch], names)

    return named.select("node", "vector").mapInArrow(run, "pass int, size int, key long, node long, x binary")


def sketches(cells) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.float16).reshape(len(cells), -1).astype(np.float32)


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unite i and j in the forest ``root`` (in place, kept flat); the unions made, as pairs of places."""
    made = []
    while True:
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            return made
        i, j = i[differ], j[differ]
        high, low = np.maximum(a[differ], b[differ]), np.minimum(a[differ], b[differ])
        np.minimum.at(root, high, low)
        high = np.unique(high)
        made.append((high, root[high].copy()))
        while (root != root[root]).any():
            root[:] = root[root]


def links_in(ids: np.ndarray, x: np.ndarray, first: int, least: float, window: int, cut: int | None = None):
    """(kind, a, b) for rows from ``first`` on against those at most ``window`` before them: kind 0 connects what is surely
    linked, kind 1 are pairs in doubt that nothing sure connects. With ``cut``, only pairs from before it to behind it."""
    root = np.arange(len(ids))
    doubts = []
    for at in range(first, len(ids), 256):
        low = max(0, at - window)
        near = x[at : at + 256] @ x[low : at + 256 if cut is None else cut].T
        i, j = np.nonzero(near >= least - DOUBT)
        sure = near[i, j] >= least + DOUBT
        i, j = i + at, j + low
        fits = (j < i) & (i - j <= window)
        for a, b in joined(root, i[fits & sure], j[fits & sure]):
            yield 0, ids[a], ids[b]
        doubts.append((i[fits & ~sure], j[fits & ~sure]))
    for i, j in doubts:
        apart = root[i] != root[j]
        yield 1, ids[i[apart]], ids[j[apart]]


LINKS = ["kind", "a", "b", "border", "pass", "size", "x"]
LINK_SCHEMA = "kind int, a long, b long, border int, pass int, size int, x binary"


def link_rows(kind: int, a: np.ndarray, b: np.ndarray, border=None, of=(None, None), x=None):
    n = len(a)
    fixed = [pa.array([v] * n, pa.int32()) for v in (border, *of)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), *fixed, x if x is not None else pa.nulls(n, pa.binary())], LINKS)


def window_links(sorted_rows: DataFrame, least: float, window: int) -> DataFrame:
    """Rows of links_in for each pass of sorted partitions; and of kind 2, the first and the last ``window`` rows of each
    partition, by the border they lie at (a: node; b: place, negative before the border)."""

    def run(batches):
        here = TaskContext.get().partitionId()
        held = None  # (pass and size, nodes, cells) of the last rows
        seen = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            pass_, size, node = (batch.column(i).to_numpy() for i in (0, 1, 3))
            cells = batch.column(4)
            at = [0, *(np.flatnonzero((pass_[1:] != pass_[:-1]) | (size[1:] != size[:-1])) + 1).tolist(), batch.num_rows]
            for s, e in zip(at, at[1:]):
                key = (int(pass_[s]), int(size[s]))
                ids, own = node[s:e], cells.slice(s, e - s).to_pylist()
                if here and seen < window:
                    n = min(window - seen, e - s)
                    yield link_rows(2, ids[:n], np.arange(seen, seen + n), here - 1, key, pa.array(own[:n], pa.binary()))
                seen += e - s
                before = 0
                if held and held[0] == key:
                    before = len(held[1])
                    ids, own = np.concatenate([held[1], ids]), held[2] + own
                for kind, a, b in links_in(ids, sketches(own), before, least, window):
                    if len(a):
                        yield link_rows(kind, a, b)
                held = (key, ids[-window:], own[-window:])
        if held:
            n = len(held[1])
            yield link_rows(2, held[1], np.arange(-n, 0), here, held[0], pa.array(held[2], pa.binary()))

    return sorted_rows.mapInArrow(run, LINK_SCHEMA)


def border_links(edges: DataFrame, least: float, window: int) -> DataFrame:
    """Rows of links_in for pairs of which one lies just before and one just behind a border between partitions."""
    keys = ["border", "pass", "size"]
    dealt = edges.repartition(parts(edges), *keys).sortWithinPartitions(*keys, "b")

    def run(batches):
        for _, node, place, cells in groups(batches, keys, ["a", "b", "x"]):
            cut = int((place < 0).sum())
            if 0 < cut < len(node):
                for kind, a, b in links_in(node, sketches(cells.tolist()), cut, least, window, cut):
                    if len(a):
                        yield link_rows(kind, a, b)

    return dealt.select(*LINKS).mapInArrow(run, LINK_SCHEMA)


def true_pairs(pairs: DataFrame, named: DataFrame, least: float) -> DataFrame:
    """Those of pairs(a, b) whose vectors' cosine is at least ``least`` in double precision."""
    names = lambda c: named.select(F.col("node").alias(c), F.col("vector").alias(f"{c}_vector"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                fits = [float((unit_rows(np.array([a.as_py()], float)) @ unit_rows(np.array([b.as_py()], float)).T)[0, 0]) >= least for a, b in zip(batch.column(2), batch.column(3))]
                yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    both = join_side(pairs).join(names("a"), "a").join(names("b"), "b")
    return both.select("a", "b", "a_vector", "b_vector").mapInArrow(run, "a long, b long")


def count_links(members: DataFrame, least: float, block: int) -> DataFrame:
    """(node, n_links): for each of members(node, component, n, vector) the sum of n over the others of its component that link with it.

    A component is cut into slices of about ``block`` members (smaller ones into up to eight); each pair of slices is one
    block of comparisons, so the largest component is spread over many tasks.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    rows = members.join(join_side(sizes), "component")
    slices = F.greatest(F.ceil(F.col("size") / block), F.least(F.lit(8), F.ceil(8 * F.col("size") / block))).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), slices).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), slices - 1)))
    keys = ["component", "i", "j"]
    rows = rows.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "vector")
    dealt = rows.repartition(parts(rows), *keys).sortWithinPartitions(*keys, "own", "node")

    def run(batches):
        for key, own, node, n, vector in groups(batches, keys, ["own", "node", "n", "vector"]):
            x, cut = unit_rows(np.array(vector.tolist(), float)), int((own == key[1]).sum())
            if key[1] == key[2]:
                near = x @ x.T >= least
                np.fill_diagonal(near, False)
                links = near @ n
            else:
                near = x[:cut] @ x[cut:].T >= least
                links = np.concatenate([near @ n[cut:], n[:cut] @ near])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links.astype(np.int64))], ["node", "n_links"])

    return dealt.mapInArrow(run, "node long, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links"))


def near_pairs(named: DataFrame, least: float, miss: float, window: int, sample: int, seed: int) -> DataFrame:
    """Links (a, b) that connect what pairs found in any pass connect; named is (node, vector, n)."""
    rows = named.count()
    sizes = named.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return named.sparkSession.createDataFrame([], "a long, b long")
    some = named.filter(F.size("vector") == sizes.d).select("vector").orderBy(F.xxhash64("vector"), "vector").limit(sample).collect()
    some = np.array([r.vector for r in some], float)
    passes, _ = passes_needed(some, rows, least, window, miss, seed)
    means = {sizes.d: unit_rows(some).mean(axis=0)}
    pairs = None
    for first in range(0, passes, TOGETHER):
        keyed = sort_keys(named, range(first, min(first + TOGETHER, passes)), means, seed)
        order = ["pass", "size", "key", "node"]
        tasks = max(1, min(parts(keyed), rows * min(TOGETHER, passes) // (16 * window)))
        found = settle(window_links(keyed.repartitionByRange(tasks, *order).sortWithinPartitions(*order), least, window))
        over = settle(border_links(found.filter("kind = 2"), least, window))
        both = found.filter("kind < 2").unionByName(over).select("kind", "a", "b")
        pairs = both if pairs is None else pairs.unionByName(both)
    doubt = pairs.filter("kind = 1").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return pairs.filter("kind = 0").select("a", "b").unionByName(true_pairs(doubt, named, least))


def near_vectors(vectors: DataFrame, least: float = 0.9, miss: float = 0.003, window: int = 512, block: int = 1024, sample: int = 4096, seed: int = 9) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors(vec_id, embedding).

    Links join vectors whose cosine is at least ``least``, in double precision. Pairs are searched among neighbours of
    sort orders, as many as a sample of at most ``sample`` vectors says are needed to miss a lone pair at odds of about
    ``miss``; whatever is in one component is compared in full. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing; vectors of different lengths don't link. Equal vectors are compared once and
    counted each. Repeated rows are vectors of their own; rows that share a vec_id but not the vector count as one node
    of the components; a null vec_id has component null. Other columns are ignored; an empty table gives an empty result.
    """
    rows = vectors.select("vec_id", F.when(usable(F.col("embedding")), F.col("embedding").cast("array<double>")).alias("vector"))
    classes = settle(rows.filter("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")))
    named = classes.filter("node is not null")
    found = settle(components(near_pairs(named, least, miss, window, sample, seed)))
    links = count_links(named.join(found, "node"), least, block)
    known = classes.join(found, "node", "left").join(links, "node", "left").select(
        "vector", F.coalesce("component", "node").alias("component_id"), (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
    )
    out = rows.join(known, "vector", "left")
    component = F.when(F.col("vector").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op9_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
