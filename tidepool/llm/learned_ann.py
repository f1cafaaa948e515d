"""Operator 1: nearest neighbours by learned partitions.

On a bounded sample, a graph of nearest neighbours is cut into parts of equal size by recursive bisection (the second
eigenvector, then swaps that lower the cut). A small classifier learns from a vector the parts of its neighbours. All
vectors are indexed in the classifier's most probable part; a query goes to its most probable parts until these hold a
share of probability that gave the wanted recall on the sample, so that clear queries visit few parts and doubtful ones
more. There, all members are ranked by the exact inner product. The number of parts grows with the table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table
from .vectors import matrix, packed, parts, unpacked, usable


def neighbour_lists(queries: np.ndarray, base: np.ndarray, k: int, same: bool = False) -> np.ndarray:
    """Places in base of each query's k largest inner products (its own place left out, if the two are the same)."""
    out = []
    for at in range(0, len(queries), 128):
        scores = queries[at : at + 128] @ base.T
        if same:
            scores[np.arange(len(scores)), at + np.arange(len(scores))] = -np.inf
        out.append(np.argpartition(-scores, min(k, scores.shape[1]) - 1, axis=1)[:, :k].copy())  # not a view, which would keep the whole row
    return np.concatenate(out)


def balanced_partition(lists: np.ndarray, depth: int, seed: int = 1, rounds: int = 60) -> np.ndarray:
    """Part (0 to 2**depth - 1) of each node of the graph given by neighbour lists; parts differ in size by at most ``depth`` nodes."""
    n = len(lists)
    a, b = np.repeat(np.arange(n), lists.shape[1]), lists.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    part = np.zeros(n, np.int64)
    rng = np.random.default_rng(seed)
    for _ in range(depth):
        inside = part[a] == part[b]
        u, v = a[inside], b[inside]
        degree = np.maximum(np.bincount(u, minlength=n), 1).astype(float)
        sizes = np.maximum(np.bincount(part, degree), 1e-9)
        x = rng.standard_normal(n)
        for _ in range(rounds):  # power iteration of the lazy walk, less its constant vector, in all parts at once
            x = 0.5 * (x + np.bincount(u, x[v], n) / degree)
            x -= (np.bincount(part, x * degree) / sizes)[part]
            x /= np.sqrt(np.bincount(part, x * x * degree) / sizes + 1e-300)[part]
        order = np.lexsort((x, part))
        start = np.searchsorted(part[order], np.arange(part.max() + 2))
        half = np.zeros(n, np.int64)
        for s, e in zip(start, start[1:]):
            half[order[(s + e + 1) // 2 : e]] = 1
        for _ in range(4):  # swap the nodes that gain most, as many from either side
            gain = np.bincount(u, np.where(half[u] != half[v], 1.0, -1.0), n)
            for s, e in zip(start, start[1:]):
                own = order[s:e]
                left, right = (own[half[own] == h] for h in (0, 1))
                left, right = left[np.argsort(-gain[left])], right[np.argsort(-gain[right])]
                m = min(len(left), len(right)) // 8
                good = gain[left[:m]] + gain[right[:m]] > 2
                half[left[:m][good]], half[right[:m][good]] = 1, 0
        part = 2 * part + half
    return part


@dataclass
class Router:
    """A linear classifier with a small hidden layer beside it that gives a vector's parts by falling probability."""

    w0: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mass: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w0 + np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def part(self, x: np.ndarray) -> np.ndarray:
        return self.scores(x).argmax(axis=1)

    def mass_before(self, x: np.ndarray) -> np.ndarray:
        """For each part, the probability of all parts that are more probable."""
        p = np.exp(self.scores(x) - self.scores(x).max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        order = np.argsort(-p, axis=1, kind="stable")
        ranked = np.take_along_axis(p, order, axis=1)
        out = np.empty_like(p)
        np.put_along_axis(out, order, np.cumsum(ranked, axis=1) - ranked, axis=1)
        return out

    def wanted(self, x: np.ndarray) -> np.ndarray:
        """Whether a query visits a part; the most probable one always."""
        return self.mass_before(x) <= self.mass


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = 16, epochs: int = 12, rate: float = 0.001, seed: int = 1) -> Router:
    """Softmax regression on target distributions by Adam; the linear part starts at the parts' mean directions."""
    rng = np.random.default_rng(seed)
    scale = 1 / max(float(np.sqrt((x**2).mean())), 1e-300)
    z, (d, k) = x * scale, (x.shape[1], target.shape[1])
    mean = np.stack([column @ z for column in target.T])  # without a copy of the targets in double precision
    mean /= np.maximum(np.linalg.norm(mean, axis=1)[:, None], 1e-12)
    p = [2 * mean.T, rng.standard_normal((d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.standard_normal((hidden, k)) * 0.1 * np.sqrt(1 / hidden), np.zeros(k)]
    m, s, t = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    steps = epochs * -(-len(z) // 256)
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for at in range(0, len(z), 256):
            i = order[at : at + 256]
            h = np.maximum(z[i] @ p[1] + p[2], 0)
            o = z[i] @ p[0] + h @ p[3] + p[4]
            o = np.exp(o - o.max(axis=1, keepdims=True))
            g = (o / o.sum(axis=1, keepdims=True) - target[i]) / len(i)
            gh = (g @ p[3].T) * (h > 0)
            grads, t = [z[i].T @ g, z[i].T @ gh, gh.sum(0), h.T @ g, g.sum(0)], t + 1
            for j, y in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * y
                s[j] = 0.999 * s[j] + 0.001 * y * y
                p[j] = p[j] - rate * (1 - t / (steps + 1)) * (m[j] / (1 - 0.9**t)) / (np.sqrt(s[j] / (1 - 0.999**t)) + 1e-8)
    return Router(p[0] * scale, p[1] * scale, *p[2:])


def fit_router(sample: np.ndarray, depth: int, k: int, recall: float, seed: int = 1) -> Router:
    """Cut the sample's graph, train on nine tenths of it, and set the mass to visit by the recall for the last tenth."""
    held = np.arange(len(sample)) % 10 == 9
    base, queries = sample[~held], sample[held]
    lists = neighbour_lists(base, base, min(20, len(base) - 1), same=True)
    part = balanced_partition(lists, depth, seed)
    target = np.zeros((len(base), 1 << depth), np.float32)
    np.add.at(target, (np.arange(len(base)), part), 2.0)
    for column in lists.T:
        np.add.at(target, (np.arange(len(base)), part[column]), 1.0)
    target /= target.sum(axis=1, keepdims=True)
    router = train_router(base, target, seed=seed)
    if depth and len(queries):
        true, own = neighbour_lists(queries, base, min(k, len(base))), np.concatenate([router.part(base[i : i + 2048]) for i in range(0, len(base), 2048)])
        needed = np.take_along_axis(router.mass_before(queries), own[true], axis=1).ravel()
        router.mass = float(np.quantile(needed, recall, method="higher"))
    return router


def depth_for(rows: int, sample: int, member: int = 64, fitted: int = 32) -> int:
    """So many bisections that a part has ``member`` rows or more, and ``fitted`` or more of the sample's."""
    return max(0, min(int(np.log2(max(rows / member, 1))), int(np.log2(max(sample / fitted, 1)))))


def runs(batch, keys: list[str]):
    """Runs of equal keys of a batch: the key, then its other columns."""
    get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
    key = [get(c) for c in keys]
    new = np.zeros(batch.num_rows, bool)
    for c in key:
        new[1:] |= c[1:] != c[:-1]
    edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows] if batch.num_rows else []
    others = [get(c) for c in batch.schema.names if c not in keys]
    for s, e in zip(edges, edges[1:]):
        yield tuple(c[s].item() for c in key), *(c[s:e] for c in others)


class Best:
    """The best members so far of each query of a slice: at most ``keep`` of each, whatever number has passed by."""

    def __init__(self, wanted: np.ndarray, x: np.ndarray, query: np.ndarray, keep: int, together: int):
        self.wanted, self.x, self.query, self.keep, self.together = wanted, unpacked(x), query, keep, together
        self.score = np.full((len(query), keep), -np.inf)
        self.least = np.full((len(query), keep), np.iinfo(np.int64).max)  # smallest id of each member, for ties
        self.ids = np.empty((len(query), keep), object)

    def rank(self, cells: list) -> None:
        """Members as (part, packed vector, ids), sorted by part."""
        if not cells:
            return
        part, v, ids = (np.concatenate(c) for c in zip(*cells))
        base, least = unpacked(v), np.array([i[0] for i in ids])
        ends = np.searchsorted(part, np.arange(self.together + 1))
        cut, keep = len(part), self.keep
        for at in range(0, len(self.query), 256):
            x, bits = self.x[at : at + 256], self.wanted[at : at + 256]
            scores = np.full((len(x), cut), -np.inf)
            for p in range(self.together):
                asks_it = np.flatnonzero(bits >> p & 1)
                if len(asks_it) and ends[p] < ends[p + 1]:
                    scores[asks_it, ends[p] : ends[p + 1]] = x[asks_it] @ base[ends[p] : ends[p + 1]].T
            for q, s in enumerate(scores, at):
                lowest = max(self.score[q, -1], np.partition(s, -keep)[-keep] if cut > keep else -np.inf)
                near = np.flatnonzero((s >= lowest) & (s > -np.inf))
                if len(near):
                    score, first = np.concatenate([self.score[q], s[near]]), np.concatenate([self.least[q], least[near]])
                    order = np.lexsort((first, -score))[:keep]
                    self.score[q], self.least[q] = score[order], first[order]
                    self.ids[q] = np.concatenate([self.ids[q], ids[near]])[order]

    def rows(self):
        for at in range(0, len(self.query), 256):
            score, ids = self.score[at : at + 256], self.ids[at : at + 256]
            row, place = np.nonzero(score > -np.inf)
            if len(row):
                columns = [pa.array(self.query[at + row], pa.int64()), pa.array(score[row, place]), pa.array(ids[row, place].tolist(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "score", "ids"])


def search(vectors: DataFrame, is_query, k: int = 20, sample: int = 16_384, depth: int | None = None, recall: float = 0.93, cell: int = 8192, slice_: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products (double precision) for each row of vectors(vec_id, embedding) with ``is_query``.

    The router is fitted on at most ``sample`` different vectors (those with the smallest hashes), in 2**depth parts (if
    not given: by depth_for(), from one part for less than 128 vectors to 512 with this sample); all vectors are indexed
    and all members of the visited parts ranked. Neighbouring parts are kept in groups, so that a query travels once for
    each group. A group's queries are cut into slices of about ``slice_``; for each slice its members pass by in cells of
    ``cell``, and a query keeps its k + 1 best: out of the ranking come at most so many rows for each query and group.
    Equal vectors are searched, and ranked, as one: of each class, the k + 1 smallest vec_ids can appear in a result. Ties
    go to the smaller vec_id; a query's own vec_id isn't returned.

    Vectors null, empty, zero or with null or non-finite components take no part, nor do those of another length than
    most, nor rows with null vec_id; repeated rows count once; other columns are ignored; an empty table gives an empty
    result.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").alias("vector"), is_query.alias("query")).filter(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = settle(rows.filter(F.size("vector") == lengths.d).distinct())
    first = Window.partitionBy("vector").orderBy("vec_id")
    classes = rows.select("vector", "vec_id", F.row_number().over(first).alias("n")).filter(F.col("n") <= k + 1)
    classes = settle(classes.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asked = rows.filter("query").select("vec_id", "vector")
    queries = asked.groupBy("vector").agg(F.min("vec_id").alias("query_id"))

    some = classes.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(sample).toArrow()
    x = matrix(some.column(0).combine_chunks())
    depth = depth_for(classes.count(), len(x)) if depth is None else depth
    together = min(64, max(1, (1 << depth) // 8))  # parts of a group: eight groups, so that a query gets as many lists at every size
    router = spark.sparkContext.broadcast(fit_router(x, depth, k, recall))  # size fixed by dimension, hidden units and parts

    def to_groups(batches):
        for batch in batches:
            v = matrix(batch.column(0))
            if len(v):
                part = router.value.part(v)
                yield pa.RecordBatch.from_arrays([pa.array(part // together, pa.int32()), pa.array(part % together, pa.int64()), packed(v), batch.column(1)], ["group", "part", "x", "ids"])

    def to_probes(batches):
        for batch in batches:
            v = matrix(batch.column(0))
            if len(v):
                wanted = router.value.wanted(v)
                wanted = np.pad(wanted, ((0, 0), (0, -wanted.shape[1] % together))).reshape(len(v), -1, together)
                bits = (wanted * (np.uint64(1) << np.arange(together, dtype=np.uint64))).sum(axis=2, dtype=np.uint64).view(np.int64)
                row, group = np.nonzero(bits)
                again = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(bits[row, group], pa.int64()), packed(v).take(again), batch.column(1).take(again)], ["group", "part", "x", "query_id"])

    members = settle(classes.select("vector", "ids").mapInArrow(to_groups, "group int, part long, x binary, ids array<long>"))
    probes = settle(queries.select("vector", "query_id").mapInArrow(to_probes, "group int, part long, x binary, query_id long"))
    asks = {r.group: r.n for r in probes.groupBy("group").agg(F.count("*").alias("n")).collect()}  # a row a group of parts
    slices = F.element_at(F.create_map(*[F.lit(y) for p in range(-(-(1 << depth) // together)) for y in (p, max(1, -(-asks.get(p, 0) // slice_)))]), F.col("group"))
    left = probes.select("group", F.pmod(F.xxhash64("query_id"), slices).cast("int").alias("slice"), F.lit(0).alias("kind"), "part", "x", F.array().cast("array<long>").alias("ids"), "query_id")
    right = members.select("group", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), F.lit(1).alias("kind"), "part", "x", "ids", F.lit(0).cast("long").alias("query_id"))
    block = ["group", "slice"]
    dealt = left.unionByName(right).repartition(parts(rows), *block).sortWithinPartitions(*block, "kind", F.when(F.col("kind") == 1, F.col("part")))

    def rank(batches):
        """A slice's queries come first and are held; its group's members pass by, and each query keeps its best so far."""
        at, asked_, wait = None, [], []
        best: Best | None = None
        for batch in batches:
            for key, kind, part, v, ids, query in runs(batch, block):
                if key != at:
                    if best is not None:
                        best.rank(wait)
                        yield from best.rows()
                    at, asked_, wait, best = key, [], [], None
                queries_ = int((kind == 0).sum())
                if queries_:
                    asked_.append((part[:queries_], v[:queries_], query[:queries_]))
                if queries_ < len(kind):
                    best = best or (Best(*(np.concatenate(c) for c in zip(*asked_)), k + 1, together) if asked_ else None)
                    wait.append((part[queries_:], v[queries_:], ids[queries_:]))
                    if sum(len(w[0]) for w in wait) >= cell:
                        if best is not None:
                            best.rank(wait)
                        wait = []
        if best is not None:
            best.rank(wait)
            yield from best.rows()

    found = dealt.mapInArrow(rank, "query_id long, score double, ids array<long>").select("query_id", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    lists = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))
    lists = queries.join(lists, "query_id").select("vector", "near")
    near = F.slice(F.filter("near", lambda y: y["vec_id"] != F.col("id")), 1, k)
    out = asked.withColumnRenamed("vec_id", "id").join(lists, "vector").select("id", F.posexplode(near).alias("at", "y"))
    return out.select(F.col("id").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("y.vec_id").alias("vec_id"), F.col("y.score").alias("score"))


def op1_learned_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)
