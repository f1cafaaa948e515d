"""Nearest neighbours and near-duplicate vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import learned_ann, projection_dedup
from tidepool.llm.entry import op1_learned_ann, op9_projection_dedup

from .helpers import groups_of

VECTORS = "vec_id long, embedding array<double>, label string, node string, n string, query string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "l", "a", "b", "c") for i, v in rows], VECTORS)


def real(spark, path):
    rows = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()
    fine = [(r.vec_id, np.array(r.embedding, float)) for r in rows if r.embedding is not None and None not in r.embedding]
    return [(i, v) for i, v in fine if len(v) and np.isfinite(v).all() and v.any()], len(rows)


def nearest(rows, queries, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for i, v in queries:
        s = x @ v
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_search_is_exact_when_small_and_breaks_ties_by_id(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(-2, 3, 6)) for i in range(90)] + [(100 + i, [1, 1, 1, 1, 1, 1]) for i in range(40)]
    bad = [(200, None), (201, [0] * 6), (202, [1, None, 0, 0, 0, 0]), (203, [float("nan")] * 6), (204, [float("inf")] + [1] * 5), (205, []), (206, [1, 2])]
    rows = [(i, v) for i, v in rows if np.any(v)]
    df = frame(spark, rows + bad)
    got = {}
    for r in learned_ann.search(df.unionByName(df.limit(3)), F.col("vec_id") % 5 == 0, k=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = nearest([(i, np.array(v, float)) for i, v in rows], [(i, np.array(v, float)) for i, v in rows if i % 5 == 0], 7)
    assert got == want


def test_search_edges(spark):
    assert learned_ann.search(frame(spark, []), F.lit(True)).count() == 0
    assert learned_ann.search(frame(spark, [(1, None), (2, [0.0])]), F.lit(True)).count() == 0
    assert learned_ann.search(frame(spark, [(1, [1.0, 2.0])]), F.lit(True)).count() == 0
    few = learned_ann.search(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [2.0, 0.0])]), F.lit(True)).collect()
    assert len(few) == 6


def test_search_recall(spark):
    path = "/root/testdata/sf0.1"
    rows, _ = real(spark, path)
    want = nearest(rows, [(i, v) for i, v in rows if i % 20 == 0], 20)
    got = {}
    for r in op1_learned_ann(spark, path).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hit = sum(len({i for i, _ in w} & set(got[q])) for q, w in want.items())
    assert hit >= 0.9 * sum(len(w) for w in want.values())


@pytest.mark.parametrize("cell, slice_", [(8192, 32_768), (64, 20)])
def test_blocks_of_a_part_agree(spark, cell, slice_):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8)) for i in range(600)]
    got = learned_ann.search(frame(spark, rows), F.col("vec_id") % 10 == 0, k=5, depth=1, recall=1.0, cell=cell, slice_=slice_)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = nearest(rows, [x for x in rows if x[0] % 10 == 0], 5)
    assert sum(len({i for i, _ in w} & found[q]) for q, w in want.items()) >= 0.97 * 5 * len(want)


def test_a_query_keeps_as_many_rows_whatever_passes_by():
    rng = np.random.default_rng(5)
    x, base = rng.standard_normal((30, 6)), np.round(rng.standard_normal((900, 6)), 1)
    base[100:160] = base[:60]  # ties
    part = np.sort(rng.integers(0, 4, len(base)))
    wanted = rng.integers(1, 16, len(x))
    pack = lambda v: np.array([r.tobytes() for r in np.ascontiguousarray(v)], object)
    ids = np.empty(len(base), object)
    ids[:] = [[int(i)] for i in rng.permutation(len(base))]
    found = []
    for size in (900, 37):
        best = learned_ann.Best(wanted, pack(x), np.arange(len(x)), 6, 4)
        for at in range(0, len(base), size):
            best.rank([(part[at : at + size], pack(base[at : at + size]), ids[at : at + size])])
        rows = [r for b in best.rows() for r in b.to_pylist()]
        assert len(rows) <= 6 * len(x)
        found.append([(r["query_id"], round(r["score"], 9), r["ids"]) for r in rows])
    assert found[0] == found[1]
    for q in range(len(x)):
        able = [(-round(float(x[q] @ base[i]), 9), ids[i][0]) for i in range(len(base)) if wanted[q] >> part[i] & 1]
        assert [(-s, i[0]) for k, s, i in found[0] if k == q] == sorted(able)[:6]


def share_and_recall(x, k=20):
    """Of all vectors the share that a query ranks, and how many of its true neighbours are among them."""
    some = x[np.random.default_rng(1).permutation(len(x))[:16_384]]
    router = learned_ann.fit_router(some, learned_ann.depth_for(len(x), len(some)), k, 0.93)
    own = np.concatenate([router.part(x[i : i + 4096]) for i in range(0, len(x), 4096)])
    sizes = np.bincount(own, minlength=router.w0.shape[1])
    queries = np.arange(0, len(x), 20)
    wanted = router.wanted(x[queries])
    s = x[queries] @ x.T
    s[np.arange(len(queries)), queries] = -np.inf
    true = np.argpartition(-s, k, axis=1)[:, :k]
    return float((wanted @ sizes).mean() / len(x)), float(np.take_along_axis(wanted, own[true], axis=1).mean())


def test_routing_saves_more_as_tables_grow():
    """On vectors without structure, which are the hardest; at ten thousand, and on a clustered table."""
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    even = unit(rng.standard_normal((12_000, 64)))
    small, large = share_and_recall(even[:1500]), share_and_recall(even)
    assert small[1] >= 0.9 and large[1] >= 0.9
    assert large[0] < small[0] - 0.05 and large[0] < 0.7
    centres = unit(rng.standard_normal((80, 64)))
    share, recall = share_and_recall(unit(centres[rng.integers(0, 80, 12_000)] + 0.08 * rng.standard_normal((12_000, 64))))
    assert recall >= 0.9 and share < 0.1


def test_search_with_null_ids_and_repeated_rows(spark):
    rows = [(i, np.eye(4)[i % 4] + 0.01 * i) for i in range(12)]
    df = frame(spark, [*rows, *rows[:3], (None, [1.0, 0, 0, 0])])
    got = learned_ann.search(df, F.coalesce(F.col("vec_id") % 3 == 0, F.lit(True)), k=3).collect()
    assert {r.query_id for r in got} == {0, 3, 6, 9} and len(got) == 12 and all(r.vec_id is not None for r in got)


def plain_links(rows):
    unit = np.array([v / np.linalg.norm(v) for _, v in rows])
    return unit @ unit.T >= 0.9


def test_near_vectors_on_driver_rows(spark, sf_dir):
    rows, total = real(spark, sf_dir)
    near = plain_links(rows)
    got = {r.vec_id: r for r in op9_projection_dedup(spark, sf_dir).collect()}
    assert len(got) == total
    root = groups_of(len(rows), lambda i, j: near[i, j])
    ids = [i for i, _ in rows]
    for n, i in enumerate(ids):
        assert got[i].n_links == near[n].sum() - 1
        assert got[i].component_id == min(ids[j] for j in range(len(ids)) if root[j] == root[n])
        assert got[i].kept == (i == got[i].component_id)


def test_near_vectors_blocks_and_edges(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(16)
    rows = [(i, centre + 0.25 * rng.standard_normal(16)) for i in range(150)] + [(500 + i, rng.standard_normal(16)) for i in range(50)] + [(600 + i, centre) for i in range(30)]
    bad = [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, []), (704, [1.0, 2.0])]
    near = plain_links(rows)
    for block in (1024, 40):
        got = {r.vec_id: r for r in projection_dedup.near_vectors(frame(spark, rows + bad), window=16, block=block).collect()}
        assert [got[i].n_links for i, _ in rows] == (near.sum(axis=1) - 1).tolist()
        assert all(got[i].n_links == 0 and got[i].kept for i, _ in bad)
    assert projection_dedup.near_vectors(frame(spark, [])).count() == 0


@pytest.mark.parametrize("rows", [2000, 10_000, 40_000])
def test_lone_pairs_are_found_at_every_size(spark, rows):
    """Pairs of cosine 0.90 to 0.92 among vectors without structure, and the same in a cone of mutual cosine 0.5."""
    rng = np.random.default_rng(rows)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    for cone in (0.0, 0.5) if rows < 40_000 else (0.0,):
        axis = unit(rng.standard_normal(64))
        inside = lambda n: unit(np.sqrt(cone) * axis + np.sqrt(1 - cone) * unit(rng.standard_normal((n, 64))))
        x, pairs = inside(rows), 100
        way = inside(pairs)
        way = unit(way - (way * x[:pairs]).sum(axis=1)[:, None] * x[:pairs])
        c = rng.uniform(0.9001, 0.92, pairs)[:, None]
        x[pairs : 2 * pairs] = c * x[:pairs] + np.sqrt(1 - c * c) * way
        got = {r.vec_id: r for r in projection_dedup.near_vectors(frame(spark, list(enumerate(x)))).filter("n_links > 0").collect()}
        found = sum(i in got and got[i + pairs].component_id == got[i].component_id for i in range(pairs) if i + pairs in got)
        assert found >= 96, (rows, cone, found)


def test_doubtful_pairs_and_borders(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(32)
    x = projection_dedup.unit_rows(base + 0.26 * rng.standard_normal((400, 32)))
    half = x.astype(np.float16).astype(np.float32)
    exact = x @ x.T
    links = list(projection_dedup.links_in(np.arange(400), half, 0, 0.9, 400))
    sure = {(a, b) for kind, i, j in links if kind == 0 for a, b in zip(i.tolist(), j.tolist())}
    doubt = [(a, b) for kind, i, j in links if kind == 1 for a, b in zip(i.tolist(), j.tolist())]
    root = groups_of(400, lambda i, j: (i, j) in sure or (j, i) in sure)
    for i, j in zip(*np.nonzero(np.triu(exact >= 0.9, 1))):
        assert root[i] == root[j] or any({a, b} == {i, j} for a, b in doubt)
    assert all(abs(exact[a, b] - 0.9) < 0.0025 for a, b in doubt)


def test_vectors_with_null_shared_or_repeated_ids(spark):
    v, w = np.array([1.0, 2, 3]), np.array([-3.0, 1, 1])
    got = projection_dedup.near_vectors(frame(spark, [(1, v), (1, v), (2, v), (3, w), (3, 2 * v), (None, v), (None, w)])).collect()
    assert len(got) == 7
    assert sorted(r.n_links for r in got if r.vec_id in (1, 2)) == [4, 4, 4]
    assert all(r.component_id is not None or r.vec_id is None for r in got)
