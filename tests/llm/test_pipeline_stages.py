"""The pipeline's stages on rows that a document's id or a few bits of a fingerprint don't tell apart."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tidepool.llm import similar_texts

from .helpers import awkward_texts, docs_frame, groups_of


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def edited(seed=8):
    """Texts of about 200 words, each with copies in which 1 to 5 words are changed."""
    r = random.Random(seed)
    out = []
    for _ in range(30):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randrange(150, 250))]
        out.append(" ".join(base))
        for changes in range(1, 6):
            copy = list(base)
            for at in r.sample(range(len(copy)), changes):
                copy[at] = "changed"
            out.append(" ".join(copy))
    return out


def test_near_copies_are_those_of_brute_force(spark):
    texts = awkward_texts() + edited()
    sets = [shingles(t) for t in texts]
    root = groups_of(len(texts), lambda i, j: alike(sets[i], sets[j]))
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs_frame(spark, texts), "").collect()}
    assert kept == {i + 1 for i in range(len(texts)) if root[i] == i}


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_near_copies_of_driver_rows(spark, name):
    docs = spark.read.parquet(f"/root/testdata/{name}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets = [shingles(t) for _, t in rows]
    root = groups_of(len(rows), lambda i, j: min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and alike(sets[i], sets[j]))
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {i for n, (i, _) in enumerate(rows) if root[n] == n}


def test_slices_of_a_bucket_agree(spark):
    texts = edited(9)[:60]
    sets = [shingles(t) for t in texts]
    root = groups_of(len(texts), lambda i, j: alike(sets[i], sets[j]))
    rows = [(0, 7, i, i, similar_texts.shingle_set(t).tobytes()) for i, t in enumerate(texts)]
    members = spark.createDataFrame(rows, "band int, key long, node long, component long, shingles binary")
    links = {(r.a, r.b) for r in similar_texts.rest_links(members, 0.8, 7).collect()}
    assert groups_of(len(texts), lambda i, j: (i, j) in links or (j, i) in links) == root


def test_rows_with_the_same_or_no_doc_id(spark):
    one, other = edited()[0], edited()[12]
    near = one.replace(" ", " changed ", 1)
    docs = docs_frame(spark, [one, other, near, other, one, other, near])
    ids = {1: 5, 2: 5, 3: 4, 4: None, 5: None, 6: None, 7: 5}
    rows = [(ids[r.doc_id], *r[1:]) for r in docs.collect()] + [(None, "quite another text of its own", None, "s", 1, "a", "b", "c", "d", "e")] * 2
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, docs.schema), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(4, near), (5, other), (0, "quite another text of its own")])


def test_packed_windows_hold_the_ids(spark):
    pieces = corpus_pipeline.packed_windows(spark, docs_frame(spark), "").collect()
    assert {p.doc_id for p in pieces} == set(range(1, len(awkward_texts()) + 1))
    assert all(len(np.frombuffer(p.ids, "<u4")) == p.length and p.ids_crc32 == zlib.crc32(p.ids) for p in pieces)
