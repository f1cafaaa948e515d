"""Toxicity, URL rules, preference formatting and the pipeline."""

import math
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import common, preference, toxicity, url_filter
from tidepool.llm.entry import op2_toxicity

from .helpers import awkward_texts, docs_frame, groups_of, repeated_bytes
from .test_pipeline_stages import alike, shingles

SF = "/root/testdata/sf0.1"


def plain_segments(scores):
    """Ruzzo and Tompa's definition: take the best segment, then do the same to its left and right."""
    if not len(scores):
        return []
    total = np.concatenate([[0], np.cumsum(scores)])
    best, at = 0, None
    for s in range(len(scores)):
        for e in range(s + 1, len(scores) + 1):
            if total[e] - total[s] > best + 1e-9:
                best, at = total[e] - total[s], (s, e)
    if at is None:
        return []
    s, e = at
    right = [(a + e, b + e, v) for a, b, v in plain_segments(scores[e:])]
    return plain_segments(scores[:s]) + [(s, e, best)] + right


def test_maximal_segments():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = rng.integers(-5, 5, rng.integers(0, 30)) + rng.random() * 0.01
        got = [(s, e, round(v, 6)) for s, e, v in toxicity.maximal_segments(x)]
        want = [(s, e, round(v, 6)) for s, e, v in plain_segments(x)]
        assert [round(v, 6) for *_, v in got] == [round(v, 6) for *_, v in want]
        assert all(round(x[s:e].sum(), 6) == v for s, e, v in got)


def test_held_out_accuracy(spark):
    got = op2_toxicity(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    toxic, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)


def labelled(spark, n=400):
    rng = np.random.default_rng(1)
    clean = ["river", "stone", "cloud", "paper", "garden", "window", "train", "music"]
    rows, marks = [], []
    for i in range(n):
        text = " ".join(rng.choice(clean, 30))
        bad = i % 4 == 0
        rows.append(text + (" vileword nastyterm foulthing vileword " + " ".join(rng.choice(clean, 20)) if bad else ""))
        marks.append((i + 1, int(bad)))
    return rows, spark.createDataFrame(marks + [(None, 1), (9999, None), (5, 0)], "doc_id long, toxic int")


def test_toxic_passages_are_found(spark):
    texts, labels = labelled(spark)
    model = toxicity.train(docs_frame(spark, texts), labels)
    passage = "Vileword nastyterm, foulthing vileword vileword nastyterm vileword foulthing"
    asked = [None, "", "river stone", "river " * 4000 + passage + " stone" * 4000, *awkward_texts()]
    rows = sorted(toxicity.score_texts(docs_frame(spark, asked), model).collect(), key=lambda r: r.doc_id)
    assert len(rows) == len(asked) and [r.predicted for r in rows[:4]] == [0, 0, 0, 1]
    (s,) = rows[3].segments
    assert asked[3][s.start : s.end] == passage and s.p <= toxicity.MOST_P
    kept = toxicity.drop_toxic(docs_frame(spark, asked), model)
    assert kept.columns == docs_frame(spark, asked).columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.predicted}


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "doc_id long, toxic int")):
        model = toxicity.train(docs_frame(spark), labels)
        got = toxicity.score_texts(docs_frame(spark), model).collect()
        assert len(got) == len(awkward_texts()) and not any(r.predicted or math.isnan(r.score) for r in got)
    assert toxicity.score_texts(docs_frame(spark, []), model).count() == 0


PAGES = ["http://a.example.net/en/x?q#f", "https://EXAMPLE.net/", "ftp://example.net/english", "http://example.com/de/1", "http://notexample.com/de/", "http://sub.example.com/fr", "http://w.org/fr/a", "http://org/fr/", "http://forg/fr/", "net/", "", None, "http://", "http://net", "http://x.net?a/", "http://x.net/?://y.org/fr/", "http://" + "a." * 3000 + "net/" + "p" * 5000, "http://x.net#/", "://net/z"]


def test_url_rules(spark):
    rows = [(i, u, "h", "p", "r", "k") for i, u in enumerate([*PAGES, *PAGES[:3]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, key string").drop("host", "path", "rule").withColumns({"html": F.lit("x"), "listed": F.lit(1)})
    got = sorted(map(tuple, url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict").collect()))
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    assert got == sorted(con.execute(url_filter.OP8_SQL).fetchall())
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, rules=()).collect()} == {"allow"}


def test_cascade_is_exact_on_its_universe(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.filter("crc32(encode(key, 'UTF-8')) % 7 = 0")
    made = url_filter.build_cascade(keys.unionByName(keys.limit(5)), listed)
    assert len(made.shards) == 1 and len(made.shards[0]) > 2
    wrong = keys.select((made.has(F.col("key")) != (F.expr("crc32(encode(key, 'UTF-8')) % 7 = 0"))).alias("x")).filter("x").count()
    assert wrong == 0


def test_preferences(spark):
    long = "word " * 50_000
    turns = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "good"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "bad"),
        (2, "chosen", 0, "user", long), (2, "chosen", 0, "user", long), (2, "rejected", 0, "user", long), (2, "rejected", 1, None, None),
        (3, "chosen", 5, "assistant", "only"), (None, "chosen", 1, "user", "x"), (4, "other", 1, "user", "x"),
        (5, "chosen", 1, "user", "b"), (5, "chosen", 1, "user", "a"), (5, "chosen", None, "system", "s"), (5, "rejected", None, "system", "s"),
    ]
    df = spark.createDataFrame([(*t, "c", "r", 1) for t in turns], "pair_id long, side string, turn int, role string, text string, c string, r string, n int")
    got = {r.pair_id: r for r in preference.format_preferences(df).collect()}
    assert set(got) == {1, 2, 3, 5}
    one = got[1]
    assert (one.both, one.prompt_turns, one.prompt) == (True, 1, "<|user|>\nhi<|end|>\n")
    assert (one.chosen, one.rejected) == ("<|assistant|>\ngood<|end|>\n", "<|assistant|>\nbad<|end|>\n")
    for text, mask, want in ((one.chosen, one.chosen_mask, "good"), (one.rejected, one.rejected_mask, "bad")):
        s, e = map(int, mask.split(":"))
        assert text[s:e] == want
    assert (got[2].prompt_turns, got[2].chosen, got[2].rejected, got[2].rejected_mask) == (1, "", "<||>\n<|end|>\n", "")
    assert (got[3].both, got[3].prompt, got[3].rejected) == (False, "", "")
    assert got[5].prompt_turns == 1 and got[5].chosen == "<|user|>\na<|end|>\n<|user|>\nb<|end|>\n"
    assert preference.format_preferences(df.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [tuple(map(int, rng.integers(2000, 2400, 2))) for _ in range(250)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame([(a, b) for a, b in edges], "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    seen = {}
    for n in sorted(near):
        todo = [n] if n not in seen else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen[x] = n
                todo += near[x]
    assert got == {n: c for n, c in seen.items() if any(m != n for m in near[n])}


def test_pipeline(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    calm = pipeline.toxic_documents(spark, docs, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score_texts(docs, model).filter("predicted = 1").collect()}
    assert calm.columns == docs.columns
    left = sorted(i for i in before if i not in toxic)
    assert {r.doc_id for r in calm.collect()} == set(left)
    sets = [shingles(before[i]) for i in left]
    root = groups_of(len(left), lambda i, j: alike(sets[i], sets[j]))
    one = [i for n, i in enumerate(left) if root[n] == n]
    kept = repeated_bytes([before[i] for i in one])
    sizes = {i: len(k) for i, (k, *_) in zip(one, kept)}
    pieces = pipeline.run(spark, sf_dir).collect()
    assert {p.doc_id for p in pieces} == set(one)
    by = defaultdict(int)
    for p in pieces:
        by[p.doc_id] += p.length
    assert all(by[p.doc_id] == p.doc_tokens for p in pieces)
    assert all((by[i] == 1) == (sizes[i] == 0) for i in one if sizes[i] == 0 or sizes[i] > 3)
    cut = {r.doc_id: r.text for r in pipeline.repeated_passages(spark, docs.filter(F.col("doc_id").isin(one)), sf_dir).collect()}
    for i, (raw, removed, _) in zip(one, kept):
        assert 0 <= len((cut[i] or "").encode()) - len(raw) <= 6 * (removed > 0) * (1 + removed // 200)


def test_pipeline_on_an_empty_table_and_odd_ids(spark, tmp_path, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/none/labels.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
    some = docs.orderBy("doc_id").limit(12)
    odd = some.unionByName(some.limit(3).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.concat(F.lit("quite another text, number "), "doc_id", F.lit(" of its kind"))})).unionByName(some.limit(2).withColumn("text", F.concat(F.lit("an own text under a known id "), "source", "doc_id")))
    labels.write.parquet(f"{tmp_path}/odd/labels.parquet")
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    pieces = pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert sum(p.doc_id is None and p.start == 0 for p in pieces) == 3
    before = [r.doc_id for r in odd.collect()]
    assert {p.doc_id for p in pieces} <= set(before)
    assert all(before.count(d) >= sum(p.doc_id == d and p.start == 0 for p in pieces) >= 1 for d in {r.doc_id for r in odd.filter("text like 'an own text%'").collect()})
