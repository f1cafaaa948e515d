"""Toxicity scores, BM25 retrieval, lexical dealing and matrix files against plain versions; awkward rows of the rest."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from tidepool.llm import bpe, packing, token_output, tokens, toxicity, url_filter

from .helpers import awkward_texts, docs_frame, with_doubles
from .test_judgements import plain_segments


def plain_toxicity(texts, marks):
    """Scores of texts {doc_id: text} by labels {doc_id: 0 or 1}, one word at a time."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    n = toxicity.BUCKETS
    count = (Counter(), Counter())
    for i, mark in marks.items():
        if fold(i) < 2:
            for w in set(toxicity.WORD(texts[i] or "")):
                count[mark].update(toxicity.buckets(w))
    total = [max(sum(v for b, v in c.items() if b < n), 1) for c in count]

    def weight(b):
        clean, toxic = count[0][b], count[1][b]
        if b < 2 * n and toxic + clean < toxicity.LEAST_SEEN:
            return None
        a0, a1 = (toxicity.PRIOR * t / sum(total) for t in total)
        odds = math.log((toxic + a1) / (total[1] + a1)) - math.log((clean + a0) / (total[0] + a0))
        z = abs(odds / math.sqrt(1 / (toxic + a1) + 1 / (clean + a0)))
        return odds * (1 - (toxicity.LEAST_Z / z) ** 2) if z > toxicity.LEAST_Z else 0.0

    def word_score(w):
        return float(np.float32(next(s for s in map(weight, toxicity.buckets(w)) if s is not None))) - toxicity.DRIFT

    known: dict = {}
    scores = {i: np.array([known[w] if w in known else known.setdefault(w, word_score(w)) for w in toxicity.WORD(t or "")]) for i, t in texts.items()}
    best = {i: [s for *_, s in plain_segments(x)] for i, x in scores.items()}
    clean = [i for i, m in marks.items() if fold(i) == 3 and not m and len(scores[i])]
    steps = np.round(np.concatenate([scores[i] for i in clean]) * 4) / 4
    low, high = 1e-6, 64.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if np.exp(mid * steps).mean() < 1 else (low, mid)
    decay = high
    log_k = np.mean([decay * max(best[i], default=0.0) - math.log(len(scores[i])) for i in clean]) - toxicity.EULER

    def evidence(i):
        beyond = [decay * s - log_k - math.log(max(len(scores[i]), 1)) for s in best[i]]
        return sum(b for b in beyond if 1 - math.exp(-math.exp(-b)) <= toxicity.MOST_P)

    x = np.array([math.floor(min(evidence(i), 200.0) + 0.5) for i in marks if fold(i) == 3], float)
    y = np.array([m for i, m in marks.items() if fold(i) == 3], float)
    theta = np.array([0.1, 0.0])
    for _ in range(200):  # Newton's steps on the regularised loss
        p = 1 / (1 + np.exp(-np.clip(theta[0] * x + theta[1], -30, 30)))
        g = np.array([((p - y) * x).sum() + 0.1 * theta[0], (p - y).sum() + 0.01 * theta[1]])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        theta = theta - np.clip(np.linalg.solve(h, g), -0.5, 0.5)
    return {i: 1 / (1 + math.exp(-(theta[0] * evidence(i) + theta[1]))) for i in texts}


def test_toxicity_scores_are_those_of_a_plain_version(spark):
    r = random.Random(4)
    calm = ["river", "stone", "cloud", "paper", "Garden", "window", "train", "music", "rivers", "stones"]
    bad = ["vileword", "nastyterm", "foulthing"]
    texts, marks = {}, {}
    for i in range(1, 500):
        words = [r.choice(calm) for _ in range(r.randrange(5, 40))]
        if i % 3 == 0:
            at = r.randrange(len(words))
            words[at:at] = [r.choice(bad) for _ in range(r.randrange(1, 9))]
        texts[i], marks[i] = " ".join(words), int(i % 3 == 0 and r.random() < 0.95)
    for i, t in enumerate(awkward_texts()):
        texts[1000 + i] = t and t[:400]
    docs = docs_frame(spark, []).limit(0).unionByName(spark.createDataFrame([(i, t, None, "s", 1, "a", "b", "c", "d", "e") for i, t in texts.items()], docs_frame(spark, []).schema))
    model = toxicity.train(docs, spark.createDataFrame(list(marks.items()), "doc_id long, toxic int"))
    got = {x.doc_id: x.score for x in toxicity.score_texts(docs, model).collect()}
    want = plain_toxicity(texts, marks)
    assert set(got) == set(want) and max(want.values()) > 0.9
    assert max(abs(got[i] - want[i]) for i in want) < 1e-4


def test_toxicity_of_repeated_rows_and_null_ids(spark):
    docs = with_doubles(docs_frame(spark))
    model = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id long, toxic int"))
    rows = toxicity.score_texts(docs, model).collect()
    assert len(rows) == len(awkward_texts()) + 3 and sum(r.doc_id is None and not r.held_out for r in rows) == 2
    assert len({r.score for r in rows if r.doc_id == 7}) == 1


def plain_bm25(docs, df, seed, terms):
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items()}

    def weight(t, d):
        tf = Counter(docs[d].tolist())[t]
        return idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(docs[d]) / mean)) if tf else 0.0

    query = sorted(set(docs[seed].tolist()), key=lambda t: -weight(t, seed))[:terms]
    return [sum(weight(t, d) for t in query) for d in range(n)]


def test_shards_rank_as_plain_bm25():
    rng = np.random.default_rng(3)
    docs = [np.minimum(rng.zipf(1.4, rng.integers(5, 60)), 300).astype("<u2") for _ in range(80)]
    df = Counter(t for d in docs for t in set(d.tolist()))
    idf = np.zeros(301, np.float32)
    for t, c in df.items():
        idf[t] = np.log(1 + (len(docs) - c + 0.5) / (c + 0.5))
    shard = packing.Shard(docs, idf, sum(map(len, docs)) / len(docs), 1000)
    for d in (3, 4, 5):
        shard.take(d)
    for seed in range(0, 80, 7):
        score = plain_bm25(docs, df, seed, 1000)
        got = shard.neighbours(seed, 8)
        open_ = sorted((-s for d, s in enumerate(score) if d not in (3, 4, 5) and s > 0))
        assert not {3, 4, 5} & set(got) and len(got) == len(set(got)) == min(8, len(open_))
        assert np.allclose([score[d] for d in got], [-s for s in open_[: len(got)]], rtol=1e-5)


def test_copies_meet_in_one_shard_wherever_they_stood(spark):
    """Each text and its near copy stand in different partitions at first; after dealing they are close."""
    r = random.Random(5)
    base = [" ".join(f"w{r.randrange(3000)}" for _ in range(120)) for _ in range(300)]
    texts = base + [t.replace(" w1", " changed w1", 1) for t in base]
    docs = docs_frame(spark, texts).repartition(6)
    path = tokens.vocabulary_path()
    made = packing.tokenize(docs, path)
    df = np.zeros(1 << 16, np.int64)
    for x in packing.document_frequencies(made, tokens.id_type(path)).collect():
        df[x.token] = x.df
    order = [x.doc_id for x in packing.dealt(made, df, tokens.id_type(path), 100_000).collect()]
    place = {d: i for i, d in enumerate(order)}
    assert sorted(order) == list(range(1, 601))
    near = sum(abs(place[i] - place[i + 300]) <= 32 for i in range(1, 301))
    assert near >= 200, near


def test_matrix_files_are_read_back(spark, tmp_path):
    texts = awkward_texts()
    rows = token_output.packed_rows(with_doubles(docs_frame(spark, texts)))
    want = sorted((np.frombuffer(r.ids, "<u4").tolist(), np.frombuffer(r.positions, "<u4").tolist(), list(r.cu_seqlens)) for r in rows.collect())
    index = token_output.write_matrices(rows, f"file://{tmp_path}/matrices").collect()
    assert sum(r.rows for r in index) == len(want)
    got = []
    for r in index:
        ids, positions, lengths = token_output.read_matrices(r.path, r.rows)
        assert ids.shape == positions.shape == (r.rows, 1024)
        got += [(i.tolist(), p.tolist(), c.tolist()) for i, p, c in zip(ids, positions, lengths)]
    assert sorted(got) == want
    assert token_output.write_matrices(token_output.packed_rows(docs_frame(spark, [])), f"file://{tmp_path}/none").count() == 0


def test_token_rows_of_repeated_rows_and_null_ids(spark):
    rows = token_output.packed_rows(with_doubles(docs_frame(spark))).collect()
    starts = Counter(d for r in rows for d, s in zip(r.doc_ids, r.starts) if s == 0)
    assert starts[7] == 2 and starts[None] == 2 and sum(starts.values()) == len(awkward_texts()) + 3


def test_bpe_edges(spark):
    assert bpe.encode_texts(docs_frame(spark, [])).count() == 0
    rows = bpe.encode_digests(with_doubles(docs_frame(spark))).collect()
    assert len(rows) == len(awkward_texts()) + 3
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.ids_sha256)
    assert len(by[7]) == 1 and sum(r.doc_id is None for r in rows) == 2


def test_ascii_texts_are_split_and_encoded_as_the_library_does():
    r = random.Random(2)
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path()
    library, codec = Tokenizer.from_file(path), bpe.codec(path)
    letters = [chr(c) for c in range(128)] + list(" \n\t'  ''sdtrevlm") * 4
    texts = ["".join(r.choices(letters, k=r.randrange(1, 60))) for _ in range(3000)] + ["".join(r.choices("abcdeiou tnrs", k=200)) for _ in range(300)]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == e.ids, t


def test_many_added_tokens_are_split_in_linear_time():
    added = {"<|endoftext|>": 50256, "<|end": 7}
    text = "<|endoftext|>a<|end" * 200_000
    parts = list(tokens.split_added(text, added))
    assert parts[:4] == [("", 50256), ("a", 7), ("", 50256), ("a", 7)] and len(parts) == 400_001
    assert list(tokens.split_added("abc", {})) == [("abc", None)]


def test_arcs_are_kept_within_their_bound(monkeypatch):
    """Texts in which every word is new: encoded as the library does, whatever the table has forgotten."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "MOST_ARCS", 300)
    made, library = bpe.Codec(tokens.vocabulary_path()), Tokenizer.from_file(tokens.vocabulary_path())
    r = random.Random(3)
    for _ in range(40):
        text = "".join(r.choice("ABCDEFabcdef0123456789+/") for _ in range(200))
        assert np.frombuffer(made.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(made.words.automaton.arcs) < 300 + 200 * 60


def test_words_are_kept_within_their_bound():
    codec = bpe.codec(tokens.vocabulary_path())
    words = bpe.Words(codec.words.automaton, 5000)
    for i in range(200):
        assert words[f" word{i}"] == codec.words[f" word{i}"]
        assert words.held <= 5000
    assert len(words) < 40


@pytest.mark.parametrize("shard_keys", [1 << 20, 500])
def test_shards_of_a_cascade_are_exact(spark, shard_keys):
    keys = spark.range(30_000).select(F.concat(F.lit("k"), "id").alias("key"))
    of = "crc32(encode(key, 'UTF-8')) % 11 = 0"
    made = url_filter.build_cascade(keys, keys.filter(of), shard_keys)
    assert len(made.shards) == (1 if shard_keys > 30_000 else 6)
    assert keys.select((made.has(F.col("key")) != F.expr(of)).alias("x")).filter("x").count() == 0


@pytest.mark.parametrize("most", [1, 2, 3])
def test_keys_that_levels_do_not_tell_apart_are_listed(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "CHUNK", 16)
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    made = url_filter.build_cascade(keys, keys.filter("hash(key) % 5 = 0"), 400, most)
    assert made.left and keys.select((made.has(F.col("key")) != F.expr("hash(key) % 5 = 0")).alias("x")).filter("x").count() == 0
    assert max(len(s) for s in made.shards) == most


def test_a_million_listed_keys(spark):
    keys = spark.range(1_500_000).select(F.concat(F.lit("host"), F.xxhash64("id"), F.lit(".net/")).alias("key"), "id")
    made = url_filter.build_cascade(keys.select("key"), keys.filter("id % 3 > 0").select("key"), 400_000)
    assert len(made.shards) == 3
    assert keys.select((made.has(F.col("key")) != F.expr("id % 3 > 0")).alias("x")).filter("x").count() == 0


def test_url_rules_on_repeated_rows_and_null_ids(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")] * 2 + [(None, "http://a.net/x"), (None, None)], "page_id long, url string")
    got = url_filter.filter_urls(pages).collect()
    assert [r.verdict for r in got].count("block") == 3 and len(got) == 4 and sum(r.page_id is None for r in got) == 2
