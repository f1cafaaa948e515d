"""SimHash, repeated strings, BPE, packing and token output against plain versions."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tidepool.llm import bpe, packing, simhash, suffix_dedup, token_output

from .helpers import awkward_texts, docs_frame, groups_of, repeated_bytes, with_doubles


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    texts = awkward_texts()
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs_frame(spark)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    root = groups_of(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert got == {i + 1: (fps[i], root[i] + 1) for i in range(len(texts))}


def test_simhash_index_is_whole_and_blocks_agree(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 12, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 12, dtype=np.uint64)) for c in centres] + [centres]))
    index = simhash.GrayIndex(fps)
    for q in fps[::17]:
        near = set(index.order[index.within(q, 4)].tolist())
        assert near == set(np.flatnonzero(np.bitwise_count(fps ^ q) <= 4).tolist())
    classes = spark.createDataFrame([(int(x), i) for i, x in enumerate(fps.view(np.int64))], "fp long, node long")
    root = groups_of(len(fps), lambda i, j: int(fps[i] ^ fps[j]).bit_count() <= 4)
    for hot in (4096, 8):
        from tidepool.llm.common import components

        found = {r.node: r.component for r in components(simhash.links(classes, hot=hot)).collect()}
        assert [found.get(i, i) for i in range(len(fps))] == root


def test_simhash_repeated_rows_and_null_ids(spark):
    rows = simhash.near_duplicates(with_doubles(docs_frame(spark))).collect()
    assert len(rows) == len(awkward_texts()) + 3
    assert sorted(r.component_id for r in rows if r.doc_id is None) == [5, 7]


def test_simhash_empty(spark):
    assert simhash.near_duplicates(docs_frame(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [8192, 1])
def test_repeated_strings(spark, hot):
    texts = awkward_texts()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removal_digests(docs_frame(spark), hot).collect()}
    want = repeated_bytes(texts)
    assert got == {i + 1: (len((t or "").encode()), removed, runs, hashlib.sha256(kept).hexdigest()) for i, (t, (kept, removed, runs)) in enumerate(zip(texts, want))}
    assert sum(w[1] for w in want) > 5000


def test_repeated_strings_in_long_texts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    passage = "".join(map(chr, rng.integers(97, 123, 260)))
    noise = ["".join(map(chr, rng.integers(97, 123, 700_000))) for _ in range(2)]
    texts = [noise[0][: (1 << 19) - 100] + passage + noise[0][(1 << 19) :], noise[1][:5000] + passage, "z" * 200, "z" * 199]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.removal_digests(docs_frame(spark, texts)).collect()}
    assert got == {1: (260, 1), 2: (260, 1), 3: (0, 0), 4: (0, 0)}


def test_repeated_rows_are_other_documents(spark):
    rows = with_doubles(docs_frame(spark, [None, "", "x", "y", "k" * 10 + "b" * 90, "u", "".join(chr(97 + i * i % 23) for i in range(250))]))
    got = suffix_dedup.removal_digests(rows).collect()
    assert len(got) == rows.count()
    assert [r.n_removed for r in got if r.doc_id == 7] == [250, 250]
    kept = suffix_dedup.remove_repeats(rows).collect()
    assert sorted(r.text or "" for r in kept if r.doc_id == 7) == ["", ""] and len(kept) == rows.count()


def test_repeated_strings_empty(spark):
    assert suffix_dedup.removal_digests(docs_frame(spark, [])).count() == 0
    assert suffix_dedup.removal_digests(docs_frame(spark, [None, ""])).count() == 2


def test_loser_tree():
    rng = np.random.default_rng(2)
    runs = []
    for n in (40, 1, 25, 60, 33):
        run = suffix_dedup.sorted_run(rng.integers(97, 99, (n, suffix_dedup.PREFIX), dtype=np.uint8))
        runs.append(list(suffix_dedup.decoded(suffix_dedup.front_coded(run, 0, len(run[0])))))
    given = list(suffix_dedup.merge(runs))
    assert [s for s, *_ in given] == sorted(s for r in runs for s, *_ in r)
    for (a, *_), (b, shared, _) in zip(given, given[1:]):
        assert a[:shared] == b[:shared] and (shared == suffix_dedup.PREFIX or a[shared] != b[shared])


def thue_morse(x, y):
    return "".join(y if i.bit_count() % 2 == 0 else x for i in range(128))


def test_texts_with_equal_hashes_stay(spark):
    """Polynomial hashes modulo 2**64 can't tell these strings apart; no 200-byte string of them comes twice."""
    middle = "dfxZyWtoX2edPuJj1B3XRoVdJz9m6fMJ"
    texts = [thue_morse("c", "u") + middle + thue_morse("q", "a"), thue_morse("u", "c") + middle + thue_morse("a", "q")]
    assert [w[1] for w in repeated_bytes(texts)] == [0, 0]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.removal_digests(docs_frame(spark, texts)).collect()}
    assert got == {1: 0, 2: 0}


def test_windows_of_colliding_prefixes_are_compared_by_bytes(spark):
    """As if all anchors had one hash: unique windows are those of brute force."""
    rng = np.random.default_rng(6)
    base = bytes(rng.integers(97, 123, 600).tolist())
    runs = [base[:300], base[60:400], b"x" + base[250:520], bytes(rng.integers(97, 123, 260).tolist()), base[:230] + b"?" * 40]
    rows = [(7, 1 + (i == 3), i, 1000 * i, len(t) - 200, t) for i, t in enumerate(runs)]
    seen = Counter(t[p : p + 200] for t in runs for p in range(len(t) - 199))
    want = {(i, 1000 * i + p) for i, t in enumerate(runs) if i != 3 for p in range(len(t) - 199) if seen[t[p : p + 200]] == 1}
    classes = spark.createDataFrame(rows, "kh long, m long, row long, lo long, n long, t binary")
    for f in (suffix_dedup.unique_windows, suffix_dedup.unique_windows_spread):
        assert {(r.row, r.lo + p) for r in f(classes).collect() for p in range(r.n + 1)} == want
    assert {(r.row, r.lo + p) for r in suffix_dedup.unique_windows(classes, few=0).collect() for p in range(r.n + 1)} == want
    few = suffix_dedup.alone_few(runs)
    for hashes in (None, lambda buf, n: np.zeros(len(buf) - n + 1, np.uint64), lambda buf, n: (buf[: len(buf) - n + 1] % 3).astype(np.uint64)):
        assert [x.tolist() for x in suffix_dedup.alone_many(runs, hashes)] == [x.tolist() for x in few]


def test_columns_with_names_used_inside(spark):
    passage = "".join(chr(97 + i * i % 23) for i in range(250))
    rows = [(i, "start of number %d " % i + passage, "r", "z", "doc", "sp", "sz") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, z string, doc string, spans string, size string")
    kept = sorted(suffix_dedup.remove_repeats(docs).collect())
    assert [tuple(r) for r in kept] == [(i, t.replace(" " + passage, ""), *rest) for i, t, *rest in rows]


def test_bpe_is_what_the_library_does(spark, library):
    every = ["".join(chr(c) for c in range(a, min(a + 997, 0x30000)) if not 0xD800 <= c < 0xE000) for a in range(0, 0x30000, 997)]
    texts = [*awkward_texts(), *every, "Hello  world\n\n  def f(x):\n\treturn x's they'll " * 50, "a" * 3000, "日本語のテキスト" * 200, "  \n " * 100]
    got = {r.doc_id: r for r in bpe.encode_texts(docs_frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    short = {r.doc_id: r for r in bpe.encode_digests(docs_frame(spark, texts)).collect()}
    for i, t in enumerate(texts, 1):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)
        assert short[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert short[i].decoded_sha256 == hashlib.sha256(got[i].decoded.encode()).hexdigest()


def test_packing_holds_every_id_once(spark, library):
    texts = awkward_texts()
    pieces = packing.pack_documents(docs_frame(spark, texts)).collect()
    digests = packing.pack_documents(docs_frame(spark, texts), digest=True).collect()
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts, 1)}
    seen, rows = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length and ids == want[p.doc_id][p.start : p.start + p.length] and p.doc_tokens == len(want[p.doc_id])
        seen[p.doc_id] += range(p.start, p.start + p.length)
        rows[p.sequence_id].append((p.offset, p.length))
    assert all(sorted(seen[i]) == list(range(len(w))) for i, w in want.items())
    ends = []
    for spans in rows.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        ends.append(at)
    assert max(ends) <= 1024 and sum(e < 1024 for e in ends) <= 8  # the last window of each shard
    crc = Counter((p.doc_id, p.start, zlib.crc32(p.ids)) for p in pieces)
    assert crc == Counter((p.doc_id, p.start, p.ids_crc32) for p in digests)


def test_packing_prefers_neighbours(spark):
    about = {"sea": "ship wave harbour sail anchor tide", "oven": "bread flour yeast crust butter dough"}
    texts = [" ".join(about[k].split() * 5) + f" {i}" for i in range(20) for k in about]
    pieces = packing.pack_documents(docs_frame(spark, texts).coalesce(1), window=128, k=4).collect()
    rows = defaultdict(list)
    for p in pieces:
        rows[p.sequence_id].append(p.doc_id % 2)
    same = sum(len(set(r)) == 1 for r in rows.values())
    assert same >= 0.8 * len(rows)


def test_packing_edges(spark):
    assert packing.pack_documents(docs_frame(spark, [])).count() == 0
    rows = packing.pack_documents(with_doubles(docs_frame(spark))).collect()
    assert Counter(p.doc_id for p in rows if p.start == 0)[7] == 2
    assert sum(p.doc_id is None and p.start == 0 for p in rows) == 2


def test_token_rows(spark, library):
    texts = awkward_texts()
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts, 1)}
    found = defaultdict(dict)
    rows = token_output.packed_rows(docs_frame(spark, texts)).collect()
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        assert len(ids) == len(positions) == 1024 and r.cu_seqlens[-1] == r.n_tokens
        assert not ids[r.n_tokens :].any()
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            found[d][s] = ids[a:b].tolist()
        assert positions[r.n_tokens :].tolist() == list(range(1024 - r.n_tokens))
    assert {d: sum((p[s] for s in sorted(p)), []) for d, p in found.items()} == want
    assert len({r.row_id for r in rows}) == len(rows)
    short = token_output.packed_rows(docs_frame(spark, texts), digest=True).collect()
    assert Counter(hashlib.sha256(r.ids).hexdigest() for r in rows) == Counter(r.ids_sha256 for r in short)
    assert token_output.packed_rows(docs_frame(spark, [])).count() == 0


def test_token_output_query_returns_the_ids(spark, sf_dir, library):
    want = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = defaultdict(dict)
    for r in token_output.op7_token_output(spark, sf_dir).collect():
        assert len(r.ids) == len(r.positions) == 4 * 1024
        ids, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            found[d][s] = ids[a:b].tolist()
            assert positions[a:b].tolist() == list(range(b - a))
        assert (r.ids_sha256, r.positions_sha256) == (hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(r.positions).hexdigest())
    assert {d: sum((p[s] for s in sorted(p)), []) for d, p in found.items()} == want


def test_best_fit_decreasing_is_best_fit():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 100, 400).tolist()
    room, want = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fit = [(r, b) for b, r in enumerate(room) if r >= sizes[i]]
        b = min(fit)[1] if fit else len(room)
        if not fit:
            room.append(100)
        room[b] -= sizes[i]
        want[i] = b
    bins = token_output.best_fit_decreasing(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert len(bins) == len(room) and sorted(100 - sum(sizes[i] for i in b) for b in bins) == sorted(room)
