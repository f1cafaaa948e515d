"""Operator 3: packing by lexical retrieval.

Documents are tokenized once into a table in the shared folder. Document frequencies of all token ids are counted over
the whole corpus (a vector of the vocabulary's size, whatever the corpus). Documents are then dealt out in the order of a
lexical key, min-hashes of their rarest shared ids, so that neighbours come together wherever they stood; a frequent key
spreads over tasks like any other. Each task reads its part in shards of bounded size and builds for each a BM25 inverted
index over token ids. A seed document is laid into windows; when it ends inside one, the index returns its best unused
neighbours, which fill the window greedily. The last of them is cut at the window's end and goes on as the next seed. So
only a shard's last window is padded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table
from .tokens import encode, id_type, vocabulary_path
from .vectors import parts

WINDOW = 1024
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def tokenize(docs: DataFrame, path: str, end_id: int | None = 0, rows: int = 64) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian 16 or 32 bits as the vocabulary needs) of each row of docs(doc_id, text)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = [encode(t, path) for t in part.column(1).to_pylist()]
                if end_id is not None:
                    ids = [np.append(x, x.dtype.type(end_id)) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def document_frequencies(tokens: DataFrame, kind: str) -> DataFrame:
    """(token, df) over all documents: each task sends one row a token at most."""

    def run(batches):
        df = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column(0):
                ids = np.unique(np.frombuffer(x.as_py(), kind))
                if len(ids) and ids[-1] >= len(df):
                    df = np.append(df, np.zeros(int(ids[-1]) + 1, np.int64))
                df[ids] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["token", "df"])

    return tokens.select("ids").mapInArrow(run, "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))


def lexical_keys(ids: np.ndarray, df: np.ndarray, terms: int) -> tuple[int, int]:
    """The two smallest hashes of a document's ``terms`` rarest ids that another document has, too."""
    own = np.unique(ids)
    seen = df[own]
    own, seen = own[seen > 1], seen[seen > 1]
    if len(own) > terms:
        own = own[np.argpartition(seen, terms)[:terms]]
    h = np.sort((own.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24))
    return tuple([*h[:2].tolist(), -1, -1][:2])


def dealt(tokens: DataFrame, frequencies: np.ndarray, kind: str, total: int, terms: int = 16, least: int = 200_000, most: int = 1 << 24) -> DataFrame:
    """tokens in the order of their lexical keys; tasks get at least about ``least`` ids, so that few windows are padded,
    and, however large the table, about ``most`` of them (where the session asks for too few partitions)."""
    shared = tokens.sparkSession.sparkContext.broadcast(frequencies)
    names = ["doc_id", "n_tokens", "ids", "k1", "k2"]

    def run(batches):
        for batch in batches:
            keys = [lexical_keys(np.frombuffer(x.as_buffer(), kind), shared.value, terms) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))], names)

    keyed = tokens.select(*names[:3]).mapInArrow(run, "doc_id long, n_tokens long, ids binary, k1 long, k2 long")
    order = ["k1", "k2", F.xxhash64("doc_id", "n_tokens")]
    return keyed.repartitionByRange(max(1, min(max(parts(tokens), total // most), total // least)), *order).sortWithinPartitions(*order).select("doc_id", "ids")


class Shard:
    """BM25 inverted index over one shard's documents, and which of them are unused."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float, terms: int):
        self.unused, post_t, post_d, post_w, self.query = np.ones(len(docs), bool), [], [], [], []
        for d, ids in enumerate(docs):
            t, tf = np.unique(ids, return_counts=True)
            w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean_length))
            post_t.append(t)
            post_d.append(np.full(len(t), d, np.int32))
            post_w.append(w.astype(np.float32))
            self.query.append(t[np.argpartition(-w, terms)[:terms]] if len(t) > terms else t)
        t = np.concatenate(post_t)
        order = np.argsort(t, kind="stable")
        self.docs, self.weights = np.concatenate(post_d)[order], np.concatenate(post_w)[order]
        size = int(t.max()) + 2 if len(t) else 1
        self.at = np.searchsorted(t[order], np.arange(size))

    def take(self, d: int) -> None:
        self.unused[d] = False

    def neighbours(self, seed: int, k: int) -> list[int]:
        """The k unused documents with the best BM25 score for the seed's terms, best first; only those with a common term."""
        spans = [slice(self.at[t], self.at[t + 1]) for t in self.query[seed].tolist()]
        if not spans:
            return []
        scores = np.bincount(np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), len(self.unused))
        scores[~self.unused] = 0
        best = np.argpartition(-scores, k)[:k] if len(scores) > k else np.arange(len(scores))
        best = best[scores[best] > 0]
        return best[np.lexsort((best, -scores[best]))].tolist()


def lay_out(lengths: list[int], shard: Shard, window: int, k: int):
    """Pieces (document, start, length, window, offset): every token of the shard once, in windows without gaps."""
    seq = room_used = first = 0
    queue: list[int] = []
    seed, n = None, len(lengths)
    while True:
        while queue and not shard.unused[queue[0]]:
            queue.pop(0)
        if queue:
            d = queue.pop(0)
        else:
            found = shard.neighbours(seed, k) if seed is not None and room_used else []
            if found:
                d, queue = found[0], found[1:]
            else:
                while first < n and not shard.unused[first]:
                    first += 1
                if first == n:
                    return
                d = first
                seed = d
        shard.take(d)
        start = 0
        while start < lengths[d]:
            take = min(lengths[d] - start, window - room_used)
            yield d, start, take, seq, room_used
            start, room_used = start + take, room_used + take
            if room_used == window:
                seq, room_used, queue, seed = seq + 1, 0, [], d  # the document that a window ends in seeds the next


def pack(tokens: DataFrame, frequencies: DataFrame, kind: str, window: int = WINDOW, shard_docs: int = 2048, shard_tokens: int = 1 << 22, k: int = 8, terms: int = 24, digest: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` ids, from tokenize() and document_frequencies().

    The table is dealt out by dealt(). A shard holds at most ``shard_docs`` documents and closes once it has ``shard_tokens`` ids (one document more at
    most), so memory doesn't grow with the corpus. ``terms`` is the number of a seed's highest weighted ids that form its
    query, ``k`` the number of neighbours fetched at a time; whoever isn't fetched stays unused and is packed later, so
    neither loses documents. Sequence ids hold the partition's number above bit 33, and are gapless within it.
    """
    n = tokens.agg(F.count("*"), F.coalesce(F.avg("n_tokens"), F.lit(1.0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    counts = frequencies.collect()  # one row a token id: bounded by the vocabulary
    df = np.zeros(max([c.token for c in counts], default=0) + 1, np.int64)
    df[[c.token for c in counts]] = [c.df for c in counts]
    idf = np.where(df > 0, np.log(1 + (n[0] - df + 0.5) / (df + 0.5)), 0.0)
    shared = tokens.sparkSession.sparkContext.broadcast(idf.astype(np.float32))
    mean = float(n[1])

    def run(batches):
        partition, first = TaskContext.get().partitionId() << 33, 0

        def close(names, docs):
            nonlocal first
            pieces = list(lay_out([len(x) for x in docs], Shard(docs, shared.value, mean, terms), window, k))
            sequences = first
            for at in range(0, len(pieces), 4096):
                some = pieces[at : at + 4096]
                d, start, length, seq, offset = map(list, zip(*some))
                ids = [docs[i][s : s + n].astype("<u4").tobytes() for i, s, n in zip(d, start, length)]
                ids = pa.array([zlib.crc32(x) for x in ids], pa.int64()) if digest else pa.array(ids, pa.binary())
                long = lambda x: pa.array(x, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [long([names[i] for i in d]), long(start), long(length), ids, long([len(docs[i]) for i in d]), long([partition + sequences + s for s in seq]), long(offset)],
                    ["doc_id", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "sequence_id", "offset"],
                )
            first += pieces[-1][3] + 1 if pieces else 0

        names, docs, size = [], [], 0
        for batch in batches:
            for name, x in zip(batch.column(0), batch.column(1)):
                names.append(name.as_py())
                docs.append(np.frombuffer(x.as_py(), kind))
                size += len(docs[-1])
                if len(docs) >= shard_docs or size >= shard_tokens:
                    yield from close(names, docs)
                    names, docs, size = [], [], 0
        if docs:
            yield from close(names, docs)

    return dealt(tokens, df, kind, n[2]).mapInArrow(run, PIECES.replace("ids binary", "ids_crc32 long") if digest else PIECES)


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW, digest: bool = False, **how) -> DataFrame:
    """Tokenize docs(doc_id, text) and pack every id, end id 0 after each document included; columns as in PIECES.

    A null text counts as empty: its document is one id. Texts of any length are cut at window ends; repeated rows and
    null doc_ids are packed each; other columns are ignored; an empty table gives an empty result. ``digest`` returns
    each piece's CRC-32 (of its ids as little-endian unsigned 32-bit integers) in place of its ids.
    """
    path = path or vocabulary_path()
    tokens = settle(tokenize(docs, path))
    return pack(tokens, document_frequencies(tokens, id_type(path)), id_type(path), window, digest=digest, **how)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), digest=True)
