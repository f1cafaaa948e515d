"""Operator 7: packed token-id matrices by best-fit-decreasing packing with a segment tree over capacities."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .packing import WINDOW
from .tokens import encode, vocabulary_path

ROWS = "row_id long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, n_tokens int, ids binary, positions binary"


class Capacities:
    """Open bins by room left. Node i of the tree tells whether any room in its range has a bin; finding the least room
    of at least a given size goes up from its leaf and down again: 2 log2(window) steps."""

    def __init__(self, window: int):
        self.base = 1 << window.bit_length()
        self.any, self.bins = bytearray(2 * self.base), [[] for _ in range(window + 1)]

    def add(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        i = self.base + room
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def best(self, size: int) -> tuple[int, int] | None:
        """Take out the bin with the least room >= size: (room, bin)."""
        i = self.base + size
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.base
        bin_ = self.bins[room].pop()
        if not self.bins[room]:
            while i and not (i < self.base and (self.any[2 * i] or self.any[2 * i + 1])):
                self.any[i] = 0
                i >>= 1
        return room, bin_


def best_fit_decreasing(sizes: list[int], window: int) -> list[list[int]]:
    """Items of each bin. Longest first (ties: in order), each into the fullest bin that still has room for it."""
    tree, bins = Capacities(window), []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.best(sizes[item])
        room, at = found or (window, len(bins))
        if found is None:
            bins.append([])
        bins[at].append(item)
        if room > sizes[item]:
            tree.add(room - sizes[item], at)
    return bins


def packed_rows(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int | None = 0, pad_id: int = 0, shard_tokens: int = 1 << 22, digest: bool = False) -> DataFrame:
    """Rows of exactly ``window`` ids from docs(doc_id, text), columns as in ROWS.

    A document's ids (and ``end_id``) are split into pieces of ``window``, without loss; the pieces of a shard (about
    ``shard_tokens`` ids of one task) are packed best fit decreasing and never cut further. ``doc_ids`` and ``starts`` name
    each piece of a row and where it starts in its document, ``cu_seqlens`` are the cumulative lengths (0 first, padding
    not included), ``ids`` the row's ids (little-endian unsigned 32-bit, padded with ``pad_id``), ``positions`` as many
    positions that start anew at 0 with each piece and with the padding. With ``digest``: SHA-256 of ids and positions.

    A null or empty text is its end id alone (without one it is left out); texts of any length are whole; repeated rows
    and null doc_ids are packed each; other columns are ignored; an empty table gives an empty result.
    """
    path = path or vocabulary_path()
    schema = ROWS.replace("ids binary, positions binary", "ids_sha256 string, positions_sha256 string") if digest else ROWS
    names = ["row_id", "doc_ids", "starts", "cu_seqlens", "n_tokens", *(["ids_sha256", "positions_sha256"] if digest else ["ids", "positions"])]

    def run(batches):
        first = TaskContext.get().partitionId() << 33
        count = np.arange(window, dtype="<u4")

        def close(pieces):
            nonlocal first
            out = []
            for items in best_fit_decreasing([len(p[2]) for p in pieces], window):
                chosen = [pieces[i] for i in items]
                lengths = [len(p[2]) for p in chosen]
                ends = np.cumsum([0, *lengths])
                used = int(ends[-1])
                ids = np.full(window, pad_id, "<u4")
                ids[:used] = np.concatenate([p[2] for p in chosen])
                positions = np.concatenate([*(count[:n] for n in lengths), count[: window - used]])
                data = (ids.tobytes(), positions.tobytes())
                out.append((first, [p[0] for p in chosen], [p[1] for p in chosen], ends.astype("i4"), used, *(map(lambda x: hashlib.sha256(x).hexdigest(), data) if digest else data)))
                first += 1
                if len(out) == 1024:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

        def batch_of(rows):
            text = pa.string() if digest else pa.binary()
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), text, text]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        pieces, size = [], 0
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                ids = encode(text.as_py(), path)
                if end_id is not None:
                    ids = np.append(ids, ids.dtype.type(end_id))
                for at in range(0, len(ids), window):
                    pieces.append((name.as_py(), at, ids[at : at + window]))
                size += len(ids)
                if size >= shard_tokens:
                    yield from close(pieces)
                    pieces, size = [], 0
        if pieces:
            yield from close(pieces)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def write_matrices(rows: DataFrame, path: str) -> DataFrame:
    """Write packed rows as raw matrices below ``path`` (any folder that all executors reach, also as a URI): an index
    (path, rows, segments) that is kept there, too, as Parquet.

    Each task writes three files: ``<path>.ids`` and ``<path>.positions`` are matrices of little-endian unsigned 32-bit
    integers, ``<path>.lengths`` holds each row's number of cumulative lengths and then these, as 32-bit integers. Names
    are new for each attempt and only what the index lists counts, so a task that is run again leaves nothing double.
    """
    suffixes = ("ids", "positions", "lengths")

    def run(batches):
        files = name = None
        n = segments = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                system, folder = pa.fs.FileSystem.from_uri(path)
                system.create_dir(folder, recursive=True)
                name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                files = [system.open_output_stream(f"{name}.{s}") for s in suffixes]
            ids, positions, lengths = (batch.column(i) for i in range(3))
            for x, y, c in zip(ids, positions, lengths):
                ends = np.array(c.as_py(), "<i4")
                for f, data in zip(files, (x.as_buffer(), y.as_buffer(), np.array([len(ends)], "<i4").tobytes() + ends.tobytes())):
                    f.write(data)
                segments += len(ends) - 1
            n += batch.num_rows
        if files:
            for f in files:
                f.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([segments], pa.int64())], ["path", "rows", "segments"])

    index = f"{path}/index"
    rows.select("ids", "positions", "cu_seqlens").mapInArrow(run, "path string, rows long, segments long").write.mode("overwrite").parquet(index)
    return rows.sparkSession.read.parquet(index)


def read_matrices(path: str, rows: int, system=None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ids, positions and cumulative lengths of one file of the index."""
    system = system or pa.fs.LocalFileSystem()

    def whole(suffix: str) -> np.ndarray:
        with system.open_input_file(f"{path}.{suffix}") as f:
            return np.frombuffer(f.readall(), "<i4" if suffix == "lengths" else "<u4")

    flat, lengths, at = whole("lengths"), [], 0
    for _ in range(rows):
        lengths.append(flat[at + 1 : at + 1 + flat[at]])
        at += 1 + int(flat[at])
    return whole("ids").reshape(rows, -1), whole("positions").reshape(rows, -1), lengths


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rows whole, and the SHA-256 of ids and positions."""
    rows = packed_rows(table(spark, sf_dir, "documents"))
    return rows.withColumns({"ids_sha256": F.sha2("ids", 256), "positions_sha256": F.sha2("positions", 256)})
