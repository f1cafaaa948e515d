"""Operator 5: removal of repeated byte strings by a distributed merge sort of sampled suffixes.

A window is a string of LENGTH bytes. Its anchor is the suffix that starts at the smallest hash of all strings of PREFIX
bytes inside it, so equal windows have their anchor at the same place, wherever they stand. Consecutive windows of one
document that share an anchor are a run of windows; about one position in 85 is an anchor. Hashes choose anchors and
deal rows out; whether strings are equal is decided by their bytes alone.

1. Each task finds its anchors, sorts their suffixes, front-codes the sorted run (what a string shares with the one
   before is sent as a number) and cuts it at splitters taken from a bounded sample.
2. Each range merges its runs by a loser tree that knows every string's common prefix with the last winner, and compares
   bytes only beyond that. Prefixes that come twice or more make their anchors candidates; one entry of a run stands for
   all equal strings of its task, so a frequent string costs a task one entry. All other windows occur once.
3. The texts of candidates' runs of windows are grouped by their bytes (equal ones meet inside each task first). A run
   with an equal is repeated entirely.
4. Runs without an equal are compared with all others of their prefix, window by window, by their bytes: what is found
   nowhere else is unique.

The bytes covered by windows of candidates that aren't unique are removed. A document only ever gets its own candidates
and its own unique windows, so no frequent string gathers rows in one place.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, settle, table
from .vectors import groups, parts

LENGTH, PREFIX = 200, 32
PIECE = 1 << 19  # bytes that are hashed at once
RUN = 150_000  # anchors that are sorted at once
RANGE = 500_000  # anchors of a range, about
BLOCK = 4096  # bytes of a text that a sample takes at once
PLACE = np.uint64(21)  # bits of a place in a buffer, which holds less than two pieces
U = np.uint64


class Rolling:
    """Polynomial hashes modulo 2**64 of all strings of one length in a buffer."""

    def __init__(self, base: int, seed: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.value = np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=U) * U(2) + U(1)
        self.powers = self.inverses = np.ones(1, U)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n += n // 4
            one = np.ones(1, U)
            self.powers = np.cumprod(np.concatenate([one, np.full(n, self.base, U)]), dtype=U)
            self.inverses = np.cumprod(np.concatenate([one, np.full(n, self.inverse, U)]), dtype=U)

    def of_all(self, buf: np.ndarray, length: int) -> np.ndarray:
        self._grow(len(buf) + 1)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(self.value[buf] * self.powers[: len(buf)], dtype=U)])
        n = len(buf) - length + 1
        return mix((sums[length:] - sums[:n]) * self.inverses[:n])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xA24BAED4963EE407)
    return x ^ (x >> U(32))


HASH = Rolling(0x9E3779B97F4A7C15, 1)


def anchors(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray):
    """For each run of windows in the documents buf[starts:stops]: document, anchor, first and last window, hash of the
    anchor's PREFIX bytes."""
    n, width = len(buf), LENGTH - PREFIX + 1
    long = stops - starts >= LENGTH
    if not long.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(U)
    h = HASH.of_all(buf, PREFIX)
    key = (h >> PLACE << PLACE) | np.arange(len(h)).astype(U)  # the leftmost of equal ones is the smallest
    padded = np.full(-(-len(key) // width) * width, ~U(0), U)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - LENGTH + 1], ahead[width - 1 : n - LENGTH + width])
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, stops[long] - LENGTH + 1, -1)
    windows = np.flatnonzero(np.cumsum(edge)[: n - LENGTH + 1])
    anchor = (least[windows] & ((U(1) << PLACE) - U(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)]))
    a, lo, hi = anchor[new], windows[new], windows[np.append(new[1:], len(windows)) - 1]
    return np.searchsorted(starts, lo, side="right") - 1, a, lo, hi, h[a]


# ---- texts


def squeezed(docs: DataFrame, *columns: str) -> DataFrame:
    """row (a number for each row of docs), size, z: the texts' bytes (null: none) compressed, and other columns.

    Only a written table keeps its row numbers."""
    names = ["row", "size", "z", *columns]

    def run(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            size, z = [], []
            for text in batch.column(1).cast(pa.binary()):
                raw = text.as_buffer()
                size.append(raw.size if raw else 0)
                z.append(codec.compress(raw, asbytes=True) if raw else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(z, pa.binary()), *batch.columns[2:]], names)

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("size", T.LongType()), T.StructField("z", T.BinaryType()), *(docs.schema[c] for c in columns)])
    return docs.select(F.monotonically_increasing_id().alias("row"), "text", *columns).mapInArrow(run, schema)


def plain(z, size: int) -> bytes:
    return pa.Codec("zstd").decompress(z, size, asbytes=True) if size else b""


def pieces(batches):
    """Texts of Arrow batches of (row, size, z) in buffers of about PIECE bytes: (buffer, starts, stops, rows, offsets
    in the texts). Longer texts come in chunks that overlap so that no window is lost."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def close():
        ends = np.cumsum([0, *(len(x) for *_, x in held)])
        return np.frombuffer(b"".join(x for *_, x in held), np.uint8), ends[:-1], ends[1:], np.array([r for r, *_ in held], np.int64), np.array([o for _, o, _ in held], np.int64)

    for batch in batches:
        for row, n, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            text = plain(z.as_buffer(), n)
            for at in range(0, max(1, n - LENGTH + 1), PIECE):
                held.append((row, at, text[at : at + PIECE + LENGTH - 1]))
                size += len(held[-1][2])
                if size >= PIECE:
                    yield close()
                    held, size = [], 0
    if held:
        yield close()


# ---- sorted runs


def sorted_run(strings: np.ndarray):
    """Different strings in order, with: common prefix with the one before, and whether there were several equal ones."""
    words = strings.view(">u8").astype(U)
    order = np.lexsort(words.T[::-1])
    strings = strings[order]
    differ = strings[1:] != strings[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), PREFIX)
    new = np.flatnonzero(np.concatenate([[True], lcp < PREFIX]))
    count = np.diff(np.append(new, len(strings)))
    return strings[new], np.concatenate([[0], lcp])[new], count > 1


def front_coded(run, low: int, high: int) -> list:
    """Entries low to high of a sorted run as binary cells."""
    strings, lcp, several = (x[low:high] for x in run)
    lcp = lcp.astype(np.uint8)
    lcp[0] = 0
    tails = strings[np.arange(PREFIX)[None, :] >= lcp[:, None]]
    return [x.tobytes() for x in (lcp, tails, np.packbits(several))]


def decoded(cells):
    """(string, common prefix, several) of a front-coded run, one after the other."""
    lcp, tails = cells[0], cells[1]
    several = np.unpackbits(np.frombuffer(cells[2], np.uint8), count=len(lcp)).tolist()
    at, last = 0, b""
    for i, n in enumerate(lcp):
        last = last[:n] + tails[at : at + PREFIX - n]
        at += PREFIX - n
        yield last, n, several[i]


def merge(runs: list):
    """Loser tree over iterators of sorted (string, common prefix with the one before, several): all of them in order,
    each as (string, common prefix with the string given before, several).

    ``h`` is a contender's common prefix with the last winner. The one with more in common is smaller; only of equally
    close ones are bytes compared, from there on. A run that has ended has h = -1 and loses.
    """
    size = 1 << max(1, (len(runs) - 1).bit_length())
    runs = [iter(r) for r in runs] + [iter(()) for _ in range(size - len(runs))]
    now = [next(r, None) for r in runs]
    string = [x[0] if x else b"" for x in now]
    h = [0 if x else -1 for x in now]

    def play(i: int, j: int) -> tuple[int, int]:
        """Winner and loser; the loser's h becomes what it shares with the winner."""
        hi, hj = h[i], h[j]
        if hi != hj:
            return (i, j) if hi > hj else (j, i)
        if hi < 0 or hi == PREFIX:
            return i, j
        x, y, n = string[i], string[j], hi
        while n < PREFIX and x[n] == y[n]:
            n += 1
        if n < PREFIX and x[n] > y[n]:
            i, j = j, i
        h[j] = n
        return i, j

    tree = [0] * size
    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], tree[node] = play(winners[2 * node], winners[2 * node + 1])
    w = winners[1]
    while h[w] >= 0:
        yield string[w], h[w], now[w][2]
        now[w] = x = next(runs[w], None)
        if x:
            string[w], h[w] = x[0], x[1]
        else:
            h[w] = -1
        node = (w + size) >> 1
        while node:
            w, tree[node] = play(w, tree[node])
            node >>= 1


CELLS = ["lcp", "tails", "several"]
RUNS = ["row", "kh", "at"]  # at: first window, the anchor's place in it and windows less one, in 48, 8 and 8 bits
FIRST, OFFSET, COUNT = "shiftright(at, 16)", "shiftright(at, 8) & 255", "at & 255"


def pick_splitters(texts: DataFrame, ranges: int) -> list[bytes]:
    """Strings that cut the anchors' suffixes into about equal ranges. They come from blocks of BLOCK bytes, eight blocks
    for each range, chosen by hash from all texts, and only balance the work."""
    blocks = F.ceil(F.col("size") / BLOCK)
    long = texts.filter(F.col("size") >= LENGTH)
    total = long.agg(F.sum(blocks)).first()[0] or 0
    if ranges < 2 or not total:
        return []
    share = int(min(1.0, 8 * ranges / total) * (1 << 30)) + 1
    some = long.withColumn("blocks", F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda b: F.pmod(F.xxhash64("row", b), F.lit(1 << 30)) < share))

    def run(batches):
        for batch in batches:
            for n, z, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = plain(z.as_buffer(), n)
                for b in at:
                    buf = np.frombuffer(text[b * BLOCK : (b + 1) * BLOCK + LENGTH - 1], np.uint8)
                    _, a, *_ = anchors(buf, np.array([0]), np.array([len(buf)]))
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array([buf[i : i + PREFIX].tobytes() for i in a[:: max(1, len(a) // 8)].tolist()], pa.binary())], ["s"])

    found = some.filter(F.size("blocks") > 0).select("size", "z", "blocks").mapInArrow(run, "s binary").collect()
    found = sorted({bytes(r.s) for r in found})
    ranges = min(ranges, len(found))
    return [found[len(found) * i // ranges] for i in range(1, ranges)]


def anchored(texts: DataFrame, splitters: list[bytes]) -> DataFrame:
    """Two kinds of rows from one pass over texts: every run of windows (RUNS: row, hash of its anchor's prefix, place), and
    front-coded parts of sorted runs of the anchors' prefixes by range."""
    longs, binaries = [*RUNS], [*CELLS]
    schema = pa.schema([*((c, pa.int64()) for c in longs), ("range", pa.int32()), *((c, pa.binary()) for c in binaries)])

    def run(batches):
        strings: list[np.ndarray] = []
        size = 0

        def close():
            done = sorted_run(np.concatenate(strings))
            cut = [0, *(bisect.bisect_left(range(len(done[0])), s, key=lambda i: done[0][i].tobytes()) for s in splitters), len(done[0])]
            rows = [(r, *front_coded(done, a, b)) for r, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
            nothing = pa.nulls(len(rows), pa.int64())
            return pa.RecordBatch.from_arrays([*[nothing] * len(longs), *(pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), *[pa.binary()] * len(binaries)]))], schema=schema)

        for buf, starts, stops, rows, offsets in pieces(batches):
            doc, a, lo, hi, kh = anchors(buf, starts, stops)
            if len(a):
                cells = [rows[doc], kh.view(np.int64), (lo - starts[doc] + offsets[doc]) << 16 | (a - lo) << 8 | hi - lo]
                yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in cells), pa.nulls(len(a), pa.int32()), *[pa.nulls(len(a), pa.binary())] * len(binaries)], schema=schema)
                strings.append(np.lib.stride_tricks.sliding_window_view(buf, PREFIX)[a])
                size += len(a)
                if size >= RUN:
                    yield close()
                    strings, size = [], 0
        if size:
            yield close()

    kinds = ", ".join([*(f"{c} long" for c in longs), "range int", *(f"{c} binary" for c in binaries)])
    return texts.select("row", "size", "z").mapInArrow(run, kinds)


def repeated_prefixes(runs: DataFrame, ranges: int) -> DataFrame:
    """(kh): hash of each PREFIX-byte string that is an anchor twice or more, from front-coded runs."""

    def merged(batches):
        cells = [row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(1, 4)))]
        found: list[bytes] = []

        def close():
            kh = HASH.of_all(np.frombuffer(b"".join(found), np.uint8), PREFIX)[::PREFIX]
            return pa.RecordBatch.from_arrays([pa.array(kh.view(np.int64))], ["kh"])

        last_found = False
        for s, shared, several in merge([decoded(c) for c in cells]) if cells else ():
            again = shared == PREFIX
            if several and not again or again and not last_found:
                found.append(s)
            last_found = bool(several) or again
            if len(found) >= 1 << 14:
                yield close()
                found = []
        if found:
            yield close()

    return runs.select("range", *CELLS).repartitionById(ranges, "range").mapInArrow(merged, "kh long")


# ---- candidates and what is repeated of them


def run_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(row, kh, lo, off, n) with the text t of each run of windows."""
    names = ["kh", "lo", "off", "n"]
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct(*names)).alias("runs"))  # of one document

    def run(batches):
        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [*[pa.int64()] * 5, pa.binary()])], ["row", *names, "t"])

        rows: list[tuple] = []
        for batch in batches:
            for row, size, z, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                text = plain(z.as_buffer(), size)
                for r in runs.as_py():
                    rows.append((row, *(r[c] for c in names), text[r["lo"] : r["lo"] + r["n"] + LENGTH]))
                    if len(rows) >= 4096:
                        yield made(rows)
                        rows = []
        if rows:
            yield made(rows)

    joined = texts.select("row", "size", "z").join(lists, "row").select("row", "size", "z", "runs")
    return joined.mapInArrow(run, "row long, kh long, lo long, off long, n long, t binary")


def alone_few(texts: list[bytes]) -> list[np.ndarray]:
    """For each text of a few, whether each of its windows is found nowhere else in them."""
    owner: dict[bytes, int] = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - LENGTH + 1):
            w = t[p : p + LENGTH]
            owner[w] = -1 if w in owner else i
    return [np.array([owner[t[p : p + LENGTH]] == i for p in range(len(t) - LENGTH + 1)], bool) for i, t in enumerate(texts)]


def alone_many(texts: list[bytes], hashes=None) -> list[np.ndarray]:
    """As alone_few, with a few numbers a window in memory. A window with a hash of its own is alone; those with equal
    hashes are compared by their bytes."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    counts = sizes - LENGTH + 1
    at = np.repeat(np.cumsum(sizes) - sizes - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    h = (hashes or HASH.of_all)(buf, LENGTH)[at]
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    windows = np.lib.stride_tricks.sliding_window_view(buf, LENGTH)
    twin, mixed = np.zeros(len(at), bool), set()
    for first in range(0, len(same), 8192):
        a, b = order[same[first : first + 8192]], order[same[first : first + 8192] + 1]
        equal = (windows[at[a]] == windows[at[b]]).all(axis=1)
        twin[a[equal]] = twin[b[equal]] = True
        mixed.update(h[a[~equal]].tolist())
    for value in mixed:  # different windows with one hash
        members = np.flatnonzero(h == U(value))
        seen: dict[bytes, int] = {}
        for m in members.tolist():
            w = windows[at[m]].tobytes()
            seen[w] = seen.get(w, 0) + 1
        twin[members] = [seen[windows[at[m]].tobytes()] > 1 for m in members.tolist()]
    return np.split(~twin, np.cumsum(counts)[:-1])


def unique_windows(classes: DataFrame, few: int = 64) -> DataFrame:
    """(row, lo, n) of the windows that no other of classes(kh, m, row, lo, t) with the same kh has, of those with m = 1.

    Equal windows have equal anchors, so all runs that could share one are in one task."""
    dealt = classes.repartition(parts(classes), "kh").sortWithinPartitions("kh")

    def run(batches):
        for _, m, row, lo, texts in groups(batches, ["kh"], ["m", "row", "lo", "t"]):
            if not (m == 1).any():
                continue
            texts = texts.tolist()
            found = (alone_few if len(texts) <= few else alone_many)(texts)
            out = []
            for i in np.flatnonzero(m == 1).tolist():
                edges = np.diff(found[i].astype(np.int8), prepend=0, append=0)
                for s, e in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
                    out.append((row[i], lo[i] + s, e - s - 1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["row", "lo", "n"])

    return dealt.select("kh", "m", "row", "lo", "t").mapInArrow(run, "row long, lo long, n long")


def unique_windows_spread(classes: DataFrame) -> DataFrame:
    """As unique_windows, for prefixes with very many different runs: every window is a row, grouped by its bytes."""

    def run(batches):
        for batch in batches:
            m, row, lo = (batch.column(i).to_numpy() for i in range(3))
            for i, t in enumerate(batch.column(3).to_pylist()):
                count = len(t) - LENGTH + 1
                cells = [np.full(count, m[i]), np.full(count, row[i]), lo[i] + np.arange(count)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in cells), pa.array([t[p : p + LENGTH] for p in range(count)], pa.binary())], ["m", "row", "lo", "w"])

    windows = classes.select("m", "row", "lo", "t").mapInArrow(run, "m long, row long, lo long, w binary")
    once = windows.groupBy("w").agg(F.count("*").alias("c"), F.max("m").alias("m"), F.min("row").alias("row"), F.min("lo").alias("lo")).filter("c = 1 and m = 1")
    return once.select("row", "lo", F.lit(0).cast("long").alias("n"))


def repeated_windows(texts: DataFrame, hot: int = 16_384) -> DataFrame:
    """(row, spans): for each row of texts (written by squeezed) with candidates, an array of (first window, windows less
    one, unique or not), unordered. Repeated are the windows of those that aren't unique less the unique ones."""
    size = texts.agg(F.sum(F.when(F.col("size") >= LENGTH, F.col("size")))).first()[0] or 0
    splitters = pick_splitters(texts, max(parts(texts), size // 85 // RANGE))
    both = settle(anchored(texts, splitters), "zstd")
    repeated = repeated_prefixes(both.filter("range is not null"), len(splitters) + 1)
    place = [F.expr(x).alias(c) for x, c in ((FIRST, "lo"), (OFFSET, "off"), (COUNT, "n"))]
    found = settle(both.filter("row is not null").select(*RUNS).join(repeated, "kh").select("row", "kh", *place))
    discard(both)
    least = [F.min(c).alias(c) for c in ("kh", "row", "lo")]  # of one row where m = 1; kh follows from off and t
    classes = settle(run_texts(texts, found).groupBy("off", "t").agg(F.count("*").alias("m"), *least), "zstd")
    crowded = settle(classes.groupBy("kh").agg(F.count("*").alias("size")).filter(F.col("size") > hot).select("kh"))
    span = lambda df, unique: df.select("row", F.struct("lo", "n", F.lit(unique).alias("unique")).alias("s"))
    if crowded.isEmpty():
        spans = span(found, False).unionByName(span(unique_windows(classes), True))
    else:
        spans = span(found, False).unionByName(span(unique_windows(classes.join(crowded, "kh", "left_anti")), True))
        spans = spans.unionByName(span(unique_windows_spread(classes.join(crowded, "kh", "left_semi")), True))
    spans = settle(spans.groupBy("row").agg(F.collect_list("s").alias("spans")))  # of one document
    discard(found, classes, crowded)
    return spans


# ---- results


def byte_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal stretches of bytes covered by repeated windows."""
    runs = sorted((s["lo"], s["lo"] + s["n"] + 1) for s in spans or [] if not s["unique"])
    holes = sorted((s["lo"], s["lo"] + s["n"] + 1) for s in spans or [] if s["unique"])
    out: list[tuple[int, int]] = []

    def cover(first: int, stop: int) -> None:
        if first < stop:
            lo, hi = first, stop - 1 + LENGTH
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], hi))
            else:
                out.append((lo, hi))

    at = 0
    for first, stop in runs:
        while at < len(holes) and holes[at][0] < stop:
            cover(first, holes[at][0])
            first, at = holes[at][1], at + 1
        cover(first, stop)
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for s, e in spans:
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]])


def removal_digests(docs: DataFrame, hot: int = 16_384) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (start, end in bytes), kept_sha256 for each row of docs(doc_id, text).

    Each byte is removed that a LENGTH-byte string covers which also starts anywhere else, in the same document or
    another; overlapping ones count. Documents don't run into each other. Null texts are empty; texts of any length are
    read whole (in overlapping chunks); a repeated row is another document, so both are removed from; null doc_ids stay;
    other columns are ignored; an empty table gives an empty result. Prefixes with more than ``hot`` different runs are
    compared over many tasks.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"]

    def run(batches):
        for batch in batches:
            got = []
            for size, z, spans in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                at = byte_spans(spans.as_py())
                kept = without(plain(z.as_buffer(), size), at)
                got.append((size, size - len(kept), len(at), [{"start": s, "end": e} for s, e in at], hashlib.sha256(kept).hexdigest()))
            if got:
                types = [pa.int64(), pa.int64(), pa.int64(), kind, pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*got), types))], names)

    texts = settle(squeezed(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id"))
    joined = texts.join(repeated_windows(texts, hot), "row", "left").select("doc_id", "size", "z", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept_sha256 string")


def remove_repeats(docs: DataFrame, hot: int = 16_384) -> DataFrame:
    """The rows of docs with repeated strings cut from ``text`` (and ``n_chars``, if there, counted anew).

    As removal_digests, but a character of which a part would stay stays whole. All columns stay, whatever their names.
    """
    columns = docs.columns
    others = [c for c in columns if c != "text"]

    def cut(text: bytes, spans) -> str:
        whole = []
        for s, e in byte_spans(spans):
            while s < e and text[s] & 0xC0 == 0x80:
                s += 1
            while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
                e -= 1
            whole.append((s, e))
        return without(text, whole).decode()

    def run(batches):
        for batch in batches:
            rest, missing, size, z, spans = batch.columns
            texts = [None if m else cut(plain(t.as_buffer(), n), s.as_py()) for m, n, t, s in zip(missing.to_pylist(), size.to_pylist(), z, spans)]
            cells = dict(zip(others, rest.flatten())) | {"text": pa.array(texts, pa.string())}
            if "n_chars" in cells:
                cells["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(cells["n_chars"].type)
            yield pa.RecordBatch.from_arrays([cells[c] for c in columns], columns)

    doc = F.struct(F.col("text").isNull().alias("missing"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest")).alias("doc")
    rows = settle(squeezed(docs.select("text", doc), "doc"))
    joined = rows.join(repeated_windows(rows, hot), "row", "left")
    return joined.select("doc.rest", "doc.missing", "size", "z", "spans").mapInArrow(run, docs.schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(table(spark, sf_dir, "documents")).drop("spans")
