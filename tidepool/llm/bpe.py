"""Operator 4: BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens. It starts as one state with an arc for each byte. Merge number k, (u, v) -> uv, adds a
gadget: the state behind u loses its arc v (a copy of the state, if others use it too), and wherever there is an arc u,
an arc uv is added that leads to where v leads. A sequence of tokens is a path of the finished automaton if and only if
it is what the merges make of its bytes, so every string of bytes is spelled by exactly one path.

All arcs of one label lead to one state, and the arcs of a copy are those of its origin at the time of the copy less
what it lost later. So states are kept as (origin, time of copy, arcs lost and when).

Encoding is driven by two tables of whole numbers: one goes from (node, byte) to the next node of the labels' byte trie,
the other from (state, label) to the state behind the arc, or to nothing; its cells are filled in when a word first needs
them. Each prefix of a word has at most one path, so there is one state for each position, from which the trie is walked
as far as the word follows it; the longest label is tried first, as most paths take it.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .tokens import split_added, vocabulary, vocabulary_path

NEVER = 1 << 60
MOST_ARCS = 1 << 19  # cells of the table of arcs that are kept, some 60 MB; texts in which every word is new fill it
# what the pattern says of ASCII texts, in the classes of Python's own, faster expressions
ASCII_PATTERN = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")


class Automaton:
    def __init__(self, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ids = ids
        self.label = {i: b for b, i in ids.items()}
        self.origin, self.since, self.lost = [-1], [0], [{}]  # state 0: the start
        self.behind = {ids[bytes([b])]: 0 for b in range(256)}  # state that a label's arcs lead to
        self.made: dict[int, tuple[int, int]] = {}  # merged label: its left part, its time
        self.dead: set[int] = set()
        users = [257]  # labels that lead to a state; the start counts as one more
        for k, (a, b) in enumerate(merges):
            u, v, uv = ids[a], ids[b], ids[a + b]
            old = self.behind[u]
            if not self._has(old, v, k):  # v never follows u: the merge is never used
                self.dead.add(uv)
                self.behind[uv] = 0
                users[0] += 1
                continue
            target = self.behind[v]
            new = old
            if users[old] > 1 or u == v:
                users[old] -= 1
                new = len(self.origin)
                self.origin.append(old)
                self.since.append(k)
                self.lost.append({})
                users.append(1)
                self.behind[u] = new
            self.lost[new][v] = k
            self.made[uv] = (u, k)
            self.behind[uv] = target
            users[target] += 1
        self.step: dict[int, int] = {}  # node << 8 | byte: next node of the trie
        self.ends = [-1]  # the label that ends at a node
        for label, token in ids.items():
            node = 0
            for byte in label:
                node = self.step.setdefault(node << 8 | byte, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = token
        self.arcs: dict[int, int] = {}  # state << 32 | label: state behind the arc, -1: no arc

    def _has(self, state: int, token: int, time: int) -> bool:
        """Whether a state has an arc at a time: it was there when it was made, and wasn't lost since."""
        while True:
            s, until = state, time
            while s >= 0:
                if self.lost[s].get(token, NEVER) < until:
                    return False
                until = min(until, self.since[s])
                s = self.origin[s]
            if token in self.dead:
                return False
            if token not in self.made:
                return True
            token, time = self.made[token]
            time += 1  # what the same merge took away is gone already

    def _arc(self, state: int, token: int) -> int:
        cell = state << 32 | token
        to = self.arcs[cell] = self.behind[token] if self._has(state, token, NEVER) else -1
        return to

    def encode(self, word: bytes) -> list[int]:
        """The labels of the one path that spells the word.

        From each position the longest label with an arc is followed first. A position is left for good when nothing
        leads on from it, so each is visited once at most.
        """
        if (whole := self.ids.get(word)) is not None and self._arc(0, whole) >= 0:
            return [whole]
        if len(self.arcs) > MOST_ARCS:
            self.arcs.clear()
        step, ends, arcs, n = self.step, self.ends, self.arcs, len(word)
        came: dict[int, tuple[int, int]] = {}  # position: where its label begins, and the label
        open_ = [(0, 0)]  # positions to go on from, with their states
        while n not in came:
            at, state = open_.pop()
            node, base = 0, state << 32
            for j in range(at, n):
                node = step.get(node << 8 | word[j])
                if node is None:
                    break
                token = ends[node]
                if token >= 0 and j + 1 not in came:
                    to = arcs.get(base | token)
                    if to is None:
                        to = self._arc(state, token)
                    if to >= 0:
                        came[j + 1] = at, token
                        open_.append((j + 1, to))
        out, at = [], n
        while at:
            at, token = came[at]
            out.append(token)
        return out[::-1]


class Words(dict):
    """Ids (as bytes) by word, made when first asked for. ``most`` bounds the bytes held; long words aren't kept."""

    def __init__(self, automaton: Automaton, most: int = 1 << 27):
        self.automaton, self.most, self.held = automaton, most, 0

    def __missing__(self, word: str) -> bytes:
        ids = self.automaton.encode(word.encode())
        made = struct.pack(f"<{len(ids)}I", *ids)
        size = 150 + len(word) + len(made)
        if size < 1024:
            if self.held + size > self.most:
                self.clear()
                self.held = 0
            self[word] = made
            self.held += size
        return made


class Codec:
    """Encoder and decoder of whole texts."""

    def __init__(self, path: str):
        ids, merges, self.added = vocabulary(path)
        automaton = Automaton(ids, merges)
        self.words = Words(automaton)
        self.find, self.find_ascii = regex.compile(public_tokenizers.PATTERN).findall, re.compile(ASCII_PATTERN, re.ASCII).findall
        self.label = automaton.label | {i: s.encode() for s, i in self.added.items()}

    def encode(self, text: str | None) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for part, special in split_added(text or "", self.added):
            out += map(self.words.__getitem__, (self.find_ascii if part.isascii() else self.find)(part))
            if special is not None:
                out.append(np.array([special], "<u4").tobytes())
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.label.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for each Python worker; workers serve many tasks."""
    return Codec(path)


def encode_texts(docs: DataFrame, path: str | None = None, rows: int = 64) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit), n_tokens, decoded for each row of ``docs(doc_id, text)``.

    A null or empty text has no ids and decodes to an empty text; texts of any length are encoded whole; repeated rows
    are encoded each; null doc_ids stay; other columns are ignored; an empty table gives an empty result.
    """
    return _map(docs, path, "doc_id long, n_tokens long, ids binary, decoded string", lambda ids, text: (len(ids) // 4, ids, text), rows)


def encode_digests(docs: DataFrame, path: str | None = None, rows: int = 64) -> DataFrame:
    """As encode_texts, with SHA-256 digests of the ids and of the decoded text in their place."""
    digest = lambda ids, text: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    return _map(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digest, rows)


def _map(docs: DataFrame, path: str | None, schema: str, made, rows: int) -> DataFrame:
    path = path or vocabulary_path()
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        tool = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):  # few texts at a time, as each can be long
                part = batch.slice(at, rows)
                got = []
                for text in part.column(1).to_pylist():
                    ids = tool.encode(text)
                    got.append(made(ids, tool.decode(ids)))
                columns = [part.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*got), types[1:]))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
