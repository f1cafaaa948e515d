"""Token ids of whole texts by a public byte-level BPE vocabulary, in batches inside tasks."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=2)
def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], dict[str, int]]:
    """Ids by bytes, merges in order, and ids of added tokens by their string."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    to_byte = byte_of_char()
    raw = lambda s: bytes(to_byte[c] for c in s)
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ids = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in added}
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    return ids, [(raw(a), raw(b)) for a, b in merges], added


@lru_cache(maxsize=2)
def id_type(path: str) -> str:
    """Of the smallest little-endian unsigned integers that hold every id: 16 or 32 bits."""
    ids, _, added = vocabulary(path)
    return "<u2" if max([*ids.values(), *added.values()]) < 1 << 16 else "<u4"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    ids, _, added = vocabulary(path)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids, special_tokens={}), added, id_type(path)


def encode(text: str | None, path: str) -> np.ndarray:
    """Ids of a text (null: none) as uint16 or uint32; strings of added tokens become those tokens."""
    encoding, added, kind = _encoding(path)
    out: list[int] = []
    for part, special in split_added(text or "", added):
        out += encoding.encode_ordinary(part)
        if special is not None:
            out.append(special)
    return np.array(out, kind)


@lru_cache(maxsize=8)
def _any_of(strings: tuple[str, ...]):
    return re.compile("|".join(map(re.escape, sorted(strings, key=len, reverse=True))))  # of those at one place, the longest


def split_added(text: str, added: dict[str, int]):
    """The text's parts between added tokens, each with the added token that follows it (the last: None)."""
    at = 0
    for hit in _any_of(tuple(added)).finditer(text) if added else ():
        yield text[at : hit.start()], added[hit.group()]
        at = hit.end()
    yield text[at:], None
