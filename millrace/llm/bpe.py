"""Byte-level BPE of whole texts, by merges over a segment tree of adjacent pair ranks."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NONE = 1 << 40
#: Distinct pieces of text remembered by a worker; beyond it the memory starts anew. It bounds memory, not the result.
CACHE = 400_000


def tokenizer_dir() -> str:
    """The folder of the public vocabularies: $MILLRACE_TOKENIZERS, else /opt/tokenizers."""
    return os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")


def merge(ids: list[int], pair: dict[int, int]) -> list[int]:
    """Merges the leftmost pair of lowest rank until none is left.

    pair: (left << 32 | right) -> the id of the merged token, which is also its rank. The tree's leaf i holds the rank of the
    pair that starts at position i; an inner node the lower of its children, so the root is the lowest rank and a descent that
    prefers left children finds its leftmost leaf. A merge changes three leaves, each with a walk to the root.
    """
    n = len(ids)
    if n < 2:
        return ids
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    get = pair.get
    tree[size : size + n - 1] = [get(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:])]
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (low := tree[1]) != _NONE:
        i = 1
        while i < size:
            i *= 2
            if tree[i] != low:
                i += 1
        i -= size
        j = after[i]
        ids[i], ids[j] = low, -1
        k = after[i] = after[j]
        changed = [(j, _NONE), (i, get(low << 32 | ids[k], _NONE) if k < n else _NONE)]
        if k < n:
            before[k] = i
        if (h := before[i]) >= 0:
            changed.append((h, get(ids[h] << 32 | low, _NONE)))
        for leaf, value in changed:
            p = leaf + size
            tree[p] = value
            p >>= 1
            while p:
                a, b = tree[2 * p], tree[2 * p + 1]
                value = a if a <= b else b
                if tree[p] == value:
                    break
                tree[p] = value
                p >>= 1
    return [t for t in ids if t >= 0]


class Encoder:
    """Encodes texts by a rank file: text is split by the public pattern, each piece's bytes merged by rank."""

    def __init__(self, path: str):
        import re

        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.single = [ranks[bytes([i])] for i in range(256)]
        # rank files name tokens, not merges; a token is reached by merging any two tokens that spell it
        self.pair: dict[int, int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    self.pair[a << 32 | b] = rank
        # fixed values: the public pattern of these vocabularies
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        # no piece holds white space behind another character, so a text may be cut before any run of it without changing a piece
        white = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.units = re.compile(f"[{white}]*[^{white}]+|[{white}]+").findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.known_pieces: dict[str, tuple[int, ...]] = {}

    def _unit(self, unit: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in self.pieces(unit):
            ids = self.known_pieces.get(piece)
            if ids is None:
                single = self.single
                ids = tuple(merge([single[b] for b in piece.encode("utf-8", "surrogatepass")], self.pair))
                if len(piece) <= 64:
                    if len(self.known_pieces) >= CACHE:
                        self.known_pieces.clear()
                    self.known_pieces[piece] = ids
            out += ids
        ids = tuple(out)
        if len(unit) <= 64:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[unit] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without special tokens; strings of special tokens are ordinary text."""
        get, unit, out = self.known.get, self._unit, []
        for u in self.units(text):
            out += get(u) or unit(u)
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    return Encoder(path)


def _path(vocabulary: str | None) -> str:
    return vocabulary or f"{tokenizer_dir()}/byte_bpe_50k.tiktoken"


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids ARRAY<INT>): the token ids of each text.

    A null text has null ids, an empty one an empty list, a blank one the ids of its white space. Every row is encoded whole,
    repeated rows each. vocabulary: a rank file, that each executor reads at this path.
    """
    path, kind = _path(vocabulary), df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc = encoder(path)
        for b in batches:
            flat: list[int] = []
            ends, valid = [0], []
            for t in b.column(1).to_pylist():
                if t:
                    flat += enc.encode(t)
                valid.append(t is not None)
                ends.append(len(flat))
            values = pa.array(np.array(flat, dtype=np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([not v for v in valid], pa.bool_()) if valid else None)
            yield pa.RecordBatch.from_arrays([b.column(0), lists], [key, "ids"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def lengths(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, n_tokens INT): the number of token ids of each text; 0 for a null or empty one."""
    path, kind = _path(vocabulary), df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = [len(enc.encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], [key, "n_tokens"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_tokens int")
