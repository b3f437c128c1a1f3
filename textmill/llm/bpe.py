"""Byte-level BPE by a segment tree over byte positions.

Every leaf stands for the pair that starts at a live position and holds (rank, position); inner nodes hold the
minimum, so the root is the leftmost pair of least rank. A merge changes three leaves (the merged pair, its dead right
half and the left neighbour's pair), each of which is carried to the root in logarithmic time. Words of like length are
merged side by side in numpy; long ones go through the same tree one at a time.

Defined results: null and empty texts have no ids; equal texts have equal ids; every text decodes to its own UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from textmill.llm.shared import map_text

LONG = 256
CACHE_WORDS = 400_000
#: Characters for which re and regex could differ on letters, numbers or space.
ODD = re.compile("[\x1c-\x1f\x80-\xbfɐ-\U0010ffff]")
#: public_tokenizers.PATTERN for the other characters, where letters are word characters without digits and underscore.
FAST = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
SLOW = regex.compile(public_tokenizers.PATTERN)
_coders: dict[str, "SegmentTreeBpe"] = {}


def split(text: str) -> list[str]:
    """The matches of public_tokenizers.PATTERN."""
    return (SLOW if ODD.search(text) else FAST).findall(text)


class SegmentTreeBpe:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {v: k for k, v in self.ranks.items()}
        self.name = {v: str(v) for v in self.ranks.values()}
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.none = int(self.values.max()) + 1
        self.cache: dict[str, tuple[int, ...]] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], self.none)

    def merge_long(self, word: bytes) -> tuple[int, ...]:
        """One word through the tree."""
        n, none, pairs = len(word), self.none, self.pairs
        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        leaves = 1 << max(1, (n - 2).bit_length())
        big = none * leaves
        tree = [big] * (2 * leaves)
        for i in range(n - 1):
            if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None:
                tree[leaves + i] = r * leaves + i
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        while tree[1] < big:
            r, i = divmod(tree[1], leaves)
            j = after[i]
            k, p = after[j], before[i]
            ids[i], ids[j], after[i] = r, -1, k
            if k < n:
                before[k] = i
            r1 = pairs.get(r << 32 | ids[k], none) if k < n else none
            changed = [(i, r1 * leaves + i if r1 < none else big), (j, big)]
            if p >= 0:
                r2 = pairs.get(ids[p] << 32 | r, none)
                changed.append((p, r2 * leaves + p if r2 < none else big))
            for leaf, value in changed:
                node = leaves + leaf
                if node < 2 * leaves:
                    tree[node] = value
                    node >>= 1
                    while node:
                        tree[node] = min(tree[2 * node], tree[2 * node + 1])
                        node >>= 1
        return tuple(i for i in ids if i >= 0)

    def merge_many(self, words: list[bytes], leaves: int) -> list[tuple[int, ...]]:
        """Words of at most leaves + 1 bytes, one tree each, all trees in step."""
        rows, width = len(words), leaves + 1
        size = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(rows, width)
        ids = np.concatenate([self.byte[data], np.full((rows, 1), -1)], 1)
        at = np.arange(width + 1)
        after, before = np.tile(at + 1, (rows, 1)), np.tile(at - 1, (rows, 1))
        big = self.none * leaves
        tree = np.full((rows, 2 * leaves), big, np.int64)
        first = self.rank(ids[:, :leaves], ids[:, 1:width])
        live = (at[:leaves] < size[:, None] - 1) & (first < self.none)
        tree[:, leaves:] = np.where(live, first * leaves + at[:leaves], big)
        ids[at[None, :] >= size[:, None]] = -1
        level = leaves >> 1
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level >>= 1
        row = np.flatnonzero(tree[:, 1] < big)
        while len(row):
            r, i = np.divmod(tree[row, 1], leaves)
            j = after[row, i]
            k, p = after[row, j], before[row, i]
            ids[row, i], ids[row, j] = r, -1
            after[row, i] = k
            inside = k < size[row]
            before[row[inside], k[inside]] = i[inside]
            right = ids[row, np.minimum(k, width)]
            r1 = np.where(inside, self.rank(r, np.maximum(right, 0)), self.none)
            r2 = np.where(p >= 0, self.rank(ids[row, np.maximum(p, 0)], r), self.none)
            dead = j < leaves
            self.put(tree, leaves, row, i, np.where(r1 < self.none, r1 * leaves + i, big))
            self.put(tree, leaves, row[dead], j[dead], np.full(int(dead.sum()), big))
            has = p >= 0
            self.put(tree, leaves, row[has], p[has], np.where(r2 < self.none, r2 * leaves + p, big)[has])
            row = row[tree[row, 1] < big]
        alive = ids >= 0
        flat, ends = ids[alive].tolist(), np.cumsum(alive.sum(1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]

    @staticmethod
    def put(tree: np.ndarray, leaves: int, row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + leaves
        tree[row, node] = value
        for _ in range(leaves.bit_length() - 1):
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...] | None] = [None] * len(words)
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for i, word in enumerate(words):
            raw = word.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                out[i] = (whole,)
            elif len(raw) > LONG:
                out[i] = self.merge_long(raw)
            else:
                groups.setdefault(1 << max(1, (len(raw) - 2).bit_length()), []).append((i, raw))
        for leaves, group in groups.items():
            step = max(1, (1 << 17) // leaves)
            for a in range(0, len(group), step):
                part = group[a : a + step]
                for (i, _), ids in zip(part, self.merge_many([w for _, w in part], leaves)):
                    out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        words = [split(t) for t in texts]
        new = set(chain.from_iterable(words)).difference(self.cache)
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache = {}
            new = set(chain.from_iterable(words))
        new = list(new)
        self.cache.update(zip(new, self.encode_words(new)))
        get = self.cache.__getitem__
        return [list(chain.from_iterable(map(get, w))) for w in words]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def coder(path: str) -> SegmentTreeBpe:
    if path not in _coders:
        _coders[path] = SegmentTreeBpe(path)
    return _coders[path]


OUTPUTS = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}


def bpe_round_trip(df: DataFrame, ranks: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Encodes every text and decodes its ids; ``outputs`` are any of OUTPUTS. ``ranks``: path of a tiktoken rank file on every worker."""

    def make():
        c = coder(ranks)
        name = c.name.__getitem__

        def block(texts: pa.Array) -> list:
            made: dict[str, list] = {k: [] for k in outputs}
            for ids in c.encode([t or "" for t in texts.to_pylist()]):
                raw = c.decode(ids) if {"decoded", "decoded_sha256"} & made.keys() else b""
                for k, column in made.items():
                    column.append(
                        ids if k == "ids" else len(ids) if k == "n_tokens" else raw if k == "decoded"
                        else hashlib.sha256(" ".join(map(name, ids)).encode() if k == "ids_sha256" else raw).hexdigest()
                    )
            types = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "decoded": pa.binary()}
            return [pa.array(v, types.get(k, pa.string())) for k, v in made.items()]

        return block

    return map_text(df, make, ", ".join(f"{k} {OUTPUTS[k]}" for k in outputs), text, list(keep))
