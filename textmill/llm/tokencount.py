"""Token counts by a two-tier lookup on the map side.

A text is split at added tokens, normalised and cut into pre-tokens as the tokenizer's file says; its count is the sum of its
pre-tokens' lengths. Lengths of frequent pre-tokens are a compact table (one blob of words, their ends, their
lengths) that every worker turns into a hash table once; it holds at most FREQUENT words, so the broadcast has a bound. A
word that misses it goes to a cache of the worker, and those new to the cache are encoded in one batch. No pre-token is ever shuffled.

Which words are frequent is read from a bounded sample of texts; the table saves work and never changes a count.

Defined results: a null text is an empty one and has no tokens; repeated rows and equal texts have equal counts; whole texts are counted, however long; an
empty table gives no rows; columns asked for in ``keep`` give way to those of the result where names clash.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.bpe import ODD
from textmill.llm.shared import map_text, sample_texts

#: Words of the broadcast table, texts and code points of each from which they are chosen, words of a worker's cache.
FREQUENT, SAMPLE, SAMPLE_CHARS, CACHE_WORDS = 50_000, 1000, 20_000, 400_000
LIMIT = 2048
LONG = 256
#: The one file form that has a fast path: these normalisers and this pattern, in lower case and without white space.
NORMAL = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: PATTERN for texts without ODD characters, where letters are word characters without digits and underscore.
FAST = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_counters: dict[str, "Pretokens"] = {}


class Pretokens:
    """Splits texts into pre-tokens and gives the lengths of pre-tokens, both by a file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        steps = (said["pre_tokenizer"] or {}).get("pretokenizers", [])
        if len(steps) != 2 or steps[0]["type"] != "Split" or steps[1]["type"] != "ByteLevel" or steps[1]["use_regex"]:
            raise ValueError("the file must split by a pattern and then map bytes")
        added = sorted((t["content"] for t in said["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        plain = {"truncation": None, "padding": None, "post_processor": None}
        splits = said | plain | {"pre_tokenizer": {"type": "Sequence", "pretokenizers": steps[:1]}, "added_tokens": []}
        self.splitter = Tokenizer.from_str(json.dumps(splits))
        self.coder = Tokenizer.from_str(json.dumps(said | plain | {"normalizer": None, "pre_tokenizer": steps[1], "added_tokens": []}))
        names = [n["type"] for n in (said["normalizer"] or {}).get("normalizers", [])]
        self.fast = names == NORMAL and steps[0]["pattern"].get("Regex") == PATTERN and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
        self.cache: dict[str, int] = {}

    def split(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many added tokens it holds."""
        if self.added is None or not self.added.search(text):
            return self.words(text), 0
        parts = self.added.split(text)
        return [w for p in parts for w in self.words(p)], len(parts) - 1

    def words(self, part: str) -> list[str]:
        if self.fast and not ODD.search(part):
            return FAST.findall(part.lower())
        if self.splitter.normalizer is not None:
            part = self.splitter.normalizer.normalize_str(part)
        return [w for w, _ in self.splitter.pre_tokenizer.pre_tokenize_str(part)]

    def lengths(self, words: list[str]) -> list[int]:
        return [len(e.ids) for e in self.coder.encode_batch(words, add_special_tokens=False)]


def counter(path: str) -> Pretokens:
    if path not in _counters:
        _counters[path] = Pretokens(path)
    return _counters[path]


class Tiers(dict):
    """The frequent words' lengths; what is not there is looked up among the worker's own."""

    def __init__(self, pairs, own: dict[str, int]) -> None:
        super().__init__(pairs)
        self.own = own

    def __missing__(self, word: str) -> int:
        return self.own[word]


def frequent(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", most: int = FREQUENT) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The table of the ``most`` most frequent pre-tokens of at most SAMPLE texts: their UTF-8 end to end, their ends, their lengths in tokens."""
    split = counter(tokenizer).split
    seen: Counter = Counter()
    for t in sample_texts(df, text, key, SAMPLE, SAMPLE_CHARS):
        seen.update(split(t)[0])
    words = [w for w, _ in seen.most_common(most) if len(w) <= LONG]
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
    return b"".join(raw), ends, np.array(counter(tokenizer).lengths(words), np.int32)


def count_tokens(
    df: DataFrame, tokenizer: str, table: tuple[bytes, np.ndarray, np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = LIMIT
) -> DataFrame:
    """keep with n_tokens and over_limit. ``tokenizer``: path of a file on every worker; ``table`` is what ``frequent`` gives."""
    shared = df.sparkSession.sparkContext.broadcast(table)

    def make():
        c = counter(tokenizer)
        blob, ends, lengths = shared.value
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        words = [blob[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
        tiers = Tiers(zip(words, lengths.tolist()), c.cache)

        def block(texts: pa.Array) -> list:
            made = [c.split(t or "") for t in texts.to_pylist()]
            new = set(chain.from_iterable(w for w, _ in made)) - tiers.keys()
            if len(c.cache) > CACHE_WORDS:
                c.cache.clear()
            new = list(new.difference(c.cache))
            c.cache.update(zip(new, c.lengths(new)))
            n = np.array([sum(map(tiers.__getitem__, w)) + k for w, k in made], np.int64)
            for w in new:
                if len(w) > LONG:
                    del c.cache[w]
            return [n, n > limit]

        return block

    return map_text(df, make, "n_tokens long, over_limit boolean", text, list(keep))


def n_bytes(text: str = "text") -> F.Column:
    """The UTF-8 bytes of a text, 0 if it is null."""
    return F.octet_length(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).cast("long")
