"""Cost-balanced packing of tokenised documents into sequences.

A document of n ids costs ``linear * n + quadratic * n * n`` (attention inside the document). Within a window of
``window_tokens`` ids of one partition, the number and capacity of the sequences follow from the number of ids: as many
of ``seq_len`` as they fill, and for the rest sequences whose lengths are powers of two, which need no padding. Documents
in descending order of cost each go to the sequence of lowest cost that has room; one that fits nowhere (longer
than a sequence, or none has room) is cut to fill the emptiest sequence, and its rest queues again. Nothing is shuffled: a window holds a
bounded number of ids, and sequence ids join the partition's number with a counter.

Defined results: a null text counts as empty and is one piece of the end id alone; repeated rows are packed each for
itself; an empty table gives no pieces; sequences depend on the partitions in which the rows arrive.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.llm.bpe import split
from textmill.llm.shared import text_blocks

SEQ_LEN = 2048
END_ID = 1
CACHE_WORDS = 800_000
_memos: dict[str, "WordTokens"] = {}


class WordTokens:
    """ids of a byte-level BPE file of the tokenizers library, remembered for each pre-token or added token as unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile(f"({'|'.join(map(re.escape, added))})") if added else None
        self.cache: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Words that are a space and letters are encoded end to end, as they stay pre-tokens of their own."""
        plain = [w for w in words if w[0] == " " and w[1:].isalpha()]
        if plain:
            made = self.tokenizer.encode("".join(plain), add_special_tokens=False)
            ids, word = np.array(made.ids, np.uint32).tobytes(), np.array(made.word_ids, np.int64)
            at = (np.append(np.flatnonzero(np.diff(word, prepend=-1)), len(word)) * 4).tolist()
            if len(at) == len(plain) + 1:
                self.cache.update(zip(plain, (ids[a:b] for a, b in zip(at, at[1:]))))
        rest = [w for w in words if w not in self.cache]
        self.cache.update(zip(rest, (array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(rest, add_special_tokens=False))))

    def split(self, text: str) -> list[str]:
        """The added tokens of the text, and the pre-tokens of what lies between."""
        if self.added is None or not self.added.search(text):
            return split(text)
        return [w for i, part in enumerate(self.added.split(text)) for w in ([part] if i % 2 else split(part))]

    def __call__(self, texts: list[str]) -> list[bytes]:
        words = [self.split(t) for t in texts]
        new = set(chain.from_iterable(words)).difference(self.cache)
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache = {}
            new = set(chain.from_iterable(words))
        self.learn(list(new))
        get = self.cache.__getitem__
        return [b"".join(map(get, w)) for w in words]


def tokens_of(path: str) -> WordTokens:
    if path not in _memos:
        _memos[path] = WordTokens(path)
    return _memos[path]


def capacities(total: int, seq_len: int) -> list[int]:
    """Sequences that hold the total without padding: full ones, then descending powers of two."""
    rest = total % seq_len
    return [seq_len] * (total // seq_len) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: list[int], seq_len: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece."""
    room = np.array(capacities(sum(lengths), seq_len), np.int64)
    size = room.copy()
    cost = np.zeros(len(room))
    queue = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(queue)
    pieces = []
    while queue:
        n, i, start = heapq.heappop(queue)
        n = -n
        fits = np.where(room >= n, cost, np.inf)
        s = int(fits.argmin())
        if fits[s] == np.inf:
            s = int(room.argmax())
            heapq.heappush(queue, (-(n - int(room[s])), i, start + int(room[s])))
            n = int(room[s])
        pieces.append((i, start, n, s, int(size[s] - room[s])))
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n
    return pieces


def pack_documents(
    df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", seq_len: int = SEQ_LEN, end_id: int = END_ID,
    linear: float = 1.0, quadratic: float = 1 / 2048, window_tokens: int = 1 << 21, with_ids: bool = False,
) -> DataFrame:
    """One row a piece: the key, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost and, if wanted, its ids.

    ``tokenizer``: path of a tokenizers JSON file on every worker. Other columns of df are left out.
    """
    fields = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double" + ", ids array<int>" * with_ids
    schema = T.StructType([T.StructField(key, df.schema[key].dataType)] + T._parse_datatype_string(fields).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = tokens_of(tokenizer), TaskContext.get().partitionId() << 32
        keys: list[pa.Array] = []
        docs: list[np.ndarray] = []
        held = used = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, docs, held, used
            pieces = assign([len(d) for d in docs], seq_len, linear, quadratic)
            doc, start, length, seq, offset = (np.array(c, np.int64) for c in zip(*pieces))
            parts = [docs[i][a : a + n] for i, a, n, _, _ in pieces]
            arrays = [pa.concat_arrays(keys).take(pa.array(doc)), start, length, np.array([zlib.crc32(p) for p in parts], np.int64)]
            arrays += [np.array([len(docs[i]) for i in doc], np.int64), seq + (task + used), offset, linear * length + quadratic * length * length]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(np.concatenate(parts).astype(np.int32))))
            used += int(seq.max()) + 1
            keys, docs, held = [], [], 0
            return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=schema.fieldNames())

        for block in text_blocks(batches, 1, 1 << 21):
            end = array("I", [end_id]).tobytes()
            docs += [np.frombuffer(ids + end, np.uint32) for ids in encode([t or "" for t in block.column(1).to_pylist()])]
            keys.append(block.column(0))
            held += sum(len(d) for d in docs[-block.num_rows :])
            if held >= window_tokens:
                yield flush()
        if docs:
            yield flush()

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)
