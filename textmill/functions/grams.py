"""n-grams of tokens as 64-bit hashes, over Arrow blocks.

Here tokens are numbers: those that Spark made are dictionary-encoded, so only different words are hashed, others are found in the bytes of a block. n-grams are
sums of rows of hashes. A hash depends on the words alone, so tasks agree; two different n-grams of 10^9 share one with a probability of about 0.03.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens of a block, and bytes of a block of texts, unless one row has more; words that a worker remembers.
BLOCK_TOKENS, BLOCK_BYTES, KNOWN_WORDS = 1 << 19, 1 << 21, 1 << 20
#: Tokens whose n-grams are put in sets together, and grams that are held before equal ones are dropped.
SET_TOKENS, HELD_GRAMS = 1 << 21, 1 << 23
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
#: The first n bytes of eight.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: ASCII punctuation, which is no token by itself.
ONE_SIGN = np.isin(np.arange(256), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
_known: dict[str, int] = {}


def blocks(batches: Iterator[pa.RecordBatch], column: int, limit: int = BLOCK_TOKENS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` items in a list column, one row at least."""
    for batch in batches:
        ends, first = np.asarray(batch.column(column).offsets, np.int64), 0
        while first < batch.num_rows:
            end = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1)
            yield batch.slice(first, end - first)
            first = end


def text_blocks(batches: Iterator[pa.RecordBatch], column: int, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(slice, offsets from 0, bytes) of the batches with at most ``limit`` bytes in a binary column, one row at least; eight zeros follow the bytes."""
    for batch in batches:
        raw = batch.column(column).cast(pa.large_binary())
        ends, data, first = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1], np.frombuffer(raw.buffers()[2] or b"", np.uint8), 0
        while first < len(raw):
            end = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1)
            yield batch.slice(first, end - first), ends[first : end + 1] - ends[first], np.append(data[ends[first] : ends[end]], np.zeros(8, np.uint8))
            first = end


def runs(offsets: np.ndarray, data: np.ndarray, first: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the longest runs that begin with a byte of ``first`` and go on with bytes of ``inner`` (256 booleans each, first within inner)."""
    inside = inner[data[: offsets[-1]]]
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before, after = np.append(False, inside[:-1])[: len(inside)], np.append(inside[1:], False)[: len(inside)]
    start, end = np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1
    begin = np.append(np.flatnonzero(first[data[: offsets[-1]]]), len(inside))
    start = begin[np.searchsorted(begin, start)]
    start, end = start[start < end], end[start < end]
    return np.searchsorted(offsets, start, side="right") - 1, start, end


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word, eight at a time; words of at most eight bytes share one only if their lengths differ. Eight bytes follow the last word."""
    eight = np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), 0, (1,))
    size = end - start
    out, at, done = size.astype(np.uint64) * ODD, np.arange(len(size)), 0
    while len(at):
        x = out[at] ^ (eight[start[at] + done] & FIRST[np.minimum(size[at] - done, 8)])
        x = (x ^ (x >> np.uint64(32))) * MIX
        x = (x ^ (x >> np.uint64(29))) * ODD
        out[at] = x ^ (x >> np.uint64(32))
        done += 8
        at = at[size[at] > done]
    return out


def lowered(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches with a column of valid texts in lower case, each code point by itself, as SQL has it."""
    for batch in batches:
        yield batch.set_column(column, batch.schema.names[column], pc.utf8_lower(batch.column(column)))


@cache
def kinds() -> np.ndarray:
    """The kind of each code point: 0 blank, 1 of words, 2 other signs."""
    out = np.full(0x110000, 2, np.uint8)
    for first in range(0, 0x110000, 0x10000):
        points = np.arange(first, first + 0x10000)
        points = points[(points < 0xD800) | (points > 0xDFFF)]
        chars = pa.array(list(points.astype("<u4").tobytes().decode("utf-32-le")))
        out[points[pc.match_substring_regex(chars, r"^[\p{L}\p{M}\p{N}_]$").to_numpy(zero_copy_only=False)]] = 1
    out[list(b" \t\n\f\r")] = 0
    return out


def token_runs(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the tokens of UTF-8 texts: words and runs of other signs, without single punctuation signs. Three bytes follow the last text."""
    size = int(offsets[-1])
    kind = kinds()[data[:size]]
    first = np.flatnonzero(data[:size] >= 0xC0)  # of a code point of several bytes
    a, b, c, d = (data[first + i].astype(np.int32) for i in range(4))
    b, c, d = b & 63, c & 63, d & 63
    point = np.where(a < 0xE0, (a & 31) << 6 | b, np.where(a < 0xF0, (a & 15) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | d))
    own = kinds()[point]
    for i, least in enumerate((0, 0xC0, 0xE0, 0xF0)):
        kind[first[a >= least] + i] = own[a >= least]
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    edge[1:size] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    good = (kind[start] > 0) & ~((end - start == 1) & ONE_SIGN[data[start]])
    start, end = start[good], end[good]
    return np.searchsorted(offsets, start, side="right") - 1, start, end


def hashed(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each token of a list column; a null list has none."""
    rows = np.repeat(np.arange(len(tokens)), np.asarray(tokens.value_lengths().fill_null(0), np.int64))
    words = tokens.flatten().dictionary_encode()
    if len(_known) > KNOWN_WORDS:
        _known.clear()
    own = []
    for word in words.dictionary.to_pylist():
        if (h := _known.get(word)) is None:
            h = _known[word] = int.from_bytes(blake2b((word or "").encode(), digest_size=8).digest())
        own.append(h)
    return rows, np.array(own, np.uint64)[words.indices.to_numpy()] if own else np.zeros(0, np.uint64)


def ngrams(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, gram) of every run of n tokens of one row; grams are signed, as Spark's are."""
    count = len(hashes) - n + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    gram = np.full(count, n, np.uint64)
    for i in range(n):
        gram = (gram ^ (gram >> np.uint64(29))) * ODD + hashes[i : i + count]
    gram = (gram ^ (gram >> np.uint64(32))) * ODD
    place = np.flatnonzero(rows[:count] == rows[n - 1 :])
    return rows[place], place, (gram[place] ^ (gram[place] >> np.uint64(31))).view(np.int64)


def distinct(rows: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, count) of the different grams of each row, by gram, then row."""
    order = np.lexsort((rows, grams))
    r, g = rows[order], grams[order]
    first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (g[1:] != g[:-1]))) if len(r) else np.zeros(0, np.int64)
    return r[first], g[first], np.diff(np.append(first, len(r)))


def sets(blocks: Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray | None]], longest: int) -> Iterator[pa.RecordBatch]:
    """(group, n, part, total, grams): the sets of n-grams of the groups, one row for each part of a set, sorted, in seven bytes a gram.

    A block is the group of each row, its number of tokens, the hashes of all tokens and, if only n-grams across a seam count, the tokens of each row before its
    seam. A set is of some ``SET_TOKENS`` tokens. A gram's highest byte is its part. Totals of a group and n, equal grams too, stand at one part of each set.
    """
    held, tokens = [], 0
    for block in blocks:
        held.append(block)
        tokens += len(block[2])
        if tokens >= SET_TOKENS:
            yield from _made(held, longest)
            held, tokens = [], 0
    if tokens:
        yield from _made(held, longest)


def _made(held: list, longest: int) -> Iterator[pa.RecordBatch]:
    names = pa.concat_arrays([b[0] for b in held]).dictionary_encode(null_encoding="encode")
    code, size, hashes = names.indices.to_numpy(), np.concatenate([b[1] for b in held]), np.concatenate([b[2] for b in held])
    order = np.argsort(code, kind="stable")  # rows by group
    first = (np.cumsum(size) - size)[order]
    code, size = code[order], size[order]
    ends = np.cumsum(size)
    hashes = hashes[np.repeat(first - (ends - size), size) + np.arange(len(hashes))]
    rows = np.repeat(np.arange(len(size)), size)
    seam = None if held[0][3] is None else ends - size + np.concatenate([b[3] for b in held])[order]
    for n in range(1, longest + 1):
        row, place, gram = ngrams(rows, hashes, n)
        if seam is not None:
            across = (place < seam[row]) & (place + n > seam[row])
            row, gram = row[across], gram[across]
        if not len(gram):
            continue
        group, gram = code[row], gram.view(np.uint64)
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        totals = np.diff(np.append(starts, len(gram)))
        for start, total in zip(starts, totals):
            gram[start : start + total].sort()
        fresh = np.append(True, (gram[1:] != gram[:-1]) | (group[1:] != group[:-1]))
        group, gram = group[fresh], gram[fresh]
        part = (gram >> np.uint64(56)).astype(np.int32)
        begin = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (group[1:] != group[:-1])))
        owner, total = group[begin], np.zeros(len(begin), np.int64)
        total[np.append(True, owner[1:] != owner[:-1])] = totals
        offsets, low = (np.append(begin, len(gram)) * 7).astype(np.int32), np.ascontiguousarray(gram.view(np.uint8).reshape(-1, 8)[:, :7])
        raw = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(low)])
        columns = [names.dictionary.take(pa.array(owner)), pa.array(np.full(len(begin), n, np.int32)), pa.array(part[begin]), pa.array(total), raw]
        yield pa.RecordBatch.from_arrays(columns, names=["group", "n", "part", "total", "grams"])


def set_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, n, kinds, total) of the rows of sets(), rows of one group, n and part one after the other: one row for each part, its different grams and its total."""
    key, held, total = None, [], 0

    def closed() -> tuple:
        return key[0], key[1], len(united(held)), total

    for batch in batches:
        if not batch.num_rows:
            continue
        names, raw, done = batch.column(0).dictionary_encode(null_encoding="encode"), batch.column(4).cast(pa.large_binary()), []
        code, n, part, totals = names.indices.to_numpy(), *(batch.column(i).to_numpy() for i in (1, 2, 3))
        ends, known = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1], names.dictionary.to_pylist()
        gram = np.zeros(((ends[-1] - ends[0]) // 7, 8), np.uint8)
        gram[:, :7] = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, 7)
        gram, ends = gram.view(np.uint64)[:, 0], (ends - ends[0]) // 7
        starts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (n[1:] != n[:-1]) | (part[1:] != part[:-1])))
        stops = np.append(starts[1:], batch.num_rows)
        # a part that came as one row holds no gram twice; the first and the last may go on in another batch
        alone = (stops - starts == 1) & (starts > 0) & (stops < batch.num_rows)
        if alone.any():
            at = starts[alone]
            columns = [names.dictionary.take(pa.array(code[at])), pa.array(n[at]), pa.array(ends[at + 1] - ends[at]), pa.array(totals[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["group", "n", "kinds", "total"])
        for a, b in zip(starts[~alone], stops[~alone]):
            if (now := (known[code[a]], int(n[a]), int(part[a]))) != key:
                if key:
                    done.append(closed())
                key, held, total = now, [], 0
            held.append(gram[ends[a] : ends[b]])
            total += int(totals[a:b].sum())
        # what goes on in the next batch is no view of this one
        held = [united(held) if sum(map(len, held)) > HELD_GRAMS else np.concatenate(held)]
        if done:
            yield _sizes(done, batch.schema.field(0).type)
    if key:
        yield _sizes([closed()], batch.schema.field(0).type)


def _sizes(done: list[tuple], group: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*done), (group, pa.int32(), pa.int64(), pa.int64()))], names=["group", "n", "kinds", "total"])


def united(parts: list[np.ndarray]) -> np.ndarray:
    """The different numbers of all parts, sorted."""
    x = np.concatenate(parts)
    x.sort()
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]
