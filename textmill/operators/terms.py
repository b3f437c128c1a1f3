"""Dictionaries matched in one pass: an Aho-Corasick automaton as numpy arrays, run over blocks of text.

States are numbered level by level; goto edges lie in an open-addressed table of (state, byte), failure links in an array. All
lanes of a block advance one byte at a time together: texts are cut in lanes that overlap by the longest term, so a long
text is as fast as many short ones. Bytes decide, as UTF-8 code points never match inside one another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a lane besides its overlap, of a block of texts, and of the terms of one automaton; a larger dictionary takes more passes.
LANE, BLOCK_BYTES, TERM_BYTES = 2048, 1 << 22, 1 << 23
#: Entries of a table of all next states, by state and kind of byte; a larger automaton follows edges and failure links.
TABLE = 1 << 22
ODD = np.uint64(0x9E3779B97F4A7C15)


class Automaton:
    """All places at which terms (different, not empty) occur."""

    def __init__(self, terms: list[bytes]) -> None:
        size = np.array([len(t) for t in terms], np.int64)
        data = np.frombuffer(b"".join(terms), np.uint8)
        start = np.cumsum(size) - size
        self.longest = int(size.max(initial=0))
        state, levels = np.zeros(len(terms), np.int64), []
        keys, total = [np.zeros(0, np.int64)], 1
        self.term = [np.full(1, -1, np.int64)]
        for depth in range(self.longest):
            alive = np.flatnonzero(size > depth)
            edges, of = np.unique(state[alive] << 8 | data[start[alive] + depth], return_inverse=True)
            state[alive] = total + of
            term = np.full(len(edges), -1, np.int64)
            done = size[alive] == depth + 1
            term[of[done]] = alive[done]
            self.term.append(term)
            keys.append(edges)
            levels.append((total, total + len(edges)))
            total += len(edges)
        self.term = np.concatenate(self.term)
        self.hash(np.concatenate(keys))
        # failure links, level by level; a state's other hits follow ``more``
        self.fail = np.zeros(total, np.int64)
        for (low, high), edges in zip(levels, keys[1:]):
            above, byte = edges >> 8, edges & 255
            self.fail[low:high] = np.where(above > 0, self.step(self.fail[above], byte), 0)
        self.more = np.zeros(total, np.int64)
        for low, high in levels:
            back = self.fail[low:high]
            self.more[low:high] = np.where(self.term[back] >= 0, back, self.more[back])
        self.hit = (self.term >= 0) | (self.more > 0)
        used = np.unique(data)
        self.table, self.kinds = None, len(used) + 1
        if total * self.kinds <= TABLE:
            # bytes of no term are of kind 0 and lead back to the start
            self.kind = np.zeros(256, np.int64)
            self.kind[used] = np.arange(1, self.kinds)
            self.table = np.zeros((total, self.kinds), np.int64)
            for (low, high), edges, (first, end) in zip([(0, 1), *levels], keys[1:], levels):
                if low:
                    self.table[low:high] = self.table[self.fail[low:high]]
                self.table[edges >> 8, self.kind[edges & 255]] = np.arange(first, end)
            if levels:
                low, high = levels[-1]
                self.table[low:high] = self.table[self.fail[low:high]]
            self.table = self.table.ravel()

    def hash(self, keys: np.ndarray) -> None:
        """Edge i leads to state i + 1."""
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        left, slot = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            winner = np.zeros(len(left), bool)
            winner[np.unique(np.where(free, slot, -1), return_index=True)[1]] = True
            winner &= free
            self.keys[slot[winner]], self.to[slot[winner]] = keys[left[winner]], left[winner] + 1
            left, slot = left[~winner], (slot[~winner] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * ODD) >> self.shift).astype(np.int64)

    def goto(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The state behind each edge, 0 where there is none."""
        wanted = state << 8 | byte
        slot = self.slot(wanted)
        seen = self.keys[slot]
        out = np.where(seen == wanted, self.to[slot], 0)
        open_ = np.flatnonzero((seen >= 0) & (seen != wanted))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            seen = self.keys[slot[open_]]
            same = seen == wanted[open_]
            out[open_[same]] = self.to[slot[open_[same]]]
            open_ = open_[(seen >= 0) & ~same]
        return out

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next state: along the edge, or along that of the first failure link that has one."""
        out = self.goto(state, byte)
        at = np.flatnonzero((out == 0) & (state > 0))
        back = state[at]
        while len(at):
            back = self.fail[back]
            out[at] = self.goto(back, byte[at])
            again = (out[at] == 0) & (back > 0)
            at, back = at[again], back[again]
        return out

    def places(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, end, term) of every occurrence; ends are byte offsets within the data."""
        size = np.diff(offsets)
        per = np.maximum(1, -(-size // LANE))
        text = np.repeat(np.arange(len(size)), per)
        part = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        own = offsets[:-1][text] + part * LANE
        end = np.minimum(own + LANE, offsets[1:][text])
        begin = np.maximum(offsets[:-1][text], own - max(0, self.longest - 1))
        order = np.argsort(begin - end, kind="stable")
        text, own, end, at = text[order], own[order], end[order], begin[order].copy()
        state, live = np.zeros(len(at), np.int64), int((end > at).sum())
        lanes, ends, states = [], [], []
        length = end - at
        for i in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -i, side="left"))
            byte = data[at[:live] + i]
            now = self.step(state[:live], byte.astype(np.int64)) if self.table is None else self.table[state[:live] * self.kinds + self.kind[byte]]
            state[:live] = now
            hits = np.flatnonzero(self.hit[now])
            hits = hits[at[hits] + i >= own[hits]]
            if len(hits):
                lanes.append(hits)
                ends.append(at[hits] + i + 1)
                states.append(now[hits])
        if not lanes:
            none = np.zeros(0, np.int64)
            return none, none, none
        lane, end, state = (np.concatenate(x) for x in (lanes, ends, states))
        found = []
        while len(lane):
            term = self.term[state]
            has = term >= 0
            found.append((text[lane[has]], end[has], term[has]))
            state = self.more[state]
            on = state > 0
            lane, end, state = lane[on], end[on], state[on]
        return tuple(np.concatenate(x) for x in zip(*found))


def groups(terms: list[str], most: int) -> Iterator[list[int]]:
    """Places of terms, in groups of at most ``most`` bytes (one term at least)."""
    held, size = [], 0
    for i, t in enumerate(terms):
        n = len(t.encode())
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(i)
        size += n
    if held:
        yield held


def scan(df: DataFrame, terms: list[str], text: str, key: str, counted: bool = True, term_bytes: int = TERM_BYTES) -> DataFrame:
    """(key, term, n): each row's terms and how often they occur in its lower-cased text, overlaps included.

    The dictionary is broadcast, in groups of at most ``term_bytes``, one pass each; empty terms and nulls are left out, equal ones are one. Rows without a
    term give nothing; a null text is an empty one.
    """

    def rows(keys: pa.Array, at: np.ndarray, term: np.ndarray, n: np.ndarray, names: pa.Array) -> list[pa.Array]:
        return [keys.take(pa.array(at)), names.take(pa.array(term)), pa.array(n)]

    return passes(df, terms, text, key, "term string, n long", rows, term_bytes)


def listed(df: DataFrame, terms: list[str], text: str, key: str, term_bytes: int = TERM_BYTES) -> DataFrame:
    """(key, terms): the terms of ``scan`` as one ascending list a row and group of the dictionary."""

    def rows(keys: pa.Array, at: np.ndarray, term: np.ndarray, n: np.ndarray, names: pa.Array) -> list[pa.Array]:
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        return [keys.take(pa.array(at[first])), pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), names.take(pa.array(term)))]

    return passes(df, terms, text, key, "terms array<string>", rows, term_bytes)


def passes(df: DataFrame, terms: list[str], text: str, key: str, added: str, rows: Callable[..., list[pa.Array]], term_bytes: int) -> DataFrame:
    """key and ``added``, made by rows(keys, row, term, times, names) from the different terms of a block's rows, by row, then term."""
    known = sorted({t for t in terms if t})
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *T._parse_datatype_string(added).fields])
    lowered = df.select(F.col(f"`{key}`"), F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("binary").alias("__text"))
    out = None
    for group in groups(known, term_bytes):
        shared = df.sparkSession.sparkContext.broadcast([known[i] for i in group])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            machine = Automaton([t.encode() for t in shared.value])
            names = pa.array(shared.value)
            for batch in batches:
                raw = batch.column(1).cast(pa.large_binary())
                sizes = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
                data, first = np.frombuffer(raw.buffers()[2] or b"", np.uint8), 0
                while first < len(raw):
                    end = max(first + 1, int(np.searchsorted(sizes, sizes[first] + BLOCK_BYTES, side="right")) - 1)
                    at, _, term = machine.places(sizes[first : end + 1], data)
                    pairs, n = np.unique(at * len(names) + term, return_counts=True)
                    if len(pairs):
                        yield pa.RecordBatch.from_arrays(rows(batch.column(0), first + pairs // len(names), pairs % len(names), n, names), names=schema.fieldNames())
                    first = end

        made = lowered.mapInArrow(run, schema)
        out = made if out is None else out.unionByName(made)
    return out if out is not None else df.sparkSession.createDataFrame([], schema)
