"""Unicode normal form KC over Arrow blocks.

Texts are scanned as arrays of code points; only spans around code points that may change are rewritten: decomposed (compatibility too), put
in canonical order, composed. Equal spans are rewritten once for each task. The tables follow from the Unicode data that Python carries, by rule.
"""

from __future__ import annotations

import unicodedata
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hangul syllables are made of 19 leading, 21 middle and 27 final letters (or none).
HANGUL, LEAD, MIDDLE, FINAL, MIDDLES, FINALS, SYLLABLES = 0xAC00, 0x1100, 0x1161, 0x11A7, 21, 28, 19 * 21 * 28
SPAN_CACHE = 100_000


@cache
def tables() -> tuple[dict[int, tuple[int, ...]], dict[tuple[int, int], int], np.ndarray]:
    """One step of decomposition by code point, composition by pair, and for each code point whether it may change or compose with what stands before it."""
    parts, pairs = {}, {}
    unsure = np.zeros(0x110000, bool)
    for c in range(0x110000):
        said = unicodedata.decomposition(chr(c))
        if said:
            kind, _, rest = said.rpartition(">")
            parts[c] = tuple(int(x, 16) for x in rest.split())
            # compositions that Unicode rules out are not in normal form themselves
            if not kind and len(parts[c]) == 2 and unicodedata.is_normalized("NFC", chr(c)):
                pairs[parts[c]] = c
            else:
                unsure[c] = True
        if unicodedata.combining(chr(c)):
            unsure[c] = True
    # a composition of something that has no place in the form is not in it either
    changes = lambda c: c in parts and (unsure[c] or any(changes(x) for x in parts[c] if not unicodedata.combining(chr(x))))
    unsure[[c for c in pairs.values() if changes(c)]] = True
    unsure[[b for _, b in pairs]] = True
    unsure[MIDDLE : MIDDLE + MIDDLES] = unsure[FINAL + 1 : FINAL + FINALS] = True
    return parts, pairs, unsure


def decomposed(c: int) -> list[int]:
    if 0 <= (s := c - HANGUL) < SYLLABLES:
        letters = [LEAD + s // (MIDDLES * FINALS), MIDDLE + s % (MIDDLES * FINALS) // FINALS]
        return letters + ([FINAL + s % FINALS] if s % FINALS else [])
    return [y for x in tables()[0].get(c, ()) for y in decomposed(x)] or [c]


def composite(a: int, b: int) -> int | None:
    if 0 <= a - LEAD < 19 and 0 <= b - MIDDLE < MIDDLES:
        return HANGUL + ((a - LEAD) * MIDDLES + b - MIDDLE) * FINALS
    if 0 <= a - HANGUL < SYLLABLES and (a - HANGUL) % FINALS == 0 and 0 < b - FINAL < FINALS:
        return a + b - FINAL
    return tables()[1].get((a, b))


@lru_cache(SPAN_CACHE)
def rewritten(span: str) -> str:
    """The normal form of a span that begins with a starter or a text."""
    order = lambda c: unicodedata.combining(chr(c))
    flat, run = [], []
    for c in (d for x in span for d in decomposed(ord(x))):
        if order(c):
            run.append(c)
        else:
            flat += [*sorted(run, key=order), c]
            run = []
    flat += sorted(run, key=order)
    out, starter, last = [], -1, 0
    for c in flat:
        own = order(c)
        # blocked, if a mark that stays has the same or a higher class; a starter composes only with a starter right before it
        free = starter >= 0 and (last < own if len(out) - 1 > starter else True)
        made = composite(out[starter], c) if free else None
        if made is not None:
            out[starter] = made
            continue
        out.append(c)
        if own == 0:
            starter = len(out) - 1
        last = own
    return "".join(map(chr, out))


def nfkc_texts(texts: list[str | None]) -> list[str | None]:
    """The normal form KC of each text."""
    unsure, out = tables()[2], []
    for text in texts:
        if text is None or text.isascii():
            out.append(text)
            continue
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        doubt = unsure[points]
        if not doubt.any():
            out.append(text)
            continue
        # a span reaches from the last sure code point before a doubtful one up to the next sure one
        inside = doubt.copy()
        inside[:-1] |= doubt[1:]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
        made, at = [], 0
        for a, b in edges.reshape(-1, 2).tolist():
            made += [text[at:a], rewritten(text[a:b])]
            at = b
        out.append("".join([*made, text[at:]]))
    return out


def nfkc(text: Column | str) -> Column:
    """The text in Unicode normal form KC; null stays null."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(nfkc_texts(texts.to_pylist()), pa.string())

    return run(F.col(text) if isinstance(text, str) else text)
