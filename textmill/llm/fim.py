"""Fill-in-middle transformation by succinct rank and select.

The texts of an Arrow block lie end to end as bytes. One packed bitvector marks the bytes at which a unit begins
(``[A-Za-z]+`` or any other code point), another those at which a code point begins. Each has a directory of the ones
before every block of 512 bits. The ones within a text are its number of units n; selecting the two ranks drawn for it
gives the byte cuts; the second vector turns cuts into code points. The draws are 32-bit groups of a hash of the key.

Defined results: a null text is an empty one, and an empty text or one that holds a marker stays plain; a null key is drawn for
as if its decimal form were empty; repeated rows give repeated results, as draws depend on the key alone; a text of any
length is one text of one block; an empty table gives no rows; columns of the input with other names than the key are left out, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.llm.shared import text_blocks, utf8

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts, those from PLAIN_FROM on stay plain; of the others SPM of 100 get the suffix first.
PLAIN_FROM, SPM = 90, 20
WORDS = 8


class RankSelect:
    """A packed bitvector: ones before a place, and the place of the k-th one, by a directory of popcounts."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        step = 8 * WORDS
        room = (len(packed) // step + 1) * step
        self.length = len(bits)
        self.words = np.concatenate([packed, np.zeros(room - len(packed), np.uint8)]).view("<u8")
        self.ones = np.bitwise_count(self.words).astype(np.int64).reshape(-1, WORDS)
        self.before = np.concatenate([[0], np.cumsum(self.ones.sum(1))])
        self.inner = np.cumsum(self.ones, 1) - self.ones

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word // WORDS] + self.inner[word // WORDS, word % WORDS] + np.bitwise_count(below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the one with k ones before it; the length of the vector if there is none."""
        found = k < self.before[-1]
        k = np.where(found, k, 0)
        block = np.searchsorted(self.before, k, side="right") - 1
        block = np.minimum(block, len(self.inner) - 1)
        left = k - self.before[block]
        slot = (self.inner[block] <= left[:, None]).sum(1) - 1
        left = left - self.inner[block, slot]
        word, at = self.words[block * WORDS + slot], np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
            up = left >= low
            left = np.where(up, left - low, left)
            at += np.where(up, width, 0)
            word = np.where(up, word >> np.uint64(width), word)
        return np.where(found, (block * WORDS + slot) * 64 + at, self.length)


def boundaries(offsets: np.ndarray, data: np.ndarray) -> tuple[RankSelect, RankSelect]:
    """The vectors of units and of code points of texts that lie end to end."""
    point = (data & 0xC0) != 0x80
    letter = ((data | 0x20) - np.uint8(97)) < 26
    inside = np.zeros(len(data), bool)
    inside[1:] = letter[1:] & letter[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    inside[first] = False
    return RankSelect(point & ~inside), RankSelect(point)


def cuts(units: RankSelect, offsets: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n of each text, and the bytes at which its prefix and its middle end."""
    base = units.rank(offsets[:-1])
    n = units.rank(offsets[1:]) - base
    ends = np.sort(draws[:2] % (n + 1), axis=0)
    places = [np.where(e == n, offsets[1:], units.select(base + e)) for e in ends]
    return n, places[0], places[1]


def draws_of(key: str, seed: int) -> list[Column]:
    """h1 to h4: the first four groups of eight hexadecimal digits of the hash of ``seed:key``."""
    known = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), known).cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long").alias(f"__h{i + 1}") for i in range(4)]


def transform(df: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 1) -> DataFrame:
    """One row a row of df: the key, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and the output text."""
    out = T._parse_datatype_string("n long, form string, prefix_chars long, middle_chars long, output string")
    schema = T.StructType([df.schema[key]] + out.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, 5):
            offsets, data = utf8(block.column(5))
            draws = np.stack([block.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 5)])
            units, points = boundaries(offsets, data)
            n, a, b = cuts(units, offsets, draws)
            chars = [points.rank(x) for x in (offsets[:-1], a, b)]
            spm = draws[3] % 100 < SPM
            raw, form, made = data.tobytes(), [], []
            for i, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                whole = raw[start:end]
                if not whole or draws[2, i] % 100 >= PLAIN_FROM or any(m in whole for m in (PREFIX, SUFFIX, MIDDLE)):
                    form.append("plain")
                    made.append(whole)
                    continue
                prefix, middle, suffix = raw[start : a[i]], raw[a[i] : b[i]], raw[b[i] : end]
                head = (SUFFIX, suffix, PREFIX, prefix) if spm[i] else (PREFIX, prefix, SUFFIX, suffix)
                form.append("spm" if spm[i] else "psm")
                made.append(b"".join((*head, MIDDLE, middle)))
            plain = np.array([f == "plain" for f in form], bool)
            counts = [pa.array(y - x, pa.int64(), mask=plain) for x, y in zip(chars, chars[1:])]
            arrays = [block.column(0), pa.array(n), pa.array(form, pa.string()), *counts, pa.array(made, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    said = F.col(f"`{text}`").cast("string").alias("__text")
    return df.select(F.col(f"`{key}`"), *draws_of(key, seed), said).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from output and form."""
    part = F.split(output, "<[PSM]>", -1)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


SQL = r"""
with t as (
    select doc_id, coalesce(text, '') as whole, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units,
        sha256('1:' || coalesce(doc_id::varchar, '')) as digits
    from documents),
h as (
    select *, len(units) as n, ('0x' || substr(digits, 1, 8))::bigint as h1, ('0x' || substr(digits, 9, 8))::bigint as h2,
        ('0x' || substr(digits, 17, 8))::bigint as h3, ('0x' || substr(digits, 25, 8))::bigint as h4
    from t),
c as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when whole = '' or contains(whole, '<P>') or contains(whole, '<S>') or contains(whole, '<M>') or h3 % 100 >= 90 then 'plain'
            when h4 % 100 < 20 then 'spm' else 'psm' end as form
    from h),
p as (
    select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:], '') as suffix
    from c)
select doc_id, n, form,
    case when form <> 'plain' then length(prefix) end as prefix_chars,
    case when form <> 'plain' then length(middle) end as middle_chars,
    sha256(case form when 'plain' then whole when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
    sha256(whole) as restored_sha256
from p
"""
