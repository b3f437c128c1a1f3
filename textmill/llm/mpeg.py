"""MPEG audio columns: writing text into frames, resynchronising, tags, bit-rate tables, checksums and seek offsets.

``write_mpeg`` stores bytes as the ancillary data of silent MPEG-1 Layer III mono frames (32 kHz, 48 kbit/s, 216 bytes, CRC
protected), 192 bytes a frame, behind an ID3v2 tag and an Info frame with a table of 100 seek points. ``read_mpeg`` reads
any MPEG 1, 2 or 2.5 stream of layers I to III: it looks for frame headers that agree with the next one, parses ID3v2 (2.2 to 2.4, with extended headers and unsynchronised tags), ID3v1, Xing, Info
and VBRI, verifies the CRC of Layer III frames and gives exact durations (a fraction of seconds) and the offset of every frame. Frames of free format (bit rate index 0) have no size
in their header; they count as bytes between frames.

Defined results: null and empty texts are one frame of spaces; a null stream, or one without frames, has no frames, a
duration of 0 and an empty payload; bytes between frames are skipped and counted; a last frame that is cut off is
not a frame; any bytes at all are a stream: a table that reaches beyond its frame is read as far as the frame goes, or not at all if its head
does not fit; an empty table of rows gives no rows; columns to keep whose names clash with those of the result give way; "TAG" at 128 bytes from the end is an ID3v1 tag unless it lies inside a frame that the end or another header follows.
"""

from __future__ import annotations

import struct
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textmill.llm.shared import map_text, utf8

UNIT = 192
FRAME = 216
SIDE = 17
RATE = 32000
#: Fixed values of the format: bit rates in kbit/s by (MPEG-1?, layer), sample rates by version bits.
BIT_RATES = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
SAMPLE_RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
#: MPEG-1 Layer III, CRC present; 48 kbit/s at 32 kHz; mono.
HEADER = bytes([0xFF, 0xFA, 0x38, 0xC0])
_crc_table: np.ndarray | None = None


def crc_table() -> np.ndarray:
    """CRC-16 with polynomial 0x8005, most significant bit first."""
    global _crc_table
    if _crc_table is None:
        x = np.arange(256, dtype=np.uint32) << 8
        for _ in range(8):
            x = np.where(x & 0x8000, (x << 1) ^ 0x8005, x << 1) & 0xFFFF
        _crc_table = x
    return _crc_table


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 of each row of bytes, from 0xFFFF."""
    table, crc = crc_table(), np.full(len(rows), 0xFFFF, np.uint32)
    for i in range(rows.shape[1]):
        crc = ((crc << 8) & 0xFFFF) ^ table[(crc >> 8) ^ rows[:, i]]
    return crc


def synchsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def unsafe(four: bytes) -> int:
    """The number of four bytes of seven bits."""
    n = 0
    for b in four:
        n = n << 7 | b & 127
    return n


def media_of(payload: np.ndarray) -> bytes:
    """The stream of a payload whose length is a multiple of 192."""
    n = len(payload) // UNIT
    frames = np.zeros((n + 1, FRAME), np.uint8)
    frames[:, :4] = np.frombuffer(HEADER, np.uint8)
    frames[1:, 6 + SIDE : 6 + SIDE + UNIT] = payload.reshape(n, UNIT)
    info = b"Info" + struct.pack(">III", 0x7, n, (n + 1) * FRAME) + bytes((i * 256 // 100) for i in range(100))
    frames[0, 6 + SIDE : 6 + SIDE + len(info)] = np.frombuffer(info, np.uint8)
    crc = crc16(frames[:, np.r_[2, 3, 6 : 6 + SIDE]])
    frames[:, 4], frames[:, 5] = crc >> 8, crc & 255
    title = b"\x03textmill\0"
    tag = b"TIT2" + struct.pack(">IH", len(title), 0) + title
    return b"ID3\x03\0\0" + synchsafe(len(tag)) + tag + frames.tobytes()


def frame_size(head: int) -> tuple[int, int, int, int, int, int] | None:
    """(bytes, samples, sample rate, side-information bytes, layer, kbit/s) of a header, or None if it is none."""
    version, layer, rate, sr = head >> 19 & 3, 4 - (head >> 17 & 3), head >> 12 & 15, head >> 10 & 3
    if head >> 21 != 0x7FF or version == 1 or layer == 4 or rate in (0, 15) or sr == 3 or head & 3 == 2:
        return None
    one = version == 3
    kbps, hz, pad = BIT_RATES[one, layer][rate], SAMPLE_RATES[version][sr], head >> 9 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or one else 576
    size = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
    mono = head >> 6 & 3 == 3
    side = 0 if layer < 3 else (17 if mono else 32) if one else (9 if mono else 17)
    return size, samples, hz, side, layer, kbps


class Stream:
    """What a byte stream holds: tags, frames, tables, checksums, payload."""

    def __init__(self, data: bytes) -> None:
        self.tags: dict[str, str] = {}
        self.offsets: list[int] = []
        self.skipped = self.crc_ok = self.crc_bad = 0
        self.table: dict | None = None
        self.samples, self.duration, self.rates = 0, Fraction(0), set()
        end = len(data)
        mark = end - 128 if data[-128:-125] == b"TAG" else end  # where an ID3v1 tag begins, unless a frame covers it
        at = self.id3v2(data) if data[:3] == b"ID3" and len(data) >= 10 else 0
        kinds: dict[int, tuple | None] = {}
        kind_of, heads = [], []
        unpack = struct.Struct(">I").unpack_from
        synced = False
        while at + 4 <= end:
            if at == mark:
                end = mark
                break
            head = unpack(data, at)[0]
            if head not in kinds:
                kinds[head] = frame_size(head)
            kind = kinds[head]
            if kind and at + kind[0] <= end:
                after = at + kind[0]
                if (synced and not at < mark < after) or after + 4 > end or frame_size(unpack(data, after)[0]):
                    self.offsets.append(at)
                    kind_of.append(kind)
                    heads.append(head)
                    at, synced = after, True
                    continue
            synced = False
            stop = mark if at < mark else end
            found = data.find(b"\xff", at + 1, stop)
            step = (found if found >= 0 else stop) - at
            self.skipped += step
            at += step
        self.skipped += max(0, end - at)
        if end < len(data):
            self.tags["ID3v1"] = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
        self.kinds = kind_of
        first = 0
        if kind_of and (table := self.vbr(data, self.offsets[0], heads[0], kind_of[0])):
            self.table, first = table, 1
        self.first = first
        for _, samples, hz, *_ in kind_of[first:]:
            self.samples += samples
            self.rates.add(hz)
        for hz in self.rates:
            self.duration += Fraction(sum(k[1] for k in kind_of[first:] if k[2] == hz), hz)
        self.verify(data, heads)

    def id3v2(self, data: bytes) -> int:
        """Reads the text frames of the tag at the start; where it ends."""
        version, flags = data[3], data[5]
        size = unsafe(data[6:10])
        body = data[10 : 10 + size]
        if flags & 0x80 and version < 4:
            body = body.replace(b"\xff\0", b"\xff")
        at, head = 0, 6 if version == 2 else 10
        if flags & 0x40 and version > 2 and len(body) >= 4:
            at = unsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4])
        while at + head <= len(body) and body[at : at + 3].isalnum():
            name = body[at : at + (3 if version == 2 else 4)]
            sizes = body[at + len(name) : at + len(name) + (3 if version == 2 else 4)]
            n = unsafe(sizes) if version == 4 else int.from_bytes(sizes)
            text = body[at + head : at + head + n]
            if version == 4 and body[at + 9] & 1:
                text = text[4:]
            if version == 4 and body[at + 9] & 2:
                text = text.replace(b"\xff\0", b"\xff")
            if name[:1] == b"T" and name.isalnum() and text:
                code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(text[0], "latin-1")
                self.tags[name.decode("ascii", "replace")] = text[1:].decode(code, "replace").rstrip("\0")
            at += head + n
        return min(10 + size, len(data)) + 10 * (flags >> 4 & 1)

    @staticmethod
    def vbr(data: bytes, at: int, head: int, kind: tuple) -> dict | None:
        size, _, _, side, layer, _ = kind
        if layer != 3:
            return None
        x = at + 4 + (0 if head >> 16 & 1 else 2) + side
        end = min(at + size, len(data))
        for x in (x, at + 4 + side):
            if data[x : x + 4] in (b"Xing", b"Info") and x + 8 <= end:
                flags, p = struct.unpack_from(">I", data, x + 4)[0], x + 8
                out: dict = {"kind": data[x : x + 4].decode(), "frames": None, "bytes": None, "toc": None}
                for bit, name in ((1, "frames"), (2, "bytes")):
                    if flags & bit and p + 4 <= end:
                        out[name], p = struct.unpack_from(">I", data, p)[0], p + 4
                if flags & 4 and p + 100 <= end:
                    out["toc"] = list(data[p : p + 100])
                return out
        x = at + 4 + 32
        if data[x : x + 4] == b"VBRI" and x + 26 <= end:
            total, frames = struct.unpack_from(">II", data, x + 10)
            entries, scale, width, _ = struct.unpack_from(">HHHH", data, x + 18)
            body = data[x + 26 : min(x + 26 + entries * width, end)]
            # entries have one to four bytes; a table of others can't be read
            toc = [int.from_bytes(body[i : i + width]) * scale for i in range(0, len(body) // width * width, width)] if 1 <= width <= 4 else []
            return {"kind": "VBRI", "frames": frames, "bytes": total, "toc": toc}
        return None

    def verify(self, data: bytes, heads: list[int]) -> None:
        """CRC of protected Layer III frames, all frames of one side-information size at once."""
        raw = np.frombuffer(data, np.uint8)
        offsets = np.array(self.offsets, np.int64)
        side = np.array([k[3] if not h >> 16 & 1 else 0 for k, h in zip(self.kinds, heads)], np.int64)
        for s in set(side.tolist()) - {0}:
            at = offsets[side == s]
            at = at[at + 6 + s <= len(raw)]
            good = crc16(raw[at[:, None] + np.r_[2, 3, 6 : 6 + s]]) == (raw[at + 4].astype(np.uint32) << 8 | raw[at + 5])
            self.crc_ok += int(good.sum())
            self.crc_bad += int((~good).sum())
        self.raw = raw

    def payload(self) -> bytes:
        """The 192 bytes behind the side information of every protected frame of our own shape."""
        at = np.array([o for o, k in zip(self.offsets[self.first :], self.kinds[self.first :]) if k[0] == FRAME and k[3] == SIDE], np.int64)
        return self.raw[at[:, None] + np.arange(6 + SIDE, 6 + SIDE + UNIT)].tobytes() if len(at) else b""


MEDIA = "n_bytes long, media binary"
STREAM = (
    "payload binary, n_frames long, n_samples long, sample_rate int, duration_us long, duration_num long, duration_den long, crc_ok long, crc_bad long, skipped_bytes long, "
    "table_kind string, table_frames long, table_toc array<long>, tags map<string,string>, seek_offsets array<long>"
)


def write_mpeg(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and n_bytes, media: each text as UTF-8, filled with spaces to a positive multiple of 192, in frames."""

    def make():
        def block(texts: pa.Array) -> list:
            offsets, data = utf8(texts)
            made = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                payload = np.full(max(1, -(-(b - a) // UNIT)) * UNIT, 32, np.uint8)
                payload[: b - a] = data[a:b]
                made.append(media_of(payload))
            return [np.diff(offsets), pa.array(made, pa.binary())]

        return block

    return map_text(df, make, MEDIA, text, list(keep))


def read_mpeg(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",), seek_every: int = 1) -> DataFrame:
    """``keep`` and STREAM: what each stream of the binary column holds; the offset of every ``seek_every``-th frame."""
    from collections.abc import Iterator

    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from textmill.llm.shared import text_blocks

    added = T._parse_datatype_string(STREAM)
    kept = [c for c in dict.fromkeys(keep) if c.lower() not in {f.name.lower() for f in added.fields}]
    schema = T.StructType([df.schema[c] for c in kept] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, len(kept)):
            streams = [Stream(m or b"") for m in block.column(len(kept)).to_pylist()]
            table = [s.table or {} for s in streams]
            arrays = [
                pa.array([s.payload() for s in streams], pa.binary()),
                pa.array([len(s.offsets) - s.first for s in streams], pa.int64()),
                pa.array([s.samples for s in streams], pa.int64()),
                pa.array([min(s.rates) if len(s.rates) == 1 else None for s in streams], pa.int32()),
                pa.array([round(s.duration * 1_000_000) for s in streams], pa.int64()),
                pa.array([s.duration.numerator for s in streams], pa.int64()),
                pa.array([s.duration.denominator for s in streams], pa.int64()),
                pa.array([s.crc_ok for s in streams], pa.int64()),
                pa.array([s.crc_bad for s in streams], pa.int64()),
                pa.array([s.skipped for s in streams], pa.int64()),
                pa.array([t.get("kind") for t in table], pa.string()),
                pa.array([t.get("frames") for t in table], pa.int64()),
                pa.array([t.get("toc") for t in table], pa.list_(pa.int64())),
                pa.array([list(s.tags.items()) for s in streams], pa.map_(pa.string(), pa.string())),
                pa.array([s.offsets[s.first :: seek_every] for s in streams], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([block.column(i) for i in range(len(kept))] + arrays, names=schema.fieldNames())

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{media}`").alias("__media")).mapInArrow(run, schema)
