"""Streams that are damaged: no exception, ever, and a result that agrees with the bytes."""

import random
import struct

import pytest

from textmill.llm import mpeg


def frames(head, n, fill=b""):
    """n frames of a header, the first one with ``fill`` behind its side information."""
    size, _, _, side, _, _ = mpeg.frame_size(head)
    body = struct.pack(">I", head).ljust(size, b"\0")
    at = 4 + (0 if head >> 16 & 1 else 2) + side
    first = bytearray(body)
    first[at : at + len(fill)] = fill[: size - at]
    return bytes(first) + body * (n - 1)


#: MPEG-1 Layer III with and without CRC, MPEG-2 Layer III of 24 bytes a frame, Layer II, Layer I.
HEADS = [0xFFFA38C0, 0xFFFB9064, 0xFFF314C0, 0xFFFD9064, 0xFFFF9064]
VBRI = b"VBRI" + struct.pack(">HHH", 1, 2, 3) + struct.pack(">II", 9000, 40) + struct.pack(">HHHH", 6, 65535, 4, 1) + b"\xff" * 24


def streams():
    xing = b"Xing" + struct.pack(">III", 15, 12, 5000) + bytes(range(100)) + struct.pack(">I", 50)
    tag = b"ID3\x04\0\x40" + mpeg.synchsafe(40) + b"\0\0\0\x06\x01\0" + b"TIT2\0\0\0\x05\0\x03\x01\0\0\0\x01a"
    made = [mpeg.media_of(__import__("numpy").frombuffer(b"some text of this".ljust(384), "uint8")), b"", b"\xff", b"ID3", b"TAG".ljust(128)]
    for head in HEADS:
        made += [frames(head, 4), frames(head, 4, xing), tag + frames(head, 3, xing) + b"TAG".ljust(128, b"t"), frames(head, 5)[:-7]]
    # the position of VBRI is fixed, 36 bytes into the frame
    vbri = bytearray(frames(HEADS[1], 4))
    vbri[36 : 36 + len(VBRI)] = VBRI
    return made + [bytes(vbri)]


def read(data):
    s = mpeg.Stream(data)
    payload = s.payload()
    sizes = [k[0] for k in s.kinds]
    # frames lie in the data, in order and apart; each byte is in a frame, skipped, or in a tag
    assert all(a + n <= b for a, n, b in zip(s.offsets, sizes, [*s.offsets[1:], len(data)]))
    assert sum(sizes) + s.skipped <= len(data) and s.crc_ok + s.crc_bad <= len(s.offsets) and len(payload) % 192 == 0
    assert s.duration >= 0 and all(isinstance(v, str) for v in s.tags.values())
    if s.table and s.table["toc"]:
        assert all(0 <= t < 2**63 for t in s.table["toc"])
    return s


def test_every_byte_flipped():
    n = 0
    for data in streams():
        read(data)
        for i in range(min(len(data), 420)):
            for bits in (0xFF, 1 << (i % 8)):
                read(data[:i] + bytes([data[i] ^ bits]) + data[i + 1 :])
                n += 1
    assert n > 2000


@pytest.mark.parametrize("seed", range(3))
def test_random_damage(seed):
    rng = random.Random(seed)
    pool = streams()
    for _ in range(700):
        data = bytearray(rng.choice(pool))
        for _ in range(rng.randint(1, 6)):
            at = rng.randint(0, len(data))
            kind = rng.randint(0, 3)
            if kind == 0:
                data[at:at] = rng.randbytes(rng.randint(1, 30))
            elif kind == 1:
                del data[at : at + rng.randint(1, 300)]
            elif kind == 2:
                data[at : at + 4] = struct.pack(">I", rng.choice(HEADS))
            else:
                data[at : at + 8] = rng.choice([b"Xing", b"Info", b"VBRI", b"TAG", b"ID3\x02"]) + rng.randbytes(4)
        read(bytes(data))


def test_the_streams_of_the_last_report():
    head = HEADS[2]
    size, _, _, side, _, _ = mpeg.frame_size(head)
    assert size == 24
    short = bytearray(frames(head, 3))
    short[24 - 4 : 24] = b"Xing"
    assert read(bytes(short[: 24])).table is None
    vbri = bytearray(frames(HEADS[1], 4))
    vbri[36 : 36 + len(VBRI)] = VBRI
    table = read(bytes(vbri)).table
    assert table["toc"] == [0xFFFFFFFF * 65535] * 6 and table["frames"] == 40


def test_damaged_streams_in_a_job(spark):
    rng = random.Random(9)
    rows = [(i, d) for i, d in enumerate([*streams(), None, rng.randbytes(5000)])]
    got = mpeg.read_mpeg(spark.createDataFrame(rows, "doc_id long, media binary").repartition(3)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.n_frames for r in got} == {i: len((s := mpeg.Stream(d or b"")).offsets) - s.first for i, d in rows}
