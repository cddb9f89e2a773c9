"""TIFF files that another hand wrote, damaged ones, and rows without a file."""

import hashlib
import random
import struct
import tracemalloc
import zlib

import numpy as np
import pytest

from codexmill.llm import media_tiff


def by_hand(width, height, bits, compression, strips, rows, more=()):
    """A big-endian file put together field by field."""
    tags = [(256, 3, [width]), (257, 3, [height]), (258, 3, [bits]), (259, 3, [compression]), (278, 3, [rows]), (279, 4, [len(s) for s in strips]), *more]
    at, offsets = 8, []
    for s in strips:
        offsets.append(at)
        at += len(s)
    tags = sorted([*tags, (273, 4, offsets)])
    head, tail = b"", b""
    places = at + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        data = struct.pack(f">{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(data) > 4:
            head += struct.pack(">HHII", tag, kind, len(values), places + len(tail))
            tail += data
        else:
            head += struct.pack(">HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
    return b"MM\0*" + struct.pack(">I", at) + b"".join(strips) + struct.pack(">H", len(tags)) + head + b"\0\0\0\0" + tail


def test_one_bit_packbits_by_hand():
    # 10 pixels a row: 1100000011 0101010101 in two bytes each; a literal of 2, then a run of two equal bytes
    file = by_hand(10, 3, 1, 32773, [bytes([1, 0b11000000, 0b11000000]) + bytes([1, 0b01010101, 0b01000000]), bytes([0xFF, 0xFF])], 2)
    (page,) = media_tiff.pages(file)
    assert page.bits == 1 and page.samples[:, :, 0].tolist() == [[1, 1, 0, 0, 0, 0, 0, 0, 1, 1], [0, 1] * 5, [1] * 10]
    (page,) = media_tiff.pages(by_hand(8, 1, 1, 1, [b"\x03"], 1, [(266, 3, [2])]))
    assert page.samples.ravel().tolist() == [1, 1, 0, 0, 0, 0, 0, 0]


def test_sixteen_bit_deflate_with_predictor_by_hand():
    rows = [struct.pack(">3H", 1000, 1, 65535), struct.pack(">3H", 5, 0, 2)]
    (page,) = media_tiff.pages(by_hand(3, 2, 16, 8, [zlib.compress(b"".join(rows))], 2, [(317, 3, [2])]))
    assert page.samples[:, :, 0].tolist() == [[1000, 1001, 1000], [5, 5, 7]]


@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
def test_damage_gives_pages_or_value_error(compression):
    rnd = random.Random(compression)
    images = [np.frombuffer(rnd.randbytes(20 * 16), np.uint8).reshape(20, 16) for _ in range(2)]
    whole = media_tiff.write(images, compression, 2, False)
    for _ in range(3000):
        data = bytearray(whole)
        for _ in range(rnd.randrange(1, 6)):
            data[rnd.choice([rnd.randrange(len(data)), rnd.randrange(max(0, len(data) - 150), len(data))])] = rnd.choice([0, 1, 127, 255, rnd.randrange(256)])
        try:
            for page in media_tiff.pages(bytes(data[: rnd.choice([len(data), rnd.randrange(len(data))])])):
                assert page.samples.nbytes < 1 << 24
        except ValueError:
            pass


def test_measure_of_odd_files(spark):
    good = media_tiff.stored(b"y" * 64)
    df = spark.createDataFrame([(1, 64, good), (2, 0, None), (3, 9, good[:-9]), (1, 64, good)], "doc_id int, n_bytes bigint, media binary")
    got = sorted(((r.doc_id, r.payload_bytes, r.media_bytes, r.feature) for r in media_tiff.measure(df).collect()), key=lambda r: r[0])
    assert got[0] == got[1] and got[0][1:3] == (64, len(good)) and got[2] == (2, None, None, None) and got[3] == (3, None, len(good) - 9, "damaged")


def test_shares_of_the_ways_of_storage(spark):
    ways = [next(media_tiff.pages(media_tiff.stored(str(i).encode().ljust(64, b"\0")))).compression for i in range(400)]
    assert all(70 < ways.count(c) < 130 for c in (media_tiff.LZW, media_tiff.PACKBITS, media_tiff.NONE, media_tiff.DEFLATE))


@pytest.mark.parametrize("compression", [5, 32773])
def test_a_hostile_strip_is_not_decoded_to_its_end(compression):
    data = b"\0" * 3_000_000
    strip = media_tiff.to_lzw(data) if compression == 5 else b"\x81\0" * 20_000
    file = by_hand(64, 1, 8, compression, [strip], 1)
    tracemalloc.start()
    (page,) = media_tiff.pages(file)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert page.samples.tobytes() == b"\0" * 64 and peak < 20 * len(file) + 500_000


def test_all_samples_are_measured(spark):
    pixels = bytes(range(1, 13))
    file = by_hand(2, 2, 8, 1, [pixels], 2, [(277, 3, [3])])
    df = spark.createDataFrame([(1, 12, file)], "doc_id int, n_bytes bigint, media binary")
    row = media_tiff.measure(df).first()
    assert (row.payload_bytes, row.payload_sha256) == (12, hashlib.sha256(pixels).hexdigest()) and row.feature.startswith("pages=1 size=6x2 ")
