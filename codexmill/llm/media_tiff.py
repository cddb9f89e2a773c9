"""Media columns of TIFF files: one row per page.

Files are read from their bytes: the header gives the byte order, image directories are
walked from one to the next, strips or tiles are decoded (PackBits, LZW, deflate or
none), predictors are undone, and each directory gives one page of samples. Files of a
column are handled where they lie, one after another: no shuffle.

``store`` writes payloads losslessly as 8-bit grey pages 64 samples wide. So that all
ways of storage are in use, compression (a quarter each), layout and predictor follow from the payload.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import chunks

# Numbers of tags, field types and compressions in TIFF files.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FILL_ORDER = 322, 323, 324, 325, 266
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}

ROW = 64
PAGE_ROWS = 1024
STRIP_ROWS = 128
TILE = 64


class Page(NamedTuple):
    samples: np.ndarray  # height x width x samples
    compression: int
    predictor: int
    tiled: bool
    bits: int  # of a sample; those of one bit are given as bytes 0 and 1


#: No codec here makes more than so many bytes of one.
MOST_EXPANSION = 4096


def packbits(data: bytes, size: float = math.inf) -> bytes:
    """Runs and literals; stops once there are ``size`` bytes."""
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        if (count := data[i]) < 128:
            out += data[i + 1 : i + 2 + count]
            i += 2 + count
        elif count > 128:
            out += data[i + 1 : i + 2] * (257 - count)
            i += 2
        else:
            i += 1
    return bytes(out)


def to_packbits(row: bytes) -> bytes:
    """Runs of three or more equal bytes as runs, all else as literals, 128 at most in each."""
    out, literal, i, n = bytearray(), bytearray(), 0, len(row)

    def flush() -> None:
        for a in range(0, len(literal), 128):
            part = literal[a : a + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    while i < n:
        j = i + 1
        while j < n and j - i < 128 and row[j] == row[i]:
            j += 1
        if j - i >= 3:
            flush()
            out.append(257 - (j - i))
            out.append(row[i])
        else:
            literal += row[i:j]
        i = j
    flush()
    return bytes(out)


_SINGLE = [bytes([i]) for i in range(256)]
#: Codes of 12 bits.
LZW_CODES = 4096


def lzw(data: bytes, size: float = math.inf) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends. Stops once there are ``size`` bytes."""
    out, table, width, last, made = [], [*_SINGLE, b"", b""], 9, b"", 0
    bits, held, mask = 0, 0, 511
    for byte in data:
        held = (held & ((1 << bits) - 1)) << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = (held >> bits) & mask
        if code == 257:
            break
        if code == 256:
            table, width, mask, last = [*_SINGLE, b"", b""], 9, 511, b""
            continue
        if code < len(table):
            text = table[code]
        elif last and code == len(table):
            text = last + last[:1]
        else:
            raise ValueError("bad LZW code")
        out.append(text)
        made += len(text)
        if made >= size:
            break
        if last and len(table) < LZW_CODES:
            table.append(last + text[:1])
            if len(table) + 1 > mask and width < 12:  # the width grows one code early
                width += 1
                mask = (1 << width) - 1
        last = text
    return b"".join(out)


def to_lzw(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 256, 9, 9
    table = {s: i for i, s in enumerate(_SINGLE)}
    following, text = 258, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        if bits > 4096:
            keep = bits % 8
            out.extend((held >> keep).to_bytes(bits // 8, "big"))
            held, bits = held & ((1 << keep) - 1), keep

    for i in range(len(data)):
        byte = data[i : i + 1]
        longer = text + byte
        if longer in table:
            text = longer
            continue
        put(table[text])
        table[longer] = following
        following += 1
        text = byte
        if following == 4094:
            put(table[text])
            put(256)
            table = {s: k for k, s in enumerate(_SINGLE)}
            following, width, text = 258, 9, b""
        elif following > (1 << width) - 1:
            width += 1
    if text:
        put(table[text])
        following += 1
        if following > (1 << width) - 1 and width < 12:
            width += 1
    put(257)
    pad = -bits % 8
    out.extend((held << pad).to_bytes((bits + pad) // 8, "big"))
    return bytes(out)


def decompress(data: bytes, compression: int, size: int) -> bytes:
    """``size`` bytes, or ValueError; sizes that the data cannot hold are refused before anything is made, and what goes beyond the size isn't decoded."""
    if size > MOST_EXPANSION * len(data):
        raise ValueError(f"{len(data)} bytes cannot hold {size}")
    if compression == NONE:
        out = data
    elif compression == LZW:
        out = lzw(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, max(1, size))
    elif compression == PACKBITS:
        out = packbits(data, size)
    else:
        raise ValueError(f"compression {compression} is not known")
    if len(out) < size:
        raise ValueError("a strip or tile is too short")
    return out[:size]


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple[int, ...]]]]:
    """(byte order, values of integer tags) of each image directory."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a ring")
        seen.add(at)
        count = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for k in range(count):
            place = at + 2 + 12 * k
            tag, kind, n = struct.unpack_from(order + "HHI", data, place)
            if kind in TYPES:
                inside = n * SIZES[kind] <= 4
                where = place + 8 if inside else struct.unpack_from(order + "I", data, place + 8)[0]
                tags[tag] = struct.unpack_from(f"{order}{n}{TYPES[kind]}", data, where)
        yield order, tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a file, in order; ValueError if it is damaged or of a kind that isn't known (BigTIFF, floats, other codecs)."""
    try:
        for order, tags in directories(data):
            yield _page(data, order, tags)
    except (struct.error, KeyError, IndexError, OverflowError, zlib.error) as e:
        raise ValueError(f"damaged: {e!r}") from e


def _page(data: bytes, order: str, tags: dict[int, tuple[int, ...]]) -> Page:
    def one(tag: int, default: int) -> int:
        return tags.get(tag, (default,))[0]

    width, height, samples = tags[WIDTH][0], tags[HEIGHT][0], one(SAMPLES, 1)
    bits, planar, predictor, compression = one(BITS, 1), one(PLANAR, 1), one(PREDICTOR, 1), one(COMPRESSION, 1)
    if bits not in (1, 8, 16, 32) or len(set(tags.get(BITS, (bits,)))) > 1 or predictor not in (1, 2) or (bits == 1 and predictor == 2):
        raise ValueError(f"{bits} bits with predictor {predictor} are not known")
    tiled = TILE_OFFSETS in tags
    if tiled:
        wide, high, offsets, counts = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0], tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        wide, high, offsets, counts = width, min(one(ROWS_PER_STRIP, height), height), tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
    if min(width, height, samples, wide, high) < 1 or planar not in (1, 2):
        raise ValueError("sizes must be positive")
    kind = np.dtype("u1" if bits == 1 else f"{order}u{bits // 8}")
    deep = samples if planar == 1 else 1
    across, down = -(-width // wide), -(-height // high)
    if len(offsets) != across * down * (1 if planar == 1 else samples) or len(offsets) != len(counts):
        raise ValueError("wrong number of strips or tiles")
    line = -(-wide * deep // 8) if bits == 1 else wide * deep * kind.itemsize
    # all parts are decoded before the page is made: it holds no more than they do
    parts = []
    for k, (a, n) in enumerate(zip(offsets, counts)):
        rows = high if tiled else min(high, height - k % (across * down) // across * high)
        parts.append((rows, decompress(data[a : a + n], compression, rows * line)))
    out = np.zeros((height, width, samples), kind.newbyteorder("="))
    for k, (rows, raw) in enumerate(parts):
        plane, cell = divmod(k, across * down)
        y, x = cell // across * high, cell % across * wide
        if bits == 1:
            packed = np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line)
            block = np.unpackbits(packed, axis=1, bitorder="little" if one(FILL_ORDER, 1) == 2 else "big")[:, : wide * deep].reshape(rows, wide, deep)
        else:
            block = np.frombuffer(raw, kind, rows * wide * deep).reshape(rows, wide, deep).astype(out.dtype)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        part = block[: height - y, : width - x]
        first = 0 if planar == 1 else plane
        out[y : y + part.shape[0], x : x + part.shape[1], first : first + deep] = part
    return Page(out, compression, predictor, tiled, bits)


def write(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tiled: bool = False, order: str = "<") -> bytes:
    """A file of 8-bit grey pages, each an array of height x width."""
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        height, width = image.shape
        high, wide = (TILE, TILE) if tiled else (STRIP_ROWS, width)
        offsets, counts = [], []
        for y in range(0, height, high):
            for x in range(0, width, wide):
                block = image[y : y + high, x : x + wide]
                if tiled and block.shape != (high, wide):
                    block = np.pad(block, ((0, high - block.shape[0]), (0, wide - block.shape[1])))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), np.uint8))
                raw = block.astype(np.uint8).tobytes()
                if compression == LZW:
                    raw = to_lzw(raw)
                elif compression in (DEFLATE, OLD_DEFLATE):
                    raw = zlib.compress(raw)
                elif compression == PACKBITS:
                    raw = b"".join(to_packbits(row.astype(np.uint8).tobytes()) for row in block)
                offsets.append(len(out))
                counts.append(len(raw))
                out += raw
        tags = {WIDTH: [width], HEIGHT: [height], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [wide], TILE_HEIGHT: [high], TILE_OFFSETS: offsets, TILE_COUNTS: counts} if tiled else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [high], STRIP_COUNTS: counts}
        fields = []
        for tag, values in sorted(tags.items()):
            value = struct.pack(f"{order}{len(values)}I", *values)
            if len(value) > 4:
                value, more = struct.pack(order + "I", len(out)), value
                out += more
            fields.append(struct.pack(order + "HHI", tag, 4, len(values)) + value)
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + b"".join(fields)
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def stored(payload: bytes) -> bytes:
    """A payload (a positive multiple of ROW bytes) as a file; its checksum picks the way of storage."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    draw = zlib.crc32(payload)
    compression = (LZW, PACKBITS, NONE, DEFLATE)[draw % 4]
    return write([grid[i : i + PAGE_ROWS] for i in range(0, len(grid), PAGE_ROWS)], compression, 2 if draw >> 8 & 1 else 1, bool(draw >> 9 & 1), ">" if draw >> 10 & 1 else "<")


def feature(images: list[np.ndarray]) -> str:
    """Pages, size, mean, deviation, mean step between neighbours, and 16 bits of light and dark bands."""
    if not images:
        return "pages=0"
    flat = np.concatenate([i.reshape(-1) for i in images]).astype(float)
    steps = np.concatenate([np.abs(np.diff(i.astype(int), axis=1)).reshape(-1) for i in images])
    bands = np.array([b.mean() if len(b) else 0.0 for b in np.array_split(flat, 16)])
    bits = int("".join("1" if b > flat.mean() else "0" for b in bands), 2)
    return f"pages={len(images)} size={images[0].shape[1]}x{sum(len(i) for i in images)} mean={flat.mean():.4f} std={flat.std():.4f} step={steps.mean() if len(steps) else 0:.4f} bands={bits:04x}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text (null: empty) as UTF-8, filled up with zeros, as a TIFF file."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in chunks(batch):
                data = [t.encode("utf-8", "surrogatepass") for t in texts]
                media = [stored(d.ljust(max(ROW, -(-len(d) // ROW) * ROW), b"\0")) for d in data]
                yield pa.RecordBatch.from_pydict({id_col: piece.column(0), "n_bytes": pa.array([len(d) for d in data], pa.int64()), "media": pa.array(media, pa.binary())})

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, media binary")


def explode_pages(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per page: id, page (from 0), width, height, samples, bits, compression, predictor, tiled, pixels, error.

    Pixels are the samples row by row, in the machine-independent order of low byte first.
    A damaged file gives the pages before the damage and one row with the error; a null
    one gives one row with the error "no file". Repeated files give their pages again.
    """
    kind = files.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"
    names = ["page", "width", "height", "samples", "bits", "compression", "predictor", "tiled", "pixels", "error"]
    types = [pa.int32()] * 7 + [pa.bool_(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1)):
                rows, k = [], 0
                try:
                    if not data.is_valid:
                        raise ValueError("no file")
                    for p in pages(data.as_py()):
                        h, w, s = p.samples.shape
                        raw = p.samples.astype(p.samples.dtype.newbyteorder("<")).tobytes()
                        rows.append((k, w, h, s, p.bits, p.compression, p.predictor, p.tiled, raw, None))
                        k += 1
                except ValueError as e:
                    rows.append((k, *[None] * 8, str(e)))
                ids = batch.column(0).take(pa.array([i] * len(rows), pa.int32()))
                yield pa.RecordBatch.from_pydict({id_col: ids} | {n: pa.array(v, t) for n, t, v in zip(names, types, zip(*rows), strict=True)})

    return files.select(id_col, media_col).mapInArrow(run, schema)


def measure(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read stored files (id, n_bytes, media) back: sizes, digests and a feature of each payload.

    The payload is all samples of all pages, row by row, those of a point side by side; the feature is of the same rows.
    A null file gives nulls; a damaged one has its own size and digest, and as feature "damaged". Repeated rows are
    read one by one.
    """
    kind = files.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column(2).to_pylist():
                if media is None:
                    rows.append((None,) * 6)
                    continue
                try:
                    images = [p.samples.reshape(len(p.samples), -1) for p in pages(media)]
                except ValueError:
                    rows.append((None, None, None, len(media), hashlib.sha256(media).hexdigest(), "damaged"))
                    continue
                payload = b"".join(i.tobytes() for i in images)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature(images)))
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "n_bytes": batch.column(1)} | {n: pa.array(v, t) for n, v, t in zip(names, columns, types, strict=True)})

    return files.select(id_col, "n_bytes", "media").mapInArrow(run, schema)
