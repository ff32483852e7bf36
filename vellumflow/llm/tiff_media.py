"""TIFF as a media column: store bytes as greyscale pages, walk image directories, decode strips and tiles.

store() writes each row's bytes as one TIFF page of 8-bit samples; pages() reads TIFF files of either byte order, walks
the chain of image directories, decodes strips or tiles (none, PackBits, LZW, deflate), undoes the horizontal predictor
and gives one row per page. A file that cannot be read gives one row with the reason instead of failing the job.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vellumflow.llm.shared import map_slices

# Fixed values of the TIFF format.
NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", DEFLATE_OLD: "deflate", PACKBITS: "packbits"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CLEAR, END = 256, 257

PAGE_SCHEMA = T.StructType(
    [T.StructField("page", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("compression", T.StringType()), T.StructField("predictor", T.IntegerType()), T.StructField("tiled", T.BooleanType()), T.StructField("pixels", T.BinaryType()), T.StructField("feature", T.StringType()), T.StructField("error", T.StringType())]
)

_RUN = re.compile(rb"(.)\1{2,127}", re.S)


def packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for k in range(at, end, 128):
            piece = data[k : min(k + 128, end)]
            out.append(len(piece) - 1)
            out.extend(piece)

    for m in _RUN.finditer(data):
        literal(m.start())
        out.append(257 - (m.end() - m.start()))
        out.append(data[m.start()])
        at = m.end()
    literal(len(data))
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, k = bytearray(), 0
    while len(out) < size and k < len(data):
        n = data[k]
        if n < 128:
            out += data[k + 1 : k + 2 + n]
            k += n + 2
        elif n > 128:
            out += data[k + 1 : k + 2] * (257 - n)
            k += 2
        else:
            k += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first, wider one code early."""
    out, hold, held = bytearray(), CLEAR, 9
    table: dict[int, int] = {}
    known, width, free = -1, 9, 258
    for byte in data:
        if known < 0:
            known = byte
            continue
        key = (known << 8) | byte
        code = table.get(key)
        if code is not None:
            known = code
            continue
        hold, held = (hold << width) | known, held + width
        table[key] = free
        free += 1
        if free == 4094:
            hold, held = (hold << 12) | CLEAR, held + 12
            table, width, free = {}, 9, 258
        elif free + 1 > (1 << width):
            width += 1
        if held >= 512:
            cut = held & 7
            out += (hold >> cut).to_bytes(held >> 3, "big")
            hold, held = hold & ((1 << cut) - 1), cut
        known = byte
    if known >= 0:
        hold, held = (hold << width) | known, held + width
        if free + 2 > (1 << width) and width < 12:
            width += 1
    hold, held = (hold << width) | END, held + width
    pad = -held % 8
    return bytes(out) + (hold << pad).to_bytes((held + pad) >> 3, "big")


def unlzw(data: bytes, size: int) -> bytes:
    out: list[bytes] = []
    single = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, before, have = list(single), 9, None, 0
    hold, held = 0, 0
    for byte in data:
        hold, held = (hold << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code = hold >> held
        hold &= (1 << held) - 1
        if code == CLEAR:
            table, width, before = list(single), 9, None
            continue
        if code == END:
            break
        if before is None:
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = before + before[:1]
            else:
                raise ValueError(f"LZW code {code} ahead of the table")
            table.append(before + entry[:1])
            if len(table) + 1 >= (1 << width) and width < 12:
                width += 1
        out.append(entry)
        have += len(entry)
        before = entry
        if have >= size:
            break
    return b"".join(out)


def _pack(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, LZW: lzw, PACKBITS: packbits, DEFLATE: lambda d: zlib.compress(d, 1)}[compression](data)


def _unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data
    if compression == LZW:
        return unlzw(data, size)
    if compression == PACKBITS:
        return unpackbits(data, size)
    if compression in (DEFLATE, DEFLATE_OLD):
        return zlib.decompressobj().decompress(data, size)  # no more than the page has room for
    raise ValueError(f"compression {compression} is not supported")


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, rows: int = 1024, order: str = "<") -> bytes:
    """A TIFF file of greyscale pages (height x width, uint8). tile: height and width of tiles, multiples of 16; else strips of so many rows."""
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for pixels in pages:
        height, width = pixels.shape
        if tile:
            grid = np.zeros((-(-height // tile[0]) * tile[0], -(-width // tile[1]) * tile[1]), np.uint8)
            grid[:height, :width] = pixels
            blocks = [grid[y : y + tile[0], x : x + tile[1]] for y in range(0, grid.shape[0], tile[0]) for x in range(0, grid.shape[1], tile[1])]
        else:
            blocks = [pixels[y : y + rows] for y in range(0, height, rows)]
        at, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            data = _pack(np.ascontiguousarray(block).tobytes(), compression)
            at.append(len(out))
            sizes.append(len(data))
            out += data
        tags = {WIDTH: [width], HEIGHT: [height], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [tile[1]], TILE_HEIGHT: [tile[0]], TILE_AT: at, TILE_BYTES: sizes} if tile else {STRIP_ROWS: [rows], STRIP_AT: at, STRIP_BYTES: sizes}
        entries = []
        for tag, values in sorted(tags.items()):
            field = struct.pack(f"{order}{len(values)}I", *values)
            if len(field) > 4:
                out += b"\0" * (len(out) % 2)
                field = struct.pack(order + "I", len(out)) + field
                out += field[4:]
            entries.append(struct.pack(order + "HHI", tag, 4, len(values)) + field[:4])
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    (count,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        size = SIZES.get(kind, 0) * n
        where = at + 10 + 12 * k
        if size > 4:
            (where,) = struct.unpack_from(order + "I", data, where)
        code = {1: "B", 3: "H", 4: "I"}.get(kind)
        if code:
            tags[tag] = list(struct.unpack_from(f"{order}{n}{code}", data, where))
    (follows,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)
    return tags, follows


#: Bytes that one byte of a file can stand for at most: a code of LZW gives up to 3 837 bytes and takes more than one.
MOST_EXPANDED = 4096


def _page(data: bytes, tags: dict[int, list[int]]) -> tuple[np.ndarray, int, int, bool]:
    one = lambda tag, default: tags.get(tag, [default])[0]
    width, height, compression, predictor, samples = one(WIDTH, 0), one(HEIGHT, 0), one(COMPRESSION, NONE), one(PREDICTOR, 1), one(SAMPLES, 1)
    if set(tags.get(BITS, [1])) != {8} or one(PLANAR, 1) != 1 or predictor not in (1, 2):
        raise ValueError("only chunky 8-bit samples with predictor 1 or 2 are supported")
    tiled = TILE_AT in tags
    rows = min(one(STRIP_ROWS, height), height)
    block_h, block_w = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (rows, width)
    blocks = tags[TILE_AT if tiled else STRIP_AT]
    if min(block_h, block_w, samples) < 1 or -(-height // block_h) * -(-width // block_w) != len(blocks):
        raise ValueError(f"{len(blocks)} blocks of {block_w}x{block_h} do not make a page of {width}x{height}")
    if max(height * width, len(blocks) * block_h * block_w) * samples > MOST_EXPANDED * len(data):
        raise ValueError(f"a page of {width}x{height} cannot come from {len(data)} bytes")
    out = np.zeros((height, width, samples), np.uint8)
    places = [(y, x) for y in range(0, height, block_h) for x in range(0, width, block_w)]
    for (y, x), at, size in zip(places, blocks, tags[TILE_BYTES if tiled else STRIP_BYTES], strict=True):
        high = block_h if tiled else min(block_h, height - y)
        need = high * block_w * samples
        got = _unpack(data[at : at + size], compression, need)
        if len(got) < need:
            raise ValueError(f"block at row {y} has {len(got)} of {need} bytes")
        block = np.frombuffer(got, np.uint8, need).reshape(high, block_w, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        part = out[y : y + high, x : x + block_w]
        part[...] = block[: part.shape[0], : part.shape[1]]
    return out, compression, predictor, tiled


def decode(data: bytes | None) -> Iterator[dict]:
    """One dict per page, with the fields of PAGE_SCHEMA; a file or page that cannot be read gives a dict with error."""
    blank = {f.name: None for f in PAGE_SCHEMA}
    try:
        order = {b"II*\0": "<", b"MM\0*": ">"}.get((data or b"")[:4])
        if order is None:
            raise ValueError("not a TIFF file")
        (at,) = struct.unpack_from(order + "I", data, 4)
        seen: set[int] = set()
        while at:
            if at in seen:
                raise ValueError("directories form a loop")
            seen.add(at)
            tags, follows = _directory(data, at, order)
            pixels, compression, predictor, tiled = _page(data, tags)
            counts = np.bincount(pixels.ravel() >> 5, minlength=8)
            feature = f"{pixels.shape[1]}x{pixels.shape[0]} mean={pixels.mean():.4f} hist={','.join(map(str, counts.tolist()))}"
            yield {"page": len(seen) - 1, "width": pixels.shape[1], "height": pixels.shape[0], "compression": NAMES[compression], "predictor": predictor, "tiled": tiled, "pixels": pixels.tobytes(), "feature": feature, "error": None}
            at = follows
    except (ValueError, KeyError, IndexError, OverflowError, MemoryError, struct.error, zlib.error) as e:
        yield blank | {"error": f"{type(e).__name__}: {e}"}


#: Layouts that store() deals out by the checksum of the bytes, so that equal bytes give equal files.
LAYOUTS = ({"compression": LZW}, {"compression": PACKBITS, "tile": (64, 64)}, {"compression": DEFLATE, "predictor": 2, "tile": (64, 64)}, {"compression": DEFLATE}, {"compression": DEFLATE, "predictor": 2}, {"compression": PACKBITS}, {"compression": DEFLATE, "rows": 64}, {"compression": DEFLATE, "tile": (128, 64)})


def payload(data: bytes | None, width: int = 64) -> bytes:
    """The bytes and zeros up to a positive multiple of the width; null counts as empty."""
    data = data or b""
    return data + b"\0" * (max(width, -(-len(data) // width) * width) - len(data))


def store(rows: DataFrame, data_col: str, media_col: str = "media", width: int = 64) -> DataFrame:
    """Replace a binary column by one that holds its payload as a one-page TIFF file.

    Null counts as empty. Every row gives one, repeated ones too, and whatever its length the whole payload is stored. Other
    columns stay as they are; one that is named like the output is replaced. No rows give no rows.
    """
    schema = T.StructType([f for f in rows.schema if f.name not in (data_col, media_col)] + [T.StructField(media_col, T.BinaryType())])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            files = []
            for data in batch[data_col]:
                whole = payload(data, width)
                files.append(encode([np.frombuffer(whole, np.uint8).reshape(-1, width)], **LAYOUTS[zlib.crc32(whole) % len(LAYOUTS)]))
            yield batch.drop(columns=[data_col]).assign(**{media_col: files})[schema.names]

    return map_slices(rows, write, schema)


def pages(media: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per page: the other columns of the row, then those of PAGE_SCHEMA (which replace columns of these names).

    Files that are null, empty, broken or larger than their bytes can tell give one row with the reason in error, after the
    pages that could be read. Repeated rows give their pages each. No rows give no rows.
    """
    new = set(PAGE_SCHEMA.names)
    others = [f for f in media.schema if f.name != media_col and f.name not in new]
    schema = T.StructType(others + list(PAGE_SCHEMA))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            files = batch[media_col].tolist()
            kept = batch[[f.name for f in others]].to_dict("list")
            for k in range(0, len(files), 256):  # the decoded pages of a few files at a time
                out = [{**{n: v[i] for n, v in kept.items()}, **page} for i in range(k, min(k + 256, len(files))) for page in decode(files[i])]
                yield pd.DataFrame(out, columns=schema.names)

    return map_slices(media.select(media_col, *[f.name for f in others]), read, schema)
