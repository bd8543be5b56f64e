"""The directory of a GeoTIFF file, and its blocks.

A file is read by ranges of bytes: the directory first, then those blocks that are asked for.
Classic and large (64-bit) files, tiles and strips, pixel by pixel or band by band, stored as
they are or deflated, with differences of neighbours or without; another compression is an error
that names it. What is written is one band of bytes in deflated tiles.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Fixed values of the format: numbers of tags and of types of values, kinds of compression.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, BANDS, STRIP_ROWS, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, TRANSFORMATION, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
PLAIN, DEFLATED, DEFLATED_OLD = 1, 8, 32946
GEOGRAPHIC_KEY, PROJECTED_KEY, MODEL_KEY, RASTER_KEY = 2048, 3072, 1024, 1025

#: Gives so many bytes from a place on; fewer at the end of the file.
Reader = Callable[[int, int], bytes]


@dataclass
class Layout:
    """What a directory says. ``transform`` is a, b, c, d, e, f of x = a * col + b * row + c and
    y = d * col + e * row + f, of pixels' corners."""

    height: int
    width: int
    bands: int
    dtype: str
    block_height: int
    block_width: int
    compression: int
    predictor: int
    by_band: bool
    transform: list[float] | None
    epsg: int | None
    nodata: float | None
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]

    @property
    def down(self) -> int:
        return -(-self.height // self.block_height)

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)

    @property
    def planes(self) -> int:
        """How many blocks there are at one place: one, or one for each band."""
        return self.bands if self.by_band else 1


def tags_of(read: Reader) -> tuple[str, dict[int, tuple]]:
    """The byte order and the values of the first directory."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2], "")
    version = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("no TIFF file")
    large = version == 43
    start = struct.unpack(f"{order}{'Q' if large else 'I'}", head[8:16] if large else head[4:8])[0]
    count_type, entry_type, inline = ("Q", "HHQ", 8) if large else ("H", "HHI", 4)
    head_size, entry_size = struct.calcsize(count_type), struct.calcsize(f"={entry_type}") + inline
    n = struct.unpack(f"{order}{count_type}", read(start, head_size))[0]
    raw = read(start + head_size, n * entry_size)
    found: dict[int, tuple] = {}
    for i in range(n):
        entry = raw[i * entry_size : (i + 1) * entry_size]
        tag, kind, count = struct.unpack(f"{order}{entry_type}", entry[:-inline])
        if kind not in TYPES:
            continue
        size = count * struct.calcsize(TYPES[kind])
        value = entry[-inline:][:size] if size <= inline else read(struct.unpack(f"{order}{'Q' if large else 'I'}", entry[-inline:])[0], size)
        found[tag] = (value,) if kind == 2 else struct.unpack(f"{order}{count}{TYPES[kind]}", value)
    return order, found


def transform_of(tags: dict[int, tuple]) -> list[float] | None:
    if TRANSFORMATION in tags:
        m = tags[TRANSFORMATION]
        return [m[0], m[1], m[3], m[4], m[5], m[7]]
    if PIXEL_SCALE in tags and TIE_POINT in tags:
        (sx, sy), (col, row, _, x, y) = tags[PIXEL_SCALE][:2], tags[TIE_POINT][:5]
        return [sx, 0.0, x - col * sx, 0.0, -sy, y + row * sy]
    return None


def layout_of(read: Reader) -> Layout:
    order, tags = tags_of(read)
    one = lambda tag, default: int(tags.get(tag, (default,))[0])
    bits, kind = one(BITS, 1), "?uif"[min(3, one(SAMPLE_FORMAT, 1))]
    keys = tags.get(GEO_KEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    nodata = tags[NODATA][0].split(b"\0")[0].strip() if NODATA in tags else b""
    height, width = one(HEIGHT, 0), one(WIDTH, 0)
    tiled = TILE_OFFSETS in tags
    return Layout(
        height,
        width,
        one(BANDS, 1),
        f"{order}{kind}{bits // 8}" if bits % 8 == 0 else f"{bits} bits",
        one(TILE_HEIGHT, 0) if tiled else min(one(STRIP_ROWS, height), height),
        one(TILE_WIDTH, 0) if tiled else width,
        one(COMPRESSION, PLAIN),
        one(PREDICTOR, 1),
        one(PLANAR, 1) == 2,
        transform_of(tags),
        codes.get(PROJECTED_KEY, codes.get(GEOGRAPHIC_KEY)),
        float(nodata) if nodata else None,
        tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, ()),
        tags.get(TILE_BYTES if tiled else STRIP_BYTES, ()),
    )


def block(layout: Layout, number: int, read: Reader) -> np.ndarray:
    """One block as (bands, rows, columns), without what it has beyond the image; one that isn't
    stored is no data, or zero."""
    at = number % (layout.down * layout.across)
    row, col = at // layout.across, at % layout.across
    bands = 1 if layout.by_band else layout.bands
    rows = min(layout.block_height, layout.height - row * layout.block_height)
    columns = min(layout.block_width, layout.width - col * layout.block_width)
    if layout.compression not in (PLAIN, DEFLATED, DEFLATED_OLD) or layout.predictor not in (1, 2) or " " in layout.dtype:
        raise ValueError(f"blocks of compression {layout.compression}, predictor {layout.predictor} and type {layout.dtype} can't be read")
    if not layout.sizes[number]:
        return np.full((bands, rows, columns), layout.nodata or 0, np.dtype(layout.dtype).newbyteorder("="))
    raw = read(layout.offsets[number], layout.sizes[number])
    raw = raw if layout.compression == PLAIN else zlib.decompress(raw)
    pixels = np.frombuffer(raw, layout.dtype)
    stored_rows = len(pixels) // (layout.block_width * bands)  # a last strip may be shorter than the others
    pixels = pixels.reshape(stored_rows, layout.block_width, bands)
    pixels = pixels.astype(pixels.dtype.newbyteorder("="))
    if layout.predictor == 2:
        pixels = np.cumsum(pixels, axis=1, dtype=pixels.dtype)
    return np.ascontiguousarray(pixels[:rows, :columns].transpose(2, 0, 1))


def window(layout: Layout, row: int, col: int, height: int, width: int, block_of: Callable[[int], np.ndarray]) -> np.ndarray | None:
    """A window as (bands, rows, columns), of the blocks below it alone; no data, or zero, where it
    reaches beyond the image. None if it is wholly outside."""
    r0, r1, c0, c1 = max(row, 0), min(row + height, layout.height), max(col, 0), min(col + width, layout.width)
    if r0 >= r1 or c0 >= c1:
        return None
    out = np.full((layout.bands, height, width), layout.nodata or 0, np.dtype(layout.dtype).newbyteorder("="))
    for plane in range(layout.planes):
        bands = slice(plane, plane + 1) if layout.by_band else slice(None)
        for i in range(r0 // layout.block_height, -(-r1 // layout.block_height)):
            for j in range(c0 // layout.block_width, -(-c1 // layout.block_width)):
                pixels = block_of((plane * layout.down + i) * layout.across + j)
                top, left = i * layout.block_height, j * layout.block_width
                a0, a1, b0, b1 = max(r0, top), min(r1, top + pixels.shape[1]), max(c0, left), min(c1, left + pixels.shape[2])
                out[bands, a0 - row : a1 - row, b0 - col : b1 - col] = pixels[:, a0 - top : a1 - top, b0 - left : b1 - left]
    return out


def file_of(height: int, width: int, size: int, blocks: dict[int, bytes], transform: list[float] | None = None, epsg: int | None = None) -> list[bytes]:
    """The parts of a file of one band of bytes, whose deflated tiles of ``size`` (a multiple of 16)
    are given by number; others are left out, and are zero."""
    n = -(-height // size) * -(-width // size)
    entries: list[tuple[int, str, list]] = [
        (WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [8]), (COMPRESSION, "H", [DEFLATED]), (PHOTOMETRIC, "H", [1]), (BANDS, "H", [1]), (PLANAR, "H", [1]),
        (TILE_WIDTH, "I", [size]), (TILE_HEIGHT, "I", [size]), (TILE_OFFSETS, "I", [0] * n), (TILE_BYTES, "I", [len(blocks.get(i, b"")) for i in range(n)]), (SAMPLE_FORMAT, "H", [1]),
    ]
    if transform:
        a, b, c, d, e, f = transform
        entries.append((TRANSFORMATION, "d", [a, b, 0, c, d, e, 0, f, 0, 0, 0, 0, 0, 0, 0, 1]))
    if epsg:
        degrees = 4000 <= epsg < 5000  # codes of geographic systems; others are projected
        keys = [(MODEL_KEY, 2 if degrees else 1), (RASTER_KEY, 1), (GEOGRAPHIC_KEY if degrees else PROJECTED_KEY, epsg)]
        entries.append((GEO_KEYS, "H", [1, 1, 0, len(keys), *(v for k, code in keys for v in (k, 0, 1, code))]))
    kinds = {v: k for k, v in TYPES.items()}
    start = 8 + 2 + 12 * len(entries) + 4
    at = start + sum(size_ for _, kind, v in entries if (size_ := len(v) * struct.calcsize(kind)) > 4)
    if at + sum(map(len, blocks.values())) >= 1 << 32:
        raise ValueError("a file of 4 GB or more")
    for _, _, values in (e for e in entries if e[0] == TILE_OFFSETS):
        for i in range(n):
            values[i] = at if i in blocks else 0
            at += len(blocks.get(i, b""))
    directory, outside = struct.pack("<H", len(entries)), b""
    for tag, kind, values in entries:
        raw = struct.pack(f"<{len(values)}{kind}", *values)
        if len(raw) > 4:
            place = struct.pack("<I", start + len(outside))
            outside += raw
        else:
            place = raw.ljust(4, b"\0")
        directory += struct.pack("<HHI", tag, kinds[kind], len(values)) + place
    return [b"II*\0" + struct.pack("<I", 8), directory + struct.pack("<I", 0), outside, *(blocks[i] for i in sorted(blocks))]
