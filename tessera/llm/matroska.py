"""Matroska columns: audio tracks written to and packet tables read from binary columns.

The reader walks EBML elements (identifier and size of variable length, unknown sizes
included), and turns clusters, simple blocks, block groups and the four kinds of lacing into
rows of packets with track, timestamp and byte range. A packet's bytes are its range of the
column's value, so nothing is copied until they are wanted. Truncated media give the packets
and cues that are whole, malformed blocks none; null and empty media have neither. A value is
held whole by its task, as Spark's binary columns are.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.tables import map_texts

# Fixed values of the format: element identifiers, as they stand in a file.
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
#: Elements that end a segment or cluster of unknown size.
TOP = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, EBML, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}
#: Elements that are read as far as they go if the file is cut off; of others, a part is nothing.
OPEN = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES}

FRAME = 576
RATE = 48_000
FRAMES_A_BLOCK = 6
BLOCKS_A_CLUSTER = 8


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    offset: int
    size: int
    keyframe: bool
    lacing: int
    cluster: int


class Media(NamedTuple):
    doc_type: str
    codecs: dict[int, str]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # time in ns, track, byte offset of the cluster


# Writing


def size_vint(n: int) -> bytes:
    """A size in as few bytes as hold it; all ones are kept for the unknown size."""
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def signed_vint(n: int) -> bytes:
    width = 1
    while not -(1 << 7 * width - 1) < n < (1 << 7 * width - 1):
        width += 1
    return ((1 << 7 * width) | (n + (1 << 7 * width - 1) - 1)).to_bytes(width, "big")


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + size_vint(len(body)) + body


def unsigned(name: int, n: int) -> bytes:
    return element(name, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: int) -> bytes:
    """What follows a block's flags."""
    sizes = [len(f) for f in frames]
    if lacing == NO_LACING:
        head = b""
    else:
        head = bytes([len(frames) - 1])
        if lacing == XIPH:
            head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
        elif lacing == EBML_LACING:
            head += size_vint(sizes[0])
            head += b"".join(signed_vint(b - a) for a, b in zip(sizes[:-2], sizes[1:-1], strict=True))
    return head + b"".join(frames)


def mux(samples: bytes, frame: int = FRAME, rate: int = RATE) -> bytes:
    """A file with one track of unsigned 8-bit samples. Clusters take turns with the four
    kinds of lacing, and each has a cue."""
    scale = 1_000_000
    info = unsigned(TIMESTAMP_SCALE, scale) + element(MUXING_APP, b"tessera") + element(WRITING_APP, b"tessera")
    info += element(DURATION, struct.pack(">d", len(samples) * 1000 / rate))
    audio = element(SAMPLING_FREQUENCY, struct.pack(">d", rate)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8)
    track = unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2)
    track += element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, audio)
    head = element(EBML, unsigned(0x4286, 1) + unsigned(0x42F7, 1) + element(DOC_TYPE, b"matroska") + unsigned(0x4287, 4) + unsigned(0x4285, 2))
    body = [element(INFO, info), element(TRACKS, element(TRACK_ENTRY, track))]
    at, cues = sum(map(len, body)), []
    step = frame * FRAMES_A_BLOCK * BLOCKS_A_CLUSTER
    for k, start in enumerate(range(0, len(samples), step)):
        lacing, end = k % 4, min(start + step, len(samples))
        time = start * 1000 // rate
        a_block = frame * (1 if lacing == NO_LACING else FRAMES_A_BLOCK)
        blocks = [unsigned(TIMESTAMP, time)]
        for s in range(start, end, a_block):
            frames = [samples[x : x + frame] for x in range(s, min(s + a_block, end), frame)]
            flags = 0x80 | (lacing << 1)
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", s * 1000 // rate - time, flags) + laced(frames, lacing)))
        cluster = element(CLUSTER, b"".join(blocks))
        place = unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER, at)
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, time) + element(CUE_POSITIONS, place)))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


# Reading


def vint(data: bytes, at: int, marked: bool) -> tuple[int, int, int]:
    """Value, position after it and width; with its length marker if ``marked``."""
    first = data[at]
    if not first:
        raise ValueError(f"no variable-length integer at {at}")
    width = 9 - first.bit_length()
    value = int.from_bytes(data[at : at + width], "big")
    if at + width > len(data):
        raise IndexError(at)
    return value if marked else value & ((1 << 7 * width) - 1), at + width, width


def children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Identifier, start and end of the bodies of the elements in a range. What doesn't end in
    the range is left out, or cut if it is OPEN."""
    while at < end:
        try:
            name, at, _ = vint(data, at, True)
            size, at, width = vint(data, at, False)
        except (IndexError, ValueError):
            return
        stop = at + size
        if size == (1 << 7 * width) - 1:
            stop = unknown_end(data, at, end, name)
        if stop <= end or name in OPEN:
            yield name, at, min(stop, end)
        at = stop


def unknown_end(data: bytes, at: int, end: int, name: int) -> int:
    """Where an element of unknown size ends: before the first element that can't be in it."""
    while at < end:
        try:
            inner, body, _ = vint(data, at, True)
            if inner in TOP and (name == CLUSTER or inner in (SEGMENT, EBML)):
                return at
            size, body, width = vint(data, body, False)
        except (IndexError, ValueError):
            return end
        at = unknown_end(data, body, end, inner) if size == (1 << 7 * width) - 1 else body + size
    return end


def number(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def block_frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative timestamp, flags and the byte ranges of a block's frames; an error if
    they don't fill it."""
    track, at, _ = vint(data, at, False)
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if lacing == NO_LACING:
        return track, relative, flags, [(at, end - at)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == FIXED:
        if (end - at) % n:
            raise ValueError("frames of one size don't fill the block")
        sizes = [(end - at) // n] * (n - 1)
    elif n > 1:
        size, at, _ = vint(data, at, False)
        sizes.append(size)
        for _ in range(n - 2):
            raw, at, width = vint(data, at, False)
            sizes.append(sizes[-1] + raw - ((1 << 7 * width - 1) - 1))
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("frames are larger than the block")
    starts = [at]
    for size in sizes[:-1]:
        starts.append(starts[-1] + size)
    return track, relative, flags, list(zip(starts, sizes, strict=True))


def demux(data: bytes) -> Media:
    doc_type, codecs, packets, cues, scale, cluster_no = "", {}, [], [], 1_000_000, -1
    rates: dict[int, float] = {}
    for name, start, end in children(data, 0, len(data)):
        if name == EBML:
            doc_type = next((data[a:b].decode("ascii", "replace") for n, a, b in children(data, start, end) if n == DOC_TYPE), "")
        if name != SEGMENT:
            continue
        for part, a, b in children(data, start, end):
            if part == INFO:
                scale = next((number(data, x, y) for n, x, y in children(data, a, b) if n == TIMESTAMP_SCALE), scale)
            elif part == TRACKS:
                for _, x, y in children(data, a, b):
                    entry = {n: (p, q) for n, p, q in children(data, x, y)}
                    if TRACK_NUMBER in entry:
                        track = number(data, *entry[TRACK_NUMBER])
                        codecs[track] = data[slice(*entry.get(CODEC_ID, (0, 0)))].decode("ascii", "replace")
                        rate = next((p for n, p, q in children(data, *entry.get(AUDIO, (0, 0))) if n == SAMPLING_FREQUENCY and q - p == 8), None)
                        rates[track] = struct.unpack_from(">d", data, rate)[0] if rate is not None else 0.0
            elif part == CLUSTER:
                cluster_no += 1
                base = 0
                for n, x, y in children(data, a, b):
                    key = True
                    if n == TIMESTAMP:
                        base = number(data, x, y)
                        continue
                    if n == BLOCK_GROUP:
                        group = {m: (p, q) for m, p, q in children(data, x, y)}
                        if BLOCK not in group:
                            continue
                        key, (x, y) = REFERENCE not in group, group[BLOCK]
                    elif n != SIMPLE_BLOCK:
                        continue
                    try:
                        track, relative, flags, frames = block_frames(data, x, y)
                    except (IndexError, ValueError, struct.error):
                        continue
                    time = (base + relative) * scale
                    for offset, size in frames:  # within a lace, time passes as 8-bit mono samples last
                        passed = round((offset - frames[0][0]) * 1e9 / rates[track]) if rates.get(track) else 0
                        packets.append(Packet(track, time + passed, offset, size, key if n == BLOCK_GROUP else bool(flags & 0x80), flags >> 1 & 3, cluster_no))
            elif part == CUES:
                for _, x, y in children(data, a, b):
                    point = {n: (p, q) for n, p, q in children(data, x, y)}
                    place = {n: number(data, p, q) for n, p, q in children(data, *point.get(CUE_POSITIONS, (0, 0)))}
                    cues.append((number(data, *point.get(CUE_TIME, (0, 0))) * scale, place.get(CUE_TRACK, 0), start + place.get(CUE_CLUSTER, 0)))
    return Media(doc_type, codecs, packets, cues)


def payload_of(raw: bytes, frame: int = FRAME) -> bytes:
    """The bytes and as many of value 255 as fill a positive number of frames."""
    return raw.ljust(max(1, -(-len(raw) // frame)) * frame, b"\xff")


def read_back(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(data[p.offset : p.offset + p.size] for p in media.packets if p.track == track)


def feature(samples: bytes, media: Media) -> str:
    values = np.frombuffer(samples, np.uint8)
    edges = np.count_nonzero((values[1:] > 127) != (values[:-1] > 127))
    counts = np.bincount(values, minlength=256)
    p = counts[counts > 0] / max(1, len(values))
    return (
        f"packets={len(media.packets)};clusters={len({x.cluster for x in media.packets})};cues={len(media.cues)};"
        f"ms={len(values) * 1000 // RATE};mean={values.mean():.3f};rms={np.sqrt((values.astype(np.float64) ** 2).mean()):.3f};"
        f"crossings={edges};entropy={-(p * np.log2(p)).sum():.4f}"
    )


# Columns


def mux_column(rows: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``media``, a Matroska file of each text's padded bytes; null counts as
    empty, which is one packet of filling."""
    return map_texts(rows, keep, [pa.field("media", pa.binary())], lambda: lambda raw: (mux(payload_of(raw)),), text)


def table_of(rows: DataFrame, keep: list[str], media: str, name: str, fields: list[tuple[str, pa.DataType]], of: Callable[[Media], list[tuple]]) -> DataFrame:
    """A row for each tuple that a media value gives, with its number."""
    from pyspark.sql import functions as F

    kind = pa.list_(pa.struct([pa.field(n, t) for n, t in fields]))
    names = [n for n, _ in fields]

    def start():
        return lambda raw: ([dict(zip(names, x, strict=True)) for x in of(demux(raw))],)

    table = map_texts(rows, keep, [pa.field("_rows", kind)], start, media)
    return table.select(*keep, F.posexplode("_rows").alias(f"{name}_no", "p")).select(*keep, f"{name}_no", "p.*")


def packets(rows: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """A row for each packet of each media value: ``keep``, packet_no, track, timestamp_ns,
    offset, size, keyframe, lacing, cluster. Values without packets give no rows."""
    fields = [("track", pa.int32()), ("timestamp_ns", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.int32()), ("cluster", pa.int32())]
    return table_of(rows, keep, media, "packet", fields, lambda m: m.packets)


def cues(rows: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """A row for each cue of each media value: ``keep``, cue_no, timestamp_ns, track, offset
    (of the cluster's first byte). Values without cues give no rows."""
    return table_of(rows, keep, media, "cue", [("timestamp_ns", pa.int64()), ("track", pa.int32()), ("offset", pa.int64())], lambda m: m.cues)


def stored_features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Writes each whole text as media, reads the packets back and describes both. Null
    counts as empty, which is one packet of filling. One row for each input row."""
    fields = [pa.field(n, t) for n, t in (("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()))]

    def of(raw: bytes) -> tuple:
        data = mux(payload_of(raw))
        media = demux(data)
        back = read_back(data, media)
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(back, media)

    return map_texts(docs, keep, fields, lambda: of, text)
