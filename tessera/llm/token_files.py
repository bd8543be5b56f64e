"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents, each with an end id. Blocks of ``BLOCK`` ids
keep their minimum, the differences to it packed at the width that a percentile of them
needs, and the few that need more in an exception list. A footer has the start of each block
and of each document, so that any document is read without decoding the others.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tables import decoded, lean, shared_dir

MAGIC = b"PFORTOK1"
BLOCK = 4_096
PERCENTILE = 98
HEAD = struct.Struct("<IIBI")  # ids, minimum, width, exceptions
FOOT = struct.Struct("<QQQQ8s")  # blocks, documents, ids, start of the index, magic
#: Stretches whose ids a task remembers; beyond it, only those that are met again stay.
CACHED_WORDS = 600_000


def pack(values: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """A block of unsigned 32-bit values."""
    low = int(values.min()) if len(values) else 0
    rest = values.astype(np.uint32) - np.uint32(low)
    typical = int(np.percentile(rest, percentile, method="lower")) if len(values) else 0
    width = typical.bit_length()
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    packed = np.packbits((rest[:, None] >> np.arange(width, dtype=np.uint32) & 1).astype(np.uint8).ravel(), bitorder="little")
    return HEAD.pack(len(values), low, width, len(odd)) + packed.tobytes() + odd.astype("<u4").tobytes() + rest[odd].astype("<u4").tobytes()


def unpack(data: bytes, at: int = 0) -> np.ndarray:
    n, low, width, odd = HEAD.unpack_from(data, at)
    at += HEAD.size
    size = (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
    out = np.zeros(n, np.uint32)
    for i in range(width):
        out |= bits[:, i].astype(np.uint32) << np.uint32(i)
    at += size
    where = np.frombuffer(data, "<u4", odd, at)
    out[where] = np.frombuffer(data, "<u4", odd, at + 4 * odd)
    return out + np.uint32(low)


class Writer:
    """Blocks go to the stream as they fill; only starts are kept."""

    def __init__(self, stream):
        self.stream, self.at, self.waiting, self.ids = stream, 0, [], 0
        self.blocks: list[int] = []
        self.keys: list[int | None] = []
        self.starts: list[int] = []
        self.put(MAGIC)

    def put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, key: int | None, ids: bytes) -> None:
        self.keys.append(key)
        self.starts.append(self.ids)
        self.waiting.append(ids)
        self.ids += len(ids) // 4
        if self.ids - len(self.blocks) * BLOCK >= 64 * BLOCK:
            self.flush(False)

    def flush(self, last: bool) -> None:
        values = np.frombuffer(b"".join(self.waiting), "<u4")
        end = len(values) if last else len(values) // BLOCK * BLOCK
        for a in range(0, end, BLOCK):
            self.blocks.append(self.at)
            self.put(pack(values[a : min(a + BLOCK, end)]))
        self.waiting = [values[end:].tobytes()]

    def close(self) -> None:
        self.flush(True)
        index = self.at
        self.put(np.array(self.blocks, "<u8").tobytes())
        self.put(np.array([k or 0 for k in self.keys], "<i8").tobytes())
        self.put(np.array([k is None for k in self.keys], np.uint8).tobytes())
        self.put(np.array(self.starts, "<u8").tobytes())
        self.put(FOOT.pack(len(self.blocks), len(self.keys), self.ids, index, MAGIC))


def read(data: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """Key, start and ids of each document of a file, block after block."""
    blocks, docs, total, at, magic = FOOT.unpack_from(data, len(data) - FOOT.size)
    if magic != MAGIC or data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    places = np.frombuffer(data, "<u8", blocks, at)
    keys = np.frombuffer(data, "<i8", docs, at + 8 * blocks)
    null = np.frombuffer(data, np.uint8, docs, at + 8 * (blocks + docs))
    starts = np.frombuffer(data, "<u8", docs, at + 8 * (blocks + docs) + docs)
    ends = [*starts[1:].tolist(), total]
    held, first, k = np.zeros(0, np.uint32), 0, 0
    for key, no, start, end in zip(keys.tolist(), null.tolist(), starts.tolist(), ends, strict=True):
        while first + len(held) < end:
            more = [unpack(data, int(p)) for p in places[k : k + 16]]
            held, first = np.concatenate([held[start - first :], *more]), start
            k += len(more)
        yield None if no else key, start, held[start - first : end - first]


class Words(dict):
    """Ids of stretches without white space, as bytes of unsigned 32-bit integers. White
    space separates and is dropped, so a text's ids are those of its stretches in turn."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.older = tokenizer, {}
        self.special = {t.content.lower() for t in tokenizer.get_added_tokens_decoder().values()}
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def of(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, stretches: set[str]) -> None:
        """Makes the ids of the stretches known. Words of letters go to the tokenizer
        together, as each of them ends with its only token that ends a word."""
        if len(self) + len(stretches) >= CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        older, plain = self.older, []
        for s in stretches.difference(self):
            found = older.get(s)
            if found is not None:
                self[s] = found
            elif s.isalpha() and (s.isascii() or normalize("NFC", s).lower().isalpha()):
                plain.append(s)
            else:
                self[s] = self.of(s)
        for at in range(0, len(plain), 2_000):
            part = plain[at : at + 2_000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cuts = [0, *(np.flatnonzero(self.ends[ids]) * 4 + 4).tolist()]
            if len(cuts) == len(part) + 1 and cuts[-1] == 4 * len(ids):
                raw = ids.tobytes()
                self.update(zip(part, [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
            else:
                self.update((s, self.of(s)) for s in part)


#: White space to str.split() that the tokenizer's expression doesn't count as such.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: A mark after a letter, where a token always begins; an apostrophe may be part of a word.
MARK = re.compile(r"[!-&(-/:-@\[-`{-~](?<=[a-zß-öø-ÿ].)")


def stretches_of(text: str, special: set[str]) -> list[str] | None:
    """Stretches whose ids make up the text's; None if it has to be encoded at once. The
    tokenizer composes characters and then lowers case letter by letter; lowering first does
    the same unless there is something to compose, or a sigma, whose place would count. It
    looks for special tokens' strings before all that, so texts that have one go at once."""
    low = text.lower()
    if any(c in text for c in SEPARATORS) or any(s in low for s in special):
        return None
    if not text.isascii() and ("Σ" in text or not (is_normalized("NFC", text) and is_normalized("NFC", low))):
        return None
    return MARK.sub(r" \g<0>", low).split()


def encode(texts: list[str], known: Words) -> Iterator[bytes]:
    """The ids of each text. The texts together should be few enough to know all their
    stretches at once."""
    apart = [stretches_of(t, known.special) for t in texts]
    known.learn(set(chain.from_iterable(filter(None, apart))))
    for text, stretches in zip(texts, apart, strict=True):
        yield known.of(text) if stretches is None else b"".join(map(known.__getitem__, stretches))


@lru_cache(maxsize=2)
def words(tokenizer_path: str) -> Words:
    from tokenizers import Tokenizer

    return Words(Tokenizer.from_file(tokenizer_path))


def portions(batch: pa.RecordBatch, column: int, size: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """The texts of a batch, about ``size`` characters at a time, and where they begin."""
    held, begin, total = [], 0, 0
    for i, raw in enumerate(batch.column(column)):
        held.append(decoded(raw.as_py()))
        total += len(held[-1])
        if total >= size:
            yield begin, held
            held, begin, total = [], i + 1, 0
    if held:
        yield begin, held


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> list[tuple[int, str, int, int]]:
    """Writes one file a partition to a folder that executors share, in ascending order of
    ``key`` (nulls first, ties by text), and returns each file's number, path, documents and
    ids. A null or empty text is its end id alone. Files appear under their name when they
    are whole, so a task may be run again."""
    parted = docs.select(key, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"))
    parted = parted.repartitionByRange(F.col(key)).sortWithinPartitions(key, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        known, end = words(tokenizer_path), struct.pack("<I", end_id)
        number, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        files, at = fs.FileSystem.from_uri(folder)
        files.create_dir(at, recursive=True)
        writer = None
        for batch in batches:
            if writer is None and len(batch):
                stream = files.open_output_stream(f"{at}/attempt-{attempt}")
                writer = Writer(stream)
            keys = batch.column(0).to_pylist()
            for begin, texts in portions(batch, 1):
                for k, ids in zip(keys[begin:], encode(texts, known), strict=False):
                    writer.add(k, ids + end)
        if writer is not None:
            writer.close()
            stream.close()
            files.move(f"{at}/attempt-{attempt}", f"{at}/part-{number:06d}.pfor")
            yield pa.RecordBatch.from_pydict({"number": [number], "path": [f"{folder}/part-{number:06d}.pfor"], "docs": [len(writer.keys)], "ids": [writer.ids]})

    return sorted(map(tuple, parted.mapInArrow(lean(run), "number long, path string, docs long, ids long").collect()))


def documents(spark: SparkSession, files: list[tuple[int, str, int, int]], key: str = "doc_id") -> DataFrame:
    """A row for each document of the files: ``key``, start (ids of all documents before
    it), n_tokens and ids_crc32. One task reads one file."""
    before, rows = 0, []
    for number, path, _, ids in files:
        rows.append((number, path, before))
        before += ids
    listed = spark.createDataFrame(rows, "number long, path string, before long").repartitionByRange(max(1, len(rows)), "number")
    names = [key, "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as f:
                    data = f.read()
                out = [(k, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for k, start, ids in read(data)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], names=names)

    return listed.mapInArrow(lean(run), ", ".join(f"{n} long" for n in names))


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id") -> DataFrame:
    """``key``, start, n_tokens and ids_crc32 of each document, from files written to the
    shared folder and read back. Documents without text have the end id alone, repeated rows
    are documents each, and without rows there are no files. A special token's string in a
    text is that token, as the tokenizer has it."""
    spark = docs.sparkSession
    return documents(spark, write(docs, shared_dir(spark, "token-files"), tokenizer_path, end_id, key), key)
