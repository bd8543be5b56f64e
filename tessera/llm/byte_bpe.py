"""Byte-level BPE encoding and decoding by monoid tree reduction.

An encoded stretch of text is an element of a monoid: its tokens, grouped by the pieces that
the splitting pattern makes. A text is cut in halves anywhere, the halves are encoded
recursively down to small leaves, and neighbours are joined. Only what is near the seam can
differ from the whole's encoding, so joining encodes a window around the seam anew and widens
it until it provably agrees with what lies outside. Of pieces:

* A piece of the left half is final if it ends at least ``LOOKAHEAD`` characters before the
  seam: the pattern reads at most that far beyond the end of its match.
* The pattern scans from left to right and remembers nothing but its position. Once a piece
  boundary of the window is also a boundary of the right half, every later piece is the same.

Of tokens, where a piece is made of pieces of both halves: tokens are a piece's encoding if
and only if each two neighbours are the encoding of their own bytes. (Take the first merge
across a boundary of tokens: all merges before it lie inside tokens, so those of its two
tokens alone come in the same order and it would happen there too.) A window of the last
tokens of one and the first of the other is merged anew. If its first token is the one that
was there, and its last too, then all neighbours are right: those outside the window were,
those inside are. Else the window grows. Each token of the ranks must be the encoding of its
own bytes, as it is for ranks that come from merges.

Decoding joins the bytes of the two halves up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.tables import decoded, lean, map_texts

#: Characters beyond the end of a match that the splitting pattern may read. In the public
#: pattern an apostrophe was first tried as a contraction of three characters, and a run of
#: white space gives its last one to the word behind it. Another pattern may need another value.
LOOKAHEAD = 2
#: Pieces whose tokens a task remembers; beyond it the memory starts afresh.
CACHED_PIECES = 150_000
LEAF_CHARS = 512
LEAF_TOKENS = 8_192
#: Tokens on either side of a seam that are merged anew at first.
SEAM_TOKENS = 2

#: A piece and its tokens.
Part = tuple[str, list[int]]


@dataclass
class Vocabulary:
    split: Callable[[str], list[str]]
    #: The tokens of a text as one piece.
    merge: Callable[[str], list[int]]
    tokens: list[bytes]


@lru_cache(maxsize=4)
def vocabulary(ranks_path: str, pattern: str) -> Vocabulary:
    import regex
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    unsplit = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return Vocabulary(regex.compile(pattern).findall, unsplit.encode_ordinary, tokens)


class Encoder:
    """Encodes texts by halves; remembers the tokens of short pieces."""

    def __init__(self, v: Vocabulary, leaf_chars: int = LEAF_CHARS, lookahead: int = LOOKAHEAD):
        self.v, self.leaf, self.lookahead = v, leaf_chars, lookahead
        self.known: dict[str, list[int]] = {}

    def __call__(self, text: str) -> list[int]:
        return [i for _, ids in self.parts(text) for i in ids]

    def merged(self, piece: str) -> list[int]:
        found = self.known.get(piece)
        if found is None:
            found = self.v.merge(piece)
            if len(piece) <= 64:
                if len(self.known) >= CACHED_PIECES:
                    self.known.clear()
                self.known[piece] = found
        return found

    def parts(self, text: str) -> list[Part]:
        if len(text) <= self.leaf:
            return [(p, self.merged(p)) for p in self.v.split(text)]
        half = len(text) // 2
        return self.join(self.parts(text[:half]), self.parts(text[half:]))

    def join(self, left: list[Part], right: list[Part]) -> list[Part]:
        """The parts of the two texts' concatenation, from the parts of each."""
        if not left or not right:
            return left or right
        keep, tail = len(left), 0
        while keep and tail < self.lookahead:
            keep -= 1
            tail += len(left[keep][0])
        near = left[keep:]
        width = 2
        while True:
            taken = right[:width]
            window = self.v.split("".join([p for p, _ in near + taken]))
            if width >= len(right):
                return left[:keep] + self.placed(window, near + taken)
            ends, at = {}, tail
            for i, (piece, _) in enumerate(taken):
                at += len(piece)
                ends[at] = i + 1
            limit, at = at - self.lookahead, 0
            for i, piece in enumerate(window):
                at += len(piece)
                if at > limit:
                    break
                if at in ends:
                    return left[:keep] + self.placed(window[: i + 1], near + taken[: ends[at]]) + right[ends[at] :]
            width *= 2

    def placed(self, pieces: list[str], old: list[Part]) -> list[Part]:
        """The pieces with their tokens. Both cut the same text; a piece that is made of whole
        old ones gets their tokens joined, any other is encoded by halves."""
        starts, at = {}, 0
        for k, (p, _) in enumerate(old):
            starts[at] = k
            at += len(p)
        starts[at] = len(old)
        out, at = [], 0
        for piece in pieces:
            a, b = starts.get(at), starts.get(at + len(piece))
            at += len(piece)
            if a is None or b is None:
                out.append((piece, self.whole(piece)))
            else:
                out.append((piece, reduce(self.join_tokens, [ids for _, ids in old[a:b]])))
        return out

    def whole(self, piece: str) -> list[int]:
        """The tokens of a text that is one piece."""
        if len(piece) <= self.leaf:
            return self.merged(piece)
        half = len(piece) // 2
        return self.join_tokens(self.whole(piece[:half]), self.whole(piece[half:]))

    def join_tokens(self, a: list[int], b: list[int]) -> list[int]:
        """The tokens of a piece, from those of its two halves."""
        tokens, width = self.v.tokens, SEAM_TOKENS
        while True:
            i, j = max(0, len(a) - width), min(len(b), width)
            while i and tokens[a[i]][0] & 0xC0 == 0x80:  # within a character
                i -= 1
            while j < len(b) and tokens[b[j]][0] & 0xC0 == 0x80:
                j += 1
            window = self.merged(b"".join([tokens[t] for t in a[i:] + b[:j]]).decode())
            if (not i or window[0] == a[i]) and (j == len(b) or window[-1] == b[j - 1]):
                return a[:i] + window + b[j:]
            width *= 2


def decode(ids: list[int], tokens: list[bytes], leaf_tokens: int = LEAF_TOKENS) -> bytes:
    if len(ids) <= leaf_tokens:
        return b"".join(map(tokens.__getitem__, ids))
    half = len(ids) // 2
    return decode(ids[:half], tokens, leaf_tokens) + decode(ids[half:], tokens, leaf_tokens)


def encode_column(
    docs: DataFrame, ranks_path: str, pattern: str, keep: list[str], text: str = "text", leaf_chars: int = LEAF_CHARS
) -> DataFrame:
    """``keep``, ``ids`` (an array of token ids for each row's whole text), n_tokens and
    lossless (whether the ids decode to the text's bytes, as they do unless those are
    malformed), in one pass without a shuffle. A null or empty text has no ids; special
    tokens' strings are ordinary text; rows that repeat stay; other columns are not read."""
    fields = [pa.field("ids", pa.list_(pa.int32())), pa.field("n_tokens", pa.int64()), pa.field("lossless", pa.bool_())]

    def start():
        v = vocabulary(ranks_path, pattern)
        encode = Encoder(v, leaf_chars)

        def of(raw: bytes) -> tuple:
            ids = encode(decoded(raw))
            return ids, len(ids), decode(ids, v.tokens) == raw

        return of

    return map_texts(docs, keep, fields, start, text)


def decode_column(rows: DataFrame, ranks_path: str, pattern: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``bytes``: the bytes that each row's ``ids`` stand for. Null ids give
    empty bytes."""
    from pyspark.sql.pandas.types import from_arrow_schema

    from tessera.llm.tables import arrow_types

    schema = pa.schema([*map(pa.field, keep, arrow_types(rows, keep)), pa.field("bytes", pa.binary())])

    def run(batches):
        tokens = vocabulary(ranks_path, pattern).tokens
        for batch in batches:
            out = [decode(ids or [], tokens) for ids in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.binary())], schema=schema)

    return rows.select(*keep, "ids").mapInArrow(lean(run), from_arrow_schema(schema))


def round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, keep: list[str], text: str = "text", leaf_chars: int = LEAF_CHARS
) -> DataFrame:
    """``keep``, n_tokens, ids_sha256 and decoded_sha256 for each row: the digests of the
    encoded ids (decimal, joined by a space) and of the bytes decoded from them. One pass;
    the ids never leave the task. Null counts as empty: no tokens, digests of nothing."""
    fields = [
        pa.field("n_tokens", pa.int64()),
        pa.field("ids_sha256", pa.string()),
        pa.field("decoded_sha256", pa.string()),
    ]

    def start():
        v = vocabulary(ranks_path, pattern)
        encode, digits = Encoder(v, leaf_chars), [str(i) for i in range(len(v.tokens))]

        def of(raw: bytes) -> tuple:
            ids = encode(decoded(raw))
            said = " ".join(map(digits.__getitem__, ids)).encode()
            return len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(decode(ids, v.tokens)).hexdigest()

        return of

    return map_texts(docs, keep, fields, start, text)
