"""Line dedup: a line goes if an equal or nearly equal line stands earlier in the corpus.

Nearly equal are lines within ``EDITS`` edits that are also few for their length: one for each
CHARS_AN_EDIT characters of the longer line. Equal lines meet by a hash of 128 bits. Nearly
equal ones meet by segments: a line is cut into edits + 1 even segments, of which an edited
copy keeps at least one unchanged and nearly in place. Each line is indexed by its segments
under its length, and looks up, for its own length and every shorter one in reach, the few
substrings that alignment allows. What meets must have nearly the same parities of characters
and of character pairs, and is then verified by a banded bit-parallel edit distance.

A line's links count, not what they lead to: of A, B and C, where only A and B, and B and C,
are nearly equal, C goes if B stands earlier, whether or not B goes too. So it is enough to find
one such B: under a key with few lines all pairs are looked at, and under a crowded one a line
is done with the first earlier line that it is nearly equal to (a semi-join).

Keys are made in numpy, many lines at a time; joining them is Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.jaccard_join import FILTER_BITS, INVERSE, MULTIPLIER, candidate_filter, mixed, powers
from tessera.llm.tables import decoded, lean, scratch, shared_dir, stored

EDITS = 2
#: One edit for so many characters of the longer line, EDITS at most.
CHARS_AN_EDIT = 10
#: Characters for which keys are made at once, in a task.
PORTION = 1 << 20
#: Lines that a task remembers as done; beyond it the memory starts afresh.
REMEMBERED = 500_000
#: Lines that one key may be of, for all their pairs to be made.
CROWDED = 64
UNIGRAMS = (1 << 32) - 1
PARITIES = ("_p0", "_p1", "_p2", "_p3")


def allowed(length: int) -> int:
    """Edits that a pair of lines may be apart, by the longer one's length."""
    return min(EDITS, length // CHARS_AN_EDIT)


def line_id(line: bytes) -> tuple[int, int]:
    """A hash of 128 bits as two signed numbers."""
    import xxhash

    h = xxhash.xxh3_128_intdigest(line)
    return (h & (1 << 64) - 1) - (1 << 63), (h >> 64) - (1 << 63)


def lines_of(raw: bytes) -> list[bytes]:
    """A text's lines without white space at their ends."""
    return [line.strip() for line in raw.split(b"\n")]


# Keys


def segment(i: int, length: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i of lines so long; the last ones are a character longer."""
    base, more = length // (edits + 1), length % (edits + 1)
    plain = edits + 1 - more
    return i * base + np.maximum(0, i - plain), base + (i >= plain)


def shifts(i: int, shorter: int, edits: int) -> range:
    """By how much the substring that can equal segment i of a line ``shorter`` characters
    shorter may be shifted: edits before it and edits after it both bound that."""
    return range(max(-i, shorter - (edits - i)), min(i, shorter + edits - i) + 1)


def key_rows(ids: list[int], lines: list[str], probe: bool) -> Iterator[pa.RecordBatch]:
    """(key, id, signature) of lines that aren't empty: those that a line is found by, or those
    that it looks for."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(x) for x in lines], np.int64)
    starts = np.cumsum(sizes) - sizes
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(MULTIPLIER, len(codes)), out=sums[1:])
    back = powers(INVERSE, len(codes) + 1)
    one = np.int64(1) << (mixed(codes.astype(np.uint64)) & np.uint64(31)).astype(np.int64)
    pair = codes[:-1].astype(np.uint64) << np.uint64(21) | codes[1:].astype(np.uint64)
    two = np.int64(1) << (mixed(pair) & np.uint64(31)).astype(np.int64)
    two = np.append(two, 0)
    two[starts + sizes - 1] = 0  # no pair across lines
    signature = np.bitwise_xor.reduceat(one, starts) | np.bitwise_xor.reduceat(two, starts) << np.int64(32)
    owners = np.array(ids, np.int64)

    def rows(i: int, edits: int, length: np.ndarray, at: np.ndarray, size: np.ndarray, ok: np.ndarray) -> pa.RecordBatch:
        a = (starts + at)[ok]
        h = (sums[a + size[ok]] - sums[a]) * back[a]
        key = mixed(h ^ mixed(((length[ok] * (edits + 1) + i) * (EDITS + 1) + edits).astype(np.uint64)))
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(owners[ok]), pa.array(signature[ok])], names=["key", "id", "signature"])

    for edits in range(1, EDITS + 1):  # by the longer line's length, which is the one that looks
        least, most = edits * CHARS_AN_EDIT, (edits + 1) * CHARS_AN_EDIT if edits < EDITS else 1 << 62
        if not probe:
            ok = (sizes >= least - edits) & (sizes < most)
            for i in range(edits + 1):
                at, size = segment(i, sizes, edits)
                yield rows(i, edits, sizes, at, size, ok)
            continue
        looks = (sizes >= least) & (sizes < most)
        for shorter in range(edits + 1):
            length = sizes - shorter
            for i in range(edits + 1):
                start, size = segment(i, length, edits)
                for shift in shifts(i, shorter, edits):
                    at = start + shift
                    yield rows(i, edits, length, at, size, looks & (at >= 0) & (at + size <= sizes))


def keys(texts: DataFrame, probe: bool) -> DataFrame:
    """The keys of a table of texts (_text), of each different line once in a while."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, ids, lines, size = set(), [], [], 0
        for batch in batches:
            for raw in batch.column(0):
                for line in lines_of(raw.as_py()):
                    if len(line) >= CHARS_AN_EDIT - 1 and (x := line_id(line)) not in met:
                        said = decoded(line)
                        met.add(x)
                        ids.append(x[0])
                        lines.append(said)
                        size += len(said)
                if size >= PORTION:
                    yield from key_rows(ids, lines, probe)
                    ids, lines, size = [], [], 0
                if len(met) >= REMEMBERED:
                    met.clear()
        if ids:
            yield from key_rows(ids, lines, probe)

    return texts.select("_text").mapInArrow(lean(run), "key long, id long, signature long")


# Meeting


def near(a: Column, b: Column) -> Column:
    """Whether signatures leave it open that lines are within EDITS edits: an edit changes the
    parity of two characters and of four pairs at most."""
    off = a.bitwiseXOR(b)
    return (F.bit_count(off.bitwiseAND(F.lit(UNIGRAMS))) <= 2 * EDITS) & (F.bit_count(F.shiftrightunsigned(off, 32)) <= 4 * EDITS)


def crowded(index: DataFrame) -> DataFrame:
    """Keys that more than CROWDED lines are found by."""
    return index.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > CROWDED).select("key")


def meetings(index: DataFrame, crowds: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, a, b, _y): pairs of line ids that a segment and the signatures bring together, and,
    without a, one row for each line b that looks for a crowded key."""
    some = index.join(crowds, "key", "left_anti").select("key", F.col("id").alias("a"), F.col("signature").alias("_x"))
    one = some.unionByName(crowds, allowMissingColumns=True)
    two = keys(texts, True).select("key", F.col("id").alias("b"), F.col("signature").alias("_y"))
    return one.join(two, (one.key == two.key) & (F.col("a").isNull() | (F.col("a") != F.col("b")) & near(F.col("_x"), F.col("_y")))).select(one.key, "a", "b", "_y")


# Verifying


def within(a: str, b: str, edits: int = EDITS) -> bool:
    """Whether two strings are within so many edits, by bit vectors of the differences along
    a band of 2 * edits + 1 diagonals."""
    if abs(len(a) - len(b)) > edits:
        return False
    m, n = len(a), len(b)
    at = 0
    while at < min(m, n) and a[at] == b[at]:
        at += 1
    end = 0
    while end < min(m, n) - at and a[m - 1 - end] == b[n - 1 - end]:
        end += 1
    a, b = a[at : m - end], b[at : n - end]
    m, n = len(a), len(b)
    if not m or not n:
        return m + n <= edits
    k, window = edits, (1 << 2 * edits + 1) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    score = min(k, m)  # of the band's lowest row, or the last row once the band reaches it
    up, down = window >> k << k, 0
    for j in range(1, n + 1):
        equal = places.get(b[j - 1], 0) << k >> j - 1 & window
        same = ((equal & up) + up ^ up | equal | down) & window
        right = (down | ~(same | up)) & window
        left = same & up
        if j + k <= m:
            score += 1 - (same >> 2 * k & 1)
            if score - (n + k - m) > k:
                return False
        else:
            score += (right >> m - j + k & 1) - (left >> m - j + k & 1)
        up = (left | ~(same >> 1 | right)) & window
        down = same >> 1 & right
    return score <= k


def lines_with(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, more, line) of the lines whose id is among ``nodes``; those that share the first half
    of their hash are told apart by the other."""
    bits = texts.sparkSession.sparkContext.broadcast(candidate_filter(nodes))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in batches:
            out = []
            for raw in batch.column(0):
                for line in lines_of(raw.as_py()):
                    if len(line) >= CHARS_AN_EDIT - 1:
                        x, more = line_id(line)
                        slot = x & (FILTER_BITS - 1)
                        if bits.value[slot >> 3] >> (slot & 7) & 1 and (x, more) not in met:
                            met.add((x, more))
                            out.append((x, more, decoded(line)))
            if len(met) >= REMEMBERED:
                met.clear()
            if out:
                x, more, lines = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(more, pa.int64()), pa.array(lines, pa.string())], names=["node", "more", "line"])

    found = texts.select("_text").mapInArrow(lean(wanted), "node long, more long, line string").join(nodes, "node", "left_semi")
    return found.dropDuplicates(["node", "more"])


def verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Of candidates (a, b) the lines that are nearly equal: (id, more, other, other_more), the
    halves of both hashes, in both directions."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [within(a, b, allowed(max(len(a), len(b)))) for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    one, two = (lines.select(F.col("node").alias(x), F.col("more").alias(f"_more_{x}"), F.col("line").alias(f"_line_{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b").select("a", "_more_a", "b", "_more_b", "_line_a", "_line_b")
    links = stored(both.mapInArrow(lean(check), "id long, more long, other long, other_more long"), "line-links")
    back = links.select(F.col("other").alias("id"), F.col("other_more").alias("more"), F.col("id").alias("other"), F.col("more").alias("other_more"))
    return links.unionByName(back)


def trigram_parities(line: str) -> list[int]:
    """Parities of a line's trigrams by a hash of 8 bits: 256 bits as four signed numbers. An edit
    changes six trigrams at most."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    three = codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]
    odd = np.bincount((mixed(three) & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def with_parities(lines: DataFrame) -> DataFrame:
    """``lines`` (node, more, line) with _p0 to _p3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                odd = zip(*map(trigram_parities, batch.column(2).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in odd)], names=["node", "more", "line", *PARITIES])

    return lines.select("node", "more", "line").mapInArrow(lean(run), f"node long, more long, line string, {', '.join(f'{c} long' for c in PARITIES)}")


def preceded(found: DataFrame, look: DataFrame, lines: DataFrame, first: DataFrame) -> DataFrame:
    """(id, more) of the lines under crowded keys to which an earlier line under the same key is
    nearly equal: each of those that look (key, id, signature) against those that are found, and the
    other way round. A line leaves one row a key at most, however many lines are like it."""
    placed = stored(with_parities(lines).join(first.select(F.col("id").alias("node"), "more", "_first"), ["node", "more"]), "crowded-lines")

    def side(rows: DataFrame, mark: str) -> DataFrame:
        own = rows.join(placed, rows.id == placed.node).select("key", "id", "more", "signature", "_first", "line", *PARITIES)
        return stored(own.distinct(), f"crowded-{mark}")

    def before(rows: DataFrame, others: DataFrame) -> DataFrame:
        x, y = rows.alias("x"), others.alias("y")
        most = F.least(F.lit(EDITS), F.floor(F.greatest(F.length("x.line"), F.length("y.line")) / CHARS_AN_EDIT))
        odd = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in PARITIES), F.lit(0))
        like = near(F.col("x.signature"), F.col("y.signature")) & (odd <= 6 * EDITS) & F.levenshtein("x.line", "y.line", EDITS).between(F.lit(0), most)
        return x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("y._first") < F.col("x._first")) & like, "left_semi").select("id", "more").distinct()

    found, look = side(found, "found"), side(look, "looking")
    done = stored(before(look, found), "preceded")
    return done.unionByName(before(found.join(done, ["id", "more"], "left_anti"), look))


# Dedup


def occurrences(texts: DataFrame) -> DataFrame:
    """(_key, _hash, _line, _size, id, more) for each line that isn't blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, line, size, ids, more = [], [], [], [], []
            for r, raw in enumerate(batch.column(2)):
                for n, x in enumerate(lines_of(raw.as_py())):
                    if x:
                        row.append(r)
                        line.append(n)
                        size.append(len(x))
                        h = line_id(x)
                        ids.append(h[0])
                        more.append(h[1])
            at = pa.array(row, pa.int64())
            ints = [pa.array(c, pa.int32()) for c in (line, size)] + [pa.array(c, pa.int64()) for c in (ids, more)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *ints], names=["_key", "_hash", "_line", "_size", "id", "more"])

    return texts.select("_key", "_hash", "_text").mapInArrow(lean(run), "_key long, _hash long, _line int, _size int, id long, more long")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, _hash, n_lines, n_equal, n_near, _dropped, _share) for each document with lines:
    its lines that aren't blank, those equal and those only nearly equal to an earlier one, the
    numbers of both, and the share of its bytes that they have. _key is the integer ``key`` and
    _hash a hash of the text, so that rows with the same key and other texts are apart; rows
    alike in both are one document, and all keep what it keeps. Documents go by key (nulls
    first), then hash. Null, empty and blank texts have no lines and no row; a text of any
    length is read whole."""
    texts = docs.select(F.col(key).cast("long").alias("_key"), F.xxhash64(text).alias("_hash"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"))
    spark = docs.sparkSession
    target = shared_dir(spark, "places-of-lines")
    lines = stored(occurrences(texts), "lines")
    place = F.struct("_key", "_hash", "_line")
    with scratch(spark):
        first = stored(lines.groupBy("id", "more").agg(F.min(place).alias("_first")), "first-lines")
        index = stored(keys(texts, False), "line-keys")
        crowds = stored(crowded(index), "crowded-keys")
        met = stored(meetings(index, crowds, texts), "line-meetings")
        pairs = stored(met.where("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-candidates")
        found = index.join(crowds, "key", "left_semi")
        look = met.where("a is null").select("key", F.col("b").alias("id"), F.col("_y").alias("signature"))
        nodes = reduce(DataFrame.union, (pairs.select(F.col("a").alias("node")), pairs.select("b"), found.select("id"), look.select("id"))).distinct()
        said = stored(lines_with(texts, nodes), "candidate-lines")
        links = verified(pairs, said)
        others = first.select(F.col("id").alias("other"), F.col("more").alias("other_more"), F.col("_first").alias("_near"))
        near_first = links.join(others, ["other", "other_more"]).groupBy("id", "more").agg(F.min("_near").alias("_near"))
        known = first.join(near_first, ["id", "more"], "left")
        if not crowds.isEmpty():
            after = preceded(found, look, said, first).distinct().withColumn("_after", F.lit(True))
            known = known.join(after, ["id", "more"], "left")
        else:
            known = known.withColumn("_after", F.lit(False))
        known = known.select("id", "more", "_first", (F.coalesce("_after", F.lit(False)) | F.coalesce(F.col("_near") < F.col("_first"), F.lit(False))).alias("_like"))
        known = stored(known, "places-of-lines", target)
    judged = lines.join(known, ["id", "more"]).withColumn("_equal", place != F.col("_first"))
    repeat = F.col("_equal") | F.col("_like")
    return judged.groupBy("_key", "_hash").agg(
        F.count_distinct("_line").alias("n_lines"),
        F.count_distinct(F.when(F.col("_equal"), F.col("_line"))).alias("n_equal"),
        F.count_distinct(F.when(~F.col("_equal") & F.col("_like"), F.col("_line"))).alias("n_near"),
        F.sort_array(F.collect_set(F.when(repeat, F.col("_line")))).alias("_dropped"),
        (F.coalesce(F.sum(F.when(repeat, F.col("_size"))), F.lit(0)) / F.sum("_size")).alias("_share"),
    )


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", whole: float = 1.0) -> DataFrame:
    """The rows of ``docs`` with their repeated lines taken out of the text. Rows of whose
    lines' bytes a share of ``whole`` or more are repeats go; rows without lines (null, empty or
    blank) stay as they are."""
    found = repeats(docs, key, text).where(F.size("_dropped") > 0)
    named = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(c).alias(n) for c, n in named.items()), F.xxhash64(text).alias("_text_hash"))
    own_key, own_text = F.col(named[key]), F.col(named[text])
    joined = rows.join(found, own_key.cast("long").eqNullSafe(F.col("_key")) & (F.col("_text_hash") == F.col("_hash")), "left")
    kept = F.array_join(F.filter(F.split(own_text, "\n"), lambda _, i: ~F.array_contains("_dropped", i)), "\n")
    left = joined.where(F.col("_dropped").isNull() | (F.col("_share") < whole))
    new = F.when(F.col("_dropped").isNull(), own_text).otherwise(kept)
    return left.select(*(new.alias(c) if c == text else F.col(n).alias(c) for c, n in named.items()))
