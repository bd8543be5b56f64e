"""N-gram Jaccard join: which documents share most of their word shingles.

Every document is the set of its five-word shingles, as 64-bit hashes. Equal sets are one
class from the start. Two classes at 80 % or more have a shingle in common among the first
20 % of each in any fixed order (prefix filter), and with up to three more in the prefix as many
more in common. The order here puts rare shingles first; it
comes from a table of fixed size with the logarithm of shingles' counts, and any such table
gives the same result, only the number of candidates differs.

Classes that have enough prefix shingles in common are candidates: as pairs where few have one, as a
star where many do, so that no shingle makes more rows than there are classes that have it
times a constant. A pair is made where the sizes, of which a class's number tells the magnitude,
allow it; it counts if it has been made by enough shingles, as chance ones (which grow with the square
of the corpus) seldom are. A task that meets many hands on its star's center alone, which from then on
represents the others: whatever meets it is in the star too, whatever else they share. Pairs must also pass a bound from
parity sketches: sets of so many unequal bits differ in at least as many shingles. It says
nothing of sets that are represented, so edges of stars needn't pass. The components of the candidates hold every link.
Each component's sets go to a trie: ordered by how many of them have a shingle, common ones
first, similar sets share most of their path. A set is joined with all others by one
traversal that computes overlaps along shared paths once and leaves subtrees whose remaining
lengths cannot reach the similarity any more. Components too large for a task are cut in
chunks that share one set; only what is not connected with that set meets all chunks. What goes
to a component's task are compressed texts, which are a third of their sets' bytes, once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.tables import lean, scratch, shared_dir, stored, text_bytes

WORDS = 5
#: Similarity as a fraction: 80 / 100.
PART, WHOLE = 4, 5
#: Slots of the count table and of the filter on candidates: fixed, whatever the input.
COUNT_SLOTS = 1 << 20
FILTER_BITS = 1 << 22
BITMAP = 1 << 15
#: A shingle that so many are known to have stands behind all rarer ones.
COMMON = 4
#: A class's number ends with the logarithm of its size, in bits of this mask. Linked sets have a
#: ratio below this base, so theirs differ by 1 at most.
MAGNITUDE = 127
MAGNITUDE_BITS = 7
MAGNITUDE_BASE = 1.26
#: From these magnitudes on (51, 102 and 162 shingles), linked sets must share one prefix shingle more.
MORE_SHARED = (17, 20, 22)
#: A prefix shingle of so many classes gives all pairs of them; of more, a star.
MOST_PAIRED = 32
#: Shingles held at once by a task that looks for repeated ones, and in a chunk of sets; and
#: sets in a chunk.
HELD = 1_500_000
CHUNK = 2_000_000
CHUNK_SETS = 2_000
#: Sets that a task remembers as done; beyond it the memory starts afresh.
REMEMBERED = 500_000

# Shingles

MULTIPLIER = 0x9E3779B97F4A7C15 | 5
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
_powers = {m: np.ones(1, np.uint64) for m in (MULTIPLIER, INVERSE)}


def powers(m: int, n: int) -> np.ndarray:
    if len(_powers[m]) < n:
        steps = np.full(max(n, 1 << 17), m, np.uint64)
        steps[0] = 1
        _powers[m] = np.cumprod(steps)
    return _powers[m][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def shingles(raw: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles: A-Z in lower case, words between ASCII
    white space. Fewer words than ``words`` are one shingle; no words, none."""
    found = raw.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    text = np.frombuffer(b" ".join(found), np.uint8)
    spaces = np.flatnonzero(text == 32)
    take = max(1, len(found) - words + 1)
    starts = np.concatenate([[0], spaces + 1])[:take]
    ends = np.concatenate([spaces, [len(text)]])[min(words, len(found)) - 1 :][:take]
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers(MULTIPLIER, len(text)), out=sums[1:])
    return np.unique(mixed((sums[ends] - sums[starts]) * powers(INVERSE, len(text))[starts]))


def class_of(found: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set, whose last bits are the set's magnitude. The size is
    hashed with it."""
    import xxhash

    return xxhash.xxh3_64_intdigest(found.tobytes(), seed=len(found)) - (1 << 63) & ~MAGNITUDE | magnitude(len(found))


def magnitude(n: int) -> int:
    return min(MAGNITUDE, int(math.log(n) / math.log(MAGNITUDE_BASE)))


def least_shared(n: int) -> int:
    """How many prefix shingles a set of n has in common at least with linked ones that are larger."""
    return 1 + sum(magnitude(n) >= m for m in MORE_SHARED)


def prefix_length(n: int) -> int:
    """Of sets that have t shingles in common, the first k of these are among the first n - t + k."""
    return n - (PART * n + WHOLE - 1) // WHOLE + least_shared(n)


def sketch(found: np.ndarray) -> bytes:
    """For each slot the parity of the shingles in it, with about a slot for each."""
    slots = max(64, 1 << (len(found) - 1).bit_length())
    return np.packbits(np.bincount((found & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1).tobytes()


def may_link(n: int, a: bytes, m: int, b: bytes) -> bool:
    """Whether sizes and sketches leave it open that two sets are linked: at most a share of
    (WHOLE - PART) / (WHOLE + PART) of their shingles is in one of them only."""
    if WHOLE * n < PART * m or WHOLE * m < PART * n:
        return False
    x, y = (np.frombuffer(s, np.uint8) for s in sorted((a, b), key=len))
    while len(y) > len(x):  # as if made with half the slots
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (WHOLE + PART) * int(np.bitwise_count(x ^ y).sum()) <= (WHOLE - PART) * (n + m)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


# Passes over the texts


def counted(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """kind 0: key, class, size, sketch and hash of the text of each document (class and sketch
    null without shingles). kind 1: shingles that a task met more than once, with how often,
    sets counted once."""

    def rows(kind: int, a, b, c, d, text_hash=None) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), a, b, c, d, pa.nulls(n, pa.int64()) if text_hash is None else text_hash], names=["kind", "a", "b", "c", "sketch", "text_hash"])

    def repeated(held: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        some = n > 1
        return rows(1, signed(found[some]), pa.array(n[some], pa.int64()), pa.nulls(int(some.sum()), pa.int64()), pa.nulls(int(some.sum()), pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, met = [], 0, set()
        for batch in batches:
            classes, sizes, sketches = [], [], []
            for raw in batch.column(2):
                found = shingles(raw.as_py(), words)
                classes.append(class_of(found) if len(found) else None)
                sizes.append(len(found))
                sketches.append(sketch(found) if len(found) else None)
                if len(found) and classes[-1] not in met:
                    met.add(classes[-1])
                    held.append(found)
                    size += len(found)
                if size >= HELD:
                    yield repeated(held)
                    held, size, met = [], 0, set()
            yield rows(0, batch.column(0), pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), batch.column(1))
        if held:
            yield repeated(held)

    named = text_bytes(docs, F.col(key).cast("long").alias("_key"), F.xxhash64(text).alias("_hash"), text=text)
    return named.mapInArrow(lean(run), "kind int, a long, b long, c long, sketch binary, text_hash long")


def count_table(repeated: DataFrame) -> np.ndarray:
    """For each slot the logarithm of the largest count of its shingles: COUNT_SLOTS bytes."""
    common = repeated.groupBy("a").agg(F.sum("b").alias("n")).where(F.col("n") >= COMMON)
    slots = common.groupBy(F.col("a").bitwiseAND(COUNT_SLOTS - 1).cast("int").alias("slot")).agg(F.max(F.floor(F.log2("n"))).cast("int").alias("log"))
    out = np.zeros(COUNT_SLOTS, np.uint8)
    found = slots.toPandas()
    out[found["slot"].to_numpy()] = found["log"].to_numpy()
    return out


def candidates(docs: DataFrame, table: np.ndarray, key: str, text: str, words: int) -> DataFrame:
    """Edges (a, b, star, n) between classes that have n prefix shingles in common, in several rows
    for one pair. Those of a star stand for all pairs of the classes that they connect."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    mask = np.uint64(COUNT_SLOTS - 1)

    def rows(edge: bool, a: np.ndarray, b: np.ndarray, center: bool = False) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), edge)), pa.array(a), pa.array(b), pa.array(np.full(len(a), center))], names=["edge", "a", "b", "center"])

    def dealt(tokens: np.ndarray, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A row for each shingle and class; of shingles with many classes, a star of them
        and a row for its center."""
        by = np.lexsort((classes, tokens))
        tokens, classes = tokens[by], classes[by]
        first, size = runs(tokens)
        many = np.repeat(size > MOST_PAIRED, size)
        center = np.repeat(classes[first], size)
        yield rows(False, tokens[~many], classes[~many])
        yield rows(False, tokens[first][size > MOST_PAIRED], classes[first][size > MOST_PAIRED], True)
        if many.any():
            pairs = np.unique(np.stack([classes, center], 1)[many & (classes != center)], axis=0)
            yield rows(True, pairs[:, 0], pairs[:, 1])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, met, held, owners, size = shared.value, set(), [], [], 0
        for batch in batches:
            for raw in batch.column(0):
                found = shingles(raw.as_py(), words)
                if not len(found) or (c := class_of(found)) in met:
                    continue
                met.add(c)
                weight = logs[(found & mask).astype(np.int64)]
                if weight.any():
                    found = found[np.argsort(weight, kind="stable")]
                held.append(found[: prefix_length(len(found))])
                owners.append(np.full(len(held[-1]), c, np.int64))
                size += len(held[-1])
                if size >= HELD:
                    yield from dealt(np.concatenate(held).view(np.int64), np.concatenate(owners))
                    met, held, owners, size = set(), [], [], 0
        if held:
            yield from dealt(np.concatenate(held).view(np.int64), np.concatenate(owners))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a shingle follow each other. Those of the last one wait for more, as
        long as they are few enough to be paired; then their first is its star's center."""
        token, waiting, center = None, (np.zeros(0, np.int64), np.zeros(0, bool)), None
        for batch in batches:
            edge, a, b, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            yield edges(a[edge], b[edge], True)
            a, b, c = a[~edge], b[~edge], c[~edge]
            if not len(a):
                continue
            if token is not None and len(waiting[0]):
                a, b, c = np.concatenate([np.full(len(waiting[0]), token), a]), np.concatenate([waiting[0], b]), np.concatenate([waiting[1], c])
            elif center is not None:
                go_on = a == token
                more = np.unique(b[go_on])
                yield edges(more[more != center], np.full(int((more != center).sum()), center), True)
                a, b, c = a[~go_on], b[~go_on], c[~go_on]
                if not len(a):
                    continue
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))  # the same class from two tasks
            a, b, c = a[new], b[new], np.logical_or.reduceat(c, new)
            first, size = runs(a)
            token, center, waiting = a[-1], None, (b[:0], c[:0])
            if size[-1] <= MOST_PAIRED:
                waiting, end = (b[first[-1] :], c[first[-1] :]), len(first) - 1
            else:
                center, end = b[first[-1]], len(first)
            yield from joined(b, c, first[:end], size[:end])
        if len(waiting[0]) > 1:
            yield from joined(*waiting, np.array([0]), np.array([len(waiting[0])]))

    rowed = text_bytes(docs, text=text).mapInArrow(lean(local), "edge boolean, a long, b long, center boolean")
    return rowed.repartition("a").sortWithinPartitions("edge", "a", "b").mapInArrow(lean(across), "a long, b long, star boolean, n long")


def enough_shared(edges: DataFrame) -> DataFrame:
    """Distinct (a, b, star) of stars, and of pairs that have as many prefix shingles in common as
    linked sets do at least. Linked sets that share one with a star are connected by that."""
    size = F.least(*(F.col(x).bitwiseAND(MAGNITUDE) for x in "ab"))
    least = sum(((size >= m).cast("int") for m in MORE_SHARED), F.lit(1))
    return edges.groupBy("a", "b", "star").agg(F.sum("n").alias("_n")).where(F.col("star") | (F.col("_n") >= least)).select("a", "b", "star")


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of equal values."""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(x)))


def edges(a: np.ndarray, b: np.ndarray, star: bool, n: np.ndarray | None = None) -> pa.RecordBatch:
    n = np.ones(len(a), np.int64) if n is None else n
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), star)), pa.array(n, pa.int64())], names=["a", "b", "star", "n"])


def joined(b: np.ndarray, center: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Edges of runs of classes: pairs of the short ones if sizes allow them, stars of the others and
    of those in which a class is the center of a task's star. A pair's bounds don't hold for a
    center, as it stands for classes that are not here."""
    pairs, centers = [], np.append(0, np.cumsum(center))
    starred = (size > MOST_PAIRED) | (centers[first + size] > centers[first])
    for n in np.unique(size):
        at = first[(size == n) & ~starred]
        if n > 1 and len(at):
            i, j = np.triu_indices(n, 1)
            some = np.stack([b[at[:, None] + i].ravel(), b[at[:, None] + j].ravel()], 1)
            size_log = some & MAGNITUDE
            pairs.append(some[np.abs(size_log[:, 0] - size_log[:, 1]) <= 1])
        at = first[(size == n) & starred]
        if n > 1 and len(at):
            rest = at[:, None] + np.arange(1, n)
            yield edges(b[rest].ravel(), np.repeat(b[at], n - 1), True)
    if pairs:
        found, times = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
        yield edges(found[:, 0], found[:, 1], False, times)


def passing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow to be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may_link(*row) for row in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one, two = (classes.select(F.col("node").alias(x), F.col("n").alias(f"_n{x}"), F.col("sketch").alias(f"_s{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "_na", "_sa", "_nb", "_sb").mapInArrow(lean(run), "a long, b long")


def candidate_filter(groups: DataFrame, skip: int = 0) -> np.ndarray:
    """A bit for each slot that a class of ``groups`` falls in: FILTER_BITS bits. The last
    ``skip`` bits of a class's number are left out."""
    slot = F.shiftright("node", skip).bitwiseAND(FILTER_BITS - 1)
    maps = groups.groupBy(F.floor(slot / BITMAP).alias("at")).agg(F.bitmap_construct_agg(slot % BITMAP).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in maps.collect():
        out[row["at"] * (BITMAP // 8) :][: BITMAP // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out


def candidate_texts(docs: DataFrame, bits: np.ndarray, text: str, words: int) -> DataFrame:
    """node and compressed text (packed) of the classes that pass the filter, once or few times a task."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in batches:
            out = []
            for raw in batch.column(0):
                found = shingles(raw.as_py(), words)
                if not len(found) or (c := class_of(found)) in met:
                    continue
                slot = c >> MAGNITUDE_BITS & FILTER_BITS - 1
                if shared.value[slot >> 3] >> (slot & 7) & 1:
                    met.add(c)
                    out.append((c, zlib.compress(raw.as_py().lower(), 1)))
            if len(met) >= REMEMBERED:
                met.clear()
            if out:
                c, packed = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(packed, pa.binary())], names=["node", "packed"])

    return text_bytes(docs, text=text).mapInArrow(lean(run), "node long, packed binary")


# The trie


class Node:
    __slots__ = ("children", "deep", "doc", "high", "here", "low", "start", "stop")

    def __init__(self, doc: int, start: int, stop: int):
        self.doc, self.start, self.stop = doc, start, stop  # its path is a stretch of this set
        self.children: list[Node] = []
        self.here: list[int] = []  # sets that end here
        self.low = self.high = self.deep = 0  # sizes of sets below, and the longest path


def build(paths: list[np.ndarray], sizes: list[int]) -> Node:
    """A trie with unbranched stretches as single nodes."""
    root = Node(0, 0, 0)
    stack, before = [root], None
    for k in sorted(range(len(paths)), key=lambda i: paths[i].astype(">u4").tobytes()):
        path, shared = paths[k], 0
        if before is not None:
            m = min(len(before), len(path))
            off = np.flatnonzero(before[:m] != path[:m])
            shared = int(off[0]) if len(off) else m
        last = None
        while stack[-1].stop > shared:
            last = stack.pop()
        if stack[-1].stop < shared:
            middle = Node(last.doc, last.start, shared)
            stack[-1].children[-1], middle.children, last.start = middle, [last], shared
            stack.append(middle)
        if len(path) > shared:
            leaf = Node(k, shared, len(path))
            stack[-1].children.append(leaf)
            stack.append(leaf)
        stack[-1].here.append(k)
        before = path
    order = [root]
    for node in order:
        order += node.children
    for node in reversed(order):
        own = [sizes[k] for k in node.here]
        node.low = min(own + [c.low for c in node.children], default=0)
        node.high = max(own + [c.high for c in node.children], default=0)
        node.deep = max([node.stop] + [c.deep for c in node.children])
    return root


def linked(n: int, m: int, common: int) -> bool:
    """common / (n + m - common) >= PART / WHOLE"""
    return (PART + WHOLE) * common >= PART * (n + m)


def probe(root: Node, paths: list[np.ndarray], sizes: list[int], x: int, marks: np.ndarray) -> Iterator[int]:
    """The sets that set ``x`` is linked with."""
    mine, n = paths[x], sizes[x]
    marks[mine] = True
    waiting = [(root, 0)]
    while waiting:
        node, common = waiting.pop()
        if WHOLE * node.high < PART * n or PART * node.low > WHOLE * n:
            continue
        left = len(mine)
        if node.stop > node.start:
            stretch = paths[node.doc][node.start : node.stop]
            common += int(np.count_nonzero(marks[stretch]))
            left -= int(np.searchsorted(mine, stretch[-1], "right"))
        if not linked(n, node.low, common + min(left, node.deep - node.stop)):
            continue
        for y in node.here:
            if y != x and linked(n, sizes[y], common):
                yield y
        waiting += [(c, common) for c in node.children]
    marks[mine] = False


def trie_links(sets: list[np.ndarray], labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs of positions that connect the sets as all links do, and are links. Sets with
    the same label are known to be connected. Once all are, no more traversal is needed."""
    sizes = [len(s) for s in sets]
    ids, inverse, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(-n, kind="stable")] = np.arange(len(ids))
    shared = int((n > 1).sum())  # what only one set has is in no overlap
    ranks = rank[inverse]
    cuts = np.cumsum([0, *sizes])
    paths = [np.sort(r[r < shared]) for r in (ranks[a:b] for a, b in zip(cuts, cuts[1:], strict=False))]
    root, marks = build(paths, sizes), np.zeros(shared + 1, bool)
    first: dict[int, int] = {}
    parent = [first.setdefault(label, i) for i, label in enumerate(labels or range(len(sets)))]
    left, out = len(first), []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for x in range(len(sets)):
        if left == 1:
            break
        for y in probe(root, paths, sizes, x, marks):
            a, b = find(x), find(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                left -= 1
                out.append((x, y))
    return out


BLOCK = ["root", "i", "j", "node", "label"]


def block_links(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Links of each block of rows (BLOCK and packed) that follow each other."""
    block, nodes, labels, sets = None, [], [], []

    def links() -> pa.RecordBatch:
        pairs = trie_links(sets, labels) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([nodes[p[i]] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        for root, i, j, node, label, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (root, i, j) != block:
                if sets:
                    yield links()
                block, nodes, labels, sets = (root, i, j), [], [], []
            if not nodes or nodes[-1] != node:
                nodes.append(node)
                labels.append(label)
                sets.append(shingles(zlib.decompress(raw), words))
    if sets:
        yield links()


def linked_blocks(docs: DataFrame, rows: DataFrame, text: str, words: int) -> DataFrame:
    """Links of the classes of each block (rows of BLOCK), whose texts are among ``docs``."""
    texts = candidate_texts(docs, candidate_filter(rows, MAGNITUDE_BITS), text, words)
    dealt = texts.join(rows.select(*BLOCK), "node").select(*BLOCK, "packed").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    return dealt.mapInArrow(lean(lambda batches: block_links(batches, words)), "a long, b long")


def chunks(sets: DataFrame, name: str) -> DataFrame:
    """For each component, the number of chunks that its sets need."""
    return sets.groupBy("root").agg(F.ceil(F.greatest(F.sum("n") / CHUNK, F.count("*") / CHUNK_SETS)).cast("int").alias(name))


def all_links(docs: DataFrame, groups: DataFrame, text: str, words: int) -> DataFrame:
    """Links (a, b) that connect the classes (node, n, root: the smallest node of its component
    of candidates) as all links do.

    A component of several chunks is first linked chunk by chunk, its smallest set being in
    all of them. Only sets that are not connected with that one then meet all chunks. So a
    family of near copies costs in proportion to its size, unless few resemble one of them.
    """
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    sized = stored(groups.join(chunks(groups, "_k"), "root"), "sized")
    places = F.when((F.col("_k") > 1) & (F.col("node") == F.col("root")), each("_k")).otherwise(F.array(part("_k")))
    first = sized.select("node", "root", F.col("node").alias("label"), F.explode(places).alias("i")).withColumn("j", F.col("i"))
    links = stored(linked_blocks(docs, stored(first, "blocks"), text, words), "links")
    if not sized.where("_k > 1").limit(1).count():
        return links
    labels = components(links).select("node", F.col("root").alias("label"))
    large = stored(sized.where("_k > 1").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "large-components")
    rest = large.where("label <> root")
    few = chunks(rest, "_u")
    them = rest.join(few, "root").withColumn("i", part("_u")).withColumn("j", F.explode(each("_k")))
    every = large.join(few, "root").withColumn("j", part("_k")).withColumn("i", F.explode(each("_u")))
    more = stored(them.select(*BLOCK).unionByName(every.select(*BLOCK)), "more-blocks")
    return links.unionByName(stored(linked_blocks(docs, more, text, words), "more-links"))


# The join


def grouped(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """_key, _hash (of the text), n_shingles and root, the least class of the row's component
    (null without shingles), for every row."""
    spark = docs.sparkSession
    placed = shared_dir(spark, "placed")
    with scratch(spark):
        first = stored(counted(docs, key, text, words), "sets")
        rows = first.where("kind = 0").select(F.col("a").alias("_key"), F.col("text_hash").alias("_hash"), F.col("b").alias("node"), F.col("c").alias("n_shingles"))
        classes = first.where("kind = 0 and b is not null").select(F.col("b").alias("node"), F.col("c").alias("n"), "sketch").dropDuplicates(["node"])
        table = count_table(first.where("kind = 1"))
        found = stored(enough_shared(candidates(docs, table, key, text, words)), "candidates")
        near_pairs = passing(found.where(~F.col("star")).select("a", "b"), classes)
        edges = stored(near_pairs.unionByName(found.where("star").select("a", "b")), "edges")
        near = components(edges)
        nodes = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct())
        groups = stored(nodes.join(classes.select("node", "n"), "node"), "groups")
        roots = stored(components(all_links(docs, groups, text, words)), "roots")
        return stored(rows.join(roots, "node", "left").select("_key", "_hash", "n_shingles", F.coalesce("root", "node").alias("root")), "placed", placed)


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``key``, n_shingles and component_id, the smallest key that links lead to, for every
    row. Texts that are null or have no words have no shingles and are linked with nothing;
    equal texts are always linked. Rows with a null key or the same key as another are rows
    like others (a null is no component's smallest unless alone). An integer key is needed;
    other columns are not read. Very long texts are sets like others, whole."""
    placed = grouped(docs, key, text, words)
    least = stored(placed.where("root is not null").groupBy("root").agg(F.min("_key").alias("_least")), "smallest")
    out = placed.join(least, "root", "left")
    return out.select(F.col("_key").alias(key), "n_shingles", F.coalesce("_least", "_key").alias("component_id"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """_key, _hash (of the text: F.xxhash64) and _rows of one document of each component, the
    one with the smallest key (null last), then hash, and of each without shingles. Rows alike in
    both are one document, and _rows is how many there are."""
    placed = grouped(docs, key, text, words)
    same = placed.groupBy("root", "_key", "_hash").agg(F.count("*").alias("_rows"))
    row = F.struct(F.col("_key").isNull().alias("no"), "_key", "_hash", "_rows")
    best = same.where("root is not null").groupBy("root").agg(F.min(row).alias("b")).select("b._key", "b._hash", "b._rows")
    return stored(best.unionByName(same.where("root is null").select("_key", "_hash", "_rows")), "representatives")


def surplus(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """_key, _hash (of the text: F.xxhash64) and _rows of the documents that aren't representatives
    (_rows is 0), and of those that are, but several rows alike in both (_rows is how many)."""
    placed = grouped(docs, key, text, words)
    same = stored(placed.groupBy("root", "_key", "_hash").agg(F.count("*").alias("_rows")), "documents")
    row = F.struct(F.col("_key").isNull().alias("no"), "_key", "_hash")
    best = same.where("root is not null").groupBy("root").agg(F.min(row).alias("b"))
    stays = F.col("_key").eqNullSafe(F.col("b._key")) & (F.col("_hash") == F.col("b._hash"))
    judged = same.where("root is not null").join(best, "root").select("_key", "_hash", F.when(stays, F.col("_rows")).otherwise(0).alias("_rows"))
    return stored(judged.unionByName(same.where("root is null").select("_key", "_hash", "_rows")).where("_rows <> 1"), "surplus")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+'), lambda x: x <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT r.a AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r.b) AS component_id
FROM reach r LEFT JOIN sizes ON sizes.doc_id = r.a
GROUP BY r.a
"""
