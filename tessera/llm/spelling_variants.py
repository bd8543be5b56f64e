"""Spelling variants: words one edit from a much more frequent word are its variants.

Words within one inserted, deleted or replaced character are found by an errata trie. In the
trie of all words each node's heavy child is the one below which most words are; any other
child, and a word's end, is light. Two words one edit apart part at one node. There the light
one of them (both, maybe) is entered again with one character changed, in the place of the
heavy one:

* replaced: with the heavy character instead of its own; it meets that word itself. Light ones
  with any character there meet each other under the same rest;
* skipped: without its own character;
* with the heavy character before its own, which is where the heavy word has one more.

Terminals that coincide are pairs, and each pair coincides once: where a run of equal
characters could lose any of them, it is the last. A word of a trie of n words is in at most
log2(n) light subtrees, so it is entered that many times, however long it is.

Nodes are known by 64-bit hashes of prefixes. Any choice of a node's heavy child gives the
same pairs, if it is one choice for all, so equal hashes cost time and change no result. Words
meet as whole strings. Light ones under one rest differ in one character, so there are fewer
of them than letters: they are counted and their two most frequent handed back, no pairs.

* Null and empty texts have no words. A null key is an empty one in the hash.
* Very long runs are words like others; the changed copies of one are few (see above).
* Repeated rows count as often as they stand. Ties of frequency go to the smaller word in
  code-point order. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.jaccard_join import MULTIPLIER, mixed, powers
from tessera.llm.tables import decoded, lean, scratch, shared_dir, stored

RUN = re.compile("[a-zÀ-ÿ]+")
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: Of the runs, one in so many loses a character (a planted slip of the pen).
SLIP = 97
#: A form has so many times the variant's count.
TIMES = 2
#: Different runs that a task counts before it hands counts on.
COUNTED = 300_000
#: Characters whose prefixes are hashed at once.
PORTION = 1 << 20

# Words


def slipped(key: str, run: str, slip: int) -> str:
    """The run, or, where the hash of key and run says so, the run without one character."""
    h = zlib.crc32(f"{key}:{run}".encode())
    if h % slip:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int = SLIP, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of so many characters that occur so often. Counted in tasks first."""
    own = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.col(text).cast("binary").alias("_text")).where("_text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, int] = {}

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                head = zlib.crc32(f"{key}:".encode())
                mine: dict[str, int] = {}
                for x in RUN.findall(decoded(raw.as_py().lower())):  # bytes.lower() changes A-Z alone
                    mine[x] = mine.get(x, 0) + 1
                for x, k in mine.items():
                    if zlib.crc32(x.encode(), head) % slip == 0:
                        x = slipped(key, x, slip)
                    if len(x) >= least_length:
                        n[x] = n.get(x, 0) + k
                if len(n) >= COUNTED:
                    yield counted()
                    n.clear()
        yield counted()

    return own.mapInArrow(lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# The trie


def prefix_rows(ids: list[int], said: list[str]) -> pa.RecordBatch:
    """(node, next, id, at): each place of each word, the hash of what stands before it and
    the character there; null at the end."""
    codes = np.frombuffer("".join(said).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.array([len(x) for x in said], np.int64)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - np.repeat(starts, sizes)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mixed(codes + np.uint64(1)) * powers(MULTIPLIER, int(sizes.max()))[place], out=sums[1:])
    depth = np.concatenate([place, sizes])  # each character's, then each end's
    at = np.concatenate([np.arange(len(codes)), starts + sizes])
    node = mixed((sums[at] - sums[at - depth]) ^ mixed(depth.astype(np.uint64)))
    letter = np.concatenate([codes.astype(np.int32), np.zeros(len(said), np.int32)])
    owner = np.array(ids, np.int64)
    owner = np.concatenate([np.repeat(owner, sizes), owner])
    arrays = [pa.array(node.view(np.int64)), pa.array(letter, mask=np.arange(len(at)) >= len(codes)), pa.array(owner), pa.array(depth.astype(np.int32))]
    return pa.RecordBatch.from_arrays(arrays, names=["node", "next", "id", "at"])


def places(lexicon: DataFrame) -> DataFrame:
    """Where each word's characters, and its end, are in the trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, said, size = [], [], 0
            for i, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(i)
                said.append(x)
                size += len(x)
                if size >= PORTION:
                    yield prefix_rows(ids, said)
                    ids, said, size = [], [], 0
            if said:
                yield prefix_rows(ids, said)

    return lexicon.select("id", "word").mapInArrow(lean(run), "node long, next int, id long, at int")


def heavy_children(lexicon: DataFrame) -> DataFrame:
    """(node, heavy) of the nodes that have a child and something else besides."""
    children = places(lexicon).groupBy("node", "next").agg(F.count("*").alias("_n"))
    heavy = F.max_by("next", F.when(F.col("next").isNotNull(), F.struct("_n", -F.col("next"))))
    return children.groupBy("node").agg(heavy.alias("heavy"), F.count("*").alias("_children")).where("_children > 1 and heavy is not null").select("node", "heavy")


def light_places(lexicon: DataFrame) -> DataFrame:
    """(word, n, at, heavy, inside): where a word leaves the heavy path, what that path has
    there, and whether the word goes on. The heavy children are written first, so that Spark can
    split the rows of a node that most words pass."""
    left = places(lexicon).join(stored(heavy_children(lexicon), "heavy"), "node").where("not next <=> heavy")
    return left.select("id", "at", F.chr("heavy").alias("heavy"), F.col("next").isNotNull().alias("inside")).join(lexicon, "id").drop("id")


# Pairs


def head() -> Column:
    """What stands before the place."""
    return F.substring("word", F.lit(1), F.col("at"))


def rest(n: int) -> Column:
    """What stands n characters after the place."""
    return F.substring("word", F.col("at") + (1 + n), F.length("word"))


def probes(light: DataFrame) -> DataFrame:
    """(word, n, near): the changed copies that may be words: with the heavy character instead,
    without one, and with the heavy character before."""
    last = F.substring("word", F.col("at") + 1, F.lit(1)) != F.substring("word", F.col("at") + 2, F.lit(1))
    changed = [
        F.when(F.col("inside"), F.concat(head(), "heavy", rest(1))),
        F.when(F.col("inside") & last, F.concat(head(), rest(1))),
        F.concat(head(), "heavy", rest(0)),
    ]
    return light.select("word", "n", F.explode(F.array(*changed)).alias("near")).where("near is not null")


def links(lexicon: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words are one edit from each, and of those the one with the
    largest n, then the smallest."""
    light = stored(light_places(lexicon), "light")
    by = lambda n, word: F.struct((-F.col(n)).alias("n"), F.col(word).alias("word"))
    met = probes(light).join(lexicon.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    sides = F.array(F.struct("word", by("near_n", "near").alias("best")), F.struct(F.col("near").alias("word"), by("n", "word").alias("best")))
    met = met.select(F.explode(sides).alias("_s")).select("_s.*", F.lit(1).cast("long").alias("k"))
    groups = light.where("inside").groupBy(head().alias("before"), rest(1).alias("after"))
    groups = groups.agg(F.sort_array(F.collect_list(by("n", "word"))).alias("all")).where("size(all) > 1")  # one for each letter at most
    beside = groups.select(F.explode("all").alias("me"), (F.size("all") - 1).cast("long").alias("k"), F.col("all")[0].alias("one"), F.col("all")[1].alias("two"))
    beside = beside.select(F.col("me.word").alias("word"), F.when(F.col("me") == F.col("one"), F.col("two")).otherwise(F.col("one")).alias("best"), "k")
    return met.unionByName(beside).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): where following forms ends. Counts at least double along
    a form, so chains are short, and each round halves what is left of them."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not now.join(step, "root", "left_semi").limit(1).count():
            return now
        now = stored(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int = SLIP, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word; written to the shared folder."""
    spark = docs.sparkSession
    out = shared_dir(spark, "variants")
    with scratch(spark):
        lexicon = stored(words(docs, key, text, slip).withColumn("id", F.monotonically_increasing_id()), "words")
        found = lexicon.join(links(lexicon), "word", "left")
        is_form = -F.col("best.n") >= times * F.col("n")
        found = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")), "forms")
        ends = roots(found.where("form is not null"))
        whole = found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return stored(whole, "variants", out)


def _crc32(bytes_: str) -> tuple[str, str]:
    """SQL for the CRC-32 of a list of bytes, and for its table, made bit by bit."""
    step = "case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    table = "range(0, 256)"
    for _ in range(8):
        table = f"list_transform({table}, lambda c: {step})"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {bytes_}), lambda c, b: xor(c >> 8, t[(xor(c & 255, b) + 1)::integer])))", f"select {table}::bigint[] as t"


def _sql() -> str:
    letter = "a-zÀ-ÿ"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    utf8 = "flatten(list_transform(string_split(doc_id::varchar || ':' || run, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [(192 + (unicode(c) >> 6))::bigint, (128 + (unicode(c) & 63))::bigint] end))"
    crc, table = _crc32(utf8)
    return f"""with recursive tab as ({table}),
runs as (select doc_id, run, count(*) as k from (select coalesce(doc_id::varchar, '') as doc_id, unnest(regexp_extract_all({lowered}, '[{letter}]+')) as run from documents) group by doc_id, run),
hashed as (select run, k, {crc} as h from runs, tab),
slips as (select case when h % {SLIP} = 0 then left(run, (h % length(run))::integer) || substr(run, (h % length(run) + 2)::integer) else run end as word, k from hashed),
lex as materialized (select word, sum(k)::bigint as n from slips where length(word) >= {LEAST_LENGTH} group by word having sum(k) >= {LEAST_COUNT}),
cut as materialized (select word, n, i, left(word, i::integer) as a, substr(word, (i + 2)::integer) as b from lex, range(0, length(word)) t(i)),
near as materialized (
  select x.word, y.word as other, y.n as other_n from cut x join cut y on x.a = y.a and x.b = y.b and x.word <> y.word
  union select x.word, y.word, y.n from (select distinct word, a || b as other from cut) x join lex y on x.other = y.word
  union select y.word, x.word, x.n from (select distinct word, n, a || b as other from cut) x join lex y on x.other = y.word),
best as (select word, count(*) as n_near, arg_min(other, (-other_n, other)) as other, arg_min(other_n, (-other_n, other)) as other_n from near group by word),
forms as materialized (select lex.word, n, coalesce(n_near, 0) as n_near, case when other_n >= {TIMES} * n then other end as form, case when other_n >= {TIMES} * n then other_n end as form_n from lex left join best using (word)),
follow as (select word, word as goal, 0 as d from forms union all select f.word, g.form, d + 1 from follow f join forms g on f.goal = g.word where g.form is not null)
select word, form, arg_max(goal, d) as root, n, n_near::bigint as n_near, form_n from forms join follow using (word) group by word, form, n, n_near, form_n"""


SQL = _sql()
