"""Operators that hold documents against each other, and the pipeline."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F
from tessera.llm import components, decontaminate, jaccard_join, line_dedup, queries

import corpus_pipeline
from tests.compare import assert_same
from tests.conftest import DATA

ODD = [(1, None), (2, ""), (3, " \n\t\n"), (4, "one two"), (5, "one  TWO"), (5, "one two"), (None, "one two")]
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, node long, _key long, _hash long, root long"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", 0, "c", 1, 2, 3, 4) for r in rows], EXTRA)


def words(r, n, of=400):
    return [f"w{r.randrange(of)}" for _ in range(n)]


def near_copies(seed, groups, size, length, edits):
    """Texts in groups, each a few words from the group's first."""
    r, out = random.Random(seed), []
    for _ in range(groups):
        first = words(r, length)
        for k in range(size):
            copy = list(first)
            for _ in range(k % (edits + 1)):
                copy[r.randrange(length)] = f"v{r.randrange(10**6)}"
            out.append(" ".join(copy))
    r.shuffle(out)
    return list(enumerate(out))


# Components


def test_components(spark):
    r = random.Random(4)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1200)] + [(7, 7)]
    found = {x.node: x.root for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert found == {x: find(x) for x in parent if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 9: n-gram Jaccard join


def brute_components(rows):
    sets = [jaccard_join.shingles((t or "").encode()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = set(sets[i].tolist()), set(sets[j].tolist())
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            parent[find(j)] = find(i)
    keys = {}
    for i, (key, _) in enumerate(rows):
        keys.setdefault(find(i), []).append(key)
    least = {g: min((k for k in some if k is not None), default=None) for g, some in keys.items()}
    return sorted(((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("paired", [2, 32])
def test_join_is_brute_force(spark, monkeypatch, paired):
    monkeypatch.setattr(jaccard_join, "MOST_PAIRED", paired)
    rows = near_copies(1, 8, 9, 60, 4) + [(k + 500, t) for k, t in near_copies(2, 3, 12, 9, 1)]
    common = "these words stand in very many of the texts at hand here"
    rows += [(k + 800, f"{common} {' '.join(words(random.Random(k), 3 + k % 30))}") for k in range(40)]
    rows += [(k + 900, t) for k, t in rows[:20]] + ODD + [(77_777, "x " * 20_000)]
    out = jaccard_join.join(docs(spark, rows).repartition(6))
    assert sorted(map(tuple, out.collect()), key=str) == brute_components(rows)


@pytest.mark.parametrize("outside", [1, 3])
def test_links_with_members_of_a_tasks_star(spark, outside):
    """One task has a base and 39 sets that are linked with it alone; so are the sets elsewhere.
    All that they have in common with it in their prefixes is the star's shingle."""
    base = " ".join(f"b{i}" for i in range(404))
    own = lambda k: f"{base} {' '.join(f'o{k}_{i}' for i in range(96))}"
    parts = [[(0, base), *((k, own(k)) for k in range(1, 40))], *([(100 + k, own(100 + k))] for k in range(outside))]
    rows = [x for part in parts for x in part]
    dealt = spark.createDataFrame(spark.sparkContext.parallelize(parts, len(parts)).flatMap(list), "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.join(dealt).collect()), key=str) == brute_components(rows)


@pytest.mark.parametrize(("shingles", "sets"), [(300, 250), (10**6, 4)])
def test_components_too_large_for_a_task(spark, monkeypatch, shingles, sets):
    monkeypatch.setattr(jaccard_join, "CHUNK", shingles)
    monkeypatch.setattr(jaccard_join, "CHUNK_SETS", sets)
    rows = near_copies(3, 2, 30, 50, 6)
    assert sorted(map(tuple, jaccard_join.join(docs(spark, rows)).collect()), key=str) == brute_components(rows)


def test_join_of_nothing(spark):
    assert jaccard_join.join(docs(spark, [])).count() == 0
    assert [tuple(r) for r in jaccard_join.join(docs(spark, [(1, None)])).collect()] == [(1, 0, 1)]


def test_join_is_its_sql(spark, duck):
    assert_same(queries.op9_jaccard_join(spark, DATA).toPandas(), duck.execute(jaccard_join.SQL).df())


def test_trie_finds_all_links():
    r = random.Random(8)
    for _ in range(60):
        base = [r.getrandbits(64) for _ in range(40)]
        sets = []
        for _ in range(12):
            s = {x for x in base[: r.choice((5, 20, 40))] if r.random() > 0.12} | {r.getrandbits(64) for _ in range(r.randrange(3))}
            sets.append(jaccard_join.np.array(sorted(s) or [1], jaccard_join.np.uint64))
        sizes, marks = [len(s) for s in sets], jaccard_join.np.zeros(2000, bool)
        ids = {x: i for i, x in enumerate(sorted({x for s in sets for x in s.tolist()}))}
        paths = [jaccard_join.np.array(sorted(ids[x] for x in s.tolist())) for s in sets]
        root = jaccard_join.build(paths, sizes)
        for x in range(12):
            expected = {y for y in range(12) if y != x and jaccard_join.linked(sizes[x], sizes[y], len(set(sets[x].tolist()) & set(sets[y].tolist())))}
            assert set(jaccard_join.probe(root, paths, sizes, x, marks)) == expected and not marks.any()
            assert all(jaccard_join.may_link(sizes[x], jaccard_join.sketch(sets[x]), sizes[y], jaccard_join.sketch(sets[y])) for y in expected)


# 6: line dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def edited(r, text, n):
    text = list(text)
    for _ in range(n):
        i, kind = r.randrange(len(text) + 1), r.random()
        if kind < 0.33 and text:
            text.pop(min(i, len(text) - 1))
        elif kind < 0.66:
            text.insert(i, r.choice("abcé日"))
        elif text:
            text[min(i, len(text) - 1)] = r.choice("abcé日")
    return "".join(text)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_banded_distance(k):
    r = random.Random(k)
    for _ in range(4000):
        a = "".join(r.choice("ab") for _ in range(r.randrange(14)))
        b = edited(r, a, r.randrange(5))
        assert line_dedup.within(a, b, k) == (distance(a, b) <= k)


def brute_repeats(rows):
    """For each document its lines, and which of them are equal or near to earlier ones: every
    line against every earlier one."""
    placed = [(key, n, line.decode()) for key, text in rows for n, line in enumerate(line_dedup.lines_of((text or "").encode())) if line]
    near, out = {}, {}
    for i, (key, n, line) in enumerate(placed):
        row = out.setdefault(key, [0, 0, 0, []])
        row[0] += 1
        before = {x for _, _, x in placed[:i]}
        if line in before:
            row[1] += 1
            row[3].append(n)
            continue
        for x in before:
            most = min(2, max(len(x), len(line)) // 10)
            if (x, line) not in near:
                near[x, line] = most > 0 and abs(len(x) - len(line)) <= most and distance(x, line) <= most
            if near[x, line]:
                row[2] += 1
                row[3].append(n)
                break
    return {k: tuple(v[:3]) + (v[3],) for k, v in out.items()}


def line_rows(seed, n):
    r = random.Random(seed)
    seeds = ["".join(r.choice("abcdefgh ") for _ in range(r.choice((3, 5, 8, 9, 10, 11, 12, 15, 17, 18, 19, 20, 21, 22, 23, 33, 60)))).strip() or "x" for _ in range(30)]
    return [(k, "\n".join(edited(r, r.choice(seeds), r.choice((0, 0, 1, 2, 3))) for _ in range(r.randrange(7)))) for k in range(n)]


@pytest.mark.parametrize("remembered", [2, 500_000])
def test_repeats_are_brute_force(spark, monkeypatch, remembered):
    monkeypatch.setattr(line_dedup, "REMEMBERED", remembered)
    rows = [*line_rows(6, 120), (1000, None), (1001, ""), (1002, " \n\n"), (1003, "é" * 600 + "\n" + "é" * 599), (1005, "ab" * 40_000), (1004, "x\r\nx\n x ")]
    found = {r._key: (r.n_lines, r.n_equal, r.n_near, r._dropped) for r in line_dedup.repeats(docs(spark, rows).repartition(5)).collect()}
    assert found == brute_repeats(rows)


@pytest.mark.parametrize("crowd", [0, 3])
def test_repeats_under_crowded_keys_are_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(line_dedup, "CROWDED", crowd)
    r, alike = random.Random(5), "A line that many others are nearly equal to, é日 and all, or not at all equal."
    rows = [*line_rows(7, 100), *((200 + k, f"{edited(r, alike, k % 5)}\nown {k}") for k in range(40)), (None, alike), (1003, "é" * 600 + "\n" + "é" * 599)]
    rows.sort(key=lambda row: row[0] or 0)
    found = {r._key: (r.n_lines, r.n_equal, r.n_near, r._dropped) for r in line_dedup.repeats(docs(spark, rows).repartition(5)).collect()}
    assert found == brute_repeats(rows)


def test_near_copies_make_rows_in_proportion(spark, monkeypatch):
    """No table on the way grows with the square of a group of nearly equal lines."""
    most, real = [0], line_dedup.stored

    def counted(*args):
        out = real(*args)
        most[0] = max(most[0], out.count())
        return out

    monkeypatch.setattr(line_dedup, "stored", counted)
    alike = "So long a line that two characters of it may be others and it is nearly the same"
    rows = [(k, alike[:8] + chr(97 + k % 26) + chr(97 + k // 26) + alike[10:]) for k in range(400)]
    found = line_dedup.repeats(docs(spark, rows)).agg(F.sum("n_near"), F.sum("n_equal")).first()
    assert tuple(found) == (399, 0) and most[0] <= 12 * len(rows)


def test_parities_of_trigrams_never_part_near_lines():
    r = random.Random(11)
    for _ in range(2000):
        a = "".join(r.choice("abc é日") for _ in range(r.randrange(9, 60)))
        b = edited(r, a, 2)
        off = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(line_dedup.trigram_parities(a), line_dedup.trigram_parities(b), strict=True))
        assert off <= 6 * line_dedup.EDITS


def test_links_of_a_chain_are_not_passed_on(spark):
    a, b, c = (f"{x} quick brown fox jumps over" for x in ("aaaa the", "bbaa the", "bbbb the"))
    found = {r._key: r._dropped for r in line_dedup.repeats(docs(spark, [(1, a), (2, c), (3, b)])).collect()}
    assert found == {1: [], 2: [], 3: [0]}
    found = {r._key: r._dropped for r in line_dedup.repeats(docs(spark, [(1, a), (2, b), (3, c)])).collect()}
    assert found == {1: [], 2: [0], 3: [0]}


def test_lines_that_share_half_a_hash(spark, monkeypatch):
    real = line_dedup.line_id
    monkeypatch.setattr(line_dedup, "line_id", lambda x: (len(x) % 2, real(x)[1]))
    rows = line_rows(9, 40)
    found = {r._key: (r.n_lines, r.n_equal, 0) for r in line_dedup.repeats(docs(spark, rows)).collect()}
    assert found == {k: (v[0], v[1], 0) for k, v in brute_repeats(rows).items()}


def test_documents_that_are_mostly_repeats(spark):
    long, rows = "The same long line stands in all of these documents, again and again.", []
    rows = [(1, long), (2, f"{long}\nown line"), (3, f"{long}\n{'own words ' * 5}"), (4, "alone"), (5, "")]
    assert {r.doc_id: r.text for r in line_dedup.dedup(docs(spark, rows), whole=0.8).collect()} == {1: long, 3: "own words " * 5, 4: "alone", 5: ""}


def test_dedup_keeps_columns_and_first_lines(spark):
    rows = [(1, "A line that is long enough.\nshort"), (2, "short\n\nA line that is long enough!\nown"), (3, "short"), (4, None), (5, ""), (6, "own"), (1, "A line that is long enough.\nshort"), (None, "own")]
    table = docs(spark, rows)
    out = line_dedup.dedup(table)
    assert out.columns == table.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, rows[0][1]), (1, rows[0][1]), (2, ""), (4, None), (5, ""), (None, "own")][:2] + [(4, None), (5, ""), (None, "own")], key=str)
    assert line_dedup.dedup(docs(spark, [])).count() == 0


# 5: decontamination

ITEM = "How many apples does Tom have if Anna gives Tom 12 kg of apples and then he eats 3 of them on the way home."


def test_reparameterised_items_are_caught(spark):
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too short"), (5, ITEM)], "item_id long, text string")
    same = ITEM.replace("Tom", "Bert").replace("Anna", "Clara").replace("12", "40").replace(" kg ", " pounds ")
    torn = ITEM.replace("does Tom", "does Bert").replace("12", "7")  # Tom is two people here
    rows = [(10, f"before that. {ITEM} after"), (11, f"Here. {same} End."), (12, f"Here. {torn} End."), (13, "Nothing of the kind stands in this text, which is clean."), *ODD, (14, ("and so on " * 5000) + ITEM), (10, ITEM), (None, ITEM)]
    table = docs(spark, [r if r[0] != 5 or r[1] != "one two" else r for r in rows])
    found = decontaminate.contaminated(table, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(k, i) for k in (10, 11, 14, None) for i in (1, 5)}
    assert all(r.n_slots >= 3 for r in found)


def test_shuffled_windows_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 0)
    assert [r.doc_id for r in decontaminate.contaminated(docs(spark, [(1, ITEM), (2, "x")]), items).collect()] == [1]


def test_items_of_mostly_placeholders_are_caught(spark):
    titled = "What Is The Largest City In The State Of Texas By Population Today And When Was It Founded"
    texts = [titled, titled.upper(), "Compute 12 + 7 - 3 + 45 / 9 - 2 + 8 * 6 - 1 + 30", "Convert 3 kg 40 g 7 lb 2 oz and 5 Tons to Pounds"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = [(k + 10 * n, f"{before}{t}. And more.") for n, before in enumerate(("", "So it was. ", "the Question, ", "A B ")) for k, t in enumerate(texts)]
    rows += [(90, texts[2].replace("45", "46").replace("7", "8").replace("6", "5")), (91, "The Smallest Town In The State Of Ohio By Area Now And When Was It Lost")]
    found = decontaminate.contaminated(docs(spark, rows), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in found if r.doc_id % 10 == r.item_id) == [(k + 10 * n, k) for n in range(4) for k in range(4)]
    assert all(r.doc_id < 90 and r.doc_id % 10 in {r.item_id, r.item_id ^ 1} for r in found)


def test_short_items_and_unspaced_scripts_are_caught(spark):
    texts = ["What is 17 times 23?", "中国的首都是哪里，它有多少人口，什么时候建立的？", "ประเทศไทยมีกี่จังหวัด", "東京タワーの高さ", "Please name the author of 1984", "Yes"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = [(k + 10 * n, f"{before}{t}{after}") for n, (before, after) in enumerate((("", ""), ("Before: ", " And after."), ("前の文。", "。次"))) for k, t in enumerate(texts)]
    rows += [(90, "What is 17 times 24?"), (91, "Please name the author of 2001"), (92, "中国的河流是哪些"), (93, "times 23 is 17 what")]
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, rows), items).collect()}
    assert found == {(k + 10 * n, k) for n in range(3) for k in range(6)} | {(91, 4)}


def test_one_inconsistent_slot_leaves_the_other_windows(spark):
    middle = "while the old farmer looks at all the fields and thinks about what his father once said to him under the tree by the river"
    item = f"A basket holds 2 apples and some pears {middle} and after waiting for 2 hours he walks back."
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item), (2, item.replace("2 apples", "3 apples").replace("2 hours", "5 hours")), (3, item.replace("2 hours", "7 hours"))]
    rows += [(4, f"Nothing. {middle[:30]}")]
    found = {r.doc_id: (r.n_windows, r.n_slots) for r in decontaminate.contaminated(docs(spark, rows), items).collect()}
    windows = found.pop(1)[0]
    assert set(found) == {2, 3} and all(windows / 2 <= n < windows and slots == 0 for n, slots in found.values())


def test_decontamination_of_nothing(spark):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert decontaminate.contaminated(docs(spark, []), items).count() == 0
    assert decontaminate.contaminated(docs(spark, [(1, ITEM)]), items.limit(0)).count() == 0


NUMERIC = "What is 12 + 35 * 4 - 9 / 3 + 18 * 2 - 7 + 41 in total?"
ALICE = "Alice has 15 apples and Mary Ann gives her twenty-two pears for 3 hours of work. How many pieces of fruit does Alice have now?"
SIX = "Where was Tom Brady born?"


def test_verbatim_items_are_always_found(spark, duck):
    """Whatever their words are and wherever they stand; re-parameterised ones where enough of
    their words aren't placeholders. By SQL as well."""
    texts = [NUMERIC, ALICE, SIX, "What is the capital of France?", "NATO", "7", ITEM, "the of and to a in is it you that", "Paris Berlin Rome Madrid Lisbon Oslo Vienna Prague Warsaw"]
    rows = [(k + 100 * n, f"{before}{t}{after}") for n, (before, after) in enumerate((("", ""), ("Quarterback ", " Brady"), ("12 kg ", " 3"), ("one ", " and"), ("So it goes.\n", "\nThen."))) for k, t in enumerate(texts)]
    renamed = [
        (901, ALICE.replace("Alice", "Bob").replace("15", "seven").replace("Mary Ann", "Tom").replace("twenty-two", "40").replace("hours", "days")),
        (902, ALICE.replace("Alice", "Tom Jones").replace("15", "3,000").replace("Mary Ann", "Eve")),
        (903, ALICE.replace("Alice", "Bob").replace("15", "seven").replace("Mary Ann", "Bob").replace("twenty-two", "40").replace("hours", "days")),  # two are one
        (904, "What is the capital of Spain?"),
        (905, NUMERIC.replace("12", "13").replace("9", "8").replace("* 2", "* 5")),
    ]
    rows += renamed + [(906, None), (907, "x y z " * 3000 + ALICE), (None, SIX)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    out = decontaminate.contaminated(docs(spark, rows), items).toPandas()
    found = {(r.doc_id, r.item_id) for r in out.itertuples()}
    assert {(k + 100 * n, k) for n in range(5) for k in range(len(texts))} <= found and (907, 1) in found
    assert {k for k, i in found if i == 1 and k > 900} == {901, 902, 907} and (904, 3) in found and (905, 0) not in found
    cursor = duck.cursor()
    these, those = docs(spark, rows).toPandas().astype({"doc_id": "Int64"}), items.toPandas()  # noqa: F841
    cursor.execute("create schema d; create table d.documents as select * from these; create table d.benchmark as select * from those; set schema = 'd'")
    assert_same(out.astype({"doc_id": "Int64"}), cursor.execute(decontaminate.SQL).df().astype({"doc_id": "Int64"}))


def test_decontamination_is_its_sql(spark, duck):
    assert_same(queries.op5_decontaminate(spark, DATA).toPandas(), duck.execute(decontaminate.SQL).df())


# The pipeline


def test_stages(spark):
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    table, kept = source, source.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, DATA)
        assert out.columns == source.columns, name
        out.write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}")
        table = spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}")
        if name == "jaccard_join":
            ids = {r.doc_id for r in jaccard_join.join(before).where("component_id = doc_id").collect()}  # noqa: F821
            assert ids == {r._key for r in jaccard_join.representatives(before).collect()}  # noqa: F821
            assert {r.doc_id for r in table.collect()} == ids
        if name == "line_dedup":
            assert table.where(F.length("text") != F.col("n_chars")).count() == 0
        before = table
        assert 0 < table.count() <= kept
        kept = table.count()
    last = corpus_pipeline.STAGES[-1][1](spark, table, DATA)
    assert last.count() == kept and last.where("not lossless").count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_scratch_folders_go(spark):
    from pathlib import Path

    from tessera.llm import tables

    at = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    kept = tables.shared_dir(spark, "kept")
    with tables.scratch(spark):
        one = tables.stored(spark.range(3), "gone")
        two = tables.stored(one, "kept", kept)
    assert two.count() == 3 and Path(kept.removeprefix("file://")).exists() and not list(at.glob("gone-*"))
    before = len(list(at.iterdir()))
    jaccard_join.join(docs(spark, ODD)).collect()
    assert len(list(at.iterdir())) <= before + 2


def test_stages_keep_columns_of_any_name_and_kind(spark):
    """Names that stages use themselves, a map, and a document twice under one key."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a", {"x": 1}), (1, text + " v", "b", {"y": 2}), (2, text, "c", {}), (3, "a b c", "d", None), (3, "a b c", "d", None), (4, "own words of another", "e", {})]
    odd = ["_id", "_row_of_same", "_key", "_hash", "_rows", "_own_0", "predicted", "_dropped"]
    table = spark.createDataFrame([(*r, *odd) for r in rows], ", ".join(["doc_id long, text string, x string, m map<string,int>", *(f"{c} string" for c in odd)]))
    near = corpus_pipeline.drop_near_duplicates(spark, table, DATA)
    assert near.columns == table.columns
    assert sorted(r.doc_id for r in near.collect()) == [1, 3, 4]
    for stage in (corpus_pipeline.drop_contaminated, corpus_pipeline.drop_toxic):
        out = stage(spark, table, DATA)
        assert out.columns == table.columns and out.count() in (0, 6)


@pytest.mark.parametrize("rows", [[], ODD])
def test_stages_on_odd_documents(spark, rows):
    columns = ["doc_id", "text", "lang", "source", "n_chars", "component_id", "node", "_key", "_hash", "root"]
    table = docs(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, DATA)
        assert table.columns == columns
        table.count()
    corpus_pipeline.STAGES[-1][1](spark, table, DATA).collect()
