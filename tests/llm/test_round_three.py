"""Spelling variants, quality rules and centroid clustering against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import centroid_clustering, quality_rules, queries, spelling_variants

from tests.conftest import DATA

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, id long, _key long, kept string, cluster int"


def docs(spark, rows):
    """(doc_id, text) or (doc_id, text, lang, source), with columns of names that operators use."""
    full = [(*r, *("en", "s")[len(r) - 2 :])[:4] if len(r) < 4 else r for r in rows]
    return spark.createDataFrame([(*r, 1, "w", 2, 3, 4, "k", 5) for r in full], EXTRA)


# Spelling variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(rows):
    n = {}
    for key, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in "".join(c if "a" <= c <= "z" or "À" <= c <= "ÿ" else " " for c in lowered).split(" "):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if run and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] = n.get(run, 0) + 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in n}
    forms = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n[w], len(near[w]), n[forms[w]] if forms[w] else None))
    return sorted(out)


def found_variants(spark, rows):
    return sorted(tuple(r) for r in spelling_variants.variants(docs(spark, rows)).collect())


@pytest.mark.parametrize("seed", range(2))
def test_variants_are_those_of_all_pairs(spark, seed):
    r = random.Random(seed)
    said = ["".join(r.choice("abÀé") for _ in range(r.randrange(4, 9))) for _ in range(150)]
    for w in list(said):
        at = r.randrange(len(w))
        said += [w[:at] + r.choice("abÀéz") + w[at + r.randrange(2) :] * r.randrange(1, 2), w[:at] + w[at + 1 :]]
    weights = [r.randrange(1, 60) for _ in said]
    rows = [(i, r.choice([" ", "-", ", 7"]).join(r.choices(said, weights, k=80))) for i in range(60)]
    found = found_variants(spark, rows)
    assert found == slow_variants(rows)
    assert sum(x[1] is not None for x in found) > 20 and any(x[1] and x[2] != x[1] for x in found)


def test_variants_of_runs_of_one_letter(spark):
    rows = [(i, " ".join(["aaaaaa"] * 9 + ["aaaaa"] * 4 + ["aaaaaaa"] * 3 + ["aaaba", "aabaa", "baaaa", "aaaab", "ababa"])) for i in range(20)]
    assert found_variants(spark, rows) == slow_variants(rows)


def test_variants_odd_texts(spark):
    long = "x" * 200_000
    rows = [(1, None), (2, ""), (3, " 12\n"), (None, "Hello hello HELLO"), (5, "hello hellö hellö hellö ÄÖÜäöü"), (5, "hello hellö hellö hellö ÄÖÜäöü"), *((i, f"{long} {long}y") for i in range(6, 10))]
    found = found_variants(spark, rows)
    assert [x for x in found if len(x[0]) < 100] == [x for x in slow_variants(rows) if len(x[0]) < 100]
    assert {(len(x[0]), x[4]) for x in found if len(x[0]) > 100} == {(200_000, 1), (200_001, 1)}
    assert found_variants(spark, []) == []


def test_each_word_is_entered_a_few_times(spark):
    rows = spelling_variants.words(queries.table(spark, DATA, "documents")).withColumn("id", F.monotonically_increasing_id())
    n = rows.count()
    most = spelling_variants.light_places(rows).groupBy("word").count().agg(F.max("count")).first()[0]
    assert most <= math.log2(n) + 1  # light subtrees that a word is in


# Quality rules


def slow_counts(text):
    space = " \t\n\v\f\r"
    said, word = [], ""
    for c in (text or "") + " ":
        if c in space:
            said, word = said + [word] if word else said, ""
        else:
            word += c
    windows = [tuple(said[i : i + 3]) for i in range(len(said) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(space)]
    return len(said), sum(map(len, said)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), len(lines)


def slow_verdicts(rows, floors=quality_rules.FLOORS, least=quality_rules.LEAST_GROUP, cut=quality_rules.CUT):
    """Concentration steps over the documents themselves, group by group, in floats."""
    counts = {i: slow_counts(r[1]) for i, r in enumerate(rows)}
    failed = {i: c[0] < 50 or 100 * c[4] > 50 * c[0] for i, c in counts.items()}
    x = {i: np.array(quality_rules.vector(*counts[i]), float) for i in counts}
    floor = np.diag([(f * quality_rules.UNITS) ** 2 for f in floors])

    def distances(v, estimate):
        off = v - estimate[0]
        return np.einsum("ij,jk,ik->i", off, np.linalg.inv(estimate[1]), off)

    def ranges(v, estimate):
        return np.floor(quality_rules.RANGES * np.log2(1 + np.maximum(0, distances(v, estimate))))

    def estimate_of(v):
        centre = np.sort(v, 0)[(len(v) - 1) // 2]
        spread = 1.4826 * np.sort(np.abs(v - centre), 0)[(len(v) - 1) // 2]
        now, before = (centre, np.diag(spread**2) + floor), None
        for _ in range(quality_rules.MOST_STEPS):
            at = ranges(v, now)
            half = v[at <= np.sort(at)[(len(v) - 1) // 2]]
            now = half.mean(0), np.cov(half.T, bias=True) + floor
            if before is not None and len(half) == len(before) and (half == before).all():
                break
            before = half
        at = ranges(v, now)
        middle = np.sort(at)[(len(v) - 1) // 2]
        upper = lambda k: 2 ** ((k + 1) / quality_rules.RANGES) - 1
        near = v[(at <= middle) | (upper(at) <= quality_rules.NEAR * max(1, upper(middle) / quality_rules.MEDIAN))]
        return near.mean(0), np.cov(near.T, bias=True) + floor

    def group(i, level):
        return ((rows[i][2], rows[i][3]), rows[i][2], ())[level]

    passing = [i for i in counts if not failed[i]]
    out = []
    for i, row in enumerate(rows):
        kept = not failed[i]
        for level in range(3) if kept else ():
            mine = [j for j in passing if group(j, level) == group(i, level)]
            if len(mine) >= least:
                kept = bool(distances(x[i][None], estimate_of(np.stack([x[j] for j in mine])))[0] <= cut)
                break
        out.append((row[0], *counts[i][:5], failed[i], kept))
    return sorted(out, key=str)


def test_counts_are_those_of_all_windows():
    r = random.Random(2)
    for _ in range(200):
        text = "".join(r.choice(["a", "b", "é", "# ", "\n", " ", "\t", "|", "a b a\n", " "]) for _ in range(r.randrange(60)))
        assert quality_rules.counts(text.encode()) == slow_counts(text), text


def plain(r, n, size=5, symbols=0.0):
    said = ["".join(r.choice("abcdefghijklmnop") for _ in range(max(1, round(r.gauss(size, 2))))) for _ in range(n)]
    return " ".join(w + "#" * (r.random() < symbols) + "\n" * (r.random() < 0.1) for w in said)


def test_verdicts_are_those_of_steps_over_documents(spark):
    r = random.Random(5)
    rows = []
    for i in range(400):
        lang, source = r.choice(["en", "de", None]), r.choice(["big", "big", "big", "small", None])
        odd = i % 11 == 0
        rows.append((i, plain(r, r.randrange(20, 300), 5 + 6 * (odd and i % 2) + 2 * (lang == "de"), 0.6 * (odd and i % 2 == 0)), lang, source))
    found = quality_rules.judged(docs(spark, rows), ["doc_id"], least=30).drop("distance")
    assert sorted((tuple(x) for x in found.collect()), key=str) == slow_verdicts(rows, least=30)
    kept = {x.doc_id: x.kept for x in found.collect() if not x.base_failed}
    assert not any(k for i, k in kept.items() if i % 11 == 0)
    assert np.mean([k for i, k in kept.items() if i % 11]) > 0.99


def test_quality_odd_texts(spark):
    rows = [(1, None, None, None), (2, "", "en", "s"), (None, " \n\t", "en", None), (4, "x" * 100_000, "en", "s"), (5, "a b c " * 40, "en", "s"), (5, "a b c " * 40, "en", "s"), (6, " ".join(map(str, range(60))), "en", "s")]
    found = {(x.doc_id, x.n_words, x.base_failed, x.kept) for x in quality_rules.judged(docs(spark, rows), ["doc_id"]).collect()}
    assert found == {(1, 0, True, False), (2, 0, True, False), (None, 0, True, False), (4, 1, True, False), (5, 120, True, False), (6, 60, False, True)}
    assert quality_rules.judged(docs(spark, []), ["doc_id"]).count() == 0


def test_labelled_documents(spark):
    """Documents labelled good that pass the base rules are kept; the others go."""
    judged = queries.op12_quality_rules(spark, DATA.replace("0.001", "0.01")).join(queries.table(spark, DATA.replace("0.001", "0.01"), "labels"), "doc_id").where("not base_failed")
    share = {x.quality: x.share for x in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] >= 0.99 and share[0] <= 0.05


# Centroid clustering


def slow_clusters(rows, size, clusters=16, rounds=3):
    kept = [(i, [math.floor(64 * int(c)) if abs(c) > 1e15 else math.floor(64 * c) for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    named = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in named[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        to = [nearest(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            mine = [v for (_, v), t in zip(kept, to) if t == k]
            if mine:
                centroids[k] = [sum(c) // len(mine) for c in zip(*mine)]
    held = lambda x: x if x < 1 << 63 else None
    last = [(i, *nearest(v)) for i, v in kept]
    within = {k: sum(d for _, d, c in last if c == k) for k in range(len(centroids))}
    return sorted(((i, k, held(d), held(within[k]), held(sum(within.values())), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, d, k in last), key=str)


def vectors(spark, rows):
    kind = "vec_id long, embedding array<double>, label int, cluster int, distance long, _key long, _vector string"
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "v") for r in rows], kind).repartition(3)


@pytest.mark.parametrize("size_of", [1.0, 1e6, 1e7, 1e12, 1e200])
def test_clusters_are_exact_at_any_magnitude(spark, size_of):
    r = random.Random(size_of)
    rows = [(i, [r.uniform(-1, 1) * size_of for _ in range(5)]) for i in range(120)] + [(i, [1.5] * 5) for i in range(120, 140)]
    found = centroid_clustering.digest(vectors(spark, rows), size=5)
    assert sorted((tuple(x) for x in found.collect()), key=str) == slow_clusters(rows, 5)


def test_vectors_that_are_left_out_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [-0.01, 0.5]), (None, [3.0, 1.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0]), (8, [2.0, 1.0]), (9, [0.0, 0.0])]
    found = centroid_clustering.digest(vectors(spark, rows), size=2)
    assert sorted((tuple(x) for x in found.collect()), key=str) == slow_clusters(rows, 2)
    assert centroid_clustering.digest(vectors(spark, []), size=2).count() == 0
    assert centroid_clustering.digest(vectors(spark, rows[:6]), size=2).count() == 0


def test_products_are_exact_at_the_guards():
    r = random.Random(3)
    for bits in (10, 20, 24, 26, 27, 30, 31, 40, 70):
        x = np.array([[r.randrange(-(1 << bits), 1 << bits) for _ in range(7)] for _ in range(40)], object)
        c = np.array([[r.randrange(-(1 << bits), 1 << bits) for _ in range(7)] for _ in range(6)], object)
        assert centroid_clustering.squared_distances(x, c).tolist() == [[sum((a - b) ** 2 for a, b in zip(u, v)) for v in c] for u in x]


def test_round_three_sql(spark, duck):
    for name in ("op11_spelling_variants", "op13_centroid_clustering"):
        ours, theirs = queries.QUERIES[name](spark, DATA), duck.execute(queries.ORACLE_SQL[name]).fetchall()
        columns = [d[0] for d in duck.description]
        assert sorted(map(str, map(tuple, ours.select(columns).collect()))) == sorted(map(str, theirs))
