"""The Jaccard join at size: chance pairs aren't candidates, texts travel instead of sets."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import decontaminate, jaccard_join

import corpus_pipeline


def text(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def test_magnitudes_of_linked_sets():
    sizes = [*range(1, 3000), *(4**k * 5**j for k in range(12) for j in range(12))]
    for n in sizes:
        large = jaccard_join.WHOLE * n // jaccard_join.PART  # the largest set that one of n can be linked with
        assert 0 <= jaccard_join.magnitude(large) - jaccard_join.magnitude(n) <= 1
        assert jaccard_join.least_shared(n) <= jaccard_join.least_shared(large)
        assert jaccard_join.prefix_length(n) <= n
    assert jaccard_join.class_of(jaccard_join.shingles(text(1, 104).encode())) & jaccard_join.MAGNITUDE == jaccard_join.magnitude(100)


def test_chance_pairs_are_no_candidates(spark):
    """Twenty long texts have one rare shingle in common, two are near copies; nothing is paired with a
    text of another size."""
    common = "five words that all have"
    rows = [(k, f"{common} {text(k, 300 if k % 2 else 150)}") for k in range(20)] + [(90, f"{common} {text(3, 300)} more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    table = np.ones(jaccard_join.COUNT_SLOTS, np.uint8)
    table[int(jaccard_join.shingles(common.encode())[0]) & jaccard_join.COUNT_SLOTS - 1] = 0  # it comes first in all prefixes
    made = jaccard_join.candidates(docs, table, "doc_id", "text", 5).localCheckpoint()
    assert made.count() > 45  # of 210 pairs, those of like sizes
    assert made.where("abs((a & 127) - (b & 127)) > 1").count() == 0
    pair = {jaccard_join.class_of(jaccard_join.shingles(t.encode())) for k, t in rows if k in (3, 90)}
    assert [{r.a, r.b} for r in jaccard_join.enough_shared(made).collect()] == [pair]
    assert {r.component_id for r in jaccard_join.join(docs).where("doc_id in (3, 90)").collect()} == {3}


def test_texts_travel_to_blocks(spark):
    """What is dealt out for a set has less than half of its eight bytes a shingle."""
    rows = [(k, f"{' '.join(f'word{i % 50}' for i in range(900))} {text(k // 2, 900)} {k % 2}") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = jaccard_join.candidate_texts(docs, np.full(jaccard_join.FILTER_BITS // 8, 255, np.uint8), "text", 5)
    sizes = {r.node: r.n for r in texts.select("node", F.length("packed").alias("n")).collect()}
    sets = {jaccard_join.class_of(s): 8 * len(s) for _, t in rows for s in [jaccard_join.shingles(t.encode())]}
    assert sizes.keys() == sets.keys() and all(2 * sizes[c] < sets[c] for c in sets)
    assert sorted(r.component_id for r in jaccard_join.join(docs).collect()) == [0, 0, 2, 2, 4, 4]


@pytest.mark.parametrize("parts", [1, 5])
def test_surplus_is_what_representatives_leave(spark, parts):
    near = [(k, f"{text(k // 3, 60)} {k % 3}") for k in range(12)]
    rows = [*near, *near[:4], (None, near[5][1]), (None, None), (None, None), (7, None), (50, "one two"), (51, "one two"), (51, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    kept = {(r._key, r._hash): r._rows for r in jaccard_join.representatives(docs).collect()}
    found = {(r._key, r._hash): r._rows for r in jaccard_join.surplus(docs).collect()}
    every = {tuple(r) for r in docs.select("doc_id", F.xxhash64("text")).collect()}
    assert {k for k, n in found.items() if n == 0} == every - kept.keys()
    assert {k: n for k, n in found.items() if n} == {k: n for k, n in kept.items() if n > 1}
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(map(tuple, left.select("doc_id", F.xxhash64("text")).collect()), key=str) == sorted(kept, key=str)


def test_texts_stay_where_few_documents_go(spark):
    """Neither of the pipeline's copies of the texts is dealt out by key."""
    docs = spark.createDataFrame([(k, f"{text(k // 2, 60)} {k % 2}") for k in range(12)], "doc_id long, text string")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert left.count() == 6 and "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2


def test_slots_are_not_broadcast(spark):
    """Their files are hundreds of times smaller than their rows, which grow with the documents."""
    item = "In the year 1999 Anna Smith bought 25 kg of green apples and sold 7 kg of them to Robert Brown near the old mill"
    docs = spark.createDataFrame([(k, f"Before it. {item} after {k}.") for k in range(30)], "doc_id long, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    assert [line for line in plan if "SortMergeJoin" in line and "r_key" in line]
    assert not [line for line in plan if "BroadcastHashJoin" in line and "r_key" in line]
    assert {r.doc_id for r in found.collect()} == {*range(30)}
