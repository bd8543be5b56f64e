"""Every spatial query against its SQL, at the smallest scale."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from tessera.config import PRESETS
from tessera.functions import geometry
from tessera.operators import catalog, tiling
from tessera.plans import fixtures, more_queries, queries, raster_queries, segmentation  # noqa: F401

from tests.compare import assert_same
from tests.conftest import DATA


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_same_as_sql(spark, duck, name):
    assert_same(queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df())


def test_random_patches_are_in_their_polygons(spark):
    rows = queries.q_random_patches(spark, DATA).collect()
    assert len(rows) == 100
    assert all(r.px1 - r.px0 == pytest.approx(5) and r.py1 - r.py0 == pytest.approx(5) for r in rows)


def test_random_fraction(spark):
    out = {r.event: r["count"] for r in queries.q_random_fraction(spark, DATA).groupBy("event").count().collect()}
    every = {r.event_type: r["count"] for r in spark.read.parquet(f"{DATA}/events.parquet").groupBy("event_type").count().collect()}
    assert out == {k: n // 10 for k, n in every.items()}


def test_prompts_are_padded(spark):
    rows = queries.q_prompts(spark, DATA).collect()
    most = max(len(r.points) for r in rows)
    for r in rows:
        assert len(r.points) == len(r.labels) == most
        assert all((p == [[-10.0, -10.0], [-10.0, -10.0]]) == (x == [0, 0]) for p, x in zip(r.points, r.labels, strict=True))


def test_tile_masks_are_disjoint(spark):
    out = queries.q_tile_masks(spark, DATA).cache()
    assert out.count() == out.select("tile", "row", "col").distinct().count() > 0
    assert {r.channel for r in out.select("channel").distinct().collect()} == {"road", "tree", "building"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 441
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("preset", PRESETS)
def test_presets_and_options(spark, preset):
    from dataclasses import replace

    tile, config = fixtures.tile(spark), replace(PRESETS[preset], size=2200, stride=1600, last_batch=3, max_area_m2=1e9)
    features = spark.createDataFrame([("t0", "building", 0.9, 100.0, 100.0, 180.0, 180.0), ("t0", "building", 0.9, 8000.0, 8000.0, 8100.0, 8100.0)], "tile string, channel string, score double, x0 double, y0 double, x1 double, y1 double")
    masks = segmentation.box_masks(tile, features, config).collect()
    buildings = {(r.x0, r.x1) for r in masks if r.channel == "building"}
    assert buildings == {(100.0, 180.0)}  # the other one is in a later batch
    grown = segmentation.box_masks(tile, features, replace(config, grow_buildings_m=5.0)).where("channel = 'building'").collect()
    assert {(r.x0, r.x1) for r in grown} == {(95.0, 185.0)}
    own = {(r.patch_seq, r.x0) for r in masks if r.channel == "tree"}
    every = {(r.patch_seq, r.x0) for r in segmentation.box_masks(tile, features, replace(config, separate_detection=True)).where("channel = 'tree'").collect()}
    assert own <= every and (own == every) == config.separate_detection
    assert not [r for r in segmentation.box_masks(tile, features, replace(config, text_threshold=0.9)).collect() if r.channel == "tree"]


def test_patches_go_on_until_there_are_enough(spark):
    thin = geometry.ring([(F.lit(0.0), F.lit(0.0)), (F.lit(100.0), F.lit(0.0)), (F.lit(0.0), F.lit(4.0))])
    tiles = spark.range(1).select("id", thin.alias("p"), *(F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 100.0), ("y1", 100.0))))
    rows = tiling.random_patches(tiles, 1, 50, 3, "id", ("p",)).collect()
    assert len(rows) == 50 and all((r.px0 + 0.5) / 100 + (r.py0 + 0.5) / 4 < 1 for r in rows)
    assert rows == tiling.random_patches(tiles.repartition(3), 1, 50, 3, "id", ("p",)).collect()
    with pytest.raises(ValueError):
        tiling.random_patches(tiles.withColumn("p", geometry.ring([(F.lit(500.0), F.lit(0.0))] * 3)), 1, 50, 3, "id", ("p",), rounds=2)
    assert tiling.random_patches(tiles.limit(0), 1, 50, 3, "id").count() == 0


def test_ranks_of_one_value(spark):
    rows = spark.range(1000).selectExpr("id", "cast(if(id % 3 = 0, id, 7) as double) v").unionByName(spark.sql("select -1L id, cast(null as double) v"))
    out = catalog.ecdf(rows, "v", ["id"]).collect()
    assert [(r.id, r["rank"]) for r in sorted(out, key=lambda r: r["rank"])] == [(r.id, k) for k, r in enumerate(sorted(rows.collect(), key=lambda r: (r.v is not None, r.v or 0, r.id)), 1)]


def test_tile_masks_are_folded_by_hash(spark):
    """Cells were sorted by each task before, all of those of its masks."""
    plan = queries.q_tile_masks(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
