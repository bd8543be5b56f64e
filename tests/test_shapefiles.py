"""Shapefiles: what is written is read back, other kinds of shapes, ranges of records."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F
from tessera.functions.geometry import PARTS
from tessera.sources import shapefiles


def closed(*points):
    return [{"x": float(x), "y": float(y)} for x, y in (*points, points[0])]


SQUARE, HOLE, FAR = closed((0, 0), (10, 0), (10, 10), (0, 10)), closed((3, 3), (6, 3), (6, 6), (3, 6)), closed((20, 0), (30, 0), (20, 10))
SCHEMA = f"id long, name string, size double, ok boolean, parts {PARTS}"


def features(spark):
    rows = [(1, "Straße", 1.5, True, [[SQUARE, HOLE], [FAR]]), (2, None, None, None, [[FAR]]), (3, "", -1e-300, False, None), (-(2**60), "x" * 254, 3.0, True, [])]
    return spark.createDataFrame(rows, SCHEMA)


def shoelace(ring):
    return sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(ring, ring[1:])) / 2


def test_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    shapefiles.write(features(spark).repartition(2), root)
    back = {r.id: r for r in shapefiles.shapes(spark, root).collect()}
    assert set(back) == {1, 2, 3, -(2**60)}
    assert (back[1].name, back[1].size, back[1].ok, back[1].kind) == ("Straße", 1.5, True, "polygon")
    assert (back[2].name, back[2].size, back[2].ok) == (None, None, None)
    assert (back[3].name, back[3].size, back[3].kind, back[3].parts) == (None, -1e-300, "null", [])
    assert [len(p) for p in back[1].parts] == [2, 1] and back[-(2**60)].name == "x" * 254
    assert [[round(shoelace(r)) for r in p] for p in back[1].parts] == [[-100, 9], [-50]]  # outer rings clockwise
    assert {(p.x, p.y) for p in back[1].parts[0][1]} == {(3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (3.0, 6.0)}
    assert shapefiles.shapes(spark, root, "name string, id long").orderBy("id").first().id == -(2**60)
    with pytest.raises(Exception, match="ten bytes"):
        shapefiles.write(features(spark).withColumnRenamed("name", "a_long_name"), root)


def test_large_files_are_read_in_ranges(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    many = spark.range(2500).select("id", F.expr("array(array(array(named_struct('x', 0D, 'y', id), named_struct('x', 1D, 'y', id), named_struct('x', 0D, 'y', id + 1D), named_struct('x', 0D, 'y', id))))").cast(PARTS).alias("parts"))
    shapefiles.write(many.coalesce(1), root)
    rows = spark.read.format("shapefile").option("part_bytes", 30_000).load(root)
    assert rows.rdd.getNumPartitions() > 5
    assert rows.agg(F.count("*"), F.sum("id"), F.sum("record"), F.count_distinct("record"), F.sum(F.get(F.get(F.get("parts", F.lit(0)), F.lit(0)), F.lit(0))["y"])).first() == (2500, 2500 * 2499 // 2, 2500 * 2499 // 2, 2500, 2500 * 2499 / 2)


def test_other_shapes():
    line = struct.pack("<i4d2i2i", 13, 0, 0, 1, 1, 2, 4, 0, 2) + struct.pack("<8d", 0, 0, 1, 1, 5, 5, 6, 6) + struct.pack("<6d", 0, 1, 0, 1, 0, 1)
    assert shapefiles.shape_of(line) == ("line", [[[(0, 0), (1, 1)], [(5, 5), (6, 6)]]])
    assert shapefiles.shape_of(struct.pack("<i2d", 1, 3, 4)) == ("point", [[[(3, 4)]]])
    assert shapefiles.shape_of(struct.pack("<i4di4d", 8, 0, 0, 1, 1, 2, 0, 0, 1, 1)) == ("points", [[[(0, 0)], [(1, 1)]]])
    with pytest.raises(ValueError, match="kind 31"):
        shapefiles.shape_of(struct.pack("<i", 31))


def test_the_query_writes_in_many_tasks(spark, tmp_path, monkeypatch):
    from tessera.plans import raster_queries

    monkeypatch.setattr(raster_queries, "folder", lambda spark, name: f"file://{tmp_path}/{name}")
    assert raster_queries.q_shapefile(spark, "/root/testdata/sf0.001").count() == 200
    assert len(list((tmp_path / "shapes").glob("*.shp"))) == 2  # as many as shuffle partitions
