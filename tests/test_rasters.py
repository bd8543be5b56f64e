"""Raster files: directories and blocks of several kinds, windows, the table source and the sink."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.sources import geotiff, rasters


def made(pixels, tile=None, strip=None, deflate=False, predictor=False, by_band=False, order="<", large=False, geo=None, nodata=None):
    """A file of another writer: (bands, rows, columns), in tiles or strips."""
    bands, h, w = pixels.shape
    bh, bw = tile or (strip or h, w)
    kind = {"u": 1, "i": 2, "f": 3}[pixels.dtype.kind]
    blocks = []
    for plane in range(bands if by_band else 1):
        own = pixels[plane : plane + 1] if by_band else pixels
        for top in range(0, h, bh):
            for left in range(0, w, bw):
                part = own[:, top : top + bh, left : left + bw]
                if tile:
                    full = np.zeros((len(own), bh, bw), pixels.dtype)
                    full[:, : part.shape[1], : part.shape[2]] = part
                    part = full
                part = part.transpose(1, 2, 0)
                if predictor:
                    part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                raw = part.astype(part.dtype.newbyteorder(order)).tobytes()
                blocks.append(zlib.compress(raw) if deflate else raw)
    number = "Q" if large else "I"
    tags = {256: ("H", [w]), 257: ("H", [h]), 258: ("H", [pixels.itemsize * 8] * bands), 259: ("H", [8 if deflate else 1]), 277: ("H", [bands]), 284: ("H", [2 if by_band else 1]), 317: ("H", [2 if predictor else 1]), 339: ("H", [kind] * bands)}
    tags |= {322: ("H", [bw]), 323: ("H", [bh])} if tile else {278: ("H", [bh])}
    if geo:
        tags |= {33550: ("d", [geo[0], geo[1], 0]), 33922: ("d", [0, 0, 0, geo[2], geo[3], 0]), 34735: ("H", [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, geo[4]])}
    if nodata is not None:
        tags[42113] = ("s", f"{nodata}\0".encode())
    head = 16 if large else 8
    start, body, offsets = head, b"", []
    for b in blocks:
        offsets.append(start + len(body))
        body += b
    tags |= {324 if tile else 273: (number, offsets), 325 if tile else 279: (number, [len(b) for b in blocks])}
    at, outside, entries = start + len(body), b"", b""
    code = {"H": 3, "I": 4, "Q": 16, "d": 12, "s": 2}
    for tag in sorted(tags):
        k, v = tags[tag]
        raw = v if k == "s" else struct.pack(f"{order}{len(v)}{k}", *v)
        inline = 8 if large else 4
        place = raw.ljust(inline, b"\0")
        if len(raw) > inline:
            place = struct.pack(f"{order}{number}", at + len(outside))
            outside += raw
        entries += struct.pack(f"{order}HH{number}", tag, code[k], len(v)) + place
    directory = at + len(outside)
    mark = b"II" if order == "<" else b"MM"
    top = mark + (struct.pack(f"{order}HHHQ", 43, 8, 0, directory) if large else struct.pack(f"{order}HI", 42, directory))
    return top + body + outside + struct.pack(f"{order}{'Q' if large else 'H'}", len(tags)) + entries + struct.pack(f"{order}{number}", 0)


def ranges(raw, asked=None):
    def read(start, size):
        if asked is not None:
            asked.append((start, size))
        return raw[start : start + size]

    return read


KINDS = [
    {"tile": (16, 32)},
    {"strip": 7},
    {"tile": (16, 16), "deflate": True, "predictor": True, "order": ">"},
    {"strip": 5, "deflate": True, "by_band": True},
    {"tile": (32, 16), "by_band": True, "large": True},
    {"strip": 100, "large": True, "order": ">", "predictor": True},
]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("dtype", ["u1", "i2", "f4"])
def test_windows_are_slices(kind, dtype):
    if dtype == "f4" and kind.get("predictor"):
        kind = {**kind, "predictor": False}
    r = np.random.default_rng(3)
    pixels = r.integers(0, 100, (3, 61, 75)).astype(dtype)
    raw = made(pixels, **kind, geo=(0.5, 0.5, 1000, 2000, 32633))
    asked = []
    read = ranges(raw, asked)
    layout = geotiff.layout_of(read)
    assert (layout.height, layout.width, layout.bands, np.dtype(layout.dtype).newbyteorder("=")) == (61, 75, 3, np.dtype(dtype))
    assert (layout.transform, layout.epsg) == ([0.5, 0.0, 1000.0, 0.0, -0.5, 2000.0], 32633)
    for row, col, h, w in [(0, 0, 61, 75), (15, 30, 3, 5), (10, 10, 40, 60), (60, 74, 1, 1), (-5, -3, 10, 10), (55, 70, 20, 20)]:
        got = geotiff.window(layout, row, col, h, w, lambda n: geotiff.block(layout, n, read))
        padded = np.zeros((3, h, w), dtype)
        for y in range(h):
            for x in range(w):
                if 0 <= row + y < 61 and 0 <= col + x < 75:
                    padded[:, y, x] = pixels[:, row + y, col + x]
        assert (got == padded).all()
    assert geotiff.window(layout, 61, 0, 5, 5, None) is None and geotiff.window(layout, 0, -5, 5, 5, None) is None
    asked.clear()
    geotiff.window(layout, 22, 40, 2, 2, lambda n: geotiff.block(layout, n, read))
    assert len(asked) == (3 if kind.get("by_band") else 1)


def test_other_files():
    with pytest.raises(ValueError, match="no TIFF"):
        geotiff.layout_of(ranges(b"\x89PNG\r\n\x1a\n" + b"\0" * 20))
    raw = made(np.ones((1, 8, 8), "u1"), strip=8, nodata=-7.5)
    assert geotiff.layout_of(ranges(raw)).nodata == -7.5
    layout = geotiff.layout_of(ranges(raw))
    layout.compression = 7
    with pytest.raises(ValueError, match="compression 7"):
        geotiff.block(layout, 0, ranges(raw))


def test_what_is_written_can_be_read():
    tile = np.zeros((32, 32), np.uint8)
    tile[3, 5] = 9
    raw = b"".join(geotiff.file_of(40, 70, 32, {1: zlib.compress(tile.tobytes())}, [2.0, 0.0, 5.0, 0.0, -2.0, 7.0], 4326))
    layout = geotiff.layout_of(ranges(raw))
    assert (layout.height, layout.width, layout.transform, layout.epsg) == (40, 70, [2.0, 0.0, 5.0, 0.0, -2.0, 7.0], 4326)
    whole = geotiff.window(layout, 0, 0, 40, 70, lambda n: geotiff.block(layout, n, ranges(raw)))
    assert whole[0, 3, 37] == 9 and whole.sum() == 9


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Three files side by side, of 61 x 75 pixels of half a unit."""
    at, r = tmp_path_factory.mktemp("rasters"), np.random.default_rng(5)
    images = {}
    for k in range(3):
        images[k] = r.integers(1, 200, (2, 61, 75)).astype("u1")
        (at / f"e{k}").mkdir()
        (at / f"e{k}" / "a.tif").write_bytes(made(images[k], tile=(16, 16), deflate=k > 0, geo=(0.5, 0.5, 37.5 * k, 100, 32633)))
    (at / "e0" / "note.txt").write_text("no raster")
    return f"file://{at}", images


def test_catalogue_opens_no_block(spark, folder, tmp_path):
    root, _ = folder
    rows = rasters.catalogue(spark, root).orderBy("path").collect()
    assert [(r.height, r.width, r.bands, r.dtype, r.n_blocks, r.epsg) for r in rows] == [(61, 75, 2, "u1", 20, 32633)] * 3
    assert [r.transform[2] for r in rows] == [0.0, 37.5, 75.0]
    whole = made(np.ones((1, 4000, 64), "u1"), strip=100)
    cut = tmp_path / "cut.tif"
    cut.write_bytes(b"II*\0" + whole[4:8] + b"\0" * 256_000 + whole[8 + 256_000 :])
    assert rasters.catalogue(spark, f"file://{tmp_path}", "height int, path string").collect()[0].height == 4000


def test_blocks(spark, folder):
    root, images = folder
    own = rasters.blocks(spark, root).where("path like '%e1%'")
    got = np.zeros((2, 61, 75), "u1")
    for r in own.collect():
        got[:, r.top : r.top + r.height, r.left : r.left + r.width] = np.frombuffer(r.pixels, "u1").reshape(2, r.height, r.width)
    assert (got == images[1]).all()
    assert rasters.blocks(spark, root, "top int, left int").count() == 60
    small = spark.read.format("raster").option("part_bytes", 1000).load(root)
    assert small.rdd.getNumPartitions() > 10 and small.count() == 60


def test_conditions_leave_out_blocks(spark, folder):
    root, _ = folder
    source = rasters.RasterReader(spark.createDataFrame([], rasters.BLOCKS).schema, {"path": root})
    path = f"{root}/e2/a.tif"
    list(source.pushFilters([rasters.EqualTo(("path",), path), rasters.GreaterThanOrEqual(("top",), 32), rasters.LessThan(("left",), 16)]))
    parts = source.partitions()
    assert [p for part in parts for p in part.paths] == [path]
    assert [(r[3], r[4]) for part in parts for r in source.read(part)] == [(32, 0), (48, 0)]
    assert rasters.blocks(spark, root).where((F.col("top") >= 32) & (F.col("left") < 16)).count() == 6


def test_windows_of_files(spark, folder):
    root, images = folder
    r = random.Random(1)
    wanted = [(i, f"{root}/e{k}/a.tif", r.randrange(-5, 58), r.randrange(-5, 70), r.randrange(1, 30), r.randrange(1, 30)) for i, k in enumerate(r.choices(range(3), k=40))]
    wanted = [(i, p, max(y, 1 - h), max(x, 1 - w), h, w) for i, p, y, x, h, w in wanted]
    table = spark.createDataFrame(wanted, "id int, path string, row int, col int, height int, width int")
    for x in rasters.windows(table).collect():
        big = np.pad(images[int(x.path[-7])], ((0, 0), (40, 40), (40, 40)))
        assert np.frombuffer(x.pixels, x.dtype).reshape(x.bands, x.height, x.width).tolist() == big[:, x.row + 40 : x.row + 40 + x.height, x.col + 40 : x.col + 40 + x.width].tolist()
    outside = spark.createDataFrame([(1, f"{root}/e0/a.tif", 61, 0, 5, 5)], table.schema)
    assert rasters.windows(outside, "skip").count() == 0
    with pytest.raises(Exception, match="is outside of"):
        rasters.windows(outside).count()


def test_boxes_of_space_over_several_files(spark, folder):
    root, images = folder
    files = rasters.catalogue(spark, root)
    queries = spark.createDataFrame([("a", 30.0, 80.0, 50.0, 90.0), ("none", 500.0, 0.0, 510.0, 10.0)], "q string, x0 double, y0 double, x1 double, y1 double")
    got = {(x.band, x.row, x.col): x.v for x in rasters.queried(files, queries, "q", 50.0).collect()}
    side = np.concatenate([images[k] for k in range(3)], axis=2)[:, 20:40, 60:100]
    assert got == {(b, i, j): side[b, i, j] for b in range(2) for i in range(20) for j in range(40)}
    assert [x.q for x in rasters.unmet(files, queries, "q", 50.0).collect()] == ["none"]


def test_windows_of_few_files_are_dealt_out(spark, folder):
    """Those of one file go to all tasks, and equal ones too."""
    root, _ = folder
    wanted = spark.range(400).selectExpr("id", f"'{root}/e0/a.tif' path", "cast(id % 2 * 7 as int) row", "3 col", "5 height", "4 width")
    held = [x["count"] for x in rasters.windows(wanted, tasks=8).groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) == 8 and sum(held) == 400 and max(held) <= 100


def test_pixels_of_boxes_on_one_file_are_not_folded(spark, folder):
    """Boxes within a file, across two and under one key: all pixels, of the first file by path, and
    those of the first are not grouped by pixel."""
    root, images = folder
    files = rasters.catalogue(spark, root)
    rows = [(1, 2.0, 85.0, 8.0, 90.0), (2, 30.0, 80.0, 50.0, 90.0), (3, 2.0, 85.0, 8.0, 90.0), (3, 2.0, 80.0, 8.0, 85.0)]
    found = rasters.queried(files, spark.createDataFrame(rows, "q int, x0 double, y0 double, x1 double, y1 double"), "q", 50.0)
    got = {(x.q, x.band, x.row, x.col): x.v for x in found.collect()}
    side = np.concatenate([images[k] for k in range(3)], axis=2)
    one = side[:, 20:30, 4:16]
    assert {k[1:]: v for k, v in got.items() if k[0] == 1} == {(b, i, j): one[b, i, j] for b in range(2) for i in range(10) for j in range(12)}
    assert len([k for k in got if k[0] == 2]) == 2 * 20 * 40 and len([k for k in got if k[0] == 3]) == 2 * 10 * 12
    assert found.count() == len(got)
    assert "Union" in found._jdf.queryExecution().optimizedPlan().toString()


def test_positions_and_pixels(spark):
    rows = spark.createDataFrame([([0.5, 0.0, 10.0, 0.0, -0.5, 20.0], 3, 7), ([0.3, 0.4, 1.0, 0.4, -0.3, 2.0], 5, 2)], "transform array<double>, r int, c int")
    x, y = rasters.xy_of("transform", F.col("r"), F.col("c"))
    row, col = rasters.index_of("transform", F.col("x"), F.col("y"))
    back = rows.withColumns({"x": x, "y": y}).withColumns({"row": row, "col": col}).collect()
    assert [(b.row, b.col) for b in back] == [(3, 7), (5, 2)]
    assert (back[0].x, back[0].y) == (13.75, 18.25)


def test_sink(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    frame = spark.createDataFrame([("e/a.tif", 300, 520, [1.0, 0.0, 0.0, 0.0, -1.0, 300.0], 32633), ("e/b.tif", 20, 20, None, None)], "file string, height int, width int, transform array<double>, epsg int")
    r = random.Random(4)
    own = {(r.randrange(300), r.randrange(520)): r.randrange(1, 256) for _ in range(3000)}
    pixels = spark.createDataFrame([("e/a.tif", y, x, v) for (y, x), v in own.items()] + [("e/a.tif", 300, 0, 1), ("e/a.tif", 0, -1, 1), ("e/none.tif", 0, 0, 1)], "file string, row int, col int, v int").repartition(3)
    rasters.write(pixels, frame, root)
    files = rasters.catalogue(spark, root).orderBy("path").collect()
    assert [(f.path.rpartition("/")[2], f.height, f.width, f.epsg) for f in files] == [("a.tif", 300, 520, 32633), ("b.tif", 20, 20, None)]
    assert files[0].transform == [1.0, 0.0, 0.0, 0.0, -1.0, 300.0]
    blocks = rasters.blocks(spark, root)
    back = rasters.pixel_rows(blocks, ["path", "top", "left"]).where("v > 0").collect()
    assert {(b.top + b.row, b.left + b.col): b.v for b in back} == own
    with pytest.raises(Exception, match="exist"):
        rasters.write(pixels, frame, root)
    rasters.write(pixels.limit(0), frame, root, overwrite=True)
    assert rasters.pixel_rows(rasters.blocks(spark, root), ["path"]).agg(F.sum("v")).first()[0] == 0
    assert not list((tmp_path / "out").glob(".staging*"))


def test_sink_writes_nothing_when_a_task_fails(spark, tmp_path):
    frame = spark.createDataFrame([("a.tif", 20, 20, None, None), ("b.tif", 20, 20, [1.0], None)], "file string, height int, width int, transform array<double>, epsg int")
    with pytest.raises(Exception):
        rasters.write(spark.createDataFrame([], "file string, row int, col int, v int"), frame, f"file://{tmp_path}/out")
    assert not list(tmp_path.rglob("*.tif"))


def test_bytes_of_floats_as_in_sql(spark, tmp_path):
    """0.159 and 0.072 as floats, 1,000 times: the product as a float is rounded up to a whole number."""
    import duckdb

    from tests.compare import assert_same

    from tessera.plans import queries, raster_queries  # noqa: F401

    rows = [(i, 1, [v] * 64) for i, v in enumerate((-0.159, 0.072, 0.5))]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert_same(queries.QUERIES["q_resized_images"](spark, str(tmp_path)).toPandas(), con.execute(queries.ORACLE_SQL["q_resized_images"]).df())
