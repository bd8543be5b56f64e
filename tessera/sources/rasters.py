"""Raster files as a table: a row a file, or a row a block; windows of them; and masks written
as such files.

``spark.read.format("raster")`` (once ``register`` has run) deals files out to tasks, large
ones in several parts. What a query doesn't ask for isn't read: a table without ``pixels``
opens no block, and conditions on path, top and left leave out files and blocks.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tessera.functions.boxes import Corners
from tessera.operators.spatial_join import overlap_join
from tessera.sources import geotiff
from tessera.sources.staging import StagedWriter, Written, listed, opened

FILES = "path string, height int, width int, bands int, dtype string, block_height int, block_width int, n_blocks int, transform array<double>, epsg int, nodata double"
BLOCKS = "path string, band int, bands int, top int, left int, height int, width int, dtype string, pixels binary"
SINK = "file string, height int, width int, transform array<double>, epsg int, number int, pixels binary"
#: Bytes of files that a task reads, about.
PART = 64 << 20
#: Bytes of decoded blocks that a task keeps, for windows that share them.
KEPT = 64 << 20
TILE = 256


def reader(path: str) -> geotiff.Reader:
    """Reads ranges of a file in whatever store its address names."""
    files, at = opened(path)
    source = files.open_input_file(at)
    return lambda start, size: source.read_at(size, start)


class Part(InputPartition):
    """Files, or one of several parts of a file's blocks."""

    def __init__(self, paths: list[str], part: int = 0, parts: int = 1) -> None:
        self.paths, self.part, self.parts = paths, part, parts


TESTS: dict[type, Callable] = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


class RasterReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns, self.root = schema.names, options["path"]
        self.ending, self.files_only = options.get("ending", ".tif"), options.get("rows", "blocks") == "files"
        self.size, self.tests = int(options.get("part_bytes", PART)), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Conditions that leave out files and blocks; Spark still applies all of them."""
        for f in filters:
            name = getattr(f, "attribute", ("",))[-1]
            if type(f) in TESTS and name in ("path", "top", "left"):
                self.tests.append((name, TESTS[type(f)], f.value))
            yield f

    def passes(self, name: str, value: object) -> bool:
        return all(test(value, v) for n, test, v in self.tests if n == name)

    def partitions(self) -> list[InputPartition]:
        _, scheme, found = listed(self.root, self.ending)
        out, some, size = [], [], 0
        for info in found:
            path, own = scheme + info.path, 0 if self.files_only or "pixels" not in self.columns else info.size
            if not self.passes("path", path):
                continue
            if own > self.size:
                parts = -(-own // self.size)
                out += [Part([path], k, parts) for k in range(parts)]
                continue
            some, size = [*some, path], size + own + self.size // 1000  # a directory costs too
            if size >= self.size:
                out.append(Part(some))
                some, size = [], 0
        return [*out, *([Part(some)] if some else [])]

    def read(self, partition: Part) -> Iterator[tuple]:
        for path in partition.paths:
            read = reader(path)
            layout = geotiff.layout_of(read)
            for row in [file_row(path, layout)] if self.files_only else self.block_rows(path, layout, read, partition):
                yield tuple(row[c] for c in self.columns)

    def block_rows(self, path: str, layout: geotiff.Layout, read: geotiff.Reader, of: Part) -> Iterator[dict]:
        n = len(layout.offsets)
        for number in range(of.part * n // of.parts, (of.part + 1) * n // of.parts):
            plane, at = divmod(number, layout.down * layout.across)
            top, left = at // layout.across * layout.block_height, at % layout.across * layout.block_width
            if not (self.passes("top", top) and self.passes("left", left)):
                continue
            pixels = geotiff.block(layout, number, read) if "pixels" in self.columns else None
            yield {
                "path": path,
                "band": plane if layout.by_band else None,
                "bands": 1 if layout.by_band else layout.bands,
                "top": top,
                "left": left,
                "height": min(layout.block_height, layout.height - top),
                "width": min(layout.block_width, layout.width - left),
                "dtype": layout.dtype.lstrip("<>"),
                "pixels": None if pixels is None else pixels.tobytes(),
            }


def file_row(path: str, layout: geotiff.Layout) -> dict:
    own = {c: getattr(layout, c) for c in ("height", "width", "bands", "block_height", "block_width", "transform", "epsg", "nodata")}
    return own | {"path": path, "dtype": layout.dtype.lstrip("<>"), "n_blocks": len(layout.offsets)}


class RasterWriter(StagedWriter):
    """Rows of one file have to follow each other."""

    def write(self, iterator: Iterator) -> Written:
        files, at, stage = self.stage()
        done: list[tuple[str, str]] = []
        head, blocks = None, {}

        def close() -> None:
            if head is None:
                return
            to = f"{stage}/{len(done)}.tif"
            with files.open_output_stream(to) as out:
                for part in geotiff.file_of(head.height, head.width, TILE, blocks, head.transform, head.epsg):
                    out.write(part)
            done.append((to, f"{at}/{head.file}"))

        for row in iterator:
            if head is None or row.file != head.file:
                close()
                head, blocks = row, {}
            if row.number is not None:
                blocks[row.number] = bytes(row.pixels)
        close()
        return Written(done)


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return FILES if self.options.get("rows", "blocks") == "files" else BLOCKS

    def reader(self, schema: StructType) -> RasterReader:
        return RasterReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> RasterWriter:
        return RasterWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and has Spark hand conditions down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)


# Reading


def catalogue(spark: SparkSession, root: str, columns: str = FILES) -> DataFrame:
    """A row a file: its size, type, blocks, transform (a, b, c, d, e, f), EPSG code and no-data
    value, from directories alone."""
    register(spark)
    return spark.read.format("raster").schema(columns).option("rows", "files").load(root)


def blocks(spark: SparkSession, root: str, columns: str = BLOCKS) -> DataFrame:
    """A row a block: its place, and its pixels as bytes, band by band and row by row."""
    register(spark)
    return spark.read.format("raster").schema(columns).load(root)


def xy_of(transform: str, row: Column, col: Column) -> tuple[Column, Column]:
    """The position of a pixel's centre."""
    a, b, c, d, e, f = (F.get(transform, i) for i in range(6))
    return a * (col + 0.5) + b * (row + 0.5) + c, d * (col + 0.5) + e * (row + 0.5) + f


def index_of(transform: str, x: Column, y: Column) -> tuple[Column, Column]:
    """Row and column of the pixel at a position, which may lie outside the raster."""
    a, b, c, d, e, f = (F.get(transform, i) for i in range(6))
    whole = a * e - b * d
    row, col = (a * (y - f) - d * (x - c)) / whole, (e * (x - c) - b * (y - f)) / whole
    return F.floor(row).cast("int"), F.floor(col).cast("int")


def bounds(transform: str) -> Corners:
    """The envelope of a file's corners."""
    a, b, c, d, e, f = (F.get(transform, i) for i in range(6))
    xs = [a * j + b * i + c for i in (F.lit(0), F.col("height")) for j in (F.lit(0), F.col("width"))]
    ys = [d * j + e * i + f for i in (F.lit(0), F.col("height")) for j in (F.lit(0), F.col("width"))]
    return Corners(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


class Blocks:
    """The blocks of the files that a task reads, of which the last ones used are kept."""

    def __init__(self, most: int = KEPT) -> None:
        self.most, self.size, self.path = most, 0, None
        self.kept: OrderedDict[int, np.ndarray] = OrderedDict()

    def turn_to(self, path: str) -> geotiff.Layout:
        if path != self.path:
            self.path, self.size = path, 0
            self.kept.clear()
            self.read = reader(path)
            self.layout = geotiff.layout_of(self.read)
        return self.layout

    def __call__(self, number: int) -> np.ndarray:
        if number in self.kept:
            self.kept.move_to_end(number)
            return self.kept[number]
        found = self.kept[number] = geotiff.block(self.layout, number, self.read)
        self.size += found.nbytes
        while self.size > self.most and len(self.kept) > 1:
            self.size -= self.kept.popitem(last=False)[1].nbytes
        return found


def windows(wanted: DataFrame, outside: str = "error", tasks: int | None = None) -> DataFrame:
    """``wanted`` (path, row, col, height, width and others) with bands, dtype and pixels: each
    window's bytes, of the blocks below it alone. Windows are dealt out in order of file, band of rows
    and place, as many to each task however few the files are, and blocks that a task's windows share
    are read once. Parts beyond the file are no data, or zero;
    a window wholly outside is an error, or with ``outside`` "skip" no row."""
    n = tasks or int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(*(f.name for f in wanted.schema if "map<" not in f.dataType.simpleString()))  # parts even equal windows
    banded = wanted.withColumns({"_band": F.floor(F.col("row") / 2048), "_tie": tie})
    dealt = banded.repartitionByRange(n, "path", "_band", "row", "col", "_tie").sortWithinPartitions("path", "_band", "row", "col").drop("_band", "_tie")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source = Blocks()
        for frame in frames:
            for i in range(len(frame)):
                one = frame.iloc[[i]]
                path, row, col, height, width = (one[c].iloc[0] for c in ("path", "row", "col", "height", "width"))
                layout = source.turn_to(path)
                image = geotiff.window(layout, int(row), int(col), int(height), int(width), source)
                if image is None and outside == "error":
                    raise IndexError(f"the window at row {row}, column {col} is outside of {path}")
                if image is not None:
                    yield one.assign(bands=layout.bands, dtype=layout.dtype.lstrip("<>"), pixels=[image.tobytes()])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema)
    return dealt.mapInPandas(run, f"{own}, bands int, dtype string, pixels binary")


def pixel_rows(images: DataFrame, keep: list[str], without: float | None = None) -> DataFrame:
    """``keep``, band, row, col and v of each pixel of windows or blocks (height, width, dtype,
    pixels), from the image's own first row and column on; but for pixels of the value
    ``without``."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.select(*keep).schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(len(frame)):
                one = frame.iloc[i]
                v = np.frombuffer(one["pixels"], one["dtype"])
                at = np.arange(len(v)) if without is None else np.flatnonzero(v != without)
                if not len(at):
                    continue
                band, row, col = np.unravel_index(at, (len(v) // (int(one["height"]) * int(one["width"])), int(one["height"]), int(one["width"])))
                yield pd.DataFrame({**{c: [one[c]] * len(at) for c in keep}, "band": band, "row": row, "col": col, "v": v[at].astype(np.float64)})

    return images.select(*dict.fromkeys([*keep, "height", "width", "dtype", "pixels"])).mapInPandas(run, f"{kinds}, band int, row int, col int, v double")


def queried(files: DataFrame, queries: DataFrame, key: str, cell: float) -> DataFrame:
    """``key``, band, row, col and v for boxes (x0, y0, x1, y1) of space: from all files of one
    resolution (a catalogue's rows) that a box meets, with the first file by path that has data
    at a pixel. row and col count from the box's upper left pixel. Only pixels of boxes that meet
    several files are shuffled and folded. A box that meets no file has
    no rows; ``unmet`` finds those."""
    box = Corners.named()
    met = overlap_join(queries.select(key, "x0", "y0", "x1", "y1"), files.select("path", "transform", "nodata", F.col("height").alias("_h"), F.col("width").alias("_w"), *bounds("transform").columns("_x0", "_y0", "_x1", "_y1")), box, Corners.named("_x0", "_y0", "_x1", "_y1"), cell)
    top, left = index_of("transform", F.col("x0"), F.col("y1"))
    size = lambda low, high, step: F.greatest(F.lit(1), F.round((F.col(high) - F.col(low)) / F.abs(F.get("transform", step))).cast("int"))
    placed = met.withColumns({"row": top, "col": left, "height": size("y0", "y1", 4), "width": size("x0", "x1", 0)})
    placed = placed.where("row < _h and col < _w and row + height > 0 and col + width > 0")
    counted = placed.withColumn("_files", F.count("*").over(W.partitionBy(key)))

    def seen(some: DataFrame) -> DataFrame:
        images = windows(some.select(key, "path", "nodata", "_h", "_w", F.col("row").alias("_top"), F.col("col").alias("_left"), "row", "col", "height", "width"))
        rows = pixel_rows(images, [key, "path", "nodata", "_h", "_w", "_top", "_left"])
        inside = (F.col("_top") + F.col("row")).between(0, F.col("_h") - 1) & (F.col("_left") + F.col("col")).between(0, F.col("_w") - 1)
        return rows.where(inside & ~F.col("v").eqNullSafe(F.col("nodata")))

    folded = seen(counted.where("_files > 1")).groupBy(key, "band", "row", "col").agg(F.min_by("v", "path").alias("v"))
    return seen(counted.where("_files = 1")).select(*folded.columns).unionByName(folded)


def unmet(files: DataFrame, queries: DataFrame, key: str, cell: float) -> DataFrame:
    """Boxes that meet no file."""
    own = files.select(*bounds("transform").columns("_x0", "_y0", "_x1", "_y1"))
    met = overlap_join(queries.select(key, "x0", "y0", "x1", "y1"), own, Corners.named(), Corners.named("_x0", "_y0", "_x1", "_y1"), cell)
    return queries.join(met.select(key).distinct(), key, "left_anti")


# Writing


def tile_of(rows: pd.DataFrame) -> pd.DataFrame:
    """The deflated tile of one block's pixels."""
    tile = np.zeros((TILE, TILE), np.uint8)
    tile[rows["row"].to_numpy() % TILE, rows["col"].to_numpy() % TILE] = rows["v"].to_numpy()
    return pd.DataFrame({"file": rows["file"].iloc[:1], "number": rows["number"].iloc[:1], "pixels": [zlib.compress(tile.tobytes())]})


def write(pixels: DataFrame, frame: DataFrame, root: str, overwrite: bool = False) -> None:
    """Files of one band of bytes below a folder: ``pixels`` (file, row, col, v from 0 to 255) on
    frames (file, height, width, transform, epsg), as a catalogue has them. Other pixels are 0;
    files without any are written too; pixels outside their frame are left out, and of several at
    one place the largest stays. Existing files are an error unless they may be overwritten, and
    nothing is written if a task fails. A file's deflated tiles are one task's."""
    register(pixels.sparkSession)
    sized = frame.select("file", "height", "width", "transform", "epsg")
    own = pixels.join(sized.select("file", "height", "width"), "file").where("row >= 0 and row < height and col >= 0 and col < width")
    own = own.withColumn("number", (F.floor(F.col("row") / TILE) * F.ceil(F.col("width") / TILE) + F.floor(F.col("col") / TILE)).cast("int"))
    own = own.groupBy("file", "number", "row", "col").agg(F.max("v").cast("int").alias("v"))
    tiles = own.groupBy("file", "number").applyInPandas(tile_of, "file string, number int, pixels binary")
    empty = sized.select("file", F.lit(None).cast("int").alias("number"), F.lit(None).cast("binary").alias("pixels"))
    rows = tiles.unionByName(empty).join(sized, "file").select("file", "height", "width", "transform", "epsg", "number", "pixels")
    rows.repartition("file").sortWithinPartitions("file", "number").write.format("raster").mode("overwrite" if overwrite else "append").save(root)
