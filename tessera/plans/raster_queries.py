"""Registered queries on masks, raster files, polygons of several parts and quadkeys of areas."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions import quadkey as qk
from tessera.operators import offsets, raster, regions, resample, sampling, tiling
from tessera.operators import spatial_join as sj
from tessera.operators.nearest import nearest
from tessera.plans import fixtures as fx
from tessera.plans.queries import box, canvas, drawn, patch, query
from tessera.sources import arrays, rasters, readers, shapefiles, writers
from tessera.sources.writers import folder

# Connected regions


def masks(spark: SparkSession, d: str) -> DataFrame:
    """The pixels of 8 x 8 patches with a logit of 0 or more."""
    return raster.pixels_of(fx.patch_logits(spark, d), "embedding", 8, ["patch_seq"]).where("v >= 0").drop("v")


def frames(spark: SparkSession, d: str) -> DataFrame:
    return fx.patch_logits(spark, d).selectExpr("patch_seq", "8 height", "8 width")


def reached(name: str, of: str) -> str:
    """SQL: from each pixel of a table to all of its region, and the number of those."""
    return f"""{name}_reach AS (SELECT patch_seq, "row", col, "row" AS r, col AS c FROM {of}
  UNION SELECT a.patch_seq, a."row", a.col, m."row", m.col FROM {name}_reach a JOIN {of} m ON a.patch_seq = m.patch_seq AND abs(m."row" - a.r) + abs(m.col - a.c) = 1),
 {name} AS (SELECT patch_seq, "row", col, count(*) AS n, min(r * 8 + c) AS first FROM {name}_reach GROUP BY ALL)"""


SET = 'm AS (SELECT patch_seq, "row", col FROM pixels WHERE v >= 0), rest AS (SELECT patch_seq, "row", col FROM pixels WHERE NOT v >= 0)'


@query(f"""WITH RECURSIVE {fx.LOGITS}, {SET}, {reached("o", "m")} SELECT patch_seq, first // 8 * 4294967296 + first % 8 AS region, count(*) AS n FROM o GROUP BY ALL""")
def q_mask_regions(spark, d):
    """Connected regions and their sizes; blocks of 4 so that regions cross their borders."""
    return regions.sizes(regions.regions(masks(spark, d), ["patch_seq"], block=4), ["patch_seq"])


@query(f"""WITH RECURSIVE {fx.LOGITS}, {SET}, {reached("o", "m")} SELECT patch_seq, "row", col FROM o WHERE n >= 6""")
def q_remove_small_objects(spark, d):
    return regions.without_small_objects(masks(spark, d), ["patch_seq"], 6, block=4)


@query(f"""WITH RECURSIVE {fx.LOGITS}, {SET}, {reached("h", "rest")} SELECT * FROM m UNION ALL SELECT patch_seq, "row", col FROM h WHERE n < 6""")
def q_remove_small_holes(spark, d):
    return regions.without_small_holes(masks(spark, d), ["patch_seq"], frames(spark, d), 6, block=4)


def crossed(name: str, of: str, erode: bool) -> str:
    """SQL: erosion or dilation with a cross of five pixels, within frames of 8 x 8."""
    near = f'FROM pixels p LEFT JOIN {of} m ON m.patch_seq = p.patch_seq AND abs(m."row" - p."row") + abs(m.col - p.col) <= 1 GROUP BY p.patch_seq, p."row", p.col'
    full = '5 - (p."row" = 0)::INT - (p."row" = 7)::INT - (p.col = 0)::INT - (p.col = 7)::INT'
    return f'{name} AS (SELECT p.patch_seq, p."row", p.col {near} HAVING count(m.col) {f"= {full}" if erode else "> 0"})'


@query(f"""WITH RECURSIVE {fx.LOGITS}, {SET}, {reached("h", "rest")}, filled AS (SELECT * FROM m UNION ALL SELECT patch_seq, "row", col FROM h WHERE n < 4), {reached("o", "filled")}, large AS (SELECT patch_seq, "row", col FROM o WHERE n >= 4),
 {crossed("e1", "large", True)}, {crossed("d1", "e1", False)}, {crossed("d2", "d1", False)}, {crossed("e2", "d2", True)} SELECT * FROM e2""")
def q_cleaned_masks(spark, d):
    """Small holes and objects go, then opening and closing."""
    return regions.cleaned(masks(spark, d), ["patch_seq"], frames(spark, d), 4, block=4)


@query(f"""WITH {fx.LOGITS}, m AS (SELECT DISTINCT image, "row", col FROM canvas WHERE v >= 0.1), by3 AS (SELECT image, ("row" + dr)::INT AS r, (col + dc)::INT AS c FROM m, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc)),
 wide AS (SELECT DISTINCT image, r, c FROM by3) SELECT image, (r + dr)::INT AS "row", (c + dc)::INT AS col FROM wide, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc) GROUP BY ALL HAVING count(*) = 9""")
def q_mask_closing(spark, d):
    return raster.closed(canvas(spark, d).where("v >= 0.1").select("image", "row", "col").distinct(), ["image"])


# Raster files

SIDE = 520


def scored(spark: SparkSession, d: str) -> DataFrame:
    """(file, row, col, v): pixels of 0 or more on a canvas for each image, with a number that
    depends on the patch; some patches cross the borders of the files' blocks."""
    own = raster.pixels_of(fx.patch_logits(spark, d), "embedding", 8, ["patch_seq", "image"]).where("v >= 0")
    return own.selectExpr("concat('e', image % 3, '/m', image, '.tif') file", "cast(patch_seq % 15 * 36 + row as int) row", "cast(patch_seq * 7 % 15 * 36 + col as int) col", "cast(1 + patch_seq % 250 as int) v")


def canvases(spark: SparkSession, d: str) -> DataFrame:
    """A frame for each image, side by side."""
    images = fx.read(spark, d, "embeddings").select("label").distinct()
    return images.selectExpr("concat('e', label % 3, '/m', label, '.tif') file", f"{SIDE} height", f"{SIDE} width", f"array(0.5D, 0D, label * {SIDE / 2}D, 0D, -0.5D, {SIDE / 2}D) transform", "32633 epsg", "label image")


def written(spark: SparkSession, d: str) -> str:
    root = folder(spark, "rasters")
    rasters.write(scored(spark, d), canvases(spark, d), root)
    return root


SCORED = f"""{fx.LOGITS}, scored AS (SELECT image, (patch_seq % 15 * 36 + "row")::INT AS "row", (patch_seq * 7 % 15 * 36 + col)::INT AS col, max(1 + patch_seq % 250)::DOUBLE AS v FROM pixels WHERE v >= 0 GROUP BY ALL)"""


@query(f"""WITH {SCORED} SELECT 'e' || (image % 3) || '/m' || image || '.tif' AS file, "row", col, v FROM scored""")
def q_masks_tiff(spark, d):
    """Masks written as GeoTIFF files, and all their blocks read back."""
    root = written(spark, d)
    own = rasters.pixel_rows(rasters.blocks(spark, root), ["path", "top", "left"], without=0)
    return own.select(F.substring("path", len(root) + 2, 1000).alias("file"), (F.col("top") + F.col("row")).alias("row"), (F.col("left") + F.col("col")).alias("col"), "v")


@query(f"""SELECT DISTINCT 'e' || (label % 3) AS event, 'm' || label AS tile, {SIDE}::INT AS height, {SIDE}::INT AS width, 1::INT AS bands, 9::INT AS n_blocks, 32633::INT AS epsg, label * {SIDE / 2}::DOUBLE AS x0, 0.0::DOUBLE AS y0,
 (label + 1) * {SIDE / 2}::DOUBLE AS x1, {SIDE / 2}::DOUBLE AS y1, label * {SIDE / 2}::DOUBLE + 5.25 AS x, {SIDE / 2}::DOUBLE - 1.75 AS y FROM embeddings""")
def q_raster_catalog(spark, d):
    """What the files' directories say, and where the pixel at row 3, column 10 is."""
    files = rasters.catalogue(spark, written(spark, d))
    x, y = rasters.xy_of("transform", F.lit(3), F.lit(10))
    named = [F.regexp_extract("path", r"/(e\d)/(m\d+)\.tif$", i).alias(c) for i, c in ((1, "event"), (2, "tile"))]
    return files.select(*named, "height", "width", "bands", "n_blocks", "epsg", *rasters.bounds("transform").columns(), x.alias("x"), y.alias("y"))


@query(f"""WITH {SCORED}, w AS (SELECT image, k::INT AS k, (k // 3 * 200)::INT AS r0, (k % 3 * 200)::INT AS c0 FROM (SELECT DISTINCT label AS image FROM embeddings), range(9) t(k))
 SELECT w.image, k, count(v) AS n, coalesce(sum(v), 0) AS total FROM w LEFT JOIN scored s ON s.image = w.image AND "row" >= r0 AND "row" < r0 + 210 AND col >= c0 AND col < c0 + 210 GROUP BY ALL""")
def q_raster_windows(spark, d):
    """Overlapping windows of every file, across its blocks and beyond its border."""
    root = written(spark, d)
    at = canvases(spark, d).select("image", F.concat(F.lit(f"{root}/"), "file").alias("path"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"))
    asked = at.selectExpr("image", "k", "path", "cast(k div 3 * 200 as int) row", "k % 3 * 200 col", "210 height", "210 width")
    own = rasters.pixel_rows(rasters.windows(asked), ["image", "k"])
    return own.groupBy("image", "k").agg(F.count_if(F.col("v") > 0).alias("n"), F.sum("v").alias("total"))


ASKED = "s_suppkey AS q, (s_suppkey * 37 % 2500)::DOUBLE AS x0, (s_suppkey * 11 % 240)::DOUBLE AS y0"


@query(f"""WITH {SCORED}, asked AS (SELECT {ASKED} FROM supplier), met AS (SELECT q, v FROM asked JOIN scored ON image * {SIDE} + col >= x0 * 2 AND image * {SIDE} + col < x0 * 2 + 40 AND "row" >= {SIDE} - (y0 + 10) * 2 AND "row" < {SIDE} - y0 * 2)
 SELECT q, count(v) AS n, coalesce(sum(v), 0) AS total FROM asked LEFT JOIN met USING (q) GROUP BY q""")
def q_raster_boxes(spark, d):
    """Pixels in boxes of space, from all the files that a box meets."""
    files = rasters.catalogue(spark, written(spark, d))
    boxes = fx.read(spark, d, "supplier").selectExpr("s_suppkey q", "cast(s_suppkey * 37 % 2500 as double) x0", "cast(s_suppkey * 11 % 240 as double) y0").selectExpr("q", "x0", "y0", "x0 + 20 x1", "y0 + 10 y1")
    return rasters.queried(files, boxes, "q", SIDE / 2).groupBy("q").agg(F.count_if(F.col("v") > 0).alias("n"), F.sum("v").alias("total"))


# Polygons of parts


def shapes(spark: SparkSession, d: str) -> DataFrame:
    """For each part a square with a square hole, and a triangle beside it."""
    x, y, s = "cast(p_partkey % 50 * 100 as double)", "cast(p_partkey % 37 * 100 as double)", "(p_size % 40 + 12D)"
    ring = lambda *corners: f"array({', '.join(f"named_struct('x', {x} + {a}, 'y', {y} + {b})" for a, b in (*corners, corners[0]))})"
    square = ring(("0D", "0D"), (s, "0D"), (s, s), ("0D", s))
    hole = ring(("4D", "4D"), ("4D", "8D"), ("8D", "8D"), ("8D", "4D"))
    triangle = ring(("60D", "0D"), ("90D", "0D"), ("60D", "30D"))
    return fx.expr(fx.read(spark, d, "part"), "p_partkey", f"array(array({square}, {hole}), array({triangle})) parts")


SHAPES = "shapes AS (SELECT p_partkey, (p_partkey % 50 * 100)::DOUBLE AS x, (p_partkey % 37 * 100)::DOUBLE AS y, (p_size % 40 + 12)::DOUBLE AS s FROM part)"
COVERS = "((px - x BETWEEN 0 AND s AND py - y BETWEEN 0 AND s AND NOT (px - x > 4 AND px - x < 8 AND py - y > 4 AND py - y < 8)) OR (px - x >= 60 AND py >= y AND px - x - 60 + py - y <= 30))"


@query(f"""WITH {SHAPES}, p AS (SELECT o_orderkey, (o_orderkey % 2495 * 2)::DOUBLE AS px, (o_custkey % 1835 * 2)::DOUBLE AS py FROM orders) SELECT DISTINCT o_orderkey, p_partkey FROM p JOIN shapes ON {COVERS}""")
def q_point_in_parts(spark, d):
    """Points in polygons with holes and several parts, borders included."""
    points = fx.read(spark, d, "orders").selectExpr("o_orderkey", "cast(o_orderkey % 2495 * 2 as double) px", "cast(o_custkey % 1835 * 2 as double) py")
    return sj.points_in_parts(points, shapes(spark, d), "px", "py", "parts", ["o_orderkey", "p_partkey"], 100, 100)


@query(f"WITH {SHAPES} SELECT p_partkey, s * s - 16 + 450 AS area, x AS x0, y AS y0, x + 90 AS x1, y + greatest(s, 30) AS y1 FROM shapes")
def q_parts_measures(spark, d):
    return shapes(spark, d).select("p_partkey", g.parts_area(F.col("parts")).alias("area"), *g.parts_envelope(F.col("parts")).columns())


@query(f"""WITH {SHAPES}, c AS (SELECT p_partkey, s, x, y, i::INT AS i, j::INT AS j, (j * 2)::DOUBLE AS a, (i * 2)::DOUBLE AS b FROM shapes, range(45) r(i), range(45) q(j) WHERE i < ceil((greatest(s, 30) - 2) / 2) + 1)
 SELECT p_partkey, i, j FROM c WHERE ((a <= s AND b <= s AND NOT (a > 4 AND a + 2 < 8 AND b > 4 AND b + 2 < 8)) OR (a + 2 >= 60 AND greatest(a, 60) - 60 + b <= 30))""")
def q_parts_grid(spark, d):
    """Small patches that meet a polygon, but not those within its hole."""
    tiles = shapes(spark, d).select("p_partkey", "parts", *g.parts_envelope(F.col("parts")).columns())
    return tiling.grid(tiles, 2, 2, "parts").select("p_partkey", "i", "j")


@query(f"""WITH {SHAPES} SELECT p_partkey, 2::INT AS n_parts, 3::INT AS n_rings, s * s - 16 + 450 AS area FROM shapes WHERE p_partkey % 150 IN (3, 77)""")
def q_footprints_parts_file(spark, d):
    """Features of several parts written by quadkey; two keys' files are read by their links."""
    own, at = shapes(spark, d).select(F.lpad((F.col("p_partkey") % 150).cast("string"), 9, "0").alias("QuadKey"), "p_partkey", F.col("parts").alias("geometry")), folder(spark, "footprints")
    writers.geojson_lines(own, at)
    links = own.select(F.lit("here").alias("Location"), "QuadKey", F.concat(F.lit(f"{at}/QuadKey="), "QuadKey").alias("Url")).distinct()
    found = readers.footprints(spark, links, spark.createDataFrame([("000000003",), ("000000077",)], "QuadKey string"))
    return found.select(F.col("properties.p_partkey").cast("long").alias("p_partkey"), F.size("parts").alias("n_parts"), F.size(F.flatten("parts")).alias("n_rings"), g.parts_area(F.col("parts")).alias("area"))


# Nearest place


@query(f"""WITH {fx.POINTS}, city AS (SELECT 'c' || s_suppkey AS city, CASE WHEN s_suppkey = 7 THEN 1e7 ELSE 12 + s_suppkey % 9 / 1e6::DOUBLE END AS clon, CASE WHEN s_suppkey = 7 THEN -1e7 ELSE 45 + s_suppkey % 11 / 1e6::DOUBLE END AS clat FROM supplier)
 SELECT c_custkey, arg_min(city, ((lon - clon) * (lon - clon) + (lat - clat) * (lat - clat), city)) AS city FROM points, city GROUP BY c_custkey""")
def q_nearest_far(spark, d):
    """Nearest places where all but one lie within a few metres and that one is far away."""
    far = "case when s_suppkey = 7 then {far}D else {at} + s_suppkey % {m} / 1000000D end"
    cities = fx.read(spark, d, "supplier").selectExpr("concat('c', s_suppkey) city", f"{far.format(far='10000000', at=12, m=9)} clon", f"{far.format(far='-10000000', at=45, m=11)} clat")
    return nearest(fx.points(spark, d), cities, "lon", "lat", "clon", "clat", ["c_custkey"], "city").select("c_custkey", "city")


# Sizes and sweeps

NEW_SIZES = ((8, 12, 13), (8, 5, 3), (8, 8, 20))


def taps_sql(old: int, new: int) -> str:
    """SQL: the weights of one axis."""
    scale, reach = old / new, max(1.0, old / new)
    near = f"greatest(0.0::DOUBLE, 1 - abs((i - (t + 0.5::DOUBLE) * {scale!r}::DOUBLE + 0.5) / {reach!r}::DOUBLE))"
    span = f"i >= greatest(0, floor((t + 0.5::DOUBLE) * {scale!r}::DOUBLE - {reach!r}::DOUBLE + 0.5)) AND i < least({old}, floor((t + 0.5::DOUBLE) * {scale!r}::DOUBLE + {reach!r}::DOUBLE + 0.5))"
    return f"(SELECT t, i, floor(n / sum(n) OVER (PARTITION BY t) * {1 << 22} + 0.5)::BIGINT AS w FROM (SELECT t, i, {near} AS n FROM range({new}) a(t), range({old}) b(i) WHERE {span}))"


def resized_sql(k: int) -> str:
    old, high, wide = NEW_SIZES[k]
    clip = lambda s: f"least(255, greatest(0, ({s} + {1 << 21}) >> 22))"
    return f"""SELECT patch_seq, y.t::INT AS "row", x.col::INT AS col, {clip("sum(x.v * y.w)::BIGINT")}::INT AS v FROM
 (SELECT patch_seq, "row", c.t AS col, {clip("sum(b.v * c.w)::BIGINT")} AS v FROM bytes b JOIN {taps_sql(old, wide)} c ON b.col = c.i WHERE patch_seq % 3 = {k} GROUP BY ALL) x
 JOIN {taps_sql(old, high)} y ON x."row" = y.i GROUP BY patch_seq, y.t, x.col"""


@query(f"""WITH {fx.LOGITS}, bytes AS (SELECT patch_seq, "row", col, (floor(abs(v) * 1000)::BIGINT % 256) AS v FROM pixels) {" UNION ALL ".join(resized_sql(k) for k in range(len(NEW_SIZES)))}""")
def q_resized_images(spark, d):
    """Images of bytes, larger, smaller and stretched."""
    own = raster.pixels_of(fx.patch_logits(spark, d), "embedding", 8, ["patch_seq"]).withColumn("v", F.floor(F.abs(F.col("v").cast("float")) * F.lit(1000).cast("float")) % 256)  # as SQL: products of floats
    size = lambda i: F.get(F.array(*(F.lit(s[i]) for s in NEW_SIZES)), (F.col("patch_seq") % 3).cast("int"))
    frame = fx.patch_logits(spark, d).select("patch_seq", F.lit(8).alias("height"), F.lit(8).alias("width"), size(1).alias("new_height"), size(2).alias("new_width"))
    return resample.resized(own, ["patch_seq"], frame)


SWEEP, SEEDS = (300, 400, 500, 600, 700), (34, 39, 45, 49, 100)


@query(f"""WITH {fx.BOXES}, tried AS (SELECT size::INT AS size, seed::INT AS seed, {drawn("x", "seed", "size")} * ({fx.EXTENT} - size) AS px0, {drawn("y", "seed", "size")} * ({fx.EXTENT} - size) AS py0 FROM (SELECT unnest({list(SWEEP)}) AS size), (SELECT unnest({list(SEEDS)}) AS seed)),
 met AS (SELECT size, seed, least((x1 - x0) / (y1 - y0), (y1 - y0) / (x1 - x0)) AS edge FROM tried JOIN boxes ON x0 <= px0 + size AND px0 <= x1 AND y0 <= py0 + size AND py0 <= y1)
 SELECT size, seed, k / 10::DOUBLE AS ratio, count(*) AS n FROM met, range(9) t(k) WHERE edge > k / 10::DOUBLE GROUP BY ALL""")
def q_seed_sweep(spark, d):
    """Boxes over an edge ratio in a random patch for each size and seed."""
    each = lambda name, values: F.explode(F.array(*map(F.lit, values))).alias(name)
    tried = fx.tile(spark).select(each("size", SWEEP)).select("size", each("seed", SEEDS))
    at = lambda axis: tiling.draw(F.lit(axis), F.col("seed"), F.col("size")) * (fx.EXTENT - F.col("size"))
    placed = tried.withColumns({"px0": at("x"), "py0": at("y")}).withColumns({"px1": F.col("px0") + F.col("size"), "py1": F.col("py0") + F.col("size")})
    met = sj.overlap_join(placed, fx.boxes(spark, d), patch(), box(), size_a=max(SWEEP), size_b=fx.BOX_SIZE)
    edge = F.least(box().width() / box().height(), box().height() / box().width())
    shapes = met.groupBy("size", "seed", edge.alias("_edge")).agg(F.count("*").alias("_n"))
    ratios = shapes.withColumn("ratio", F.explode(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: k / F.lit(10.0)))).where("_edge > ratio")
    return ratios.groupBy("size", "seed", "ratio").agg(F.sum("_n").alias("n"))


# Quadkeys of areas

AREA_LEVEL, LEAST_LEVEL = 9, 7
AREA = "p_partkey % 340 - 170.5::DOUBLE AS lon0, p_partkey % 120 - 60.25::DOUBLE AS lat0"


def tiles_sql(lon: str, lat: str) -> tuple[str, str]:
    n = 1 << AREA_LEVEL
    x = f"greatest(0, least({n - 1}, floor(({lon} + 180) / 360 * {n})))::INT"
    return x, f"greatest(0, least({n - 1}, floor((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / {math.pi!r}) / 2 * {n})))::INT"


@query(f"""WITH a AS (SELECT p_partkey, {AREA} FROM part), t AS (SELECT p_partkey, {tiles_sql("lon0", "lat0 + 1.5")[0]} AS x0, {tiles_sql("lon0", "lat0 + 1.5")[1]} AS y0, {tiles_sql("lon0 + 2", "lat0")[0]} AS x1, {tiles_sql("lon0 + 2", "lat0")[1]} AS y1 FROM a),
 k AS (SELECT p_partkey, array_to_string(list_transform(range({AREA_LEVEL - 1}, -1, -1), lambda i: ((x >> i) & 1) + 2 * ((y >> i) & 1)), '') AS qk FROM (SELECT p_partkey, y1, y0, unnest(range(x0, x1 + 1)) AS x FROM t) u, LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y))
 SELECT DISTINCT p_partkey, substr(qk, 1, n)::BIGINT AS quadkey FROM k, range({LEAST_LEVEL}, {AREA_LEVEL + 1}) r(n)""")
def q_quadkey_covering(spark, d):
    """The keys, with their parents, of the tiles that an area touches."""
    areas = fx.read(spark, d, "part").selectExpr("p_partkey", "p_partkey % 340 - 170.5D lon0", "p_partkey % 120 - 60.25D lat0")
    keys = qk.covering(F.col("lon0"), F.col("lat0"), F.col("lon0") + 2, F.col("lat0") + 1.5, AREA_LEVEL)
    return areas.select("p_partkey", F.explode(F.transform(qk.with_parents(keys, LEAST_LEVEL, AREA_LEVEL), lambda k: k.cast("long"))).alias("quadkey"))


BOX = (-70.0, -35.5, 40.25, 51.0)


def sorted_points(spark: SparkSession, d: str, level: int = 14) -> DataFrame:
    """Points written in order of their quadkeys."""
    key = qk.quadkey(*qk.tile_of(F.col("lon"), F.col("lat"), level), level)
    return writers.stored(fx.points(spark, d).withColumn("quadkey", key).repartitionByRange("quadkey").sortWithinPartitions("quadkey"), "points")


@query(f"WITH {fx.POINTS} SELECT c_custkey, lon, lat FROM points WHERE lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]}")
def q_quadkey_ranges(spark, d):
    """Points of a box, from a table in order of quadkeys, of which only the box's ranges are read."""
    ranges = qk.key_ranges(qk.cover(*BOX, 9), 14)
    near = sorted_points(spark, d).where(qk.in_ranges(F.col("quadkey"), ranges))
    return near.where(F.col("lon").between(BOX[0], BOX[2]) & F.col("lat").between(BOX[1], BOX[3])).select("c_custkey", "lon", "lat")


# Offset curves

BENT = """bent AS (SELECT o_orderkey, x, y, sqrt(1700::DOUBLE) AS ab, acos(-10 / sqrt(1700::DOUBLE)) AS angle FROM lines)"""


@query(f"""WITH {fx.LINES}, {BENT}, arcs AS (SELECT *, ceil(angle / (pi() / 32)) AS n FROM bent)
 SELECT o_orderkey, 5.0::DOUBLE AS distance, (n + 3)::INT AS n_vertices, round(ab + 35 + n * 10 * sin(angle / n / 2), 6) AS length, round(x - 50 / ab, 6) AS x0, round(y + 200 / ab, 6) AS y0, x + 45 AS x1, y - 25 AS y1 FROM arcs
 UNION ALL SELECT o_orderkey, -5.0, 3, round(ab + 35 - 10 * tan(angle / 2), 6), round(x + 50 / ab, 6), round(y - 200 / ab, 6), x + 35, y - 25 FROM arcs""")
def q_offset_curves(spark, d):
    """Curves on both sides of bent lines: an arc outside, a cut inside."""
    made = offsets.offset_lines(fx.lines(spark, d).select("o_orderkey", "geometry"), "geometry", [5.0, -5.0])
    end = lambda i, c: F.round(F.element_at("geometry", i)[c], 6)
    return made.select("o_orderkey", "distance", F.size("geometry").alias("n_vertices"), F.round(g.length(F.col("geometry")), 6).alias("length"), end(1, "x").alias("x0"), end(1, "y").alias("y0"), end(-1, "x").alias("x1"), end(-1, "y").alias("y1"))


# Shapefiles


@query(f"""WITH {SHAPES} SELECT p_partkey, p_name, p_retailprice AS price, p_size > 25 AS large, 2::INT AS n_parts, 3::INT AS n_rings, s * s - 16 + 450 AS area FROM shapes JOIN part USING (p_partkey)""")
def q_shapefile(spark, d):
    """Polygons and attributes written as shapefiles and read back."""
    at = folder(spark, "shapes")
    own = fx.read(spark, d, "part").selectExpr("p_partkey", "p_name", "p_retailprice price", "p_size > 25 large")
    shapefiles.write(raster.spread(shapes(spark, d).join(own, "p_partkey")), at)  # few bytes, much work
    area, sizes = g.parts_area(F.col("parts")), (F.size("parts"), F.size(F.flatten("parts")))
    return shapefiles.shapes(spark, at).select("p_partkey", "p_name", "price", "large", sizes[0].alias("n_parts"), sizes[1].alias("n_rings"), area.alias("area"))


# Exact samples

DRAWS, DRAWN_SIZE = 500, 5


def shared_sql(seed: str, i: str) -> str:
    return f"('0x' || substr(md5('{seed}|' || {i}), 1, 13))::BIGINT::DOUBLE / {1 << 52}"


@query(f"""WITH {fx.POLYGONS}, rooms AS (SELECT p_partkey, x + CASE WHEN p_size > 5 THEN 2.5 ELSE 0 END AS l, x + p_size - CASE WHEN p_size > 5 THEN 2.5 ELSE 0 END AS r,
  y + CASE WHEN p_size + 3 > 5 THEN 2.5 ELSE 0 END AS b, y + p_size + 3 - CASE WHEN p_size + 3 > 5 THEN 2.5 ELSE 0 END AS t FROM polygons),
 weighed AS (SELECT *, floor((r - l) * (t - b) / (SELECT sum(((r - l) * (t - b))::DECIMAL(38, 12))::DOUBLE FROM rooms) * {1 << 52}::DOUBLE)::BIGINT AS w FROM rooms),
 lined AS (SELECT *, (sum(w) OVER (ORDER BY ('0x' || substr(md5(p_partkey || '|0'), 1, 2))::INT, p_partkey))::BIGINT AS e, (sum(w) OVER ())::BIGINT AS total FROM weighed WHERE w > 0),
 drawn AS (SELECT i, floor({shared_sql("3", "i")} * (SELECT max(total) FROM lined))::BIGINT AS d FROM range({DRAWS}) t(i))
 SELECT p_partkey, l + (r - l) * {shared_sql("3u", "i")} - 2.5 AS px0, b + (t - b) * {shared_sql("3v", "i")} - 2.5 AS py0 FROM drawn JOIN lined ON e - w <= d AND d < e""")
def q_exact_patches(spark, d):
    """As many patches as wanted, with their centres spread evenly over polygons, in one join."""
    tiles = fx.polygons(spark, d).select("p_partkey", "geometry", *g.envelope(F.col("geometry")).columns())
    return sampling.patches_in(tiles, DRAWN_SIZE, DRAWS, 3, "p_partkey", ("geometry",)).select("p_partkey", "px0", "py0")


# Array files


@query("SELECT vec_id, label, 8::INT AS n_rows, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 6) AS total, round(embedding[10]::DOUBLE, 6) AS v9 FROM embeddings")
def q_arrays_file(spark, d):
    """Vectors written as array files of 8 x 8 numbers and read back."""
    at = folder(spark, "arrays")
    named = F.concat(F.lit("l"), F.col("label").cast("string"), F.lit("/"), F.col("vec_id").cast("string"), F.lit(".npy"))
    own = fx.read(spark, d, "embeddings").select(named.alias("path"), F.lit("<f4").alias("dtype"), F.array(F.lit(8), F.lit(8)).alias("shape"), "embedding")
    arrays.write(arrays.packed(own, "embedding", "<f4"), at)
    back = arrays.unpacked(arrays.arrays(spark, at), ["path", "shape"])
    part = lambda i: F.regexp_extract("path", r"/l(\d+)/(\d+)\.npy$", i)
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return back.select(part(2).cast("long").alias("vec_id"), part(1).cast("int").alias("label"), F.get("shape", F.lit(0)).alias("n_rows"), F.round(total, 6).alias("total"), F.round(F.get("values", F.lit(9)), 6).alias("v9"))
