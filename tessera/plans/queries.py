"""The registered queries, each beside the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import SegmentConfig
from tessera.functions import geometry as g
from tessera.functions import quadkey as qk
from tessera.functions import utm
from tessera.functions.boxes import Corners, area_between, edge_ratio_over, rescaled
from tessera.operators import catalog, raster, tiling
from tessera.operators import spatial_join as sj
from tessera.operators.nearest import nearest
from tessera.plans import fixtures as fx
from tessera.plans.segmentation import tile_masks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

K = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def patch() -> Corners:
    return Corners.named("px0", "py0", "px1", "py1")


def box() -> Corners:
    return Corners.named()


def rounded(rows: DataFrame, digits: int, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, digits) for c in columns})


# Boxes


@query(f"""WITH {fx.BOXES_REL} SELECT {K}, round((cx - w * 0.9 / 2) * 600, 6) AS x0, round((cy - h * 0.9 / 2) * 600, 6) AS y0,
 round((cx + w * 0.9 / 2) * 600, 6) AS x1, round((cy + h * 0.9 / 2) * 600, 6) AS y1 FROM boxes_rel""")
def q_box_to_xyxy(spark, d):
    corners = Corners.of_center(F.col("cx"), F.col("cy"), F.col("w") * 0.9, F.col("h") * 0.9, 600, 600)
    return rounded(fx.boxes_rel(spark, d).select(*fx.KEY, *corners.columns()), 6, "x0", "y0", "x1", "y1")


@query(f"""WITH {fx.BOXES_REL} SELECT {K}, round(w * h * 360000 * 0.09, 6) AS area FROM boxes_rel
 WHERE w * h * 360000 * 0.09 > 20 AND w * h * 360000 * 0.09 < 90 AND w / h > 0.5 AND h / w > 0.5""")
def q_box_filter(spark, d):
    w, h = F.col("w"), F.col("h")
    area = w * h * 360000 * 0.09
    kept = fx.boxes_rel(spark, d).where(area_between(area, 20, 90) & edge_ratio_over(w, h, 0.5))
    return kept.select(*fx.KEY, F.round(area, 6).alias("area"))


@query(f"WITH {fx.BOXES} SELECT {K}, (x1 - x0) * (y1 - y0) AS area FROM boxes WHERE (x1 - x0) * (y1 - y0) > 100 AND (x1 - x0) * (y1 - y0) < 600 AND score > 0.15")
def q_box_area_px(spark, d):
    kept = fx.boxes(spark, d).where(area_between(box().area(), 100, 600) & (F.col("score") > 0.15))
    return kept.select(*fx.KEY, box().area().alias("area"))


@query(f"""WITH {fx.BOXES}, {fx.PATCHES} SELECT {K}, patch_seq, (x0 - 1 - px0) / 0.5 AS left_px, (py1 - (y1 + 1)) / 0.5 AS top_px,
 (x1 + 1 - px0) / 0.5 AS right_px, (py1 - (y0 - 1)) / 0.5 AS bottom_px
 FROM boxes JOIN patches ON x0 <= px1 AND px0 <= x1 AND y0 <= py1 AND py0 <= y1""")
def q_geo_to_patch(spark, d):
    met = sj.overlap_join(fx.patches(spark), fx.boxes(spark, d), patch(), box(), fx.SIZE, size_a=fx.SIZE, size_b=fx.BOX_SIZE)
    return met.select(*fx.KEY, "patch_seq", *box().in_patch(F.col("px0"), F.col("py1"), 0.5, 2).columns("left_px", "top_px", "right_px", "bottom_px"))


@query(f"""WITH {fx.BOXES} SELECT {K}, floor((x0 + x1) / 2 / 0.5)::INT AS col, floor((8600 - (y0 + y1) / 2) / 0.5)::INT AS "row",
 (floor((x0 + x1) / 2 / 0.5) + 0.5) * 0.5 AS x, 8600 - (floor((8600 - (y0 + y1) / 2) / 0.5) + 0.5) * 0.5 AS y FROM boxes""")
def q_pixel_of_point(spark, d):
    x, y = box().center()
    col, row = F.floor(x / 0.5).cast("int"), F.floor((8600 - y) / 0.5).cast("int")
    return fx.boxes(spark, d).select(*fx.KEY, col.alias("col"), row.alias("row"), ((col + 0.5) * 0.5).alias("x"), (8600 - (row + 0.5) * 0.5).alias("y"))


# Tiling


@query(f"WITH {fx.PLOTS} SELECT p_partkey, patch_seq, i, j, px0, py0, px1, py1 FROM patches")
def q_patches(spark, d):
    return fx.plot_patches(spark, d)


@query(f"WITH {fx.PLOTS} SELECT p_partkey, patch_seq, (patch_seq // 4)::INT AS batch_ix, (patch_seq % 4)::INT AS place FROM patches")
def q_patch_batches(spark, d):
    return tiling.batches(fx.plot_patches(spark, d), 4, ["p_partkey"]).select("p_partkey", "patch_seq", "batch_ix", "place")


@query(f"""WITH {fx.POLYGONS} SELECT p_partkey, (i * cols + j)::INT AS patch_seq, x + j * 10 AS px0, y + i * 10 AS py0
 FROM (SELECT p_partkey, x, y, unnest(range(greatest(1, ceil((p_size + 3 - 15) / 10::DOUBLE) + 1)::INT)) AS i, greatest(1, ceil((p_size - 15) / 10::DOUBLE) + 1)::INT AS cols FROM polygons), range(10) r(j) WHERE j < cols""")
def q_tile_grid(spark, d):
    e = g.envelope(F.col("geometry"))
    tiles = fx.polygons(spark, d).select("p_partkey", "geometry", *e.columns())
    return tiling.grid(tiles, 15, 10, "geometry").select("p_partkey", "patch_seq", "px0", "py0")


def drawn(axis: str, *of: str) -> str:
    return f"('0x' || substr(md5({' || chr(124) || '.join([repr(axis), *of])}), 1, 8))::BIGINT::DOUBLE / 4294967296"


@query(f"""WITH {fx.POLYGONS}, sized AS (SELECT p_partkey, x, y, p_size AS w, p_size + 3 AS h FROM polygons), shared AS (SELECT *, ceil(w * h / (SELECT sum(w * h) FROM sized)::DOUBLE * 100 * 2)::INT + 1 AS n FROM sized),
 tries AS (SELECT *, unnest(range(1, n + 1)) AS k FROM shared),
 placed AS (SELECT p_partkey, x + {drawn("1x", "p_partkey", "k")} * greatest(0.0::DOUBLE, w - 5) AS px0, y + {drawn("1y", "p_partkey", "k")} * greatest(0.0::DOUBLE, h - 5) AS py0, x, y, w, h, k, {drawn("1o", "p_partkey", "k")} AS o FROM tries)
 SELECT p_partkey, px0, py0, px0 + 5 AS px1, py0 + 5 AS py1 FROM placed WHERE px0 + 2.5 >= x AND px0 + 2.5 < x + w AND py0 + 2.5 >= y AND py0 + 2.5 < y + h ORDER BY o, p_partkey, k LIMIT 100""")
def q_random_patches(spark, d):
    e = g.envelope(F.col("geometry"))
    tiles = fx.polygons(spark, d).select("p_partkey", "geometry", *e.columns())
    return tiling.random_patches(tiles, 5, 100, 1, "p_partkey", ("geometry",)).select("p_partkey", "px0", "py0", "px1", "py1")


@query(f"""WITH {fx.TILES}, n AS (SELECT event, img, count(*) OVER (PARTITION BY event) AS n, row_number() OVER (PARTITION BY event ORDER BY {drawn("3", "event", "img")}, img) AS k FROM tiles)
 SELECT event, img FROM n WHERE k <= floor(n * 0.1)""")
def q_random_fraction(spark, d):
    return tiling.random_fraction(fx.tiles(spark, d).select("event", "img"), 0.1, 3, ["event"])


@query(f"""WITH {fx.TILES}, placed AS (SELECT DISTINCT event, "when", (event_id % 40 * 100)::DOUBLE AS x, (event_id % 23 * 100)::DOUBLE AS y FROM tiles)
 SELECT event, x0, y0, (i * cols + j)::INT AS patch_seq FROM (SELECT *, unnest(range(greatest(1, ceil((h - 40) / 30) + 1)::INT)) AS i FROM
 (SELECT DISTINCT a.event, greatest(a.x, b.x) AS x0, greatest(a.y, b.y) AS y0, 150 - abs(a.y - b.y) AS h, greatest(1, ceil((150 - abs(a.x - b.x) - 40) / 30) + 1)::INT AS cols
  FROM placed a JOIN placed b ON a.event = b.event AND a."when" = 'pre' AND b."when" = 'post' AND abs(a.x - b.x) <= 150 AND abs(a.y - b.y) <= 150)), range(10) r(j) WHERE j < cols""")
def q_intersection_grid(spark, d):
    return tiling.grid(prepost(spark, d), 40, 30).select("event", "x0", "y0", "patch_seq")


def prepost(spark: SparkSession, d: str) -> DataFrame:
    """What pre and post tiles of an event have in common."""
    placed = fx.tiles(spark, d).selectExpr("event", "when", "cast(event_id % 40 * 100 as double) x", "cast(event_id % 23 * 100 as double) y").distinct()
    side = lambda w, p: placed.where(F.col("when") == w).select(F.col("event").alias(f"{p}event"), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    a, b = (Corners(F.col(f"{p}x"), F.col(f"{p}y"), F.col(f"{p}x") + 150, F.col(f"{p}y") + 150) for p in "ab")
    met = sj.overlap_join(side("pre", "a"), side("post", "b"), a, b, cell=200).where("aevent = bevent")
    return met.select(F.col("aevent").alias("event"), *a.common(b).columns()).distinct()


@query(f"""WITH {fx.TILES}, placed AS (SELECT DISTINCT event, "when", (event_id % 40 * 100)::DOUBLE AS x, (event_id % 23 * 100)::DOUBLE AS y FROM tiles)
 SELECT DISTINCT a.event, greatest(a.x, b.x) AS x0, greatest(a.y, b.y) AS y0, least(a.x, b.x) + 150 AS x1, least(a.y, b.y) + 150 AS y1
 FROM placed a JOIN placed b ON a.event = b.event AND a."when" = 'pre' AND b."when" = 'post' AND abs(a.x - b.x) <= 150 AND abs(a.y - b.y) <= 150""")
def q_prepost_overlap(spark, d):
    return prepost(spark, d)


# Spatial joins


@query(f"""WITH {fx.BOXES}, {fx.PATCHES} SELECT patch_seq, {K}, class FROM boxes JOIN patches ON x0 <= px1 AND px0 <= x1 AND y0 <= py1 AND py0 <= y1""")
def q_patch_feature_join(spark, d):
    return sj.overlap_join(fx.patches(spark), fx.boxes(spark, d), patch(), box(), fx.SIZE, size_a=fx.SIZE, size_b=fx.BOX_SIZE).select("patch_seq", *fx.KEY, "class")


@query(f"""WITH {fx.BOXES}, {fx.PATCHES} SELECT patch_seq, count(x0) AS n_boxes FROM patches LEFT JOIN boxes ON x0 <= px1 AND px0 <= x1 AND y0 <= py1 AND py0 <= y1 GROUP BY patch_seq""")
def q_boxes_per_patch(spark, d):
    return sj.counts_of(fx.patches(spark), fx.boxes(spark, d), patch(), box(), ["patch_seq"], fx.SIZE, fx.BOX_SIZE)


@query(f"""WITH {fx.BOXES}, {fx.PATCHES}, n AS (SELECT patch_seq, count(*) AS n_boxes FROM patches JOIN boxes ON x0 <= px1 AND px0 <= x1 AND y0 <= py1 AND py0 <= y1 GROUP BY patch_seq HAVING count(*) > 10)
 SELECT patch_seq, n_boxes, row_number() OVER (ORDER BY patch_seq)::INT AS k FROM n""")
def q_patches_over_10(spark, d):
    from pyspark.sql import Window as W

    n = sj.counts_of(fx.patches(spark), fx.boxes(spark, d), patch(), box(), ["patch_seq"], fx.SIZE, fx.BOX_SIZE).where("n_boxes > 10")
    return n.withColumn("k", F.row_number().over(W.partitionBy(F.lit("t0")).orderBy("patch_seq")))  # of the one tile


@query(f"""WITH {fx.BOXES}, {fx.PATCHES}, n AS (SELECT patch_seq, count(*) FILTER (class = 'tree') AS t, count(*) FILTER (class = 'building') AS b FROM patches JOIN boxes ON x0 <= px1 AND px0 <= x1 AND y0 <= py1 AND py0 <= y1 GROUP BY patch_seq)
 SELECT (patch_seq // 16)::INT AS batch_ix, max(t + b) AS max_detections FROM n GROUP BY 1""")
def q_max_detections(spark, d):
    met = sj.overlap_join(fx.patches(spark), fx.boxes(spark, d), patch(), box(), fx.SIZE, size_a=fx.SIZE, size_b=fx.BOX_SIZE)
    n = met.groupBy("patch_seq").agg(F.count_if(F.col("class") == "tree").alias("t"), F.count_if(F.col("class") == "building").alias("b"))
    return n.groupBy(F.floor(F.col("patch_seq") / 16).cast("int").alias("batch_ix")).agg(F.max(F.col("t") + F.col("b")).alias("max_detections"))


HIT = """abs((ax + bx) / 2 - (qx + 20)) <= 20 + abs(bx - ax) / 2 AND abs((ay + "by") / 2 - (qy + 20)) <= 20 + abs("by" - ay) / 2
 AND abs((bx - ax) / 2 * ((ay + "by") / 2 - (qy + 20)) - ("by" - ay) / 2 * ((ax + bx) / 2 - (qx + 20))) <= 20 * abs("by" - ay) / 2 + 20 * abs(bx - ax) / 2"""


@query(f"""WITH {fx.LINES}, {fx.EDGES}, q AS (SELECT (s_suppkey * 97 % 900)::DOUBLE AS qx, (s_suppkey * 61 % 900)::DOUBLE AS qy, s_suppkey AS q FROM supplier)
 SELECT q, count(DISTINCT o_orderkey) AS n_lines FROM q JOIN edges ON {HIT} GROUP BY q""")
def q_line_hits_box(spark, d):
    boxes = fx.read(spark, d, "supplier").selectExpr("s_suppkey q", "cast(s_suppkey * 97 % 900 as double) qx", "cast(s_suppkey * 61 % 900 as double) qy")
    asked = boxes.selectExpr("q", "qx", "qy", "qx + 40 qx1", "qy + 40 qy1")
    return sj.lines_per_box(asked, fx.lines(spark, d), ("qx", "qy", "qx1", "qy1"), "geometry", ["q"], "o_orderkey", 40)


@query(f"""WITH {fx.POLYGONS}, p AS (SELECT o_orderkey, (o_orderkey % 499 * 10 + 3)::DOUBLE AS px, (o_custkey % 367 * 10 + 3)::DOUBLE AS py FROM orders)
 SELECT DISTINCT o_orderkey, p_partkey FROM p JOIN polygons ON px >= x AND px < x + p_size AND py >= y AND py < y + p_size + 3""")
def q_point_in_poly(spark, d):
    points = fx.read(spark, d, "orders").selectExpr("o_orderkey", "cast(o_orderkey % 499 * 10 + 3 as double) px", "cast(o_custkey % 367 * 10 + 3 as double) py")
    return sj.points_in_rings(points, fx.polygons(spark, d), "px", "py", "geometry", ["o_orderkey", "p_partkey"], size=53)


@query(f"""WITH {fx.LINES}, {fx.EDGES}, e AS (SELECT DISTINCT ax, ay, bx, "by" FROM edges), p AS (SELECT (p_partkey % 100 * 10 + 5)::DOUBLE AS x, (p_partkey // 100 * 10 + 7)::DOUBLE AS y, p_partkey AS id FROM part),
 t AS (SELECT id, x, y, ax, ay, bx - ax AS dx, "by" - ay AS dy, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * ("by" - ay)) / ((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)))) AS t
  FROM p JOIN e ON x >= least(ax, bx) - 1 AND x <= greatest(ax, bx) + 1 AND y >= least(ay, "by") - 1 AND y <= greatest(ay, "by") + 1)
 SELECT id, x, y FROM p WHERE id NOT IN (SELECT id FROM t WHERE (x - ax - t * dx) * (x - ax - t * dx) + (y - ay - t * dy) * (y - ay - t * dy) <= 1) AND x < 900 AND y < 900""")
def q_bg_points(spark, d):
    points = fx.read(spark, d, "part").selectExpr("p_partkey id", "cast(p_partkey % 100 * 10 + 5 as double) x", "cast(p_partkey div 100 * 10 + 7 as double) y")
    points = points.where((F.col("x") >= 0) & (F.col("x") < 900) & (F.col("y") >= 0) & (F.col("y") < 900))
    return sj.beyond_lines(points, fx.lines(spark, d), "x", "y", ["id"], "geometry", 1.0).select("id", "x", "y")


@query(f"""WITH {fx.POINTS}, city AS (SELECT 'c' || s_suppkey AS city, (s_suppkey * 37 % 360 - 180)::DOUBLE AS clon, (s_suppkey * 23 % 160 - 80)::DOUBLE AS clat FROM supplier)
 SELECT c_custkey, min((lon - clon) * (lon - clon) + (lat - clat) * (lat - clat)) AS distance2, arg_min(city, ((lon - clon) * (lon - clon) + (lat - clat) * (lat - clat), city)) AS city FROM points, city GROUP BY c_custkey""")
def q_nearest_city(spark, d):
    cities = fx.read(spark, d, "supplier").selectExpr("concat('c', s_suppkey) city", "cast(s_suppkey * 37 % 360 - 180 as double) clon", "cast(s_suppkey * 23 % 160 - 80 as double) clat")
    return nearest(fx.points(spark, d), cities, "lon", "lat", "clon", "clat", ["c_custkey"], "city").select("c_custkey", "distance2", "city")


# Catalogue


@query(f"""WITH {fx.TILES}, {fx.DATES} SELECT event_id, event, CASE WHEN ts::DATE < event_date THEN 'pre' ELSE 'post' END AS "when" FROM tiles JOIN dates USING (event)""")
def q_pre_post_split(spark, d):
    return catalog.split_by_date(fx.tiles(spark, d).drop("when"), fx.dates(spark, d), "ts").select("event_id", "event", "when")


@query(f"""WITH {fx.TILES}, {fx.DATES} SELECT event, count(*) FILTER (ts::DATE < event_date) AS n_pre, count(*) FILTER (ts::DATE >= event_date) AS n_post, count(*) AS n, true AS complete FROM tiles JOIN dates USING (event) GROUP BY event""")
def q_completeness(spark, d):
    return catalog.completeness(catalog.split_by_date(fx.tiles(spark, d).drop("when"), fx.dates(spark, d), "ts"), ["event"])


@query("SELECT n_name AS event_id, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_event_region(spark, d):
    regions = fx.read(spark, d, "region")
    joined = fx.read(spark, d, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("n_name").alias("event_id"), F.col("r_name").alias("region"))


@query(f"WITH {fx.DATES} SELECT DISTINCT event_type AS event FROM events WHERE event_type NOT IN (SELECT event FROM dates)")
def q_events_missing_date(spark, d):
    return catalog.missing(fx.tiles(spark, d), fx.dates(spark, d), "event")


MATCHED = """images AS (SELECT DISTINCT event, "when", mosaic, img FROM tiles),
 both_sides AS (SELECT event, img FROM images GROUP BY event, img HAVING count(DISTINCT "when") = 2), matched AS (SELECT i.* FROM images i JOIN both_sides USING (event, img))"""


@query(f'WITH {fx.TILES}, {MATCHED} SELECT event, "when", mosaic, img FROM matched')
def q_prepost_match(spark, d):
    return catalog.matched(fx.tiles(spark, d))


@query(f'WITH {fx.TILES}, {MATCHED} SELECT event, "when", mosaic, img FROM images EXCEPT SELECT event, "when", mosaic, img FROM matched')
def q_prepost_nonmatch(spark, d):
    return catalog.unmatched(fx.tiles(spark, d))


@query(f"""WITH {fx.TILES}, {MATCHED}, a AS (SELECT event, "when", count(*) AS n_images FROM images GROUP BY ALL), b AS (SELECT event, "when", count(*) AS n_matched FROM matched GROUP BY ALL)
 SELECT event, "when", n_images, coalesce(n_matched, 0) AS n_matched, round(100.0 * coalesce(n_matched, 0)::DOUBLE / n_images, 2) AS percent FROM a LEFT JOIN b USING (event, "when")""")
def q_match_pct(spark, d):
    return catalog.match_rate(fx.tiles(spark, d))


@query(f"WITH {fx.TILES} SELECT event, img, array_to_string(list_sort(list_distinct(list(mosaic))), ',') AS mosaics FROM tiles GROUP BY event, img")
def q_img_mosaics(spark, d):
    return catalog.mosaics_of_images(fx.tiles(spark, d)).withColumn("mosaics", F.array_join("mosaics", ","))


@query(f"""WITH {fx.TILES}, {MATCHED} SELECT event, "when", mosaic, array_to_string(list_sort(list(img)), ',') AS imgs FROM matched GROUP BY ALL""")
def q_mosaic_imgs(spark, d):
    return catalog.images_of_mosaics(fx.tiles(spark, d)).withColumn("imgs", F.array_join("imgs", ","))


@query(f"""WITH {fx.TILES} SELECT event, "when", mosaic, count(*) AS n_images FROM tiles GROUP BY ALL""")
def q_images_per_mosaic(spark, d):
    return fx.tiles(spark, d).groupBy("event", "when", "mosaic").agg(F.count("*").alias("n_images"))


@query(f"WITH {fx.TILES} SELECT event, bool_or(\"when\" = 'pre') AS has_pre, bool_or(\"when\" = 'post') AS has_post FROM tiles GROUP BY event")
def q_has_sides(spark, d):
    return catalog.has_sides(fx.tiles(spark, d))


@query(f"WITH {fx.TILES} SELECT event, count(*) AS n_images, round(sum(area), 4) AS area, grouping(event)::BIGINT AS level FROM tiles GROUP BY ROLLUP (event)")
def q_event_totals_rollup(spark, d):
    return rounded(catalog.totals(fx.tiles(spark, d), "event", "area"), 4, "area")


@query(f"WITH {fx.BOXES} SELECT class, l_linenumber, min(x0) - 5 AS x0, min(y0) - 5 AS y0, max(x1) + 5 AS x1, max(y1) + 5 AS y1 FROM boxes GROUP BY class, l_linenumber")
def q_mosaic_bbox(spark, d):
    return catalog.bounding_box(fx.boxes(spark, d), ["class", "l_linenumber"], 10)


@query("SELECT r_name AS region, array_to_string(list_sort(list_distinct(list(n_name))), ',') AS countries FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (SELECT c_nationkey FROM customer) GROUP BY r_name")
def q_region_countries(spark, d):
    nations = fx.read(spark, d, "nation").join(fx.read(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left_semi")
    named = nations.join(fx.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy(F.col("r_name").alias("region")).agg(F.array_join(F.sort_array(F.collect_set("n_name")), ",").alias("countries"))


@query(f"WITH {fx.TILES} SELECT DISTINCT event, mosaic, img FROM tiles WHERE event NOT IN (SELECT event_type FROM events WHERE event_type < 'e') AND mosaic NOT LIKE '%6%'")
def q_incremental(spark, d):
    done = fx.read(spark, d, "events").where("event_type < 'e'").select(F.col("event_type").alias("event")).distinct()
    return catalog.not_done(fx.tiles(spark, d), done, ["event"]).where(~F.col("mosaic").contains("6")).select("event", "mosaic", "img").distinct()


@query("SELECT count(*) FILTER (c_acctbal < 0) AS n_null, count(*) AS n, bool_and(c_custkey >= 0) AS all_keys, bool_or(c_acctbal > 9000) AS any_rich FROM customer")
def q_null_counts(spark, d):
    rows = fx.read(spark, d, "customer").withColumn("b", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    return rows.agg(F.count_if(F.col("b").isNull()).alias("n_null"), F.count("*").alias("n"), F.bool_and(F.col("c_custkey") >= 0).alias("all_keys"), F.bool_or(F.col("b") > 9000).alias("any_rich"))


# Geometries


LEVEL = 9
TILE_SQL = f"""located AS (SELECT c_custkey, greatest(0, least({2**LEVEL - 1}, floor((lon + 180) / 360 * {2**LEVEL})))::INT AS tx,
 greatest(0, least({2**LEVEL - 1}, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / {math.pi!r}) / 2 * {2**LEVEL})))::INT AS ty FROM points),
 keyed AS (SELECT c_custkey, array_to_string(list_transform(range({LEVEL - 1}, -1, -1), lambda i: ((tx >> i) & 1) + 2 * ((ty >> i) & 1)), '') AS qk FROM located)"""


@query(f"WITH {fx.POINTS}, {TILE_SQL} SELECT c_custkey, qk, qk::BIGINT AS qk_int FROM keyed")
def q_quadkeys(spark, d):
    key = qk.quadkey(*qk.tile_of(F.col("lon"), F.col("lat"), LEVEL), LEVEL)
    return fx.points(spark, d).select("c_custkey", key.alias("qk")).withColumn("qk_int", F.col("qk").cast("long"))


@query(f"WITH {fx.POINTS}, {TILE_SQL} SELECT DISTINCT substr(qk, 1, n) AS parent FROM keyed, range(3, 8) t(n)")
def q_quadkey_parents(spark, d):
    key = qk.quadkey(*qk.tile_of(F.col("lon"), F.col("lat"), LEVEL), LEVEL)
    return fx.points(spark, d).select(F.explode(qk.parents(key, 3, 7)).alias("parent")).distinct()


UTM_SQL = " + ".join(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(utm.ALPHA, 1)), " + ".join(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(utm.ALPHA, 1))


@query(f"""WITH {fx.POINTS}, a AS (SELECT c_custkey, lat, (floor((lon + 180) / 6)::INT % 60 + 1)::INT AS zone, radians(lat) AS phi, lon FROM points),
 b AS (SELECT *, radians(lon - (zone * 6 - 183)) AS lam, sinh(atanh(sin(phi)) - {utm.ECCENTRIC!r} * atanh({utm.ECCENTRIC!r} * sin(phi))) AS t FROM a),
 c AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM b)
 SELECT c_custkey, zone, round({utm.EASTING!r} + {utm.SCALE * utm.RADIUS!r} * (eta + {UTM_SQL[0]}), 3) AS easting,
  round({utm.SCALE * utm.RADIUS!r} * (xi + {UTM_SQL[1]}) + CASE WHEN lat < 0 THEN {utm.NORTHING!r} ELSE 0 END, 3) AS northing FROM c""")
def q_utm(spark, d):
    zoned = fx.points(spark, d).withColumn("zone", utm.zone_of(F.col("lon")))
    east, north = utm.to_utm(F.col("lon"), F.col("lat"), F.col("zone"))
    return zoned.select("c_custkey", "zone", F.round(east, 3).alias("easting"), F.round(north, 3).alias("northing"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 2 END::INT AS n_vertices, CASE WHEN event_id % 7 <> 0 THEN (user_id % 50)::DOUBLE END AS x0, CASE WHEN event_id % 7 <> 0 THEN (event_id % 70)::DOUBLE END AS x1 FROM events""")
def q_json_geom(spark, d):
    line = fx.road_json(spark, d).select("event_id", g.line_from_json(F.col("feature")).alias("l"))
    return line.select("event_id", F.size("l").alias("n_vertices"), F.get("l", F.lit(0))["x"].alias("x0"), F.get("l", F.lit(1))["x"].alias("x1"))


@query(f"""WITH {fx.POLYGONS} SELECT p_partkey, x AS x0, y AS y0, x + p_size AS x1, y + p_size + 3 AS y1, round(p_size * (p_size + 3)::DOUBLE, 6) AS area, round(least(p_size / (p_size + 3)::DOUBLE, (p_size + 3) / p_size::DOUBLE), 6) AS ratio, 2 * (2 * p_size + 3)::DOUBLE AS around FROM polygons""")
def q_poly_measures(spark, d):
    shape = F.col("geometry")
    measured = fx.polygons(spark, d).select("p_partkey", *g.envelope(shape).columns(), g.ring_area(shape).alias("area"), g.edge_ratio(shape).alias("ratio"), g.length(shape).alias("around"))
    return rounded(measured, 6, "area", "ratio")


L1 = math.hypot(40, 10)


@query(f"""WITH {fx.LINES} SELECT o_orderkey, n::INT AS n, round(CASE WHEN n * 20 <= {L1!r} THEN x + n * 20 / {L1!r} * 40 ELSE x + 40 END, 6) AS px,
 round(CASE WHEN n * 20 <= {L1!r} THEN y + n * 20 / {L1!r} * 10 ELSE y + 10 - (n * 20 - {L1!r}) END, 6) AS py FROM lines, range(4) t(n)""")
def q_line_points(spark, d):
    along = fx.lines(spark, d).select("o_orderkey", F.posexplode(g.points_along(F.col("geometry"), 20)).alias("n", "p"))
    return along.select("o_orderkey", "n", F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py"))


@query(f"""WITH {fx.LINES}, {fx.EDGES}, o AS (SELECT o_orderkey, e, ax, ay, bx, "by", sqrt((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)) AS n FROM edges)
 SELECT o_orderkey, (2 * e)::INT AS n, round(ax - ("by" - ay) / n * 4, 5) AS px, round(ay + (bx - ax) / n * 4, 5) AS py FROM o UNION ALL
 SELECT o_orderkey, (2 * e + 1)::INT, round(bx - ("by" - ay) / n * 4, 5), round("by" + (bx - ax) / n * 4, 5) FROM o""")
def q_offset_lines(spark, d):
    moved = fx.lines(spark, d).select("o_orderkey", F.posexplode(g.offset(F.col("geometry"), 4.0)).alias("n", "p"))
    return moved.select("o_orderkey", "n", F.round("p.x", 5).alias("px"), F.round("p.y", 5).alias("py"))


# Rasters


NEAR_EDGE = """greatest(0, least(1, ((c + 0.5 - ax) * (bx - ax) + (r + 0.5 - ay) * ("by" - ay)) / ((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay))))"""


@query(f"""WITH {fx.LINES}, {fx.EDGES}, e AS (SELECT DISTINCT ax, ay, bx, "by" FROM edges),
 cells AS (SELECT *, unnest(range(greatest(0, floor(least(ax, bx) - 1.5))::INT, least(999, floor(greatest(ax, bx) + 1.5))::INT + 1)) AS c FROM e),
 grid AS (SELECT *, unnest(range(greatest(0, floor(least(ay, "by") - 1.5))::INT, least(999, floor(greatest(ay, "by") + 1.5))::INT + 1)) AS r FROM cells),
 t AS (SELECT r, c, ax, ay, bx - ax AS dx, "by" - ay AS dy, {NEAR_EDGE} AS t FROM grid)
 SELECT DISTINCT r::INT AS "row", c::INT AS col FROM t WHERE (c + 0.5 - ax - t * dx) * (c + 0.5 - ax - t * dx) + (r + 0.5 - ay - t * dy) * (r + 0.5 - ay - t * dy) <= 2.25""")
def q_road_mask(spark, d):
    return raster.burn_lines(fx.lines(spark, d), "geometry", 1.5, 1000, 1000, [])


@query(f"""WITH {fx.LINES}, {fx.EDGES}, e AS (SELECT DISTINCT ax, ay, bx, "by" FROM edges), set_pixels AS (SELECT DISTINCT (p_partkey * 7 % 1000)::INT AS r, (p_partkey * 13 % 1000)::INT AS c FROM part),
 t AS (SELECT r, c, ax, ay, bx - ax AS dx, "by" - ay AS dy, {NEAR_EDGE} AS t FROM set_pixels JOIN e ON c + 0.5 >= least(ax, bx) - 1.5 AND c + 0.5 <= greatest(ax, bx) + 1.5 AND r + 0.5 >= least(ay, "by") - 1.5 AND r + 0.5 <= greatest(ay, "by") + 1.5)
 SELECT DISTINCT r AS "row", c AS col FROM t WHERE (c + 0.5 - ax - t * dx) * (c + 0.5 - ax - t * dx) + (r + 0.5 - ay - t * dy) * (r + 0.5 - ay - t * dy) <= 2.25""")
def q_mask_clip(spark, d):
    pixels = fx.read(spark, d, "part").selectExpr("cast(p_partkey * 7 % 1000 as int) row", "cast(p_partkey * 13 % 1000 as int) col").distinct()
    return raster.clip_to_lines(pixels, fx.lines(spark, d), "geometry", 1.5, ["row", "col"])


def pixels(spark: SparkSession, d: str) -> DataFrame:
    return raster.pixels_of(fx.patch_logits(spark, d), "embedding", 8, ["patch_seq", "image", "channel", "top", "left"])


def canvas(spark: SparkSession, d: str) -> DataFrame:
    own = pixels(spark, d).withColumns({"r": F.col("row"), "c": F.col("col")})
    return raster.on_canvas(own, "top", "left", 60, 60)


@query(f"""WITH {fx.LOGITS}, frame AS (SELECT image, channel, r::INT AS "row", c::INT AS col FROM (SELECT DISTINCT label AS image FROM embeddings), (SELECT unnest(['road', 'tree', 'building', 'pad']) AS channel), range(8) a(r), range(8) b(c))
 SELECT image, channel, "row", col, coalesce(covered, false) AS covered FROM frame LEFT JOIN (SELECT image, channel, "row", col, bool_or(v >= 0) AS covered FROM pixels GROUP BY ALL) USING (image, channel, "row", col)""")
def q_class_fold_any(spark, d):
    return raster.fold_any(pixels(spark, d), ["image", "channel", "row", "col"], frame(spark, d))


@query(f"""WITH {fx.LOGITS}, frame AS (SELECT image, channel, r::INT AS "row", c::INT AS col FROM (SELECT DISTINCT label AS image FROM embeddings), (SELECT unnest(['road', 'tree', 'building', 'pad']) AS channel), range(8) a(r), range(8) b(c))
 SELECT image, channel, "row", col, coalesce(v::DOUBLE, '-inf'::DOUBLE) AS v FROM frame LEFT JOIN (SELECT image, channel, "row", col, max(v) AS v FROM pixels GROUP BY ALL) USING (image, channel, "row", col)""")
def q_class_fold_max(spark, d):
    return raster.fold_max(pixels(spark, d), ["image", "channel", "row", "col"], frame(spark, d)).withColumn("v", F.col("v").cast("double"))


def frame(spark: SparkSession, d: str) -> DataFrame:
    """Every pixel of every class and image."""
    images = fx.read(spark, d, "embeddings").select(F.col("label").alias("image")).distinct()
    cells = images.select("image", F.explode(F.array(*map(F.lit, ("road", "tree", "building", "pad")))).alias("channel"))
    rows = cells.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(7))))


@query(f"""WITH {fx.LOGITS} SELECT image, "row", col, arg_max(v, patch_seq)::DOUBLE AS v FROM canvas GROUP BY ALL""")
def q_canvas_last(spark, d):
    return raster.blend(canvas(spark, d), ["image", "row", "col"], "last").withColumn("v", F.col("v").cast("double"))


@query(f"""WITH {fx.LOGITS} SELECT image, "row", col, max(v)::DOUBLE AS v FROM canvas GROUP BY ALL""")
def q_canvas_max(spark, d):
    return raster.blend(canvas(spark, d), ["image", "row", "col"], "max").withColumn("v", F.col("v").cast("double"))


@query(f"""WITH {fx.LOGITS} SELECT image, "row", col, round(list_reduce(list(v::DOUBLE ORDER BY patch_seq), lambda a, b: (a + b) / 2), 6) AS v FROM canvas GROUP BY ALL""")
def q_canvas_average(spark, d):
    return rounded(raster.blend(canvas(spark, d), ["image", "row", "col"], "average"), 6, "v")


def spline_list(size: int) -> str:
    tri = [(2 * k + 1) / size if k < size // 2 else 2 - (2 * k + 1) / size for k in range(size)]
    w = [abs(2 * t) ** 2 / 2 if k < size // 4 or k >= size - size // 4 else 1 - abs(2 * (t - 1)) ** 2 / 2 for k, t in enumerate(tri)]
    return "[" + ", ".join(f"{x / (sum(w) / size)!r}::DOUBLE" for x in w) + "]"


@query(f"""WITH {fx.LOGITS} SELECT image, "row", col, round(sum(v::DOUBLE * {spline_list(8)}[r + 1] * {spline_list(8)}[c + 1]), 6) + 0.0::DOUBLE AS v FROM canvas GROUP BY ALL""")
def q_canvas_spline(spark, d):
    weight = raster.spline_weight(F.col("r"), 8) * raster.spline_weight(F.col("c"), 8)
    summed = raster.blend(canvas(spark, d), ["image", "row", "col"], "sum", weight=weight)
    return summed.withColumn("v", F.round("v", 6) + 0.0)  # no negative zero


@query(f"""WITH {fx.LOGITS}, m AS (SELECT DISTINCT image, "row", col, list_position(['road', 'tree', 'building'], channel) AS k FROM canvas WHERE v >= 0)
 SELECT image, "row", col, ['road', 'tree', 'building'][max(k)] AS channel FROM m GROUP BY image, "row", col""")
def q_overlap_resolve(spark, d):
    masks = canvas(spark, d).where(raster.positive(F.col("v"))).select("image", "row", "col", "channel").distinct()
    return raster.without_overlap(masks, ["image", "row", "col"])


@query("""WITH c AS (SELECT label, vec_id, embedding[1]::DOUBLE AS score, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings)
 SELECT label, max(score) AS score, arg_max(total, score) AS total FROM c GROUP BY label""")
def q_best_mask(spark, d):
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x), 4)
    rows = fx.read(spark, d, "embeddings").select("label", total.alias("total"), F.get("embedding", F.lit(0)).cast("double").alias("score"))
    return raster.best_mask(rows, ["label"], "total", "score")


OPEN = """around AS (SELECT image, "row" + dr AS r, col + dc AS c, count(*) AS n FROM m, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc) GROUP BY ALL)"""


@query(f"""WITH {fx.LOGITS}, m AS (SELECT DISTINCT image, "row", col FROM canvas WHERE v >= 0.05), {OPEN}, e AS (SELECT image, r, c FROM around WHERE n = 9)
 SELECT DISTINCT image, (r + dr)::INT AS "row", (c + dc)::INT AS col FROM e, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc)""")
def q_mask_opening(spark, d):
    m = canvas(spark, d).where("v >= 0.05").select("image", "row", "col").distinct()
    return raster.opened(m, ["image"])


@query()
def q_prompts(spark, d):
    """Corner points of each patch's boxes, trees first, padded to the longest."""
    met = sj.overlap_join(fx.patches(spark), fx.boxes(spark, d).where("class <> 'road'"), patch(), box(), fx.SIZE, size_a=fx.SIZE, size_b=fx.BOX_SIZE)
    point = F.array(F.array("x0", "y0"), F.array("x1", "y1"))
    grouped = met.groupBy("patch_seq").agg(F.transform(F.array_sort(F.collect_list(F.struct((F.col("class") == "building").alias("b"), *fx.KEY, point.alias("p")))), lambda s: s["p"]).alias("points"))
    most = grouped.agg(F.max(F.size("points")).alias("_most"))
    padded = grouped.crossJoin(F.broadcast(most)).withColumn("_pad", F.col("_most") - F.size("points"))
    none = F.array(F.array(F.lit(-10.0), F.lit(-10.0)), F.array(F.lit(-10.0), F.lit(-10.0)))
    labels = F.concat(F.array_repeat(F.array(F.lit(2), F.lit(3)), F.size("points")), F.array_repeat(F.array(F.lit(0), F.lit(0)), F.col("_pad")))
    return padded.select("patch_seq", F.concat("points", F.array_repeat(none, F.col("_pad"))).alias("points"), labels.alias("labels"))


@query(f"""WITH {fx.BOXES}, {fx.PATCHES}, met AS (SELECT patch_seq, x0, y0, x1, y1, row_number() OVER (PARTITION BY patch_seq ORDER BY class = 'building', {K}, x0, y0, x1, y1) - 1 AS k FROM boxes JOIN patches ON x0 <= px1 AND px0 <= x1 AND y0 <= py1 AND py0 <= y1 WHERE class <> 'road'),
 most AS (SELECT max(k) + 1 AS n FROM met)
 SELECT p.patch_seq, r.k::INT AS k, coalesce(x0, -10) AS x0, coalesce(y0, -10) AS y0, coalesce(x1, -10) AS x1, coalesce(y1, -10) AS y1, CASE WHEN x0 IS NULL THEN 0 ELSE 2 END::INT AS label
 FROM (SELECT DISTINCT patch_seq FROM met) p CROSS JOIN (SELECT unnest(range(n)) AS k FROM most) r LEFT JOIN met ON met.patch_seq = p.patch_seq AND met.k = r.k""")
def q_prompt_rows(spark, d):
    """The padded prompts, a row a box."""
    label = F.get("labels", F.col("k"))[0].alias("label")
    at = lambda i, j: F.get(F.get("_b", F.lit(i)), F.lit(j))
    rows = q_prompts(spark, d).select("patch_seq", F.posexplode("points").alias("k", "_b"), "labels")
    return rows.select("patch_seq", "k", at(0, 0).alias("x0"), at(0, 1).alias("y0"), at(1, 0).alias("x1"), at(1, 1).alias("y1"), label)


# Ranks, buckets and sweeps


@query(f"""WITH n AS (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank, count(*) OVER () AS n FROM orders)
 SELECT o_orderkey, o_totalprice, rank, round((rank - 1) / (n - 1)::DOUBLE, 9) AS share FROM n""")
def q_ecdf(spark, d):
    return rounded(catalog.ecdf(fx.read(spark, d, "orders"), "o_totalprice", ["o_orderkey"]), 9, "share")


@query(f"""WITH {fx.POLYGONS} SELECT p_partkey, (p_size * (p_size + 3))::DOUBLE AS area, row_number() OVER (ORDER BY p_size * (p_size + 3), p_partkey) AS rank FROM polygons""")
def q_cumcount(spark, d):
    areas = fx.polygons(spark, d).select("p_partkey", g.ring_area(F.col("geometry")).alias("area"))
    return catalog.ecdf(areas, "area", ["p_partkey"]).drop("share")


@query(f"WITH {fx.POLYGONS} SELECT p_partkey, (p_size * (p_size + 3))::DOUBLE AS area FROM polygons ORDER BY p_size DESC, p_partkey LIMIT 5")
def q_topk(spark, d):
    areas = fx.polygons(spark, d).select("p_partkey", g.ring_area(F.col("geometry")).alias("area"))
    return areas.orderBy(F.desc("area"), "p_partkey").limit(5)


BOUNDS = [-50.0, -10.0, -5.0, 0.0, 10.0, 20.0, 50.0]


@query("SELECT (" + " + ".join(f"CASE WHEN c_acctbal / 100 >= {b} THEN 1 ELSE 0 END" for b in BOUNDS) + ")::INT AS bucket, count(*) AS n FROM customer GROUP BY 1")
def q_buckets(spark, d):
    return fx.read(spark, d, "customer").groupBy(catalog.bucket(F.col("c_acctbal") / 100, BOUNDS).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""WITH {fx.BOXES}, edges AS (SELECT least((x1 - x0) / (y1 - y0), (y1 - y0) / (x1 - x0)) AS ratio, count(*) AS n FROM boxes WHERE x1 > x0 AND y1 > y0 GROUP BY 1)
 SELECT size::INT AS size, (k / 10::DOUBLE) AS ratio, sum(n)::BIGINT AS n FROM (SELECT unnest(range(300, 701, 100)) AS size), (SELECT unnest(range(0, 9)) AS k), edges e WHERE e.ratio > k / 10::DOUBLE GROUP BY ALL""")
def q_param_sweep(spark, d):
    ratio = F.least(F.try_divide(box().width(), box().height()), F.try_divide(box().height(), box().width()))
    shapes = fx.boxes(spark, d).groupBy(ratio.alias("_edge")).agg(F.count("*").alias("_n"))
    sweep = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: k / F.lit(10.0))
    tried = shapes.withColumn("ratio", F.explode(sweep)).where("_edge > ratio").groupBy("ratio").agg(F.sum("_n").alias("n"))
    return tried.select(F.explode(F.sequence(F.lit(300), F.lit(700), F.lit(100))).alias("size"), "ratio", "n")


@query()
def q_tile_masks(spark, d):
    """The whole way from a tile to its masks, with stand-ins for the models."""
    features = fx.boxes(spark, d).where("class = 'building'").selectExpr("'t0' tile", "class channel", "score", "x0", "y0", "x1", "y1")
    features = features.groupBy("tile", "channel", "x0", "y0", "x1", "y1").agg(F.max("score").alias("score"))
    roads = fx.lines(spark, d).select(F.lit("t0").alias("tile"), "geometry")
    return tile_masks(fx.tile(spark), features, roads, SegmentConfig(min_edge_ratio=0.2, road_width_m=20.0), 8)


INVERSE = tuple(" ".join(f"- {b!r} * {f}({2 * j} * xi) * {h}({2 * j} * eta)" for j, b in enumerate(utm.BETA, 1)) for f, h in (("sin", "cosh"), ("cos", "sinh")))


@query(f"""WITH {fx.BOXES}, b AS (SELECT class, unnest([0, 1]) AS corner, unnest([min(x0) - 5 + 400000, max(x1) + 5 + 400000]) AS x, unnest([min(y0) - 5 + 4900000, max(y1) + 5 + 4900000]) AS y FROM boxes GROUP BY class),
 s AS (SELECT class, corner, y / {utm.SCALE * utm.RADIUS!r} AS xi, (x - {utm.EASTING!r}) / {utm.SCALE * utm.RADIUS!r} AS eta FROM b),
 k AS (SELECT class, corner, xi {INVERSE[0]} AS p, eta {INVERSE[1]} AS e FROM s), c AS (SELECT *, asin(sin(p) / cosh(e)) AS chi FROM k)
 SELECT class, corner::INT AS corner, round(33 * 6 - 183 + degrees(atan2(sinh(e), cos(p))), 8) AS lon, round(degrees(chi {" ".join(f"+ {x!r} * sin({2 * j} * chi)" for j, x in enumerate(utm.DELTA, 1))}), 8) AS lat FROM c""")
def q_event_bbox_lon_lat(spark, d):
    """Each class's bounding box in a UTM zone, by its corners in degrees."""
    b = catalog.bounding_box(fx.boxes(spark, d), ["class"], 10)
    corners = utm.box_to_lon_lat(F.col("x0") + 400000, F.col("y0") + 4900000, F.col("x1") + 400000, F.col("y1") + 4900000, F.lit(33), F.lit(False))
    pairs = F.array(*(F.struct(F.lit(i).alias("corner"), F.round(corners[2 * i], 8).alias("lon"), F.round(corners[2 * i + 1], 8).alias("lat")) for i in (0, 1)))
    return b.select("class", F.explode(pairs).alias("p")).select("class", "p.*")


@query(f"""WITH {fx.BOXES}, u AS (SELECT class, x0, y0, x1, y1, max(score) AS score FROM boxes GROUP BY ALL), t AS (SELECT *, (x1 - x0) * (y1 - y0) AS a FROM u)
 SELECT class, x0, y0, x1, y1, round(score, 6) AS score FROM t WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.class = t.class AND o.x0 = t.x0 AND o.y0 = t.y0
  AND (o.score > t.score OR (o.score = t.score AND (o.x1, o.y1) > (t.x1, t.y1)))
  AND (least(o.x1, t.x1) - t.x0) * (least(o.y1, t.y1) - t.y0) > 0.5 * (o.a + t.a - (least(o.x1, t.x1) - t.x0) * (least(o.y1, t.y1) - t.y0)))
 AND NOT EXISTS (SELECT 1 FROM t o WHERE o.class = t.class AND (o.x0 <> t.x0 OR o.y0 <> t.y0) AND o.x0 <= t.x1 AND t.x0 <= o.x1 AND o.y0 <= t.y1 AND t.y0 <= o.y1
  AND (o.score > t.score OR (o.score = t.score AND (o.x1, o.y1) > (t.x1, t.y1)))
  AND (least(o.x1, t.x1) - greatest(o.x0, t.x0)) * (least(o.y1, t.y1) - greatest(o.y0, t.y0)) > 0.5 * (o.a + t.a - (least(o.x1, t.x1) - greatest(o.x0, t.x0)) * (least(o.y1, t.y1) - greatest(o.y0, t.y0))))""")
def q_box_dedupe(spark, d):
    """Boxes without those that a better one of their class covers."""
    boxes = fx.boxes(spark, d).groupBy("class", "x0", "y0", "x1", "y1").agg(F.max("score").alias("score"))
    return rounded(sj.without_covered(boxes, "class", "score", 0.5), 6, "score")


@query("SELECT p_partkey, CASE WHEN p_size - 10 >= 0 THEN (p_size - 10) * 1024 / 600::DOUBLE ELSE -1 END AS x, CASE WHEN p_size - 25 >= 0 THEN (p_size - 25) * 1024 / 300::DOUBLE ELSE -1 END AS y FROM part")
def q_rescaled_points(spark, d):
    x, y = F.col("p_size") - 10, F.col("p_size") - 25
    return fx.read(spark, d, "part").select("p_partkey", rescaled(x, 1024, 600).alias("x"), rescaled(y, 1024, 300).alias("y"))


@query("SELECT event_type, event_id, sum(round(value * 100)::BIGINT) OVER (PARTITION BY event_type ORDER BY event_id)::DOUBLE / row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS mean_so_far FROM events")
def q_running_mean(spark, d):
    """In hundredths, so that sums are exact."""
    from pyspark.sql import Window as W

    mean = F.avg(F.round(F.col("value") * 100).cast("long")).over(W.partitionBy("event_type").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0))
    return fx.read(spark, d, "events").select("event_type", "event_id", mean.alias("mean_so_far"))


@query(f"""WITH {fx.TILES} SELECT DISTINCT event, mosaic FROM tiles WHERE "when" = 'pre' INTERSECT SELECT DISTINCT event, mosaic FROM tiles WHERE "when" = 'post'""")
def q_mosaics_on_both_sides(spark, d):
    side = lambda w: catalog.select_when(fx.tiles(spark, d), w).select("event", "mosaic")
    return side("pre").intersect(side("post"))


@query(f"""WITH {fx.TILES} SELECT event, img AS tile, k::INT AS k FROM (SELECT event, img, row_number() OVER (PARTITION BY event ORDER BY img) AS k FROM (SELECT DISTINCT event, img FROM tiles)) WHERE k = 18""")
def q_kth_tile(spark, d):
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy("event").orderBy("tile"))
    return fx.tiles(spark, d).select("event", F.col("img").alias("tile")).distinct().withColumn("k", k).where("k = 18")


@query(f"""WITH {fx.PLOTS}, first AS (SELECT p_partkey, patch_seq, (px0 + px1) / 2 AS cx, (py0 + py1) / 2 AS cy FROM patches)
 SELECT p_partkey, patch_seq, cx, cy FROM first WHERE cx >= 1000 AND cx < 27000 AND cy >= 1000 AND cy < 25000""")
def q_patches_by_center(spark, d):
    x, y = patch().center()
    spots = [(1000.0, 1000.0), (27000.0, 1000.0), (27000.0, 25000.0), (1000.0, 25000.0)]
    return fx.plot_patches(spark, d).select("p_partkey", "patch_seq", x.alias("cx"), y.alias("cy")).where(g.in_fixed_ring(F.col("cx"), F.col("cy"), spots))
