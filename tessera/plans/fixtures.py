"""Imagery-like tables derived from the test tables, in Spark and as SQL with the same
arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
SIZE, STRIDE, EXTENT = 600, 400, 8600
#: No box is wider (l_quantity) or higher (6 * l_linenumber).
BOX_SIZE = 50


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def expr(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.selectExpr(*columns)


def boxes(spark: SparkSession, d: str) -> DataFrame:
    return expr(
        read(spark, d, "lineitem"), *KEY,
        "cast(l_partkey % 400 * 20 as double) x0", "cast(l_suppkey % 400 * 20 as double) y0",
        "l_partkey % 400 * 20 + l_quantity x1", "cast(l_suppkey % 400 * 20 + l_linenumber * 6 as double) y1",
        "case l_returnflag when 'A' then 'tree' when 'N' then 'building' else 'road' end class", "l_discount * 10 score",
    )


def boxes_rel(spark: SparkSession, d: str) -> DataFrame:
    return expr(
        read(spark, d, "lineitem"), *KEY,
        "(l_partkey % 100) / 100D cx", "(l_suppkey % 100) / 100D cy", "l_quantity / 600D w", "l_linenumber * 6 / 600D h",
    )


def tile(spark: SparkSession) -> DataFrame:
    return spark.range(0, 1, 1, 1).selectExpr("'t0' tile", "0D x0", "0D y0", f"{EXTENT}D x1", f"{EXTENT}D y1")


def patches(spark: SparkSession) -> DataFrame:
    from tessera.operators.tiling import grid

    return grid(tile(spark), SIZE, STRIDE).select("patch_seq", "i", "j", "px0", "py0", "px1", "py1")


def marks(paths: DataFrame, root: str) -> None:
    """Makes a file of one byte for each path below a folder, as a mark of what exists (Spark's
    readers pass over empty files)."""
    def run(frames):
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(root)
        for frame in frames:
            for path in frame["path"]:
                files.create_dir(f"{at}/{path.rpartition('/')[0]}", recursive=True)
                with files.open_output_stream(f"{at}/{path}") as out:
                    out.write(b"\0")
            yield frame[:0]

    paths.select("path").mapInPandas(run, "path string").write.format("noop").mode("overwrite").save()


def plots(spark: SparkSession, d: str) -> DataFrame:
    """A tile for each part, of different sizes."""
    return expr(
        read(spark, d, "part"), "p_partkey", "cast(p_partkey % 50 * 1000 as double) x0", "cast(p_partkey % 37 * 1000 as double) y0",
        "p_partkey % 50 * 1000 + p_size * 60 + 300D x1", "p_partkey % 37 * 1000 + p_size * 40 + 300D y1",
    )


def plot_patches(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators.raster import spread
    from tessera.operators.tiling import grid

    return grid(spread(plots(spark, d)), SIZE, STRIDE).select("p_partkey", "patch_seq", "i", "j", "px0", "py0", "px1", "py1")


def tiles(spark: SparkSession, d: str) -> DataFrame:
    return expr(
        read(spark, d, "events"),
        "event_type event", "concat('m', user_id % 7) mosaic", "lpad(event_id % 500, 9, '0') img",
        "case when ts < timestamp_ntz'2024-01-15 00:00:00' then 'pre' else 'post' end when", "value area", "event_id", "ts",
    )


def dates(spark: SparkSession, d: str) -> DataFrame:
    """A day for each kind of event but the last."""
    kinds = read(spark, d, "events").select("event_type").distinct()
    last = kinds.agg(F.max("event_type").alias("_last"))
    return kinds.crossJoin(F.broadcast(last)).where("event_type <> _last").selectExpr("event_type event", "date_add(date'2024-01-10', length(event_type)) event_date")


def points(spark: SparkSession, d: str) -> DataFrame:
    return expr(read(spark, d, "customer"), "c_custkey", "c_custkey % 3600 / 10D - 180 lon", "c_custkey * 7 % 1600 / 10D - 80 lat")


def lines(spark: SparkSession, d: str) -> DataFrame:
    x, y = "cast(o_orderkey % 97 * 10 as double)", "cast(o_custkey % 89 * 10 as double)"
    vertices = ", ".join(f"named_struct('x', {x} + {dx}, 'y', {y} + {dy})" for dx, dy in (("0D", "0D"), ("40D", "10D"), ("40D", "-25D")))
    return expr(read(spark, d, "orders"), "o_orderkey", f"array({vertices}) geometry")


def polygons(spark: SparkSession, d: str) -> DataFrame:
    x, y = "cast(p_partkey % 50 * 100 as double)", "cast(p_partkey % 37 * 100 as double)"
    corners = (("0D", "0D"), ("p_size", "0D"), ("p_size", "p_size + 3D"), ("0D", "p_size + 3D"), ("0D", "0D"))
    vertices = ", ".join(f"named_struct('x', {x} + {dx}, 'y', {y} + {dy})" for dx, dy in corners)
    return expr(read(spark, d, "part"), "p_partkey", "p_size", f"array({vertices}) geometry")


def road_json(spark: SparkSession, d: str) -> DataFrame:
    feature = "concat('{\"geometry\":{\"type\":\"LineString\",\"coordinates\":[[', user_id % 50, ',', event_id % 90, '],[', event_id % 70, ',1]]}}')"
    return expr(read(spark, d, "events"), "event_id", f"case when event_id % 7 = 0 then substr({feature}, 1, 3) else {feature} end feature")


def patch_logits(spark: SparkSession, d: str) -> DataFrame:
    return expr(
        read(spark, d, "embeddings"), "vec_id patch_seq", "label image", "embedding",
        "element_at(array('road', 'tree', 'building'), cast(vec_id % 3 as int) + 1) channel", "cast(vec_id % 15 * 4 as int) top", "cast(vec_id * 7 % 15 * 4 as int) left",
    )


BOXES = """boxes AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_partkey % 400 * 20)::DOUBLE AS x0, (l_suppkey % 400 * 20)::DOUBLE AS y0,
  l_partkey % 400 * 20 + l_quantity AS x1, (l_suppkey % 400 * 20 + l_linenumber * 6)::DOUBLE AS y1,
  CASE l_returnflag WHEN 'A' THEN 'tree' WHEN 'N' THEN 'building' ELSE 'road' END AS class, l_discount * 10 AS score FROM lineitem)"""
BOXES_REL = """boxes_rel AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_partkey % 100) / 100::DOUBLE AS cx, (l_suppkey % 100) / 100::DOUBLE AS cy,
  l_quantity / 600::DOUBLE AS w, l_linenumber * 6 / 600::DOUBLE AS h FROM lineitem)"""
PATCHES = """patches AS (SELECT (i * 21 + j)::INT AS patch_seq, i::INT AS i, j::INT AS j, (j * 400)::DOUBLE AS px0, (i * 400)::DOUBLE AS py0,
  (j * 400 + 600)::DOUBLE AS px1, (i * 400 + 600)::DOUBLE AS py1 FROM range(21) a(i), range(21) b(j))"""
PLOTS = f"""plots AS (SELECT p_partkey, (p_partkey % 50 * 1000)::DOUBLE AS x0, (p_partkey % 37 * 1000)::DOUBLE AS y0, greatest(1, ceil((p_size * 60 + 300 - {SIZE}) / {STRIDE}::DOUBLE) + 1)::INT AS cols,
  greatest(1, ceil((p_size * 40 + 300 - {SIZE}) / {STRIDE}::DOUBLE) + 1)::INT AS n FROM part),
patches AS (SELECT p_partkey, (i * cols + j)::INT AS patch_seq, i::INT AS i, j::INT AS j, x0 + j * {STRIDE} AS px0, y0 + i * {STRIDE} AS py0, x0 + j * {STRIDE} + {SIZE} AS px1, y0 + i * {STRIDE} + {SIZE} AS py1
  FROM plots, range(20) a(i), range(20) b(j) WHERE i < n AND j < cols)"""
TILES = """tiles AS (SELECT event_type AS event, 'm' || (user_id % 7) AS mosaic, lpad((event_id % 500)::VARCHAR, 9, '0') AS img,
  CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 'pre' ELSE 'post' END AS "when", value AS area, event_id, ts FROM events)"""
DATES = """dates AS (SELECT DISTINCT event_type AS event, DATE '2024-01-10' + length(event_type)::INT AS event_date FROM events
  WHERE event_type <> (SELECT max(event_type) FROM events))"""
POINTS = "points AS (SELECT c_custkey, c_custkey % 3600 / 10::DOUBLE - 180 AS lon, c_custkey * 7 % 1600 / 10::DOUBLE - 80 AS lat FROM customer)"
LINES = """lines AS (SELECT o_orderkey, (o_orderkey % 97 * 10)::DOUBLE AS x, (o_custkey % 89 * 10)::DOUBLE AS y FROM orders)"""
EDGES = """edges AS (SELECT o_orderkey, 0 AS e, x AS ax, y AS ay, x + 40 AS bx, y + 10 AS "by" FROM lines UNION ALL SELECT o_orderkey, 1, x + 40, y + 10, x + 40, y - 25 FROM lines)"""
POLYGONS = "polygons AS (SELECT p_partkey, p_size, (p_partkey % 50 * 100)::DOUBLE AS x, (p_partkey % 37 * 100)::DOUBLE AS y FROM part)"
LOGITS = """logits AS (SELECT vec_id AS patch_seq, label AS image, ['road', 'tree', 'building'][(vec_id % 3 + 1)::INT] AS channel,
  (vec_id % 15 * 4)::INT AS top, (vec_id * 7 % 15 * 4)::INT AS "left", unnest(embedding) AS v, unnest(range(64)) AS pos FROM embeddings),
pixels AS (SELECT patch_seq, image, channel, top, "left", (pos // 8)::INT AS "row", (pos % 8)::INT AS col, v FROM logits),
canvas AS (SELECT patch_seq, image, channel, (top + "row")::INT AS "row", ("left" + col)::INT AS col, "row" AS r, col AS c, v FROM pixels WHERE top + "row" < 60 AND "left" + col < 60)"""
