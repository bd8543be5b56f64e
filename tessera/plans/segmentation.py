"""From tiles to masks: detect on all patches, filter once, join with features, segment the
boxes, fold the classes on the tile's canvas and resolve overlaps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import SegmentConfig
from tessera.functions.boxes import Corners, area_between, edge_ratio_over
from tessera.operators.raster import best_mask, burn_lines, spread, without_overlap
from tessera.operators.spatial_join import overlap_join
from tessera.operators.tiling import batches, grid, until
from tessera.plans import infer
from tessera.sources.writers import stored


def detections(patches: DataFrame, config: SegmentConfig, detector: Callable = infer.stub_detector, resolution: float = 1.0) -> DataFrame:
    """Boxes in tile coordinates that pass the score, area and edge limits."""
    found = infer.apply_model(patches.select("tile", "patch_seq"), detector, infer.DETECTIONS)
    found = found.where((F.col("score") > config.box_threshold) & (F.col("text_score") > config.text_threshold))
    box = Corners.of_center(F.col("cx"), F.col("cy"), F.col("w") * (1 - config.shrink), F.col("h") * (1 - config.shrink), config.size, config.size)
    sized = found.select("tile", "patch_seq", "box_ix", "score", *box.columns())
    area = Corners.named().area(resolution if config.area_units == "m2" else 1.0)
    kept = sized.where(area_between(area, None, config.max_area_m2) & edge_ratio_over(Corners.named().width(), Corners.named().height(), config.min_edge_ratio))
    placed = kept.join(patches.select("tile", "patch_seq", "px0", "py0"), ["tile", "patch_seq"])
    moved = Corners.named().shifted(F.col("px0"), F.col("py0"))
    return placed.select("tile", "patch_seq", F.lit("tree").alias("channel"), "score", *moved.columns())


def box_masks(tiles: DataFrame, features: DataFrame, config: SegmentConfig, detector: Callable = infer.stub_detector, segmenter: Callable = infer.stub_segmenter) -> DataFrame:
    """The best mask of each box in each patch that it overlaps, in tile coordinates.
    ``features``: tile, channel, score, x0, y0, x1, y1."""
    patches = until(batches(grid(tiles, config.size, config.stride), config.batch_size, ["tile"]), config.last_batch)
    found = stored(detections(patches, config, detector), "detections")
    grown = Corners.named().grown(2 * config.grow_buildings_m)
    named = features.select("tile", F.lit(None).cast("int").alias("patch_seq"), "channel", "score", *(F.when(F.col("channel") == "building", new).otherwise(F.col(c)).alias(c) for new, c in zip((grown.x0, grown.y0, grown.x1, grown.y1), ("x0", "y0", "x1", "y1"), strict=True)))
    boxes = found.unionByName(named)
    b = boxes.select(F.col("tile").alias("_tile"), F.col("patch_seq").alias("_own"), "channel", "score", *Corners.named().columns("bx0", "by0", "bx1", "by1"))
    p = patches.select("tile", "patch_seq", "px0", "py0", "px1", "py1")
    met = overlap_join(p, b, Corners.named("px0", "py0", "px1", "py1"), Corners.named("bx0", "by0", "bx1", "by1"), cell=config.size, size_a=config.size).where("tile = _tile")
    if not config.separate_detection:
        met = met.where("_own is null or _own = patch_seq")
    box_ix = F.xxhash64("bx0", "by0", "bx1", "by1", "channel")
    prompts = met.select("tile", "patch_seq", box_ix.alias("box_ix"), "channel", "score", *Corners.named("bx0", "by0", "bx1", "by1").columns())
    masks = infer.apply_model(prompts, segmenter, infer.MASKS)
    return best_mask(masks, ["tile", "patch_seq", "box_ix", "channel", "x0", "y0", "x1", "y1"], "logit", "quality")


def tile_masks(tiles: DataFrame, features: DataFrame, roads: DataFrame, config: SegmentConfig, cell: int, **models) -> DataFrame:
    """(tile, row, col, channel): the class of each canvas cell of ``cell`` units, at most
    one. ``roads``: tile and geometry, in canvas cells."""
    masks = box_masks(tiles, features, config, **models)
    at = lambda c: F.floor(F.col(c) / cell).cast("int")
    area = ["tile", "patch_seq", "channel"]
    alike = masks.groupBy(*area, at("y0").alias("_top"), at("y1").alias("_low"), at("x0").alias("_a"), at("x1").alias("_b")).agg(F.max("logit").alias("logit"))
    cells = spread(alike).select(*area, "logit", "_a", "_b", F.explode(F.sequence("_top", "_low")).alias("row")).select(*area, "logit", "row", F.explode(F.sequence("_a", "_b")).alias("col"))
    logit = F.max("logit")
    if not config.smooth_overlap:  # the last patch's; plain values, so that sums are hashed, not sorted
        cells, logit = cells.groupBy(*area, "row", "col").agg(F.max("logit").alias("logit")), F.max_by("logit", "patch_seq")
    folded = cells.groupBy("tile", "channel", "row", "col").agg(logit.alias("logit")).where("logit >= 0 and not isnan(logit)").drop("logit")
    size = tiles.agg(F.max((F.col("x1") - F.col("x0")) / cell).cast("int").alias("w"), F.max((F.col("y1") - F.col("y0")) / cell).cast("int").alias("h")).first()
    burnt = burn_lines(roads, "geometry", config.road_width_m / cell, size.h or 0, size.w or 0, ["tile"]).withColumn("channel", F.lit("road"))
    return without_overlap(folded.unionByName(burnt), ["tile", "row", "col"])
