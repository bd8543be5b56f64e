"""Settings of detection and segmentation. A model is passed separately."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class DetectConfig:
    batch_size: int = 1
    size: int = 600
    stride: int = 400
    text_prompt: str = "bush"
    box_threshold: float = 0.15
    text_threshold: float = 0.30
    max_area_m2: float = 6000.0
    min_edge_ratio: float = 0.0
    shrink: float = 0.0
    #: px compares a box's area in pixels with the limit, m2 in square metres.
    area_units: str = "m2"


@dataclass(frozen=True)
class SegmentConfig(DetectConfig):
    road_width_m: float = 5.0
    grow_buildings_m: float = 0.0
    #: The largest score of a pixel over all patches, else the last patch's.
    smooth_overlap: bool = False
    #: Boxes found in a patch are segmented in all patches that they overlap, else in their own.
    separate_detection: bool = False
    #: Stop after this batch; None runs all.
    last_batch: int | None = None


CLASS_DEFAULTS = SegmentConfig()
TILE_RUN = replace(CLASS_DEFAULTS, batch_size=2, stride=400, box_threshold=0.12, text_threshold=0.30)
GLOBAL_RUN = replace(TILE_RUN, separate_detection=True, smooth_overlap=True, min_edge_ratio=0.5)
PRESETS = {"class": CLASS_DEFAULTS, "tile": TILE_RUN, "global": GLOBAL_RUN}
