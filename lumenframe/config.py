"""Defaults of the operators, passed as literals into plans."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    max_side: int = 1280
    box_threshold: float = 0.15
    track_threshold: float = 0.30
    dedup_iou: float = 0.70
    semantic_iou: float = 0.02
    mask_overlap: float = 0.05
    box_overlap: float = 0.10
    depth_far_mm: int = 3000
    neighbours: int = 8
    max_tags: int = 8
    fov_degrees: float = 60.0
    erosion: int = 5
    adaptive_erosion: bool = True
    sigma: float = 2.0
    min_clip_pixels: int = 10
    min_inliers: int = 5
    central_fraction: float = 0.5
    transparent_mm: int = 150
    tile: int = 256
    union_pad: int = 10
    ema_keep: float = 0.6
    default_query: str = "object."


DEFAULT = Config()
