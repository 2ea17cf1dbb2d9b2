"""Typed settings of both comparisons, lossless to and from a flat dictionary, frozen as JSON for a run."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field


# Names and defaults of the settings, so that files of settings can be read.


@dataclass(frozen=True)
class Identify:
    """Settings of version identification."""

    luma_threshold: float = 32.0
    chroma_threshold: float = 14.0
    tolerance_radius: int = 1
    reference_luma_threshold: float = 10.0
    reference_chroma_threshold: float = 10.0
    border_uniform_tolerance: float = 10.0
    max_border_crop_fraction: float = 0.30
    morph_open: int = 3
    morph_close: int = 25
    region_morph_open: int = 1
    min_region_area_fraction: float = 0.00005
    global_change_area_fraction: float = 0.25
    global_change_min_regions: int = 20
    clean_fraction: float = 0.012
    region_margin_ratio: float = 1.12
    region_signal_cap: float = 3.0
    region_signal_top_fraction: float = 0.05
    single_candidate_accept_below: float | None = None
    extra: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Pairwise:
    """Settings of pairwise comparison."""

    border_uniform_tolerance: float = 10.0
    max_border_crop_fraction: float = 0.30
    registration_max_features: int = 400
    registration_lowe_ratio: float = 0.75
    registration_ransac_reproj_px: float = 3.0
    registration_inliers_ok: int = 30
    registration_inliers_required: int = 15
    registration_max_condition_number: float = 1e6
    registration_min_scale: float = 0.25
    registration_max_scale: float = 4.0
    registration_min_overlap_fraction: float = 0.30
    ssim_window: int = 7
    ssim_threshold: float = 0.30
    chroma_threshold: float = 12.0
    morph_open: int = 3
    morph_close_x: int = 31
    morph_close_y: int = 7
    min_region_area_fraction: float = 0.0005
    max_regions: int = 25
    overlap_erode_px: int = 8
    global_change_area_fraction: float = 0.40
    global_change_min_regions: int = 10
    global_change_min_area_fraction: float = 0.02
    chroma_dominance_fraction: float = 0.75
    unreliable_similarity: float = 0.75
    extra: dict = field(default_factory=dict)


#: Settings that must be positive are all numeric ones but these.
MAY_BE_ZERO = {"tolerance_radius", "overlap_erode_px"}


def from_flat(kind: type, flat: dict):
    """Settings from a flat dictionary; unknown keys are kept, wrong types and values raise."""
    names = {f.name for f in dataclasses.fields(kind)} - {"extra"}
    known = {k: v for k, v in flat.items() if k in names}
    for k, v in known.items():
        if v is None and kind is Identify and k == "single_candidate_accept_below":
            continue
        if isinstance(v, bool) or not isinstance(v, int | float):
            raise TypeError(f"{k} must be a number")
        if v < 0 or (v == 0 and k not in MAY_BE_ZERO):
            raise ValueError(f"{k} must be positive")
    return kind(**known, extra={k: v for k, v in flat.items() if k not in names})


def to_flat(settings) -> dict:
    out = dataclasses.asdict(settings)
    return {**{k: v for k, v in out.items() if k != "extra"}, **out["extra"]}


def frozen(settings) -> str:
    """The JSON that a run keeps; it is part of the key of incremental runs."""
    return json.dumps(to_flat(settings), sort_keys=True)


def load(path: str, kind: type):
    """Settings from a JSON file; a file that is missing or isn't valid gives the defaults."""
    try:
        with open(path, encoding="utf-8") as f:
            return from_flat(kind, json.load(f))
    except (OSError, ValueError, TypeError):
        return kind()


def edited(settings, changes: dict):
    """Settings with changes to known keys, no longer calibrated."""
    unknown = set(changes) - set(to_flat(settings)) | (set(changes) & set(settings.extra))
    if unknown:
        raise KeyError(f"unknown settings: {', '.join(sorted(unknown))}")
    return from_flat(type(settings), {**to_flat(settings), **changes, "calibrated": False})
