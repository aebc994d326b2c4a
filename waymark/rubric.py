"""The default rubric: anchors, weights and thresholds (fixed values), replaceable by a YAML file of the same shape."""

from __future__ import annotations

# The shipped rubric.
RUBRIC = {
    "anchors": {
        "curviness": [[0, 0.0], [60, 0.25], [120, 0.5], [220, 0.75], [350, 1.0]],
        "corners": [[0, 0.0], [1.5, 0.35], [3, 0.65], [4.5, 0.85], [6, 1.0]],
        "esses": [[0, 0.0], [0.3, 0.4], [0.5, 0.75], [0.7, 1.0]],
        "flow": [[0, 1.0], [0.7, 0.8], [1.5, 0.5], [3, 0.15], [5, 0.0]],
        "straights": {"ideal_min": 0.15, "ideal_max": 0.50, "below": 0.3, "above": 0.3, "peak": 1.0},
        "quiet": [[0.02, 1.0], [0.1, 0.85], [0.25, 0.55], [0.45, 0.2], [0.7, 0.0]],
        "speed": [[15, 0.0], [30, 0.1], [50, 0.45], [60, 0.9], [80, 1.0], [100, 0.65], [130, 0.25]],
        "elevation": [[0, 0.0], [5, 0.25], [10, 0.5], [20, 0.75], [35, 1.0]],
        "grade": [[0, 0.0], [2, 0.2], [4, 0.6], [6, 0.85], [9, 1.0]],
        "scenery": [[0, 0.0], [0.2, 0.3], [0.5, 0.7], [0.8, 1.0]],
    },
    "corner_blend": {"curviness": 0.55, "engaged": 0.45},
    "flow_blend": {"stops": 0.45, "esses": 0.35, "straights": 0.20},
    "weights": {"corners": 0.30, "flow": 0.15, "quiet": 0.15, "speed": 0.15, "elevation": 0.10, "surface": 0.10, "scenery": 0.10},
    "surface_base": {"asphalt": 1.0, "concrete": 0.9, "paved": 0.9, "paving_stones": 0.45, "sett": 0.15, "unpaved": 0.0, "default": 0.6},
    "low_car_penalties": {"speed_bump_each": 0.92, "table_each": 0.95, "narrow_below_4m": 0.8, "very_narrow_below_3m": 0.6, "camera_each": 0.97},
    "routing": {"stretch_min_km": 1.0, "stretch_fun_threshold": 0.55, "stretch_split_gap_m": 400.0, "cluster_radius_m": 6000.0, "overlap_drop_threshold": 0.30},
}


def load_rubric(path: str) -> dict:
    """A rubric from YAML; anchor tables may stand under `points`."""
    import yaml

    with open(path, encoding="utf-8") as f:
        read = yaml.safe_load(f)
    read["anchors"] = {k: v.get("points", v) if isinstance(v, dict) else v for k, v in read["anchors"].items()}
    return RUBRIC | read
