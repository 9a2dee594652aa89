"""Policies: thresholds, grids and targets read from a file and given to plans as parameters."""

from __future__ import annotations

import copy
import json

from pyspark.sql import SparkSession

# What a policy says where its file is silent.
USUAL: dict = {
    "t_recall": 0.3493918746,
    "random_seed": 42,
    "qa": {"min_points_per_season": 2, "min_clean_points_total": 4, "min_season_bins_total": 2},
    "gates": {"state_change_ratio": {"r_min": 3.0, "eps": 0.001}, "transient_spike": {"peak_frac": 0.6, "adjacency_frac": 0.2, "min_seasons": 4}},
    "tuning": {
        "r_min_grid": [1.5, 2.0, 2.5, 3.0], "peak_frac_grid": [0.5, 0.6, 0.7], "adjacency_frac_grid": [0.3, 0.4, 0.5], "min_clean_points_total_grid": [10, 12, 14], "min_season_bins_total_grid": [4, 5, 6],
        "class_fp_objective": {"enabled": False, "weights": {}}, "class_fp_caps": {}, "cv_n_splits": 5,
    },
    "acceptance_targets": {"recall_clagn_min": 0.8, "blazar_fpr_max": 0.1, "balanced_accuracy_min": 0.9},
    "evaluation": {"reliability_bins": 10, "recall_at_k": [10, 20, 50], "synthetic_prevalence_shift": [0.05, 0.1, 0.2, 0.5]},
}


def merged(usual: dict, given: dict) -> dict:
    """The given values over the usual ones, mapping by mapping."""
    out = copy.deepcopy(usual)
    for k, v in given.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def read_policy(spark: SparkSession, path: str) -> dict:
    """A JSON policy, or a YAML one where a parser is at hand, from any store that Spark reads.
    Raises where the file is missing or is no mapping."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    try:
        given = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"policy is no JSON, and YAML can't be read here: {path}") from e
        given = yaml.safe_load(text) or {}
    if not isinstance(given, dict):
        raise ValueError(f"policy must be a mapping: {path}")
    return merged(USUAL, given)


def search_settings(policy: dict) -> tuple[dict, dict]:
    """(grid, arguments) for :func:`operators.tuning.search`."""
    t, targets = policy["tuning"], policy["acceptance_targets"]
    grid = {"ratio": t["r_min_grid"], "peak": t["peak_frac_grid"], "near": t["adjacency_frac_grid"], "points": t["min_clean_points_total_grid"], "seasons": t["min_season_bins_total_grid"]}
    objective = t["class_fp_objective"]
    weights = {k: float(v) for k, v in objective["weights"].items()} if objective["enabled"] else {}
    caps = {k: float(v) for k, v in t["class_fp_caps"].items() if v is not None}
    return {k: tuple(sorted(v)) for k, v in grid.items()}, {"recall_target": targets["recall_clagn_min"], "veto_target": targets["blazar_fpr_max"], "caps": caps, "weights": weights}


def accepted(policy: dict, measured: dict[str, float]) -> dict[str, bool]:
    """Which acceptance targets the measures meet; a measure that is missing meets none."""
    out = {}
    for name, target in policy["acceptance_targets"].items():
        key, kind = name.rsplit("_", 1)
        value = measured.get(key)
        out[name] = value is not None and (value >= target if kind == "min" else value <= target)
    return out
