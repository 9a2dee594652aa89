"""Constants that are part of the semantics, in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    # Zero points in Jy, time origin and bin width in days, thresholds, weights.
    zero_point_jy: dict[str, float] = field(default_factory=lambda: {"W1": 309.540, "W2": 171.787, "W3": 31.674, "W4": 8.363})
    days_per_year: float = 365.25
    j2000_mjd: float = 51544.5
    survey_anchor_mjd: float = 55200.0
    half_year_days: float = 182.625
    gap_before_mjd: float = 55340.0
    gap_after_mjd: float = 56650.0
    season_gap_days: float = 120.0
    feature_gap_days: float = 100.0
    visit_gap_days: float = 0.5
    adjacency_days: float = 0.01
    min_baseline_years: float = 7.0
    min_epochs: int = 20
    min_epochs_side: int = 5
    min_redshift: float = 0.002
    max_redshift: float = 5.0
    colour_cut: float = 0.8
    max_pm_sig: float = 3.0
    max_parallax_sig: float = 3.0
    max_ruwe: float = 1.4
    ruwe_hard: float = 2.5
    systematic_floor: float = 0.028
    mad_scale: float = 1.4826
    break_edge: float = 0.15
    stage_a_threshold: float = 0.3493918746
    weights_v1: dict[str, float] = field(default_factory=lambda: {"nonstationarity": 3.0, "delta_mag": 2.5, "changepoint": 2.5, "sf_break": 2.0, "colour": 1.5, "sigma_excess": 1.5, "variability_flag": 1.0})
    weights_v2: dict[str, float] = field(default_factory=lambda: {"nonstationarity": 3.0, "broken": 3.0, "step_process": 2.5, "delta_mag": 2.5, "changepoint": 2.5, "sf_excess": 2.0, "colour": 1.5, "bimodality": 1.5, "variability_flag": 1.5, "sigma_excess": 1.0})
    weights_v3: dict[str, float] = field(default_factory=lambda: {"amplitude": 3.0, "temporal": 3.0, "colour": 2.0, "statistical": 1.5, "astrometric": 0.5})
    penalties: dict[str, float] = field(default_factory=lambda: {"supernova": 0.70, "stellar": 0.50, "artifact": 0.30, "supernova_shape": 0.50, "transient": 0.00, "blazar": 0.30, "dust": 0.70, "reversal": 0.50})
    wilson_z: float = 1.959963984540054


P = Params()
