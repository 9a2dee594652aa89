"""Physical scales from photometry and timescales, as Column expressions (cgs)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .params import P

# Physical constants (cgs), cosmology, scaling relations.
C, G, PARSEC, SUN = 2.997924e10, 6.674300e-8, 3.085678e18, 1.989000e33
NU_W1, NU_W2 = 3.0e14 / 3.4, 3.0e14 / 4.6
EDDINGTON = 1.26e38
TAU_A, TAU_B, TAU_C = 2.4, 0.17, 0.038
H0, OMEGA_M = 67.4, 0.315
LIGHT_DAYS_PER_PC = 1190.0


def luminosity_distance(z: Column, steps: int = 1000) -> Column:
    """Mpc, flat cosmology, trapezoid rule over ``steps`` intervals."""
    e = lambda x: 1.0 / F.sqrt(OMEGA_M * F.pow(1.0 + x, 3.0) + (1.0 - OMEGA_M))
    inner = F.aggregate(F.sequence(F.lit(1), F.lit(steps - 1)), F.lit(0.0), lambda acc, i: acc + e(z * i / float(steps)))
    integral = (z / float(steps)) * (inner + 0.5 * (e(F.lit(0.0)) + e(z)))
    return F.when(z < 1e-6, 1e-10).otherwise((1.0 + z) * (C / 1e5 / H0) * integral)


def bolometric_luminosity(w1: Column, w2: Column, z: Column, correction: float = 8.0) -> Column:
    flux = P.zero_point_jy["W1"] * F.pow(F.lit(10.0), -0.4 * w1) * 1e-23
    distance = luminosity_distance(z) * (1e6 * PARSEC)
    slope = F.coalesce(-0.4 * (w2 - w1) / math.log10(NU_W2 / NU_W1), F.lit(0.5))
    return F.when(z > 0, correction * 4.0 * math.pi * distance * distance * NU_W1 * flux * F.pow(1.0 + z, slope - 1.0))


def black_hole_mass(tau: Column, luminosity: Column, reliable: Column | None = None) -> Column:
    """Solar masses, the linear scaling relation solved for mass; null if tau is unreliable."""
    log8 = (F.log10(F.greatest(tau, F.lit(1.0))) - TAU_A - TAU_B * F.log10(F.greatest(luminosity / 1e44, F.lit(1e-10)))) / TAU_C
    ok = (tau > 0) & (luminosity > 0)
    return F.when(ok if reliable is None else ok & reliable, F.pow(F.lit(10.0), log8) * 1e8)


def eddington_ratio(luminosity: Column, mass: Column) -> Column:
    return F.when(mass > 0, luminosity / (EDDINGTON * mass))


def sublimation_radius(luminosity: Column, grain: str = "graphite") -> Column:
    """Parsecs."""
    return F.when(luminosity > 0, {"graphite": 0.5, "silicate": 1.3}[grain] * F.sqrt(luminosity / 1e46))


def broad_line_radius(luminosity: Column, correction: float = 20.0) -> Column:
    return F.when(luminosity > 0, 7.2e-3 * F.pow(luminosity / correction / 1e43, 0.532))


def disk_timescales(mass: Column, radius: float = 150.0) -> dict[str, Column]:
    """Days at ``radius`` gravitational radii: light crossing, dynamical, thermal, viscous."""
    grams = mass * SUN
    r = radius * G * grams / (C * C)
    dynamical = F.sqrt(F.pow(r, 3.0) / (G * grams)) / 86400.0
    ok = lambda c: F.when(mass > 0, c)
    return {"light": ok(r / C / 86400.0), "dynamical": ok(dynamical), "thermal": ok(dynamical / 0.1), "viscous": ok(dynamical / 0.1 * 400.0)}


def mechanism(days: Column, scales: dict[str, Column]) -> Column:
    return F.when(days.isNull(), "unknown").when((days < 2.0 * scales["light"]) | (days < 5.0 * scales["thermal"]), "disk_instability").when(days < 2.0 * scales["viscous"], "accretion_rate_change").when(days < 5.0 * scales["viscous"], "viscous_transition").otherwise("external_trigger")


def dust_temperature(w1: Column, w2: Column) -> Column:
    flux = lambda m, b: P.zero_point_jy[b] * F.pow(F.lit(10.0), -0.4 * m)
    return 2000.0 * F.pow(flux(w1, "W1") / flux(w2, "W2"), 0.42)
