"""Magnitudes, fluxes and weights as Column expressions.  Positive delta_mag: brighter."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .params import P

LN10_25 = math.log(10.0) / 2.5


def clip(x: Column, low: float, high: float) -> Column:
    """Within bounds; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def finite(x: Column) -> Column:
    """The value, null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def mag_to_flux(mag: Column, band: str = "W1") -> Column:
    """mJy; null outside 0 < mag < 30."""
    return F.when((mag > 0) & (mag < 30), F.lit(P.zero_point_jy[band] * 1000.0) * F.pow(F.lit(10.0), -0.4 * mag))


def mag_error_to_flux_error(mag: Column, error: Column, band: str = "W1") -> Column:
    return mag_to_flux(mag, band) * F.lit(LN10_25) * error


def flux_to_mag(flux: Column, band: str = "W1") -> Column:
    return F.when(flux > 0, -2.5 * F.log10(flux / F.lit(P.zero_point_jy[band] * 1000.0)))


def flux_error_to_mag_error(flux: Column, error: Column) -> Column:
    return F.when(flux > 0, F.lit(1.0 / LN10_25) * error / flux)


def delta_mag(early: Column, late: Column) -> Column:
    return F.when((early > 0) & (late > 0), 2.5 * F.log10(late / early))


def flux_ratio(delta: Column) -> Column:
    return F.pow(F.lit(10.0), delta / 2.5)


def snr_weight(snr1: Column, snr2: Column, moon_separation: Column) -> Column:
    """Mean signal-to-noise, less near the moon."""
    return 0.5 * (snr1 + snr2) * clip((moon_separation - 10.0) / 90.0, 0.1, 1.0)


def noise_weight(error: Column, floor: float = 0.005) -> Column:
    return 1.0 / (error * error + floor * floor)


def host_fraction(z: Column) -> Column:
    return clip(0.5 * F.exp(-z / 0.15), 0.0, 0.95)


def host_flag(fraction: Column) -> Column:
    return F.when(fraction > 0.5, "severe_contamination").when(fraction > 0.3, "moderate_contamination").when(fraction > 0.1, "low_contamination").otherwise("negligible")


def host_corrected(delta: Column, own: Column) -> Column:
    """Undiluted delta_mag, where the source's own share of the flux is at least a fifth."""
    ratio = clip(1.0 + (flux_ratio(delta) - 1.0) / own, 0.01, 100.0)
    return F.when((own >= 0.2) & (own <= 1), 2.5 * F.log10(ratio)).otherwise(delta)


def in_hibernation(mjd: Column, start: float = 55593.0, end: float = 56987.0) -> Column:
    return (mjd > start) & (mjd < end)


def reliable(mag: Column, band: str) -> Column:
    """Between the saturation and the faint limit of the band."""
    bright, faint = {"W1": (8.0, 14.5), "W2": (6.7, 13.7)}[band]
    return F.coalesce((mag > bright) & (mag < faint), F.lit(False))


def saturation_flag(w1: Column, w2: Column) -> Column:
    def part(mag: Column, band: str) -> Column:
        bright, faint = {"W1": (8.0, 14.5), "W2": (6.7, 13.7)}[band]
        return F.when(mag <= bright, F.concat(F.lit(f"{band}="), F.format_number(mag, 1), F.lit(f" saturated (limit: {bright} mag)"))).when(mag >= faint, F.concat(F.lit(f"{band}="), F.format_number(mag, 1), F.lit(f" too faint (limit: {faint} mag)")))

    flags = F.array_compact(F.array(part(w1, "W1"), part(w2, "W2")))
    return F.when(F.size(flags) > 0, F.concat_ws("; ", flags))


def mjd_of(ts: Column) -> Column:
    """Modified Julian date of a timestamp without zone, in days."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) / F.lit(86400e6) + F.lit(40587.0)


def year_of(mjd: Column) -> Column:
    return 2000.0 + (mjd - P.j2000_mjd) / P.days_per_year
