"""Positions on the sphere as Column expressions, in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The north galactic pole, ICRS.
POLE_RA, POLE_DEC = 192.85948, 27.12825


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance by haversines, degrees."""
    d1, d2 = F.radians(dec1), F.radians(dec2)
    h = F.pow(F.sin((d2 - d1) / 2.0), 2.0) + F.cos(d1) * F.cos(d2) * F.pow(F.sin(F.radians(ra2 - ra1) / 2.0), 2.0)
    return F.degrees(2.0 * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def galactic_latitude(ra: Column, dec: Column) -> Column:
    d, p = F.radians(dec), F.radians(F.lit(POLE_DEC))
    return F.degrees(F.asin(F.sin(d) * F.sin(p) + F.cos(d) * F.cos(p) * F.cos(F.radians(ra - POLE_RA))))


def in_range(ra: Column, dec: Column) -> Column:
    return F.coalesce(ra.between(0.0, 360.0) & dec.between(-90.0, 90.0), F.lit(False))


def sexagesimal(text: Column, hours: bool = False) -> Column:
    """Degrees of ``dd:mm:ss`` or a plain number; right ascension counts in hours."""
    m = lambda i: F.regexp_extract(F.trim(text), r"^([+-]?)(\d+)[:\s]+(\d+)[:\s]+(\d+(?:\.\d*)?)$", i)
    part = lambda i: m(i).try_cast("double")
    value = (part(2) + part(3) / 60.0 + part(4) / 3600.0) * F.when(m(1) == "-", -1.0).otherwise(1.0) * (15.0 if hours else 1.0) + 0.0  # no negative zero
    return F.coalesce(F.trim(text).try_cast("double"), value)
