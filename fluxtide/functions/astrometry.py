"""Foreground-star rules on proper motion, parallax and solution quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .params import P
from .photometry import clip


def pm_significance(pmra: Column, pmra_err: Column, pmdec: Column, pmdec_err: Column) -> Column:
    """Total proper motion over its propagated error; null where unknown."""
    total = F.sqrt(pmra * pmra + pmdec * pmdec)
    error = F.try_divide(F.sqrt(F.pow(pmra * pmra_err, 2.0) + F.pow(pmdec * pmdec_err, 2.0)), total)
    known = pmra_err.isNotNull() & pmdec_err.isNotNull()
    return F.when(known & (total < 1e-10), F.lit(0.0)).when(known & (error > 0), F.try_divide(total, error))


def star_verdict(pm_sig: Column, parallax_sig: Column, ruwe: Column) -> dict[str, Column]:
    """reject, reason, confidence, n_criteria: any of parallax, motion, bad solution; a
    mildly bad solution only corroborates; unknown astrometry never rejects."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    plx, pm, hard = yes(parallax_sig > P.max_parallax_sig), yes(pm_sig > P.max_pm_sig), yes(ruwe > P.ruwe_hard)
    soft = yes(ruwe > P.max_ruwe) & ~hard & (plx | pm)
    n = plx.cast("int") + pm.cast("int") + hard.cast("int")
    unknown = pm_sig.isNull() & parallax_sig.isNull()
    reasons = F.array_compact(F.array(F.when(plx, "parallax"), F.when(pm, "proper_motion"), F.when(hard, "ruwe_hard"), F.when(soft, "ruwe_corroborated")))
    return {
        "reject": (plx | pm | hard | soft) & ~unknown,
        "reason": F.when(F.size(reasons) > 0, F.concat_ws("; ", reasons)).otherwise("passes_all"),
        "confidence": F.when(unknown, "unknown").when(n >= 2, "high").when(n == 1, "medium").otherwise("low"),
        "n_criteria": n,
        "requires_confirmation": unknown,
    }


def is_foreground_star(pm_sig: Column, parallax_sig: Column, ruwe: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    return yes(pm_sig > P.max_pm_sig) | yes(parallax_sig > P.max_parallax_sig) | yes(ruwe > P.max_ruwe)


def point_source(ruwe: Column, noise_sig: Column) -> tuple[Column, Column]:
    passes = F.coalesce(ruwe <= P.max_ruwe, F.lit(True))
    flag = F.when(ruwe.isNull(), "ruwe_unknown").when(ruwe > P.max_ruwe, "ruwe_exceeds").when(noise_sig >= 2.0, "excess_noise").otherwise("clean_point_source")
    return passes, flag


def quasar_support(probability: Column) -> Column:
    return F.when(probability.isNull(), "unknown").when(probability > 0.5, "strong_quasar_support").when(probability < 0.1, "low_quasar_prob").otherwise("neutral")


def variability_score(probability: Column, variable: Column) -> Column:
    own = F.coalesce(F.when(probability > 0, probability), F.lit(0.0))
    return clip(F.greatest(own, F.when(F.coalesce(F.upper(variable) == "VARIABLE", F.lit(False)), 0.3).otherwise(0.0)), 0.0, 1.0)


def astrometric_variability(noise: Column, noise_sig: Column, ruwe: Column, pmra: Column, pmra_err: Column, pmdec: Column, pmdec_err: Column, parallax: Column, parallax_err: Column, quasar: Column) -> dict[str, Column]:
    """Excess noise of the astrometric solution as a sign of variability, unless any rule says
    star: parallax or either proper motion above 3 sigma, a bad solution, or a quasar
    probability below 0.1.  Zero and missing values read as the defaults of a quiet source."""
    given = lambda c, d: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(d))
    sig = lambda v, e, least: F.abs(given(v, 0.0)) / F.greatest(given(e, 1.0), F.lit(least))
    pm = F.greatest(sig(pmra, pmra_err, 1e-6), sig(pmdec, pmdec_err, 1e-6))
    plx = F.when(parallax.isNotNull() & parallax_err.isNotNull(), sig(parallax, parallax_err, 1e-10)).otherwise(0.0)
    reasons = F.array_compact(F.array(F.when(plx > 3.0, "parallax"), F.when(pm > 3.0, "proper_motion"), F.when(given(ruwe, 1.0) > 1.4, "ruwe"), F.when(quasar < 0.1, "quasar_probability")))
    star = F.size(reasons) > 0
    varies = (given(noise, 0.0) > 0.5) & (given(noise_sig, 0.0) > 2.0)
    score = F.when(varies & ~star, F.least(F.lit(1.0), given(noise_sig, 0.0) / 10.0)).otherwise(0.0)
    return {"pm_sig": pm, "parallax_sig": plx, "is_variable": varies, "is_star": star, "star_reasons": F.concat_ws("; ", reasons), "score": score}


def colour_variability(bp: Column, rp: Column, bp_rp: Column, flag: Column, quasar: Column) -> dict[str, Column]:
    """Colour (given, else from the two bands), its class, the catalogue's flag of variability
    and whether it is a likely quasar; zero magnitudes are missing ones."""
    given = lambda c: F.nullif(c, F.lit(0.0))
    colour = F.coalesce(given(bp_rp), given(bp) - given(rp))
    kind = F.when(colour < 0.5, "blue").when(colour > 1.5, "red").when(colour.isNotNull(), "intermediate").otherwise("unknown")
    return {"bp_rp": colour, "color_class": kind, "is_variable": F.coalesce(F.upper(flag).contains("VARIABLE"), F.lit(False)), "quasar_prob": F.coalesce(quasar, F.lit(0.0)), "is_quasar": F.coalesce(quasar > 0.5, F.lit(False))}
