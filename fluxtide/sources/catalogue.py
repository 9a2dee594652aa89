"""Source catalogues: aliases of column names, identifiers, validity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import number
from ..functions.params import P
from ..functions.sky import in_range

# Names under which catalogues give positions, redshifts and ids.
ALIASES = {
    "ra": ("ra", "raj2000", "ra_j2000", "ra_deg", "radeg", "_raj2000", "alpha"),
    "dec": ("dec", "dej2000", "decj2000", "dec_j2000", "dec_deg", "dedeg", "_dej2000", "delta", "de"),
    "redshift": ("redshift", "z", "z_spec", "zspec", "z_best", "z_vi"),
    "source_id": ("source_id", "name", "objid", "object", "id", "designation", "sdss_name", "source_name"),
}


def rename_aliases(df: DataFrame) -> DataFrame:
    """The first known alias of each column gets the standard name; case does not matter."""
    have = {c.lower(): c for c in df.columns}
    found = {target: next((have[a] for a in names if a in have), None) for target, names in ALIASES.items()}
    return df.withColumnsRenamed({c: target for target, c in found.items() if c and c != target})


def with_id(df: DataFrame) -> DataFrame:
    """An id from the position where there is none."""
    made = F.concat(F.lit("J"), F.format_string("%.4f", F.col("ra")), F.when(F.col("dec") >= 0, "+").otherwise(""), F.format_string("%.4f", F.col("dec")))
    return df.withColumn("source_id", F.coalesce("source_id", made) if "source_id" in df.columns else made)


def validate(df: DataFrame, low: float = P.min_redshift, high: float = P.max_redshift) -> DataFrame:
    """Rows with a position in range and a redshift within bounds, numbers read from text."""
    typed = df.withColumns({c: number(F.col(c)) for c in ("ra", "dec", "redshift")})
    return with_id(typed).filter((F.col("redshift") > low) & (F.col("redshift") < high) & in_range(F.col("ra"), F.col("dec")))


def removals(df: DataFrame, low: float = P.min_redshift, high: float = P.max_redshift) -> DataFrame:
    """One row: what each filter of :func:`validate` takes away, in order."""
    z = F.col("redshift")
    a, b, c = z.isNotNull(), z.isNotNull() & (z > low), z.isNotNull() & (z > low) & (z < high)
    return df.agg(F.count_if(~a).alias("no_redshift"), F.count_if(a & ~b).alias("too_near"), F.count_if(b & ~c).alias("too_far"), F.count_if(c & ~in_range(F.col("ra"), F.col("dec"))).alias("bad_position"))


def colour_selected(df: DataFrame, colour: str = "w1_minus_w2", cut: float = P.colour_cut) -> DataFrame:
    """Adds pass (unknown passes) and unknown."""
    return df.withColumn("colour_pass", F.coalesce(F.col(colour) > cut, F.lit(True))).withColumn("colour_unknown", F.col(colour).isNull())
