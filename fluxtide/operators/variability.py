"""Amplitudes, coherence, rolling medians and shape tests on seasonal light curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.params import P
from ..functions.photometry import LN10_25, clip
from ..functions.stats import correlation
from .seasons import median_mad, season_fluxes, sessionize


def _delta(early: Column, early_err: Column, late: Column, late_err: Column) -> tuple[Column, Column]:
    ok = (early > 0) & (late > 0)
    error = (1.0 / LN10_25) * F.sqrt(F.pow(early_err / early, 2.0) + F.pow(late_err / late, 2.0))
    return F.when(ok, 2.5 * F.log10(late / early)), F.when(ok, error)


def delta_standard(seasons: DataFrame, keys: list[str], least: int = 4) -> DataFrame:
    """Inverse-variance mean of the last two seasons against the first two; keys with fewer
    than ``least`` seasons have null amplitudes."""
    up, down = Window.partitionBy(*keys).orderBy("season"), Window.partitionBy(*keys).orderBy(F.col("season").desc())
    s = seasons.withColumn("_first", F.row_number().over(up)).withColumn("_last", F.row_number().over(down)).withColumn("_w", 1.0 / (F.col("err") * F.col("err")))

    def mean(which: str) -> tuple[Column, Column, Column]:
        on = F.col(which) <= 2
        weight = F.sum(F.when(on, F.col("_w")))
        return F.sum(F.when(on, F.col("_w") * F.col("med"))) / weight, 1.0 / F.sqrt(weight), 1.0 / F.sqrt(F.sum(F.when(on, 1.0 / (F.col("stat_err") * F.col("stat_err")))))

    (fe, ee, se), (fl, el, sl) = mean("_first"), mean("_last")
    out = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_seasons"), fe.alias("f_early"), ee.alias("e_early"), fl.alias("f_late"), el.alias("e_late"), se.alias("s_early"), sl.alias("s_late"))
    d, err = _delta(F.col("f_early"), F.col("e_early"), F.col("f_late"), F.col("e_late"))
    _, stat = _delta(F.col("f_early"), F.col("s_early"), F.col("f_late"), F.col("s_late"))
    on = F.col("n_seasons") >= least
    return out.select(*keys, "n_seasons", "f_early", "f_late", F.when(on, d).alias("delta_mag"), F.when(on, err).alias("delta_err"), F.when(on, stat).alias("delta_stat_err"))


def delta_minmax(seasons: DataFrame, keys: list[str], least: int = 4) -> DataFrame:
    """Faintest against brightest season, in order of time; the first of equals."""
    pick = lambda col, key: F.min_by(F.struct("season", "med", "err"), F.struct(key, F.col("season"))).alias(col)
    s = seasons.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_seasons"), pick("low", F.col("med")), pick("high", -F.col("med")))
    first = F.col("low.season") <= F.col("high.season")
    a, b = F.when(first, F.col("low")).otherwise(F.col("high")), F.when(first, F.col("high")).otherwise(F.col("low"))
    s = s.withColumn("a", a).withColumn("b", b)
    d, err = _delta(F.col("a.med"), F.col("a.err"), F.col("b.med"), F.col("b.err"))
    on = F.col("n_seasons") >= least
    return s.select(*keys, "n_seasons", F.when(on, d).alias("delta_mag"), F.when(on, err).alias("delta_err"))


def delta_max_contrast(seasons: DataFrame, keys: list[str], least: int = 4) -> DataFrame:
    """The pair of seasons with the highest significance; neighbours are left out where there
    are more than three seasons.  Pairs are of seasons, not epochs: a few per key."""
    w = Window.partitionBy(*keys).orderBy("season")
    s = seasons.withColumn("i", F.row_number().over(w)).withColumn("n_seasons", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    cols = [F.col(k) for k in keys]
    a = s.select(*cols, "n_seasons", F.col("i").alias("i"), F.col("med").alias("fa"), F.col("err").alias("ea"))
    b = s.select(*cols, F.col("i").alias("j"), F.col("med").alias("fb"), F.col("err").alias("eb"))
    pairs = a.join(b, keys).filter((F.col("j") > F.col("i") + 1) | ((F.col("j") == F.col("i") + 1) & (F.col("n_seasons") <= 3)))
    d, err = _delta(F.col("fa"), F.col("ea"), F.col("fb"), F.col("eb"))
    pairs = pairs.withColumn("delta_mag", d).withColumn("delta_err", err).filter((F.col("n_seasons") >= least) & F.col("delta_mag").isNotNull())
    best = F.max_by(F.struct("i", "j", "delta_mag", "delta_err"), F.struct(F.round(F.abs(F.col("delta_mag")) / F.col("delta_err"), 9), -F.col("i"), -F.col("j")))
    return pairs.groupBy(*keys).agg(best.alias("p")).select(*keys, "p.i", "p.j", "p.delta_mag", "p.delta_err")


def best_amplitude(standard: DataFrame, minmax: DataFrame, contrast: DataFrame, keys: list[str]) -> DataFrame:
    """The estimator with the highest significance; the earlier wins a tie."""
    parts = [x.select(*keys, F.lit(k).alias("place"), F.lit(name).alias("method"), "delta_mag", "delta_err") for k, (name, x) in enumerate((("standard", standard), ("min_max", minmax), ("max_contrast", contrast)))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("delta_mag IS NOT NULL AND delta_err > 0")
    best = F.max_by(F.struct("method", "delta_mag", "delta_err"), F.struct(F.round(F.abs(F.col("delta_mag")) / F.col("delta_err"), 9), -F.col("place")))
    return every.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.method", "b.delta_mag", "b.delta_err")


def rolling_median(df: DataFrame, keys: list[str], width: float, value: str = "flux", time: str = "mjd", least: int = 3) -> DataFrame:
    """Adds ``rolling``: median within half the width on either side, of ``least`` points."""
    half = width / 2.0
    over = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {time} RANGE BETWEEN {half!r}D PRECEDING AND {half!r}D FOLLOWING)"
    return df.withColumn("rolling", F.expr(f"CASE WHEN count({value}) {over} >= {least} THEN percentile({value}, 0.5D) {over} END"))


def rolling_ratio(df: DataFrame, keys: list[str], width: float, value: str = "flux", time: str = "mjd") -> DataFrame:
    r = rolling_median(df, keys, width, value, time)
    return r.groupBy(*keys).agg(F.try_divide(F.max("rolling"), F.min("rolling")).alias("flux_ratio"))


def coherence(df: DataFrame, keys: list[str], gap: float, band: str = "band", flux: str = "flux", time: str = "mjd", least: int = 4) -> DataFrame:
    """Weighted correlation of the two bands' seasonal medians, direction and score.

    Seasons come from all epochs of a key, so the bands share them."""
    s = sessionize(df.filter(F.col(band).isin("W1", "W2") & (F.col(flux) > 0)), keys, gap, time)
    m = median_mad(s, [*keys, "season", band], flux).withColumn("e2", F.pow(P.mad_scale * F.col("mad"), 2.0) / F.col("n"))
    one = lambda b, v: F.max(F.when(F.col(band) == b, F.col(v)))
    m = m.groupBy(*keys, "season").agg(one("W1", "med").alias("a"), one("W2", "med").alias("b"), one("W1", "e2").alias("ea"), one("W2", "e2").alias("eb")).filter("a IS NOT NULL AND b IS NOT NULL")
    m = m.withColumn("w", 1.0 / (F.col("ea") + F.col("eb") + 1e-10))
    order = lambda c: (F.min_by(c, "season"), F.max_by(c, "season"), F.avg(c))
    (a0, a1, am), (b0, b1, bm) = order("a"), order("b")
    # Weighted means first: weights differ by many orders where a season has no spread.
    whole = Window.partitionBy(*keys)
    m = m.withColumn("xa", F.col("a") - F.sum(F.expr("w * a")).over(whole) / F.sum("w").over(whole)).withColumn("xb", F.col("b") - F.sum(F.expr("w * b")).over(whole) / F.sum("w").over(whole))
    g = m.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("sw"), F.sum(F.expr("w * xa * xa")).alias("saa"), F.sum(F.expr("w * xb * xb")).alias("sbb"), F.sum(F.expr("w * xa * xb")).alias("sab"), ((a1 - a0) / am).alias("da"), ((b1 - b0) / bm).alias("db"))
    cov, va, vb = F.expr("sab / sw"), F.expr("saa / sw"), F.expr("sbb / sw")
    r = cov / (F.sqrt(va * vb) + 1e-10)
    same = F.when((F.abs("da") < 0.02) | (F.abs("db") < 0.02), None).otherwise(F.signum("da") == F.signum("db"))
    factor = F.when(same.isNull(), 0.75).when(same, 1.0).otherwise(0.5)
    g = g.filter(F.col("n") >= least).withColumn("r", r).withColumn("same", same)
    flag = F.when((F.col("r") > 0.6) & F.coalesce("same", F.lit(False)), "coherent").when(((F.col("r") > 0.6) & F.col("same").isNull()) | (F.col("r") > 0.3), "marginal").otherwise("incoherent")
    return g.withColumn("score", clip(F.greatest(F.col("r"), F.lit(0.0)) * factor, 0.0, 1.0)).withColumn("flag", flag).select(*keys, "n", "r", "same", "score", "flag")


def nonstationarity(df: DataFrame, keys: list[str], width: float = 90.0, sigma: float = 1.0, tau: float = 300.0, z: float = 0.0, flux: str = "flux", err: str = "err", time: str = "mjd") -> DataFrame:
    """Change of the median between halves of the time span's median, over what a damped
    random walk of (sigma, tau) would give."""
    r = rolling_median(df, keys, width, flux, time).withColumn("mid", F.median(time).over(Window.partitionBy(*keys)))
    early = F.col(time) <= F.col("mid")
    half = lambda on: (F.count_if(on), F.coalesce(F.median(F.when(on, F.col("rolling"))), F.median(F.when(on, F.col(flux)))), F.avg(F.when(on, F.col(time))), F.avg(F.when(on, F.col(err) * F.col(err))))
    (n1, m1, t1, v1), (n2, m2, t2, v2) = half(early), half(~early)
    g = r.groupBy(*keys).agg(n1.alias("n1"), n2.alias("n2"), m1.alias("m1"), m2.alias("m2"), t1.alias("t1"), t2.alias("t2"), v1.alias("v1"), v2.alias("v2"))
    lag = (F.col("t2") - F.col("t1")) / (1.0 + z)
    v_lag = 2.0 * sigma * sigma * (1.0 - F.exp(-lag / tau))
    walk = sigma * F.sqrt(2.0 / F.greatest("n1", "n2")) * (1.0 + F.sqrt(F.greatest(v_lag / (sigma * sigma + 1e-30), F.lit(0.01))))
    noise = F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2")
    return g.filter("n1 >= 3 AND n2 >= 3").withColumn("sigma_shift", F.abs(F.col("m2") - F.col("m1")) / F.sqrt(walk * walk + noise)).select(*keys, "m1", "m2", "sigma_shift")


def state_change_ratio(seasons: DataFrame, keys: list[str], least: int = 2, eps: float = 1e-3) -> DataFrame:
    """Per band: range of seasonal medians over the median positive scatter, else over the
    MAD of the medians; the largest over bands.  Needs columns band, med, scatter."""
    g = seasons.withColumn("mm", F.median("med").over(Window.partitionBy(*keys, "band")))
    g = g.groupBy(*keys, "band").agg(F.count(F.lit(1)).alias("n"), (F.max("med") - F.min("med")).alias("range"), F.median(F.when(F.col("scatter") > 0, F.col("scatter"))).alias("typical"), F.median(F.abs(F.col("med") - F.col("mm"))).alias("mad"))
    g = g.filter(F.col("n") >= least).withColumn("ratio", F.col("range") / (F.coalesce("typical", "mad") + eps))
    return g.groupBy(*keys).agg(F.max("ratio").alias("state_change_ratio"))


def transient_spike(seasons: DataFrame, keys: list[str], least: int = 3, adjacency: float = 0.2, peak: float = 0.6) -> DataFrame:
    """Per band the season farthest from the median of the others; how far its neighbours
    and any other season stand from that, relative to the peak.  A key holds few seasons, so
    a band is one sorted array."""
    arr = seasons.groupBy(*keys, "band").agg(F.transform(F.array_sort(F.collect_list(F.struct("season", "med"))), lambda s: s["med"]).alias("v")).filter(F.size("v") >= least)
    rest = lambda j: F.array_sort(F.filter("v", lambda x, i: i != j))

    def middle(a: Column) -> Column:
        n = F.size(a)
        return (F.element_at(a, (F.floor((n - 1) / 2) + 1).cast("int")) + F.element_at(a, (F.floor(n / 2) + 1).cast("int"))) / 2.0

    arr = arr.withColumn("base", F.transform(F.sequence(F.lit(0), F.size("v") - 1), lambda j: middle(rest(j))))
    arr = arr.withColumn("off", F.zip_with("v", "base", lambda v, b: F.round(F.abs(v - b), 9)))
    arr = arr.withColumn("p", (F.array_position("off", F.array_max("off")) - 1).cast("int")).withColumn("b", F.element_at("base", F.col("p") + 1)).withColumn("top", F.abs(F.element_at("v", F.col("p") + 1) - F.col("b")))
    near = F.array_max(F.transform(F.filter("v", lambda x, i: F.abs(i - F.col("p")) == 1), lambda x: F.abs(x - F.col("b"))))
    other = F.array_max(F.transform(F.filter("v", lambda x, i: i != F.col("p")), lambda x: F.abs(x - F.col("b"))))
    g = arr.groupBy(*keys).agg(F.max(F.try_divide(near, F.col("top"))).alias("adjacency"), F.max(F.try_divide(other, F.col("top"))).alias("nonpeak"), F.min(F.size("v")).alias("seasons"))
    return g.withColumn("spike", (F.col("adjacency") < adjacency) & (F.col("nonpeak") < peak))


def supernova_shape(seasons: DataFrame, keys: list[str]) -> DataFrame:
    """One season over 1.5 times the baseline (mean of first and last) whose neighbours stay
    below 1.2 times."""
    w = Window.partitionBy(*keys).orderBy("season")
    whole = Window.partitionBy(*keys)
    s = seasons.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("base", (F.min_by("med", "season").over(whole) + F.max_by("med", "season").over(whole)) / 2.0)
    s = s.withColumn("calm", F.coalesce(F.lag("med").over(w) < 1.2 * F.col("base"), F.lit(True)) & F.coalesce(F.lead("med").over(w) < 1.2 * F.col("base"), F.lit(True))).withColumn("high", F.col("med") > 1.5 * F.col("base"))
    return s.groupBy(*keys).agg(F.max("n").alias("n_seasons"), F.count_if("high").alias("n_high"), F.count_if(F.col("high") & F.col("calm")).alias("n_calm")).withColumn("sn_like", (F.col("n_seasons") >= 3) & (F.col("n_high") == 1) & (F.col("n_calm") == 1))


def paired_seasons(df: DataFrame, keys: list[str], gap: float, flux: str = "flux") -> DataFrame:
    """(keys, season, a, b): seasonal medians of both bands, seasons shared."""
    s = sessionize(df.filter(F.col("band").isin("W1", "W2")), keys, gap)
    m = s.groupBy(*keys, "season").agg(F.median(F.when(F.col("band") == "W1", F.col(flux))).alias("a"), F.median(F.when(F.col("band") == "W2", F.col(flux))).alias("b"))
    return m.filter("a IS NOT NULL AND b IS NOT NULL")


def dust_correlation(pairs: DataFrame, keys: list[str], limit: float = 0.7) -> DataFrame:
    """Correlation of the first band with the difference of the bands."""
    g = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("a"), F.col("a") - F.col("b")).alias("r")).filter("n >= 3")
    return g.withColumn("dusty", F.col("r") > limit)


def colour_reversal(pairs: DataFrame, keys: list[str], steps: int = 2) -> DataFrame:
    """The difference of the bands turns within the first steps."""
    w = Window.partitionBy(*keys).orderBy("season")
    d = pairs.withColumn("c", F.col("a") - F.col("b")).withColumn("i", F.row_number().over(w)).withColumn("d1", F.col("c") - F.lag("c").over(w)).withColumn("d0", F.lag("c").over(w) - F.lag("c", 2).over(w))
    turn = (F.col("d1") * F.col("d0") < 0) & (F.col("i") <= steps + 1)
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(turn), F.lit(False)).alias("reversal")).filter("n >= 3")


def artifact(df: DataFrame, keys: list[str], gap: float, flux: str = "flux", err: str = "err", time: str = "mjd") -> DataFrame:
    """The amplitude without the epoch farthest from the median (robust z of 3 or more, ten
    epochs): true if it goes or falls below 0.6 of what it was."""
    m = median_mad(df, keys, flux).filter("n >= 10 AND mad > 0").select(*keys, "med", "mad")
    far = df.join(m, keys).withColumn("z", F.round(F.abs(F.col(flux) - F.col("med")) / (P.mad_scale * F.col("mad")), 9))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("z").desc(), time))
    far = far.withColumn("place", place)
    worst = far.filter("place = 1 AND z >= 3").select(*keys)
    full = delta_standard(season_fluxes(df.join(worst, keys, "left_semi"), keys, gap, flux, err, time), keys).select(*keys, F.col("delta_mag").alias("d0"))
    less = delta_standard(season_fluxes(far.filter("place > 1 OR z < 3").join(worst, keys, "left_semi").select(df.columns), keys, gap, flux, err, time), keys).select(*keys, F.col("delta_mag").alias("d1"))
    out = full.join(less, keys, "left").filter("d0 IS NOT NULL")
    return out.withColumn("artifact", F.coalesce(F.abs("d1") < 0.6 * F.abs("d0"), F.lit(True)))


def thirds(df: DataFrame, keys: list[str], value: str, time: str = "mjd", cuts: tuple[float, float] = (0.3, 0.7)) -> DataFrame:
    """Medians of the first, middle and last rows in time (30, 40 and 30 percent)."""
    w = Window.partitionBy(*keys)
    p = (F.row_number().over(w.orderBy(time)) - 1) / F.count(F.lit(1)).over(w)
    s = df.withColumn("p", p)
    part = lambda on, n: F.median(F.when(on, F.col(value))).alias(n)
    return s.groupBy(*keys).agg(part(F.col("p") < cuts[0], "first"), part((F.col("p") >= cuts[0]) & (F.col("p") < cuts[1]), "middle"), part(F.col("p") >= cuts[1], "last"))


def band_stats(df: DataFrame, keys: list[str], value: str = "flux", least: int = 3) -> DataFrame:
    """Median, population spread and range of a band, of ``least`` rows or more."""
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.median(value).alias("med"), F.stddev_pop(value).alias("sd"), (F.max(value) - F.min(value)).alias("range"))
    return g.filter(F.col("n") >= least)


def paired_colour(df: DataFrame, keys: list[str], a: str, b: str, least: int = 3) -> DataFrame:
    """Median of the paired difference of two columns."""
    g = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.median(F.col(a) - F.col(b)).alias("colour"))
    return g.filter(F.col("n") >= least)


def rms_ratio(df: DataFrame, keys: list[str], band: str = "band", first: str = "W1", second: str = "W2", value: str = "flux") -> DataFrame:
    """Spread of one band over that of another."""
    of = lambda b: F.stddev_pop(F.when(F.col(band) == b, F.col(value)))
    return df.groupBy(*keys).agg(of(first).alias("rms_a"), of(second).alias("rms_b")).withColumn("ratio", F.try_divide("rms_a", "rms_b"))


def quality_masks(df: DataFrame, snr1: str, snr2: str, least: float = 3.0) -> DataFrame:
    """Adds ok_w1, ok_w2 and ok_joint; unknown is not good."""
    ok = lambda c: F.coalesce(F.col(c) > least, F.lit(False))
    return df.withColumn("ok_w1", ok(snr1)).withColumn("ok_w2", ok(snr2)).withColumn("ok_joint", ok(snr1) & ok(snr2))


def early_late_colour(df: DataFrame, keys: list[str], band: str = "band", value: str = "flux", time: str = "mjd", days: float = 10.0) -> DataFrame:
    """Median colour (first band less second) in the first and the last days of a key."""
    w = Window.partitionBy(*keys)
    s = df.withColumn("_early", F.col(time) < F.min(time).over(w) + days).withColumn("_late", F.col(time) > F.max(time).over(w) - days)
    med = lambda on, b: F.median(F.when(F.col(on) & (F.col(band) == b), F.col(value)))
    return s.groupBy(*keys).agg((med("_early", "W1") - med("_early", "W2")).alias("early"), (med("_late", "W1") - med("_late", "W2")).alias("late")).withColumn("change", F.col("late") - F.col("early"))
