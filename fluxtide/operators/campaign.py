"""Injection and recovery: seeded visit cadences, simulated scatter, signals, a quick score.

Every random number is md5 of a seed and the row's keys, so a campaign is the same on any
cluster, in any partitioning and in SQL.  Hosts, amplitudes, shapes and trials are rows; a trial's
epochs are a few tens, so windows and medians stay within small groups.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resampling import uniform

# Survey start, days between visits and their scatter, exposures a visit, length.
START, SPACING, JITTER, EXPOSURES, BASELINE = 56800.0, 180.0, 5.0, (8, 16), 3650.0
AMPLITUDES = (0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0)
SHAPES = ("step", "ramp", "gaussian", "sinusoidal")


def normal(*parts) -> Column:
    """Standard normal by md5 of the parts (Box and Muller)."""
    half = 0.5 / float(1 << 52)
    return F.sqrt(-2.0 * F.log(uniform(*parts, "r") + half)) * F.cos(2.0 * math.pi * uniform(*parts, "a"))


def cadence(hosts: DataFrame, key: str, epochs: int = 10, seed: int = 0, baseline: float = BASELINE) -> DataFrame:
    """(key, visit, exposure, mjd): visits about every half year with scatter, each of 8 to 15
    exposures within two days; of these ``epochs`` in random order (0: all)."""
    most = math.ceil(baseline / (SPACING - JITTER))
    k = F.col(key)
    v = hosts.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("visit"))
    late = F.sum(F.when(F.col("visit") > 0, SPACING + JITTER * (2.0 * uniform(seed, "gap", k, F.col("visit")) - 1.0)).otherwise(0.0)).over(Window.partitionBy(key).orderBy("visit"))
    v = v.withColumn("_t", late).filter(F.col("_t") < baseline)
    many = EXPOSURES[0] + F.floor(uniform(seed, "count", k, F.col("visit")) * (EXPOSURES[1] - EXPOSURES[0]))
    e = v.select(key, "visit", "_t", F.explode(F.sequence(F.lit(0), (many - 1).cast("int"))).alias("exposure"))
    e = e.withColumn("mjd", START + F.col("_t") + 2.0 * uniform(seed, "time", k, F.col("visit"), F.col("exposure"))).drop("_t")
    if epochs:
        place = F.row_number().over(Window.partitionBy(key).orderBy(uniform(seed, "pick", k, F.col("visit"), F.col("exposure")), "visit", "exposure"))
        e = e.withColumn("_place", place).filter(F.col("_place") <= epochs).drop("_place")
    return e


def walk(df: DataFrame, keys: list[str], noise: Column, sigma: Column, tau: float, time: str = "mjd") -> DataFrame:
    """Adds ``walk``: a damped walk by its exact recursion, as a cumulative sum of
    innovations over exponentials.  Times may span some 700 tau."""
    w = Window.partitionBy(*keys).orderBy(time)
    since = (F.col(time) - F.first(time).over(w)) / tau
    d = df.withColumn("_s", since).withColumn("_z", noise)
    fresh = F.coalesce(F.sqrt(1.0 - F.exp(-2.0 * (F.col("_s") - F.lag("_s").over(w)))), F.lit(1.0))
    d = d.withColumn("_e", F.exp("_s") * fresh * F.col("_z"))
    return d.withColumn("walk", sigma * F.exp(-F.col("_s")) * F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_s", "_z", "_e")


def signal(time: Column, start: Column, end: Column, middle: Column, amplitude: Column, shape: Column) -> Column:
    """The share of the flux added, by shape; ``middle`` is where a step begins.  Amplitudes in
    magnitudes become flux at first order, as 0.4 ln 10 a magnitude."""
    span = F.greatest(end - start, F.lit(1.0))
    full = 0.4 * math.log(10.0) * amplitude
    ramp = F.least(F.greatest((time - (start + 0.35 * span)) / F.greatest(0.3 * span, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    flare = F.exp(-0.5 * F.pow((time - 0.5 * (start + end)) / (0.15 * span), 2.0))
    wave = 0.5 * (1.0 + F.sin(2.0 * math.pi * (time - start) / (0.3 * span)))
    return full * F.when(shape == "ramp", ramp).when(shape == "gaussian", flare).when(shape == "sinusoidal", wave).otherwise((time > middle).cast("double"))


def quick_scores(curves: DataFrame, keys: list[str], flux: str = "flux", time: str = "mjd") -> DataFrame:
    """(keys, n, score, measured): change between the first and last fifths by medians, a test
    of the halves' means, and their mean for the third part; ``measured`` is the change in
    magnitudes.  Fewer than five epochs or no positive median score 0."""
    w = Window.partitionBy(*keys)
    c = curves.filter(F.col(flux).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(time))).withColumn("_n", F.count(F.lit(1)).over(w))
    fifth, half = F.greatest(F.lit(1), F.floor(F.col("_n") / 5)), F.floor(F.col("_n") / 2)
    x = F.col(flux)
    on = lambda cond: F.when(cond, x)
    first, second = F.col("_i") <= half, F.col("_i") > half
    g = c.groupBy(*keys).agg(
        F.max("_n").alias("n"), F.median(x).alias("mid"), F.median(on(F.col("_i") <= fifth)).alias("early"), F.median(on(F.col("_i") > F.col("_n") - fifth)).alias("late"),
        F.avg(on(first)).alias("m1"), F.avg(on(second)).alias("m2"), F.stddev_pop(on(first)).alias("s1"), F.stddev_pop(on(second)).alias("s2"), F.count_if(first).alias("n1"), F.count_if(second).alias("n2"),
    )
    change = F.least(F.lit(1.0), F.abs(F.col("late") - F.col("early")) / F.greatest("mid", F.lit(1e-6)))
    e1, e2 = F.col("s1") / F.greatest(F.sqrt("n1"), F.lit(1.0)), F.col("s2") / F.greatest(F.sqrt("n2"), F.lit(1.0))
    shift = F.tanh(F.abs(F.col("m2") - F.col("m1")) / F.greatest(F.sqrt(e1 * e1 + e2 * e2), F.lit(1e-8)) / 3.0)
    score = 0.35 * change + 0.35 * shift + 0.30 * (0.5 * (change + shift))
    ok = (F.col("n") >= 5) & (F.col("mid") > 0)
    measured = F.when((F.col("early") > 0) & (F.col("late") > 0), 2.5 * F.log10(F.col("late") / F.col("early")))
    return g.select(*keys, "n", F.when(ok, score).otherwise(0.0).alias("score"), measured.alias("measured"))


def trials(hosts: DataFrame, key: str, level: str, amplitudes: tuple = AMPLITUDES, shapes: tuple = SHAPES, repeats: int = 2, scatter: float = 0.05, noise: float = 0.02, tau: float = 300.0, seed: int = 12345) -> DataFrame:
    """(key, amplitude, shape, trial, n, score, measured): each host, at its own level, gets each
    signal on its own cadence under fresh scatter."""
    grid = hosts.sparkSession.createDataFrame([(float(a), s, r) for a in amplitudes for s in shapes for r in range(repeats)], "amplitude double, shape string, trial int")
    own = hosts.filter(F.col(level) > 0).select(key, F.col(level).alias("_level"))
    c = cadence(own, key).join(own, key).crossJoin(F.broadcast(grid))
    by = [key, "amplitude", "shape", "trial"]
    names = [F.col(key), F.col("amplitude"), F.col("shape"), F.col("trial")]
    place = F.row_number().over(Window.partitionBy(*by).orderBy("mjd"))
    c = walk(c.withColumn("_i", place), by, normal(seed, "walk", *names, F.col("_i")), F.lit(scatter), tau)
    base = 1.0 + F.col("walk") + noise * normal(seed, "noise", *names, F.col("_i"))
    w = Window.partitionBy(*by)
    start, end = F.min("mjd").over(w), F.max("mjd").over(w)
    c = c.withColumns({"_a": start, "_b": end})
    middle = 0.5 * (F.col("_a") + F.col("_b")) + 0.2 * (uniform(seed, "start", *names) - 0.5) * F.greatest(F.col("_b") - F.col("_a"), F.lit(1.0))
    share = signal(F.col("mjd"), F.col("_a"), F.col("_b"), middle, F.col("amplitude"), F.col("shape"))
    return quick_scores(c.withColumn("flux", F.col("_level") * (base + share)), by)


def completeness(scored: DataFrame, least: float = 0.5) -> DataFrame:
    """Per amplitude and shape: trials, recovered ones, mean score, and the mean of measured
    less injected magnitudes."""
    hit = F.col("score") > least
    g = scored.groupBy("amplitude", "shape").agg(F.count(F.lit(1)).alias("n_trials"), F.count_if(hit).alias("n_recovered"), F.avg("score").alias("mean_score"), F.avg(F.col("measured") - F.col("amplitude")).alias("bias"))
    return g.withColumn("completeness", F.col("n_recovered") / F.col("n_trials"))


def thresholds(table: DataFrame) -> DataFrame:
    """The smallest amplitudes at which half and nine tenths are recovered, over all shapes."""
    g = table.groupBy("amplitude").agg(F.avg("completeness").alias("c"))
    at = lambda q: F.min(F.when(F.round("c", 9) >= q, F.col("amplitude")))
    return g.agg(at(0.5).alias("half"), at(0.9).alias("nine_tenths"))


def chosen_epochs(curves: DataFrame, key: str, timescales: tuple, realisations: int = 20, time: str = "mjd", side: int = 3, seed: int = 42) -> DataFrame:
    """(key, timescale, realisation, start): for each host and timescale, epochs drawn from those
    with ``side`` epochs before and ``side`` after the signal is full; hosts without one are out."""
    w = Window.partitionBy(key).orderBy(time)
    parts = []
    for tag, x in enumerate(timescales):
        # Epochs at or after start + timescale, for each epoch as a start.
        after = F.expr(f"count(1) OVER (PARTITION BY `{key}` ORDER BY `{time}` RANGE BETWEEN {float(x)!r}D FOLLOWING AND UNBOUNDED FOLLOWING)")
        parts.append(curves.select(key, F.col(time).alias("start"), F.lit(float(x)).alias("timescale"), F.lit(tag).alias("_tag"), (F.rank().over(w) - 1).alias("_pre"), after.alias("_post")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    both = Window.partitionBy(key, "timescale")
    ok = every.filter((F.col("_pre") >= side) & (F.col("_post") >= side)).withColumn("_i", F.row_number().over(both.orderBy("start")) - 1).withColumn("_m", F.count(F.lit(1)).over(both))
    draws = ok.filter("_i = 0").select(key, "timescale", "_tag", "_m", F.explode(F.sequence(F.lit(0), F.lit(realisations - 1))).alias("realisation"))
    picked = draws.withColumn("_i", F.floor(uniform(seed, F.col(key), F.col("_tag"), F.col("realisation")) * F.col("_m")).cast("int"))
    return picked.join(ok.select(key, "timescale", "_i", "start"), [key, "timescale", "_i"]).select(key, "timescale", "realisation", "start")


def host_recovery(curves: DataFrame, key: str, value: str, amplitudes: tuple = (0.2, 0.5, 1.0, 1.5), timescales: tuple = (0.5, 1.0, 2.0, 5.0), realisations: int = 20, threshold: float = 0.5, time: str = "mjd", seed: int = 42) -> DataFrame:
    """Completeness and bias per amplitude and timescale of brightenings put into hosts at chosen
    epochs, found by medians before and after.

    What comes after the signal is full is brighter by the amplitude whatever the shape, and
    what comes before is as it was; so one pair of medians a chosen epoch serves all shapes and
    amplitudes."""
    picked = chosen_epochs(curves, key, timescales, realisations, time, seed=seed)
    starts = picked.select(key, "timescale", "start").distinct()
    j = starts.join(curves.select(key, F.col(time).alias("_t"), F.col(value).alias("_m")), key)
    m = j.groupBy(key, "timescale", "start").agg(F.median(F.when(F.col("_t") < F.col("start"), F.col("_m"))).alias("pre"), F.median(F.when(F.col("_t") >= F.col("start") + F.col("timescale"), F.col("_m"))).alias("post"))
    grid = curves.sparkSession.createDataFrame([(float(a),) for a in amplitudes], "amplitude double")
    found = picked.join(m, [key, "timescale", "start"]).crossJoin(F.broadcast(grid)).withColumn("measured", F.col("pre") - F.col("post") + F.col("amplitude"))
    g = found.groupBy("amplitude", "timescale").agg(F.count(F.lit(1)).alias("n_trials"), F.count_if(F.abs("measured") >= threshold).alias("n_recovered"), F.avg(F.col("measured") - F.col("amplitude")).alias("bias"))
    return g.withColumn("completeness", F.col("n_recovered") / F.col("n_trials"))
