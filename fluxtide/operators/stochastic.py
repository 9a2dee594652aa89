"""Stochastic light-curve models, one source per group.

The damped random walk is Markov, so its likelihood is a scalar Kalman filter, linear in the
number of epochs; no epochs are left out.  Spark spreads the sources over tasks; a source's
epochs are one array, and the filters of many sources take their steps together.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Bounds of ln(tau / day) and ln(sigma).
LOG_TAU, LOG_SIGMA = (1.0, 8.5), (-5.0, 5.0)


def ou_likelihood(sigma: np.ndarray, tau: np.ndarray, t: np.ndarray, y: np.ndarray, err: np.ndarray) -> np.ndarray:
    """Negative log-likelihood of many (sigma, tau) at once; y is centred."""
    state, var = np.zeros_like(sigma), sigma**2
    total = np.zeros_like(sigma)
    last = t[0]
    for when, value, e in zip(t, y, err):
        fade = np.exp(-(when - last) / tau)
        state, var = state * fade, sigma**2 + (var - sigma**2) * fade**2
        s = var + e * e + 1e-12
        miss = value - state
        total += 0.5 * (np.log(2.0 * math.pi * s) + miss * miss / s)
        gain = var / s
        state, var = state + gain * miss, var * (1.0 - gain)
        last = when
    return total


def ou_smooth(sigma: float, tau: float, t: np.ndarray, y: np.ndarray, err: np.ndarray) -> np.ndarray:
    """One-step predictions."""
    state, var, last, out = 0.0, sigma**2, t[0], []
    for when, value, e in zip(t, y, err):
        fade = math.exp(-(when - last) / tau)
        state, var = state * fade, sigma**2 + (var - sigma**2) * fade**2
        out.append(state)
        gain = var / (var + e * e + 1e-12)
        state, var, last = state + gain * (value - state), var * (1.0 - gain), when
    return np.array(out)


def minimise(cost: Callable[[np.ndarray], np.ndarray], bounds: list[tuple[float, float]], points: int = 5, rounds: int = 7) -> tuple[np.ndarray, float]:
    """Grid search that narrows about the best point; the cost takes many points at once.

    Deterministic; ties go to the first grid point."""
    low, high = np.array([b[0] for b in bounds]), np.array([b[1] for b in bounds])
    a, b, best, value = low.copy(), high.copy(), low, math.inf
    for _ in range(rounds):
        axes = [np.linspace(x, y, points) for x, y in zip(a, b)]
        grid = np.stack([g.ravel() for g in np.meshgrid(*axes, indexing="ij")], 1)
        costs = cost(grid)
        i = int(np.argmin(costs))
        if costs[i] < value:
            best, value = grid[i], float(costs[i])
        step = (b - a) / (points - 1)
        a, b = np.maximum(low, best - step), np.minimum(high, best + step)
    return best, value


def minimise_many(cost: Callable[[np.ndarray], np.ndarray], count: int, bounds: list[tuple[float, float]], points: int = 5, rounds: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """``minimise`` for many sources at once: the cost takes (sources, points, parameters), and
    each source's grid narrows about its own best point."""
    low, high = np.array([b[0] for b in bounds]), np.array([b[1] for b in bounds])
    a, b, best = (np.tile(x, (count, 1)) for x in (low, high, low))
    value, every = np.full(count, math.inf), np.arange(count)
    place = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(points)] * len(bounds), indexing="ij")], 1)
    for _ in range(rounds):
        axes = np.linspace(a, b, points)  # points, sources, parameters
        grid = np.stack([axes[place[:, k], :, k].T for k in range(len(bounds))], 2)
        costs = cost(grid)
        i = np.argmin(costs, 1)
        found = costs[every, i]
        better = found < value
        best[better], value[better] = grid[every, i][better], found[better]
        step = (b - a) / (points - 1)
        a, b = np.maximum(low, best - step), np.minimum(high, best + step)
    return best, value


Curve = tuple[np.ndarray, np.ndarray, np.ndarray]


def stacked(curves: list[Curve], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(which, t, y, err, alive) of at most ``most`` curves at a time, the longest first: arrays
    (epochs, curves), of which the first ``alive[i]`` curves have an epoch i."""
    size = np.array([len(c[0]) for c in curves], np.int64)
    order = np.argsort(-size, kind="stable")
    for at in range(0, len(order), most):
        which = order[at : at + most]
        t, y, e = (np.zeros((size[which[0]], len(which))) for _ in range(3))
        for k, w in enumerate(which):
            for out, own in zip((t, y, e), curves[w]):
                out[: size[w], k] = own
        yield which, t, y, e, np.searchsorted(-size[which], -np.arange(len(t)), "left")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by the keys over all shuffle partitions: few bytes a source can be much work, so
    the partitions must not be merged by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _centred(y: np.ndarray, err: np.ndarray) -> np.ndarray:
    w = 1.0 / err**2
    return y - (w * y).sum() / w.sum()


def fit_ou(t: np.ndarray, y: np.ndarray, err: np.ndarray) -> tuple[float, float, float]:
    """(sigma, tau, negative log-likelihood) at the maximum."""
    y = _centred(y, err)
    best, nll = minimise(lambda p: ou_likelihood(np.exp(p[:, 0]), np.exp(p[:, 1]), t, y, err), [LOG_SIGMA, LOG_TAU])
    return float(np.exp(best[0])), float(np.exp(best[1])), nll


def ou_likelihoods(sigma: np.ndarray, tau: np.ndarray, t: np.ndarray, y: np.ndarray, err: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """``ou_likelihood`` of stacked curves, each at points (curves, points) of its own."""
    square = sigma**2
    state, var, total = np.zeros_like(sigma), square.copy(), np.zeros_like(sigma)
    for i, m in enumerate(alive):
        fade = np.exp(-(t[i, :m] - t[max(i - 1, 0), :m])[:, None] / tau[:m])
        own = state[:m] * fade
        v = square[:m] + (var[:m] - square[:m]) * fade**2
        s = v + (err[i, :m] * err[i, :m])[:, None] + 1e-12
        miss = y[i, :m, None] - own
        total[:m] += 0.5 * (np.log(2.0 * math.pi * s) + miss * miss / s)
        gain = v / s
        state[:m], var[:m] = own + gain * miss, v * (1.0 - gain)
    return total


def fit_ous(curves: list[Curve], most: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``fit_ou`` of many curves: arrays of sigma, tau and the negative log-likelihood."""
    sigma, tau, nll = (np.empty(len(curves)) for _ in range(3))
    for which, t, y, e, alive in stacked([(t, _centred(y, e), e) for t, y, e in curves], most):
        best, value = minimise_many(lambda p: ou_likelihoods(np.exp(p[..., 0]), np.exp(p[..., 1]), t, y, e, alive), len(which), [LOG_SIGMA, LOG_TAU])  # noqa: B023
        sigma[which], tau[which], nll[which] = np.exp(best[:, 0]), np.exp(best[:, 1]), value
    return sigma, tau, nll


KINDS = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def _grouped(df: DataFrame, key: str, schema: str, least: int, row: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple] | None, value: str, err: str, time: str, rows: Callable[[list[Curve]], list[tuple]] | None = None) -> DataFrame:
    """A row a source that has ``least`` good epochs, by ``row`` of its curve or by ``rows`` of
    many curves.  Epochs are in order of time, then value, then error."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    kind = df.schema[key].dataType.simpleString()
    every = rows or (lambda curves: [row(*c) for c in curves])
    x = [F.col(c).cast("double") for c in (time, value, err)]
    good = df.select(key, F.struct(*[c.alias(n) for c, n in zip(x, "tye")]).alias("_x")).filter(" AND ".join(f"_x.{n} IS NOT NULL AND NOT isnan(_x.{n})" for n in "tye") + " AND _x.e > 0")
    sorted_ = spread(good, key).groupBy(key).agg(F.array_sort(F.collect_list("_x")).alias("_x")).filter(F.size("_x") >= least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("_x")
            ends = lists.offsets.to_numpy()
            whole = [lists.values.field(n).to_numpy(zero_copy_only=False) for n in "tye"]
            found = every([tuple(c[i:j] for c in whole) for i, j in zip(ends, ends[1:])])
            columns = [pa.array(list(c), KINDS[k], from_pandas=True) for c, k in zip(zip(*found), kinds)]
            yield pa.RecordBatch.from_arrays([b.column(key), *columns], names=[key, *names])

    return sorted_.mapInArrow(run, f"`{key}` {kind}, {schema}")


def fit_walk(df: DataFrame, key: str = "source_id", value: str = "flux", err: str = "err", time: str = "mjd", z: float = 0.0, least: int = 10) -> DataFrame:
    """Maximum a posteriori walk per source: sigma, tau (rest frame), nll, residual spread,
    and whether tau is reliable (a tenth of the baseline at most, off the bounds)."""

    def rows(curves):
        curves = [((t - t[0]) / (1.0 + z), y, e) for t, y, e in curves]
        out = []
        for (rest, y, e), sigma, tau, nll in zip(curves, *(x.tolist() for x in fit_ous(curves))):
            left = _centred(y, e) - ou_smooth(sigma, tau, rest, _centred(y, e), e)
            off = LOG_TAU[0] + 0.01 < math.log(tau) < LOG_TAU[1] - 0.01
            out.append((len(y), sigma, tau, nll, float(left.std()), bool(tau <= rest[-1] / 10 and off)))
        return out

    return _grouped(df, key, "n long, sigma double, tau double, nll double, residual double, reliable boolean", least, None, value, err, time, rows)


def running_costs(t: np.ndarray, y: np.ndarray, err: np.ndarray, sigma: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """(epochs, points): the negative log-likelihood of the first 1, 2, ... epochs at many
    (sigma, tau), each about its own weighted mean.  The filter is linear, so it runs over the
    values and over ones, and the mean enters afterwards."""
    state, unit, var, last = np.zeros_like(sigma), np.zeros_like(sigma), sigma**2, t[0]
    logs, yy, y1, ones = (np.zeros_like(sigma) for _ in range(4))
    w = 1.0 / err**2
    means, out = np.cumsum(w * y) / np.cumsum(w), np.empty((len(t), len(sigma)))
    for i, (when, value, e) in enumerate(zip(t, y, err)):
        fade = np.exp(-(when - last) / tau)
        state, unit, var = state * fade, unit * fade, sigma**2 + (var - sigma**2) * fade**2
        s = var + e * e + 1e-12
        miss, miss1 = value - state, 1.0 - unit
        logs, yy, y1, ones = logs + np.log(2.0 * math.pi * s), yy + miss * miss / s, y1 + miss * miss1 / s, ones + miss1 * miss1 / s
        gain = var / s
        state, unit, var, last = state + gain * miss, unit + gain * miss1, var * (1.0 - gain), when
        out[i] = 0.5 * (logs + yy - 2.0 * means[i] * y1 + means[i] ** 2 * ones)
    return out


def least_running_costs(t: np.ndarray, y: np.ndarray, err: np.ndarray, alive: np.ndarray, sigma: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """(epochs, curves): the least of ``running_costs`` over the points, of stacked curves."""
    shape = t.shape[1], len(sigma)
    square = sigma**2
    state, unit, logs, yy, y1, ones = (np.zeros(shape) for _ in range(6))
    var = np.tile(square, (shape[0], 1))
    w = np.divide(1.0, err**2, where=err > 0, out=np.zeros_like(err))
    means, out = np.cumsum(w * y, 0) / np.cumsum(w, 0), np.empty(t.shape)
    for i, m in enumerate(alive):
        fade = np.exp(-(t[i, :m] - t[max(i - 1, 0), :m])[:, None] / tau)
        own, one, v = state[:m] * fade, unit[:m] * fade, square + (var[:m] - square) * fade**2
        s = v + (err[i, :m] * err[i, :m])[:, None] + 1e-12
        miss, miss1, mean = y[i, :m, None] - own, 1.0 - one, means[i, :m, None]
        logs[:m] += np.log(2.0 * math.pi * s)
        yy[:m] += miss * miss / s
        y1[:m] += miss * miss1 / s
        ones[:m] += miss1 * miss1 / s
        gain = v / s
        state[:m], unit[:m], var[:m] = own + gain * miss, one + gain * miss1, v * (1.0 - gain)
        out[i, :m] = (0.5 * (logs[:m] + yy[:m] - 2.0 * mean * y1[:m] + mean**2 * ones[:m])).min(1)
    return out


def fit_broken_walk(df: DataFrame, key: str = "source_id", value: str = "flux", err: str = "err", time: str = "mjd", least: int = 10, edge: float = 0.15, points: int = 13, refine: int = 5) -> DataFrame:
    """One walk against two with a break, which is sought at every epoch from ``edge`` to
    1 - ``edge``: running costs over a grid, forwards for what is before and backwards for what
    is after, score all breaks in time linear in the epochs, and the best ``refine`` are fitted.
    ``break_lo`` and ``break_hi`` bound the middle 68 % of the breaks' likelihood."""

    axes = np.linspace(*LOG_SIGMA, points), np.linspace(*LOG_TAU, points)
    sigma, tau = (np.exp(x.ravel()) for x in np.meshgrid(*axes, indexing="ij"))

    def running(curves) -> list[np.ndarray]:
        out: list = [None] * len(curves)
        for which, t, y, e, alive in stacked(curves, 48):
            found = least_running_costs(t, y, e, alive, sigma, tau)
            for k, w in enumerate(which):
                out[w] = found[: len(curves[w][0]), k]
        return out

    def rows(curves):
        whole = fit_ous(curves)[2]
        before, after = running(curves), running([(t[-1] - t[::-1], y[::-1], e[::-1]) for t, y, e in curves])
        tried, parts = [], []
        for (t, y, e), a, b in zip(curves, before, after):
            n = len(t)
            places = np.arange(max(3, int(edge * n)), min(n - 2, int((1 - edge) * n)))
            cost = a[places - 1] + b[::-1][places]
            chosen = np.argsort(cost, kind="stable")[:refine]
            tried.append((places, cost, chosen))
            parts += [(c[:i] if first else c[i:]) for i in places[chosen] for first in (True, False) for c in (t, y, e)]
        fitted = iter(fit_ous([tuple(parts[i : i + 3]) for i in range(0, len(parts), 3)])[2].reshape(-1, 2).sum(1))
        out = []
        for (t, _, _), plain, (places, cost, chosen) in zip(curves, whole, tried):
            for k in chosen:
                cost[k] = min(cost[k], next(fitted))
            n, k = len(t), int(np.argmin(cost))
            share = np.cumsum(np.exp(cost[k] - cost))
            low, high = (int(np.searchsorted(share, q * share[-1])) for q in (0.16, 0.84))
            out.append((n, float(t[places[k]]), float(2 * plain + 2 * math.log(n) - 2 * cost[k] - 5 * math.log(n)), float(t[places[low]]), float(t[places[high]]), len(places)))
        return out

    return _grouped(df, key, "n long, break_mjd double, delta_bic double, break_lo double, break_hi double, n_tried long", least, None, value, err, time, rows)


def fit_step(df: DataFrame, key: str = "source_id", value: str = "flux", err: str = "err", time: str = "mjd", least: int = 15, breaks: int = 8) -> DataFrame:
    """A walk about a mean that steps once; the step's height is profiled on a grid."""

    def row(t, y, e):
        n = len(t)
        c = _centred(y, e)
        sigma, tau, plain = fit_ou(t, y, e)
        best = (math.inf, 0.0, 0.0)
        for q in np.linspace(0.2, 0.8, breaks):
            b = float(np.quantile(t, q))
            after = t > b
            if after.sum() < 3 or (~after).sum() < 3:
                continue
            top = c[after].mean() - c[~after].mean()
            for height in np.linspace(0.0, 1.5, 7) * top:
                m = np.where(after, height, 0.0)
                v = ou_likelihood(np.array([sigma]), np.array([tau]), t, c - m - (c - m).mean(), e)[0]
                if v < best[0]:
                    best = (float(v), b, float(height))
        return n, best[1], best[2], float(2 * (plain - best[0]) - 2 * math.log(n))

    return _grouped(df, key, "n long, step_mjd double, height double, delta_bic double", least, row, value, err, time)


def sample_walk(df: DataFrame, key: str = "source_id", value: str = "flux", err: str = "err", time: str = "mjd", walkers: int = 32, steps: int = 2000, burn: int = 500, seed: int = 42, least: int = 10) -> DataFrame:
    """Ensemble sampling of (ln sigma, ln tau) by stretch moves; quantiles and R-hat."""

    def row(t, y, e):
        c = _centred(y, e)
        low, high = np.array([LOG_SIGMA[0], LOG_TAU[0]]), np.array([LOG_SIGMA[1], LOG_TAU[1]])

        def cost(p):
            ok = ((p > low) & (p < high)).all(1)
            out = np.full(len(p), math.inf)
            if ok.any():
                out[ok] = ou_likelihood(np.exp(p[ok, 0]), np.exp(p[ok, 1]), t, c, e)
            return out

        sigma, tau, _ = fit_ou(t, y, e)
        rng = np.random.default_rng(seed)
        at = np.clip(np.log([sigma, tau]) + 0.1 * rng.standard_normal((walkers, 2)), low + 1e-3, high - 1e-3)
        now, chain = cost(at), []
        for _ in range(steps):
            for half in (0, 1):
                mine, other = np.arange(half, walkers, 2), np.arange(1 - half, walkers, 2)
                z = (rng.random(len(mine)) + 1.0) ** 2 / 2.0
                peer = at[rng.choice(other, len(mine))]
                new = peer + z[:, None] * (at[mine] - peer)
                price = cost(new)
                take = np.log(rng.random(len(mine))) < np.log(z) + now[mine] - price
                at[mine[take]], now[mine[take]] = new[take], price[take]
            chain.append(at.copy())
        kept = np.array(chain[burn:])  # steps, walkers, 2
        within = kept.var(0, ddof=1).mean(0)
        between = kept.mean(0).var(0, ddof=1)
        n = len(kept)
        rhat = np.sqrt(((n - 1) / n * within + between) / within)
        q = np.exp(np.quantile(kept.reshape(-1, 2), [0.16, 0.5, 0.84], axis=0))
        return len(t), *map(float, q[:, 0]), *map(float, q[:, 1]), float(rhat.max())

    return _grouped(df, key, "n long, sigma16 double, sigma50 double, sigma84 double, tau16 double, tau50 double, tau84 double, rhat double", least, row, value, err, time)


def simulate_walk(grid: DataFrame, key: str, sigma: float, tau: float, mean: float = 0.0, time: str = "mjd", seed: int = 42) -> DataFrame:
    """Adds ``flux``: the exact recursion on each key's times, by the seed and the key."""
    kind = grid.schema[key].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, kind="stable")
        t = pdf[time].to_numpy(float)
        rng = np.random.default_rng([seed, int(pd.util.hash_array(np.array([str(pdf[key].iloc[0])], object))[0])])
        x, out = rng.standard_normal() * sigma, []
        for i in range(len(t)):
            if i:
                fade = math.exp(-(t[i] - t[i - 1]) / tau)
                x = x * fade + sigma * math.sqrt(1.0 - fade * fade) * rng.standard_normal()
            out.append(mean + x)
        return pd.DataFrame({key: pdf[key], time: t, "flux": out})

    return spread(grid.select(key, time), key).groupBy(key).applyInPandas(one, f"`{key}` {kind}, {time} double, flux double")


def injected(flux, mjd, amplitude, start, width, shape):
    """Column: the flux with a signal of ``amplitude`` magnitudes, by shape: step, ramp,
    gaussian or two_step."""
    full = F.pow(F.lit(10.0), amplitude / 2.5) - 1.0
    since = (mjd - start) / width
    part = F.when(shape == "step", F.when(since >= 0, 1.0).otherwise(0.0)).when(shape == "ramp", F.least(F.greatest(since, F.lit(0.0)), F.lit(1.0))).when(shape == "gaussian", F.exp(-0.5 * since * since)).otherwise(F.when(since >= 1, 1.0).when(since >= 0, 0.5).otherwise(0.0))
    return flux * (1.0 + full * part)


def recovery_grid(hosts: DataFrame, amplitudes: list[float], shapes: list[str], key: str = "source_id", flux: str = "flux", time: str = "mjd", least: int = 3, threshold: float = 0.3, width: float = 3.0) -> DataFrame:
    """Completeness per amplitude and shape: signals put into every host at its median time,
    found if the medians before and after differ by the threshold in magnitudes.  The grid is
    small; hosts are scanned once."""
    spark = hosts.sparkSession
    grid = spark.createDataFrame([(float(a), s) for a in amplitudes for s in shapes], "amplitude double, shape string")
    mid = hosts.groupBy(key).agg(F.median(time).alias("start"))
    j = hosts.join(mid, key).crossJoin(F.broadcast(grid))
    j = j.withColumn("x", injected(F.col(flux), F.col(time), F.col("amplitude"), F.col("start"), F.lit(width), F.col("shape")))
    before = F.col(time) < F.col("start")
    g = j.groupBy("amplitude", "shape", key).agg(F.median(F.when(before, F.col("x"))).alias("a"), F.median(F.when(~before, F.col("x"))).alias("b"), F.count_if(before).alias("na"), F.count_if(~before).alias("nb"))
    hit = (F.col("na") >= least) & (F.col("nb") >= least) & (F.abs(2.5 * F.log10(F.try_divide(F.col("b"), F.col("a")))) >= threshold)
    return g.groupBy("amplitude", "shape").agg(F.count(F.lit(1)).alias("n_trials"), F.count_if(hit).alias("n_detected"), F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("completeness"))


def completeness_threshold(grid: DataFrame, target: float = 0.9, shape: str = "step") -> DataFrame:
    """The smallest amplitude whose mean completeness reaches the target."""
    g = grid.filter(F.col("shape") == shape).groupBy("amplitude").agg(F.avg("completeness").alias("c"))
    return g.filter(F.col("c") >= target).agg(F.min("amplitude").alias("amplitude"))


def jackknife(df: DataFrame, key: str, row_key: str, statistic, replicates: int = 20, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Spread of a grouped statistic over random subsets: the Column is evaluated per
    replicate; rows stay by md5 of (seed, replicate, row)."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col(row_key).cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    j = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).filter(u < share)
    g = j.groupBy(key, "replicate").agg(statistic.alias("s"))
    return g.groupBy(key).agg(F.count("s").alias("n"), F.avg("s").alias("mean"), F.stddev_samp("s").alias("sd"), F.percentile("s", F.lit(0.16)).alias("p16"), F.percentile("s", F.lit(0.84)).alias("p84"))


def block_bootstrap(seasons: DataFrame, key: str, value: str = "med", replicates: int = 50, seed: int = 42) -> DataFrame:
    """Spread of the log range of seasonal values when seasons are drawn with replacement, as
    Poisson weights: a season of weight 0 is out of the replicate."""
    from .sampling import bootstrap_weights

    s = seasons.withColumn("_row", F.concat_ws(":", F.col(key).cast("string"), F.col("season").cast("string")))
    b = bootstrap_weights(s, "_row", replicates, seed).filter("weight > 0")
    g = b.groupBy(key, "replicate").agg((F.max(value) / F.min(value)).alias("r"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return g.groupBy(key).agg(F.count("r").alias("n"), F.stddev_samp(2.5 * F.log10("r")).alias("sd"))


def false_alarm(df: DataFrame, key: str, sigma: float, tau: float, thresholds: list[float], flux: str = "flux", time: str = "mjd", seed: int = 42) -> DataFrame:
    """Share of simulated null curves, on every source's own times, whose halves differ by
    each threshold (in units of sigma)."""
    sim = simulate_walk(df, key, sigma, tau, time=time, seed=seed)
    mid = sim.groupBy(key).agg(F.median(time).alias("mid"))
    early = F.col(time) <= F.col("mid")
    g = sim.join(mid, key).groupBy(key).agg((F.abs(F.median(F.when(early, F.col("flux"))) - F.median(F.when(~early, F.col("flux")))) / sigma).alias("shift"))
    levels = df.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    return g.crossJoin(F.broadcast(levels)).groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("shift") >= F.col("threshold")).cast("double")).alias("rate"))


def null_threshold(df: DataFrame, key: str, sigma: float, tau: float, rate: float = 0.05, simulations: int = 5, flux: str = "flux", time: str = "mjd", seed: int = 42) -> DataFrame:
    """The shift between halves (in sigma) that null curves on the sources' own times exceed
    at the given rate, over several simulations a source."""
    every = df.select(F.explode(F.sequence(F.lit(0), F.lit(simulations - 1))).alias("_s"), F.col(key).cast("string").alias("_k"), time).select(F.concat_ws("#", "_k", "_s").alias(key), time)
    sim = simulate_walk(every, key, sigma, tau, time=time, seed=seed)
    mid = sim.withColumn("_mid", F.median(time).over(Window.partitionBy(key)))
    early = F.col(time) <= F.col("_mid")
    g = mid.groupBy(key).agg((F.abs(F.median(F.when(early, F.col("flux"))) - F.median(F.when(~early, F.col("flux")))) / sigma).alias("shift"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.percentile("shift", F.lit(1.0 - rate)).alias("threshold"))
