"""Posterior of the walk by ensemble sampling, with a prior on the timescale and diagnostics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import sigma_excess
from .stochastic import LOG_SIGMA, LOG_TAU, _centred, _grouped, fit_ou, ou_likelihood

# Mean and spread of the prior on ln(tau / day), and the bound of R-hat.
PRIOR_TAU = (5.7, 1.0)
RHAT = 1.1


def potential_scale(chain: np.ndarray) -> np.ndarray:
    """R-hat of each parameter of (steps, walkers, parameters): pooled over within-walker
    variance."""
    n = len(chain)
    within = chain.var(0, ddof=1).mean(0)
    between = chain.mean(0).var(0, ddof=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.sqrt(((n - 1) / n * within + between) / within)


def stretch_chain(cost, start: np.ndarray, rng: np.random.Generator, burn: int, most: int, block: int, bound: float) -> tuple[np.ndarray, float]:
    """(steps, walkers, parameters) after the burn-in, and the share of accepted moves, by
    stretch moves of half the walkers against the other half.  Blocks of steps follow until
    R-hat of all parameters is below the bound, or ``most`` steps are made in all."""
    at = start.copy()
    walkers, size = at.shape
    now, chain, taken, made = cost(at), [], 0, 0
    while made < most:
        for _ in range(min(block if made >= burn else burn, most - made)):
            for half in (0, 1):
                mine, other = np.arange(half, walkers, 2), np.arange(1 - half, walkers, 2)
                z = (rng.random(len(mine)) + 1.0) ** 2 / 2.0
                new = at[other[rng.integers(0, len(other), len(mine))]]
                new = new + z[:, None] * (at[mine] - new)
                price = cost(new)
                take = np.log(rng.random(len(mine))) < (size - 1) * np.log(z) + now[mine] - price
                at[mine[take]], now[mine[take]] = new[take], price[take]
                taken += int(take.sum())
            made += 1
            if made > burn:
                chain.append(at.copy())
        if len(chain) >= block and (potential_scale(np.array(chain)) < bound).all():
            break
    return np.array(chain), taken / (made * walkers)


def walk_posterior(df: DataFrame, key: str = "source_id", value: str = "flux", err: str = "err", time: str = "mjd", z: float = 0.0, walkers: int = 64, burn: int = 1000, most: int = 3000, block: int = 500, prior: tuple[float, float] = PRIOR_TAU, seed: int = 42, least: int = 10) -> DataFrame:
    """Quantiles of sigma and tau (rest frame) under a flat prior on ln sigma and a normal one on
    ln tau, both within bounds; the share of accepted moves, both R-hats, steps kept, whether
    it converged, and ``excess``: the median sigma over what the mean flux leads to expect."""

    def row(t, y, e):
        rest, c = (t - t[0]) / (1.0 + z), _centred(y, e)
        low, high = np.array([LOG_SIGMA[0], LOG_TAU[0]]), np.array([LOG_SIGMA[1], LOG_TAU[1]])

        def cost(p):
            ok = ((p > low) & (p < high)).all(1)
            out = np.full(len(p), math.inf)
            if ok.any():
                out[ok] = ou_likelihood(np.exp(p[ok, 0]), np.exp(p[ok, 1]), rest, c, e) + 0.5 * ((p[ok, 1] - prior[0]) / prior[1]) ** 2
            return out

        sigma, tau, _ = fit_ou(rest, y, e)
        rng = np.random.default_rng(seed)
        start = np.clip(np.log([sigma, tau]), low + 0.5, high - 0.5) + 1e-2 * rng.standard_normal((walkers, 2))
        chain, accepted = stretch_chain(cost, start, rng, burn, most, block, RHAT)
        rhat = potential_scale(chain)
        q = np.exp(np.quantile(chain.reshape(-1, 2), [0.16, 0.5, 0.84], axis=0))
        return len(t), *map(float, q[:, 0]), *map(float, q[:, 1]), accepted, float(rhat[0]), float(rhat[1]), len(chain), bool((rhat < RHAT).all()), float(y.mean())

    schema = "n long, sigma16 double, sigma50 double, sigma84 double, tau16 double, tau50 double, tau84 double, accepted double, rhat_sigma double, rhat_tau double, steps long, converged boolean, mean_flux double"
    out = _grouped(df, key, schema, least, row, value, err, time)
    return out.withColumn("excess", sigma_excess(F.col("sigma50"), F.col("mean_flux")))
