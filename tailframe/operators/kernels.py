"""The small dense kernels of one forecast date, in numpy. They run inside Arrow batches, never on tables."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np


#: Largest table of shocks that a worker keeps; beyond it shocks are drawn in runs of rows, which give the same numbers.
SHOCK_VALUES = 8_000_000


def check_draws(scenarios: int, seed: int) -> None:
    for name, x, least in (("scenarios", scenarios, 2), ("seed", seed, 0)):
        if isinstance(x, bool) or not isinstance(x, (int, np.integer)) or x < least:
            raise ValueError(f"{name} is a whole number of at least {least}")


@lru_cache(maxsize=2)
def normal_shocks(scenarios: int, assets: int, seed: int) -> np.ndarray:
    """Seeded standard normal draws, one row per scenario. Each worker makes them again instead of receiving them."""
    if scenarios < 2 or assets < 1:
        raise ValueError("two scenarios and one asset are the least")
    z = np.random.default_rng(seed).standard_normal((scenarios, assets))
    z.setflags(write=False)
    return z


def generator_states(scenarios: int, assets: int, seed: int, block: int) -> Iterator[tuple[int, str]]:
    """(first scenario, the generator's state there) for every ``block`` scenarios. A normal takes one or more steps of the generator, so states are found by
    drawing once through all of them: quick, in the memory of one block, and for all dates that share the seed."""
    rng = np.random.default_rng(seed)
    for first in range(0, scenarios, block):
        yield first, json.dumps(rng.bit_generator.state)
        rng.standard_normal((min(block, scenarios - first), assets))


def draws_from(state: str, scenarios: int, assets: int) -> np.ndarray:
    """``scenarios`` rows of the shocks that follow a stored state."""
    rng = np.random.default_rng()
    rng.bit_generator.state = json.loads(state)
    return rng.standard_normal((scenarios, assets))


def lower_factor(cov: np.ndarray, strict: bool = False) -> np.ndarray:
    """Lower Cholesky factor. ``strict`` refuses matrices that are all but singular."""
    cov = np.asarray(cov, dtype=float)
    if cov.ndim != 2 or cov.shape[0] != cov.shape[1] or not np.isfinite(cov).all() or not np.allclose(cov, cov.T, rtol=1e-12, atol=0):
        raise ValueError("a finite symmetric matrix is needed")
    if strict and np.linalg.eigvalsh(cov)[0] <= 1e-12 * max(1.0, np.abs(cov).max()):
        raise ValueError("the covariance is not positive definite")
    return np.linalg.cholesky(cov)


def return_scenarios(mu: np.ndarray, cov: np.ndarray, scenarios: int, seed: int) -> np.ndarray:
    return np.asarray(mu) + normal_shocks(scenarios, len(mu), seed) @ lower_factor(cov).T


def losses_from_shocks(mu: np.ndarray, cov: np.ndarray, w: np.ndarray, shocks: np.ndarray) -> np.ndarray:
    """Portfolio losses; the weights are pulled through the factor first, so scenarios by assets are never built."""
    return -(np.dot(w, mu) + shocks @ (lower_factor(cov).T @ w))


def shock_runs(scenarios: int, assets: int, seed: int) -> Iterator[np.ndarray]:
    """``normal_shocks`` in runs of rows: one that is kept if it is small, else as many as memory asks for."""
    if scenarios * assets <= SHOCK_VALUES:
        yield normal_shocks(scenarios, assets, seed)
        return
    rng, most = np.random.default_rng(seed), max(1, SHOCK_VALUES // assets)
    for i in range(0, scenarios, most):
        yield rng.standard_normal((min(most, scenarios - i), assets))


def losses_of_dates(means: np.ndarray, pulled: np.ndarray, scenarios: int, seed: int) -> np.ndarray:
    """Losses (dates by scenarios) from portfolio means and weights pulled through the factors (assets by dates)."""
    out, at = np.empty((len(means), scenarios)), 0
    for shocks in shock_runs(scenarios, len(pulled), seed):
        out[:, at : at + len(shocks)] = -(means[:, None] + (shocks @ pulled).T)
        at += len(shocks)
    return out


def portfolio_losses(mu: np.ndarray, cov: np.ndarray, w: np.ndarray, scenarios: int, seed: int) -> np.ndarray:
    return losses_from_shocks(mu, cov, w, normal_shocks(scenarios, len(mu), seed))


def empirical_tail(losses: np.ndarray, level: float) -> tuple[float, float, int]:
    """VaR, ES and the number of losses of at least the VaR."""
    var = float(np.quantile(losses, level, method="linear"))
    tail = losses[losses >= var]
    return var, float(tail.mean()), len(tail)


def empirical_tails(losses: np.ndarray, levels: Sequence[float]) -> list[tuple[float, float, int]]:
    """``empirical_tail`` for rising levels; only the tail beyond the lowest is sorted."""
    n = len(losses)
    low = int(np.floor((n - 1) * levels[0]))
    tail = np.sort(np.partition(losses, low)[low:])
    out = []
    for level in levels:
        at = (n - 1) * level
        k = int(np.floor(at))
        a, b = tail[k - low], tail[min(k + 1, n - 1) - low]
        var = float(a if a == b else a + (b - a) * (at - k))
        over = tail[np.searchsorted(tail, var) :]
        out.append((var, float(over.mean()), len(over)))
    return out


def sorted_tails(rows: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    """VaR (linear between order statistics) and ES (mean of losses of at least the VaR) of each sorted row."""
    n = rows.shape[1]
    at = (n - 1) * level
    k = int(np.floor(at))
    a, b = rows[:, k], rows[:, min(k + 1, n - 1)]
    var = np.where(a == b, a, a + (b - a) * (at - k))
    tail = rows >= var[:, None]
    return var, np.where(tail, rows, 0.0).sum(axis=1) / tail.sum(axis=1)


def weighted_tail(values: np.ndarray, times: np.ndarray, level: float) -> tuple[float, float, int]:
    """``empirical_tail`` of each value repeated ``times`` times, without repeating it."""
    order = np.argsort(values, kind="stable")
    v, n = values[order], times[order]
    upto = np.cumsum(n)
    at = (upto[-1] - 1) * level
    low = int(np.floor(at))
    a, b = (float(v[np.searchsorted(upto, k, side="right")]) for k in (low, min(low + 1, int(upto[-1]) - 1)))
    var = a if a == b else a + (b - a) * (at - low)
    tail = v >= var
    return var, float((v[tail] * n[tail]).sum() / n[tail].sum()), int(n[tail].sum())


def standardize(u: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Whitened innovation: L z = u."""
    return np.linalg.solve(lower_factor(cov, strict=True), u)


def rescale(z: np.ndarray, cov: np.ndarray) -> np.ndarray:
    return lower_factor(cov, strict=True) @ z


def filtered_loss(mu: np.ndarray, z: np.ndarray, cov: np.ndarray, w: np.ndarray) -> float:
    """The portfolio loss of one residual, rescaled by the date's covariance: what the weights pulled through the factor give at once."""
    return -float(np.dot(mu + rescale(z, cov), w))


def initial_pool(window: np.ndarray) -> np.ndarray:
    """Residuals of the first window (sessions by assets) by its own mean and sample covariance."""
    return standardize((window - window.mean(axis=0)).T, np.cov(window.T, ddof=1).reshape(window.shape[1], -1)).T


def positions(pool: int, scenarios: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, pool, scenarios)


def resample(pool: np.ndarray, scenarios: int, seed: int) -> np.ndarray:
    """Whole rows of the pool, with replacement."""
    return pool[positions(len(pool), scenarios, seed)]


@lru_cache(maxsize=4)
def multiplicity(pool: int, scenarios: int, seed: int) -> np.ndarray:
    """How often each pool position is drawn; the same for every date, as every date draws with the seed anew."""
    return np.bincount(positions(pool, scenarios, seed), minlength=pool)
