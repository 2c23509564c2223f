"""The run's configuration: a YAML mapping, checked once on the driver."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date
from typing import Any


class ConfigError(ValueError):
    pass


def number(value: Any, name: str) -> float:
    """A finite number; booleans are none."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ConfigError(f"{name} must be a finite number")
    return float(value)


def whole(value: Any, name: str, least: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ConfigError(f"{name} must be a whole number of at least {least}")
    return value


def within(value: Any, name: str, low: float, high: float) -> float:
    x = number(value, name)
    if not low < x < high:
        raise ConfigError(f"{name} must lie between {low} and {high}")
    return x


@dataclass(frozen=True)
class Config:
    assets: tuple[str, ...]
    start: date
    end: date
    initial_value: float
    cash: float
    rebalance: str
    cost_bps: float
    window: int
    levels: tuple[float, ...]
    decay: float
    scenarios: int
    seed: int
    reuse_shocks: bool
    large_return: float


SECTIONS = {"universe", "period", "portfolio", "estimation", "ewma", "simulation", "quality"}


def parse(raw: Mapping[str, Any]) -> Config:
    missing = SECTIONS - set(raw)
    if missing:
        raise ConfigError(f"missing sections: {sorted(missing)}")
    u, p, f, e, w, s, q = (raw[k] for k in ("universe", "period", "portfolio", "estimation", "ewma", "simulation", "quality"))
    assets = tuple(u.get("assets") or ())
    if not assets or len(set(assets)) != len(assets) or not all(isinstance(a, str) and a for a in assets):
        raise ConfigError("assets must be distinct names")
    start, end = p.get("start"), p.get("end")
    if not isinstance(start, date) or not isinstance(end, date) or start >= end:
        raise ConfigError("the period must begin before it ends")
    if f.get("rebalance") not in ("monthly", "daily", "never"):
        raise ConfigError("rebalance is monthly, daily or never")
    if f.get("weighting", "equal") != "equal":
        raise ConfigError("weighting is equal")
    levels = tuple(within(x, "confidence level", 0, 1) for x in e.get("confidence_levels") or ())
    if not levels or sorted(set(levels)) != list(levels):
        raise ConfigError("confidence levels must rise")
    cost = number(f.get("transaction_cost_bps", 0), "transaction_cost_bps")
    if cost < 0:
        raise ConfigError("transaction_cost_bps must not be negative")
    cash = number(f.get("cash_weight", 0), "cash_weight")
    if not 0 <= cash < 1:
        raise ConfigError("cash_weight lies in [0, 1)")
    if not isinstance(s.get("reuse_shocks"), bool):
        raise ConfigError("reuse_shocks is true or false")
    value = number(f.get("initial_value"), "initial_value")
    if value <= 0:
        raise ConfigError("initial_value must be positive")
    return Config(
        assets, start, end, value, cash, f["rebalance"], cost, whole(e.get("window"), "window", 2), levels, within(w.get("decay"), "decay", 0, 1),
        whole(s.get("scenarios"), "scenarios", 2), whole(s.get("seed"), "seed", 0), s["reuse_shocks"], within(q.get("large_return"), "large_return", 0, math.inf),
    )


def load(path: str) -> Config:
    import yaml

    with open(path) as f:
        raw = yaml.safe_load(f)
    if not isinstance(raw, Mapping):
        raise ConfigError("the configuration is a mapping")
    return parse(raw)


def require_runnable(c: Config) -> Config:
    """What the path and the simulations can do: no costs, shared shocks."""
    if c.cost_bps:
        raise ConfigError("transaction costs are not modelled")
    if not c.reuse_shocks:
        raise ConfigError("dates share their shocks: reuse_shocks must be true")
    return c
