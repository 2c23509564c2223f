"""Traffic lights on a stream of forecasts: the last 250 flags of each model as state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

WINDOW = 250
OUT = "model string, forecast_date date, exception_count long, zone string"
STATE = "flags array<boolean>, days array<date>"


def zone(count: int) -> str:
    return "green" if count <= 4 else "amber" if count <= 9 else "red"


def advance(key: tuple, batches: Iterator[pd.DataFrame], state: Any, window: int = WINDOW) -> Iterator[pd.DataFrame]:
    """Takes one trigger's forecasts of a model in date order; a date that is not newer than the state is left out."""
    flags, days = (list(x) for x in state.get) if state.exists else ([], [])
    rows = pd.concat(list(batches)).sort_values("forecast_date", kind="stable").drop_duplicates("forecast_date")
    out = []
    for day, flag in zip(rows["forecast_date"], rows["var_exceedance"], strict=True):
        if days and day <= days[-1]:
            continue
        flags, days = [*flags, bool(flag)][-window:], [*days, day][-window:]
        if len(flags) == window:
            out.append((key[0], day, sum(flags), zone(sum(flags))))
    state.update((flags, days))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def monitor(forecasts: DataFrame, level_bp: int = 9900, window: int = WINDOW) -> DataFrame:
    """A streaming frame of forecasts becomes a stream of window counts and zones; state is bounded by the window."""
    rows = forecasts.where(f"level_bp = {level_bp}").select("model", "forecast_date", "var_exceedance")
    return rows.groupBy("model").applyInPandasWithState(lambda k, b, s: advance(k, b, s, window), OUT, STATE, "append", "NoTimeout")
