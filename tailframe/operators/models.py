"""Forecast models behind one contract: the forecast fact table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels, moments
from .contracts import guarded
from .schedule import check_levels, forecast_schedule, LEVELS, level_rows

#: Order is part of the contract: pairwise tests take the earlier model first.
MODELS = ("rolling-gaussian", "ewma-gaussian", "filtered-historical")
#: Sessions that one group of a windowed numpy kernel forecasts; it also gets the window before them.
BLOCK = 256


def gaussian_tail(mean: Column, vol: Column, z: Column, phi: Column, level: Column) -> tuple[Column, Column]:
    """VaR and ES of a normal return, as losses."""
    return -mean + vol * z, -mean + vol * phi / (1 - level)


def gaussian_forecasts(moments_by_date: DataFrame, levels: Sequence[float] = LEVELS, by: Sequence[str] = ()) -> DataFrame:
    """forecast_date, level, mean_return, volatility, value_at_risk, expected_shortfall. A volatility that is not positive is an error."""
    vol = F.col("volatility")
    rows = moments_by_date.withColumn("volatility", guarded(F.coalesce((vol > 0) & (vol < float("inf")) & ~F.isnan("mean_return"), F.lit(False)), vol, "the volatility of a forecast is not positive"))
    rows = rows.crossJoin(F.broadcast(level_rows(moments_by_date.sparkSession, levels)))
    var, es = gaussian_tail(F.col("mean_return"), vol, F.col("z"), F.col("phi"), F.col("confidence_level"))
    return rows.select(*by, "forecast_date", "level_bp", "confidence_level", "mean_return", "volatility", var.alias("value_at_risk"), es.alias("expected_shortfall"))


def rolling_gaussian_univariate(portfolio: DataFrame, window: int, levels: Sequence[float] = LEVELS, by: Sequence[str] = ()) -> DataFrame:
    return gaussian_forecasts(moments.rolling_univariate(portfolio, window, by), levels, by)


def numbered_weights(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Weights with the returns' asset_no."""
    if "asset_no" in weights.columns:
        return weights
    return weights.join(returns.select("asset", "asset_no").distinct(), "asset")


def packed_dates(returns: DataFrame, weights: DataFrame, window: int, decay: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``moments.packed`` of the rolling, or with ``decay`` the exponentially weighted, moments."""
    means = moments.rolling_means(returns, window)
    cov = moments.rolling_covariance(returns, window) if decay is None else moments.ewma_covariance(returns, window, decay)
    return moments.packed(means, cov, numbered_weights(returns, weights), by)


def rolling_gaussian(returns: DataFrame, weights: DataFrame, window: int, levels: Sequence[float] = LEVELS, by: Sequence[str] = ()) -> DataFrame:
    return gaussian_forecasts(moments.moments_of(packed_dates(returns, weights, window, None, by), by), levels, by)


def ewma_gaussian(returns: DataFrame, weights: DataFrame, window: int, decay: float = 0.94, levels: Sequence[float] = LEVELS, by: Sequence[str] = ()) -> DataFrame:
    return gaussian_forecasts(moments.moments_of(packed_dates(returns, weights, window, decay, by), by), levels, by)


def with_blocks(rows: DataFrame, at: str, window: int, block: int = BLOCK) -> DataFrame:
    """Each row for every block of ``block`` sessions whose forecasts need it: its own, and those whose windows reach back to it."""
    return rows.withColumn("_block", F.explode(F.expr(f"sequence({at} div {block}, ({at} + {window}) div {block})")))


def historical_simulation(portfolio: DataFrame, window: int, levels: Sequence[float] = LEVELS, by: Sequence[str] = ()) -> DataFrame:
    """VaR and ES of the ``window`` realised losses before each session.

    Sessions are numbered and dealt to blocks with the window before them, so blocks run in parallel. A missing return is an error.
    """
    moments.check_window(window)
    check_levels(levels)
    at = W.partitionBy(*by).orderBy("session_date")
    loss = guarded(F.col("portfolio_return").isNotNull(), -F.col("portfolio_return"), moments.SHORT)
    r = portfolio.select(*by, F.col("session_date").alias("forecast_date"), loss.alias("loss"), (F.row_number().over(at) - 1).alias("t"))
    kinds = ", ".join(f"`{c}` {portfolio.schema[c].dataType.simpleString()}" for c in by)
    schema = (kinds + ", " if kinds else "") + "forecast_date date, level_bp int, confidence_level double, value_at_risk double, expected_shortfall double"
    names = [*by, "forecast_date", "level_bp", "confidence_level", "value_at_risk", "expected_shortfall"]

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        t, x = part["t"].to_numpy(), part["loss"].to_numpy()
        own = np.flatnonzero((t // BLOCK == key[-1]) & (t >= window))
        if not len(own):
            return pd.DataFrame(columns=names)
        views = np.sort(np.lib.stride_tricks.sliding_window_view(x, window)[own - window], axis=1)
        parts = []
        for level in levels:
            var, es = kernels.sorted_tails(views, level)
            parts.append(pd.DataFrame({**dict(zip(by, key, strict=False)), "forecast_date": part["forecast_date"].to_numpy()[own], "level_bp": round(level * 10000), "confidence_level": level, "value_at_risk": var, "expected_shortfall": es}))
        return pd.concat(parts)[names]

    return with_blocks(r, "t", window).groupBy(*by, "_block").applyInPandas(run, schema)


def as_forecasts(model: str, model_no: int, tails: DataFrame, schedule: DataFrame, extra: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """The fact table's rows of one model: what was forecast, what happened, and whether the loss exceeded the VaR.

    Every date of the schedule has a forecast and every forecast a date: one without the other fails the job.
    """
    rows = schedule.withColumn("_due", F.lit(True)).join(tails.withColumn("_made", F.lit(True)), [*by, "forecast_date"], "full")
    rows = rows.withColumn("value_at_risk", guarded(F.col("_due").isNotNull() & F.col("_made").isNotNull(), F.col("value_at_risk"), f"{model}: a date has a forecast or an outcome only"))
    return rows.select(
        *by, F.lit(model).alias("model"), F.lit(model_no).alias("model_no"), "forecast_date", "confidence_level", "level_bp", "estimation_start_date", "estimation_end_date",
        "realized_return", "realized_loss", "value_at_risk", "expected_shortfall", (F.col("realized_loss") > F.col("value_at_risk")).alias("var_exceedance"), *extra,
    )


#: What simulated forecasts tell of their draws.
DRAWS = ("simulated_mean_return", "simulated_volatility", "scenario_count", "random_seed", "tail_scenario_count")


@dataclass(frozen=True)
class Inputs:
    """What a model may look at. Rows of the columns ``by`` are portfolios of their own; asset returns are shared by all of them."""

    returns: DataFrame
    portfolio: DataFrame
    weights: DataFrame
    window: int
    levels: Sequence[float] = LEVELS
    decay: float = 0.94
    scenarios: int = 100_000
    seed: int = 20261002
    by: Sequence[str] = ()


@dataclass(frozen=True)
class Model:
    """A forecast model: from ``Inputs`` to tails (by, forecast_date, level_bp, confidence_level, value_at_risk, expected_shortfall, extra), one row for each scheduled
    date and level. ``closed_form``: the exact tails that simulated ones can be held against, where there are any."""

    name: str
    tails: Callable[[Inputs], DataFrame]
    extra: Sequence[str] = ()
    closed_form: Callable[[Inputs], DataFrame] | None = None


#: Registered models by name; a model's number is its place.
_REGISTRY: dict[str, Model] = {}


def register(model: Model) -> Model:
    """Makes a model known to forecasts, reports and commands. A name is taken once; models keep the order of their registration, which pairwise tests follow."""
    if model.name in _REGISTRY and _REGISTRY[model.name] != model:
        raise ValueError(f"there is a model {model.name} already")
    _REGISTRY[model.name] = model
    return model


def registered() -> tuple[str, ...]:
    return tuple(_REGISTRY)


def model_of(name: str) -> Model:
    if name not in _REGISTRY:
        raise ValueError(f"a model is one of {registered()}")
    return _REGISTRY[name]


TAIL_COLUMNS = ("forecast_date", "level_bp", "confidence_level", "value_at_risk", "expected_shortfall")


def forecasts_of(model: str | Model, inputs: Inputs) -> DataFrame:
    """The fact table's rows of a registered model, on the schedule of each portfolio. A model whose tails lack a column is refused before anything runs."""
    m = model if isinstance(model, Model) else model_of(model)
    tails = m.tails(inputs)
    if missing := {*TAIL_COLUMNS, *inputs.by, *m.extra} - set(tails.columns):
        raise ValueError(f"{m.name} lacks {sorted(missing)}")
    tails = tails.select(*inputs.by, *TAIL_COLUMNS, *m.extra)
    number = registered().index(m.name) if m.name in _REGISTRY else len(_REGISTRY)
    return as_forecasts(m.name, number, tails, forecast_schedule(inputs.portfolio, inputs.window, inputs.by), m.extra, inputs.by)


def _gaussian_of(decay: bool) -> Model:
    def drawn(i: Inputs) -> DataFrame:
        from .simulation import monte_carlo

        return monte_carlo(i.returns, i.weights, i.window, i.levels, i.scenarios, i.seed, i.decay if decay else None, i.by)

    def exact(i: Inputs) -> DataFrame:
        return ewma_gaussian(i.returns, i.weights, i.window, i.decay, i.levels, i.by) if decay else rolling_gaussian(i.returns, i.weights, i.window, i.levels, i.by)

    return Model(MODELS[decay], drawn, DRAWS, exact)


def _filtered(i: Inputs) -> DataFrame:
    from .simulation import filtered_historical

    return filtered_historical(i.returns, i.weights, i.window, i.levels, i.decay, i.scenarios, i.seed, i.by)


register(_gaussian_of(False))
register(_gaussian_of(True))
register(Model(MODELS[2], _filtered, DRAWS))


def model_forecasts(model: str, returns: DataFrame, portfolio: DataFrame, weights: DataFrame, window: int, levels: Sequence[float] = LEVELS, decay: float = 0.94, scenarios: int = 100_000, seed: int = 20261002, by: Sequence[str] = ()) -> DataFrame:
    """``forecasts_of`` a model by its name."""
    return forecasts_of(model, Inputs(returns, portfolio, weights, window, levels, decay, scenarios, seed, by))
