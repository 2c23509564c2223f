"""Monte Carlo and filtered historical simulation: dates in parallel, one numpy kernel per date."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tailframe.sources import store

from . import kernels
from .contracts import guarded
from .models import BLOCK, packed_dates, with_blocks
from .moments import SHORT, in_order
from .schedule import LEVELS, check_levels
from .tails import tail_risk

SIMULATED = "forecast_date date, level_bp int, confidence_level double, simulated_mean_return double, simulated_volatility double, scenario_count long, random_seed long, tail_scenario_count long, value_at_risk double, expected_shortfall double"
NAMES = [c.split()[0] for c in SIMULATED.split(", ")]
#: Dates whose losses a task holds at once (by 100,000 scenarios: 13 MB).
DATES = 16


def square(pairs: Sequence[float], n: int) -> np.ndarray:
    out = np.zeros((n, n))
    out[np.triu_indices(n)] = pairs
    return np.triu(out) + np.triu(out, 1).T


#: Scenarios of one date that a task draws.
SCENARIO_BLOCK = 1 << 16


def keyed(df: DataFrame, by: Sequence[str], schema: str) -> str:
    """The schema with the columns that tell portfolios apart first."""
    return ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), schema])


def monte_carlo_of(dates: DataFrame, levels: Sequence[float] = LEVELS, scenarios: int = 100_000, seed: int = 20261002, by: Sequence[str] = ()) -> DataFrame:
    """Gaussian Monte Carlo VaR and ES by date and level, from ``packed`` rows. All dates and portfolios share the shocks.

    A task holds all scenarios of DATES dates; for scenarios beyond its memory see ``monte_carlo_by_scenario``.
    """
    check_levels(levels)
    kernels.check_draws(scenarios, seed)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for i in range(0, len(part), DATES):
                some = part.iloc[i : i + DATES]
                w = [np.asarray(x) for x in some["w"]]
                pulled = np.stack([kernels.lower_factor(square(c, len(x))).T @ x for c, x in zip(some["cov"], w, strict=True)], axis=1)
                means = np.array([np.dot(x, m) for x, m in zip(w, some["mu"], strict=True)])
                losses = kernels.losses_of_dates(means, pulled, scenarios, seed)
                for key, x in zip(some[[*by, "forecast_date"]].itertuples(index=False), losses, strict=True):
                    mean, vol = -x.mean(), x.std(ddof=1)
                    for level, (var, es, tail) in zip(levels, kernels.empirical_tails(x, levels), strict=True):
                        rows.append((*key, round(level * 10000), level, mean, vol, scenarios, seed, tail, var, es))
            yield pd.DataFrame(rows, columns=[*by, *NAMES])

    return dates.select(*by, "forecast_date", "mu", "cov", "w").repartition(*by, "forecast_date").mapInPandas(run, keyed(dates, by, SIMULATED))


def state_table(spark: SparkSession, scenarios: int, assets: int, seed: int) -> DataFrame:
    """first, state: where each block of scenarios begins, and the generator there. Stored, so that any task can draw any block."""
    block = SCENARIO_BLOCK

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _ in range(len(part)):
                yield pd.DataFrame(kernels.generator_states(scenarios, assets, seed, block), columns=["first", "state"])

    return store.working_table(spark.range(1).mapInPandas(run, "first long, state string"), "states")


def scenario_losses(dates: DataFrame, scenarios: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """by, forecast_date, scenario, loss: the losses of every scenario of ``packed`` dates, one date's blocks over many tasks.

    The draws are those of one generator for all scenarios, as in ``monte_carlo_of``. A task holds a block of shocks and its losses of DATES dates. Dates must have one number of assets.
    """
    kernels.check_draws(scenarios, seed)
    block = SCENARIO_BLOCK
    sizes = [r[0] for r in dates.select(F.size("w")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError("dates have different numbers of assets")
    schema = keyed(dates, by, "forecast_date date, scenario long, loss double")
    if not sizes:
        return dates.sparkSession.createDataFrame([], schema)
    assets = sizes[0]
    states = store.sized(state_table(dates.sparkSession, scenarios, assets, seed))
    some = dates.select(*by, "forecast_date", "mu", "cov", "w").withColumn("_some", F.expr(f"unix_date(forecast_date) div {DATES}"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        first = int(part["first"].iloc[0])
        shocks = kernels.draws_from(part["state"].iloc[0], min(block, scenarios - first), assets)
        out = []
        for *key, mu, cov, w in part[[*by, "forecast_date", "mu", "cov", "w"]].itertuples(index=False):
            w = np.asarray(w)
            x = -(np.dot(w, mu) + shocks @ (kernels.lower_factor(square(cov, len(w))).T @ w))
            out.append(pd.DataFrame({**dict(zip([*by, "forecast_date"], key, strict=True)), "scenario": np.arange(first, first + len(x)), "loss": x}))
        return pd.concat(out)

    return some.crossJoin(states).groupBy(*by, "_some", "first").applyInPandas(run, schema)


def monte_carlo_by_scenario(dates: DataFrame, levels: Sequence[float] = LEVELS, scenarios: int = 100_000, seed: int = 20261002, by: Sequence[str] = ()) -> DataFrame:
    """``monte_carlo_of`` for any number of scenarios: losses are drawn by many tasks for each date, stored, and their tails selected by counts."""
    losses = store.working_table(scenario_losses(dates, scenarios, seed, by), "scenario-losses")
    keys = [*by, "forecast_date"]
    seen = losses.groupBy(*keys).agg((-F.avg("loss")).alias("simulated_mean_return"), F.stddev_samp("loss").alias("simulated_volatility"))
    tails_ = tail_risk(losses, levels, keys).withColumnsRenamed({"observation_count": "scenario_count", "tail_count": "tail_scenario_count"}).withColumn("random_seed", F.lit(seed).cast("long"))
    same = F.lit(True)
    for c in keys:
        same = same & tails_[c].eqNullSafe(seen[c])
    return tails_.join(seen, same).select(*(tails_[c] for c in by), *(seen[c] if c.startswith("simulated") else tails_[c] for c in NAMES))


def monte_carlo(returns: DataFrame, weights: DataFrame, window: int, levels: Sequence[float] = LEVELS, scenarios: int = 100_000, seed: int = 20261002, decay: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``monte_carlo_of`` rolling moments, or of EWMA covariances with ``decay``."""
    return monte_carlo_of(packed_dates(returns, weights, window, decay, by), levels, scenarios, seed, by)


def residuals_of(returns: DataFrame, dates: DataFrame, window: int) -> DataFrame:
    """session_no, residual_date, z: every session's standardised innovation; ``dates`` is a stored ``packed`` table.

    Sessions with a forecast use the mean and covariance forecast for them; the first window uses its own moments. Residuals are the assets', so portfolios share them:
    of a date that has rows of several portfolios one is looked at.
    """
    dates = dates.select("session_no", "forecast_date", "mu", "u", "cov").dropDuplicates(["session_no"])
    first = dates.where(F.col("session_no") == window).select("mu", "cov")  # one row
    early = returns.where(F.col("session_no") < window).groupBy("session_no", F.col("session_date").alias("residual_date")).agg(in_order("asset_no", "ret").alias("ret"))
    early = early.crossJoin(F.broadcast(first)).select("session_no", "residual_date", guarded(F.size("ret") == F.size("mu"), F.zip_with("ret", "mu", lambda r, m: r - m), SHORT).alias("u"), "cov")
    late = dates.select("session_no", F.col("forecast_date").alias("residual_date"), "u", "cov")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            z = [kernels.standardize(np.asarray(u), square(c, len(u))) for u, c in zip(part["u"], part["cov"], strict=True)]
            yield pd.DataFrame({"session_no": part["session_no"], "residual_date": part["residual_date"], "z": z})

    return early.union(late).mapInPandas(run, "session_no int, residual_date date, z array<double>")


def residual_table(returns: DataFrame, weights: DataFrame, window: int, decay: float, by: Sequence[str] = ()) -> DataFrame:
    return residuals_of(returns, store.working_table(packed_dates(returns, weights, window, decay, by), "packed"), window)


def residual_pools(residuals: DataFrame, window: int) -> DataFrame:
    """forecast_date, and size, first and last date of the ``window`` residuals before each session: what it draws from."""
    w = W.orderBy("session_no").rowsBetween(-window, -1)  # a row for each session
    day = F.col("residual_date")
    pools = residuals.select(day.alias("forecast_date"), F.count("*").over(w).alias("pool_size"), F.min(day).over(w).alias("pool_start_date"), F.max(day).over(w).alias("pool_end_date"))
    return pools.where(F.col("pool_size") == window)


def filtered_historical_of(dates: DataFrame, residuals: DataFrame, window: int, levels: Sequence[float] = LEVELS, scenarios: int = 100_000, seed: int = 20261002, by: Sequence[str] = ()) -> DataFrame:
    """VaR and ES of resampled residuals, rescaled by each date's EWMA covariance (``packed``).

    A date has only ``window`` distinct losses, so drawn scenarios are counted, not built. Residuals are dealt to blocks
    of sessions with the window before them: a task gets each residual once, not once for every date.
    """
    check_levels(levels)
    kernels.check_draws(scenarios, seed)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=[*by, *NAMES])
        times, right = kernels.multiplicity(window, scenarios, seed), right.sort_values("session_no")
        at, z = right["session_no"].to_numpy(), np.stack(right["z"].to_list())
        rows = []
        for *key, day, no, mu, cov, w in left[[*by, "forecast_date", "session_no", "mu", "cov", "w"]].itertuples(index=False):
            w, stop = np.asarray(w), int(np.searchsorted(at, no))
            if stop < window or at[stop - window] != no - window:
                raise ValueError(f"residuals before {day} are missing")
            loading = kernels.lower_factor(square(cov, len(w)), strict=True).T @ w
            losses = -(np.dot(w, mu) + z[stop - window : stop] @ loading)
            mean = -(losses * times).sum() / scenarios
            vol = np.sqrt((times * (losses + mean) ** 2).sum() / (scenarios - 1))
            for level in levels:
                var, es, tail = kernels.weighted_tail(losses, times, level)
                rows.append((*key, day, round(level * 10000), level, mean, vol, scenarios, seed, tail, var, es))
        return pd.DataFrame(rows, columns=[*by, *NAMES])

    left = dates.select(*by, "forecast_date", "session_no", "mu", "cov", "w").withColumn("_block", F.expr(f"session_no div {BLOCK}"))
    return left.groupBy("_block").cogroup(with_blocks(residuals, "session_no", window).groupBy("_block")).applyInPandas(run, keyed(dates, by, SIMULATED))


def filtered_historical(returns: DataFrame, weights: DataFrame, window: int, levels: Sequence[float] = LEVELS, decay: float = 0.94, scenarios: int = 100_000, seed: int = 20261002, by: Sequence[str] = ()) -> DataFrame:
    """``filtered_historical_of`` the EWMA moments of the returns, which are stored once."""
    dates = store.working_table(packed_dates(returns, weights, window, decay, by), "packed")
    return filtered_historical_of(dates, residuals_of(returns, dates, window), window, levels, scenarios, seed, by)


def loss_histogram(losses: DataFrame, bins: int = 90) -> DataFrame:
    """left, right, density: a stored table of losses in bins of equal width from the least to the largest, the last one closed. Counted where the losses lie."""
    ends = losses.agg(F.min("loss").alias("a"), F.max("loss").alias("z"), F.count("*").alias("n")).where("n > 0")
    ends = ends.select("n", F.when(F.col("a") == F.col("z"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("z"), F.col("z") + 0.5).otherwise(F.col("z")).alias("z"))
    edge = lambda k: F.when(k == bins, F.col("z")).otherwise(F.col("a") + k * ((F.col("z") - F.col("a")) / bins))
    x, place = F.col("loss"), F.floor((F.col("loss") - F.col("a")) / (F.col("z") - F.col("a")) * bins).cast("int")
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), place))
    at = F.when(x < edge(at), at - 1).when((at < bins - 1) & (x >= edge(at + 1)), at + 1).otherwise(at)  # edges are numbers of their own
    counts = losses.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("c"))
    all_bins = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).join(counts, "bin", "left")
    left, right = edge(F.col("bin")), edge(F.col("bin") + 1)
    return all_bins.select(left.alias("left"), right.alias("right"), (F.coalesce("c", F.lit(0)) / F.col("n") / (right - left)).alias("density"))


def loss_marks(losses: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """level_bp, VaR and ES of the same losses: the lines drawn into the histogram."""
    return tail_risk(losses, levels).select("level_bp", "value_at_risk", "expected_shortfall")


def simulation_errors(analytic: DataFrame, simulated: DataFrame) -> DataFrame:
    """Bias, mean, median, 95 % and largest absolute error of simulated VaR and ES in basis points, by level and metric."""
    a = analytic.select("forecast_date", "level_bp", F.col("value_at_risk").alias("va"), F.col("expected_shortfall").alias("ea"))
    b = simulated.select("forecast_date", "level_bp", F.col("value_at_risk").alias("vb"), F.col("expected_shortfall").alias("eb"))
    both = a.join(b, ["forecast_date", "level_bp"], "full")
    both = both.withColumn("va", guarded(F.col("va").isNotNull() & F.col("vb").isNotNull(), F.col("va"), "a forecast is analytic or simulated only"))
    long = both.select("level_bp", F.expr("stack(2, 'value_at_risk', (vb - va) * 10000, 'expected_shortfall', (eb - ea) * 10000) as (metric, e)"))
    size = F.abs("e")
    return long.groupBy("level_bp", "metric").agg(
        F.count("*").alias("observation_count"), F.avg("e").alias("bias_bps"), F.avg(size).alias("mean_absolute_error_bps"), F.percentile(size, F.lit(0.5)).alias("median_absolute_error_bps"),
        F.percentile(size, F.lit(0.95)).alias("p95_absolute_error_bps"), F.max(size).alias("max_absolute_error_bps"),
    )
