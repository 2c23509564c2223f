"""Which sessions are forecast, from which window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEVELS = (0.95, 0.975, 0.99)


def check_levels(levels: Sequence[float]) -> Sequence[float]:
    """Rising numbers between 0 and 1; booleans are none."""
    bad = [x for x in levels if isinstance(x, bool) or not isinstance(x, (int, float)) or not 0 < x < 1]
    if not levels or bad or sorted(set(levels)) != list(levels):
        raise ValueError("levels rise and lie between 0 and 1")
    return levels


def forecast_schedule(portfolio_returns: DataFrame, window: int, by: Sequence[str] = ()) -> DataFrame:
    """One row per session with a full window before it: the window's ends, the realised return and loss (-return)."""
    if window < 2:
        raise ValueError("a window has two sessions or more")
    w = W.partitionBy(*by).orderBy("session_date")
    return portfolio_returns.select(
        *by, F.col("session_date").alias("forecast_date"), F.lag("session_date", window).over(w).alias("estimation_start_date"), F.lag("session_date", 1).over(w).alias("estimation_end_date"),
        F.col("portfolio_return").alias("realized_return"), (-F.col("portfolio_return")).alias("realized_loss"),
    ).where("estimation_start_date is not null")


def level_rows(spark, levels: Sequence[float] = LEVELS) -> DataFrame:
    """The level dimension: level_bp (an integer key), the level, its normal quantile and density."""
    from tailframe.functions.special import normal_point

    check_levels(levels)
    return spark.createDataFrame([(round(x * 10000), float(x), *normal_point(x)) for x in levels], "level_bp int, confidence_level double, z double, phi double")


def forecast_grid(schedule: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """Every forecast date with every level (a few rows, broadcast)."""
    return schedule.crossJoin(F.broadcast(level_rows(schedule.sparkSession, levels).select("level_bp", "confidence_level")))
