"""Returns, flags, gaps and diagnostics of price panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tailframe.functions.special import sample_kurtosis, sample_skewness
from tailframe.sources import store

LOSS_LEVELS = (0.95, 0.975, 0.99)


def simple_returns(prices: DataFrame) -> DataFrame:
    """price / previous price - 1 by asset; null where either is missing. Gaps are rows with a null price."""
    w = W.partitionBy("asset").orderBy("session_date")
    return prices.select("session_date", "asset", (F.col("price") / F.lag("price").over(w) - 1).alias("ret"))


def on_all_sessions(prices: DataFrame) -> DataFrame:
    """Adds a null price for each asset and session that lacks one."""
    sessions, assets = prices.select("session_date").distinct(), prices.select("asset").distinct()
    grid = sessions.crossJoin(assets)  # the cells of the panel itself
    return grid.join(prices, ["session_date", "asset"], "left")


def drop_empty_sessions(returns: DataFrame) -> DataFrame:
    """Drops sessions in which no asset has a return."""
    return returns.withColumn("_n", F.count("ret").over(W.partitionBy("session_date"))).where("_n > 0").drop("_n")


def complete_returns(returns: DataFrame) -> DataFrame:
    """Keeps the sessions in which every asset of the panel has a return, numbered anew: what a portfolio needs.

    An asset that has no row at all in a session counts as missing there.
    """
    assets = returns.agg(F.count_distinct("asset").alias("_all"))  # one row
    full = returns.withColumn("_n", F.count("ret").over(W.partitionBy("session_date"))).crossJoin(F.broadcast(assets)).where("_n = _all")
    return numbered(store.working_table(full.select("session_date", "asset", "ret"), "complete"))


def numbered(returns: DataFrame) -> DataFrame:
    """Adds session_no and asset_no, dense from 0, in date and name order. There are few distinct dates and assets.

    The table is read three times: give it a stored one.
    """
    sessions = returns.select("session_date").distinct().withColumn("session_no", F.row_number().over(W.orderBy("session_date")) - 1)
    assets = returns.select("asset").distinct().withColumn("asset_no", F.row_number().over(W.orderBy("asset")) - 1)
    return returns.join(sessions, "session_date").join(assets, "asset").select("session_date", "session_no", "asset", "asset_no", "ret")


def asset_returns(prices: DataFrame) -> DataFrame:
    """Numbered returns of a panel without the first session. Plain returns are stored, so that the prices are read once."""
    return numbered(store.working_table(drop_empty_sessions(simple_returns(prices)), "returns"))


def large_return_flags(returns: DataFrame, threshold: float) -> DataFrame:
    """Adds flag: the absolute return reaches the threshold. Missing returns are not flagged, flagged ones are kept."""
    if not threshold > 0:
        raise ValueError("the threshold must be positive")
    return returns.withColumn("flag", F.coalesce(F.abs("ret") >= threshold, F.lit(False)))


def missing_counts(prices: DataFrame) -> DataFrame:
    return prices.groupBy("asset").agg(F.count_if(F.col("price").isNull()).alias("missing"))


def return_diagnostics(returns: DataFrame, column: str = "ret", sessions_per_year: int = 252, by: tuple[str, ...] = ()) -> DataFrame:
    """Moments, annualised moments, loss quantiles and extremes in one aggregation; the earliest date wins ties."""
    r = F.col(column)
    day = F.col("session_date")
    losses = F.percentile(-r, F.array(*(F.lit(x) for x in LOSS_LEVELS)))
    out = returns.groupBy(*by).agg(
        F.count(r).alias("observation_count"),
        F.avg(r).alias("mean_return"),
        F.var_samp(r).alias("variance"),
        F.stddev_samp(r).alias("volatility"),
        (F.avg(r) * sessions_per_year).alias("annualized_mean_return"),
        (F.stddev_samp(r) * F.sqrt(F.lit(float(sessions_per_year)))).alias("annualized_volatility"),
        sample_skewness(r).alias("skewness"),
        sample_kurtosis(r).alias("excess_kurtosis"),
        losses.alias("q"),
        F.min(r).alias("worst_return"),
        F.min_by(day, F.struct(r, day)).alias("worst_date"),
        F.max(r).alias("best_return"),
        F.min_by(day, F.struct(-r, day)).alias("best_date"),
    )
    return out.select(*by, *(c for c in out.columns if c not in (*by, "q")), *(F.col("q")[n].alias(f"loss_q{int(x * 1000):03d}") for n, x in enumerate(LOSS_LEVELS)))
