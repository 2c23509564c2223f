"""Weights and the drift-and-rebalance path, without a loop over sessions.

``by`` names the columns that tell portfolios apart in ``targets``. Growth is shared by all portfolios that hold an asset; every
portfolio is a partition of its own from there on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tailframe.sources import store

FREQUENCIES = ("monthly", "daily", "never")


def equal_weights(assets: DataFrame, cash: float = 0.0) -> DataFrame:
    """asset, weight: (1 - cash) dealt evenly. The table has one row per asset."""
    if not 0 <= cash < 1:
        raise ValueError("cash lies in [0, 1)")
    names = assets.select("asset").distinct()
    n = names.agg(F.count("*").alias("n"))
    return names.crossJoin(F.broadcast(n)).select("asset", ((1 - F.lit(cash)) / F.col("n")).alias("weight"))


def rebalances(day: Column, following: Column, frequency: str) -> Column:
    """Whether weights return to target after the close: the next session is in another month; never after the last."""
    if frequency not in FREQUENCIES:
        raise ValueError(f"frequency is one of {FREQUENCIES}")
    if frequency == "never":
        return F.lit(False)
    later = following.isNotNull()
    return later if frequency == "daily" else later & (F.trunc(day, "MM") != F.trunc(following, "MM"))


def asset_path(returns: DataFrame, targets: DataFrame, frequency: str = "monthly", by: Sequence[str] = ()) -> DataFrame:
    """Per portfolio, session and asset: block, target weight, growth since the block began (before and after the session),
    and the whole portfolio's growth g0 and g1 at the same times.

    A block runs from one rebalance to the next; inside it every holding grows by its own returns, so growth
    is a product over the block and no session waits for the one before. ``returns`` is read twice.
    """
    days = returns.select("session_date").distinct()
    order = W.orderBy("session_date")  # distinct dates only
    days = days.withColumn("rebalanced_after_close", rebalances(F.col("session_date"), F.lead("session_date").over(order), frequency))
    days = days.withColumn("block", F.coalesce(F.sum(F.col("rebalanced_after_close").cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    grown = returns.join(days, "session_date")
    w = W.partitionBy("asset", "block").orderBy("session_date")
    growth = F.product(1 + F.col("ret"))
    grown = grown.withColumns({"after": growth.over(w.rowsBetween(W.unboundedPreceding, 0)), "before": F.coalesce(growth.over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(1.0))})
    held = grown.join(targets.select(*by, "asset", "weight"), "asset")
    whole = W.partitionBy(*by, "session_date")
    cash = 1 - F.sum("weight").over(whole)
    total = lambda c: F.sum(F.col("weight") * F.col(c)).over(whole) + cash
    numbers = [c for c in ("session_no", "asset_no") if c in returns.columns]
    return held.select(*by, "session_date", "asset", *numbers, "rebalanced_after_close", "block", "weight", "before", "after", cash.alias("cash"), total("before").alias("g0"), total("after").alias("g1"))


def weights_of(path: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """session_date, asset, begin_weight, pre_rebalance_weight (drifted to the close), and asset_no if the returns have it."""
    numbers = [c for c in ("asset_no",) if c in path.columns]
    w = F.col("weight")
    return path.select(*by, "session_date", "asset", *numbers, (w * F.col("before") / F.col("g0")).alias("begin_weight"), (w * F.col("after") / F.col("g1")).alias("pre_rebalance_weight"))


def path_of(path: DataFrame, initial_value: float = 1_000_000.0, by: Sequence[str] = ()) -> DataFrame:
    """Daily value, return, profit, dollar loss and turnover, from ``asset_path``; one portfolio's sessions lie in one task."""
    if not initial_value > 0:
        raise ValueError("the initial value must be positive")
    moved = F.abs(F.col("weight") - F.col("weight") * F.col("after") / F.col("g1"))
    g = path.groupBy(*by, "session_date", "block", "rebalanced_after_close").agg(F.first("g0").alias("g0"), F.first("g1").alias("g1"), (F.sum(moved) + F.first(F.abs(F.col("cash") - F.col("cash") / F.col("g1")))).alias("moved"))
    at = W.partitionBy(*by).orderBy("session_date")
    g = g.withColumn("ended", F.when(F.lead("block").over(at) != F.col("block"), F.col("g1")).otherwise(F.lit(1.0)))
    base = F.coalesce(F.product("ended").over(at.rowsBetween(W.unboundedPreceding, -1)), F.lit(1.0)) * initial_value
    v = g.withColumns({"beginning_value": base * F.col("g0"), "ending_value": base * F.col("g1"), "portfolio_return": F.col("g1") / F.col("g0") - 1})
    pnl = F.col("ending_value") - F.col("beginning_value")
    turnover = F.when(F.col("rebalanced_after_close"), F.col("moved") / 2).otherwise(F.lit(0.0))
    return v.select(*by, "session_date", "beginning_value", "portfolio_return", pnl.alias("pnl"), (-pnl).alias("loss"), "ending_value", "rebalanced_after_close", turnover.alias("turnover"))


def portfolio_weights(returns: DataFrame, targets: DataFrame, frequency: str = "monthly", by: Sequence[str] = ()) -> DataFrame:
    """``weights_of`` the stored path of every asset."""
    return weights_of(store.working_table(asset_path(returns, targets, frequency, by), "assets"), by)


def portfolio_path(returns: DataFrame, targets: DataFrame, initial_value: float = 1_000_000.0, frequency: str = "monthly", by: Sequence[str] = ()) -> DataFrame:
    """``path_of`` the stored path of every asset. Holdings earn their returns, cash earns nothing."""
    if not initial_value > 0:
        raise ValueError("the initial value must be positive")
    return path_of(store.working_table(asset_path(returns, targets, frequency, by), "assets"), initial_value, by)


def rebalance_summary(path: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return path.groupBy(*by).agg(F.count_if("rebalanced_after_close").alias("rebalance_count"), F.sum("turnover").alias("total_turnover"))
