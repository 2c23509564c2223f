"""Rolling and exponentially weighted moments as window aggregates, and the table of what one date's forecast needs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .contracts import guarded

SHORT = "a forecast's window holds missing returns"


def check_window(window: int) -> None:
    if isinstance(window, bool) or not isinstance(window, int) or window < 2:
        raise ValueError("a window has two sessions or more")


def windowed(rows: DataFrame, keys: Sequence[str], at: str, x: str, y: str, window: int, keep: Sequence[str]) -> DataFrame:
    """keys, at, keep, n, mean, cov: of the ``window`` sessions before each row from number ``window`` on, the pairs of x and y that are known, x's mean and
    the sample covariance.

    Time is cut into blocks of ``window`` sessions. A window is the end of one block and the beginning of the next, so what runs forwards over the
    one and backwards over the other is merged: a step for each row instead of a window of rows, and blocks are tasks of their own.
    """
    block, own = F.expr(f"{at} div {window}"), F.col("_own")
    r = rows.withColumn("_b", F.explode(F.array(block, block + 1))).withColumns({"_own": F.col("_b") == block, "_o": F.col(at) % window})
    r = r.repartition(*keys, "_b").withColumns({"_x": F.when(F.col(y).isNotNull(), F.col(x)), "_y": F.when(F.col(x).isNotNull(), F.col(y))})
    part = W.partitionBy(*keys, "_b", "_own")
    past, rest = part.orderBy(at).rowsBetween(W.unboundedPreceding, -1), part.orderBy(F.desc(at)).rowsBetween(W.unboundedPreceding, 0)
    for name, w in (("p", past), ("s", rest)):
        r = r.withColumns({f"_{name}n": F.count("_x").over(w), f"_{name}x": F.avg("_x").over(w), f"_{name}y": F.avg("_y").over(w), f"_{name}c": F.covar_pop("_x", "_y").over(w)})
    mine = lambda c: F.max(F.when(own, F.col(c)))
    other = lambda c: F.max(F.when(~own, F.col(c)))
    parts = {f"p{c}": mine(f"_p{c}") for c in "nxyc"} | {f"s{c}": other(f"_s{c}") for c in "nxyc"}
    g = r.groupBy(*keys, "_b", "_o").agg(mine(at).alias(at), *(mine(c).alias(c) for c in keep if c != at), *(c.alias(f"_{n}") for n, c in parts.items())).where(f"{at} >= {window}")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    n1, n2 = (F.coalesce(f"_{k}n", F.lit(0)).cast("double") for k in "ps")
    n = n1 + n2
    mean = (n1 * zero("_px") + n2 * zero("_sx")) / n
    apart = F.when((n1 > 0) & (n2 > 0), (F.col("_px") - F.col("_sx")) * (F.col("_py") - F.col("_sy")) * n1 * n2 / n).otherwise(F.lit(0.0))
    cov = (n1 * zero("_pc") + n2 * zero("_sc") + apart) / (n - 1)
    return g.select(*keys, at, *(c for c in keep if c != at), n.cast("long").alias("n"), F.when(n > 0, mean).alias("mean"), F.when(n > 1, cov).alias("cov"))


def rolling_univariate(portfolio: DataFrame, window: int, by: Sequence[str] = ()) -> DataFrame:
    """forecast_date, mean_return, volatility over the ``window`` sessions before. A missing return in a window is an error."""
    check_window(window)
    number = (F.row_number().over(W.partitionBy(*by).orderBy("session_date")) - 1).alias("_t")  # a row for each session
    x = portfolio.select(*by, "session_date", F.col("portfolio_return").alias("r"), number)
    r = windowed(x, by, "_t", "r", "r", window, ["session_date"])
    return r.select(*by, F.col("session_date").alias("forecast_date"), guarded(F.col("n") == window, F.col("mean"), SHORT).alias("mean_return"), F.sqrt("cov").alias("volatility"))


def rolling_means(returns: DataFrame, window: int) -> DataFrame:
    """forecast_date, session_no, asset_no, mu, and the session's own innovation u = ret - mu (for later sessions only).

    A window that does not hold ``window`` returns, or a session without one, is an error.
    """
    check_window(window)
    r = windowed(returns.select("session_date", "session_no", "asset_no", "ret"), ["asset_no"], "session_no", "ret", "ret", window, ["session_date", "ret"])
    r = r.withColumn("mu", guarded((F.col("n") == window) & F.col("ret").isNotNull(), F.col("mean"), SHORT))
    return r.select(F.col("session_date").alias("forecast_date"), "session_no", "asset_no", "mu", (F.col("ret") - F.col("mu")).alias("u"))


def asset_pairs(returns: DataFrame) -> DataFrame:
    """session_date, session_no, i <= j and both returns."""
    a = returns.select("session_date", "session_no", F.col("asset_no").alias("i"), F.col("ret").alias("ri"))
    b = returns.select("session_no", F.col("asset_no").alias("j"), F.col("ret").alias("rj"))
    return a.join(b, "session_no").where("i <= j")


def rolling_covariance(returns: DataFrame, window: int) -> DataFrame:
    """forecast_date, session_no, i, j, cov: sample covariance of the ``window`` sessions before, by pair, all of them whole."""
    check_window(window)
    p = windowed(asset_pairs(returns), ["i", "j"], "session_no", "ri", "rj", window, ["session_date"])
    return p.select(F.col("session_date").alias("forecast_date"), "session_no", "i", "j", guarded(F.col("n") == window, F.col("cov"), SHORT).alias("cov"))


def first_covariance(returns: DataFrame, window: int) -> DataFrame:
    """i, j, cov of the first ``window`` sessions."""
    c = asset_pairs(returns.where(F.col("session_no") < window)).groupBy("i", "j").agg(F.covar_samp("ri", "rj").alias("c"), F.count(F.col("ri") + F.col("rj")).alias("n"))
    return c.select("i", "j", guarded(F.col("n") == window, F.col("c"), SHORT).alias("cov"))


def ewma_covariance(returns: DataFrame, window: int, decay: float, means: DataFrame | None = None) -> DataFrame:
    """forecast_date, session_no, i, j, cov with cov(t + 1) = decay cov(t) + (1 - decay) u(t) u(t)', started from the first window.

    With k the forecast's number this is decay^k cov(0) + (1 - decay) decay^(k-1) sum over s < k of decay^-s u(s) u(s)', a running
    sum. Powers would overflow after some 700 / -ln(decay) forecasts, so sums restart in blocks; over a
    block the past fades by exp(-600), and the block before is all that is left of it. ``means``: a stored ``rolling_means``.
    """
    if not 0 < decay < 1:
        raise ValueError("the decay lies between 0 and 1")
    m = rolling_means(returns, window) if means is None else means
    block = max(1, int(600 / -math.log(decay)))
    u = m.select("forecast_date", "session_no", F.col("asset_no").alias("i"), F.col("u").alias("ui")).join(m.select("session_no", F.col("asset_no").alias("j"), F.col("u").alias("uj")), "session_no").where("i <= j")
    u = u.withColumn("k", (F.col("session_no") - window).cast("int")).withColumns({"b": F.expr(f"k div {block}"), "s": F.expr(f"k % {block}")})
    lam = F.lit(float(decay))
    inside = W.partitionBy("i", "j", "b").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("i", "j").orderBy("b").rangeBetween(-1, -1)  # the rows of the block before
    product = F.col("ui") * F.col("uj")
    fresh = (1 - lam) * F.pow(lam, F.col("s") - 1) * F.coalesce(F.sum(F.pow(lam, -F.col("s")) * product).over(inside), F.lit(0.0))
    carry = (1 - lam) * F.sum(F.pow(lam, F.lit(block - 1) - F.col("s")) * product).over(before)
    out = u.withColumns({"carry": carry, "fresh": fresh}).join(first_covariance(returns, window), ["i", "j"])
    start = F.when(F.col("b") == 0, F.col("cov")).otherwise(F.col("carry"))
    return out.select("forecast_date", "session_no", "i", "j", (F.pow(lam, F.col("s")) * start + F.col("fresh")).alias("cov"))


def in_order(index: str, value: str) -> Column:
    """Aggregate: the values as an array in the order of ``index``."""
    return F.transform(F.array_sort(F.collect_list(F.struct(index, value))), lambda x: x[value])


def packed(means: DataFrame, cov: DataFrame, weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """forecast_date, session_no, mu, u, cov (pairs i <= j in order) and w: what one date's forecast needs, a row for each portfolio.

    All tables are grouped by the date, so the joins move nothing again. A date without a weight for every asset is an error.

    weights: session_date, asset_no, begin_weight.
    """
    m = means.groupBy("forecast_date").agg(F.first("session_no").alias("session_no"), in_order("asset_no", "mu").alias("mu"), in_order("asset_no", "u").alias("u"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "cov"))), lambda x: x["cov"])
    c = cov.groupBy("forecast_date").agg(pairs.alias("cov"))
    w = weights.groupBy(F.col("session_date").alias("forecast_date"), *by).agg(in_order("asset_no", "begin_weight").alias("w"))
    out = m.join(c, "forecast_date").join(w, "forecast_date", "left")
    whole = F.coalesce(F.size("w") == F.size("mu"), F.lit(False))
    return out.withColumn("w", guarded(whole, F.col("w"), "a forecast date lacks weights of some asset"))


def moments_of(dates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """forecast_date, mean_return, variance, volatility of the weights with which each session begins, from ``packed``."""
    add = lambda s, x: s + x
    mean = F.aggregate(F.zip_with("w", "mu", lambda a, b: a * b), F.lit(0.0), add)
    pairs = F.expr("flatten(transform(sequence(0, size(w) - 1), i -> transform(sequence(i, size(w) - 1), j -> w[i] * w[j] * IF(i = j, 1.0D, 2.0D))))")
    variance = F.aggregate(F.zip_with(pairs, "cov", lambda a, b: a * b), F.lit(0.0), add)
    out = dates.select(*by, "forecast_date", mean.alias("mean_return"), variance.alias("variance"))
    return out.withColumn("volatility", F.sqrt("variance"))


def portfolio_moments(means: DataFrame, cov: DataFrame, weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return moments_of(packed(means, cov, weights, by), by)
