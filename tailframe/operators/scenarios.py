"""Scenario tables: the assets' simulated returns of each date, and what a portfolio loses in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from . import kernels
from .contracts import guarded
from .simulation import square


@udtf(returnType="forecast_date date, scenario long, asset_no int, ret double")
class ReturnScenarios:
    """A table function over dates (``moments.packed``), partitioned by date: SELECT * FROM return_scenarios(TABLE(dates) PARTITION BY (forecast_date), scenarios, seed).

    Rows are the Gaussian return of every asset in every scenario. All dates share the seed's shocks; a worker draws them once.
    """

    def eval(self, date, scenarios: int, seed: int) -> Iterator[tuple]:
        mu, day = np.asarray(date["mu"], dtype=float), date["forecast_date"]
        x = mu + kernels.normal_shocks(scenarios, len(mu), seed) @ kernels.lower_factor(square(date["cov"], len(mu))).T
        for scenario, row in enumerate(x.tolist()):
            for asset, ret in enumerate(row):
                yield day, scenario, asset, ret


def register(spark) -> None:
    """Makes ``return_scenarios`` known to SQL."""
    spark.udtf.register("return_scenarios", ReturnScenarios)


def return_scenarios(dates: DataFrame, scenarios: int, seed: int) -> DataFrame:
    """forecast_date, scenario, asset_no, ret: Gaussian scenarios of ``packed`` dates, mean plus shocks through the Cholesky factor."""
    kernels.check_draws(scenarios, seed)
    table = dates.select("forecast_date", "mu", "cov").asTable().partitionBy("forecast_date")
    return ReturnScenarios(table, F.lit(scenarios), F.lit(seed))


def factors(dates: DataFrame) -> DataFrame:
    """forecast_date, session_no, mu, lower: the strict Cholesky factor of each date, row by row."""

    @F.pandas_udf("array<array<double>>")
    def lower_of(cov: pd.Series, mu: pd.Series) -> pd.Series:
        return pd.Series([kernels.lower_factor(square(c, len(m)), strict=True).tolist() for c, m in zip(cov, mu, strict=True)])

    return dates.select("forecast_date", "session_no", "mu", lower_of("cov", "mu").alias("lower"))


def filtered_scenarios(dates: DataFrame, residuals: DataFrame, window: int, scenarios: int, seed: int) -> DataFrame:
    """forecast_date, pool_position, draws, asset_no, ret: the returns of each residual of a date's pool, rescaled by the date's factor, and how often the seed draws it.

    A date has only ``window`` distinct scenarios, so they are counted, not repeated. Residuals meet dates by the numbers of their sessions; the rescaling is a native expression.
    """
    kernels.check_draws(scenarios, seed)
    times = F.array(*(F.lit(int(k)).cast("long") for k in kernels.multiplicity(window, scenarios, seed)))
    need = factors(dates).withColumn("n", F.explode(F.expr(f"sequence(session_no - {window}, session_no - 1)")))
    met = need.join(residuals.select(F.col("session_no").alias("n"), "z"), "n", "left")
    z = guarded(F.col("z").isNotNull(), F.col("z"), "a residual of a pool is missing")
    add = lambda s, v: s + v
    ret = F.transform("lower", lambda row, i: F.get("mu", i) + F.aggregate(F.zip_with(row, "z", lambda a, b: a * b), F.lit(0.0), add))
    rows = met.withColumn("z", z).select("forecast_date", (F.col("n") - F.col("session_no") + window).cast("int").alias("pool_position"), F.posexplode(ret).alias("asset_no", "ret"))
    return rows.withColumn("draws", F.get(times, F.col("pool_position")))


def losses_of(table: DataFrame, weights: DataFrame) -> DataFrame:
    """forecast_date, pool_position, draws, loss: what the weights with which each session begins (session_date, asset_no, begin_weight) lose in each scenario of the table."""
    w = weights.select(F.col("session_date").alias("forecast_date"), "asset_no", "begin_weight")
    met = table.join(w, ["forecast_date", "asset_no"], "left")
    loss = -F.sum(guarded(F.col("begin_weight").isNotNull(), F.col("begin_weight"), "a scenario's asset has no weight") * F.col("ret"))
    return met.groupBy("forecast_date", "pool_position", "draws").agg(loss.alias("loss"))
