"""The model registry, scenario tables, many overlapping periods, and snapshots by model."""

from datetime import UTC, date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailframe.operators import evaluate as ev
from tailframe.operators import kernels, models, scenarios, simulation
from tailframe.sources import store

from .test_golden import panel, rows
from .test_tails import dates_of


def flat(i):
    """A model of its own: VaR and ES are fixed multiples of the volatility of the window."""
    t = models.rolling_gaussian_univariate(i.portfolio, i.window, i.levels, i.by)
    return t.withColumns({"value_at_risk": 2 * F.col("volatility"), "expected_shortfall": 3 * F.col("volatility"), "note": F.lit("flat")})


def test_a_registered_model_joins_the_others(spark, monkeypatch, tmp_path):
    """A fourth model goes through forecasts, scores, comparisons and a snapshot by model without a change to the library."""
    monkeypatch.setattr(models, "_REGISTRY", dict(models._REGISTRY))
    assert models.registered() == models.MODELS
    models.register(models.Model("flat", flat, ("note",)))
    with pytest.raises(ValueError, match="already"):
        models.register(models.Model("flat", lambda i: flat(i)))
    with pytest.raises(ValueError, match="one of"):
        models.model_of("none")
    models.register(models.Model("lame", lambda i: flat(i).drop("expected_shortfall")))
    _, r, w = panel(spark, 40)
    daily = r.join(w, ["session_date", "asset"]).groupBy("session_date").agg(F.sum(F.col("begin_weight") * F.col("ret")).alias("portfolio_return"))
    given = models.Inputs(r, daily, w, 20, (0.95, 0.99), scenarios=500, seed=1)
    with pytest.raises(ValueError, match="expected_shortfall"):
        models.forecasts_of("lame", given)
    f = {name: models.forecasts_of(name, given) for name in ("rolling-gaussian", "flat")}
    got = rows(f["flat"])
    assert len(got) == 40 and {q["model_no"] for q in got} == {3} and {q["note"] for q in got} == {"flat"}
    both = store.working_table(f["rolling-gaussian"].unionByName(f["flat"], allowMissingColumns=True), "both")
    assert {q["model"] for q in rows(ev.score_summary(both, ev.quantile_loss(), "quantile_loss"))} == {"rolling-gaussian", "flat"}
    assert {(q["model_a"], q["model_b"]) for q in rows(ev.diebold_mariano(both, 2))} == {("rolling-gaussian", "flat")}
    base = store.save_snapshot(str(tmp_path), "s", {"forecasts": both}, datetime(2026, 1, 1, tzinfo=UTC), partition_by={"forecasts": ["model"]})
    back = store.load_snapshot(spark, base)["forecasts"]
    assert sorted(map(repr, back.collect())) == sorted(map(repr, both.collect()))
    assert all("model=flat" in x for x in back.where("model = 'flat'").inputFiles() if "model=flat" in x) and "PartitionFilters: [isnotnull(model" in back.where("model = 'flat'")._jdf.queryExecution().executedPlan().toString()


def test_a_model_with_many_portfolios(spark):
    _, r, w = panel(spark, 30)
    daily = r.join(w, ["session_date", "asset"]).groupBy("session_date").agg(F.sum(F.col("begin_weight") * F.col("ret")).alias("portfolio_return"))
    books = lambda df: df.withColumn("book", F.lit(1)).unionByName(df.withColumn("book", F.lit(2)))
    out = rows(models.forecasts_of("filtered-historical", models.Inputs(r, books(daily), books(w), 20, (0.95,), scenarios=300, seed=1, by=("book",))))
    assert len(out) == 20 and {q["book"] for q in out} == {1, 2}


def test_return_scenarios(spark):
    """The table function's rows are numpy's, from the library and from SQL."""
    dates = dates_of(spark, 2)
    got = {(q["forecast_date"], q["scenario"], q["asset_no"]): q["ret"] for q in rows(scenarios.return_scenarios(dates, 200, 5))}
    for q in dates.collect():
        x = kernels.return_scenarios(np.array(q["mu"]), simulation.square(q["cov"], 3), 200, 5)
        assert np.array([[got[q["forecast_date"], k, a] for a in range(3)] for k in range(200)]) == pytest.approx(x, rel=1e-12)
    assert len(got) == 2 * 200 * 3
    scenarios.register(spark)
    dates.createOrReplaceTempView("some_dates")
    sql = spark.sql("SELECT * FROM return_scenarios(TABLE(SELECT forecast_date, mu, cov FROM some_dates) PARTITION BY (forecast_date), 200, 5)")
    assert {(q["forecast_date"], q["scenario"], q["asset_no"]): q["ret"] for q in rows(sql)} == got


def test_filtered_scenarios(spark):
    """Every residual of a pool, rescaled, and its losses, against the small kernels; counts are the generator's."""
    window, n = 6, 1000
    z = np.random.default_rng(3).normal(0, 1, (10, 3))
    pool = spark.createDataFrame([(k, date(2023, 12, 1) + timedelta(k), x.tolist()) for k, x in enumerate(z)], "session_no int, residual_date date, z array<double>")
    dates = dates_of(spark, 2).withColumn("session_no", F.when(F.col("forecast_date") == F.lit(date(2024, 1, 1)), 8).otherwise(10))
    table = scenarios.filtered_scenarios(dates, pool, window, n, 4)
    got = {(q["forecast_date"], q["pool_position"], q["asset_no"]): (q["ret"], q["draws"]) for q in rows(table)}
    assert len(got) == 2 * window * 3
    times = kernels.multiplicity(window, n, 4)
    weights = dates.select(F.col("forecast_date").alias("session_date"), F.posexplode("w").alias("asset_no", "begin_weight"))
    losses = {(q["forecast_date"], q["pool_position"]): q["loss"] for q in rows(scenarios.losses_of(table, weights))}
    for q in dates.collect():
        mu, cov = np.array(q["mu"]), simulation.square(q["cov"], 3)
        for p in range(window):
            own = z[q["session_no"] - window + p]
            assert [got[q["forecast_date"], p, a][0] for a in range(3)] == pytest.approx(mu + kernels.rescale(own, cov), rel=1e-12)
            assert got[q["forecast_date"], p, 0][1] == times[p]
            assert losses[q["forecast_date"], p] == pytest.approx(kernels.filtered_loss(mu, own, cov, np.array(q["w"])), rel=1e-12)
    with pytest.raises(Exception, match="residual of a pool is missing"):
        scenarios.filtered_scenarios(dates, pool.where("session_no <> 5"), window, n, 4).collect()


def test_many_overlapping_periods(spark, monkeypatch):
    """Beyond a few periods forecasts meet them by stretches of days: the same rows, no nested loop, also before 1970."""
    rng = np.random.default_rng(6)
    days = [date(1969, 6, 1) + timedelta(int(k)) for k in rng.integers(0, 800, 300)]
    f = spark.createDataFrame([(d, n) for n, d in enumerate(days)], "forecast_date date, n int")
    starts = [date(1969, 5, 1) + timedelta(int(k)) for k in rng.integers(0, 900, 400)]
    p = spark.createDataFrame([(f"p{k}", a, a + timedelta(int(rng.integers(-2, 300)))) for k, a in enumerate(starts)], "period_id string, requested_start_date date, requested_end_date date")
    many = ev.by_period(f, p)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    monkeypatch.setattr(ev, "FEW", 1000)
    few = ev.by_period(f, p)
    assert many.columns == few.columns
    same = lambda df: sorted((q["n"], q["period_id"]) for q in rows(df))
    assert same(many) == same(few) and len(same(few)) > 1000


def test_a_hundred_thousand_periods(spark):
    """Periods of a month, one for each of 100,000 starts, are joined in one pass."""
    f = spark.range(0, 2000).select(F.date_add(F.lit(date(1990, 1, 1)), F.col("id").cast("int")).alias("forecast_date"))
    p = spark.range(0, 100_000, 1, 4).select(F.col("id").cast("string").alias("period_id"), F.date_add(F.lit(date(1990, 1, 1)), F.expr("cast(id % 1970 as int)")).alias("requested_start_date")).withColumn("requested_end_date", F.date_add("requested_start_date", 29))
    assert ev.by_period(f, p).count() == 100_000 * 30
