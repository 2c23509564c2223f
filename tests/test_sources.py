"""The market source and its pushed filters, raw snapshots and their coverage, forecast rules one by one, portfolios told apart in every simulation."""

from datetime import UTC, date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailframe.functions import special
from tailframe.operators import contracts, models, portfolio, schedule, simulation
from tailframe.sources import market, snapshots, store

from .test_golden import business, returns_of, rows


def quotes(spark):
    data = [(date(2019, 12, 30) + timedelta(n), a, f, float(n + 10 * k)) for n in range(0, 400, 2) for k, a in enumerate(["A/B", "C D", "é"]) for f in ("Adj Close", "Volume")]
    return spark.createDataFrame([*data, (date(2020, 1, 1), "A/B", "Volume", None)], "session_date date, asset string, field string, value double")


def test_market_source(spark, tmp_path):
    """What was written is read; options and pushed filters agree with filters of Spark; nothing is overwritten."""
    q = quotes(spark)
    tree = market.write_tree(q, f"{tmp_path}/tree")
    with pytest.raises(Exception, match="(?i)exists"):
        market.write_tree(q, tree)
    with pytest.raises(Exception, match="no asset or date"):
        market.write_tree(spark.createDataFrame([(None, "A", "f", 1.0)], "session_date date, asset string, field string, value double"), f"{tmp_path}/bad")
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert same(market.read_tree(spark, tree), q)
    some = "session_date >= DATE'2020-03-01' AND session_date < DATE'2020-09-11' AND asset IN ('é', 'A/B') AND field = 'Volume' AND value > 3"
    assert same(market.read_tree(spark, tree).where(some), q.where(some)) and not q.where(some).isEmpty()
    assert same(market.read_tree(spark, tree, start="2020-03-01", end="2020-03-31", assets="C D", fields="Volume"), q.where("asset = 'C D' AND field = 'Volume' AND session_date BETWEEN DATE'2020-03-01' AND DATE'2020-03-31'"))
    assert market.read_tree(spark, tree).where("asset = 'none'").isEmpty()


def test_pushed_filters_skip_files(spark, tmp_path):
    tree = market.write_tree(quotes(spark), f"{tmp_path}/tree")
    whole = market.read_tree(spark, tree).rdd.getNumPartitions()
    assert whole == 9  # three assets by three years
    assert market.read_tree(spark, tree).where("session_date >= DATE'2020-06-01' AND session_date <= DATE'2020-12-31'").rdd.getNumPartitions() == 3
    assert market.read_tree(spark, tree).where("asset = 'C D' AND session_date >= DATE'2020-06-01'").rdd.getNumPartitions() == 2
    assert market.read_tree(spark, tree, start="2021-01-01", assets="é").rdd.getNumPartitions() == 1


def test_coverage_and_raw_snapshot(spark, tmp_path):
    days = [date(2024, 1, d) for d in (1, 2, 3, 4, 5)]
    data = [(d, "A", "Close", 1.0 + d.day) for d in days] + [(d, "B", "Close", 9.0) for d in days[1::2]] + [(days[2], "B", "Volume", None), (days[0], "B", "Volume", float("nan"))]
    df = spark.createDataFrame(data, "session_date date, asset string, field string, value double")
    got = {(r["scope"], r["asset"], r["field"]): (r["rows"], r["missing"], r["sessions"], r["gaps"], r["lowest"], r["highest"]) for r in snapshots.coverage(df).collect()}
    assert got == {
        ("asset_field", "A", "Close"): (5, 0, 5, 0, 2.0, 6.0), ("asset_field", "B", "Close"): (2, 0, 2, 1, 9.0, 9.0), ("asset_field", "B", "Volume"): (2, 2, 2, 1, None, None), ("asset", "A", None): (5, 0, 5, 0, 2.0, 6.0),
        ("asset", "B", None): (4, 2, 4, 0, 9.0, 9.0), ("field", None, "Close"): (7, 0, 5, 0, 2.0, 9.0), ("field", None, "Volume"): (2, 2, 2, 1, None, None), ("table", None, None): (9, 2, 5, 0, 2.0, 9.0),
    }
    assert snapshots.coverage(df.where("false")).isEmpty()
    base = snapshots.save_raw(str(tmp_path), "raw", df, {"assets": ["A", "B"], "start": "2024-01-01"}, datetime(2026, 1, 1, tzinfo=UTC))
    facts = store.load_manifest(spark, base)
    assert facts["facts"]["rows"] == 9 and facts["facts"]["fields"] == {"Close": 0, "Volume": 2} and facts["facts"]["assets"]["B"] == {"rows": 4, "missing": 2, "gaps": 0} and facts["lineage"]["request"]["start"] == "2024-01-01"
    assert store.load_snapshot(spark, base)["market"].count() == 9
    with pytest.raises(store.SnapshotError):
        snapshots.save_raw(str(tmp_path), "raw", df, {}, datetime(2026, 1, 1, tzinfo=UTC))


def forecasts(spark, n=30, window=5):
    x = np.random.default_rng(4).normal(0, 0.02, n)
    df = spark.createDataFrame(list(zip(business(n), x.tolist())), "session_date date, portfolio_return double")
    s = schedule.forecast_schedule(df, window)
    return models.as_forecasts("m", 0, models.rolling_gaussian_univariate(df, window), s), s


BREAKS = {
    "forecast is missing": lambda f: f.where("NOT (forecast_date = day AND level_bp = 9500)"),
    "model, date and level repeat": lambda f: f.union(f.where("forecast_date = day")),
    "date or window is not the schedule's": lambda f: f.withColumn("estimation_start_date", F.expr("IF(forecast_date = day, date_sub(estimation_start_date, 1), estimation_start_date)")),
    "window reaches the forecast date": lambda f: f.withColumn("estimation_end_date", F.expr("IF(forecast_date = day, forecast_date, estimation_end_date)")),
    "level is unknown": lambda f: f.withColumn("confidence_level", F.expr("IF(forecast_date = day AND level_bp = 9500, 0.5D, confidence_level)")),
    "number is not finite": lambda f: f.withColumn("expected_shortfall", F.expr("IF(forecast_date = day, CAST('Infinity' AS DOUBLE), expected_shortfall)")),
    "outcome is not the schedule's": lambda f: f.withColumns({"realized_return": F.expr("IF(forecast_date = day, realized_return + 1e-9, realized_return)"), "realized_loss": F.expr("IF(forecast_date = day, -(realized_return + 1e-9), realized_loss)")}),
    "loss is not minus return": lambda f: f.withColumn("realized_loss", F.expr("IF(forecast_date = day, realized_loss - 1e-9, realized_loss)")),
    "ES is below VaR": lambda f: f.withColumn("expected_shortfall", F.expr("IF(forecast_date = day, value_at_risk - 1e-6, expected_shortfall)")),
    "flag does not match": lambda f: f.withColumn("var_exceedance", F.expr("IF(forecast_date = day, NOT var_exceedance, var_exceedance)")),
}


@pytest.mark.parametrize("rule", BREAKS)
def test_every_rule_refuses(spark, rule):
    """Each rule counts the rows that break it, and the check names it."""
    f, s = forecasts(spark)
    day = f.agg(F.min("forecast_date")).first()[0]
    broken = BREAKS[rule](f.withColumn("day", F.lit(day))).drop("day")
    counts = {r["rule"]: r["rows_broken"] for r in rows(contracts.rule_counts(broken, s, schedule.LEVELS))}
    assert counts[rule] == (1 if rule in ("forecast is missing", "level is unknown") else 3), counts
    with pytest.raises(contracts.ContractError, match=rule[:12]):
        contracts.check_forecasts(broken, s, schedule.LEVELS)
    assert set(BREAKS) == set(counts)


def test_sound_forecasts_pass(spark):
    f, s = forecasts(spark)
    assert not any(r["rows_broken"] for r in rows(contracts.rule_counts(f, s, schedule.LEVELS)))
    assert contracts.check_forecasts(f, s, schedule.LEVELS) is f


def test_rules_are_counted_while_a_table_is_written(spark, tmp_path):
    f, _ = forecasts(spark)
    watched = contracts.Watched(f, contracts.row_rules())
    watched.table.write.parquet(f"{tmp_path}/sound")
    watched.enforce()
    watched = contracts.Watched(f.withColumn("expected_shortfall", F.lit(-1.0)), contracts.row_rules())
    watched.table.write.parquet(f"{tmp_path}/broken")
    assert watched.broken() == {"ES is below VaR": f.where("value_at_risk > -1").count()}
    with pytest.raises(contracts.ContractError, match="ES is below VaR"):
        watched.enforce()


def test_portfolios_are_told_apart_in_every_simulation(spark):
    """Two portfolios at once give what each gives alone."""
    x = np.random.default_rng(9).normal(0.001, 0.02, (26, 2))
    r = returns_of(spark, business(26), A=x[:, 0].tolist(), B=x[:, 1].tolist())
    one = portfolio.portfolio_weights(r, portfolio.equal_weights(r))
    two = portfolio.portfolio_weights(r, portfolio.equal_weights(r, 0.5))
    both = one.withColumn("book", F.lit("one")).unionByName(two.withColumn("book", F.lit("two")))
    for run in (simulation.monte_carlo, simulation.filtered_historical):
        got = {(q["book"], q["forecast_date"], q["level_bp"]): (q["value_at_risk"], q["expected_shortfall"]) for q in rows(run(r, both, 10, (0.9, 0.95), scenarios=400, seed=3, by=["book"]))}
        assert len(got) == 2 * 16 * 2
        for book, w in (("one", one), ("two", two)):
            for q in rows(run(r, w, 10, (0.9, 0.95), scenarios=400, seed=3)):
                assert got[book, q["forecast_date"], q["level_bp"]] == pytest.approx((q["value_at_risk"], q["expected_shortfall"]), rel=1e-12)


def test_a_date_without_a_forecast_fails(spark):
    """Neither a date of the schedule without forecast nor a forecast without date vanishes."""
    f, s = forecasts(spark)
    tails = f.select("forecast_date", "level_bp", "confidence_level", "value_at_risk", "expected_shortfall")
    day = f.agg(F.min("forecast_date")).first()[0]
    for t, due in ((tails.where(F.col("forecast_date") != day), s), (tails, s.where(F.col("forecast_date") != day))):
        with pytest.raises(Exception, match="a forecast or an outcome only"):
            models.as_forecasts("m", 0, t, due).collect()
    with pytest.raises(Exception, match="analytic or simulated only"):
        simulation.simulation_errors(tails, tails.where(F.col("forecast_date") != day)).collect()


def test_exact_intervals_take_no_time():
    import time

    began = time.perf_counter()
    for n in (3519, 100_000, 10**7):
        low, high = special.clopper_pearson(n // 20, n, 0.95)
        assert low < 0.05 < high and high - low < 5 / n**0.5
    assert time.perf_counter() - began < 0.5
    for x, n in ((7, 50), (1, 1), (49, 50)):  # the binomial tails at the ends are half of what is left
        low, high = special.clopper_pearson(x, n, 0.9)
        tail = lambda a, b, p: sum(np.exp(special.log_pmf(k, n, p)) for k in range(a, b + 1))
        assert low == 0 or tail(x, n, low) == pytest.approx(0.05, rel=1e-10)
        assert high == 1 or tail(0, x, high) == pytest.approx(0.05, rel=1e-10)
