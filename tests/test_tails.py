"""Exact selection over weighted loss tables, and scenarios of one date over many tasks, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailframe.operators import kernels, simulation, tails


def direct(x, times, level):
    x = np.repeat(np.asarray(x, dtype=float), times)
    var = np.quantile(x, level, method="linear")
    return len(x), int((x >= var).sum()), var, x[x >= var].mean()


CASES = {
    "normal": lambda g: (g.normal(0, 1, 3000), g.integers(1, 4, 3000)),
    "ties": lambda g: (g.integers(-3, 4, 3000).astype(float), g.integers(0, 3, 3000)),
    "whole rank": lambda g: (np.arange(101.0), np.ones(101, int)),
    "outlier": lambda g: (np.append(g.normal(0, 1e-12, 2000), [1e300, -1e300]), np.ones(2002, int)),
    "one": lambda g: (np.array([2.5]), np.array([1])),
    "equal": lambda g: (np.full(500, -7.25), np.full(500, 3)),
    "often": lambda g: (np.array([1.0, 2.0, 3.0]), np.array([10**9, 5 * 10**7, 1])),
}


@pytest.mark.parametrize("exact", [20_000, 50])
def test_tail_risk(spark, monkeypatch, exact):
    """Groups of all kinds at once, with brackets that need no narrowing and with such that do; a null key is a group."""
    monkeypatch.setattr(tails, "EXACT", exact)
    monkeypatch.setattr(tails, "BUCKETS", 64)
    g = np.random.default_rng(8)
    data = {name: make(g) for name, make in CASES.items()}
    data[None] = (g.exponential(3, 700), np.ones(700, int))
    rows = [(n, float(x), int(t), "clash") for n, (xs, ts) in data.items() for x, t in zip(xs, ts, strict=True)] + [("normal", 9.0, None, "clash"), ("never", 1.0, 0, "clash")]
    df = spark.createDataFrame(rows, "grp string, loss double, times long, low string").repartition(5)
    levels = (0.9, 0.95, 0.99)
    got = {(r["grp"], r["confidence_level"]): r for r in tails.tail_risk(df, levels, ["grp"], times="times").collect()}
    assert len(got) == len(data) * 3
    for name, (x, t) in data.items():
        for level in levels:
            r = got[name, level]
            if name == "often":
                want = (int(t.sum()), *((int(t[1] + t[2]), 2.0, (2.0 * t[1] + 3) / (t[1] + t[2])) if level > 0.9523 else (int(t.sum()), 1.0, float((x * t).sum() / t.sum()))))
            else:
                want = direct(x, t, level)
            assert (r["observation_count"], r["tail_count"]) == want[:2], (name, level)
            assert (r["value_at_risk"], r["expected_shortfall"]) == pytest.approx(want[2:], rel=1e-12, abs=1e-300)
    whole = {r["confidence_level"]: r["value_at_risk"] for r in tails.tail_risk(df.where("grp = 'normal' and times is not null"), levels, times="times").collect()}
    assert whole == pytest.approx({x: got["normal", x]["value_at_risk"] for x in levels}, rel=1e-13)
    assert tails.tail_risk(df.where("false"), levels, ["grp"]).isEmpty()


def test_tail_risk_refuses(spark):
    for bad in ([(1.0, 1), (None, 1)], [(float("nan"), 1)], [(float("inf"), 1)], [(1.0, -1)]):
        with pytest.raises(Exception, match="a loss"):
            tails.tail_risk(spark.createDataFrame(bad, "loss double, times long"), times="times").collect()
    with pytest.raises(ValueError):
        tails.tail_risk(spark.createDataFrame([(1.0,)], "loss double"), (0.95, 1.0))


def test_one_hot_group_is_many_tasks(spark, monkeypatch):
    """A group of all rows is counted where its rows lie: before the last exchange a task gives a row for each bucket at most."""
    monkeypatch.setattr(tails, "EXACT", 100)
    df = spark.range(0, 200_000, 1, 8).select(F.lit("all").alias("grp"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1000.0).alias("loss"))
    out = tails.tail_risk(df, (0.99,), ["grp"])
    x = np.array([r[0] for r in df.select("loss").collect()])
    assert out.first()["value_at_risk"] == pytest.approx(np.quantile(x, 0.99), rel=1e-13)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_sum") >= 1 and "SortMergeJoin" not in plan


MU, COV, WEIGHTS = [0.001, -0.002, 0.0005], [4e-4, 1e-4, -5e-5, 9e-4, 2e-4, 2.5e-4], [0.5, 0.3, 0.2]


def dates_of(spark, n=3):
    from datetime import date

    rows = [("p", date(2024, 1, 1 + d), [m * (1 + d) for m in MU], [c * (1 + d) for c in COV], WEIGHTS) for d in range(n)]
    return spark.createDataFrame(rows, "book string, forecast_date date, mu array<double>, cov array<double>, w array<double>")


def test_scenarios_over_tasks_equal_numpy(spark, monkeypatch):
    """Any block's draws are those that one generator would have made at its place, so losses and tails are numpy's."""
    monkeypatch.setattr(simulation, "SCENARIO_BLOCK", 1000)
    n, seed, dates = 25_500, 7, dates_of(spark)
    losses = simulation.scenario_losses(dates, n, seed, ["book"])
    got = {}
    for r in losses.collect():
        got.setdefault(r["forecast_date"], {})[r["scenario"]] = r["loss"]
    for r in dates.collect():
        x = kernels.portfolio_losses(np.array(r["mu"]), simulation.square(r["cov"], 3), np.array(r["w"]), n, seed)
        assert np.array([got[r["forecast_date"]][k] for k in range(n)]) == pytest.approx(x, rel=1e-12)
    got = {(r["forecast_date"], r["level_bp"]): r for r in simulation.monte_carlo_by_scenario(dates, (0.95, 0.99), n, seed, ["book"]).collect()}
    want = {(r["forecast_date"], r["level_bp"]): r for r in simulation.monte_carlo_of(dates, (0.95, 0.99), n, seed, ["book"]).collect()}
    assert got.keys() == want.keys() and len(got) == 6
    for k, r in want.items():
        assert got[k]["tail_scenario_count"] == r["tail_scenario_count"] and got[k]["book"] == r["book"] == "p"
        for c in ("value_at_risk", "expected_shortfall", "simulated_mean_return", "simulated_volatility"):
            assert got[k][c] == pytest.approx(r[c], rel=1e-10), c


def test_states_are_made_in_runs():
    """A great many scenarios take the memory of one block."""
    import tracemalloc

    kernels.generator_states(10, 2, 1, 5)
    tracemalloc.start()
    states = list(kernels.generator_states(2_000_000, 3, 5, 1 << 17))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6 and len(states) == 16
    last = kernels.draws_from(states[-1][1], 2_000_000 - 15 * (1 << 17), 3)
    assert (last == np.random.default_rng(5).standard_normal((2_000_000, 3))[15 * (1 << 17) :]).all()


@pytest.mark.parametrize("window", [2, 3, 7, 30])
def test_block_moments_equal_numpy(spark, window):
    """Windows that begin and end anywhere in the blocks, with returns far from zero, against numpy to twelve digits; the plan deals blocks, not pairs."""
    from tailframe.operators import moments

    from .test_golden import business, returns_of

    x = 5 + np.random.default_rng(1).normal(0, 1e-3, (61, 2))
    r = returns_of(spark, business(61), A=x[:, 0].tolist(), B=x[:, 1].tolist())
    cov = {(q["session_no"], q["i"], q["j"]): q["cov"] for q in moments.rolling_covariance(r, window).collect()}
    mu = {(q["session_no"], q["asset_no"]): q["mu"] for q in moments.rolling_means(r, window).collect()}
    assert len(cov) == 3 * (61 - window) and len(mu) == 2 * (61 - window)
    for t in range(window, 61):
        c, m = np.cov(x[t - window : t].T), x[t - window : t].mean(axis=0)
        assert [cov[t, 0, 0], cov[t, 0, 1], cov[t, 1, 1]] == pytest.approx([c[0, 0], c[0, 1], c[1, 1]], rel=1e-9, abs=1e-18)
        assert [mu[t, 0], mu[t, 1]] == pytest.approx(m, rel=1e-14)
    gap = r.where("NOT (asset = 'A' AND session_no = 40)")
    with pytest.raises(Exception, match="missing returns"):
        moments.rolling_covariance(gap, window).collect()
