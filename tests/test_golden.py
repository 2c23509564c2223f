"""Hand-computed values, invariants and rejections of the tail-risk operators."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailframe.functions import special
from tailframe.operators import contracts, evaluate as ev, kernels, market, models, moments, portfolio, schedule, simulation


def days(*text):
    return [date.fromisoformat(t) for t in text]


def business(n, start="2025-01-02"):
    out, d = [], date.fromisoformat(start)
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += timedelta(1)
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def returns_of(spark, dates, **assets):
    data = [(d, n, a, k, float(v[n])) for k, (a, v) in enumerate(sorted(assets.items())) for n, d in enumerate(dates)]
    return spark.createDataFrame(data, "session_date date, session_no int, asset string, asset_no int, ret double")


def test_returns(spark):
    ds = days("2025-01-02", "2025-01-03", "2025-01-06", "2025-01-07")
    data = [(d, "A", p) for d, p in zip(ds, [100.0, 105.0, 105.0, 99.75])] + [(d, "B", p) for d, p in zip(ds, [100.0, None, 110.0, 121.0])]
    df = spark.createDataFrame(data, "session_date date, asset string, price double")
    got = {(r["asset"], r["session_date"]): r["ret"] for r in rows(market.simple_returns(df))}
    assert [got["A", d] for d in ds] == [None, pytest.approx(0.05), 0.0, pytest.approx(-0.05)]
    assert [got["B", d] for d in ds] == [None, None, None, pytest.approx(0.10)]
    flags = {(r["asset"], r["session_date"]): r["flag"] for r in rows(market.large_return_flags(market.simple_returns(df), 0.05))}
    assert not flags["B", ds[1]] and flags["B", ds[3]]
    assert {r["asset"]: r["missing"] for r in rows(market.missing_counts(df))} == {"A": 0, "B": 1}


def test_portfolio(spark):
    ds = days("2025-01-30", "2025-01-31", "2025-02-03")
    r = returns_of(spark, ds, A=[0.10, 0.0, 0.0], B=[0.0, 0.0, 0.10])
    t = portfolio.equal_weights(r)
    p = sorted(rows(portfolio.portfolio_path(r, t, 1000.0)), key=lambda x: x["session_date"])
    assert [x["portfolio_return"] for x in p] == pytest.approx([0.05, 0, 0.05])
    assert [x["rebalanced_after_close"] for x in p] == [False, True, False]
    assert p[1]["turnover"] == pytest.approx(1 / 42) and p[2]["ending_value"] == pytest.approx(1102.5)
    w = {(x["session_date"], x["asset"]): x for x in rows(portfolio.portfolio_weights(r, t))}
    assert w[ds[1], "A"]["pre_rebalance_weight"] == pytest.approx(550 / 1050) and w[ds[2], "A"]["begin_weight"] == 0.5
    cash = sorted(rows(portfolio.portfolio_path(returns_of(spark, ds[:1], A=[0.10], B=[0.0]), portfolio.equal_weights(r, 0.1), 1000.0)), key=lambda x: x["session_date"])
    assert cash[0]["ending_value"] == pytest.approx(1045)


@pytest.mark.parametrize("frequency", ["monthly", "daily", "never"])
def test_path_equals_recursion(spark, frequency):
    rng = np.random.default_rng(3)
    ds, x = business(120), rng.normal(0, 0.03, (120, 3))
    r = returns_of(spark, ds, A=x[:, 0].tolist(), B=x[:, 1].tolist(), C=x[:, 2].tolist())
    got = sorted(rows(portfolio.portfolio_path(r, portfolio.equal_weights(r, 0.1), 100.0, frequency)), key=lambda q: q["session_date"])
    value, w = 100.0, np.full(3, 0.3)
    for n, q in enumerate(got):
        grown = (w * (1 + x[n])).sum() + 1 - w.sum()
        assert q["portfolio_return"] == pytest.approx(grown - 1, abs=1e-12)
        value *= grown
        assert q["ending_value"] == pytest.approx(value, rel=1e-11)
        w = w * (1 + x[n]) / grown
        last = n == len(ds) - 1
        if not last and (frequency == "daily" or frequency == "monthly" and ds[n].month != ds[n + 1].month):
            assert q["turnover"] == pytest.approx((np.abs(w - 0.3).sum() + abs(w.sum() - 0.9)) / 2, abs=1e-12)
            w = np.full(3, 0.3)


def test_diagnostics(spark):
    ds = days("2025-01-02", "2025-01-03", "2025-01-06", "2025-01-07", "2025-01-08")
    df = spark.createDataFrame(list(zip(ds, [0.02, -0.01, 0.01, -0.03, 0.01])), "session_date date, ret double")
    r = rows(market.return_diagnostics(df))[0]
    assert (r["mean_return"], r["variance"], r["skewness"], r["excess_kurtosis"]) == pytest.approx((0, 4e-4, -0.9375, -0.1875), abs=1e-12)
    assert (r["loss_q950"], r["loss_q975"], r["loss_q990"]) == pytest.approx((0.026, 0.028, 0.0292))
    assert (r["worst_date"], r["best_date"]) == (ds[3], ds[0]) and r["annualized_volatility"] == pytest.approx(math.sqrt(252) * 0.02)


def test_schedule(spark):
    ds = days("2025-01-02", "2025-01-03", "2025-01-06", "2025-01-07", "2025-01-08")
    df = spark.createDataFrame(list(zip(ds, [0.01, -0.02, 0.03, -0.04, 0.05])), "session_date date, portfolio_return double")
    s = sorted(rows(schedule.forecast_schedule(df, 3)), key=lambda r: r["forecast_date"])
    assert [tuple(r.values()) for r in s] == [(ds[3], ds[0], ds[2], -0.04, 0.04), (ds[4], ds[1], ds[3], 0.05, -0.05)]


def test_moments(spark):
    ds = business(5)
    r = returns_of(spark, ds, A=[0.02, 0, -0.01, 0.03, 0.9], B=[0.01, -0.01, 0, 0.02, -0.9])
    cov = {(x["i"], x["j"]): x["cov"] for x in rows(moments.rolling_covariance(r, 4))}
    assert cov == pytest.approx({(0, 0): 1e-3 / 3, (0, 1): 2e-4, (1, 1): 5e-4 / 3}, rel=1e-12)
    one = returns_of(spark, ds[:4], A=[0.01, 0.03, -0.01, 0.50])
    e = sorted(rows(moments.ewma_covariance(one, 2, 0.5)), key=lambda x: x["session_no"])
    assert [x["cov"] for x in e] == pytest.approx([2e-4, 5.5e-4], rel=1e-12)


def panel(spark, n=60, seed=5):
    x = np.random.default_rng(seed).normal(0.001, 0.02, (n, 3))
    r = returns_of(spark, business(n), A=x[:, 0].tolist(), B=x[:, 1].tolist(), C=x[:, 2].tolist())
    return x, r, portfolio.portfolio_weights(r, portfolio.equal_weights(r))


@pytest.mark.parametrize("decay", [0.94, 1e-40])
def test_ewma_equals_recursion(spark, decay):
    """The small decay makes the running sums restart every few sessions."""
    x, r, _ = panel(spark, 40)
    got = {(q["session_no"], q["i"], q["j"]): q["cov"] for q in rows(moments.ewma_covariance(r, 10, decay))}
    c = np.cov(x[:10].T)
    for t in range(10, 40):
        assert [got[t, i, j] for i in range(3) for j in range(i, 3)] == pytest.approx([c[i, j] for i in range(3) for j in range(i, 3)], rel=1e-9)
        u = x[t] - x[t - 10 : t].mean(axis=0)
        c = decay * c + (1 - decay) * np.outer(u, u)


def test_gaussian(spark):
    z, phi = special.normal_point(0.95)
    assert (-0.001 + 0.02 * z, -0.001 + 0.02 * phi / 0.05) == pytest.approx((0.03189707253902943, 0.040254256150148576))
    _, r, w = panel(spark)
    a = {(q["forecast_date"], q["level_bp"]): q for q in rows(models.rolling_gaussian(r, w, 20))}
    b = {(q["forecast_date"], q["level_bp"]): q for q in rows(models.ewma_gaussian(r, w, 20))}
    first = min(a)[0]
    assert b[first, 9900]["value_at_risk"] == pytest.approx(a[first, 9900]["value_at_risk"], rel=1e-12)
    assert all(q["expected_shortfall"] > q["value_at_risk"] for q in a.values())


def test_no_look_ahead(spark):
    _, r, w = panel(spark, 40)
    last = business(40)[-1]
    changed = r.withColumn("ret", F.when(F.col("session_date") == last, 0.4).otherwise(F.col("ret")))
    for make in (lambda q: models.ewma_gaussian(q, w, 20), lambda q: simulation.filtered_historical(q, w, 20, scenarios=500)):
        a, b = ({(x["forecast_date"], x["level_bp"]): x["value_at_risk"] for x in rows(make(q))} for q in (r, changed))
        assert a == b


def test_monte_carlo(spark):
    mu, cov, w = np.array([0.001, -0.0005]), np.array([[4e-4, 1.2e-4], [1.2e-4, 2.25e-4]]), np.array([0.6, 0.4])
    losses = kernels.portfolio_losses(mu, cov, w, 250_000, 20261002)
    vol, mean = math.sqrt(w @ cov @ w), w @ mu
    z, phi = special.normal_point(0.95)
    var, es, n = kernels.empirical_tail(losses, 0.95)
    assert (-losses.mean(), losses.std(ddof=1)) == pytest.approx((mean, vol), abs=1e-4)
    assert (var, es) == pytest.approx((-mean + vol * z, -mean + vol * phi / 0.05), abs=3e-4) and n == 12500
    assert kernels.empirical_tail(np.arange(-2, 8) / 100, 0.8) == (pytest.approx(0.052), pytest.approx(0.065), 2)
    s = kernels.return_scenarios(mu, cov, 1000, 7)
    assert -(s @ w) == pytest.approx(kernels.portfolio_losses(mu, cov, w, 1000, 7), abs=1e-15)
    _, r, wt = panel(spark, 30)
    out = rows(simulation.monte_carlo(r, wt, 20, scenarios=2000))
    assert len(out) == 30 and all(q["scenario_count"] == 2000 and q["expected_shortfall"] >= q["value_at_risk"] for q in out)
    errors = rows(simulation.simulation_errors(models.rolling_gaussian(r, wt, 20), simulation.monte_carlo(r, wt, 20, scenarios=20000)))
    assert len(errors) == 6 and all(e["max_absolute_error_bps"] < 30 for e in errors)
    for x in (kernels.portfolio_losses(mu, cov, w, 1000, 1), np.full(7, 2.0), np.arange(91) / 90, np.array([0.3])):
        bars = simulation.loss_histogram(spark.createDataFrame([(float(v),) for v in x], "loss double")).orderBy("left").collect()
        density, edges = np.histogram(x, bins=90, density=True)
        assert [b["density"] for b in bars] == pytest.approx(density, rel=1e-9) and [b["left"] for b in bars] + [bars[-1]["right"]] == pytest.approx(edges, rel=1e-12, abs=1e-15)
    assert simulation.loss_histogram(spark.createDataFrame([], "loss double")).isEmpty()


def test_filtered_historical(spark):
    c = np.array([[0.02, 0], [0.006, 0.01]])
    z = np.array([-2, 1.5])
    assert kernels.standardize(c @ z, c @ c.T) == pytest.approx(z, rel=1e-12)
    window = np.array([[0.010, 0.005], [-0.020, 0.015], [0.030, -0.010], [-0.010, -0.020]])
    pool = kernels.initial_pool(window)
    assert pool.mean(axis=0) == pytest.approx([0, 0], abs=1e-12) and np.cov(pool.T) == pytest.approx(np.eye(2), abs=1e-12)
    assert (kernels.resample(pool, 50, 3) == kernels.resample(pool, 50, 3)).all()
    with pytest.raises(ValueError):
        kernels.standardize(z, np.ones((2, 2)))
    rng = np.random.default_rng(8)
    for level in (0.8, 0.95, 0.975):
        v = np.round(rng.normal(size=40), 1)
        drawn = kernels.positions(40, 1001, 5)
        assert kernels.weighted_tail(v, kernels.multiplicity(40, 1001, 5), level) == (pytest.approx((t := kernels.empirical_tail(v[drawn], level))[0]), pytest.approx(t[1]), t[2])
    x, r, w = panel(spark, 34)
    got = {(q["forecast_date"], q["level_bp"]): q for q in rows(simulation.filtered_historical(r, w, 20, scenarios=3000, seed=9))}
    wt = {(q["session_date"], q["asset"]): q["begin_weight"] for q in rows(w)}
    cov, pool = np.cov(x[:20].T), list(kernels.initial_pool(x[:20]))
    for t, day in list(enumerate(business(34)))[20:]:
        mu = x[t - 20 : t].mean(axis=0)
        b = np.array([wt[day, a] for a in "ABC"])
        drawn = np.array(pool)[kernels.positions(20, 3000, 9)]
        var, es, n = kernels.empirical_tail(-(b @ mu + drawn @ (np.linalg.cholesky(cov).T @ b)), 0.95)
        q = got[day, 9500]
        assert (q["value_at_risk"], q["expected_shortfall"], q["tail_scenario_count"]) == (pytest.approx(var, rel=1e-9), pytest.approx(es, rel=1e-9), n)
        u = x[t] - mu
        pool = [*pool[1:], kernels.standardize(u, cov)]
        cov = 0.94 * cov + 0.06 * np.outer(u, u)


def facts(spark, losses, var, es, levels, model="m", no=0):
    data = []
    for bp, v, e in zip(levels, var, es):
        for d, x, a, b in zip(business(len(losses)), losses, v, e):
            data.append((model, no, d, bp / 10000, bp, float(x), float(a), float(b), bool(x > a)))
    return spark.createDataFrame(data, "model string, model_no int, forecast_date date, confidence_level double, level_bp int, realized_loss double, value_at_risk double, expected_shortfall double, var_exceedance boolean")


def test_coverage(spark):
    f = facts(spark, [0.010, 0.020, 0.021, 0.030, -0.010], [[0.020] * 5, [0.030] * 5], [[0.04] * 5, [0.05] * 5], [9500, 9900])
    a, b = sorted(rows(ev.with_interval(ev.exceedance_counts(f))), key=lambda r: r["level_bp"])
    assert (a["observed_count"], a["expected_count"], a["count_difference"], b["observed_count"]) == (2, pytest.approx(0.25), pytest.approx(1.75), 0)
    assert (a["rate_lower"], a["rate_upper"], b["rate_lower"], b["rate_upper"]) == pytest.approx((0.052744950526316926, 0.853367200365327, 0, 0.5218237501049814))


def test_special(spark):
    assert special.clopper_pearson(7, 50, 0.95) == pytest.approx((0.05819170033997342, 0.26739600249700846))
    assert special.clopper_pearson(0, 10, 0.95) == pytest.approx((0, 0.30849710781876083)) and special.clopper_pearson(10, 10, 0.95) == pytest.approx((0.6915028921812392, 1))
    x = [0.0, 0.1, 1.0, 2.4999, 2.5, 5.0, 20.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(special.erfc(F.col("x"))).collect()]
    assert got == pytest.approx([math.erfc(v) for v in x], rel=1e-11)
    low, high = special.reference_band(252, 0.05)
    assert 0 < low < 0.05 < high < 0.1


def test_likelihood_ratios(spark):
    flags = [False] * 90 + [True] * 10
    f = facts(spark, [2.0 if x else 0.0 for x in flags], [[1.0] * 100], [[1.5] * 100], [9500])
    r = rows(ev.coverage_tests(f))[0]
    assert (r["lr_unconditional"], r["lr_independence"], r["lr_conditional"]) == pytest.approx((4.130843782549277, 53.81628780732018, 57.94713158986946))
    assert (r["p_unconditional"], r["p_conditional"]) == pytest.approx((0.042108350096184695, 2.611802024625561e-13)) and r["reject_unconditional"]
    flags = [False, False, True, True, False, True, False, False]
    r = rows(ev.coverage_tests(facts(spark, [2.0 if x else 0.0 for x in flags], [[1.0] * 8], [[1.5] * 8], [9500])))[0]
    assert (r["n00"], r["n01"], r["n10"], r["n11"]) == (2, 2, 2, 1) and (r["lr_independence"], r["p_independence"]) == pytest.approx((0.1964510115581639, 0.6576008676133729))
    r = rows(ev.coverage_tests(facts(spark, [0.0] * 8, [[1.0] * 8], [[1.5] * 8], [9500])))[0]
    assert r["rate_after_exceedance"] is None and r["lr_independence"] == 0


def test_holm(spark):
    df = spark.createDataFrame([(n, p) for n, p in enumerate([0.01, 0.04, 0.03, 0.20])], "n int, p double")
    out = sorted(rows(ev.holm(df, "p", ["n"])), key=lambda r: r["n"])
    assert [r["holm_p_value"] for r in out] == pytest.approx([0.04, 0.09, 0.09, 0.20]) and [r["holm_reject"] for r in out] == [True, False, False, False]


def test_scores_and_severity(spark):
    f = facts(spark, [0.01, 0.02, 0.03], [[0.02] * 3], [[0.03] * 3], [9500])
    s = sorted(rows(ev.daily_scores(f)), key=lambda r: r["forecast_date"])
    assert [r["quantile_loss"] for r in s] == pytest.approx([0.0005, 0, 0.0095]) and [r["fz0_loss"] for r in s] == pytest.approx([-3.8398912307, -3.8398912307, 2.8267754360])
    f = facts(spark, [3, 7, 9, 2, 12], [[8, 8, 8, 8, 10], [14] * 5], [[10, 10, 10, 10, 13], [17] * 5], [9500, 9900])
    a, b = sorted(rows(ev.tail_severity(f)), key=lambda r: r["level_bp"])
    assert [a[k] for k in ("exceedance_count", "mean_loss", "mean_value_at_risk", "mean_expected_shortfall", "mean_excess", "median_excess", "max_excess", "mean_severity_gap")] == [2, 10.5, 9, 11.5, 1.5, 1.5, 2, -1]
    assert b["exceedance_count"] == 0 and b["mean_loss"] is None and b["max_excess"] is None


def test_newey_west(spark):
    df = lambda v: spark.createDataFrame([("g", d, float(x)) for d, x in zip(business(len(v)), v)], "g string, forecast_date date, v double")
    r = rows(ev.newey_west(df([1, 2, 3, 4]), "v", ["g"], lags=1))[0]
    assert (r["mean"], r["long_run_variance"], r["standard_error"], r["statistic"], r["p_value"]) == pytest.approx((2.5, 1.5625, 0.625, 4, 6.334248366623984e-5))
    assert rows(ev.newey_west(df([0, 0, 0]), "v", ["g"]))[0]["p_value"] == 1
    r = rows(ev.newey_west(df([-1, -1, -1]), "v", ["g"]))[0]
    assert r["statistic"] == -math.inf and r["p_value"] == 0 and r["reject"]
    a, b = facts(spark, [2, 4, 6, 8], [[0] * 4], [[1] * 4], [9500], "a", 0), facts(spark, [1, 2, 3, 4], [[0] * 4], [[1] * 4], [9500], "b", 1)
    q = next(r for r in rows(ev.diebold_mariano(a.union(b), lags=1)) if r["score_name"] == "quantile_loss")
    assert q["statistic"] == pytest.approx(4) and (q["model_a"], q["model_b"]) == ("a", "b")


@pytest.mark.parametrize("k, zone", [(0, "green"), (4, "green"), (5, "amber"), (9, "amber"), (10, "red"), (250, "red")])
def test_traffic(spark, k, zone):
    f = facts(spark, [2.0] * k + [0.5] * (250 - k), [[1.0] * 250], [[1.5] * 250], [9900])
    path = ev.traffic_path(f)
    assert [(r["exception_count"], r["zone"]) for r in rows(path)] == [(k, zone)]
    s = rows(ev.traffic_summary(path))[0]
    assert s["window_count"] == 1 and s["latest_zone"] == zone and s[f"{zone}_rate"] == 1


def test_subperiods(spark):
    f = facts(spark, [1.0] * 400, [[0.5 if n < 5 else 2.0 for n in range(400)]], [[3.0] * 400], [9500])
    p = ev.subperiods(f, [("s", "stress", "2025-02-01", "2025-02-28")])
    got = {r["period_id"]: r for r in rows(p)}
    assert set(got) == {"year_2025", "year_2026", "s"} and got["year_2026"]["is_partial"] and not got["year_2025"]["is_partial"]
    scores = ev.period_scores(f, p)
    year = next(r for r in rows(scores) if r["period_id"] == "year_2025")
    n = year["observation_count"]
    assert year["mean_quantile_loss"] == pytest.approx((5 * 0.95 * 0.5 + (n - 5) * 0.05) / n) and year["quantile_loss_rank"] == 1
    assert sum(r["first_places"] for r in rows(ev.first_places(scores))) == 4
    full = rows(ev.full_sample_scores(scores))[0]
    assert full["mean_quantile_loss"] == pytest.approx(rows(ev.score_summary(f, ev.quantile_loss(), "q"))[0]["mean_q"])


def test_contracts(spark):
    _, r, w = panel(spark, 30)
    path = portfolio.portfolio_path(r, portfolio.equal_weights(r))
    s = schedule.forecast_schedule(path, 20)
    f = models.as_forecasts("m", 0, models.rolling_gaussian(r, w, 20), s)
    assert contracts.check_forecasts(f, s, schedule.LEVELS) is f
    contracts.check_common_dates(f)
    for c in ("realized_loss", "value_at_risk", "expected_shortfall"):
        with pytest.raises(contracts.ContractError):
            contracts.check_forecasts(f.withColumn(c, -F.col(c) - 1), s, schedule.LEVELS)
    with pytest.raises(contracts.ContractError):
        contracts.check_forecasts(f.where("level_bp > 9500"), s, schedule.LEVELS)
    with pytest.raises(contracts.ContractError):
        contracts.check_returns(r.withColumn("ret", F.lit(-1.5)))
    with pytest.raises(contracts.ContractError):
        contracts.check_weights(spark.createDataFrame([("A", 0.8), ("B", 0.3)], "asset string, weight double"))
    with pytest.raises(ValueError):
        portfolio.rebalances(F.lit(1), F.lit(2), "weekly")


def test_rejections(spark):
    """Each guard refuses what it is there for."""
    schema = "session_date date, asset string, field string, value double"
    ds = business(3)
    good = [(d, a, "Close", 10.0) for d in ds for a in "AB"]
    check = lambda data: contracts.check_market(spark.createDataFrame(data, schema), ["A", "B"], ["Close"], ["Close"])
    assert check(good).count() == 6
    for bad in (good[::2], [(d, a, "Open", v) for d, a, _, v in good], [*good, good[0]], [*good, (None, "A", "Close", 1.0)], [*good[1:], (ds[0], "A", "Close", 0.0)], [*good[1:], (ds[0], "A", "Close", math.nan)], [*good[1:], (ds[0], "A", "Close", math.inf)]):
        with pytest.raises(contracts.ContractError):
            check(bad)
    assert check([*good[1:], (ds[0], "A", "Close", None)]).count() == 6
    _, r, w = panel(spark, 30)
    for bad in (r.withColumn("ret", F.lit(None).cast("double")), r.withColumn("ret", F.lit(math.inf)), r.union(r.limit(1))):
        with pytest.raises(contracts.ContractError):
            contracts.check_returns(bad)
    for bad in ([("A", -0.1)], [("A", None)], [("A", 0.4), ("A", 0.4)]):
        with pytest.raises(contracts.ContractError):
            contracts.check_weights(spark.createDataFrame(bad, "asset string, weight double"))
    path = portfolio.portfolio_path(r, portfolio.equal_weights(r))
    contracts.check_alignment(path, w)
    last = business(30)[-1]
    for days_, weights_ in ((path.where(F.col("session_date") < last), w), (path, w.where(f"session_date < '{last}' or asset <> 'A'")), (path, w.where(F.col("session_date") < last))):
        with pytest.raises(contracts.ContractError):
            contracts.check_alignment(days_, weights_)
    for call in (
        lambda: moments.rolling_means(r, 1), lambda: moments.rolling_means(r, True), lambda: schedule.forecast_schedule(path, 1), lambda: schedule.level_rows(spark, [0.99, 0.95]), lambda: schedule.level_rows(spark, [True]),
        lambda: schedule.level_rows(spark, []), lambda: kernels.check_draws(1, 3), lambda: kernels.check_draws(10, True), lambda: kernels.check_draws(10, -1), lambda: moments.ewma_covariance(r, 5, 1.0), lambda: market.large_return_flags(r, 0.0),
        lambda: portfolio.equal_weights(r, 1.0), lambda: portfolio.portfolio_path(r, portfolio.equal_weights(r), 0.0), lambda: models.model_forecasts("other", r, path, w, 20), lambda: ev.newey_west(path, "pnl", [], "session_date", lags=-1), lambda: special.clopper_pearson(3, 2, 0.95), lambda: special.normal_point(1.0),
        lambda: simulation.monte_carlo(r, w, 20, scenarios=True), lambda: kernels.lower_factor(np.array([[1.0, 0.5], [0.2, 1.0]])),
    ):
        with pytest.raises(ValueError):
            call()


def test_nothing_is_dropped_in_silence(spark):
    """What cannot be forecast fails the job instead of vanishing."""
    _, r, w = panel(spark, 30)
    gap = r.withColumn("ret", F.when((F.col("session_no") != 12) | (F.col("asset") != "B"), F.col("ret")))
    flat = r.withColumn("ret", F.lit(0.01))
    last = business(30)[-1]
    path = portfolio.portfolio_path(r, portfolio.equal_weights(r))
    holed = path.withColumn("portfolio_return", F.when(F.col("session_date") < last, F.col("portfolio_return")))
    two = path.withColumn("portfolio_return", F.when(F.dayofmonth("session_date") != 8, F.col("portfolio_return")))
    for make in (
        lambda: moments.rolling_means(gap, 20), lambda: moments.rolling_covariance(gap, 20), lambda: moments.ewma_covariance(gap, 20, 0.9), lambda: models.rolling_gaussian(flat, w, 20),
        lambda: models.rolling_gaussian(r, w.where(F.col("session_date") < last), 20), lambda: models.rolling_gaussian(r, w.where("asset <> 'A'"), 20), lambda: simulation.filtered_historical(r, w.where(F.col("session_date") < last), 20, scenarios=100),
        lambda: models.rolling_gaussian_univariate(two, 20), lambda: models.historical_simulation(holed, 20),
        lambda: ev.subperiods(facts(spark, [1.0] * 9, [[2.0] * 9], [[3.0] * 9], [9500]), [("s", "none", "1990-01-01", "1990-02-01")]),
    ):
        with pytest.raises(Exception, match="missing|positive|lacks|holds no|weights"):
            make().collect()


def test_many_portfolios(spark):
    """Portfolios side by side give what each gives alone, over shared asset moments."""
    _, r, _ = panel(spark, 40)
    mixes = {"even": [1 / 3] * 3, "one": [0.7, 0.2, 0.0], "cash": [0.1, 0.1, 0.1]}
    book = spark.createDataFrame([(p, a, v) for p, x in mixes.items() for a, v in zip("ABC", x)], "book string, asset string, weight double")
    by = ["book"]
    w, path = portfolio.portfolio_weights(r, book, by=by), portfolio.portfolio_path(r, book, by=by)
    both = {(q["book"], q["forecast_date"], q["level_bp"]): q for q in rows(models.rolling_gaussian(r, w, 20, by=by))}
    past = {(q["book"], q["forecast_date"], q["level_bp"]): q for q in rows(models.historical_simulation(path, 20, by=by))}
    assert len(both) == len(past) == 3 * 20 * 3 and schedule.forecast_schedule(path, 20, by).count() == 60
    for p in mixes:
        own = book.where(F.col("book") == p).drop("book")
        one = portfolio.portfolio_path(r, own)
        for q in rows(models.rolling_gaussian(r, portfolio.portfolio_weights(r, own), 20)):
            assert both[p, q["forecast_date"], q["level_bp"]]["value_at_risk"] == pytest.approx(q["value_at_risk"], rel=1e-12)
        x = np.array([-q["portfolio_return"] for q in sorted(rows(one), key=lambda q: q["session_date"])])
        for t, day in list(enumerate(business(40)))[20:]:
            var, es, _ = kernels.empirical_tail(x[t - 20 : t], 0.975)
            assert (past[p, day, 9750]["value_at_risk"], past[p, day, 9750]["expected_shortfall"]) == pytest.approx((var, es), rel=1e-12)
    f = models.as_forecasts("m", 0, models.rolling_gaussian(r, w, 20, by=by), schedule.forecast_schedule(path, 20, by), by=by)
    assert f.count() == 180 and ev.exceedance_counts(f, ["book", *ev.KEY]).count() == 9


def test_shocks_in_runs(monkeypatch):
    """Shocks that are too many to keep are drawn in runs that give the same losses."""
    mu, pulled = np.array([0.001, -0.002]), np.random.default_rng(1).normal(size=(3, 2))
    whole = kernels.losses_of_dates(mu, pulled, 1001, 5)
    monkeypatch.setattr(kernels, "SHOCK_VALUES", 100)
    assert kernels.losses_of_dates(mu, pulled, 1001, 5) == pytest.approx(whole, abs=1e-15)
    x = whole[0]
    for level, got in zip((0.9, 0.95, 0.999), kernels.empirical_tails(x, (0.9, 0.95, 0.999))):
        assert got == (pytest.approx((t := kernels.empirical_tail(x, level))[0]), pytest.approx(t[1]), t[2])
    assert kernels.filtered_loss(mu, np.array([0.5, -1.0]), np.eye(2) * 4.0, np.array([0.6, 0.4])) == pytest.approx(-(0.6 * (0.001 + 1) + 0.4 * (-0.002 - 2)))
