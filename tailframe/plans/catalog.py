"""Catalogue of queries: the operators over the panel that the order lines give, and the flagship."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailframe.functions import special
from tailframe.operators import contracts, kernels, market, models, moments, portfolio, scenarios, schedule, simulation, tails
from tailframe.operators import evaluate as ev
from tailframe.sources import market as market_source
from tailframe.sources import panel, snapshots, store

from .sql import DECAY, ORACLES, SCENARIOS, SEED, STRESS, WINDOW

#: Window and grain of the flagship. The catalogue's simulations draw as many scenarios for each date as the reference.
FLAGSHIP_WINDOW, FLAGSHIP_GRAIN = 52, "week"
#: Larger movements are flagged; declared for this synthetic panel.
LARGE = 0.5
#: Tables whose files the stored stages depend on.
PANEL = ("lineitem", "orders", "customer")


def shared(name: str, spark: SparkSession, sf_dir: str, make: Callable[[], DataFrame]) -> DataFrame:
    return store.stage(spark, sf_dir, name, PANEL, make)


def line_prices(spark, d, grain="day"):
    return shared(f"prices-{grain}", spark, d, lambda: panel.line_prices(spark, d, grain))


def prices(spark, d, grain="day"):
    return panel.complete_sessions(line_prices(spark, d, grain))


def returns(spark, d, grain="day"):
    return shared(f"returns-{grain}", spark, d, lambda: market.asset_returns(prices(spark, d, grain)))


def targets(spark, d, cash=0.0, grain="day"):
    return portfolio.equal_weights(returns(spark, d, grain), cash)


def assets(spark, d, grain="day"):
    return shared(f"assets-{grain}", spark, d, lambda: portfolio.asset_path(returns(spark, d, grain), targets(spark, d, grain=grain)))


def path(spark, d, grain="day"):
    return shared(f"path-{grain}", spark, d, lambda: portfolio.path_of(assets(spark, d, grain)))


def weights(spark, d, grain="day"):
    return portfolio.weights_of(assets(spark, d, grain))


def means(spark, d, grain="day", window=WINDOW):
    return shared(f"means-{grain}", spark, d, lambda: moments.rolling_means(returns(spark, d, grain), window))


def packed(spark, d, decay=None, grain="day", window=WINDOW):
    """What each date's forecast needs, of the rolling or of the exponentially weighted moments."""

    def make():
        r = returns(spark, d, grain)
        cov = moments.rolling_covariance(r, window) if decay is None else moments.ewma_covariance(r, window, decay, means(spark, d, grain, window))
        return moments.packed(means(spark, d, grain, window), cov, weights(spark, d, grain))

    return shared(f"packed-{grain}-{'rolling' if decay is None else 'ewma'}", spark, d, make)


def gaussian(spark, d, decay=None, grain="day", window=WINDOW):
    return models.gaussian_forecasts(moments.moments_of(packed(spark, d, decay, grain, window)))


def residuals(spark, d):
    return shared("residuals", spark, d, lambda: simulation.residuals_of(returns(spark, d), packed(spark, d, DECAY), WINDOW))


def fhs(spark, d):
    return shared("fhs", spark, d, lambda: simulation.filtered_historical_of(packed(spark, d, DECAY), residuals(spark, d), WINDOW, scenarios=SCENARIOS, seed=SEED))


def forecasts(spark, d):
    """The fact table: rolling and EWMA Gaussian, in closed form, and filtered historical simulation."""

    def make():
        s = schedule.forecast_schedule(path(spark, d), WINDOW)
        tails = (gaussian(spark, d), gaussian(spark, d, DECAY), fhs(spark, d))
        rows = [models.as_forecasts(name, no, tail, s) for no, (name, tail) in enumerate(zip(models.MODELS, tails, strict=True))]
        return rows[0].unionByName(rows[1]).unionByName(rows[2])

    return shared("forecasts", spark, d, make)


def rounded(df: DataFrame, digits: int = 8, coarse: tuple[str, ...] = (), drop: tuple[str, ...] = ()) -> DataFrame:
    """Doubles to ``digits`` decimals (6 for ``coarse``), without negative zeros, so that engines can be compared."""
    keep = {"confidence_level"}
    return df.select(*((F.round(c, 6 if c in coarse else digits) + 0.0).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes if c not in drop))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling Gaussian backtest with coverage tests, weekly."""
    tails = gaussian(spark, sf_dir, None, FLAGSHIP_GRAIN, FLAGSHIP_WINDOW)
    f = models.as_forecasts("rolling-gaussian", 0, tails, schedule.forecast_schedule(path(spark, sf_dir, FLAGSHIP_GRAIN), FLAGSHIP_WINDOW))
    return rounded(ev.coverage_tests(store.working_table(f, "flagship")))


LV = ("confidence_level",)
NO = ("model_no", "confidence_level")


def periods(spark, d):
    return shared("periods", spark, d, lambda: ev.subperiods(forecasts(spark, d), [STRESS]))


def _path_query(spark, d):
    p = path(spark, d)
    return rounded(p.select("session_date", F.ln("beginning_value").alias("log_beginning_value"), "portfolio_return", F.ln("ending_value").alias("log_ending_value"), (F.col("ending_value") < F.col("beginning_value")).alias("lost"), "rebalanced_after_close", "turnover"))


def _tails(df):
    return rounded(df.select("forecast_date", "level_bp", "value_at_risk", "expected_shortfall"))


def _mc(spark, d, decay=None):
    return shared(f"mc-{'rolling' if decay is None else 'ewma'}", spark, d, lambda: simulation.monte_carlo_of(packed(spark, d, decay), scenarios=SCENARIOS, seed=SEED))


def _dm(spark, d, lags=None):
    return ev.diebold_mariano(forecasts(spark, d), lags)


#: Published comparisons: model and reference.
PAIRS = (("ewma-gaussian", "rolling-gaussian"), ("filtered-historical", "rolling-gaussian"), ("filtered-historical", "ewma-gaussian"))


def _inference(spark, d):
    means = ev.full_sample_scores(ev.period_scores(forecasts(spark, d), periods(spark, d)))
    return rounded(ev.oriented_inference(_dm(spark, d), _dm(spark, d, 0), means, PAIRS), 6)


def _band(spark, d):
    """Exception rates that a right model shows with 95 % probability in as many sessions as each period of the data has."""
    sizes = periods(spark, d).select(F.col("observation_count").alias("sessions")).distinct()
    levels = spark.createDataFrame([(round(x * 10000), 1.0 - x) for x in schedule.LEVELS], "level_bp int, rate double")
    rows = sizes.crossJoin(F.broadcast(levels))  # a row for each level
    band = special.reference_interval(F.col("sessions"), F.col("rate"))
    return rows.select("sessions", "level_bp", band.alias("b")).select("sessions", "level_bp", F.col("b.lower").alias("rate_lower"), F.col("b.upper").alias("rate_upper"))


def _draws(spark, d):
    """How often the last forecast date draws each residual of its pool: the session's number and date, and the seeded generator's draws."""
    r = residuals(spark, d).select("session_no", "residual_date")
    last = r.agg((F.max("session_no") - WINDOW).alias("first"))
    pool = r.crossJoin(F.broadcast(last)).select((F.col("session_no") - F.col("first")).alias("pool_position"), "residual_date").where(f"pool_position between 0 and {WINDOW - 1}")
    times = F.array(*(F.lit(int(k)).cast("long") for k in kernels.multiplicity(WINDOW, SCENARIOS, SEED)))
    return pool.select("pool_position", "residual_date", F.get(times, F.col("pool_position")).alias("draws"))


def last_losses(spark, d):
    """The simulated losses of the last forecast date, drawn by many tasks."""

    def make():
        dates = packed(spark, d)
        last = dates.agg(F.max("forecast_date").alias("forecast_date"))
        return simulation.scenario_losses(dates.join(F.broadcast(last), "forecast_date"), SCENARIOS, SEED)

    return shared("last-losses", spark, d, make)


#: Scenarios of a date in the table of return scenarios.
TABLE_SCENARIOS = 500


def stress_dates(spark, d, decay=None):
    """What the stress period's forecasts need."""
    return packed(spark, d, decay).where(F.col("forecast_date").between(F.to_date(F.lit(STRESS[2])), F.to_date(F.lit(STRESS[3]))))


def _stress_mc(spark, d):
    """Monte Carlo of the stress period's dates, each date's scenarios over many tasks and their tails selected by counts."""
    dates = stress_dates(spark, d)
    return shared("stress-mc", spark, d, lambda: simulation.monte_carlo_by_scenario(dates, scenarios=SCENARIOS, seed=SEED))


def quotes(spark, d):
    """The order lines' market tree, read back by the market source."""
    tree = store.made_once(spark, d, "market-tree", PANEL, lambda path: market_source.write_tree(panel.market_quotes(spark, d), path))
    return market_source.read_tree(spark, tree)


def companion_scores(spark, d):
    """Scores and ranks by period, as they are published: nine columns."""
    f, p = forecasts(spark, d), periods(spark, d)
    kinds = p.select("period_id", "period_type")
    s = ev.period_scores(f, p).join(F.broadcast(kinds), "period_id")  # a row for each period
    return ev.companion_table(s)


def _columns(spark, d, years=False):
    """The periods of the data in order, as columns of a matrix: a row for each year and stress period."""
    rows = periods(spark, d).select("period_id", "period_type").collect()
    return sorted(r["period_id"] for r in rows if not years or r["period_type"] == "calendar_year")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    f = forecasts
    return {
        "asset_returns": lambda s, d: rounded(returns(s, d)),
        "large_return_flags": lambda s, d: rounded(market.large_return_flags(returns(s, d), LARGE).select("session_date", "asset", "ret", "flag")),
        "missing_price_counts": lambda s, d: market.missing_counts(market.on_all_sessions(panel.segment_prices(s, d))),
        "complete_sessions": lambda s, d: rounded(prices(s, d), 6),
        "segment_returns": lambda s, d: rounded(market.simple_returns(market.on_all_sessions(panel.segment_prices(s, d)))),
        "return_diagnostics": lambda s, d: rounded(market.return_diagnostics(path(s, d), "portfolio_return"), coarse=("skewness", "excess_kurtosis")),
        "equal_weights": lambda s, d: rounded(targets(s, d, 0.1)),
        "portfolio_path": _path_query,
        "portfolio_weights": lambda s, d: rounded(weights(s, d).drop("asset_no")),
        "rebalance_summary": lambda s, d: rounded(portfolio.rebalance_summary(path(s, d)), 6),
        "forecast_schedule": lambda s, d: rounded(schedule.forecast_schedule(path(s, d), WINDOW)),
        "forecast_grid": lambda s, d: schedule.forecast_grid(schedule.forecast_schedule(path(s, d), WINDOW)).select("forecast_date", "level_bp", "confidence_level"),
        "complete_segment_returns": lambda s, d: rounded(market.complete_returns(market.numbered(shared("segment-returns", s, d, lambda: market.drop_empty_sessions(market.simple_returns(market.on_all_sessions(panel.segment_prices(s, d)))))))),
        "rolling_moments": lambda s, d: rounded(means(s, d), drop=("session_no",)),
        "rolling_covariance": lambda s, d: rounded(moments.rolling_covariance(returns(s, d), WINDOW), drop=("session_no",)),
        "ewma_covariance": lambda s, d: rounded(moments.ewma_covariance(returns(s, d), WINDOW, DECAY, means(s, d)), drop=("session_no",)),
        "portfolio_moments": lambda s, d: rounded(moments.moments_of(packed(s, d))),
        "rolling_gaussian_univariate": lambda s, d: rounded(models.rolling_gaussian_univariate(path(s, d), WINDOW), drop=LV),
        "rolling_gaussian_multivariate": lambda s, d: _tails(gaussian(s, d)),
        "ewma_gaussian": lambda s, d: _tails(gaussian(s, d, DECAY)),
        "historical_simulation": lambda s, d: _tails(models.historical_simulation(path(s, d), WINDOW)),
        "forecasts": lambda s, d: rounded(f(s, d), drop=(*NO, "realized_return")),
        "var_exceedances": lambda s, d: rounded(ev.exceedance_counts(f(s, d)), drop=LV),
        "exact_binomial_interval": lambda s, d: rounded(ev.with_interval(ev.exceedance_counts(f(s, d)))),
        "es_tail_severity": lambda s, d: rounded(ev.tail_severity(f(s, d)), drop=LV),
        "quantile_losses": lambda s, d: rounded(ev.daily_scores(f(s, d)).select("model", "level_bp", "forecast_date", "quantile_loss")),
        "fz0_losses": lambda s, d: rounded(ev.daily_scores(f(s, d)).select("model", "level_bp", "forecast_date", "fz0_loss"), 6),
        "identification_residuals": lambda s, d: rounded(ev.daily_scores(f(s, d)).select("model", "level_bp", "forecast_date", "identification"), 6),
        "quantile_loss_rank": lambda s, d: rounded(ev.score_summary(f(s, d), ev.quantile_loss(), "quantile_loss"), drop=LV),
        "fz0_rank": lambda s, d: rounded(ev.score_summary(f(s, d), ev.fz0_loss(), "fz0_loss"), drop=LV),
        "exceedance_transitions": lambda s, d: ev.transitions(f(s, d)).drop(*LV),
        "coverage_likelihood_ratios": lambda s, d: rounded(ev.coverage_tests(f(s, d)).select(*ev.KEY[:3], "lr_unconditional", "lr_independence", "lr_conditional", "p_conditional", "reject_conditional"), coarse=("lr_unconditional", "lr_independence", "lr_conditional")),
        "coverage_holm": lambda s, d: rounded(ev.coverage_report(f(s, d)).select(*ev.KEY[:3], "holm_p_value", "holm_reject")),
        "coverage_report": lambda s, d: rounded(ev.with_interval(ev.coverage_report(f(s, d))), coarse=("lr_unconditional", "lr_independence", "lr_conditional")),
        "var_es_calibration": lambda s, d: rounded(ev.calibration_report(f(s, d)).select(*ev.KEY[:3], "observation_count", "bandwidth", "mean", "long_run_variance", "standard_error", "statistic"), 6),
        "calibration_report": lambda s, d: rounded(ev.calibration_report(f(s, d)), 6),
        "diebold_mariano": lambda s, d: rounded(_dm(s, d).select("score_name", "level_bp", "model_a", "model_b", "observation_count", "bandwidth", "mean", "standard_error", "statistic"), 6),
        "dm_report": lambda s, d: rounded(_dm(s, d), 6),
        "oriented_inference": _inference,
        "traffic_light_path": lambda s, d: ev.traffic_path(f(s, d)).select("model", "forecast_date", "window_start_date", "exception_count", "zone"),
        "traffic_light_summary": lambda s, d: rounded(ev.traffic_summary(ev.traffic_path(f(s, d)))).drop("model_no"),
        "subperiod_definitions": lambda s, d: periods(s, d),
        "subperiod_coverage": lambda s, d: rounded(ev.period_coverage(f(s, d), periods(s, d)), drop=(*LV, "expected_rate", "expected_count", "count_difference")),
        "subperiod_intervals": lambda s, d: rounded(ev.interval_table(ev.period_coverage(f(s, d), periods(s, d)))),
        "subperiod_severity": lambda s, d: rounded(ev.period_severity(f(s, d), periods(s, d)), drop=LV),
        "subperiod_calibration": lambda s, d: rounded(ev.period_calibration(f(s, d), periods(s, d)), 6, drop=LV),
        "subperiod_scores": lambda s, d: rounded(ev.period_scores(f(s, d), periods(s, d)), coarse=("mean_fz0_loss",), drop=LV),
        "first_place_counts": lambda s, d: ev.first_places(ev.period_scores(f(s, d), periods(s, d))).drop("model_no"),
        "rank_matrix": lambda s, d: ev.rank_matrix(ev.period_scores(f(s, d), periods(s, d)), _columns(s, d, True)).drop("model_no"),
        "exception_rate_matrix": lambda s, d: rounded(ev.exception_matrix(ev.period_coverage(f(s, d), periods(s, d)), _columns(s, d)).drop("model_no")),
        "rank_by_period": lambda s, d: ev.long_ranks(ev.period_scores(f(s, d), periods(s, d))).select("score_name", "level_bp", "model", "period_id", "rank"),
        "exception_rate_by_period": lambda s, d: rounded(ev.exception_gaps(ev.period_coverage(f(s, d), periods(s, d)))),
        "full_sample_scores": lambda s, d: rounded(ev.full_sample_scores(ev.period_scores(f(s, d), periods(s, d))), coarse=("mean_fz0_loss",), drop=LV),
        "binomial_reference_band": _band,
        "fhs_multiplicity": _draws,
        "loss_histogram": lambda s, d: simulation.loss_histogram(last_losses(s, d)),
        "loss_marks": lambda s, d: simulation.loss_marks(last_losses(s, d)),
        "loss_tails": lambda s, d: rounded(tails.tail_risk(shared("line-losses", s, d, lambda: panel.line_losses(s, d)), by=["flag"], times="times"), 6, drop=LV),
        "stress_mc_by_scenario": lambda s, d: rounded(_stress_mc(s, d)),
        "market_quotes": lambda s, d: rounded(quotes(s, d), 6),
        "market_coverage": lambda s, d: snapshots.coverage(quotes(s, d)),
        "forecast_contract": lambda s, d: contracts.rule_counts(f(s, d), schedule.forecast_schedule(path(s, d), WINDOW), schedule.LEVELS),
        "return_scenarios": lambda s, d: rounded(scenarios.return_scenarios(stress_dates(s, d), TABLE_SCENARIOS, SEED)),
        "filtered_scenarios": lambda s, d: rounded(scenarios.filtered_scenarios(stress_dates(s, d, DECAY), residuals(s, d), WINDOW, SCENARIOS, SEED)),
        "filtered_losses": lambda s, d: rounded(scenarios.losses_of(scenarios.filtered_scenarios(stress_dates(s, d, DECAY), residuals(s, d), WINDOW, SCENARIOS, SEED), weights(s, d))),
        "companion_scores": lambda s, d: rounded(companion_scores(s, d), coarse=("mean_fz0_loss",)),
        "gaussian_mc": lambda s, d: rounded(_mc(s, d)),
        "ewma_mc": lambda s, d: rounded(_mc(s, d, DECAY)),
        "mc_error_summary": lambda s, d: rounded(simulation.simulation_errors(gaussian(s, d), _mc(s, d)), 4),
        "standardized_residuals": lambda s, d: rounded(residuals(s, d).select("residual_date", F.posexplode("z").alias("asset_no", "z"))),
        "residual_pool_window": lambda s, d: simulation.residual_pools(residuals(s, d), WINDOW),
        "fhs_forecasts": lambda s, d: rounded(fhs(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
