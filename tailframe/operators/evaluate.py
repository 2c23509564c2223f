"""Backtest evaluation of the forecast fact table: coverage, severity, scores, tests, monitoring.

Every function takes (model, model_no, forecast_date, confidence_level, level_bp, realized_loss, value_at_risk,
expected_shortfall, var_exceedance) and groups by model and level, so models are evaluated together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tailframe.functions.special import chi2_tail_1, chi2_tail_2, exact_interval, normal_two_sided

from .contracts import guarded

KEY = ("model", "model_no", "level_bp", "confidence_level")


def hits() -> Column:
    return F.col("var_exceedance")


def long(c: Column) -> Column:
    return c.cast("long")


# Coverage


def exceedance_counts(f: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Observed against expected exceedances. The expected rate is 1 - level in floating point."""
    g = f.groupBy(*keys).agg(F.count("*").alias("observation_count"), F.count_if(hits()).alias("observed_count"))
    rate = 1.0 - F.col("confidence_level")
    n, x = F.col("observation_count"), F.col("observed_count")
    return g.select(*keys, "observation_count", "observed_count", rate.alias("expected_rate"), (x / n).alias("observed_rate"), (rate * n).alias("expected_count"), (x - rate * n).alias("count_difference"))


def with_interval(counts: DataFrame, level: float = 0.95) -> DataFrame:
    """Adds the exact binomial interval of the observed rate."""
    return counts.withColumn("_i", exact_interval(F.col("observed_count"), F.col("observation_count"), level)).withColumns({"rate_lower": F.col("_i.lower"), "rate_upper": F.col("_i.upper")}).drop("_i")


def bernoulli(successes: Column, failures: Column, p: Column) -> Column:
    """Log-likelihood with 0 log 0 = 0."""
    s = F.when(successes > 0, successes * F.ln(p)).otherwise(F.lit(0.0))
    return s + F.when(failures > 0, failures * F.ln(1 - p)).otherwise(F.lit(0.0))


def kupiec(x: Column, n: Column, level: Column) -> Column:
    p = 1.0 - level
    return F.greatest(F.lit(0.0), -2 * (bernoulli(x, n - x, p) - bernoulli(x, n - x, x / n)))


def transitions(f: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """n00, n01, n10, n11: how often each state follows each, in date order."""
    before = F.lag("var_exceedance").over(W.partitionBy(*keys).orderBy("forecast_date"))
    rows = f.select(*keys, before.alias("a"), hits().alias("b"))
    count = lambda a, b: F.count_if((F.col("a") == a) & (F.col("b") == b))
    return rows.groupBy(*keys).agg(count(False, False).alias("n00"), count(False, True).alias("n01"), count(True, False).alias("n10"), count(True, True).alias("n11"))


def independence(n00: Column, n01: Column, n10: Column, n11: Column) -> Column:
    """Likelihood ratio of first-order dependence; a state that is never left adds nothing."""
    total = n00 + n01 + n10 + n11
    p = (n01 + n11) / total
    zero = F.when(n00 + n01 > 0, bernoulli(n01, n00, n01 / (n00 + n01))).otherwise(F.lit(0.0))
    one = F.when(n10 + n11 > 0, bernoulli(n11, n10, n11 / (n10 + n11))).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), -2 * (bernoulli(n01 + n11, n00 + n10, p) - zero - one))


def coverage_tests(f: DataFrame, significance: float = 0.05, keys: Sequence[str] = KEY) -> DataFrame:
    """Unconditional coverage, independence, conditional coverage; missing transition rates are null."""
    c = exceedance_counts(f, keys).join(transitions(f, keys), list(keys))
    n00, n01, n10, n11 = (F.col(k) for k in ("n00", "n01", "n10", "n11"))
    c = c.withColumns({"lr_unconditional": kupiec(F.col("observed_count"), F.col("observation_count"), F.col("confidence_level")), "lr_independence": independence(n00, n01, n10, n11)})
    c = c.withColumn("lr_conditional", F.col("lr_unconditional") + F.col("lr_independence"))
    c = c.withColumns({
        "transition_rate": (n01 + n11) / (n00 + n01 + n10 + n11), "rate_after_normal": F.when(n00 + n01 > 0, n01 / (n00 + n01)), "rate_after_exceedance": F.when(n10 + n11 > 0, n11 / (n10 + n11)),
        "p_unconditional": chi2_tail_1(F.col("lr_unconditional")), "p_independence": chi2_tail_1(F.col("lr_independence")), "p_conditional": chi2_tail_2(F.col("lr_conditional")),
    })
    return c.withColumns({f"reject_{t}": F.col(f"p_{t}") < significance for t in ("unconditional", "independence", "conditional")})


def holm(rows: DataFrame, p: str, order: Sequence[str], family: Sequence[str] = (), significance: float = 0.05, names: tuple[str, str] = ("holm_p_value", "holm_reject")) -> DataFrame:
    """Step-down adjusted p-values within each family; ties keep their order. Families are a handful of tests."""
    base = W.partitionBy(*family)
    ranked = base.orderBy(p, *order)
    m = F.count("*").over(base)
    step = F.col(p) * (m - F.row_number().over(ranked) + 1)
    out = rows.withColumn("_step", step)
    adjusted = F.least(F.lit(1.0), F.max("_step").over(ranked.rowsBetween(W.unboundedPreceding, 0)))
    return out.withColumn(names[0], adjusted).drop("_step").withColumn(names[1], F.col(names[0]) < significance)


def coverage_report(f: DataFrame, significance: float = 0.05) -> DataFrame:
    """Coverage tests of all models; conditional coverage is adjusted over all models and levels."""
    return holm(coverage_tests(f, significance), "p_conditional", ["model_no", "level_bp"], significance=significance)


# Severity


def tail_severity(f: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """What happened on exceedance days; null where there is none."""
    hit = lambda c: F.when(hits(), c)
    loss, var, es = F.col("realized_loss"), F.col("value_at_risk"), F.col("expected_shortfall")
    excess = hit(loss - var)
    return f.groupBy(*keys).agg(
        F.count("*").alias("observation_count"), F.count_if(hits()).alias("exceedance_count"), F.avg(hit(loss)).alias("mean_loss"), F.avg(hit(var)).alias("mean_value_at_risk"), F.avg(hit(es)).alias("mean_expected_shortfall"),
        F.avg(excess).alias("mean_excess"), F.median(excess).alias("median_excess"), F.max(excess).alias("max_excess"), F.avg(hit(loss - es)).alias("mean_severity_gap"),
    )


# Scores


def quantile_loss() -> Column:
    level = F.col("confidence_level")
    return F.when(hits(), level).otherwise(1.0 - level) * F.abs(F.col("realized_loss") - F.col("value_at_risk"))


def fz0_loss() -> Column:
    """Joint score of VaR and ES; ES must be positive."""
    var, es = F.col("value_at_risk"), F.col("expected_shortfall")
    over = F.when(hits(), (F.col("realized_loss") - var) / ((1.0 - F.col("confidence_level")) * es)).otherwise(F.lit(0.0))
    return over + var / es + F.ln(es) - 1


def identification() -> Column:
    """Zero on average if VaR and ES are right together."""
    var = F.col("value_at_risk")
    return var + F.when(hits(), (F.col("realized_loss") - var) / (1.0 - F.col("confidence_level"))).otherwise(F.lit(0.0)) - F.col("expected_shortfall")


def daily_scores(f: DataFrame) -> DataFrame:
    return f.select(*KEY, "forecast_date", quantile_loss().alias("quantile_loss"), fz0_loss().alias("fz0_loss"), identification().alias("identification"))


def score_summary(f: DataFrame, score: Column, name: str, keys: Sequence[str] = KEY) -> DataFrame:
    """Mean score by model, with its rank among the models of a level; equal scores share a rank."""
    g = f.select(*keys, score.alias("s")).groupBy(*keys).agg(F.count("*").alias("observation_count"), F.avg("s").alias(f"mean_{name}"))
    others = [k for k in keys if k not in ("model", "model_no")]
    return g.withColumn("rank", long(F.rank().over(W.partitionBy(*others).orderBy(f"mean_{name}"))))


# Autocorrelation-robust tests


def bandwidth(n: Column) -> Column:
    return F.least(n - 1, F.floor(4 * F.pow(n / 100.0, F.lit(2.0 / 9.0))))


def newey_west(rows: DataFrame, value: str, keys: Sequence[str], order: str = "forecast_date", lags: int | None = None, significance: float = 0.05) -> DataFrame:
    """Test of a zero mean with Bartlett-weighted autocovariances (over T), a two-sided normal p-value:
    without variance a zero mean has statistic 0, any other an infinite one.

    Each lag meets its partner by an equi-join on the position, so lags add rows, not passes.
    """
    if lags is not None and (isinstance(lags, bool) or lags < 0):
        raise ValueError("lags is a whole number of at least 0")
    group = W.partitionBy(*keys)
    d = rows.select(*keys, F.col(value).alias("v"), long(F.row_number().over(group.orderBy(order))).alias("t"), F.count("*").over(group).alias("n"), F.avg(value).over(group).alias("m"))
    d = d.withColumns({"d": F.col("v") - F.col("m"), "k_max": long(bandwidth(F.col("n")) if lags is None else F.least(F.col("n") - 1, F.lit(lags)))})
    later = d.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k_max")))).withColumn("t", F.col("t") - F.col("k")).drop("v")
    gamma = later.join(d.select(*keys, "t", F.col("d").alias("e")), [*keys, "t"])
    share = F.when(F.col("k") == 0, 1.0).otherwise(2.0 * (1.0 - F.col("k") / (F.col("k_max") + 1.0)))
    omega = F.greatest(F.lit(0.0), F.sum(share * F.col("d") * F.col("e") / F.col("n")))
    out = gamma.groupBy(*keys).agg(F.first("n").alias("n"), F.first("k_max").alias("k_max"), F.first("m").alias("m"), omega.alias("long_run_variance"))
    out = out.withColumn("standard_error", F.sqrt(F.col("long_run_variance") / F.col("n")))
    flat = F.col("standard_error") == 0
    stat = F.when(flat & (F.col("m") == 0), 0.0).when(flat & (F.col("m") > 0), float("inf")).when(flat, float("-inf")).otherwise(F.col("m") / F.col("standard_error"))
    out = out.withColumn("statistic", stat)
    p = F.when(F.abs("statistic") == float("inf"), 0.0).when(F.col("statistic") == 0, 1.0).otherwise(normal_two_sided(F.col("statistic")))
    out = out.withColumn("p_value", p)
    return out.select(*keys, F.col("n").alias("observation_count"), F.col("k_max").alias("bandwidth"), F.col("m").alias("mean"), "long_run_variance", "standard_error", "statistic", "p_value", (F.col("p_value") < significance).alias("reject"))


def calibration_report(f: DataFrame, lags: int | None = None, significance: float = 0.05) -> DataFrame:
    """Whether identification residuals average zero, adjusted over all models and levels."""
    rows = f.select(*KEY, "forecast_date", identification().alias("v"))
    return holm(newey_west(rows, "v", KEY, lags=lags, significance=significance), "p_value", ["model_no", "level_bp"], significance=significance)


def diebold_mariano(f: DataFrame, lags: int | None = None, significance: float = 0.05) -> DataFrame:
    """All pairs of models (earlier minus later) by score and level, adjusted within each score."""
    s = f.select("model", "model_no", "level_bp", "confidence_level", "forecast_date", quantile_loss().alias("q"), fz0_loss().alias("z"))
    s = s.select("model", "model_no", "level_bp", "confidence_level", "forecast_date", F.expr("stack(2, 0, 'quantile_loss', q, 1, 'fz0_loss', z) as (score_no, score_name, s)"))
    same = ["score_no", "score_name", "level_bp", "confidence_level", "forecast_date"]
    a = s.select(*same, F.col("model").alias("model_a"), F.col("model_no").alias("a"), F.col("s").alias("sa"))
    b = s.select(*same, F.col("model").alias("model_b"), F.col("model_no").alias("b"), F.col("s").alias("sb"))
    d = a.join(b, same).where("a < b").withColumn("v", F.col("sa") - F.col("sb"))
    keys = ["score_no", "score_name", "level_bp", "confidence_level", "a", "b", "model_a", "model_b"]
    out = newey_west(d, "v", keys, lags=lags, significance=significance)
    return holm(out, "p_value", ["level_bp", "a", "b"], ["score_name"], significance)


# Monitoring


def zone(count: Column) -> Column:
    return F.when(count <= 4, "green").when(count <= 9, "amber").otherwise("red")


def traffic_path(f: DataFrame, window: int = 250, level_bp: int = 9900) -> DataFrame:
    """Exceedances in the last ``window`` 99 % forecasts of each model, once that many exist, and their zone."""
    w = W.partitionBy("model", "model_no").orderBy("forecast_date").rowsBetween(1 - window, 0)
    r = f.where(F.col("level_bp") == level_bp).select(
        "model", "model_no", "forecast_date", F.first("forecast_date").over(w).alias("window_start_date"), F.count("*").over(w).alias("window_observations"), F.sum(long(hits())).over(w).alias("exception_count")
    )
    return r.where(F.col("window_observations") == window).withColumn("zone", zone(F.col("exception_count")))


def traffic_summary(path: DataFrame) -> DataFrame:
    day, n = F.col("forecast_date"), F.col("exception_count")
    in_zone = lambda z: F.count_if(F.col("zone") == z)
    total = F.count("*")
    return path.groupBy("model", "model_no").agg(
        total.alias("window_count"), *(in_zone(z).alias(f"{z}_count") for z in ("green", "amber", "red")), *((in_zone(z) / total).alias(f"{z}_rate") for z in ("green", "amber", "red")),
        F.max_by("exception_count", day).alias("latest_count"), F.max_by("zone", day).alias("latest_zone"), F.max(n).alias("max_count"), F.min_by(day, F.struct(-n, day)).alias("first_max_date"),
        F.min(F.when(F.col("zone") == "amber", day)).alias("first_amber_date"), F.min(F.when(F.col("zone") == "red", day)).alias("first_red_date"),
    )


# Subperiods

#: Fewest expected or observed exceedances that are not called sparse, and the share of the fullest year that makes a whole one.
SPARSE, WHOLE_YEAR = 5, 0.90


def subperiods(f: DataFrame, stress: Sequence[tuple[str, str, str, str]] = ()) -> DataFrame:
    """Calendar years of the forecasts and named stress periods (id, label, first day, last day). A few rows.

    A stress period without forecasts is an error.
    """
    days = f.select("forecast_date").distinct()
    years = days.groupBy(F.year("forecast_date").alias("y")).agg(F.min("forecast_date").alias("first_forecast_date"), F.max("forecast_date").alias("last_forecast_date"), F.count("*").alias("observation_count"))
    top = F.max("observation_count").over(W.partitionBy())
    out = years.select(
        F.concat(F.lit("year_"), F.col("y").cast("string")).alias("period_id"), F.lit("calendar_year").alias("period_type"), F.col("y").cast("string").alias("label"), F.make_date("y", F.lit(1), F.lit(1)).alias("requested_start_date"),
        F.make_date("y", F.lit(12), F.lit(31)).alias("requested_end_date"), "first_forecast_date", "last_forecast_date", "observation_count", (F.col("observation_count") < WHOLE_YEAR * top).alias("is_partial"),
    )
    if stress:
        s = f.sparkSession.createDataFrame(list(stress), "period_id string, label string, a string, b string").select("period_id", "label", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
        s = s.join(days, F.col("forecast_date").between(F.col("a"), F.col("b")), "left").groupBy("period_id", "label", "a", "b").agg(F.min("forecast_date").alias("x"), F.max("forecast_date").alias("y"), F.count("forecast_date").alias("n"))
        out = out.union(s.select("period_id", F.lit("stress"), "label", "a", "b", "x", "y", guarded(F.col("n") > 0, F.col("n"), "a stress period holds no forecast"), F.lit(False)))
    return out


PERIOD_KEY = ("period_id", *KEY)


#: Periods that are held against every forecast; more of them meet forecasts by stretches of so many days.
FEW, STRETCH = 200, 64


def by_period(f: DataFrame, periods: DataFrame) -> DataFrame:
    """Each forecast with every period that holds its date.

    A few periods are broadcast and compared. Of many, each is cut at the stretches of STRETCH days that it reaches into, so forecasts and periods meet by equal stretches, and dates
    are checked there: no forecast is held against all periods.
    """
    p = periods.select("period_id", "requested_start_date", "requested_end_date")
    inside = F.col("forecast_date").between(F.col("requested_start_date"), F.col("requested_end_date"))
    if p.limit(FEW + 1).count() <= FEW:
        return f.join(F.broadcast(p), inside)
    stretch = lambda c: F.expr(f"CAST(floor(unix_date({c}) / {STRETCH}) AS INT)")
    cut = p.where("requested_start_date <= requested_end_date").withColumn("_stretch", F.explode(F.sequence(stretch("requested_start_date"), stretch("requested_end_date"))))
    return f.withColumn("_stretch", stretch("forecast_date")).join(cut, "_stretch").where(inside).drop("_stretch")


def period_coverage(f: DataFrame, periods: DataFrame) -> DataFrame:
    rows = by_period(f, periods)
    c = exceedance_counts(rows, PERIOD_KEY)
    m = rows.groupBy(*PERIOD_KEY).agg(F.avg("value_at_risk").alias("mean_value_at_risk"), F.avg("expected_shortfall").alias("mean_expected_shortfall"))
    c = c.join(m, list(PERIOD_KEY))
    return c.withColumns({"sparse_expected": F.col("expected_count") < SPARSE, "sparse_observed": F.col("observed_count") < SPARSE})


def period_severity(f: DataFrame, periods: DataFrame) -> DataFrame:
    return tail_severity(by_period(f, periods), PERIOD_KEY)


def period_calibration(f: DataFrame, periods: DataFrame) -> DataFrame:
    rows = by_period(f, periods)
    return rows.groupBy(*PERIOD_KEY).agg(F.count("*").alias("observation_count"), F.avg(identification()).alias("mean_identification"))


def companion_table(scores: DataFrame) -> DataFrame:
    """``period_scores`` with their period_type, by the names under which they are published."""
    return scores.select(
        "period_id", "period_type", "model", "confidence_level", "observation_count", F.col("mean_quantile_loss").alias("mean_var_quantile_loss"), F.col("quantile_loss_rank").alias("var_quantile_loss_rank"), "mean_fz0_loss", "fz0_loss_rank"
    )


def period_scores(f: DataFrame, periods: DataFrame) -> DataFrame:
    rows = by_period(f, periods)
    s = rows.groupBy(*PERIOD_KEY).agg(F.count("*").alias("observation_count"), F.avg(quantile_loss()).alias("mean_quantile_loss"), F.avg(fz0_loss()).alias("mean_fz0_loss"))
    w = W.partitionBy("period_id", "level_bp")
    return s.withColumns({"quantile_loss_rank": long(F.rank().over(w.orderBy("mean_quantile_loss"))), "fz0_loss_rank": long(F.rank().over(w.orderBy("mean_fz0_loss")))})


def long_ranks(scores: DataFrame) -> DataFrame:
    return scores.select("period_id", "model", "model_no", "level_bp", F.expr("stack(2, 'quantile_loss', quantile_loss_rank, 'fz0_loss', fz0_loss_rank) as (score_name, rank)"))


def first_places(scores: DataFrame) -> DataFrame:
    """Calendar years in which each model ranks first, by score and level."""
    r = long_ranks(scores.where(F.col("period_id").startswith("year_")))
    return r.groupBy("score_name", "level_bp", "model", "model_no").agg(F.count_if(F.col("rank") == 1).alias("first_places"))


def rank_matrix(scores: DataFrame, periods: Sequence[str]) -> DataFrame:
    return long_ranks(scores).groupBy("score_name", "level_bp", "model", "model_no").pivot("period_id", list(periods)).agg(F.first("rank"))


def exception_gaps(coverage: DataFrame) -> DataFrame:
    """Observed minus expected exception rate, a row for each period, level and model."""
    return coverage.select("level_bp", "model", "period_id", (F.col("observed_rate") - F.col("expected_rate")).alias("rate_gap"))


def exception_matrix(coverage: DataFrame, periods: Sequence[str]) -> DataFrame:
    """Observed minus expected exception rate, models and levels by period."""
    gap = F.col("observed_rate") - F.col("expected_rate")
    return coverage.groupBy("level_bp", "model", "model_no").pivot("period_id", list(periods)).agg(F.first(gap))


def interval_table(coverage: DataFrame, level: float = 0.95) -> DataFrame:
    return with_interval(coverage, level).select(*PERIOD_KEY, "observation_count", "observed_rate", "expected_rate", "rate_lower", "rate_upper")


def full_sample_scores(scores: DataFrame) -> DataFrame:
    """Full-sample means from calendar-year means, weighted by their observations."""
    y = scores.where(F.col("period_id").startswith("year_"))
    n = F.col("observation_count")
    mean = lambda c: F.sum(n * F.col(c)) / F.sum(n)
    return y.groupBy(*KEY).agg(F.sum(n).alias("observation_count"), mean("mean_quantile_loss").alias("mean_quantile_loss"), mean("mean_fz0_loss").alias("mean_fz0_loss"))


# Publication


def oriented_inference(dm: DataFrame, plain: DataFrame, means: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """The pairwise tests as (model, reference) in the order of ``pairs``, signs turned where they were tested the other way.

    ``plain`` is the same table without autocovariances; where its adjusted decision differs, decision_changed is true.
    """
    spark = dm.sparkSession
    want = spark.createDataFrame([(n, *p) for n, p in enumerate(pairs)], "pair_no int, model string, reference string")
    met = ((F.col("model_a") == F.col("model")) & (F.col("model_b") == F.col("reference"))) | ((F.col("model_a") == F.col("reference")) & (F.col("model_b") == F.col("model")))
    d = dm.join(F.broadcast(want), met)
    turn = F.when(F.col("model_a") == F.col("model"), 1.0).otherwise(-1.0)
    other = plain.select("score_name", "level_bp", "model_a", "model_b", F.col("statistic").alias("plain_statistic"), F.col("holm_p_value").alias("plain_holm_p_value"), F.col("holm_reject").alias("plain_reject"))
    d = d.join(other, ["score_name", "level_bp", "model_a", "model_b"])
    long_means = means.select("model", "level_bp", F.expr("stack(2, 'quantile_loss', mean_quantile_loss, 'fz0_loss', mean_fz0_loss) as (score_name, s)"))
    d = d.join(long_means.withColumnRenamed("s", "model_mean"), ["model", "level_bp", "score_name"])
    d = d.join(long_means.select(F.col("model").alias("reference"), "level_bp", "score_name", F.col("s").alias("reference_mean")), ["reference", "level_bp", "score_name"])
    gap = turn * F.col("mean")
    percent = F.when(F.col("score_name") == "quantile_loss", 100 * gap / F.col("reference_mean"))
    label = F.when(F.col("holm_p_value") < 0.001, "<0.001").otherwise(F.format_string("%.3f", "holm_p_value"))
    return d.select(
        "score_name", "level_bp", "pair_no", "model", "reference", "model_mean", "reference_mean", gap.alias("mean_difference"), percent.alias("percent_difference"), (turn * F.col("statistic")).alias("statistic"), "p_value", "holm_p_value", "holm_reject",
        F.when(gap < 0, F.col("model")).when(gap > 0, F.col("reference")).alias("lower_score_model"), (turn * F.col("plain_statistic")).alias("plain_statistic"), "plain_holm_p_value", "plain_reject", (F.col("holm_reject") != F.col("plain_reject")).alias("decision_changed"), label.alias("p_label"),
    )
