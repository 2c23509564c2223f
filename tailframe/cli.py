"""Commands: each stage reads verified snapshots and writes a new one.

python -m tailframe.cli raw        --market DIR --root R --id ID [--format F] [--start D] [--end D] [--assets A,B] [--fields F,G]
python -m tailframe.cli returns    --config C --market DIR --root R --id ID
python -m tailframe.cli portfolio  --config C --returns DIR --root R --id ID
python -m tailframe.cli backtest   --config C --returns DIR --portfolio DIR --model M --root R --id ID [--scenarios N]
python -m tailframe.cli report     --kind K --backtest DIR ... --root R --id ID [--bandwidth N] [--significance-level X]
                                   [--interval-confidence-level X] [--stress ID:LABEL:FIRST:LAST ...]
python -m tailframe.cli publish    --primary DIR --plain DIR --periods DIR --root R --id ID
python -m tailframe.cli validate   --config C --returns DIR --portfolio DIR --backtest DIR --root R --id ID
python -m tailframe.cli simulate   --config C --returns DIR --portfolio DIR --root R --id ID [--date D] [--scenarios N]
python -m tailframe.cli summary    --portfolio DIR
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailframe.operators import contracts, market, models, moments, portfolio, schedule, simulation
from tailframe.operators import evaluate as ev
from tailframe.sources import config, panel, snapshots, store
from tailframe.sources import market as market_source

#: Published comparisons (model, reference) in their order.
PAIRS = (("ewma-gaussian", "rolling-gaussian"), ("filtered-historical", "rolling-gaussian"), ("filtered-historical", "ewma-gaussian"))


def process_raw(spark: SparkSession, path: str, root: str, name: str, fmt: str = "parquet", **request: str | None) -> str:
    """What is asked of a market (dates, assets, fields), as an immutable snapshot with its coverage. ``fmt`` may be the market source's name: then whole files are left out."""
    asked = {k: v for k, v in request.items() if v}
    if fmt == market_source.NAME:
        rows = market_source.read_tree(spark, path, **asked)
    else:
        rows = panel.read_market(spark, path, fmt)
        for column, key in (("asset", "assets"), ("field", "fields")):
            if key in asked:
                rows = rows.where(F.col(column).isin(*(x.strip() for x in asked[key].split(","))))
        for key, keep in (("start", F.col("session_date") >= asked.get("start")), ("end", F.col("session_date") <= asked.get("end"))):
            rows = rows.where(keep) if key in asked else rows
    return snapshots.save_raw(root, name, rows, {"path": path, "format": fmt, **asked})


def process_returns(spark: SparkSession, c: config.Config, path: str, root: str, name: str, field: str = "Adj Close", fmt: str = "parquet") -> str:
    """Returns with gaps, those of sessions in which every asset has one, and the large ones, which are kept."""
    raw = contracts.check_market(panel.read_market(spark, path, fmt), c.assets, [field], [field])
    prices = panel.extract_field(raw, field).where(F.col("asset").isin(*c.assets))
    returns = store.working_table(market.asset_returns(market.on_all_sessions(store.working_table(prices, "prices"))), "returns")
    complete = store.working_table(market.complete_returns(returns), "complete")
    flagged = store.working_table(market.large_return_flags(returns, c.large_return).where("flag"), "flagged")
    facts = {"complete": date_facts(complete, "session_date"), "flag_counts": {r["asset"]: r["count"] for r in flagged.groupBy("asset").count().collect()}, "large_return": c.large_return, "flagged": "retained"}
    return store.save_snapshot(root, name, {"returns": returns, "complete_returns": complete, "flagged": flagged}, datetime.now(UTC), {"stage": "returns", "source": path, "assets": list(c.assets)}, facts=facts)


def date_facts(df: DataFrame, column: str) -> dict[str, object]:
    """Number of dates, the first and the last."""
    r = df.agg(F.count_distinct(column).alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).first()
    return {"dates": r["n"], "first": str(r["a"]), "last": str(r["b"])}


def process_portfolio(spark: SparkSession, c: config.Config, source: str, root: str, name: str) -> str:
    """The path of an equally weighted portfolio over the complete sessions of a returns snapshot."""
    config.require_runnable(c)
    returns = contracts.check_returns(store.load_snapshot(spark, source)["complete_returns"])
    targets = contracts.check_weights(portfolio.equal_weights(returns, c.cash))
    assets = store.working_table(portfolio.asset_path(returns, targets, c.rebalance), "assets")
    tables = {"daily": portfolio.path_of(assets, c.initial_value), "weights": portfolio.weights_of(assets)}
    return store.save_snapshot(root, name, tables, datetime.now(UTC), {"stage": "portfolio", "returns": store.load_manifest(spark, source)["snapshot_id"]})


def load_portfolio(spark: SparkSession, at: str) -> dict[str, DataFrame]:
    """A portfolio snapshot whose days and weights belong together."""
    found = store.load_snapshot(spark, at)
    contracts.check_alignment(found["daily"], found["weights"])
    return found


def load_sources(spark: SparkSession, returns_at: str, portfolio_at: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Returns and portfolio that were made from each other and share their dates and assets."""
    made_from = store.load_manifest(spark, returns_at)["snapshot_id"]
    if store.load_manifest(spark, portfolio_at)["lineage"]["returns"] != made_from:
        raise store.SnapshotError("the portfolio was made from other returns")
    returns, found = store.load_snapshot(spark, returns_at)["complete_returns"], load_portfolio(spark, portfolio_at)
    contracts.check_same_keys(returns, found["weights"], ["session_date", "asset"])
    return returns, found


def backtest_facts(f: DataFrame) -> dict[str, object]:
    counts = f.groupBy("level_bp").agg(F.count_if("var_exceedance").alias("n")).collect()  # a row for each level
    return {"forecasts": date_facts(f, "forecast_date"), "exceedances": {str(r["level_bp"]): r["n"] for r in counts}}


def run_backtest(spark: SparkSession, c: config.Config, returns_at: str, portfolio_at: str, model: str, root: str, name: str, scenarios: int | None = None) -> str:
    config.require_runnable(c)
    returns, path = load_sources(spark, returns_at, portfolio_at)
    n = c.scenarios if scenarios is None else scenarios
    watched = contracts.Watched(models.model_forecasts(model, returns, path["daily"], path["weights"], c.window, c.levels, c.decay, n, c.seed), contracts.row_rules())
    f = store.working_table(watched.table, "forecasts")
    watched.enforce()  # what a row can break by itself was counted while it was written
    contracts.check_forecasts(f, schedule.forecast_schedule(path["daily"], c.window), c.levels)
    ids = {k: store.load_manifest(spark, at)["snapshot_id"] for k, at in (("returns", returns_at), ("portfolio", portfolio_at))}
    lineage = {"stage": "backtest", "model": model, **ids, "window": c.window, "levels": list(c.levels), "scenarios": n, "seed": c.seed, "decay": c.decay}
    base = store.save_snapshot(root, name, {"forecasts": f}, datetime.now(UTC), lineage, {"forecasts": ["model"]}, backtest_facts(f))
    load_backtest(spark, base)
    return base


def load_backtest(spark: SparkSession, at: str) -> DataFrame:
    """A backtest's forecasts, whose dates and exceedances are those that its manifest states."""
    f = store.load_snapshot(spark, at)["forecasts"]
    if backtest_facts(f) != store.load_manifest(spark, at)["facts"]:
        raise store.SnapshotError("dates or exceedances differ from the manifest")
    return f


def reports(f: DataFrame, bandwidth: int | None, stress: Sequence[tuple[str, str, str, str]], significance: float = 0.05, interval: float = 0.95) -> dict[str, Callable[[], dict[str, DataFrame]]]:
    def subperiods() -> dict[str, DataFrame]:
        p = store.working_table(ev.subperiods(f, stress), "periods")
        coverage = ev.with_interval(ev.period_coverage(f, p), interval)
        return {"periods": p, "coverage": coverage, "severity": ev.period_severity(f, p), "calibration": ev.period_calibration(f, p), "scores": ev.period_scores(f, p)}

    def accuracy() -> dict[str, DataFrame]:
        return {"quantile_loss": ev.score_summary(f, ev.quantile_loss(), "quantile_loss"), "fz0_loss": ev.score_summary(f, ev.fz0_loss(), "fz0_loss"), "comparisons": ev.diebold_mariano(f, bandwidth, significance)}

    return {
        "coverage": lambda: {"coverage": ev.with_interval(ev.coverage_report(f, significance), interval)},
        "severity": lambda: {"severity": ev.tail_severity(f)},
        "calibration": lambda: {"calibration": ev.calibration_report(f, bandwidth, significance)},
        "accuracy": accuracy,
        "traffic": lambda: {"path": ev.traffic_path(f), "summary": ev.traffic_summary(ev.traffic_path(f))},
        "subperiods": subperiods,
    }


def run_report(spark: SparkSession, kind: str, backtests: list[str], root: str, name: str, bandwidth: int | None = None, stress: Sequence[tuple[str, str, str, str]] = (), significance: float = 0.05, interval: float = 0.95) -> str:
    for what, x in (("significance level", significance), ("interval confidence level", interval)):
        config.within(x, what, 0, 1)
    manifests = [store.load_manifest(spark, b) for b in backtests]
    store.require_same_lineage(manifests, ["returns", "portfolio", "window", "levels", "scenarios", "seed"])
    f = store.working_table(reduce(DataFrame.unionByName, [load_backtest(spark, b) for b in backtests]), "forecasts")
    contracts.check_common_dates(f)
    tables = {k: store.working_table(t, k) for k, t in reports(f, bandwidth, stress, significance, interval)[kind]().items()}
    lineage = {"report": kind, "bandwidth": bandwidth, "significance": significance, "interval": interval, "sources": [m["snapshot_id"] for m in manifests], "experiment": manifests[0]["lineage"]["portfolio"]}
    return store.write_report(root, name, tables, datetime.now(UTC), lineage)


def publish(spark: SparkSession, primary: str, plain: str, periods: str, root: str, name: str, pairs: Sequence[tuple[str, str]] = PAIRS) -> str:
    """The comparisons as published: primary test, the same without autocovariances, and full-sample means.

    The three reports must come from the same experiment, the primary with automatic bandwidth, the other with none.
    """
    manifests = [store.load_manifest(spark, at) for at in (primary, plain, periods)]
    store.require_inference_lineage(*manifests)
    tests, other = (store.load_snapshot(spark, at)["comparisons"] for at in (primary, plain))
    scores = store.load_snapshot(spark, periods)["scores"]
    store.require_columns(scores, ["period_id", *ev.KEY, "observation_count", "mean_quantile_loss", "mean_fz0_loss"])
    n, levels = scores.select("model").distinct().count(), scores.select("level_bp").distinct().count()
    for table in (tests, other):
        contracts.check_comparisons(table, n, levels)
    out = ev.oriented_inference(tests, other, ev.full_sample_scores(scores), pairs)
    return store.write_report(root, name, {"inference": store.working_table(out, "inference")}, datetime.now(UTC), {"report": "inference", "sources": [m["snapshot_id"] for m in manifests], "experiment": manifests[0]["lineage"]["experiment"]})


def validate(spark: SparkSession, c: config.Config, returns_at: str, portfolio_at: str, backtest_at: str, root: str, name: str) -> str:
    """How far the simulated VaR and ES of a Gaussian backtest lie from their closed forms, in basis points."""
    returns, path = load_sources(spark, returns_at, portfolio_at)
    lineage = store.load_manifest(spark, backtest_at)["lineage"]
    exact = models.model_of(lineage["model"]).closed_form
    if exact is None:
        raise store.SnapshotError("only Gaussian models have a closed form")
    analytic = exact(models.Inputs(returns, path["daily"], path["weights"], c.window, c.levels, c.decay))
    errors = simulation.simulation_errors(analytic, load_backtest(spark, backtest_at))
    return store.write_report(root, name, {"errors": store.working_table(errors, "errors")}, datetime.now(UTC), {"report": "validation", "backtest": backtest_at, **lineage})


def simulate(spark: SparkSession, c: config.Config, returns_at: str, portfolio_at: str, root: str, name: str, date: str | None = None, scenarios: int | None = None) -> str:
    """The simulated loss distribution of one forecast date (the last, if none is named), with its VaR and ES."""
    returns, path = load_sources(spark, returns_at, portfolio_at)
    dates = models.packed_dates(returns, path["weights"], c.window)
    if date is not None:
        dates = dates.where(F.col("forecast_date") == F.to_date(F.lit(date)))
    dates = store.working_table(dates, "dates")
    day = dates.agg(F.max("forecast_date")).first()[0]
    if day is None:
        raise contracts.ContractError(f"there is no forecast for {date}")
    n = c.scenarios if scenarios is None else scenarios
    losses = store.working_table(simulation.scenario_losses(dates.where(F.col("forecast_date") == F.lit(day)), n, c.seed), "losses")
    tables = {"histogram": simulation.loss_histogram(losses), "marks": simulation.loss_marks(losses, c.levels)}
    return store.write_report(root, name, tables, datetime.now(UTC), {"report": "simulation", "date": str(day), "scenarios": n, "seed": c.seed})


def stress_period(text: str) -> tuple[str, str, str, str]:
    parts = text.split(":")
    if len(parts) != 4:
        raise argparse.ArgumentTypeError("a stress period is ID:LABEL:FIRST:LAST")
    return parts[0], parts[1], parts[2], parts[3]


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tailframe")
    p.add_argument("command", choices=["raw", "returns", "portfolio", "backtest", "report", "publish", "validate", "simulate", "summary"])
    for a in ("config", "market", "returns", "portfolio", "model", "root", "id", "kind", "primary", "plain", "periods", "date", "start", "end", "assets", "fields"):
        p.add_argument(f"--{a}")
    p.add_argument("--format", default="parquet")
    p.add_argument("--backtest", nargs="+")
    p.add_argument("--scenarios", type=int)
    p.add_argument("--bandwidth", type=int)
    p.add_argument("--stress", nargs="*", type=stress_period, default=[])
    p.add_argument("--significance-level", type=float, default=0.05)
    p.add_argument("--interval-confidence-level", type=float, default=0.95)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tailframe").getOrCreate()
    c = config.load(a.config) if a.config else None
    do = {
        "raw": lambda: process_raw(spark, a.market, a.root, a.id, a.format, start=a.start, end=a.end, assets=a.assets, fields=a.fields),
        "returns": lambda: process_returns(spark, c, a.market, a.root, a.id, fmt=a.format),
        "portfolio": lambda: process_portfolio(spark, c, a.returns, a.root, a.id),
        "backtest": lambda: run_backtest(spark, c, a.returns, a.portfolio, a.model, a.root, a.id, a.scenarios),
        "report": lambda: run_report(spark, a.kind, a.backtest, a.root, a.id, a.bandwidth, a.stress, a.significance_level, a.interval_confidence_level),
        "publish": lambda: publish(spark, a.primary, a.plain, a.periods, a.root, a.id),
        "validate": lambda: validate(spark, c, a.returns, a.portfolio, a.backtest[0], a.root, a.id),
        "simulate": lambda: simulate(spark, c, a.returns, a.portfolio, a.root, a.id, a.date, a.scenarios),
        "summary": lambda: market.return_diagnostics(load_portfolio(spark, a.portfolio)["daily"], "portfolio_return").show(vertical=True),
    }
    out = do[a.command]()
    if out:
        print(out)


if __name__ == "__main__":
    main()
