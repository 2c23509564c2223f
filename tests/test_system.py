"""Snapshots, configuration, commands, streaming, and the driver's entry points."""

import os
import shutil
import subprocess
import sys
from datetime import UTC, date, datetime, timedelta
from pathlib import Path

import numpy as np
import pytest

from tailframe import cli
from tailframe.operators import contracts
from tailframe.sources import config, market, store
from tailframe.streaming import monitor

ROOT = Path(__file__).resolve().parents[1]
CONFIG = {
    "universe": {"assets": ["A", "B"]}, "period": {"start": date(2020, 1, 1), "end": date(2021, 1, 1)}, "portfolio": {"initial_value": 1000.0, "rebalance": "monthly", "transaction_cost_bps": 0},
    "estimation": {"window": 20, "confidence_levels": [0.95, 0.99]}, "ewma": {"decay": 0.94}, "simulation": {"scenarios": 500, "seed": 1, "reuse_shocks": True}, "quality": {"large_return": 0.1},
}


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    now = datetime(2026, 1, 1, tzinfo=UTC)
    base = store.save_snapshot(str(tmp_path), "one", {"t": df}, now, {"k": 1})
    assert sorted(map(tuple, store.load_snapshot(spark, base)["t"].collect())) == [(1, "a"), (2, None)]
    with pytest.raises(store.SnapshotError):
        store.save_snapshot(str(tmp_path), "one", {"t": df}, now)
    with pytest.raises(store.SnapshotError):
        store.save_snapshot(str(tmp_path), "two", {"t": df}, datetime(2026, 1, 1))
    with pytest.raises(store.SnapshotError):
        store.require_same_lineage([{"lineage": {"k": 1}}, {"lineage": {"k": 2}}], ["k"])
    part = next(Path(base, "t").glob("*.parquet"))
    assert store.file_sha256(str(part)) in store.checksums(spark, f"{base}/t").values()
    data = bytearray(part.read_bytes())  # one flipped byte inside the data pages, whatever the file holds
    data[8] ^= 0xFF
    part.write_bytes(bytes(data))
    for crc in Path(base, "t").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(store.SnapshotError):
        store.load_snapshot(spark, base)


@pytest.mark.parametrize("parts", [1, 4, 8])
def test_snapshots_of_any_partitions(spark, tmp_path, parts):
    """A row taken away is found out, wherever the rows lie."""
    df = spark.range(50).repartition(parts)
    base = store.save_snapshot(str(tmp_path), "one", {"t": df}, datetime(2026, 1, 1, tzinfo=UTC))
    assert store.load_snapshot(spark, base)["t"].count() == 50
    other = store.save_snapshot(str(tmp_path), "two", {"t": df.where("id <> 7")}, datetime(2026, 1, 1, tzinfo=UTC))
    shutil.rmtree(f"{base}/t")
    shutil.copytree(f"{other}/t", f"{base}/t")
    with pytest.raises(store.SnapshotError):
        store.load_snapshot(spark, base)


def test_stages_follow_their_input(spark, tmp_path):
    """A stored stage is read again while its input stays, and made anew when the input changes or the table is gone."""
    def make():
        made.append(1)
        return spark.read.parquet(f"{tmp_path}/in.parquet")

    made = []
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/in.parquet")
    for _ in range(2):
        assert store.stage(spark, str(tmp_path), "s", ["in"], make).count() == 3
    assert len(made) == 1
    spark.range(5).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in.parquet")
    table = store.stage(spark, str(tmp_path), "s", ["in"], make)
    assert table.count() == 5 and len(made) == 2
    shutil.rmtree(table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])
    assert store.stage(spark, str(tmp_path), "s", ["in"], make).count() == 5 and len(made) == 3


def test_config():
    c = config.require_runnable(config.parse(CONFIG))
    assert c.levels == (0.95, 0.99) and c.window == 20
    for section, key, bad in [("estimation", "window", True), ("estimation", "window", 1), ("estimation", "confidence_levels", [0.99, 0.95]), ("ewma", "decay", 1.0), ("simulation", "seed", 1.5), ("portfolio", "rebalance", "weekly"), ("portfolio", "initial_value", float("nan")), ("universe", "assets", ["A", "A"]), ("quality", "large_return", 0)]:
        with pytest.raises(config.ConfigError):
            config.parse({**CONFIG, section: {**CONFIG[section], key: bad}})
    with pytest.raises(config.ConfigError):
        config.parse({k: v for k, v in CONFIG.items() if k != "ewma"})
    for section, key, bad in [("portfolio", "transaction_cost_bps", 5), ("simulation", "reuse_shocks", False)]:
        with pytest.raises(config.ConfigError):
            config.require_runnable(config.parse({**CONFIG, section: {**CONFIG[section], key: bad}}))


def test_commands(spark, tmp_path):
    rng = np.random.default_rng(2)
    first = date(2020, 1, 1)
    rows = []
    for a in "AB":
        p = 100 * np.cumprod(1 + rng.normal(0, 0.02, 45))
        rows += [(first + timedelta(n), a, "Adj Close", float(x)) for n, x in enumerate(p)]
    spark.createDataFrame(rows, "session_date date, asset string, field string, value double").write.parquet(f"{tmp_path}/market")
    c, root = config.parse(CONFIG), str(tmp_path)
    tree = market.write_tree(spark.read.parquet(f"{tmp_path}/market"), f"{tmp_path}/tree")
    asked = {"start": "2020-01-05", "end": "2020-01-20", "assets": "B"}
    counts = [store.load_manifest(spark, cli.process_raw(spark, at, root, f"raw-{fmt}", fmt, fields=None, **asked))["facts"]["rows"] for at, fmt in ((f"{tmp_path}/market", "parquet"), (tree, market.NAME))]
    assert counts == [16, 16]
    returns = cli.process_returns(spark, c, f"{tmp_path}/market", root, "returns")
    path = cli.process_portfolio(spark, c, returns, root, "portfolio")
    tests = [cli.run_backtest(spark, c, returns, path, m, root, m) for m in ("rolling-gaussian", "ewma-gaussian", "filtered-historical")]
    assert store.load_snapshot(spark, tests[0])["forecasts"].count() == 48
    stress = [("s", "a stress", "2020-01-25", "2020-02-05")]
    for kind in ("coverage", "severity", "calibration", "accuracy", "traffic", "subperiods"):
        base = cli.run_report(spark, kind, tests, root, kind, stress=stress)
        assert store.load_snapshot(spark, base) and os.path.isdir(f"{base}/csv")
    assert store.load_snapshot(spark, f"{root}/accuracy")["comparisons"].count() == 12
    assert store.load_snapshot(spark, f"{root}/subperiods")["scores"].where("period_id = 's'").count() == 6
    plain = cli.run_report(spark, "accuracy", tests, root, "plain", bandwidth=0)
    out = store.load_snapshot(spark, cli.publish(spark, f"{root}/accuracy", plain, f"{root}/subperiods", root, "inference"))["inference"].toPandas()
    assert len(out) == 12 and (out["mean_difference"] - (out["model_mean"] - out["reference_mean"])).abs().max() < 1e-12
    with pytest.raises(store.SnapshotError):
        cli.publish(spark, plain, f"{root}/accuracy", f"{root}/subperiods", root, "wrong")
    for model in ("rolling-gaussian", "ewma-gaussian"):
        errors = store.load_snapshot(spark, cli.validate(spark, c, returns, path, f"{root}/{model}", root, f"{model}-errors"))["errors"]
        assert errors.count() == 4 and errors.where("max_absolute_error_bps > 100").isEmpty()
    with pytest.raises(store.SnapshotError):
        cli.validate(spark, c, returns, path, f"{root}/filtered-historical", root, "none")
    seen = store.load_snapshot(spark, cli.simulate(spark, c, returns, path, root, "losses"))
    assert seen["histogram"].count() == 90 and seen["marks"].where("expected_shortfall >= value_at_risk").count() == 2
    with pytest.raises(contracts.ContractError):
        cli.simulate(spark, c, returns, path, root, "never", "1999-01-01")
    with pytest.raises(config.ConfigError):
        cli.run_report(spark, "coverage", tests, root, "bad", significance=1.5)
    at = f"{root}/rolling-gaussian/manifest.json"  # a count that the data does not have
    text = Path(at).read_text()
    Path(f"{root}/rolling-gaussian/.manifest.json.crc").unlink()
    Path(at).write_text(text.replace('"dates": 24', '"dates": 25'))
    with pytest.raises(store.SnapshotError):
        cli.load_backtest(spark, f"{root}/rolling-gaussian")


def test_missing_price(spark, tmp_path):
    """A missing price leaves returns with gaps and complete ones without the two sessions that it spoils; the portfolio is made of these."""
    first = date(2020, 1, 1)
    rows = [(first + timedelta(n), a, "Adj Close", None if (a, n) == ("B", 10) else 100.0 + n) for a in "AB" for n in range(30)]
    spark.createDataFrame(rows, "session_date date, asset string, field string, value double").write.parquet(f"{tmp_path}/market")
    c, root = config.parse(CONFIG), str(tmp_path)
    at = cli.process_returns(spark, c, f"{tmp_path}/market", root, "returns")
    found = store.load_snapshot(spark, at)
    assert found["returns"].where("ret is null").count() == 2 and found["complete_returns"].count() == 2 * 27
    assert store.load_manifest(spark, at)["facts"]["complete"] == {"dates": 27, "first": "2020-01-02", "last": "2020-01-30"}
    assert cli.load_portfolio(spark, cli.process_portfolio(spark, c, at, root, "portfolio"))["daily"].count() == 27


def test_stream(spark, tmp_path):
    src, first = f"{tmp_path}/in", date(2020, 1, 1)
    schema = "model string, forecast_date date, level_bp int, var_exceedance boolean"
    data = [("m", first + timedelta(n), bp, n % 4 == 0) for n in range(30) for bp in (9500, 9900)]
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(src)
    stream = monitor.monitor(spark.readStream.schema(schema).parquet(src), window=20)
    q = stream.writeStream.format("memory").queryName("lights").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.sql("SELECT forecast_date, exception_count, zone FROM lights").collect()))
    assert len(got) == 11 and {g[1:] for g in got} == {(5, "amber")}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    """The flagship finishes, and neither it nor a headline query has a plan that grows out of hand."""
    import __spark_entry__ as e
    import bench

    df = e.entry(spark)
    out = df.collect()
    assert len(out) == 3 and all(r["observation_count"] > 100 for r in out)
    assert plan_of(df).count("Scan parquet") < 10 and plan_of(df).count("Exchange") < 20
    q = e.queries()
    assert set(e.oracle_sql()) <= set(q)
    assert q["asset_returns"](spark, "/root/testdata/sf0.01").count() == 7485
    for name in bench.HEADLINE:
        plan = plan_of(q[name](spark, "/root/testdata/sf0.01"))
        assert plan.count("Scan parquet") < 40 and plan.count("Exchange") < 60, name


def test_without_text_operators(tmp_path):
    """The library and its entry points work where the text operators' folder is gone."""
    for name in ("tailframe", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "tailframe/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'asset_returns' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests/test_golden.py", "-k", "test_special or test_returns or test_schedule"], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    for f in (ROOT / "tailframe").rglob("*.py"):
        if "llm" not in f.parts:
            assert "tailframe.llm" not in f.read_text()


def test_plans(spark):
    """Scans read the columns they need, and dimension tables alone are broadcast."""
    from tailframe.plans import catalog

    from tailframe.sources import panel

    plan = plan_of(panel.line_prices(spark, "/root/testdata/sf0.001"))
    assert "l_tax" not in plan and "l_comment" not in plan and "CartesianProduct" not in plan
    for name in ("binomial_reference_band", "fhs_multiplicity", "loss_histogram", "loss_marks"):
        assert catalog.queries()[name](spark, "/root/testdata/sf0.01").count() > 0


def test_scenarios(spark):
    """The catalogue's simulations draw the reference's 100,000 scenarios for each date."""
    from tailframe.plans import catalog

    q, d = catalog.queries(), "/root/testdata/sf0.01"
    assert sum(r["draws"] for r in q["fhs_multiplicity"](spark, d).collect()) == 100_000
    for name in ("gaussian_mc", "fhs_forecasts"):
        r = q[name](spark, d).where("level_bp = 9900").first()
        assert r["scenario_count"] == 100_000 and 1000 <= r["tail_scenario_count"] <= (1000 if name == "gaussian_mc" else 2000)


def test_all_periods(spark):
    """Ranks and exception rates have every period of the data, in the long tables and in the matrices."""
    from tailframe.plans import catalog

    q, d = catalog.queries(), "/root/testdata/sf0.01"
    want = {r["period_id"] for r in q["subperiod_definitions"](spark, d).collect()}
    years = {f"year_{r['y']}" for r in q["forecast_schedule"](spark, d).selectExpr("year(forecast_date) AS y").distinct().collect()}
    assert years == {p for p in want if p.startswith("year_")}
    for long, wide, value, key, have in (("rank_by_period", "rank_matrix", "rank", ("score_name", "level_bp", "model"), years), ("exception_rate_by_period", "exception_rate_matrix", "rate_gap", ("level_bp", "model"), want)):
        got = q[long](spark, d).collect()
        found = {(*(r[k] for k in key), r["period_id"]): r[value] for r in got}
        assert len(found) == len(got) and {r["period_id"] for r in got} == want and None not in found.values()
        for r in q[wide](spark, d).collect():
            assert set(r.asDict()) - set(key) == have
            for p in have:
                assert found[*(r[k] for k in key), p] == r[p]


def test_simulations_equal_numpy(spark):
    """Whole output of the simulated queries, which no SQL can draw, against plain numpy."""
    from tailframe.plans import catalog

    q, d = catalog.queries(), "/root/testdata/sf0.01"
    shocks = np.random.default_rng(catalog.SEED).standard_normal((catalog.SCENARIOS, 3))
    got = {}
    for name, decay in (("gaussian_mc", None), ("ewma_mc", catalog.DECAY)):
        got[name] = {(r["forecast_date"], r["level_bp"]): r for r in q[name](spark, d).collect()}
        dates = catalog.packed(spark, d, decay).collect()
        assert len(got[name]) == 3 * len(dates)
        for x in dates:
            cov = np.zeros((3, 3))
            cov[np.triu_indices(3)] = x["cov"]
            cov = cov + np.triu(cov, 1).T
            w = np.array(x["w"])
            losses = np.sort(-(w @ np.array(x["mu"]) + shocks @ (np.linalg.cholesky(cov).T @ w)))
            for level in (0.95, 0.975, 0.99):
                r, var = got[name][x["forecast_date"], round(level * 10000)], np.quantile(losses, level)
                tail = losses[np.searchsorted(losses, var) :]
                assert (r["value_at_risk"], r["expected_shortfall"], r["simulated_mean_return"], r["simulated_volatility"]) == pytest.approx((var, tail.mean(), -losses.mean(), losses.std(ddof=1)), abs=1e-7)
                assert r["tail_scenario_count"] == len(tail)
    exact = {(r["forecast_date"], r["level_bp"]): r for r in q["rolling_gaussian_multivariate"](spark, d).collect()}
    for r in q["mc_error_summary"](spark, d).collect():
        e = np.array([1e4 * (v[r["metric"]] - exact[k][r["metric"]]) for k, v in got["gaussian_mc"].items() if k[1] == r["level_bp"]])
        assert (r["bias_bps"], r["mean_absolute_error_bps"], r["median_absolute_error_bps"], r["p95_absolute_error_bps"], r["max_absolute_error_bps"]) == pytest.approx((e.mean(), *(f(np.abs(e)) for f in (np.mean, np.median, lambda a: np.quantile(a, 0.95), np.max))), abs=2e-3)
    last = max(k[0] for k in got["gaussian_mc"])
    bars, marks = q["loss_histogram"](spark, d).toPandas(), q["loss_marks"](spark, d).collect()
    assert len(bars) == 90 and (bars["density"] * (bars["right"] - bars["left"])).sum() == pytest.approx(1)
    for r in marks:
        assert (r["value_at_risk"], r["expected_shortfall"]) == pytest.approx((got["gaussian_mc"][last, r["level_bp"]]["value_at_risk"], got["gaussian_mc"][last, r["level_bp"]]["expected_shortfall"]), abs=1e-7)
