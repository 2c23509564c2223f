"""Data contracts: one aggregation of rule violations per table, raised on the driver."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

TOLERANCE = 1e-12


class ContractError(ValueError):
    """A table breaks one or more rules."""


def violations(df: DataFrame, rules: Mapping[str, Column]) -> dict[str, int]:
    """How many rows break each rule (true: broken; unknown counts as broken), in one pass."""
    row = df.agg(*(F.count_if(F.coalesce(c, F.lit(True))).alias(f"r{n}") for n, c in enumerate(rules.values()))).first()
    return {name: row[n] for n, name in enumerate(rules) if row[n]}


def enforce(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    broken = violations(df, rules)
    if broken:
        raise ContractError("; ".join(f"{name}: {n} rows" for name, n in broken.items()))
    return df


def guarded(ok: Column, value: Column, message: str) -> Column:
    """The value where ``ok`` holds; a row where it does not fails the job, so nothing is dropped in silence."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def finite(name: str) -> Column:
    c = F.col(name)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ContractError(f"{', '.join(keys)} repeats")
    return df


def require_values(df: DataFrame, column: str, wanted: Iterable[str]) -> DataFrame:
    """Every wanted value occurs (tickers, fields)."""
    want = df.sparkSession.createDataFrame([(w,) for w in wanted], f"`{column}` string")
    missing = [r[0] for r in want.join(df.select(column).distinct(), column, "left_anti").collect()]  # at most the wanted ones
    if missing:
        raise ContractError(f"{column} lacks {sorted(missing)}")
    return df


def check_prices(prices: DataFrame, column: str = "price") -> DataFrame:
    """Missing prices are allowed; observed ones are finite and positive."""
    c = F.col(column)
    return enforce(prices, {"price is not positive and finite": c.isNotNull() & (F.isnan(c) | (c <= 0) | (c == float("inf")))})


def check_market(market: DataFrame, assets: Iterable[str], fields: Iterable[str], price_fields: Sequence[str]) -> DataFrame:
    """Assets and fields are there, dates are unique by asset and field, prices are positive."""
    require_values(market, "asset", assets)
    require_values(market, "field", fields)
    require_unique(market, ["session_date", "asset", "field"])
    enforce(market, {"session_date is missing": F.col("session_date").isNull()})
    check_prices(market.where(F.col("field").isin(*price_fields)), "value")
    return market


def check_returns(returns: DataFrame) -> DataFrame:
    """For a portfolio: no return is missing, infinite or below -1."""
    return enforce(require_unique(returns, ["session_date", "asset"]), {"return is not finite": ~finite("ret"), "return is below -1": F.col("ret") < -1})


def check_weights(targets: DataFrame) -> DataFrame:
    """Long only, with a sum of at most 1; the rest is cash."""
    enforce(require_unique(targets, ["asset"]), {"weight is not finite": ~finite("weight"), "weight is negative": F.col("weight") < 0})
    total = targets.agg(F.sum("weight")).first()[0] or 0.0
    if total > 1 + TOLERANCE:
        raise ContractError(f"weights sum to {total}")
    return targets


def check_same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> None:
    """Both tables have the same keys, once each."""
    both = require_unique(a, keys).select(*keys, F.lit(1).alias("_a")).join(require_unique(b, keys).select(*keys, F.lit(1).alias("_b")), list(keys), "full")
    n = both.where("_a is null or _b is null").count()
    if n:
        raise ContractError(f"{n} rows of {', '.join(keys)} are in one table only")


def check_alignment(daily: DataFrame, weights: DataFrame) -> None:
    """Every day of a portfolio has weights of every asset, and no other day has any."""
    assets = weights.select("asset").distinct().count()
    n = weights.groupBy("session_date").agg(F.count_distinct("asset").alias("n"), F.count("*").alias("rows"))
    if not n.where((F.col("n") != assets) | (F.col("rows") != assets)).isEmpty():
        raise ContractError("a day lacks weights of some asset, or repeats them")
    check_same_keys(daily.select("session_date"), n.select("session_date"), ["session_date"])


def outcome_rules(levels: Sequence[float]) -> dict[str, Column]:
    """What a forecast and the schedule's facts for its date (s0, s1, sr) can break, by rule."""
    return {
        "date or window is not the schedule's": F.col("s0").isNull() | ~F.col("estimation_start_date").eqNullSafe(F.col("s0")) | ~F.col("estimation_end_date").eqNullSafe(F.col("s1")),
        "window reaches the forecast date": F.col("estimation_end_date") >= F.col("forecast_date"),
        "level is unknown": ~F.col("confidence_level").isin(*levels),
        "number is not finite": ~(finite("realized_return") & finite("realized_loss") & finite("value_at_risk") & finite("expected_shortfall")),
        "outcome is not the schedule's": F.abs(F.col("realized_return") - F.col("sr")) > 1e-15 + TOLERANCE * F.abs("sr"),
        "loss is not minus return": F.col("realized_loss") != -F.col("realized_return"),
        "ES is below VaR": F.col("expected_shortfall") < F.col("value_at_risk") - TOLERANCE,
        "flag does not match": F.col("var_exceedance") != (F.col("realized_loss") > F.col("value_at_risk")),
    }


#: Rules of ``outcome_rules`` that a forecast can be held to by itself.
ALONE = ("window reaches the forecast date", "number is not finite", "loss is not minus return", "ES is below VaR", "flag does not match")


def forecast_rules(levels: Sequence[float]) -> dict[str, Column]:
    """What is wrong with a row of ``forecast_grid_rows``, by rule; unknown counts as broken."""
    there, own = F.col("_rows") > 0, outcome_rules(levels)
    return {"forecast is missing": F.col("_rows") == 0, "model, date and level repeat": F.col("_rows") > 1, **{name: there & F.coalesce(c, F.lit(True)) for name, c in own.items()}}


def forecast_grid_rows(f: DataFrame, schedule: DataFrame, levels: Sequence[float]) -> DataFrame:
    """A row for each model, date and level that the schedule asks for or that is there, with the number of its forecasts (``_rows``) and the schedule's facts (s0, s1, sr).

    One grouping of the forecasts and one join with a grid of some rows a date.
    """
    key = ["model", "forecast_date", "level_bp"]
    rest = ["confidence_level", "estimation_start_date", "estimation_end_date", "realized_return", "realized_loss", "value_at_risk", "expected_shortfall", "var_exceedance"]
    one = f.groupBy(*key).agg(F.count("*").alias("_rows"), *(F.first(c).alias(c) for c in rest))
    s = schedule.select("forecast_date", F.col("estimation_start_date").alias("s0"), F.col("estimation_end_date").alias("s1"), F.col("realized_return").alias("sr"))
    wanted = f.sparkSession.createDataFrame([(round(x * 10000),) for x in levels], "level_bp int")
    grid = s.crossJoin(F.broadcast(wanted)).crossJoin(F.broadcast(f.select("model").distinct()))  # a row for each level, for each model
    out = one.join(grid.select(*key, F.lit(True).alias("_due")), key, "full").join(F.broadcast(s), "forecast_date", "left")  # a row for each session
    return out.withColumn("_rows", F.coalesce("_rows", F.lit(0)))


def rule_counts(f: DataFrame, schedule: DataFrame, levels: Sequence[float]) -> DataFrame:
    """rule, rows_checked, rows_broken of all forecast rules, in one pass."""
    rules = forecast_rules(levels)
    counts = forecast_grid_rows(f, schedule, levels).agg(F.count("*").alias("n"), *(F.count_if(c).alias(f"r{i}") for i, c in enumerate(rules.values())))
    pairs = F.array(*(F.struct(F.lit(name).alias("rule"), F.col("n").alias("rows_checked"), F.col(f"r{i}").alias("rows_broken")) for i, name in enumerate(rules)))
    return counts.select(F.explode(pairs).alias("x")).select("x.*")


def check_forecasts(f: DataFrame, schedule: DataFrame, levels: Sequence[float]) -> DataFrame:
    """A complete grid of schedule dates and levels without look-ahead, with consistent outcomes, flags and ES >= VaR: all rules in one job."""
    broken = {r["rule"]: r["rows_broken"] for r in rule_counts(f, schedule, levels).collect() if r["rows_broken"]}  # a row for each rule
    if broken:
        raise ContractError("; ".join(f"{name}: {n} rows" for name, n in broken.items()))
    return f


class Watched:
    """Rules that are counted while a table is written: ``table`` goes to the writer, ``enforce`` raises what was broken once it is written."""

    def __init__(self, df: DataFrame, rules: Mapping[str, Column]):
        self.names, self.seen = list(rules), Observation()
        self.table = df.observe(self.seen, *(F.count_if(F.coalesce(c, F.lit(True))).alias(f"r{n}") for n, c in enumerate(rules.values())))

    def broken(self) -> dict[str, int]:
        found = self.seen.get
        return {name: found[f"r{n}"] for n, name in enumerate(self.names) if found[f"r{n}"]}

    def enforce(self) -> None:
        if broken := self.broken():
            raise ContractError("; ".join(f"{name}: {n} rows" for name, n in broken.items()))


def row_rules() -> dict[str, Column]:
    """The forecast rules that a row alone can break."""
    return {name: c for name, c in outcome_rules([]).items() if name in ALONE}


def check_common_dates(f: DataFrame) -> DataFrame:
    """All models share dates, levels and realised losses."""
    models = f.select("model").distinct().count()
    spread = F.max("realized_loss") - F.min("realized_loss")
    bad = f.groupBy("forecast_date").agg(F.count_distinct("model").alias("m"), spread.alias("d"), F.max(F.abs("realized_loss")).alias("a"), F.count("*").alias("n"), F.count_distinct("level_bp").alias("l"))
    if not bad.where((F.col("m") != models) | (F.col("n") != F.col("m") * F.col("l")) | (F.col("d") > 1e-15 + TOLERANCE * F.col("a"))).isEmpty():
        raise ContractError("models differ in dates, levels or outcomes")
    return f


def check_comparisons(dm: DataFrame, models: int, levels: int, scores: int = 2) -> DataFrame:
    """The pairwise table is complete and its adjusted values lie between the raw ones and 1."""
    require_unique(dm, ["score_name", "level_bp", "model_a", "model_b"])
    if dm.count() != scores * levels * models * (models - 1) // 2:
        raise ContractError("the table of comparisons is not complete")
    return enforce(dm, {"p-value out of range": ~F.col("p_value").between(0, 1), "adjusted below raw": F.col("holm_p_value") < F.col("p_value") - TOLERANCE, "adjusted above 1": F.col("holm_p_value") > 1})
