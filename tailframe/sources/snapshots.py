"""What is in raw market data: counts, gaps and bounds by field, by asset and of the whole table, in one pass."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def coverage(market: DataFrame) -> DataFrame:
    """scope, asset, field, rows, missing, sessions, gaps, first_date, last_date, lowest, highest of long market data.

    Scope is asset_field, asset, field or table. ``missing`` counts rows without a finite value; ``gaps`` the sessions of the scope's own span, among
    all sessions of the table, on which it has no row. One grouping over sets (asset and field; asset; field; none) after one over sessions, so a hot asset is combined before the shuffle.
    """
    known = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    days = market.select("session_date").distinct()
    numbered = days.selectExpr("session_date", "CAST(row_number() OVER (ORDER BY session_date) AS BIGINT) AS no")  # a row for each session
    cells = market.groupBy("session_date", "asset", "field").agg(F.count("*").alias("rows"), F.count_if(~known).alias("missing"), F.min(F.when(known, F.col("value"))).alias("low"), F.max(F.when(known, F.col("value"))).alias("high"))
    cells = cells.join(store.sized(numbered), "session_date")
    found = cells.groupingSets([["asset", "field"], ["asset"], ["field"], []], "asset", "field").agg(
        F.grouping_id("asset", "field").alias("g"), F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.count_distinct("no").alias("sessions"), (F.max("no") - F.min("no") + 1).alias("span"),
        F.min("session_date").alias("first_date"), F.max("session_date").alias("last_date"), F.min("low").alias("lowest"), F.max("high").alias("highest"),
    )
    scope = F.when(F.col("g") == 0, "asset_field").when(F.col("g") == 1, "asset").when(F.col("g") == 2, "field").otherwise("table")
    return found.where("rows > 0").select(scope.alias("scope"), "asset", "field", "rows", "missing", "sessions", (F.col("span") - F.col("sessions")).alias("gaps"), "first_date", "last_date", (F.round("lowest", 6) + 0.0).alias("lowest"), (F.round("highest", 6) + 0.0).alias("highest"))


def save_raw(root: str, snapshot_id: str, market: DataFrame, request: Mapping[str, Any], created_at: datetime | None = None) -> str:
    """Market data as an immutable snapshot with what was asked for and what came: two tables, prices and their coverage, and facts of the whole."""
    stored = store.working_table(market, "raw")
    seen = store.working_table(coverage(stored), "coverage")
    whole = seen.where("scope = 'table'").first()
    lists = seen.where("scope in ('asset', 'field')").orderBy("asset", "field").collect()  # a row for each asset and field
    facts = {
        "rows": whole["rows"] if whole else 0, "missing": whole["missing"] if whole else 0, "first": str(whole["first_date"]) if whole else None, "last": str(whole["last_date"]) if whole else None,
        "fields": {r["field"]: r["missing"] for r in lists if r["scope"] == "field"}, "assets": {r["asset"]: {"rows": r["rows"], "missing": r["missing"], "gaps": r["gaps"]} for r in lists if r["scope"] == "asset"},
    }
    return store.save_snapshot(root, snapshot_id, {"market": stored, "coverage": seen}, created_at or datetime.now(UTC), {"stage": "raw", "request": dict(request)}, facts=facts)
