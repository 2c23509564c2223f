"""Price panels: long (session_date, asset, price), read from market files or derived from order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_market(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Long market data: session_date, asset, field, value."""
    schema = "session_date DATE, asset STRING, field STRING, value DOUBLE"
    return spark.read.schema(schema).option("header", True).format(fmt).load(path)


def extract_field(market: DataFrame, field: str) -> DataFrame:
    """One price field of the market data as a price panel."""
    return market.where(F.col("field") == field).select("session_date", "asset", F.col("value").alias("price"))


def line_prices(spark: SparkSession, sf_dir: str, grain: str = "day") -> DataFrame:
    """Unit prices of order lines by return flag and ship date. Sums are decimal, so they don't depend on row order."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day = F.to_date("l_shipdate") if grain == "day" else F.to_date(F.date_trunc(grain, "l_shipdate"))
    paid = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    units = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double")
    return line.groupBy(day.alias("session_date"), F.col("l_returnflag").alias("asset")).agg((paid / units).alias("price"))


def market_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines as long market data: unit price and volume of each return flag and ship date."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    paid, units = (F.sum(F.col(c).cast("decimal(18,2)")).cast("double") for c in ("l_extendedprice", "l_quantity"))
    day = line.groupBy(F.to_date("l_shipdate").alias("session_date"), F.col("l_returnflag").alias("asset")).agg((paid / units).alias("Adj Close"), units.alias("Volume"))
    return day.unpivot(["session_date", "asset"], ["Adj Close", "Volume"], "field", "value")


def line_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flag, loss, times: what an order line gives away, its discount less its tax, counted as often as it has units. Exact, as decimals."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rate = F.col("l_discount").cast("decimal(4,2)") - F.col("l_tax").cast("decimal(4,2)")
    return line.select(F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice").cast("decimal(18,2)") * rate).cast("double").alias("loss"), F.col("l_quantity").cast("long").alias("times"))


def segment_prices(spark: SparkSession, sf_dir: str, grain: str = "week") -> DataFrame:
    """A second panel, with gaps: mean order value by market segment."""
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    day = F.to_date(F.date_trunc(grain, "o_orderdate"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return joined.groupBy(day.alias("session_date"), F.col("c_mktsegment").alias("asset")).agg((total / F.count("*")).alias("price"))


def complete_sessions(prices: DataFrame) -> DataFrame:
    """Prices of the sessions in which every asset of the panel has one."""
    seen = prices.where("price is not null")
    assets = seen.agg(F.count_distinct("asset").alias("assets"))
    full = seen.groupBy("session_date").agg(F.count_distinct("asset").alias("n")).join(F.broadcast(assets), F.col("n") == F.col("assets"))  # one row
    return seen.join(full.select("session_date"), "session_date", "left_semi")
