"""VaR and ES of plain, weighted loss tables of any length: exact selection by counts, narrowed in rounds.

No group of losses meets in one task, and no loss is moved before it lies in a narrow bracket: a round counts the rows of rank buckets, which combine
before the shuffle, and keeps of each group and level the one bucket that holds the wanted rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tailframe.sources import store

from .contracts import guarded
from .schedule import LEVELS, check_levels

#: Buckets of a round, losses of a bracket that is read as it is, and rounds until a bracket is as narrow as doubles are.
BUCKETS, EXACT, ROUNDS = 4096, 20_000, 16


def rank_scale(loss: Column) -> Column:
    """A scale that rises with the loss and on which losses of all magnitudes can be cut into buckets of equal width."""
    return F.signum(loss) * F.log1p(F.abs(loss))


def met(rows: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows with what is known of their group, a row for each level. Brackets are broadcast while they are measured to be few; else groups are met by
    a join that adaptive execution splits where a group is hot."""
    if not by:
        return rows.crossJoin(F.broadcast(found))  # a row for each level
    keys = found.select(*(F.col(c).alias(f"_{c}") for c in by), *(c for c in found.columns if c not in by))
    cond = [rows[c].eqNullSafe(F.col(f"_{c}")) for c in by]
    return rows.join(store.sized(keys), cond, "inner").drop(*(f"_{c}" for c in by))


def narrowed(rows: DataFrame, open_: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each open bracket (low, high, below, k) cut to the bucket that holds rank k, with the rows in it."""
    place = (F.col("_s") - F.col("low")) / (F.col("high") - F.col("low")) * BUCKETS
    inside = met(rows, open_, by).where(F.col("_s").between(F.col("low"), F.col("high")))
    keys = [*by, "level_bp"]
    counts = inside.groupBy(*keys, F.least(F.lit(BUCKETS - 1), F.floor(place).cast("int")).alias("bucket")).agg(
        F.sum("_t").alias("inside"), F.min("_s").alias("low"), F.max("_s").alias("high"), *(F.first(c).alias(c) for c in ("below", "k", "confidence_level", "n"))
    )
    run = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)  # BUCKETS rows at most
    counts = counts.withColumn("upto", F.col("below") + F.sum("inside").over(run))
    return counts.where((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("inside"))).select(*keys, "confidence_level", "n", "k", "low", "high", (F.col("upto") - F.col("inside")).alias("below"), "inside")


def tail_risk(losses: DataFrame, levels: Sequence[float] = LEVELS, by: Sequence[str] = (), loss: str = "loss", times: str | None = None) -> DataFrame:
    """by, level_bp, confidence_level, observation_count, tail_count, value_at_risk, expected_shortfall of each group of losses.

    VaR is the quantile that is linear between order statistics, at (n - 1) * level; ES the mean of the losses of at least the VaR, ties at it among
    them. ``times``: a column that says how often each loss counts (0 or null: not at all; negative: an error). A missing or infinite loss fails the job. Keys may be null. An empty table gives no rows.
    ``losses`` is read some three to six times; store it if it is dear.
    """
    check_levels(levels)
    spark = losses.sparkSession
    x = F.col(loss)
    sound = guarded(F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)), x.cast("double"), "a loss is missing or not finite")
    often = F.lit(1).cast("long") if times is None else guarded(F.coalesce(F.col(times) >= 0, F.lit(True)), F.coalesce(F.col(times).cast("long"), F.lit(0)), "a loss counts a negative number of times")
    rows = losses.select(*by, sound.alias("_x"), often.alias("_t")).where("_t > 0").withColumn("_s", rank_scale(F.col("_x")))
    wanted = spark.createDataFrame([(round(v * 10000), float(v)) for v in levels], "level_bp int, confidence_level double")
    whole = rows.groupBy(*by).agg(F.sum("_t").alias("n"), F.min("_s").alias("low"), F.max("_s").alias("high")).where("n > 0")
    brackets = whole.crossJoin(F.broadcast(wanted)).withColumns({"k": F.floor((F.col("n") - 1) * F.col("confidence_level")).cast("long"), "below": F.lit(0).cast("long"), "inside": F.col("n")})
    names = [*by, "level_bp", "confidence_level", "n", "k", "low", "high", "below", "inside"]
    brackets = store.working_table(brackets.select(*names), "brackets")
    wide = (F.col("inside") > EXACT) & (F.col("low") < F.col("high"))
    for _ in range(ROUNDS):
        if brackets.where(wide).limit(1).count() == 0:
            break
        brackets = store.working_table(narrowed(rows, brackets.where(wide), by).select(*names).unionByName(brackets.where(~wide)), "brackets")
    keys = [*by, "level_bp"]
    last = met(rows, brackets, by).where(F.col("_s").between(F.col("low"), F.col("high")))
    last = last.groupBy(*keys, "_x").agg(F.sum("_t").alias("c"), *(F.first(f).alias(f) for f in ("n", "k", "below", "confidence_level")))
    run = W.partitionBy(*keys).orderBy("_x").rowsBetween(W.unboundedPreceding, 0)  # the distinct losses of a bracket
    at = last.withColumn("upto", F.col("below") + F.sum("c").over(run)).where((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("c")))
    at = store.working_table(at.select(*keys, "confidence_level", "n", "k", "upto", F.col("_x").alias("a")), "ranks")
    above = F.col("_x") > F.col("a")
    ends = met(rows, at, by).where(F.col("_x") >= F.col("a")).groupBy(*keys).agg(
        *(F.first(c).alias(c) for c in ("confidence_level", "n", "k", "upto", "a")), F.min(F.when(above, F.col("_x"))).alias("next"),
        F.sum(F.when(above, F.col("_x") * F.col("_t"))).alias("sum_above"), F.sum(F.when(above, F.col("_t"))).alias("n_above"), F.sum(F.when(~above, F.col("_t"))).alias("n_at"),
    )
    b = F.when(F.col("upto") > F.col("k") + 1, F.col("a")).otherwise(F.coalesce("next", "a"))
    rest = (F.col("n") - 1) * F.col("confidence_level") - F.col("k")
    var = F.when(F.col("a") == b, F.col("a")).otherwise(F.col("a") + (b - F.col("a")) * rest)
    ends = ends.withColumn("value_at_risk", var)
    ties = F.col("value_at_risk") <= F.col("a")
    count = F.coalesce("n_above", F.lit(0)) + F.when(ties, F.col("n_at")).otherwise(F.lit(0))
    total = F.coalesce("sum_above", F.lit(0.0)) + F.when(ties, F.col("n_at") * F.col("a")).otherwise(F.lit(0.0))
    return ends.select(*keys, "confidence_level", F.col("n").alias("observation_count"), count.alias("tail_count"), "value_at_risk", (total / count).alias("expected_shortfall"))
