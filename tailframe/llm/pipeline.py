"""A training corpus in four stages: toxicity, exact dedup, SimHash near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes it as Parquet in the shared folder
and reads it again as the next stage's docs. All but the last keep the columns of documents.

In every stage null text counts as empty, rows are told apart by their place and not by their id, so null and repeated ids lose nothing,
other columns pass through whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_shuffles, gated, materialize, scratch
from .exact_dedup import keep_one
from .packing import pack
from .simhash import near_dedup
from .toxicity import reject, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the network calls toxic. It is fitted on the labelled ones among docs; without labels of both kinds
    nothing is dropped. Empty texts stay, rows that repeat a text share its fate."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return reject(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of the texts that are equal without white space: the longest, then the smallest id (null ids last). Empty texts are equal to
    each other; of rows that repeat id and text one stays."""
    free_shuffles(spark)
    return keep_one(docs)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every component of near-duplicates, that with the smallest id (null ids last).

    Rows are told apart by a stored number, as ids can be null or repeated. Texts without words have one fingerprint and are a component.
    """
    free_shuffles(spark)
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    groups = near_dedup(rows.select(row.alias("doc"), "text"), key="doc")
    keep = materialize(groups.where("doc = component_id").select(F.col("doc.row").alias("_keep")), "keep")
    keep = gated(keep)  # texts are shuffled only where the kept numbers are too many to broadcast
    return rows.join(keep, rows["_row"] == keep["_keep"], "left_semi").drop("_row")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of what is left into sequences; one row per piece, with its ids. An empty text is its end token alone."""
    free_shuffles(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("simhash near-dedup", simhash), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the filters keep of ``documents``. A stage's working tables are deleted once its result is stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            docs = materialize(made, name.replace(" ", "-"), keep=True)
    return docs


#: No SQL says what a trained network rejects; the tests hold every stage against brute force.
ORACLE_SQL = None
