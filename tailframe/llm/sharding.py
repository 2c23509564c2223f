"""Contiguous shards of equal bytes, by global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prefix_sums

SHARDS = 16


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Puts each row into one of ``shards`` contiguous runs of the key order, near equal in bytes.

    A row's size is its text's UTF-8 bytes (null: none) plus 1, so every row counts. Partition
    totals give each row the bytes before it; the row goes where the middle of its bytes falls
    among ``shards`` equal targets. Columns: key, size, text_crc32 (null text as empty), shard, slot
    (gapless from 0 in a shard).

    Null keys come first. Rows with equal keys lie side by side, in any order when they are
    equal throughout. A text larger than a target fills its shard and may leave a neighbour empty. An
    empty table gives no rows. Other columns are ignored, whatever their names.
    """
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[key].alias("k"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("crc"))
    rows = materialize(rows, "sizes")  # the texts are read once
    placed = prefix_sums(rows, ["k", "crc", "size"], {"before": "size"})
    total = rows.agg(F.sum("size").alias("total"))
    placed = placed.crossJoin(F.broadcast(total))  # one row
    placed = placed.withColumn("shard", F.expr(f"cast(least({shards - 1}, ((before * 2 + size) * {shards}) div (2 * total)) as int)"))
    first = placed.groupBy("shard").agg(F.min("pos").alias("first"))  # one row for each shard
    out = placed.join(F.broadcast(first), "shard")
    return out.select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("pos") - F.col("first")).alias("slot"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = shard_by_bytes(docs)
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def crc_table() -> list[int]:
    """CRC-32 of every byte, from its polynomial: DuckDB has no such function."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


ORACLE_SQL = f"""
WITH t AS (SELECT CAST({crc_table()} AS BIGINT[]) AS crc),
d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
c AS (SELECT doc_id, strlen(x) + 1 AS size,
  xor(list_reduce(list_transform(regexp_extract_all(hex(x), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM d, t),
p AS (SELECT *, CAST(sum(size) OVER w AS BIGINT) - size AS before, CAST(sum(size) OVER () AS BIGINT) AS total FROM c WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CAST(least({SHARDS - 1}, ((before * 2 + size) * {SHARDS}) // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY before) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""
