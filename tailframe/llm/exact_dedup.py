"""Exact dedup against immutable snapshots, screened by static binary-fuse filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, gated, join_groups, materialize

#: Keys that one filter holds, about; a snapshot has as many filters as that needs.
FILTER_KEYS = 50_000
SEGMENT, ARITY = 1 << 12, 3


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _slots(h: np.ndarray, segments: int, length: int) -> np.ndarray:
    """Three places in consecutive segments, which is what makes the filter 'fused'."""
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    base = first * np.uint64(length)
    mask = np.uint64(length - 1)
    return np.stack([base + (h & mask), base + np.uint64(length) + ((h >> np.uint64(18)) & mask), base + np.uint64(2 * length) + ((h >> np.uint64(36)) & mask)]).astype(np.int64)


def _print8(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29)) ^ (h >> np.uint64(47))) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> bytes:
    """A three-wise binary-fuse filter with 8-bit prints of distinct uint64 keys.

    Layout: seed, segments, segment length (uint32 each), then the table. Peeling takes rounds of all
    slots with one key left; a seed whose graph does not peel is replaced by the next.
    """
    keys = np.unique(np.asarray(keys, dtype=np.uint64))
    n = len(keys)
    length = 8
    while length < SEGMENT and length * 48 < n:
        length *= 2
    for seed in range(1, 200):
        size = int(n * (1.2 + 0.02 * (seed // 4))) + 2 * length
        segments = max(1, -(-size // length) - (ARITY - 1))
        h = _mix(keys, seed)
        at = _slots(h, segments, length)
        slots = (segments + ARITY - 1) * length
        count = np.bincount(at.ravel(), minlength=slots)
        index = np.zeros(slots, dtype=np.int64)
        for row in at:
            np.bitwise_xor.at(index, row, np.arange(n))
        order, owner, left = [], [], np.ones(n, dtype=bool)
        while True:
            single = np.flatnonzero(count == 1)
            if not len(single):
                break
            key, where = np.unique(index[single], return_index=True)
            single = single[where]
            order.append(key)
            owner.append(single)
            left[key] = False
            for row in at[:, key]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(index, row, key)
        if left.any():
            continue
        table, prints = np.zeros(slots, dtype=np.uint8), _print8(h)
        for key, place in zip(reversed(order), reversed(owner), strict=True):
            three = at[:, key]
            table[place] = 0
            value = prints[key] ^ table[three[0]] ^ table[three[1]] ^ table[three[2]]
            table[place] = value
        return np.array([seed, segments, length], dtype="<u4").tobytes() + table.tobytes()
    raise RuntimeError(f"no seed peels {n} keys")


def probe_filter(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """True for every key that is in the filter, and for about 1 in 256 others."""
    seed, segments, length = (int(x) for x in np.frombuffer(blob[:12], dtype="<u4"))
    table = np.frombuffer(blob, dtype=np.uint8, offset=12)
    h = _mix(np.asarray(keys, dtype=np.uint64), seed)
    a, b, c = _slots(h, segments, length)
    return (table[a] ^ table[b] ^ table[c]) == _print8(h)


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def digests(docs: DataFrame, key: str, text: str, batches: int) -> DataFrame:
    """k, rid, n_cp, digest, and the batch in which the row arrives. Texts are read once."""
    body = F.coalesce(docs[text], F.lit(""))
    rid = F.monotonically_increasing_id()
    d = docs.select(docs[key].alias("k"), rid.alias("rid"), F.char_length(body).cast("long").alias("n_cp"), F.sha2(normalised(docs[text]), 256).alias("digest"))
    return d.withColumn("batch", F.pmod(F.xxhash64("k"), F.lit(batches)).cast("int"))


def group_batch(rows: DataFrame) -> DataFrame:
    """The batch's own duplicates: one row per digest with its size, the row that stays and any member."""
    first = F.min(F.struct((-F.col("n_cp")).alias("a"), F.col("k").isNull().alias("n"), F.col("k").alias("k"), F.col("rid").alias("rid")))
    return rows.groupBy("digest").agg(F.count("*").alias("n"), first.alias("best"))


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def snapshot_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """bucket, filter: one filter for the digests of each bucket of an immutable snapshot."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        keys = np.array([int(x[8:24], 16) for x in part["digest"]], dtype=np.uint64)
        return pd.DataFrame({"bucket": [int(part["bucket"].iloc[0])], "filter": [build_filter(keys)]})

    return groups.select(bucket_of(buckets).alias("bucket"), "digest").groupBy("bucket").applyInPandas(build, "bucket int, filter binary")


def screen(incoming: DataFrame, filters: DataFrame, buckets: int, count: int) -> DataFrame:
    """The ``count`` incoming digests that a snapshot's filters may hold. Bucket by bucket: digests are
    distinct and hashed, so buckets are even whatever the texts repeat. A batch larger than the snapshot cuts each
    bucket into parts that get a copy of its filter, so no task gets more than about FILTER_KEYS of either side."""

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"digest": pd.Series([], dtype=str)})
        keys = np.array([int(x[8:24], 16) for x in left["digest"]], dtype=np.uint64)
        return pd.DataFrame({"digest": left["digest"][probe_filter(bytes(right["filter"].iloc[0]), keys)]})

    parts = max(1, -(-count // (buckets * FILTER_KEYS)))
    part = F.pmod(F.conv(F.substring("digest", 25, 8), 16, 10).cast("long"), F.lit(parts)).cast("int")
    left = incoming.select(bucket_of(buckets).alias("bucket"), part.alias("part"), "digest").groupBy("bucket", "part")
    right = filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("bucket", "part")
    return left.cogroup(right).applyInPandas(probe, "digest string")


def buckets_for(count: int) -> int:
    return max(1, -(-count // FILTER_KEYS))


def write_snapshot(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Stores docs as an immutable snapshot for later batches: one row for each distinct text (digest, the key that stays, the
    text without white space) under ``path``/texts, and the filters of its digests under ``path``/filters.

    Null text is empty. Nothing is overwritten: an existing path is an error.
    """
    rows = materialize(digests(docs, key, text, 1), "digests")
    own = materialize(group_batch(rows).select("digest", F.col("best.k").alias("k")), "batch")
    source = docs.select(docs[key].alias("dk"), docs[text].alias("x")).join(gated(own), F.col("dk").eqNullSafe(F.col("k")))
    body = source.select("digest", "k", normalised(F.col("x")).alias("x")).where(F.sha2("x", 256) == F.col("digest"))
    body.groupBy("digest").agg(F.first("k").alias("k"), F.min("x").alias("x")).write.parquet(f"{path}/texts")
    snapshot_filters(own, buckets_for(own.count())).write.parquet(f"{path}/filters")


def against_snapshot(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text_sha256, seen, seen_id of every row: whether a stored snapshot has the same text, and under which key.

    The batch's own duplicates are grouped first; the distinct digests are screened by the snapshot's filters, positives join
    its exact digests, and texts that meet are compared byte for byte. An empty batch gives no rows, an empty snapshot has seen nothing.
    """
    spark = docs.sparkSession
    texts, filters = spark.read.parquet(f"{path}/texts"), spark.read.parquet(f"{path}/filters")
    known = texts.count()
    rows = materialize(digests(docs, key, text, 1), "digests")
    own = materialize(group_batch(rows), "batch")
    met = own.where("false").select("digest", F.lit(None).cast(texts.schema["k"].dataType).alias("seen_id"))
    if known:
        maybe = materialize(screen(own.select("digest"), filters, buckets_for(known), own.count()), "maybe")
        near = materialize(own.join(maybe, "digest", "left_semi").select("digest", F.col("best.k").alias("k")), "near")
        source = docs.select(docs[key].alias("dk"), docs[text].alias("y")).join(gated(near), F.col("dk").eqNullSafe(F.col("k"))).select("digest", normalised(F.col("y")).alias("y"))
        met = source.join(texts, "digest").where(F.col("x") == F.col("y")).groupBy("digest").agg(F.first("k").alias("seen_id"))
    met = materialize(met.withColumn("seen", F.lit(True)).join(own.select("digest", "n"), "digest"), "met")
    out = join_groups(rows.select("k", "digest"), met, ["digest"], "n", rows.count())
    return out.select(F.col("k").alias(key), F.col("digest").alias("text_sha256"), F.coalesce("seen", F.lit(False)).alias("seen"), "seen_id")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = 2) -> DataFrame:
    """``grouped`` as the contract names its columns: key, keep_id, group_size, kept, text_sha256."""
    return grouped(docs, key, text, batches).drop("n_cp")


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = 2) -> DataFrame:
    """Groups texts that are identical without ASCII white space and names the row that stays.

    Rows arrive in ``batches`` (by a hash of the key). Each batch groups its own duplicates, then its
    distinct digests are screened by the binary-fuse filters of the snapshots before it. Positives join the
    snapshot's exact digests; of those that meet, the two texts are compared byte for byte, and only equal
    ones join a group. The batch then becomes a snapshot of its own and is never changed.

    Of equal texts the row with the most code points in the original text stays, then the smallest key
    (a null key comes last). Null text counts as empty, and empty texts are equal to each other. A row that
    is repeated, key and all, is a member each time; exactly one copy is kept. Columns: key, keep_id,
    group_size, kept, text_sha256, n_cp (code points of the original text). Other columns are ignored. An empty table gives no rows.
    """
    rows = materialize(digests(docs, key, text, batches), "digests")
    groups = None  # digest, side (batch), n, best
    links = None
    snapshots: list[tuple[int, DataFrame, DataFrame, int]] = []  # those that hold anything
    for b in range(batches):
        own = materialize(group_batch(rows.where(F.col("batch") == b)), "batch")
        count = own.count()
        for sb, sown, filters, buckets in snapshots if count else ():
            maybe = screen(own, filters, buckets, count)
            met = own.join(maybe, "digest", "left_semi").join(sown.select("digest", F.col("best").alias("old")), "digest")
            met = materialize(met.select("digest", F.col("best.k").alias("k1"), F.col("old.k").alias("k0")), "met")
            pair = same_bytes(docs, key, text, met).select("digest", F.lit(b).alias("b1"), F.lit(sb).alias("b0"))
            links = pair if links is None else links.union(pair)
        if count and b + 1 < batches:
            filters = materialize(snapshot_filters(own, buckets_for(count)), "filters")
            snapshots.append((b, own, filters, buckets_for(count)))
        mine = own.withColumn("batch", F.lit(b))
        groups = mine if groups is None else groups.union(mine)
    # The class of a batch's group is the first batch with equal bytes; only groups of several rows are kept apart.
    cls = F.col("batch")
    if links is not None:
        first = materialize(links.groupBy("digest", F.col("b1").alias("batch")).agg(F.min("b0").alias("b0")), "links")
        groups, cls = groups.join(first, ["digest", "batch"], "left"), F.coalesce("b0", "batch")
    groups = groups.withColumn("cls", cls).select("digest", "batch", "n", "best", "cls")
    merged = groups.groupBy("digest", "cls").agg(F.sum("n").alias("group_size"), F.min("best").alias("best"), F.collect_list("batch").alias("in"))  # at most one for each batch
    merged = merged.where("group_size > 1").select("digest", F.explode("in").alias("batch"), "group_size", F.col("best.k").alias("keep"), F.col("best.rid").alias("keep_rid"))
    merged = materialize(merged, "groups")
    out = join_groups(rows, merged.withColumn("_size", F.col("group_size")), ["digest", "batch"], "_size", rows.count())
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("k")).otherwise(F.col("keep"))
    return out.select(F.col("k").alias(key), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"), F.col("digest").alias("text_sha256"), "n_cp")


def same_bytes(docs: DataFrame, key: str, text: str, met: DataFrame) -> DataFrame:
    """The digests of ``met`` whose two texts, named by k0 and k1, are the same bytes."""
    wanted = materialize(met.select("digest", F.explode(F.array("k0", "k1")).alias("k")).distinct(), "wanted")
    wanted = gated(wanted)
    source = docs.select(docs[key].alias("dk"), docs[text].alias("x"))
    texts = source.join(wanted, source.dk.eqNullSafe(F.col("k"))).select("digest", normalised(F.col("x")).alias("x"))
    texts = texts.where(F.sha2("x", 256) == F.col("digest"))  # of rows that share a key, the one that was meant
    return texts.groupBy("digest").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo = hi").select("digest")


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    Where keys repeat, a row is told by its text without white space and by its length too, so of rows that share a key the longest stays; of rows that are alike
    in all three one does.
    """
    out = materialize(grouped(docs, key, text), "kept")
    kept = out.where("kept").select(F.col(key).alias("_kept_key"), F.col("text_sha256").alias("_kept_sha"), F.col("n_cp").alias("_kept_n"))
    n = out.agg(F.count("*").alias("n"), F.count_distinct(key).alias("d")).first()
    if n["n"] == n["d"]:  # texts are shuffled only where the kept keys are too many to broadcast
        keys = gated(materialize(kept.select("_kept_key"), "keys"))
        return docs.join(keys, docs[key].eqNullSafe(keys["_kept_key"]), "left_semi")
    sha, size = F.sha2(normalised(docs[text]), 256), F.char_length(F.coalesce(docs[text], F.lit("")))
    rows = docs.join(kept, docs[key].eqNullSafe(kept["_kept_key"]) & (sha == kept["_kept_sha"]) & (size == kept["_kept_n"]), "left_semi")
    return rows.withColumn("_sha", sha).dropDuplicates([key, "_sha"]).drop("_sha")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n_cp DESC, doc_id)
"""
