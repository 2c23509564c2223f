"""SimHash near-dedup: fingerprints, pivot distance tables, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, join_groups, materialize, pair_tasks, task_runs, text_batches, unload

SHINGLE, SEED, BITS = 4, 42, 4
#: Reference fingerprints; the table has the distance of every fingerprint to each.
PIVOTS = 16
#: Fingerprints of one cell that are compared in one task; texts that a worker holds as Python strings at once.
BLOCK, TEXTS = 2048, 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of one text: lower-case (A-Z), words between ASCII white space, hashed shingles with repeats."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[len(words) - n :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """key as k, fp (the fingerprint's 64 bits as a signed long), one row per row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unload()
        for b in batches:
            parts = (b.column(1).slice(i, TEXTS) for i in range(0, b.num_rows, TEXTS))
            fps = np.array([fingerprint(t, shingle) for x in parts for t in x.to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["k", "fp"])

    text_batches(docs.sparkSession)
    return docs.select(docs[key].alias("k"), docs[text].alias("x")).mapInArrow(run, f"k {kind}, fp long")


def pivot_bits(pivots: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: a fixed pseudo-random sequence."""
    return np.random.default_rng(2).integers(0, 2**64, pivots, dtype=np.uint64)


def pivot_table(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint (row) to each reference (column)."""
    return np.bitwise_count(fp[:, None] ^ pivots[None, :])


def cell_blocks(bits: int, count: int) -> int:
    """Into how many bit blocks fingerprints are cut, so that a cell of random ones stays near one."""
    blocks = bits + 2
    while blocks < bits + 6 and 64 * (blocks - bits) // blocks < int(count).bit_length() + 2:
        blocks += 1
    return blocks


def cells(table: DataFrame, bits: int, count: int) -> DataFrame:
    """fp, choice, cell: two fingerprints within ``bits`` share all bits of at least blocks - bits of the blocks,
    so they meet in a cell for each such choice of blocks. Which choice is part of the cell's key."""
    from itertools import combinations

    blocks = cell_blocks(bits, count)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    chosen = [sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    keys = F.array(*(F.struct(F.lit(n).cast("short").alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for n, m in enumerate(signed)))
    return table.select("fp", F.explode(keys).alias("cell")).select("fp", F.col("cell.c").alias("c"), F.col("cell.v").alias("v"))


def forest(fp: np.ndarray, table: np.ndarray, block: np.ndarray, i: int, j: int, bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the task's pairs within ``bits``: at most one for each fingerprint.

    A pair is discarded if its distances to some reference differ by more than ``bits`` (the triangle inequality);
    survivors are verified on the fingerprints.
    """
    trees = Forest(len(fp))
    out = []
    narrow = table.astype(np.int8)
    left = range(len(fp)) if i == j else np.flatnonzero(block == i).tolist()
    right = None if i == j else np.flatnonzero(block == j)
    for x in left:
        others = np.arange(x + 1, len(fp)) if right is None else right
        for p in range(narrow.shape[1]):
            if not len(others):
                break
            others = others[np.abs(narrow[others, p] - narrow[x, p]) <= bits]
            if p >= 3 and len(others) > 64:
                others = others[(np.abs(narrow[others, p + 1 :] - narrow[x, p + 1 :]) <= bits).all(axis=1)]
                break
        if len(others):
            for y in others[np.bitwise_count(fp[others] ^ fp[x]) <= bits].tolist():
                if trees.join(x, y):
                    out.append((x, y))
    return out


def near_links(table: DataFrame, count: int, bits: int = BITS, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """a, b: links that connect exactly the fingerprints that all pairs within ``bits`` would connect.

    ``table`` has distinct fingerprints fp. No link is lost: see ``cells``; a cell too large
    for one task is split into tasks that together compare all its pairs. A task first makes the pivot table of its fingerprints: distances
    follow from the fingerprint, so they do not travel with its many copies.
    """
    dealt, refs = materialize(cells(table, bits, count), "cells"), pivot_bits(pivots)
    tasks = pair_tasks(dealt, ["c", "v"], "fp", block)
    where = ["c", "v", "_i", "_j"]
    tasks = tasks.repartition(*where).sortWithinPartitions(*where).select(*where, "_b", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in task_runs(batches, where):
            i, j, b, fp = (t.column(n).to_numpy() for n in ("_i", "_j", "_b", "fp"))
            size, bits_of = np.diff(edges), fp.view(np.uint64)
            data = pivot_table(bits_of, refs)
            two = edges[:-1][size == 2]  # most cells, all at once
            two = two[(i[two] == j[two]) | (b[two] != b[two + 1])]
            two = two[(np.abs(data[two].astype(np.int16) - data[two + 1]) <= bits).all(axis=1)]
            two = two[np.bitwise_count(bits_of[two] ^ bits_of[two + 1]) <= bits]
            got = list(zip(fp[two].tolist(), fp[two + 1].tolist(), strict=True))
            for s, n in zip(edges[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                part = slice(s, s + n)
                got += [(int(fp[s + x]), int(fp[s + y])) for x, y in forest(bits_of[part], data[part], b[part], int(i[s]), int(j[s]), bits)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], names=["a", "b"])

    return tasks.mapInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS, shingle: int = SHINGLE, pivots: int = PIVOTS) -> DataFrame:
    """Fingerprint and component of every row; fingerprints within ``bits`` differing bits are linked.

    Equal fingerprints are one node from the start, so groups of exact copies cost nothing. Nodes meet in cells; the
    pivot table of a task holds each node's distances to the reference fingerprints, pairs are discarded by their largest
    difference in it, survivors verified, and links become components.

    Columns: key, fingerprint (16 hex digits), component_id (smallest key reachable). Null text is empty; a text without words has
    fingerprint zero and is linked like any other. Null keys are members but never name a component unless all its keys
    are null. Repeated rows give repeated results; an empty table gives none; other columns are ignored.
    """
    rows = materialize(fingerprints(docs, key, text, shingle), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("k").alias("low"), F.count("*").alias("n")), "nodes")
    count = nodes.count()
    links = materialize(near_links(nodes.select("fp"), count, bits, pivots=pivots), "links")
    labels = components(links)
    named = materialize(nodes.join(labels, nodes.fp == labels.node, "left").select("fp", "low", "n", F.coalesce("label", "fp").alias("label")), "labelled")
    lows = materialize(named.groupBy("label").agg(F.min("low").alias("component_id"), F.count("*").alias("_size")), "lows")
    named = materialize(join_groups(named, lows, ["label"], "_size", count).select("fp", "component_id", "n"), "named")
    out = join_groups(rows, named, ["fp"], "n", rows.count())
    return out.select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
