"""Embedding near-dedup by collision counts over sorted one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, join_groups, materialize, pair_tasks, task_runs

COSINE = 0.98
#: Projections on which collisions are counted, and half a window's width in standard deviations of a pair at the threshold.
COUNTED, HALF_WINDOW = 24, 2.0
#: Share of pairs at the threshold that must reach the count, and that must reach it and share a cell.
RECALL_COUNT, RECALL = 0.999, 0.99
#: Width of a cell on each of its projections, and steps in which projections are stored (16 bits).
CELL, STEP = 1.2, 1 / 2048
#: Vectors that a cell of unrelated vectors should hold, about; and the most that one task compares.
CELL_ROWS, BLOCK = 64, 1024
#: Projections counted for all pairs of a task; the others are counted for those that can still reach the count.
DENSE = 10


class Plan:
    """Projections, cells, window and count, from the dimension, the threshold and the largest label's size.

    For unit vectors at cosine c the difference of a Gaussian projection has deviation s = sqrt(2 - 2c). It exceeds
    a window of half width 2 s in 4.6 % of projections, so the count that RECALL_COUNT of such pairs reach follows
    from the binomial law. One window alone holds 22 % of unrelated pairs, so windows cannot be listed pair by pair: pairs must first
    collide on k projections at once. A table cuts k of the counted projections at random places; its cells are their products, which a pair shares
    with probability 1 - |d| / CELL for each. k grows with the logarithm of the rows. Tables are added until, of differences drawn from
    the law of pairs at the threshold, RECALL share a cell of some table and reach the count; closer pairs do better in both.
    """

    def __init__(self, dim: int, rows: int, cosine: float = COSINE):
        s = math.sqrt(max(2 - 2 * cosine, 1e-6))
        self.window = int(HALF_WINDOW * s / STEP) + 1
        p, total, need = math.erf(HALF_WINDOW / math.sqrt(2)), 0.0, COUNTED
        while need > 0:
            total += math.comb(COUNTED, need) * p**need * (1 - p) ** (COUNTED - need)
            if total >= RECALL_COUNT:
                break
            need -= 1
        self.need = need
        self.k = min(COUNTED, max(2, math.ceil(math.log(max(rows, 1) / CELL_ROWS, 3)))) if rows > CELL_ROWS else 2
        rng = np.random.default_rng(7)
        self.lines = rng.standard_normal((dim, COUNTED))
        d = np.abs(rng.standard_normal((4000, COUNTED))) * s
        reach = (d <= HALF_WINDOW * s).sum(axis=1) >= need
        stay, missed = np.clip(1 - d / CELL, 0, 1), np.ones(len(d))
        most = reach.mean()
        self.axes: list[np.ndarray] = []
        while (reach * (1 - missed)).mean() < min(RECALL, most - 0.002):
            order = rng.permutation(COUNTED)
            for i in range(0, COUNTED - self.k + 1, self.k):
                self.axes.append(order[i : i + self.k])
                missed *= 1 - stay[:, self.axes[-1]].prod(axis=1)
        self.tables = len(self.axes)
        self.shifts = rng.random((self.tables, self.k))

    def places(self, x: np.ndarray) -> np.ndarray:
        """The counted projections of unit vectors, in steps: all later work is on these whole numbers."""
        return np.clip(np.rint(x @ self.lines / STEP), -32767, 32767).astype("<i2")

    def cells(self, q: np.ndarray, tables: int | None = None) -> np.ndarray:
        """A 64-bit cell key for each row and each of the first ``tables`` tables."""
        tables = self.tables if tables is None else tables
        key = np.full((len(q), tables), 0x9E3779B97F4A7C15, dtype=np.uint64)
        for t in range(tables):
            place = np.floor(q[:, self.axes[t]] * (STEP / CELL) + self.shifts[t]).astype(np.int64).view(np.uint64)
            for d in range(self.k):
                key[:, t] = (key[:, t] ^ place[:, d]) * np.uint64(0xFF51AFD7ED558CCD)
                key[:, t] ^= key[:, t] >> np.uint64(32)
        return key.view(np.int64)

    def collisions(self, q: np.ndarray, left: np.ndarray, right: np.ndarray, one: bool) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (left row, right row) with at least ``need`` projections that have right's row in the window around left's.

        Each projection is sorted and every row's window found in it; a pair is given up once it has missed too many.
        """
        spare = COUNTED - self.need
        missed = np.zeros((len(left), len(right)), dtype=np.uint8)
        if one:
            missed[np.tri(len(left), dtype=bool)] = COUNTED + 1
        pairs: tuple[np.ndarray, np.ndarray] | None = None
        for p in range(COUNTED):
            a, b = q[left, p].astype(np.int32), q[right, p].astype(np.int32)
            order = np.argsort(b, kind="stable")
            rank = np.empty(len(b), dtype=np.int32)
            rank[order] = np.arange(len(b), dtype=np.int32)
            low = np.searchsorted(b[order], a - self.window, side="left").astype(np.int32)
            high = np.searchsorted(b[order], a + self.window, side="right").astype(np.int32)
            if pairs is None:
                missed += (rank[None, :] < low[:, None]) | (rank[None, :] >= high[:, None])
                if p + 1 == DENSE:
                    pairs = np.nonzero(missed <= spare)
                    lost = missed[pairs]
            else:
                i, j = pairs
                lost = lost + ((rank[j] < low[i]) | (rank[j] >= high[i]))
                keep = lost <= spare
                pairs, lost = (i[keep], j[keep]), lost[keep]
        i, j = pairs
        return left[i], right[j]


def vectors_of(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of one length, as unit vectors in double precision."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    most = np.abs(x).max(axis=1, keepdims=True)
    x = np.where((most > 1e100) | (most < 1e-100), x / most, x)  # their squares would overflow or vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def bytes_of(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i2").reshape(len(column), COUNTED)


def task_pairs(plan: Plan, t: pa.Table, edges: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each task its pairs (rows of t) with enough collisions that share no cell of an earlier table."""
    tab, i, j, b = (t.column(c).to_numpy() for c in ("tab", "_i", "_j", "_b"))
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        rows = np.arange(s, e)
        one = bool(i[s] == j[s])
        left, right = (rows, rows) if one else (rows[b[s:e] == i[s]], rows[b[s:e] == j[s]])
        if len(left) and len(right):
            u, w = plan.collisions(q, left, right, one)
            if tab[s] and len(u):
                keys = plan.cells(q[s:e], int(tab[s]))
                new = np.ones(len(u), dtype=bool)
                for x in range(keys.shape[1]):
                    new &= keys[u - s, x] != keys[w - s, x]
                u, w = u[new], w[new]
            yield u, w


def near_links(nodes: DataFrame, dim: int, rows: int, cosine: float, block: int) -> DataFrame:
    """Of distinct vectors (id, label, v, n copies): per task, id with the links it found (n), and links a, b of a
    forest that connects what the found pairs connect. A pair counts in the first table whose cell it shares only.

    Cells are met by the stored projections, 48 bytes a copy; vectors travel only to the cells where they have a pair with enough collisions.
    """
    plan = Plan(dim, rows, cosine)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = plan.places(vectors_of(pa.Table.from_batches([b]).column("v")))
                again, tables = np.repeat(np.arange(b.num_rows), plan.tables), np.tile(np.arange(plan.tables, dtype=np.int32), b.num_rows)
                place = pa.array([r.tobytes() for r in q], pa.binary()).take(pa.array(again))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(again)), b.column(1).take(pa.array(again)), place, pa.array(tables), pa.array(plan.cells(q).reshape(-1))], names=["id", "grp", "q", "tab", "cell"])

    placed = nodes.select("id", F.xxhash64("label").alias("grp"), "v").mapInArrow(project, "id long, grp long, q binary, tab int, cell long")
    where = ["grp", "tab", "cell", "_i", "_j"]
    tasks = pair_tasks(materialize(placed, "cells"), ["grp", "tab", "cell"], "id", block)
    tasks = tasks.repartition(*where).sortWithinPartitions(*where).select(*where, "_b", "id", "q")

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each task that have a pair."""
        for t, edges in task_runs(batches, where):
            met = np.zeros(t.num_rows, dtype=bool)
            for u, w in task_pairs(plan, t, edges, bytes_of(t.column("q"))):
                met[u] = met[w] = True
            yield from t.filter(pa.array(met)).to_batches()

    kept = materialize(tasks.mapInArrow(screen, tasks.schema), "met")
    full = kept.join(nodes.select("id", "v", "n"), "id").repartition(*where).sortWithinPartitions(*where)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in task_runs(batches, where):
            x, ids, n = vectors_of(t.column("v")), t.column("id").to_numpy(), t.column("n").to_numpy()
            links = np.zeros(len(x), dtype=np.int64)
            trees, got = Forest(len(x)), []
            for p, q in task_pairs(plan, t, edges, bytes_of(t.column("q"))):
                for at in range(0, len(p), 1 << 16):  # verified in double precision
                    u, w = p[at : at + (1 << 16)], q[at : at + (1 << 16)]
                    ok = np.einsum("ij,ij->i", x[u], x[w]) >= cosine
                    u, w = u[ok], w[ok]
                    np.add.at(links, u, n[w])
                    np.add.at(links, w, n[u])
                    got += [(a, c) for a, c in zip(u.tolist(), w.tolist(), strict=True) if trees.join(a, c)]
            some = np.flatnonzero(links)
            a = np.concatenate([ids[some], ids[[g[0] for g in got]]]) if got else ids[some]
            other = pa.array([None] * len(some) + [int(ids[g[1]]) for g in got], pa.int64())
            count = pa.array(links[some].tolist() + [0] * len(got), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), other, count], names=["a", "b", "links"])

    return full.select(*where, "_b", "id", "q", "v", "n").mapInArrow(verify, "a long, b long, links long")


def near_dedup(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """Links vectors of equal, non-null label whose cosine is at least ``cosine``, and names their components.

    Equal vectors of a label are one node with a number of copies, so a common vector costs nothing. Nodes
    meet in cells; in a cell the collisions of each pair are counted over sorted projections, pairs with enough
    are verified exactly, so no link is false; ``Plan`` sets counts and cells for a stated recall. A cell too
    large for a task is split into tasks that compare all its pairs.

    Columns: key, n_links (rows linked directly, copies counted), component_id (smallest key reachable), kept. Null, empty and
    zero vectors, and those with null or non-finite components, link with nothing, as do rows with null label or
    null key. Vectors of different lengths do not link; each length has its own ``Plan``, so a table costs a run for each. Rows that repeat a key and vector link to each other. An empty table gives no rows; other columns are ignored.
    """
    single = vectors.schema[vector].dataType.elementType.simpleString() == "float"
    rows = vectors.select(vectors[key].alias("k"), vectors[label].alias("label"), vectors[vector].alias("v"))
    if not single:
        rows = rows.withColumn("v", F.transform("v", lambda x: x.cast("double")))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(fine & F.col("label").isNotNull() & F.col("k").isNotNull(), F.lit(False)))
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v"), "dim": F.size("v")})
    rows = materialize(rows, "vectors")
    nodes = rows.where("ok").groupBy("label", "dim", "h1", "h2").agg(F.min("k").alias("low"), F.count("*").alias("n"), F.first("v").alias("v"))
    nodes = materialize(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")  # stored, so the numbers stay
    # of each dimension its largest label: one row for each
    largest = nodes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("most")).orderBy("dim").collect()
    if not largest:
        return rows.select(F.col("k").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"), F.lit(True).alias("kept"))
    found = vectors.sparkSession.createDataFrame([], "a long, b long, links long")
    for d in largest:
        if d["most"] > 1:  # else no two meet
            found = found.union(materialize(near_links(nodes.where(F.col("dim") == d["dim"]), d["dim"], d["most"], cosine, block), "links"))
    count = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    labels = components(found.where("b is not null")).select(F.col("node").alias("id"), F.col("label").alias("part"))
    full = nodes.drop("v").join(count, "id", "left").join(labels, "id", "left").withColumn("part", F.coalesce("part", "id"))
    full = materialize(full, "parts")
    lows = materialize(full.groupBy("part").agg(F.min("low").alias("component"), F.count("*").alias("_size")), "lows")
    full = join_groups(full, lows, ["part"], "_size", full.count()).select("label", "dim", "h1", "h2", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component")
    full = materialize(full, "named")
    members = rows.select("k", F.when(F.col("ok"), F.col("label")).alias("label"), "dim", "h1", "h2")
    out = join_groups(members, full, ["label", "dim", "h1", "h2"], "n", rows.count())
    part = F.coalesce("component", "k")
    return out.select(F.col("k").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), part.alias("component_id"), F.coalesce(F.col("k") == part, F.lit(True)).alias("kept"))


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
