"""What the operators share: working tables, distributed prefix sums, pair tasks, components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: ASCII white space, as the text contracts define it.
WHITE = r"[\x20\x09-\x0D]"
CHUNK = 1024


_LOADED: dict[tuple, object] = {}


def loaded(blob, make: Callable[[bytes], object]):
    """What ``make`` builds of a broadcast's bytes, one at a time for each worker: the next operator's model replaces
    the last one's, with all that it remembers."""
    key = (make.__module__, make.__qualname__, hash(blob.value))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = make(blob.value)
    return _LOADED[key]


def unload() -> None:
    """Lets a worker drop the model of an operator before, where the next one needs none."""
    _LOADED.clear()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session that names none gets a temporary one; elsewhere executors could not read it.
    """
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tailframe-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tailframe-llm/{name}-{uuid.uuid4().hex}"


#: Working tables that the innermost ``scratch`` deletes when it ends.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the working tables that are written inside it, when it ends. What is built on them must be stored by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for name in _SCRATCH.pop():
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts the lineage.

    A lost executor costs no more than the tasks it ran: the table is replicated by the
    shared store. ``scratch`` and ``release`` remove the tables once nothing reads them; ``keep`` saves one from ``scratch``.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of texts that go to a Python worker at once: a batch is held by the executor and, as columns and as strings, by the worker.
TEXT_BYTES = 4 << 20


def text_batches(spark: SparkSession) -> None:
    """Lets texts travel to Python in batches of TEXT_BYTES at most, instead of some ten thousand rows. A setting of the session, read where a plan runs; a smaller one stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name, "64m").lower()
    size = int(re.match("-?[0-9]+", own)[0]) << {"k": 10, "m": 20, "g": 30}.get(own.rstrip("b")[-1:], 0)  # type: ignore[index]
    if not 0 < size <= TEXT_BYTES:
        spark.conf.set(name, str(TEXT_BYTES))


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nobody holds any more: it does so when their driver-side objects are collected.

    Called where a stage begins with a stored table, so that the disk holds one stage's shuffles and not those of all before.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Deletes every working table. Call it when all results built on them are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tailframe-llm")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of the key columns of two aliased frames."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def gated(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """Broadcast hint for a stored table if its measured bytes are within ``most``; else the join shuffles.

    A value counts its bytes, or 8, and a row 48 more for the hash table that holds it.
    """
    width = F.lit(48).cast("long")
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        width = width + (F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) if kind in ("string", "binary") else F.lit(8 if kind in ("long", "bigint", "int", "boolean", "double") else 64))
    size = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if size <= most else df


#: Groups of at least so many rows, or of one in so many of all rows, are met by broadcast.
HOT_ROWS, HOT_GROUPS = 20_000, 10_000


def join_groups(rows: DataFrame, groups: DataFrame, on: Sequence[str], size: str, total: int) -> DataFrame:
    """rows left-joined with one row for each group, when a group may hold a large share of all rows.

    Groups of over max(HOT_ROWS, total / HOT_GROUPS) rows are HOT_GROUPS at most, so these are broadcast and their rows stay where
    they are; the others are joined by shuffle, where none is large. ``size`` is dropped. Both are stored tables.
    """
    limit = max(HOT_ROWS, total // HOT_GROUPS)
    hot, rest = (groups.where(c).drop(size) for c in (F.col(size) > limit, F.col(size) <= limit))
    if hot.isEmpty():
        return rows.join(rest, list(on), "left")
    hot = F.broadcast(hot)
    return rows.join(hot, list(on)).unionByName(rows.join(hot, list(on), "left_anti").join(rest, list(on), "left"))


def prefix_sums(df: DataFrame, order: Sequence[str], values: dict[str, str], group: Sequence[str] = ()) -> DataFrame:
    """Adds, for each name, the exclusive running sum of a column in ``order`` within ``group``.

    ``values`` maps new column to summed column. ``pos`` (rows before) is added too. Rows are
    range-partitioned by group and order and cut into chunks of at most CHUNK rows; sums run
    within a chunk, over the chunks of a partition, and over the partitions. So no task holds a
    whole group, however hot the group is. Ties in ``order`` are broken by arrival; equal
    rows can trade places and nothing else changes.
    """
    keys = [*group, *order, "_tie"]
    at = F.monotonically_increasing_id()
    d = df.withColumn("_tie", at).repartitionByRange(*keys).sortWithinPartitions(*keys)
    d = d.withColumn("_at", at).withColumns({"_pid": F.shiftright("_at", 33), "_sub": F.shiftright(F.col("_at").bitwiseAND((1 << 33) - 1), CHUNK.bit_length() - 1)})
    d = materialize(d, "ordered")
    summed = {**values, "pos": None}
    one = lambda c: F.lit(1).cast("long") if c is None else F.col(c).cast("long")

    def running(frame: DataFrame, by: Sequence[str], ordered: Sequence[str], prefix: str, of: dict[str, Column]) -> DataFrame:
        w = W.partitionBy(*by).orderBy(*ordered).rowsBetween(W.unboundedPreceding, -1)
        return frame.withColumns({f"{prefix}{k}": F.coalesce(F.sum(c).over(w), F.lit(0).cast("long")) for k, c in of.items()})

    chunk = [*group, "_pid", "_sub"]
    inner = running(d, chunk, ["_at"], "_in_", {k: one(c) for k, c in summed.items()})
    totals = d.groupBy(*chunk).agg(*(F.sum(one(c)).alias(f"_t_{k}") for k, c in summed.items()))
    if group:
        base = running(totals, group, ["_pid", "_sub"], "_b_", {k: F.col(f"_t_{k}") for k in summed})
    else:
        within = running(totals, ["_pid"], ["_sub"], "_b0_", {k: F.col(f"_t_{k}") for k in summed})
        parts = totals.groupBy("_pid").agg(*(F.sum(f"_t_{k}").alias(f"_p_{k}") for k in summed))
        parts = running(parts, [], ["_pid"], "_b1_", {k: F.col(f"_p_{k}") for k in summed})  # one row for each partition
        base = within.join(F.broadcast(parts.select("_pid", *(f"_b1_{k}" for k in summed))), "_pid")
        base = base.withColumns({f"_b_{k}": F.col(f"_b0_{k}") + F.col(f"_b1_{k}") for k in summed})
    base = base.select(*(F.col(c).alias(f"_k_{c}") for c in chunk), *(f"_b_{k}" for k in summed))
    cond = F.lit(True)
    for c in chunk:
        cond = cond & inner[c].eqNullSafe(base[f"_k_{c}"])
    out = inner.join(base, cond)
    return out.select(*df.columns, *((F.col(f"_in_{k}") + F.col(f"_b_{k}")).alias(k) for k in summed))


def pair_tasks(df: DataFrame, cell: Sequence[str], ident: str, block: int) -> DataFrame:
    """Deals the rows of each cell to tasks that together meet every pair of a cell exactly once.

    Cells of at most ``block`` rows are one task. A larger cell is split by a hash of ``ident``
    into b blocks; task (i, j) compares block i with block j, so each row is copied b times and
    no task holds more than about two blocks. Cells of one row are left out: they have no pair.
    Adds ``_i``, ``_j`` (the task) and ``_b`` (the row's block). df must be a stored table.
    """
    sizes = df.groupBy(*cell).agg(F.count("*").alias("_n")).where("_n > 1")
    sized = df.join(sizes, list(cell))
    parts = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    sized = sized.withColumn("_b", F.pmod(F.xxhash64(F.col(ident), F.lit(77)), parts).cast("int"))
    sized = sized.withColumn("_o", F.explode(F.sequence(F.lit(0), parts - 1)))
    return sized.withColumns({"_i": F.least("_b", "_o"), "_j": F.greatest("_b", "_o")}).drop("_o", "_n")


def task_runs(batches: Iterator[pa.RecordBatch], where: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole tasks of a partition sorted by ``where``: a table, and where its tasks begin and end.

    Batches are cut anywhere, so the last task of each waits for the next batch.
    """
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        edges = run_edges(t, where)
        if len(edges) > 2:
            yield t.slice(0, edges[-2]), edges[:-1]
        rest = t.slice(edges[-2])
    if rest is not None:
        yield rest, run_edges(rest, where)


def run_edges(t: pa.Table, where: Sequence[str]) -> np.ndarray:
    fresh = np.zeros(max(0, t.num_rows - 1), dtype=bool)
    for n in where:
        x = t.column(n).to_numpy()
        fresh |= x[1:] != x[:-1]
    return np.concatenate([[0], np.flatnonzero(fresh) + 1, [t.num_rows]]).astype(np.int64)


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def top(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Joins the trees of x and y; False if they were one."""
        a, b = self.top(x), self.top(y)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable node of every node that has an edge: columns node, label.

    Alternating large-star and small-star steps; every step is a grouped minimum (combined before
    the shuffle) and an equi-join whose large keys adaptive execution can split. Links and
    labels stay in tables.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = materialize(e, "edges")
    mark = None
    while not e.isEmpty():
        both = e.union(e.select(F.col("v"), F.col("u")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small, "edges")
        row = e.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == tuple(row):
            break
        mark = tuple(row)
    stars = e.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return materialize(stars.union(roots), "labels")
