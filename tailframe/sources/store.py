"""Immutable snapshots: Parquet tables with a JSON manifest of checksums and lineage, never overwritten."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST, BLOCKS = "manifest.json", "blocks"


class SnapshotError(ValueError):
    """A snapshot is missing, changed, or does not belong with another."""


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session that names none gets a temporary one: a folder of
    one machine is no use to executors elsewhere."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise SnapshotError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tailframe-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def working_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df in the shared folder and reads it back: later plans start from the table."""
    path = f"{shared_dir(df.sparkSession)}/tailframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes that a broadcast may take, and what a row takes besides its values.
BROADCAST, ROW = 32 << 20, 48


def sized(df: DataFrame, most: int = BROADCAST) -> DataFrame:
    """A broadcast hint for a stored table that is measured to be small enough: as wide as its values, 8 bytes for a number, and ROW for a row."""
    width = F.lit(ROW).cast("long")
    for c, kind in df.dtypes:
        width = width + (F.coalesce(F.octet_length(F.col(c)), F.lit(0)) if kind in ("string", "binary") else F.lit(8 if not kind.startswith(("array", "map", "struct")) else 256))
    size = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def release(spark: SparkSession) -> None:
    """Deletes every working table. Call it when all results built on them are written."""
    fs, p = _filesystem(spark, f"{shared_dir(spark)}/tailframe")
    fs.delete(p, True)


#: Stored stages: (name, application, input) to (what the input looked like, where the table is, the table).
_STAGES: dict[tuple, tuple] = {}


def input_state(spark: SparkSession, path: str, tables: Iterable[str]) -> tuple:
    """Name, length and time of change of the files of some tables, by a listing on the driver."""
    out = []
    for table in tables:
        fs, p = _filesystem(spark, f"{path}/{table}.parquet")
        if fs.exists(p):
            found = fs.listFiles(p, True)
            while found.hasNext():
                f = found.next()
                out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def stage(spark: SparkSession, path: str, name: str, tables: Iterable[str], make: Callable[[], DataFrame]) -> DataFrame:
    """A stage's table, written once for each session and state of the input and read by every later stage.

    It is made again if the input's files have changed or the stored table is gone.
    """
    key, state = (name, spark.sparkContext.applicationId, path), input_state(spark, path, tables)
    if key in _STAGES:
        seen, at, table = _STAGES[key]
        fs, p = _filesystem(spark, f"{at}/_SUCCESS")
        if seen == state and fs.exists(p):
            return table
        if at:
            fs.delete(p.getParent(), True)  # the input has changed: nothing is built on the old table any more
    table = working_table(make(), name)
    at = table.inputFiles()[0].rsplit("/", 1)[0] if table.inputFiles() else ""
    _STAGES[key] = (state, at, table)
    return table


def made_once(spark: SparkSession, path: str, name: str, tables: Iterable[str], make: Callable[[str], object]) -> str:
    """The path of a folder that ``make`` fills, once for each session and state of the input, as ``stage`` does for tables."""
    key, state = (name, spark.sparkContext.applicationId, path), input_state(spark, path, tables)
    if key in _STAGES:
        seen, at, _ = _STAGES[key]
        fs, p = _filesystem(spark, at)
        if seen == state and fs.exists(p):
            return at
    at = f"{shared_dir(spark)}/tailframe/{name}-{uuid.uuid4().hex}"
    make(at)
    _STAGES[key] = (state, at, None)
    return at


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file through the cluster's file system; fails if it exists."""
    fs, p = _filesystem(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.format("binaryFile").load(path).select("content").collect()  # one small file
    return bytes(rows[0]["content"]).decode()


def checksums(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of each data file below ``path``: files are listed here and hashed in pieces by tasks, so size is no limit."""
    fs, p = _filesystem(spark, path)
    names, found = [], fs.listFiles(p, True)
    while found.hasNext():
        at = found.next().getPath().toString()
        if at.endswith(".parquet"):
            names.append((at,))
    if not names:
        return {}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as arrow

        for part in parts:
            out = []
            for at in part["at"]:
                where, inner = arrow.FileSystem.from_uri(at if ":/" in at and not at.startswith("file:/") else "file://" + at.removeprefix("file:"))
                h = hashlib.sha256()
                with where.open_input_stream(inner) as f:
                    while piece := f.read(1 << 22):
                        h.update(piece)
                out.append(h.hexdigest())
            yield pd.DataFrame({"at": part["at"], "h": out})

    tasks = spark.createDataFrame(names, "at string").repartition(min(len(names), 512))
    return {"/".join(r["at"].split("/")[-2:]): r["h"] for r in tasks.mapInPandas(run, "at string, h string").collect()}  # one row per file


#: Bytes of a file that are hashed together: a large file is several tasks, and a change is found to a block.
HASH_BLOCK = 16 << 20


def data_files(spark: SparkSession, path: str, where: Mapping[str, Any] | None = None) -> list[tuple[str, str, int]]:
    """(name below path, address, bytes) of the table's data files; ``where`` names values of partition columns, and leaves the files of others out."""
    fs, p = _filesystem(spark, path)
    base, out, found = fs.makeQualified(p).toString().rstrip("/") + "/", [], fs.listFiles(p, True)
    wanted = {f"{c}={v}" for c, v in (where or {}).items()}
    while found.hasNext():
        f = found.next()
        at = f.getPath().toString()
        name = at.removeprefix(base)
        if name.endswith(".parquet") and wanted <= set(name.split("/")[:-1]):
            out.append((name, at, f.getLen()))
    return sorted(out)


def block_hashes(spark: SparkSession, files: Iterable[tuple[str, str, int]]) -> DataFrame:
    """file, block, sha256 of every block of some files, hashed by tasks."""
    size = HASH_BLOCK
    rows = spark.createDataFrame([(n, a, b) for n, a, b in files], "file string, at string, bytes long")
    cut = rows.select("file", "at", "bytes", F.explode(F.expr(f"sequence(0L, greatest(0L, (bytes - 1) div {size}))")).alias("block"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tailframe.sources.market import opened

        for part in parts:
            out = []
            for at, block in zip(part["at"], part["block"], strict=True):
                where, inner = opened(at)
                with where.open_input_file(inner) as f:
                    f.seek(int(block) * size)
                    h, left = hashlib.sha256(), size
                    while left and (piece := f.read(min(left, 1 << 22))):
                        h.update(piece)
                        left -= len(piece)
                out.append(h.hexdigest())
            yield pd.DataFrame({"file": part["file"], "block": part["block"], "sha256": out})

    return cut.repartition("file", "block").mapInPandas(run, "file string, block long, sha256 string")


def file_roots(blocks: DataFrame) -> dict[str, str]:
    """Of each file the hash over its blocks' hashes, in order: one row for each file."""
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("block", "sha256"))), lambda x: x["sha256"]))
    return {r["file"]: r["root"] for r in blocks.groupBy("file").agg(F.sha2(joined, 256).alias("root")).collect()}


def table_root(roots: Mapping[str, str]) -> str:
    """The hash over a table's files."""
    return hashlib.sha256("".join(f"{n}:{h};" for n, h in sorted(roots.items())).encode()).hexdigest()


def verify(spark: SparkSession, base: str, name: str, where: Mapping[str, Any] | None = None) -> int:
    """Holds a table's files, or those of some partitions, to the manifest's hash tree; gives the number of bytes that were hashed.

    The roots of the files are in the manifest; the hashes of their blocks, stored beside the tables, tell which block of a file was changed.
    """
    facts = load_manifest(spark, base)["tables"][name]
    roots = facts["files"]
    if table_root(roots) != facts["root"]:
        raise SnapshotError(f"{name}: the manifest's files are not those of its root")
    files = data_files(spark, f"{base}/{name}", where)
    wanted = {n for n in roots if {f"{c}={v}" for c, v in (where or {}).items()} <= set(n.split("/")[:-1])}
    if {n for n, _, _ in files} != wanted:
        raise SnapshotError(f"{name}: a file is missing or was added, so it differs from the manifest")
    if not files:
        return 0
    blocks = block_hashes(spark, files)
    found = file_roots(blocks)
    wrong = sorted(n for n in wanted if found[n] != roots[n])
    if wrong:
        stored = spark.read.parquet(f"{base}/{BLOCKS}/{name}").select("file", "block", F.col("sha256").alias("was"))
        changed = blocks.where(F.col("file").isin(wrong)).join(stored, ["file", "block"], "full").where("not (sha256 <=> was)").orderBy("file", "block").select("file", "block").limit(5).collect()
        raise SnapshotError(f"{name}: a file differs from the manifest, in " + ", ".join(f"block {r['block']} of {r['file']}" for r in changed))
    return sum(b for _, _, b in files)


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def save_snapshot(root: str, snapshot_id: str, tables: Mapping[str, DataFrame], created_at: datetime, lineage: Mapping[str, Any] | None = None, partition_by: Mapping[str, list[str]] | None = None, facts: Mapping[str, Any] | None = None) -> str:
    """Writes tables and manifest below root/snapshot_id, which must not exist. ``created_at`` needs a time zone.

    ``facts``: what a loader may check again (dates, counts).
    """
    if created_at.tzinfo is None:
        raise SnapshotError("created_at needs a time zone")
    spark = next(iter(tables.values())).sparkSession
    base = f"{root.rstrip('/')}/{snapshot_id}"
    fs, p = _filesystem(spark, base)
    if fs.exists(p):
        raise SnapshotError(f"{base} exists")
    found = {}
    for name, df in tables.items():
        writer = df.write.mode("errorifexists")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(*partition_by[name])
        writer.parquet(f"{base}/{name}")
        files = data_files(spark, f"{base}/{name}")
        block_hashes(spark, files).coalesce(8).write.parquet(f"{base}/{BLOCKS}/{name}")
        roots = file_roots(spark.read.parquet(f"{base}/{BLOCKS}/{name}"))
        found[name] = {"columns": [[c, t] for c, t in df.dtypes], "rows": spark.read.parquet(f"{base}/{name}").count() if files else 0, "files": roots, "root": table_root(roots)}
    manifest = {"snapshot_id": snapshot_id, "created_at": created_at.isoformat(), "tables": found, "lineage": dict(lineage or {}), "facts": dict(facts or {})}
    write_text(spark, f"{base}/{MANIFEST}", json.dumps(manifest, indent=1, sort_keys=True))
    return base


def load_manifest(spark: SparkSession, base: str) -> dict[str, Any]:
    return json.loads(read_text(spark, f"{base}/{MANIFEST}"))


def load_table(spark: SparkSession, base: str, name: str, where: Mapping[str, Any] | None = None) -> DataFrame:
    """One table of a snapshot, or with ``where`` its partitions of some values, after the files that are read are found to be the manifest's."""
    facts = load_manifest(spark, base)["tables"][name]
    verify(spark, base, name, where)
    df = spark.read.schema(", ".join(f"`{c}` {t}" for c, t in facts["columns"])).parquet(f"{base}/{name}")
    for c, v in (where or {}).items():
        df = df.where(F.col(c) == v)
    if not where and df.count() != facts["rows"]:
        raise SnapshotError(f"{name}: the row count differs from the manifest")
    return df.select(*(c for c, _ in facts["columns"]))


def load_snapshot(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """All tables, after their files, columns and row counts are found to be the manifest's."""
    return {name: load_table(spark, base, name) for name in load_manifest(spark, base)["tables"]}


def require_same_lineage(manifests: Iterable[Mapping[str, Any]], keys: Iterable[str]) -> None:
    """Refuses to combine snapshots that differ in any of the lineage keys."""
    manifests = list(manifests)
    for key in keys:
        seen = {json.dumps(m["lineage"].get(key), sort_keys=True) for m in manifests}
        if len(seen) > 1:
            raise SnapshotError(f"snapshots differ in {key}")


def require_inference_lineage(primary: Mapping[str, Any], plain: Mapping[str, Any], periods: Mapping[str, Any], keys: Iterable[str] = ("experiment", "sources")) -> None:
    """The lag-zero table may differ from the primary in its bandwidth alone."""
    require_same_lineage([primary, plain, periods], keys)
    if primary["lineage"].get("bandwidth") is not None or plain["lineage"].get("bandwidth") != 0:
        raise SnapshotError("the primary table has an automatic bandwidth, the other none")


def write_report(root: str, name: str, tables: Mapping[str, DataFrame], created_at: datetime, lineage: Mapping[str, Any]) -> str:
    """A report is a snapshot of result tables; each is also exported as one CSV file."""
    base = save_snapshot(root, name, tables, created_at, lineage)
    for table, df in tables.items():
        df.coalesce(1).write.mode("errorifexists").option("header", True).csv(f"{base}/csv/{table}")  # report tables are small
    return base


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SnapshotError(f"missing columns: {missing}")
    return df
