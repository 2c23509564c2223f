"""The hash tree of a snapshot: what a load reads is what it verifies, and a change is found to its block."""

import shutil
from datetime import UTC, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tailframe.sources import store

NOW = datetime(2026, 1, 1, tzinfo=UTC)


@pytest.fixture
def base(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "HASH_BLOCK", 1000)
    df = spark.range(4000).select("id", F.when(F.col("id") < 3000, "large").otherwise("small").alias("model"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    return store.save_snapshot(str(tmp_path), "s", {"t": df.repartition(2), "u": df.limit(5)}, NOW, partition_by={"t": ["model"]})


def size(base, part):
    return sum(f.stat().st_size for f in Path(base, part).rglob("*.parquet"))


def test_only_what_is_read_is_hashed(spark, base):
    whole, some = store.verify(spark, base, "t"), store.verify(spark, base, "t", {"model": "small"})
    assert whole == size(base, "t") and some == size(base, "t/model=small") and some < whole / 2
    part = store.load_table(spark, base, "t", {"model": "small"})
    assert part.count() == 1000 and part.columns == ["id", "model", "x"]
    assert store.load_snapshot(spark, base)["t"].count() == 4000


def change(file: Path, at: int) -> None:
    data = bytearray(file.read_bytes())
    data[at] ^= 0xFF
    file.write_bytes(bytes(data))
    crc = file.with_name(f".{file.name}.crc")
    crc.unlink(missing_ok=True)


def test_a_changed_block_is_named(spark, base):
    file = max(Path(base, "t/model=large").glob("*.parquet"), key=lambda f: f.stat().st_size)
    change(file, 5500)
    with pytest.raises(store.SnapshotError, match=f"block 5 of model=large/{file.name}"):
        store.load_table(spark, base, "t")
    assert store.load_table(spark, base, "t", {"model": "small"}).count() == 1000  # the change is not in what is read
    assert store.load_table(spark, base, "u").count() == 5


def test_files_that_come_and_go(spark, base):
    file = next(Path(base, "t/model=small").glob("*.parquet"))
    shutil.copy(file, file.with_name("part-more.parquet"))
    with pytest.raises(store.SnapshotError, match="missing or was added"):
        store.load_table(spark, base, "t")
    file.with_name("part-more.parquet").unlink()
    file.unlink()
    with pytest.raises(store.SnapshotError, match="missing or was added"):
        store.load_table(spark, base, "t", {"model": "small"})


def test_a_manifest_that_was_changed(spark, base):
    at = Path(base, "manifest.json")
    text = at.read_text()
    root = store.load_manifest(spark, base)["tables"]["t"]["root"]
    at.write_text(text.replace(root, root[::-1]))
    (at.parent / ".manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(store.SnapshotError, match="not those of its root"):
        store.verify(spark, base, "t")


def test_an_empty_table_and_one_of_no_rows(spark, tmp_path):
    at = store.save_snapshot(str(tmp_path), "e", {"t": spark.range(0)}, NOW)
    assert store.load_table(spark, at, "t").count() == 0
