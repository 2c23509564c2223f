"""A market data source: price files by asset and year, read by asset and date range with filters pushed to the files."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as arrow
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

NAME = "tailframe_market"
SCHEMA = "session_date date, asset string, field string, value double"
ARROW = pa.schema([("session_date", pa.date32()), ("asset", pa.string()), ("field", pa.string()), ("value", pa.float64())])
#: Rows that a reader holds at once.
ROWS = 1 << 16


def write_tree(market: DataFrame, path: str) -> str:
    """Stores long market data (session_date, asset, field, value) as path/asset=A/year=Y/*.parquet. Nothing is overwritten. Rows without asset or date are an error."""
    from tailframe.operators.contracts import guarded

    sound = F.col("asset").isNotNull() & F.col("session_date").isNotNull()
    rows = market.select("session_date", guarded(sound, F.col("asset"), "a price has no asset or date").alias("asset"), "field", "value").withColumn("year", F.year("session_date"))
    rows.repartition("asset", "year").sortWithinPartitions("session_date", "field").write.mode("errorifexists").partitionBy("asset", "year").parquet(path)
    return path


def opened(path: str) -> tuple[arrow.FileSystem, str]:
    """The file system of a path or address, and the path there. Local names are taken as they are: what looks like an escape is part of the name."""
    if re.match("[a-z0-9]+:/", path) and not path.startswith("file:/"):
        return arrow.FileSystem.from_uri(path)
    return arrow.LocalFileSystem(), re.sub("^file:/+", "/", path)


@dataclass
class Files(InputPartition):
    """One price file of one asset and year."""

    path: str
    asset: str
    year: int

    def __post_init__(self):
        self.value = (self.path, self.asset, self.year)


class Bounds:
    """What pushed filters leave of assets, dates and fields. Filters that say something else stay with Spark."""

    def __init__(self) -> None:
        self.assets: set[str] | None = None
        self.fields: set[str] | None = None
        self.low: date = date.min
        self.high: date = date.max

    def take(self, f: Filter) -> bool:
        """Whether the filter is wholly kept here."""
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if column in ("asset", "field") and isinstance(f, (EqualTo, In)):
            wanted = set(f.value) if isinstance(f, In) else {f.value}
            name = f"{column}s"
            own = getattr(self, name)
            setattr(self, name, wanted if own is None else own & wanted)
            return True
        value = getattr(f, "value", None)
        if column != "session_date" or not isinstance(value, date):
            return False
        if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, value)
        if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
            self.high = min(self.high, value)
        return isinstance(f, (EqualTo, GreaterThanOrEqual, LessThanOrEqual))  # of a strict bound Spark drops the day itself


class MarketReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.bounds = options["path"].rstrip("/"), Bounds()
        for name, filter_of in (("start", GreaterThanOrEqual), ("end", LessThanOrEqual)):
            if name in options:
                self.bounds.take(filter_of(("session_date",), date.fromisoformat(options[name])))
        for name in ("assets", "fields"):
            if name in options:
                self.bounds.take(In((name[:-1],), tuple(x.strip() for x in options[name].split(",") if x.strip())))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.bounds.take(f)]

    def partitions(self) -> list[Files]:
        """The files that may hold a wanted row: directories are listed, files are not opened."""
        where, inner = opened(self.path)
        out, b = [], self.bounds
        for folder in where.get_file_info(arrow.FileSelector(inner)):
            asset = re.fullmatch("asset=(.*)", folder.base_name)
            if not asset or b.assets is not None and unescaped(asset[1]) not in b.assets:
                continue
            for info in where.get_file_info(arrow.FileSelector(folder.path, recursive=True)):
                year = re.search(r"/year=(\d+)/[^/]*\.parquet$", info.path)
                if year and b.low.year <= int(year[1]) <= b.high.year:
                    out.append(Files(info.path, unescaped(asset[1]), int(year[1])))
        return sorted(out, key=lambda p: p.path)

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is left
            return
        b = self.bounds
        with opened(self.path)[0].open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(ROWS, columns=["session_date", "field", "value"]):
                day = batch.column("session_date").cast(pa.date32())
                keep = pc.and_(pc.greater_equal(day, pa.scalar(b.low, pa.date32())), pc.less_equal(day, pa.scalar(b.high, pa.date32())))
                if b.fields is not None:
                    keep = pc.and_(keep, pc.is_in(batch.column("field"), pa.array(sorted(b.fields), pa.string())))
                out = pa.RecordBatch.from_arrays([day, pa.array([partition.asset] * batch.num_rows, pa.string()), batch.column("field"), batch.column("value")], schema=ARROW)
                yield out.filter(keep)


def unescaped(name: str) -> str:
    """A directory's value as it was before unusual characters were escaped."""
    return re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), name)


class MarketSource(DataSource):
    """``spark.read.format("tailframe_market").option("path", ...)`` with options start, end, assets and fields; a partition is a file."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> MarketReader:
        return MarketReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets filters reach it."""
    spark.dataSource.register(MarketSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_tree(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Market data of a tree. Options: start and end (ISO dates, both included), assets and fields (comma-separated)."""
    register(spark)
    return spark.read.format(NAME).option("path", path).options(**options).load()
