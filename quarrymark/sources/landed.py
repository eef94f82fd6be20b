"""Landed provider payloads as a Spark data source: filters become the requests a provider is sent.

A landing is a folder of Parquet files by region code and category, one folder per request that filled it.
The source ``landed`` turns equalities and lists on both columns into such requests: each request
is one input partition, the others are neither opened nor planned, and with ``limit`` each yields its newest
rows only, as the provider's own ``perpage`` and ``sort`` would. Other filters stay with Spark. Files are
opened by pyarrow's file systems (local, HDFS, S3, GCS); through any other store the same folder is read
with ``spark.read.parquet``, whose partitions are pruned alike.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions.schemas import LANDED
from .provider import contract_parameters

ROWS = pa.schema([("region", pa.string()), ("category", pa.string()), ("number", pa.string()), ("signed", pa.timestamp("us", "UTC")), ("payload", pa.string())])
_NULL = "__HIVE_DEFAULT_PARTITION__"
KEYS = ("region", "category")


def land(rows: DataFrame, path: str) -> None:
    """Writes rows (region, category, number, signed, payload) as a landing; a hot request is split over tasks."""
    rows.select(*(F.col(f.name) for f in ROWS)).hint("rebalance", *KEYS).write.mode("append").partitionBy(*KEYS).parquet(path)


@dataclass
class Request(InputPartition):
    """One request and the files that answer it."""

    region: str | None
    category: str | None
    files: tuple[str, ...]
    limit: int | None

    def parameters(self) -> dict[str, str]:
        """What a provider would be sent."""
        return contract_parameters(self.category or "", self.region, self.limit or 50)


class LandedReader(DataSourceReader):
    def __init__(self, path: str, limit: int | None):
        self.path, self.limit = path, limit
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equalities and lists on the request's columns, leaves the rest to Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in KEYS:  # neither finds nulls
                values = ({f.value} if isinstance(f, EqualTo) else set(f.value)) - {None}
                name = f.attribute[0]
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[Request]:
        files, base = pyarrow.fs.FileSystem.from_uri(self.path)
        found = []
        for region, folder in self._folders(files, base, "region"):
            for category, inner in self._folders(files, folder, "category"):
                names = [i.path for i in files.get_file_info(pyarrow.fs.FileSelector(inner)) if i.is_file and not i.base_name.startswith((".", "_"))]
                if names:
                    found.append(Request(region, category, tuple(sorted(names)), self.limit))
        return found or [Request(None, None, (), self.limit)]

    def _folders(self, files: pyarrow.fs.FileSystem, folder: str, key: str) -> Iterator[tuple[str | None, str]]:
        for info in sorted(files.get_file_info(pyarrow.fs.FileSelector(folder)), key=lambda i: i.path):
            name, _, value = info.base_name.partition("=")
            value = None if value == _NULL else unquote(value)
            if info.type == pyarrow.fs.FileType.Directory and name == key and (key not in self.wanted or value in self.wanted[key]):
                yield value, info.path

    def read(self, partition: Request) -> Iterator[pa.RecordBatch]:
        files, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        batches = (batch for name in partition.files for batch in self._batches(files, name, partition))
        if partition.limit is None:
            yield from batches
            return
        # the newest rows of the request, by date and number; never more than the limit are held
        rows = (row for batch in batches for row in batch.to_pylist())
        newest = heapq.nlargest(partition.limit, rows, key=lambda r: (r["signed"] is not None, r["signed"] and r["signed"].timestamp(), r["number"] or "", r["payload"] or ""))
        if newest:
            yield pa.RecordBatch.from_pylist(newest, ROWS)

    @staticmethod
    def _batches(files: pyarrow.fs.FileSystem, name: str, partition: Request) -> Iterator[pa.RecordBatch]:
        with files.open_input_file(name) as stream:
            for batch in pq.ParquetFile(stream).iter_batches(1024, columns=["number", "signed", "payload"]):
                n = batch.num_rows
                own = [pa.array([value] * n, pa.string()) for value in (partition.region, partition.category)]
                signed = batch.column("signed").cast(pa.timestamp("us", "UTC"))
                yield pa.RecordBatch.from_arrays([*own, batch.column("number").cast(pa.string()), signed, batch.column("payload").cast(pa.string())], schema=ROWS)


class LandedSource(DataSource):
    """``spark.read.format("landed").load(path)``; option ``limit``: newest rows per request, 1 to 50."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return LANDED

    def reader(self, schema) -> LandedReader:
        limit = self.options.get("limit")
        return LandedReader(self.options["path"], None if limit is None else max(1, min(int(limit), 50)))


def read_landed(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A landing as rows; filters on region and category choose the requests that are read."""
    spark.dataSource.register(LandedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("landed")
    return (reader if limit is None else reader.option("limit", limit)).load(path)
