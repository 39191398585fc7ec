"""``spark.read.format("disc_image").option("table", ...)``: a Python data source whose tasks
open images by themselves, for images on paths that the executors share."""

from __future__ import annotations

import glob
import mmap
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .disc import SCHEMAS, Options, _rows


class DiscImageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "disc_image"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "volumes")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, schema.names)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]) -> None:
        self.options, self.names = options, names

    def partitions(self) -> list[InputPartition]:
        path = self.options["path"]
        found = sorted(glob.glob(os.path.join(path, "**"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path))
        return [InputPartition(p) for p in found if os.path.isfile(p)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        what = self.options.get("table", "volumes")
        # Decoders seek in the file, so no more of a large image is held than what they read.
        with open(partition.value, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if os.path.getsize(partition.value) else b""
        try:
            for row in _rows(partition.value, data, what, Options(partition=self.options.get("partition"))):
                yield tuple(row.get(n) for n in self.names)
        except Exception as e:
            if what == "volumes":
                yield tuple({"path": partition.value, "status": "error", "error": f"{type(e).__name__}: {e}"}.get(n) for n in self.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DiscImageSource)
