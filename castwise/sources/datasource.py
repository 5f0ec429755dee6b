"""``spark.read.format("tei_plays")``: plays as a data source with a schema and partitions of its own.

Option ``pattern`` filters a folder's files (*.xml).  A partition is some files of together at most
``partition_mb`` (64); each is read in pieces by the task that parses it.  A file that fails is a row with ``error``.
"""

from __future__ import annotations

from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sinks.files import open_uri
from .tei import SCHEMA, failed_row, play


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class PlaysReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[Files]:
        fs, root = open_uri(self.options["path"])
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.options["path"])
        pattern = self.options.get("pattern", "*.xml")
        found = [info] if info.type == pafs.FileType.File else [f for f in fs.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.File and fnmatch(f.base_name, pattern)]
        limit, out, size = float(self.options.get("partition_mb", 64)) * 2**20, [], 0
        for f in sorted(found, key=lambda f: f.path):
            if not out or size + f.size > limit:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(f.path)
            size += f.size
        return out

    def read(self, partition: Files):
        fs, _ = open_uri(self.options["path"])
        schema = to_arrow_schema(self.schema)
        for path in partition.paths:
            try:
                with fs.open_input_stream(path) as f:
                    row = play(f, path)
            except Exception as error:
                row = failed_row(path, error)
            yield pa.RecordBatch.from_pylist([row], schema=schema)


class PlaysSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tei_plays"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PlaysReader:
        return PlaysReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlaysSource)
