"""``df.write.format("play_files")``: rows of (place, name, content) as files, all of them or none.

A task writes under a folder of its own within ``_staged`` and reports its files; only when all tasks are done
does the driver move them to their names.  What a killed or repeated task has left stays in ``_staged``, which goes
at the end whether the job succeeds or not, so no name ever holds half a file.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "place string, name string, content string"


def open_uri(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), str(Path(uri).resolve()))


@dataclass
class Written(WriterCommitMessage):
    staged: list[tuple[str, str]] = field(default_factory=list)  # where a file is, and its name below the root


class FilesWriter(DataSourceWriter):
    def __init__(self, out: str):
        self.out, self.job = out, uuid.uuid4().hex

    def _root(self) -> tuple[pafs.FileSystem, str, str]:
        fs, root = open_uri(self.out)
        return fs, root, f"{root}/_staged/{self.job}"

    def write(self, iterator) -> Written:
        fs, _, staged = self._root()
        context = TaskContext.get()
        own, done = f"{staged}/{context.partitionId()}-{context.taskAttemptId()}", []
        fs.create_dir(own)
        for i, row in enumerate(iterator):
            with fs.open_output_stream(f"{own}/{i}") as f:
                f.write((row["content"] or "").encode())
            done.append((f"{own}/{i}", f"{row['place']}/{row['name']}"))
        return Written(done)

    def commit(self, messages) -> None:
        fs, root, staged = self._root()
        files = [x for m in messages if m is not None for x in m.staged]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise FileExistsError("two rows have one name")
        for folder in {name.rpartition("/")[0] for name in names}:
            fs.create_dir(f"{root}/{folder}")
        for place, name in files:
            fs.move(place, f"{root}/{name}")
        self._clear(fs, root, staged)

    def abort(self, messages) -> None:
        fs, root, staged = self._root()
        self._clear(fs, root, staged)

    def _clear(self, fs, root: str, staged: str) -> None:
        if fs.get_file_info(staged).type == pafs.FileType.Directory:
            fs.delete_dir(staged)
        if fs.get_file_info(f"{root}/_staged").type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(f"{root}/_staged")):
            fs.delete_dir(f"{root}/_staged")


class FilesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "play_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FilesSink)
