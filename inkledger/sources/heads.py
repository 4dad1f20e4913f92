"""First bytes of many files, without reading the rest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEAD_BYTES = 16
# Files of one folder that one task opens.
FILES_PER_TASK = 2000


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it."""
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.removeprefix("file:"))


@dataclass
class Share(InputPartition):
    """Files, or a folder that the task lists itself."""

    files: tuple[str, ...] = ()
    folder: str | None = None


class HeadReader(DataSourceReader):
    """Folders below the top are listed by the tasks, so the driver holds one level at most."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.size = int(options.get("bytes", HEAD_BYTES))

    def partitions(self) -> list[InputPartition]:
        store, path = open_store(self.root)
        found = store.get_file_info(fs.FileSelector(path, recursive=False))
        files = sorted(f.path for f in found if f.type == fs.FileType.File)
        shares = [Share(tuple(files[at:at + FILES_PER_TASK])) for at in range(0, len(files), FILES_PER_TASK)]
        shares += [Share(folder=f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.Directory]
        return shares or [Share()]

    def read(self, partition: Share) -> Iterator[tuple]:
        store, _ = open_store(self.root)
        if partition.folder is None:
            names = [f.path for f in store.get_file_info(list(partition.files))] if partition.files else []
        else:
            below = store.get_file_info(fs.FileSelector(partition.folder, recursive=True))
            names = sorted(f.path for f in below if f.type == fs.FileType.File)
        for name in names:
            with store.open_input_file(name) as file:
                length = file.size()
                yield name, length, file.read_at(min(self.size, length), 0)


class FileHeads(DataSource):
    """``path, length, content``: ``content`` holds the first ``bytes`` bytes."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, length long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return HeadReader(self.options)


def file_heads(spark: SparkSession, folder: str, size: int = HEAD_BYTES) -> DataFrame:
    """The first ``size`` bytes of every file under a folder.

    Paths are those of the store (without a scheme). An empty file has empty content; a folder
    that does not exist is an error.
    """
    spark.dataSource.register(FileHeads)
    return spark.read.format("file_heads").option("bytes", str(size)).load(folder)
