"""A listing of files as a Spark data source: one partition for each folder below the given one, hidden names included.

Spark's own file sources never show names that begin with a dot or an underscore. Folders are read by pyarrow's file
systems, so any store that pyarrow reaches from the workers can be listed; a folder that cannot be read is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "quillstack_files"
SCHEMA = "path string, name string, size long, modified_at timestamp, hidden boolean"


class Folder(InputPartition):
    """A folder to walk; ``deep`` is false for the top folder's own files."""

    def __init__(self, path: str, deep: bool) -> None:
        super().__init__(path)
        self.path, self.deep = path, deep


class FileListing(DataSource):
    """Options: path, glob (of the file name), hidden (true shows names with a leading dot or underscore, and what lies below), recursive."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)


class FolderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.glob = options.get("glob", "*")
        self.hidden = options.get("hidden", "false").lower() == "true"
        self.recursive = options.get("recursive", "true").lower() == "true"

    def _entries(self, path: str) -> list:
        from pyarrow.fs import FileSelector, FileSystem

        system, at = FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        try:
            return system.get_file_info(FileSelector(at))
        except OSError:
            return []

    def _seen(self, entry) -> bool:
        return self.hidden or not entry.base_name.startswith((".", "_"))

    def _address(self, path: str) -> str:
        scheme = self.root.partition("://")[0] if "://" in self.root else "file"
        return f"{scheme}://{path}" if scheme != "file" else path

    def partitions(self) -> list[Folder]:
        from pyarrow.fs import FileType

        folders = []
        if self.recursive:
            folders = [Folder(self._address(e.path), True) for e in self._entries(self.root) if e.type == FileType.Directory and self._seen(e)]
        return [Folder(self.root, False), *sorted(folders, key=lambda f: f.path)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        from pyarrow.fs import FileType

        waiting = [partition.path]
        while waiting:
            for entry in sorted(self._entries(waiting.pop()), key=lambda e: e.path):
                if not self._seen(entry):
                    continue
                if entry.type == FileType.Directory:
                    if partition.deep:
                        waiting.append(self._address(entry.path))
                elif fnmatchcase(entry.base_name, self.glob):
                    at = entry.mtime_ns and datetime.fromtimestamp(entry.mtime_ns / 1e9, timezone.utc)
                    yield self._address(entry.path), entry.base_name, entry.size, at, entry.base_name.startswith((".", "_"))


def list_folder(spark: SparkSession, path: str, show_hidden: bool = False, glob: str = "*", recursive: bool = True) -> DataFrame:
    """Path, name, size, time and whether the name is hidden, of the files below ``path``."""
    spark.dataSource.register(FileListing)
    reader = spark.read.format(FORMAT).option("glob", glob).option("hidden", str(show_hidden).lower()).option("recursive", str(recursive).lower())
    return reader.load(path)
