"""Files as rows: a data source that writes one file a row, and one that lists files.

``write_files`` takes rows (path, content): each becomes a file of its own under a folder, by
the executors. A file is written under a name of its attempt and then renamed, so that a task that
runs twice leaves one whole file. ``list_files`` returns (path, length, modified) of every file
under a folder, empty ones included, without reading any content; folders are listed by tasks.

Paths are those that pyarrow's file systems know (local folders, HDFS, object stores).
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def open_fs(uri: str):
    """pyarrow file system and path of a URI or a local path."""
    from pyarrow import fs
    if uri.startswith("file:"):
        uri = "file://" + "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Written(WriterCommitMessage):
    pass


class RowFileWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        fs, base = open_fs(self.folder)
        made = set()
        for row in iterator:
            path, content = row[0], row[1]
            if path is None or path.startswith("/") or ".." in path.split("/"):
                raise ValueError(f"not a path inside the folder: {path!r}")
            target = f"{base}/{path}"
            parent, _, name = target.rpartition("/")
            if parent not in made:
                fs.create_dir(parent, recursive=True)
                made.add(parent)
            own = f"{parent}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(own, compression=None) as out:
                out.write(bytes(content or b""))
            fs.move(own, target)
        return Written()


class RowFiles(DataSource):
    """``df.write.format("row_files").save(folder)`` of (path string, content binary)."""

    @classmethod
    def name(cls) -> str:
        return "row_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return RowFileWriter(self.options["path"])


class ListingReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs as pafs
        fs, base = open_fs(self.folder)
        top = fs.get_file_info(pafs.FileSelector(base))
        return [InputPartition(None), *[InputPartition(x.path) for x in top if x.type == pafs.FileType.Directory]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs as pafs
        fs, base = open_fs(self.folder)
        whole = partition.value is not None  # else the files right in the folder
        for x in fs.get_file_info(pafs.FileSelector(partition.value if whole else base, recursive=whole)):
            if x.type == pafs.FileType.File:
                yield x.path[len(base.rstrip("/")) + 1:], x.size, x.mtime.replace(tzinfo=None) if x.mtime else None


class Listing(DataSource):
    """``spark.read.format("file_listing").load(folder)``: path (below the folder), length, modified."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return "path string, length long, modified timestamp_ntz"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options["path"])


def write_files(files: DataFrame, folder: str, path: str = "path", content: str | Column = "content") -> None:
    """A file for each row; a path that is there is replaced."""
    files.sparkSession.dataSource.register(RowFiles)
    body = F.col(content) if isinstance(content, str) else content
    files.select(F.col(path).alias("path"), body.cast("binary").alias("content")).write.format("row_files").mode(
        "append").save(folder)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(Listing)
    return spark.read.format("file_listing").load(folder)
