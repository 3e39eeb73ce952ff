"""Books written as archives, entry by entry, and moved to their place when all are whole."""

from __future__ import annotations

import os
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: What is written: the file that an entry is of, its place there, its name, its bytes (null: none is written).
COLUMNS = "file string, place long, name string, content binary"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


class ZipSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_archives"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: list[str]


class _Writer(DataSourceArrowWriter):
    """Phase one: each attempt of a task writes whole files to a folder of its own. Phase two: the driver moves the files of the attempts that count.

    A task that is killed leaves its folder only, which commit and abort both remove with all others of the job.
    """

    def __init__(self, path: str) -> None:
        self.path, self.job = path, f"_writing-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        system, root = _system(self.path)
        folder = f"{root}/{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        files: list[str] = []
        book, stream = None, None
        try:
            for b in batches:
                for file, name, content in zip(b.column("file").to_pylist(), b.column("name").to_pylist(), b.column("content")):
                    if not files or file != files[-1]:
                        if book:
                            book.close()
                            stream.close()
                        files.append(file)
                        system.create_dir(os.path.dirname(f"{folder}/{file}"), recursive=True)
                        stream = system.open_output_stream(f"{folder}/{file}", compression=None)
                        book = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                    if content.is_valid:
                        entry = zipfile.ZipInfo(name)
                        entry.file_size = len(content.as_buffer())
                        with book.open(entry, "w") as out:
                            out.write(memoryview(content.as_buffer()))
            if book:
                book.close()
                stream.close()
        except BaseException:
            if stream:
                stream.close()
            system.delete_dir_contents(folder, missing_dir_ok=True)
            raise
        return Written(folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _system(self.path)
        for m in messages:
            for file in m.files if m else ():
                system.create_dir(os.path.dirname(f"{root}/{file}"), recursive=True)
                system.move(f"{m.folder}/{file}", f"{root}/{file}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, root = _system(self.path)
        if system.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.job}")


def write_archives(entries: DataFrame, path: str) -> None:
    """Write `COLUMNS` as archives of stored entries below `path`, in the order of place and name. A file that is there is replaced when the new one is whole.

    A book is written by one task as its entries come, sorted by Spark: the task holds one batch of them, never a book. Null files are left out, a file whose contents are all null
    is an empty archive.
    """
    entries.sparkSession.dataSource.register(ZipSink)
    own = entries.select(*[c.split()[0] for c in COLUMNS.split(", ")]).where("file is not null")
    own.repartition("file").sortWithinPartitions("file", "place", "name").write.format("zip_archives").mode("append").save(path)
