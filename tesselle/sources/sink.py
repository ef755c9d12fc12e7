"""A sink of files that appear when the whole write has succeeded, as a Spark data source in Python.

Each task writes into a staging folder beside the target, under names of its own attempt. When all tasks have succeeded the driver moves what the
committed attempts wrote to its place; a failed write removes the folder, so neither a failed nor a repeated task leaves a file behind. The folder's name
begins with an underscore, so Spark's readers pass over it while it is there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

FORMAT = "tesselle_files"
#: Columns of what is written: the file's name below the target folder, and its bytes. A null in ``content`` writes no file.
SCHEMA = "name string, content binary"


def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@dataclass
class Written(WriterCommitMessage):
    """What one attempt of a task wrote: (staged, name) for each file."""

    files: list[tuple[str, str]]


class FilesWriter(DataSourceWriter):
    def __init__(self, base: str):
        self.base = base
        self.staging = f"{base}/_staging-{uuid.uuid4().hex}"
        system, folder = _system(self.staging)
        system.create_dir(folder, recursive=True)

    def write(self, rows: Iterator[Row]) -> Written:
        system, folder = _system(self.staging)
        attempt = uuid.uuid4().hex
        system.create_dir(f"{folder}/{attempt}", recursive=False)  # a task that outlives its write finds the folder gone
        files = []
        for i, row in enumerate(rows):
            if row.content is None:
                continue
            with system.open_output_stream(f"{folder}/{attempt}/{i}") as f:
                f.write(row.content)
            files.append((f"{attempt}/{i}", row.name))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _system(self.staging)
        _, target = _system(self.base)
        files = [file for m in messages if m is not None for file in m.files]
        if len({name for _, name in files}) != len(files):
            self.abort(messages)
            raise ValueError("two files have one name")
        for parent in {f"{target}/{name}".rpartition("/")[0] for _, name in files}:
            system.create_dir(parent, recursive=True)
        for staged, name in files:
            system.move(f"{folder}/{staged}", f"{target}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, folder = _system(self.staging)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class Files(DataSource):
    """``df.write.format("tesselle_files").mode("append").save(folder)`` of rows (name, content)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        if overwrite:
            raise ValueError("files are only ever added; use mode append")
        return FilesWriter(self.options["path"].rstrip("/"))


def write_files(files: DataFrame, base: str) -> None:
    """Writes rows (name, content) under ``base``, a URI or an absolute path that all machines share: all files or none."""
    base = base if "://" in base else f"file://{base}"
    files.sparkSession.dataSource.register(Files)
    files.select("name", "content").write.format(FORMAT).mode("append").save(base.rstrip("/"))
