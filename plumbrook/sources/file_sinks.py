"""Sinks that write one file per row, plain or in zip archives, from the executors.

Rows have `path` (relative to the output folder) and `content` (string or binary); names in any case
and order, other columns are ignored. Each task writes under a name of its own in the folder and the
files get their names when the job commits, so that a repeated task leaves nothing twice.
"""

from __future__ import annotations

import itertools
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from plumbrook.errors import PlumbrookError
from plumbrook.sources.files import Files

_PENDING = "_pending"


def checked_path(path: str) -> str:
    """A relative path in plain form; one that leaves the output folder is refused."""
    plain = posixpath.normpath(path or "")
    if not path or plain in (".", "..") or plain.startswith("../") or posixpath.isabs(plain):
        raise PlumbrookError(f"path '{path}' is not inside the output folder")
    return plain


def _places(schema: T.StructType) -> tuple[int, int]:
    by_name = {f.name.lower(): (k, f.dataType) for k, f in enumerate(schema.fields)}
    path, content = by_name.get("path"), by_name.get("content")
    if path is None or not isinstance(path[1], T.StringType) or content is None or not isinstance(content[1], T.StringType | T.BinaryType):
        raise PlumbrookError("columns path (string) and content (string or binary) are required")
    return path[0], content[0]


def _system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{posixpath.abspath(path)}")


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # pending name, final name


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: T.StructType, overwrite: bool):
        self.folder = options.get("path") or ""
        if not self.folder:
            raise PlumbrookError("an output path is required")
        self.options, self.overwrite = dict(options), overwrite
        self.places = _places(schema)
        self.run = uuid.uuid4().hex

    def rows(self, iterator: Iterator) -> Iterator[tuple[str, bytes]]:
        path_at, content_at = self.places
        for row in iterator:
            content = row[content_at]
            if row[path_at] is None:
                raise PlumbrookError("a row has no path")
            yield checked_path(row[path_at]), content.encode() if isinstance(content, str) else bytes(content or b"")

    def pending(self, system: fs.FileSystem, base: str) -> str:
        path = posixpath.join(base, f"{_PENDING}-{self.run}", uuid.uuid4().hex)
        system.create_dir(posixpath.dirname(path), recursive=True)
        return path

    def put(self, system: fs.FileSystem, base: str, final: str, content: bytes) -> tuple[str, str]:
        path = self.pending(system, base)
        with system.open_output_stream(path) as out:
            out.write(content)
        return path, posixpath.join(base, final)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = _system(self.folder)
        if self.overwrite and system.get_file_info(base).type == fs.FileType.Directory:
            for info in system.get_file_info(fs.FileSelector(base)):
                if info.base_name != f"{_PENDING}-{self.run}":
                    system.delete_dir(info.path) if info.type == fs.FileType.Directory else system.delete_file(info.path)
        system.create_dir(base, recursive=True)
        for m in messages:
            for pending, final in m.files if m is not None else ():
                system.create_dir(posixpath.dirname(final), recursive=True)
                system.move(pending, final)
        self._clean(system, base)
        with system.open_output_stream(posixpath.join(base, "_SUCCESS")):
            pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean(*_system(self.folder))

    def _clean(self, system: fs.FileSystem, base: str) -> None:
        pending = posixpath.join(base, f"{_PENDING}-{self.run}")
        if system.get_file_info(pending).type == fs.FileType.Directory:
            system.delete_dir(pending)


class _FilesWriter(_Writer):
    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, base = _system(self.folder)
        return _Written([self.put(system, base, path, content) for path, content in self.rows(iterator)])


class _ZipWriter(_Writer):
    """One archive per task: part-<number>.zip, or zip_file_name where there is one task."""

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        method = {"STORED": zipfile.ZIP_STORED, "DEFLATED": zipfile.ZIP_DEFLATED}.get(self.options.get("zip_method", "DEFLATED").upper())
        level = self.options.get("zip_level")
        if method is None or (level is not None and not (level.lstrip("-").isdigit() and 0 <= int(level) <= 9)):
            raise PlumbrookError("zip_method is STORED or DEFLATED, zip_level 0 to 9")
        number = TaskContext.get().partitionId()
        rows = self.rows(iterator)
        if (first := next(rows, None)) is None:
            return _Written([])
        system, base = _system(self.folder)
        path = self.pending(system, base)
        # Entries go straight into the file; the archive is never held.
        with system.open_output_stream(path) as out, zipfile.ZipFile(out, "w", method, compresslevel=int(level) if level is not None else None) as z:
            for entry, content in itertools.chain([first], rows):
                z.writestr(entry, content)
        name = self.options.get("zip_file_name")
        final = name if name and number == 0 else f"{name.removesuffix('.zip')}-{number:05d}.zip" if name else f"part-{number:05d}.zip"
        return _Written([(path, posixpath.join(base, final))])


class FilePerRow(DataSource):
    """df.write.format("file_per_row").mode("append" or "overwrite").save(folder)."""

    @classmethod
    def name(cls) -> str:
        return "file_per_row"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema: T.StructType):
        raise PlumbrookError("file_per_row only writes; binaryFile reads such folders")

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _FilesWriter(self.options, schema, overwrite)


class Zip(DataSource):
    """df.write.format("zip"): options zip_method, zip_level, zip_file_name; coalesce(1) for a single archive."""

    @classmethod
    def name(cls) -> str:
        return "zip"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema: T.StructType):
        raise PlumbrookError("zip only writes")

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _ZipWriter(self.options, schema, overwrite)


def register(spark) -> None:
    for source in (FilePerRow, Zip):
        spark.dataSource.register(source)


def write_files(df: DataFrame, folder: str, format: str = "file_per_row", mode: str = "errorifexists", **options: str) -> None:
    """As DataFrameWriter.save with all four modes, which a Python data source alone lacks."""
    spark = df.sparkSession
    register(spark)
    exists = Files(spark).exists(folder)
    if mode not in ("errorifexists", "error", "ignore", "append", "overwrite"):
        raise PlumbrookError(f"unknown mode {mode}")
    if exists and mode in ("errorifexists", "error"):
        raise PlumbrookError(f"path {folder} already exists")
    if exists and mode == "ignore":
        return
    df.write.format(format).mode("overwrite" if mode == "overwrite" else "append").options(**options).save(folder)
