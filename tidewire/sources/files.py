"""Writers of a static copy: one file a row, and one JSON document from sorted parts.

Tasks write to a staging folder beside the target; only the commit moves files into place, so a write that fails leaves
the old copy as it was. Paths may be of any file system that Arrow reaches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Bytes that the commit copies at once.
CHUNK = 1 << 20


@dataclass
class Written(WriterCommitMessage):
    """A task's staged files and where they belong, what it left as it is, its place among the tasks."""

    files: list[tuple[str, str]]
    kept: list[str]
    task: int


class _Staged(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.options = dict(options)
        files, self.target = self._open(options["path"].rstrip("/"))
        self.staging = f"{self.target}.staging-{uuid.uuid4().hex}"

    def _open(self, path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    @property
    def files(self) -> fs.FileSystem:
        return self._open(self.options["path"])[0]

    def abort(self, messages: list) -> None:
        files = self.files
        if files.get_file_info(self.staging).type == fs.FileType.Directory:
            files.delete_dir(self.staging)

    def _name(self) -> str:
        return f"{self.staging}/{TaskContext.get().partitionId():08d}-{TaskContext.get().taskAttemptId()}"


class _FilesWriter(_Staged):
    """Rows (path, content): a file each below the option ``path``. Options: existing (``keep``: files that are there aren't written again), clean (a folder below whose files go if no row names them)."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, keep, made, kept = self.files, self.options.get("existing") == "keep", [], []
        files.create_dir(self.staging)
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                if keep and files.get_file_info(f"{self.target}/{path}").type == fs.FileType.File:
                    kept.append(path)
                    continue
                staged = f"{self._name()}-{len(made)}"
                with files.open_output_stream(staged) as out:
                    data = content.as_py()
                    out.write(data.encode() if isinstance(data, str) else data or b"")
                made.append((staged, path))
        return Written(made, kept, TaskContext.get().partitionId())

    def commit(self, messages: list[Written | None]) -> None:
        files, own = self.files, [m for m in messages if m is not None]
        for staged, path in (f for m in own for f in m.files):
            files.create_dir(f"{self.target}/{path}".rpartition("/")[0])
            files.move(staged, f"{self.target}/{path}")
        if "clean" in self.options:
            folder = f"{self.target}/{self.options['clean']}"
            wanted = {f"{self.target}/{p}" for m in own for p in (*m.kept, *(f[1] for f in m.files))}
            for info in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if info.type == fs.FileType.File and info.path not in wanted:
                    files.delete_file(info.path)
        self.abort([])


class _DocumentWriter(_Staged):
    """Rows ``json`` in the order of tasks: one document at ``path``. Option form: array, or object for an only row."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, some, staged = self.files, False, self._name()
        files.create_dir(self.staging)
        with files.open_output_stream(staged) as out:
            for batch in iterator:
                for line in batch.column("json").to_pylist():
                    out.write((",\n" if some else "").encode() + line.encode())
                    some = True
        return Written([(staged, "")] if some else [], [], TaskContext.get().partitionId())

    def commit(self, messages: list[Written | None]) -> None:
        files, array = self.files, self.options.get("form", "array") == "array"
        parts = [f for m in sorted((m for m in messages if m is not None), key=lambda m: m.task) for f, _ in m.files]
        files.create_dir(self.staging)
        files.create_dir(self.target.rpartition("/")[0])
        whole = f"{self.staging}/document"
        with files.open_output_stream(whole) as out:
            out.write(b"[\n" if array else b"")
            for k, part in enumerate(parts):
                out.write(b",\n" if k else b"")
                with files.open_input_stream(part) as rows:
                    while chunk := rows.read(CHUNK):
                        out.write(chunk)
            out.write(b"\n]\n" if array else b"\n")
        files.move(whole, self.target)
        self.abort([])


class FilesSink(DataSource):
    """``df.write.format("tidewire_files")``: see _FilesWriter."""

    @classmethod
    def name(cls) -> str:
        return "tidewire_files"

    def writer(self, schema, overwrite: bool):
        return _FilesWriter(self.options)


class DocumentSink(DataSource):
    """``df.write.format("tidewire_document")``: see _DocumentWriter."""

    @classmethod
    def name(cls) -> str:
        return "tidewire_document"

    def writer(self, schema, overwrite: bool):
        return _DocumentWriter(self.options)
