"""A sink of real files: one file for each target, written by tasks and committed as a whole.

`spark.dataSource.register(DocumentFiles)` makes the format "document_files" known.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

DRAFTS, DONE = ".drafts-", "_committed-"


def _store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def checked(target: str | None) -> str:
    """A target that stays below its root, or ValueError."""
    parts = (target or "").split("/")
    if not target or target.startswith("/") or any(p in ("", ".", "..") for p in parts) or parts[0].startswith((DRAFTS, DONE)):
        raise ValueError(f"not a path below the root: {target!r}")
    return target


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class _Writer(DataSourceWriter):
    def __init__(self, root: str):
        self._root, self._job = root, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        """Rows of a target stand together; their parts follow each other in its file.

        A task writes drafts under a name of its own attempt and moves them to
        their targets when all are whole, so an attempt that dies leaves targets as
        they are, and one that runs again puts the same bytes in the same places.
        """
        store, root = _store(self._root)
        home = f"{root}/{DRAFTS}{self._job}/{uuid.uuid4().hex}"
        store.create_dir(home, recursive=True)
        targets: list[str] = []
        size, handle = 0, None
        for row in rows:
            target, part = checked(row["target"]), row["part"]
            if not targets or target != targets[-1]:
                if handle is not None:
                    handle.close()
                handle = store.open_output_stream(f"{home}/{len(targets)}")
                targets.append(target)
            data = part.encode() if isinstance(part, str) else bytes(part or b"")
            handle.write(data)
            size += len(data)
        if handle is not None:
            handle.close()
        for folder in {t.rpartition("/")[0] for t in targets}:
            store.create_dir(f"{root}/{folder}" if folder else root, recursive=True)
        for n, target in enumerate(targets):
            store.move(f"{home}/{n}", f"{root}/{target}")
        return Written(len(targets), size)

    def _tidy(self) -> tuple[pyarrow.fs.FileSystem, str]:
        store, root = _store(self._root)
        drafts = f"{root}/{DRAFTS}{self._job}"
        if store.get_file_info(drafts).type == pyarrow.fs.FileType.Directory:
            store.delete_dir(drafts)
        return store, root

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Leave a mark with the number of files and bytes; drafts go."""
        store, root = self._tidy()
        done = [m for m in messages if m is not None]
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{DONE}{self._job}") as mark:
            mark.write(f"{sum(m.files for m in done)} files, {sum(m.size for m in done)} bytes\n".encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._tidy()


class DocumentFiles(DataSource):
    """Write-only; option `path` is the root, a folder that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "target string, part string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("files are added or replaced one by one: use mode append")
        return _Writer(self.options["path"])


def write_files(rows: DataFrame, root: str, order: str | None = None) -> None:
    """Write one file for each `target` (a path below `root`) from its `part` rows, by `order` if there are several.

    Targets are dealt by hash and parts sorted within the task, which streams them into
    the file: no row has to hold a whole file. Existing files of the same name are replaced.
    """
    rows.sparkSession.dataSource.register(DocumentFiles)
    dealt = rows.repartition(F.col("target")).sortWithinPartitions("target", *([order] if order else []))
    dealt.select("target", "part").write.format("document_files").mode("append").save(root)
