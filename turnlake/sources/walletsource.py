"""Markdown wallets as a data source of Spark: ``spark.read.format("wallet")`` and ``df.write.format("wallet")``.

Reading makes one partition per folder of a collection (a day, as a rule) and
lists a folder only in its own task; ``content=false`` opens no file. Filters on
``folder`` name the partitions to read.

Writing stages the files of each task attempt in a folder of its own below
``.staging`` and moves them to their place when the whole job has succeeded. A
task that fails, is repeated or runs twice leaves nothing visible, and a job
that fails removes what it staged.

The folder must be reachable under one path by the driver and all executors.
"""

from __future__ import annotations

import os
import shutil
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    In,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

FILES = "collection string, folder string, path string, file_name string, bytes bigint, modified_at timestamp"
STAGING = ".staging"
STALE_SECONDS = 86_400
PUSH_DOWN = "spark.sql.python.filterPushdown.enabled"


def local(root: str) -> str:
    return root.removeprefix("file://").removeprefix("file:")


def escapes(path: str) -> bool:
    """Does a relative path leave the folder it is joined to, or name none?"""
    parts = path.split("/")
    return not path or path.startswith("/") or ".." in parts or parts[0] == STAGING


@dataclass
class _Folder(InputPartition):
    collection: str
    folder: str | None  # None: files that stand in no folder


class _Reader(DataSourceReader):
    def __init__(self, root: str, collections: list[str], content: bool, suffix: str):
        self.root, self.collections, self.content, self.suffix = root, collections, content, suffix
        self.folders: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            if isinstance(one, EqualTo) and one.attribute == ("folder",):
                self._only({one.value})
            elif isinstance(one, In) and one.attribute == ("folder",):
                self._only(set(one.value))
            else:
                yield one

    def _only(self, folders: set[str]) -> None:
        self.folders = folders if self.folders is None else self.folders & folders

    def partitions(self) -> list[InputPartition]:
        found: list[InputPartition] = []
        for collection in self.collections:
            base = Path(self.root, collection)
            if not base.is_dir():
                continue
            loose = False
            with os.scandir(base) as entries:
                for entry in entries:
                    if entry.is_dir():
                        if self.folders is None or entry.name in self.folders:
                            found.append(_Folder(collection, entry.name))
                    else:
                        loose = True
            if loose and self.folders is None:
                found.append(_Folder(collection, None))
        return sorted(found, key=lambda p: (p.collection, p.folder is not None, p.folder or ""))

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # Spark's stand-in where there is no partition at all
            return
        base = Path(self.root, partition.collection)
        places = base.glob("*") if partition.folder is None else (base / partition.folder).rglob("*")
        for place in places:
            if not place.name.endswith(self.suffix) or place.name.startswith("."):
                continue
            try:
                known = place.stat()
                if not os.path.isfile(place):
                    continue
                content = (place.read_bytes().decode("utf-8", "replace"),) if self.content else ()
            except FileNotFoundError:  # removed since it was listed
                continue
            modified = datetime.fromtimestamp(known.st_mtime, timezone.utc)
            path = place.relative_to(base).as_posix()
            yield (partition.collection, partition.folder, path, place.name, known.st_size, modified, *content)


@dataclass
class _Staged(WriterCommitMessage):
    folder: str
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.job = root, uuid.uuid4().hex

    def _place(self, *parts: str) -> Path:
        return Path(self.root, STAGING, self.job, *parts)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        attempt, files = uuid.uuid4().hex, 0
        try:
            for row in iterator:
                path, content = row["path"], row["content"]
                if path is None or escapes(path):
                    raise ValueError(f"path leaves the folder: {path}")
                target = self._place(attempt, path)
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_text(content or "", "utf-8", newline="")
                files += 1
        except Exception:
            shutil.rmtree(self._place(attempt), ignore_errors=True)
            raise
        return _Staged(attempt, files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        for message in messages:
            if message is None or not message.files:
                continue
            staged = self._place(message.folder)
            for folder, _, names in os.walk(staged):
                target = Path(self.root, os.path.relpath(folder, staged))
                target.mkdir(parents=True, exist_ok=True)
                for name in names:
                    os.replace(Path(folder, name), target / name)
        self._clean()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        """Remove what this job staged, and what tasks of jobs long ended may have left."""
        shutil.rmtree(self._place(), ignore_errors=True)
        staging = Path(self.root, STAGING)
        try:
            for job in staging.iterdir():
                if time.time() - job.stat().st_mtime > STALE_SECONDS:
                    shutil.rmtree(job, ignore_errors=True)
            staging.rmdir()
        except OSError:  # nothing is staged, or another job is staging
            pass


class WalletSource(DataSource):
    """Options: path; collections (comma-separated); content (true); suffix (.md)."""

    @classmethod
    def name(cls) -> str:
        return "wallet"

    def _flag(self, name: str) -> bool:
        return str(self.options.get(name, "true")).lower() == "true"

    def schema(self) -> str:
        return f"{FILES}, content string" if self._flag("content") else FILES

    def reader(self, schema: StructType) -> DataSourceReader:
        collections = [c for c in self.options.get("collections", "").split(",") if c]
        return _Reader(local(self.options["path"]), collections, self._flag("content"), self.options.get("suffix", ".md"))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        missing = {"path", "content"} - set(schema.names)
        if missing:
            raise ValueError(f"a wallet is written from path and content; missing: {sorted(missing)}")
        return _Writer(local(self.options["path"]))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down to it."""
    spark.conf.set(PUSH_DOWN, "true")
    spark.dataSource.register(WalletSource)
