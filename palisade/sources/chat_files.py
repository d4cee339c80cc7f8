"""Uploaded chats as a data source: ``spark.read.format("palisade_chats")`` and ``spark.readStream.format("palisade_chats")``.

Every file below a folder gives one row (path, text, reason): accepted files have a text and no reason, rejected ones a reason:
``type``, ``size``, ``empty`` or ``length``, judged in this order. Files are dealt over tasks by their bytes. A stream goes on
from the last file it has seen, in order of time of change and name. The folder must be one that all workers can open; other
stores are read by :func:`palisade.sources.feeds.conversation_file_scan`.

Defined cases: bytes that are no UTF-8 are left out; outer blanks go; a file that is larger than the limit is not opened; names
that begin with a dot or an underscore are no uploads; a missing folder gives no rows; a folder given as a file is that file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

CHAT_BYTES, CHAT_CHARS, CHAT_SUFFIXES = 1_048_576, 100_000, (".txt", ".log", ".csv")
#: Bytes of files that a task reads, and what opening a file counts for.
TASK_BYTES, OPEN_BYTES = 16_000_000, 65_536


def listed(path: str) -> list[tuple[int, str, int]]:
    """(time of change, path, bytes) of the uploads, in order."""
    root = Path(path.removeprefix("file://"))
    found = [root] if root.is_file() else (p for p in root.rglob("*") if p.is_file()) if root.exists() else []
    files = []
    for p in found:
        inside = p.relative_to(root).parts if p != root else (p.name,)
        if not any(x.startswith((".", "_")) for x in inside):
            stat = p.stat()
            files.append((stat.st_mtime_ns, str(p), stat.st_size))
    return sorted(files)


def dealt(files: list[tuple[int, str, int]], task_bytes: int) -> list[FileBatch]:
    out, batch, size = [], [], 0
    for _, path, n in files:
        cost = OPEN_BYTES + (n if n <= CHAT_BYTES else 0)
        if batch and size + cost > task_bytes:
            out.append(FileBatch(batch))
            batch, size = [], 0
        batch.append(path)
        size += cost
    return [*out, FileBatch(batch)] if batch else out


class FileBatch(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def judged(path: str) -> tuple[str, str | None, str | None]:
    """(path, text, reason) of one upload."""
    p = Path(path)
    if p.suffix.lower() not in CHAT_SUFFIXES:
        return path, None, "type"
    if p.stat().st_size > CHAT_BYTES:
        return path, None, "size"
    text = p.read_bytes().decode("utf-8", "ignore").strip()
    reason = "empty" if not text else "length" if len(text) > CHAT_CHARS else None
    return path, None if reason else text, reason


class ChatReader(DataSourceReader):
    def __init__(self, path: str, task_bytes: int):
        self.path, self.task_bytes = path, task_bytes

    def partitions(self) -> list[FileBatch]:
        return dealt(listed(self.path), self.task_bytes) or [FileBatch([])]

    def read(self, partition: FileBatch) -> Iterator[tuple]:
        yield from map(judged, partition.paths)


class ChatStreamReader(ChatReader, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"last": json.dumps([-1, ""])}

    def latestOffset(self) -> dict:  # noqa: N802
        files = listed(self.path)
        return {"last": json.dumps(files[-1][:2])} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[FileBatch]:
        low, high = tuple(json.loads(start["last"])), tuple(json.loads(end["last"]))
        return dealt([f for f in listed(self.path) if low < f[:2] <= high], self.task_bytes)

    def commit(self, end: dict) -> None:
        pass


class ChatFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "palisade_chats"

    def schema(self) -> str:
        return "path string, text string, reason string"

    def reader(self, schema) -> ChatReader:
        return ChatReader(self.options["path"], int(self.options.get("taskBytes", TASK_BYTES)))

    def streamReader(self, schema) -> ChatStreamReader:  # noqa: N802
        return ChatStreamReader(self.options["path"], int(self.options.get("taskBytes", TASK_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChatFiles)
