"""Folders of many small files as Spark data sources: a reader of text files and a writer of pages, task by task.

Both work on a path that all executors see. The reader's tasks list the folder themselves and take the files whose names
fall to them, so the driver never holds a list of files. The writer's tasks put each page under its final name in one step
when all pages of the task are written; a task that is repeated writes the same files again.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from textloom.functions.unicode import decoded, read_text

FILES_SCHEMA = "path string, doc_id string, content binary, raw string, text string, reason string"
#: Bytes of files after which rows are sent on.
BATCH_BYTES = 8 << 20


def local_path(folder: str) -> str:
    return folder.removeprefix("file://").removeprefix("file:")


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.suffix = local_path(options["path"]), options.get("suffix", ".txt")
        self.parts = max(1, int(options.get("parts", 8)))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for name in self.names(partition.value):
            path = os.path.join(self.folder, name)
            try:
                content = Path(path).read_bytes()
                text, reason = read_text(content)
            except OSError:
                content, text, reason = None, None, "unreadable"
            rows.append(("file:" + os.path.abspath(path), name, content, decoded(content) if content else None, text, reason))
            held += len(content or b"")
            if held >= BATCH_BYTES:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def names(self, part: int) -> Iterator[str]:
        with os.scandir(self.folder) as found:
            for entry in found:
                if entry.name.endswith(self.suffix) and zlib.crc32(os.fsencode(entry.name)) % self.parts == part and entry.is_file():
                    yield entry.name

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in FILES_SCHEMA.split(", ")])


class FolderSource(DataSource):
    """Files of a folder, not of those in it: option `path`; `suffix` (.txt); `parts`, how many tasks share them (8)."""

    @classmethod
    def name(cls) -> str:
        return "textloom_folder"

    def schema(self) -> str:
        return FILES_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FolderReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    pages: int


def page_name(key: str) -> str:
    """A file's name for a key: the key itself; where that can't be one, with its hash."""
    plain = key.replace("/", "_").replace("\0", "_")
    if plain == key and len(plain.encode()) <= 240:
        return f"{plain}.html"
    cut = plain.encode()[:200].decode("utf-8", "ignore")
    return f"{cut}-{hashlib.sha256(key.encode()).hexdigest()[:12]}.html"


class PageWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder = Path(local_path(options["path"]))

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        staging = self.folder / "_writing" / uuid.uuid4().hex
        staging.mkdir(parents=True)
        pages = 0
        for row in iterator:
            (staging / page_name(row[0])).write_text(row[1], encoding="utf-8")
            pages += 1
        for path in list(os.scandir(staging)):
            os.replace(path.path, self.folder / path.name)
        staging.rmdir()
        return Written(pages)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self.clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.clear()

    def clear(self) -> None:
        shutil.rmtree(self.folder / "_writing", ignore_errors=True)


class PageSink(DataSource):
    """One file for each row (key, page): option `path`, a folder, which is made; files of other names in it stay."""

    @classmethod
    def name(cls) -> str:
        return "textloom_pages"

    def schema(self) -> str:
        return "pair_key string, html string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PageWriter(self.options)


def scan_folder(spark: SparkSession, folder: str, parts: int | None = None) -> DataFrame:
    """(path, doc_id, content, raw, text, reason) of a folder's own text files; doc_id is the file's name.

    `reason` tells why a file has no text: it is empty (or blank), or can't be read or decoded.
    """
    spark.dataSource.register(FolderSource)
    return spark.read.format("textloom_folder").option("path", folder).option("parts", parts or int(spark.conf.get("spark.sql.shuffle.partitions"))).load()


def write_pages(pages: DataFrame, folder: str) -> None:
    """Writes (pair_key, html) as one file a page, `<pair_key>.html`, by the tasks that made them."""
    pages.sparkSession.dataSource.register(PageSink)
    Path(local_path(folder)).mkdir(parents=True, exist_ok=True)
    pages.select("pair_key", "html").write.format("textloom_pages").mode("append").option("path", folder).save()
