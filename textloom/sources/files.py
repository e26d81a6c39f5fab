"""Text files, tag files and vocabularies as DataFrames."""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.fixed import BACKINGS, SCOPES
from textloom.functions.unicode import file_text, raw_text, text_with_map
from textloom.sources.folders import scan_folder


__all__ = ["TagFileError", "documents", "load_tags", "load_vocabulary", "name_collisions", "parse_tag", "parse_tags", "read_files", "skipped", "skipped_counts", "tag_table", "text_with_map"]


class TagFileError(ValueError):
    """A tag file that isn't as it should be."""


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, doc_id, content, raw, text, reason) of the folder's own *.txt files; doc_id is the file's name.

    Folders that executors see as paths are listed and read by the tasks. Of other stores, which only Spark's readers
    reach, the driver takes the list, since those readers leave out empty and unreadable files.
    """
    if "://" not in folder or folder.startswith("file://"):
        return scan_folder(spark, folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("ignoreCorruptFiles", "true").load(folder)
    rows = files.select("path", "content").withColumn("t", file_text(F.col("content"))).select("path", "content", raw_text(F.col("content")).alias("raw"), "t.text", "t.reason")
    there = spark.createDataFrame(_listed(spark, folder), "path string, size long")
    rows = there.join(rows, "path", "left").withColumn("reason", F.when(F.col("size") == 0, "empty_input").when(F.col("content").isNull(), "unreadable").otherwise(F.col("reason")))
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("doc_id"), "content", "raw", "text", "reason")


def _listed(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of the folder's own *.txt files, by the file system that Spark uses."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return [(f.getPath().toString(), f.getLen()) for f in found if f.isFile() and f.getPath().getName().endswith(".txt")]


def documents(files: DataFrame) -> DataFrame:
    """(doc_id, text): readable files, decoded, in NFKC, stripped."""
    return files.where("reason IS NULL").select("doc_id", "text")


def skipped(files: DataFrame) -> DataFrame:
    """(path, reason) of the files left out, in the order of paths; reason is empty_input or unreadable."""
    return files.where("reason IS NOT NULL").select("path", "reason").orderBy("path")


def skipped_counts(files: DataFrame) -> DataFrame:
    return skipped(files).groupBy("reason").agg(F.count("*").alias("n"))


def name_collisions(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("doc_id").intersect(right.select("doc_id"))


def parse_tag(value, key: str) -> tuple[str | None, str | None, str | None]:
    """(backing, scope, evidence) of a tag: a backing by name, or an object."""
    if isinstance(value, str):
        value = {"backing": value}
    if not isinstance(value, dict):
        raise TagFileError(f"tag value must be a string or an object: key={key}")
    backing, scope, evidence = (value.get(x) for x in ("backing", "scope", "evidence"))
    for name, got, known in (("backing", backing, BACKINGS), ("scope", scope, SCOPES)):
        if got is not None and got not in known:
            raise TagFileError(f"invalid {name} {got!r} for {key} (valid: {', '.join(known)})")
    if evidence is not None and not isinstance(evidence, str):
        raise TagFileError(f"evidence must be a string: key={key}")
    return backing, scope, evidence


def parse_tags(text: str) -> list[tuple]:
    """(n, sentence_sha256, backing, scope, evidence) of a tag file, in its order, keys in lower case."""
    try:
        found = json.loads(text)
    except json.JSONDecodeError as e:
        raise TagFileError(f"tagfile is not valid JSON: {e}") from e
    if not isinstance(found, dict):
        raise TagFileError("tagfile must be a JSON object keyed by sentence_sha256")
    rows: dict[str, tuple] = {}
    for key, value in found.items():
        low = key.lower()
        if not re.fullmatch("[0-9a-f]{64}", low):
            raise TagFileError(f"tag key must be a 64-hex sentence_sha256: {key!r}")
        rows[low] = parse_tag(value, low)
    return [(n, k, *v) for n, (k, v) in enumerate(rows.items())]


def tag_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "n int, sentence_sha256 string, backing string, scope string, evidence string")


def _whole_text(spark: SparkSession, path: str) -> str | None:
    """The text of one file, None where there is no such file."""
    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row[0] if row else ""


def load_tags(spark: SparkSession, path: str) -> DataFrame:
    text = _whole_text(spark, path)
    if text is None:
        raise TagFileError(f"tagfile not found: {path}")
    return tag_table(spark, parse_tags(text))


def load_vocabulary(spark: SparkSession, path: str) -> tuple[str, ...]:
    """One pattern a line; blank lines and those that begin with # are left out. A missing file is a FileNotFoundError."""
    text = _whole_text(spark, path)
    if text is None:
        raise FileNotFoundError(f"vocabulary not found: {path}")
    lines = [x.strip() for x in text.splitlines()]
    return tuple(x for x in lines if x and not x.startswith("#"))
