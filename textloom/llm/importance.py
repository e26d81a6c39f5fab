"""Resampling of documents by importance towards a target's distribution of hashed word n-grams.

Two passes of Arrow batches. The first counts features by bucket with np.bincount, one vector a partition, and treeReduce
adds the vectors up. The second gathers each feature's gain from the broadcast table of buckets and sums them by document.
Documents are drawn without replacement by their weights: those with the highest sums of weight and Gumbel noise, which
a hash of the id gives.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.shared_store import materialize
from textloom.llm.worker_memory import gives_back
from textloom.operators.ranking import global_rank

BUCKETS = 10_000
#: Bytes of text looked at together; a longer text is taken by itself.
PART_BYTES = 4_000_000
#: Words up to so many bytes are hashed side by side.
SIDE_BY_SIDE = 48
#: Word bytes: digits, a-z and those of other code points than ASCII; A-Z become a-z, all else a space.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@functools.cache
def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """(the CRC-32 table by byte; what n bytes of zero make of each byte of a checksum, by n, place and byte)."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    moved = np.empty((SIDE_BY_SIDE + 1, 4, 256), dtype=np.uint32)
    moved[0] = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(SIDE_BY_SIDE):
        moved[n + 1] = (moved[n] >> 8) ^ step[moved[n] & 255]
    return step, moved.ravel()


def _checksums(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, byte by byte for all words at once; of longer words one by one."""
    step, _ = _crc_tables()
    order = np.argsort(-np.minimum(sizes, SIDE_BY_SIDE + 1).astype(np.int16), kind="stable")
    at, size = starts[order], sizes[order]
    counts = np.bincount(np.minimum(size, SIDE_BY_SIDE + 1), minlength=SIDE_BY_SIDE + 2)
    longer = np.cumsum(counts[::-1])[::-1]  # words of so many bytes or more
    c = np.full(len(at), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(SIDE_BY_SIDE):
        m = int(longer[k + 1])
        if not m:
            break
        c[:m] = step[(c[:m] ^ raw[at[:m] + k]) & 255] ^ (c[:m] >> 8)
    c ^= np.uint32(0xFFFFFFFF)
    for i in range(int(longer[SIDE_BY_SIDE + 1])):
        c[i] = zlib.crc32(raw[at[i] : at[i] + size[i]].tobytes())
    out = np.empty_like(c)
    out[order] = c
    return out


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket and text of each feature, words of each text): words and pairs of neighbours, by CRC-32 modulo BUCKETS."""
    _, moved = _crc_tables()
    raw = np.frombuffer(b" ".join(texts).translate(PLAIN) + b" ", dtype=np.uint8)
    edges = np.flatnonzero(np.diff(raw != 32, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    owner = np.searchsorted(firsts, starts, side="right") - 1
    sizes = ends - starts
    one = _checksums(raw, starts, sizes)
    # A checksum of a and b in a row is a's, moved on by b's length, with b's on top.
    left = np.flatnonzero(owner[1:] == owner[:-1])
    right = left + 1
    shift = lambda c, n: functools.reduce(np.bitwise_xor, (moved[(n * 4 + k) * 256 + (c >> np.uint32(8 * k) & 255)] for k in range(4)))
    spaced = shift(one[left], np.ones(len(left), dtype=np.int64)) ^ np.uint32(zlib.crc32(b" "))
    two = shift(spaced, np.minimum(sizes[right], SIDE_BY_SIDE)) ^ one[right]
    for i in np.flatnonzero(sizes[right] > SIDE_BY_SIDE).tolist():
        two[i] = zlib.crc32(raw[starts[right[i]] : ends[right[i]]].tobytes(), zlib.crc32(b" ", int(one[left[i]])))
    bucket = np.concatenate((one, two)) % np.uint32(BUCKETS)
    return bucket.astype(np.int64), np.concatenate((owner, owner[left])), np.bincount(owner, minlength=len(texts))


def _parts(texts: pa.Array) -> Iterator[list[bytes]]:
    """Texts as bytes, some at a time; null is empty."""
    raw = texts.cast(pa.binary())
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(raw), 0))
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // PART_BYTES)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield [x or b"" for x in raw[a:b].to_pylist()]


def bucket_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often features of all texts fall into each bucket: one vector for each partition, added up in a tree."""

    @gives_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for part in _parts(batch.column(0)):
                total += np.bincount(features(part)[0], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], dtype=np.int64))
    n = vectors.getNumPartitions()
    if not n:
        return np.zeros(BUCKETS, dtype=np.int64)
    depth = max(2, math.ceil(math.log(n, 64)))  # at most some 64 vectors (of 80 kB) meet in one place
    return vectors.treeReduce(np.add, depth)


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(p / q)) of each bucket: p its share in the target, q in the source, both smoothed by one."""
    ratio = ((target + 1.0) * (source.sum() + float(BUCKETS))) / ((source + 1.0) * (target.sum() + float(BUCKETS)))
    return np.floor(1000 * np.log(ratio))


def importance_weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of each document's features, 0 if it has none."""
    spark = docs.sparkSession
    gains = spark.sparkContext.broadcast(bucket_gains(bucket_counts(docs, text_col), bucket_counts(target, "text")))  # 80 kB, whatever the corpus

    @gives_back
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for part in _parts(batch.column(1)):
                bucket, owner, words = features(part)
                n = words + np.maximum(words - 1, 0)
                total = np.bincount(owner, weights=gains.value[bucket], minlength=len(part)).astype(np.int64)
                columns = [batch.column(0)[row : row + len(part)], pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(total // np.maximum(n, 1))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])
                row += len(part)

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(weigh, f"doc_id {id_type}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_features, weight, score, rank): floor(percent * N / 100) of the N documents with `least_words` words are
    drawn, those with the highest score, the smaller id first among equals; `rank` is null for all others.

    A null or empty text has no features, weight 0 and is never drawn; a null id counts as an empty one in the hash. Rows
    that repeat an id have the same noise and each a place of its own. With an empty `target` all its shares are equal;
    an empty table stays empty. Columns other than id and text are not read.
    """
    rows = importance_weights(docs, target, id_col)
    unit = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    noise = F.floor(F.lit(-1000) * F.log(-F.log((unit.cast("double") + 0.5) / F.lit(4294967296.0))))
    rows = rows.withColumn("score", F.col("weight") + noise).withColumn("able", F.col("n_words") >= least_words)
    rows = materialize(rows.drop("n_words"), "weights")
    drawn = percent * rows.where("able").count() // 100
    rows = global_rank(rows, [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc()])
    return rows.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
