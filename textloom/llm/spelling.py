"""Spelling variants: words one edit apart, found by the half that an edit leaves intact.

The shorter of two words one edit apart is m long, and they share a prefix or a suffix of m // 2 characters. So each word
stands in a forward dictionary under its prefix and in a reversed one under its suffix, for its own length and for one
less. Sorted, words that share a half are a range, which is scanned for pairs. A range that is too large is divided: of what
is left between the shared ends, an edit again leaves one half intact, so its words move to ranges that share three
quarters, and so on. Each pair is found in one range only, the one for the place of its first difference.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.shared_store import materialize
from textloom.llm.worker_memory import gives_back

#: Ranges of more words are divided.
RANGE_WORDS = 200
#: Characters compared together, and distinct words that a task counts before it sends their counts on.
CELLS, HELD_WORDS = 4_000_000, 200_000


def variant_words(docs: DataFrame, least_size: int = 7, every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all whole texts: maximal runs of letters up to U+00FF, with A-Z in lower case, that have `least_size`.

    Where the CRC-32 of `<doc_id>:<run>` is divisible by `every`, the run loses the code point at that number modulo its
    length. A null text has no words, a null id counts as an empty one. Rows that repeat count again.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{least_size},}}")

    @gives_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                if not text.is_valid:
                    continue
                begun = zlib.crc32(f"{i.as_py() if i.is_valid else ''}:".encode())
                for run, n in Counter(runs.findall(text.as_py().lower().decode("utf-8", "replace"))).items():  # of bytes, only A-Z are lowered
                    h = zlib.crc32(run.encode(), begun)
                    if h % every == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= least_size:
                        held[run] += n
                if len(held) >= HELD_WORDS:
                    yield send()
        yield send()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _halves(low: Column, high: Column, until: Column) -> Column:
    """What becomes of a range whose words differ between `low` and `high` (of the shorter word), first before `until`: the
    part that shares the first half of what is between, and the part that shares the second half."""
    half = F.floor((high - low) / 2).cast("int")
    window = lambda a, b, u: F.struct(a.cast("int").alias("low"), b.cast("int").alias("high"), u.cast("int").alias("until"))
    return F.array(window(low + half, high, until), window(low, high - half, F.least(until, low + half)))


def _keyed(rows: DataFrame) -> DataFrame:
    """`rows` (code, word, n, size, m, w: low, high, until) with the ends they share as `key`; windows that no pair can have go."""
    key = F.concat_ws(":", F.lpad(F.col("m").cast("string"), 9, "0"), "w.low", "w.high", F.expr("left(word, w.low)"), F.expr("if(m = w.high, '', right(word, m - w.high))"))
    return rows.where("w.low < w.until").select("code", "word", "n", "size", "m", "w", key.alias("key"))


def _pairs_of(codes: pa.Array, ends: np.ndarray, m: np.ndarray, size: np.ndarray, low: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of words one edit apart: i of m characters, j after it in the range that ends at ends[i]."""
    flat, at = np.frombuffer(codes.buffers()[2] or b"", dtype=">u4"), np.frombuffer(codes.buffers()[1], dtype=np.int32)[codes.offset :][: len(codes)] // 4
    short = np.flatnonzero((size == m) & (ends > np.arange(len(ends)) + 1))
    found = [(np.zeros(0, dtype=np.int64),) * 2]
    for width in np.unique(m[short]).tolist():
        rows = short[m[short] == width]
        many = ends[rows] - rows - 1
        group = np.cumsum(many * width) // CELLS
        for rows_, many_ in zip(np.split(rows, np.flatnonzero(np.diff(group)) + 1), np.split(many, np.flatnonzero(np.diff(group)) + 1)):
            i = np.repeat(rows_, many_)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many_) - many_, many_)
            first, last = int(rows_[0]), int((rows_ + many_)[-1])
            place = at[first : last + 1, None] + np.arange(width + 1)
            table = flat[np.minimum(place, len(flat) - 1)]  # shorter words run on into the next, which is never looked at
            a, b = table[i - first], table[j - first]
            differ = a[:, :width] != b[:, :width]
            p = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
            shifted = a[:, :width] != b[:, 1:]
            final = np.where(shifted.any(axis=1), width - 1 - shifted[:, ::-1].argmax(axis=1), -1)
            near = np.where(size[j] == width, differ.sum(axis=1) == 1, final < p) & (low[i] <= p) & (p < until[i])
            found.append((i[near], j[near]))
    return tuple(np.concatenate(x) for x in zip(*found))


def near_words(words: DataFrame, limit: int = RANGE_WORDS) -> DataFrame:
    """(code, near, near_n), both ways, for distinct `words` (word, n) one inserted, deleted or replaced code point apart.

    `code` and `near` are words in UTF-32, big end first, which sort like the words. Ranges of more than `limit` words are
    divided until they share all but one character of the shorter word; what is larger then is bounded by the alphabet.
    """
    words = words.select(F.encode("word", "UTF-32").alias("code"), "word", "n", F.length("word").alias("size"))
    words = words.withColumn("m", F.explode(F.array(F.col("size"), F.col("size") - 1))).where("m > 0")
    rows = _keyed(words.withColumn("w", F.explode(_halves(F.lit(0), F.col("m"), F.col("m") + 1))))
    ranges = None
    while True:
        counts = rows.groupBy("key").agg(F.count("*").alias("many"), F.min(F.col("size") - F.col("m")).alias("least")).where("many > 1 and least = 0").select("key", "many")
        sized = materialize(rows.join(counts, "key"), "ranges")
        large = f"many > {int(limit)} and w.high - w.low > 1"
        done = sized.where(f"not ({large})").drop("many")
        ranges = done if ranges is None else ranges.unionByName(done)
        rest = sized.where(large)
        if rest.isEmpty():
            break
        rows = _keyed(rest.drop("key", "many").withColumn("w", F.explode(_halves(F.col("w.low"), F.col("w.high"), F.col("w.until")))))

    @gives_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def pairs_of(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            get = lambda name: np.asarray(table[name])
            keys, codes = table["key"].combine_chunks(), table["code"].combine_chunks()
            codes, keys = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (codes, keys))
            breaks = np.flatnonzero(np.asarray(pa.compute.not_equal(keys[1:], keys[:-1]))) + 1 if len(keys) > 1 else np.zeros(0, dtype=np.int64)
            cuts = np.concatenate(([0], breaks, [len(keys)]))
            i, j = _pairs_of(codes, np.repeat(cuts[1:], np.diff(cuts)), get("m"), get("size"), get("low"), get("until"))
            left, right, n = codes.take(pa.array(i)), codes.take(pa.array(j)), get("n")
            return pa.RecordBatch.from_arrays([pa.concat_arrays([left, right]), pa.concat_arrays([right, left]), pa.array(np.concatenate((n[j], n[i])))], ["code", "near", "near_n"])

        for batch in batches:  # ranges that a batch ends within wait for the next
            if not batch.num_rows:
                continue
            final = batch.column("key")[-1]
            inside = int(pa.compute.sum(pa.compute.equal(batch.column("key"), final)).as_py())
            if inside < batch.num_rows or (kept and kept[-1].column("key")[-1] != final):
                head = batch.slice(0, batch.num_rows - inside)
                yield pairs_of(pa.Table.from_batches([*kept, head]))
                kept = []
            kept.append(batch.slice(batch.num_rows - inside))
        if kept:
            yield pairs_of(pa.Table.from_batches(kept))

    flat = ranges.select("key", "code", "n", "size", "m", F.col("w.low").alias("low"), F.col("w.until").alias("until"))
    return flat.repartition("key").sortWithinPartitions("key", "size", "code").mapInArrow(scan, "code binary, near binary, near_n long")


def spelling_variants(words: DataFrame, ratio: int = 10, limit: int = RANGE_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct `words` (word, n).

    Near words are one inserted, deleted or replaced code point apart; `n_near` counts them. `form` is the near word of the
    largest n, the first in code-point order among equals, if its n is `ratio` times the word's or more; `root` is where
    following the forms ends. Null and empty words are left out, of repeated words the counts are added up, other columns
    aren't read. An empty table stays empty.
    """
    words = words.where("word <> ''").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    words = materialize(words, "words")
    best = near_words(words, limit).groupBy("code").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    best = best.select(F.decode("code", "UTF-32").alias("word"), "n_near", F.decode("best.near", "UTF-32").alias("form"), (-F.col("best.less")).alias("form_n"))
    good = F.col("form_n") >= ratio * F.col("n")
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"))
    rows = materialize(rows, "forms")
    # Counts grow with every step, so there are no circles and at most one step for each factor `ratio`; paths double in length.
    ways = materialize(rows.where("form is not null").select("word", F.col("form").alias("root")), "ways")
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        ways = materialize(ways.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "ways")
        if ways.where("moved").isEmpty():
            break
        ways = ways.select("word", "root")
    return rows.join(ways.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
