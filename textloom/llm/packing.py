"""Best-two-fit packing of tokenised documents into fixed-length training sequences.

The packing problem only depends on how many pieces there are of each length, so it is solved on a histogram with at
most `capacity` entries, whatever the corpus size. The solution is a list of bin patterns with multiplicities; pieces
take their places by their rank among the pieces of their length. No list of documents is ever collected.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.shared_store import materialize
from textloom.llm.worker_memory import gives_back

#: Words kept in a Python worker's cache of token ids.
CACHE_WORDS = 600_000
SIGNS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"
#: Signs from an ASCII letter or digit to white space or the end; it begins with a sign, which re looks for first.
TAIL = re.compile(rb"[%b](?<=[0-9a-z].)[%b]*(?=[\t-\r ]|\Z)" % (re.escape(SIGNS), re.escape(SIGNS)))


def _parts(text: bytes) -> list[bytes]:
    """Words in lower case, ASCII signs at the end of one apart: the tokenizer gives them tokens of their own.

    So "word", "Word" and "word," are learned once. A text that may name a special token is split at white space only.
    """
    return text.split() if b"<|" in text else TAIL.sub(rb" \g<0>", text.lower()).split()


class WordIds(dict):
    """Token ids of words as little-endian bytes, of at most CACHE_WORDS words or of those of one part of the texts.

    The tokenizer's pre-tokenizer never joins text across white space, so the ids of a text are those of its
    white-space separated parts in turn. Parts that are new are encoded together, as one text, and told apart by the
    offsets of its tokens.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.normalizer = self.tokenizer.normalizer
        self.apart: dict[str, bool] = {}

    def _signs_apart(self, stem: bytes) -> bool:
        """Whether ASCII signs after `stem` are tokens of their own, by its last character.

        The tokenizer is asked once for each character: lower-casing and composing may turn a letter into one with a mark
        behind it, which signs join, and its tables of letters are its own.
        """
        if stem[-1:] < b"\x80":
            return stem[-1:].isalnum()
        last = stem.decode("utf-8", "replace")[-1]
        if last not in self.apart:
            self.apart[last] = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(last + "!"))[-1][0] == "!"
        return self.apart[last]

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self]  # words - self.keys() goes through the whole cache
        # A run of ASCII signs after a letter or digit is a token of the pre-tokenizer by itself, and ASCII case is dropped.
        plain, cut, need = [], [], set()
        for w in new:
            stem = w.rstrip(SIGNS)
            if len(stem) == len(w) or b"<|" in w or not self._signs_apart(stem):  # "<|" may begin the name of a special token
                low = w if b"<|" in w or w.islower() else w.lower()
                need.add(low)
                if low is not w:
                    plain.append((w, low))
            else:
                cut.append((w, stem.lower(), w[len(stem) :]))
        need.update([x[1] for x in cut], [x[2] for x in cut])
        if len(self) + len(need) + len(plain) + len(cut) > CACHE_WORDS and len(self):
            self.clear()
            return self.learn(words)
        self._encode(sorted((w for w in need if w not in self), key=bytes.isascii))
        for w, low in plain:
            self[w] = self[low]
        for w, stem, tail in cut:
            self[w] = self[stem] + self[tail]

    def _encode(self, new: list[bytes]) -> None:
        """`new`: parts, those in ASCII last."""
        for at in range(0, len(new), 2_000):
            part = new[at : at + 2_000]
            joined = b" ".join(part).decode("utf-8", "replace")
            # Lower-case letters that are composed are what the normaliser would give.
            easy = joined.isascii() and b"<|" not in joined.encode()
            self.tokenizer.normalizer = None if easy else self.normalizer
            found = self.tokenizer.encode(joined, add_special_tokens=False)
            starts = np.cumsum([0, *(len(t) + 1 for t in (part if easy else joined.split(" ")))])
            ids = np.asarray(found.ids, dtype="<u4")
            first = np.fromiter((x[0] for x in found.offsets), dtype=np.int64, count=len(ids))
            cuts = (np.searchsorted(first, starts) * 4).tolist()
            raw = ids.tobytes()
            self.update((w, raw[x:y]) for w, x, y in zip(part, cuts, cuts[1:], strict=False))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Of each text its ids; only a part of the texts is held as Python objects at a time."""
        raw = texts.cast(pa.binary())
        for at in range(0, len(raw), 500):
            words = [_parts(t or b"") for t in raw[at : at + 500].to_pylist()]
            self.learn(set().union(*words))
            for w in words:
                yield b"".join(map(self.__getitem__, w))


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own cache, kept between its tasks."""
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and `end_id`, cut only where longer than `capacity`.

    A null or empty text is a piece of one token. `doc_id` may be null or repeated; other columns are not read.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        for batch in batches:
            owner, places, sums = [], [], []
            for i, ids in enumerate(words.encode_all(batch.column(1))):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    owner.append(i)
                    places.append((k, at // 4, len(cut) // 4))
                    sums.append(zlib.crc32(cut))
            piece, start, length = np.array(places, dtype=np.int64).reshape(-1, 3).T
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Bin patterns as (how many bins, lengths in a bin) that use up `counts` (pieces of each length).

    A bin is filled greedily with the longest piece that still fits. Then its smallest piece is taken out and, where two
    unpacked pieces fit the expanded gap more tightly, they replace it. The pattern is applied as often as the counts
    allow, so each step uses up some length and there are at most a few patterns for each distinct length.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    lengths = np.arange(capacity + 1)
    out: list[tuple[int, list[int]]] = []
    while left.any():
        take = left.copy()
        bin_: list[int] = []
        gap = capacity
        while gap > 0:
            fit = np.flatnonzero(take[1 : gap + 1])
            if not len(fit):
                break
            longest = int(fit[-1]) + 1
            bin_.append(longest)
            take[longest] -= 1
            gap -= longest
        if gap and len(bin_) > 1:
            smallest = bin_[-1]
            room = gap + smallest
            # For each first length, the longest second one that fits beside it.
            known = np.where(take > 0, lengths, 0)
            longest_upto = np.maximum.accumulate(known)
            first = np.flatnonzero(take[: room + 1])
            first = first[first > 0]
            if len(first):
                second = longest_upto[room - first]
                same = (second == first) & (take[first] < 2)
                if same.any():
                    below = longest_upto[np.maximum(first - 1, 0)]
                    second = np.where(same, np.minimum(below, second), second)
                total = np.where(second > 0, first + second, 0)
                best = int(np.argmax(total))
                if total[best] > smallest:
                    bin_[-1:] = sorted((int(first[best]), int(second[best])), reverse=True)
        used: dict[int, int] = {}
        for x in bin_:
            used[x] = used.get(x, 0) + 1
        times = min(int(left[x]) // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= times * n
        out.append((times, bin_))
    return out


def slots(patterns: list[tuple[int, list[int]]]) -> pd.DataFrame:
    """One row for each place in a pattern: pieces of `length` with ranks from `rank` on take it in the bins from `bin` on."""
    rows, taken, at = [], {}, 0
    for times, bin_ in patterns:
        offset = 0
        for x in bin_:
            rows.append((x, taken.get(x, 0), times, at, offset))
            taken[x] = taken.get(x, 0) + times
            offset += x
        at += times
    return pd.DataFrame(rows, columns=["length", "rank", "times", "bin", "offset"]).sort_values(["length", "rank"], ignore_index=True)


def pack(items: DataFrame, capacity: int = 4096, blocks: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` from 1 to `capacity`.

    Every sequence is gapless from offset 0 and no longer than `capacity`. Rows of one length are ranked in `blocks`
    parts (by a hash of the piece), so that a length that a third of all rows share is ranked by many tasks. The table of
    places that is sent to the tasks has a few rows for each distinct length: it is bounded by `capacity`, not by the
    corpus. An empty table stays empty; repeated rows each get a place of their own.
    """
    items = items.withColumn("block_", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int"))
    items = materialize(items, "pieces")
    by_block = materialize(items.groupBy("length", "block_").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = slots(best_two_fit(counts, capacity))
    table = {k: places[k].to_numpy(dtype=np.int64) for k in places}
    key = table["length"] << 44 | table["rank"] if len(places) else np.zeros(0, dtype=np.int64)

    from pyspark.sql import Window

    before = F.sum("n").over(Window.partitionBy("length").orderBy("block_").rowsBetween(Window.unboundedPreceding, -1))
    starts = by_block.select("length", "block_", F.coalesce(before, F.lit(0)).alias("before_"))
    local = F.row_number().over(Window.partitionBy("length", "block_").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = items.withColumn("local_", local).join(starts, ["length", "block_"]).withColumn("rank_", F.col("before_") + F.col("local_"))
    ranked = ranked.drop("block_", "local_", "before_")
    names = [c for c in items.columns if c != "block_"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(np.int64), pdf["rank_"].to_numpy(np.int64)
            at = np.searchsorted(key, length << 44 | rank, side="right") - 1
            out = pdf[names].copy()
            out["sequence_id"] = table["bin"][at] + rank - table["rank"][at]
            out["offset"] = table["offset"][at]
            yield out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema if f.name in names)
    return ranked.select(*names, "rank_").mapInPandas(place, f"{schema}, sequence_id long, offset long")
