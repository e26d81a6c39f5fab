"""Byte-level BPE: texts to token ids with their places, and ids back to bytes.

Pre-tokens are found without a regular expression. Every code point has a class, every class is a function from states to
states, and functions compose associatively. The few functions that compositions can give are numbered, so a scan over
numbers gives the state before every code point of a whole batch at once: blocks are scanned side by side, their totals by
doubling steps, and both are put together. A pre-token begins where state, class and next class say so. The slices go
through a cache of merged pairs, and each token keeps the byte at which it begins.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import sys
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.worker_memory import gives_back

#: Slices in a worker's cache, and the longest that is kept (in bytes).
CACHE_PIECES, CACHE_BYTES = 300_000, 32
#: Code points looked at together; a longer text is taken by itself.
PART_CHARS = 1_000_000

# Classes of code points. SHORT, TWO, E and EL are letters, those that may follow an apostrophe ('s 't 'm 'd, 're 've, 'll).
SPACE, WHITE, LETTER, NUMBER, OTHER, QUOTE, SHORT, TWO, E, EL = CLASSES = range(10)
LETTERS, BLANKS, NO_NEXT = (LETTER, SHORT, TWO, E, EL), (SPACE, WHITE), 10
# States: what the last code point belongs to. AT_QUOTE: an apostrophe that begins a pre-token; AT_DONE: a whole contraction.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AT_SPACE, AT_WHITE, AT_QUOTE, AT_TWO, AT_EL, AT_DONE = STATES = range(10)

#: Letters and numbers that Unicode 16.0 added, which Python 3.13's tables (15.1) lack.
LETTERS_16 = """1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5
113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"""
NUMBERS_16 = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
#: White space of the pattern.
WHITE_SPACE = "9-D 20 85 A0 1680 2000-200A 2028-2029 202F 205F 3000"


def _ranges(text: str) -> Iterator[slice]:
    for part in text.split():
        low, _, high = part.partition("-")
        yield slice(int(low, 16), int(high or low, 16) + 1)


@functools.cache
def class_table() -> np.ndarray:
    """The class of each code point."""
    major = np.array([unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)])
    table = np.where(major == "L", LETTER, np.where(major == "N", NUMBER, OTHER)).astype(np.uint8)
    for kind, text in ((LETTER, LETTERS_16), (NUMBER, NUMBERS_16), (WHITE, WHITE_SPACE)):
        for span in _ranges(text):
            table[span] = kind
    for kind, chars in ((SPACE, " "), (QUOTE, "'"), (SHORT, "stmd"), (TWO, "rv"), (E, "e"), (EL, "l")):
        table[[ord(c) for c in chars]] = kind
    return table


def _after(state: int, kind: int) -> int:
    """The state after a code point of class `kind`."""
    if kind == QUOTE:  # within a run of signs, or after the space that such a run takes, it begins nothing
        return IN_OTHERS if state in (IN_OTHERS, AT_SPACE, AT_QUOTE) else AT_QUOTE
    special = {(AT_QUOTE, SHORT): AT_DONE, (AT_QUOTE, TWO): AT_TWO, (AT_QUOTE, EL): AT_EL, (AT_TWO, E): AT_DONE, (AT_EL, EL): AT_DONE}
    plain = {SPACE: AT_SPACE, WHITE: AT_WHITE, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    return special.get((state, kind), plain.get(kind, IN_LETTERS))


def _begins(state: int, kind: int, following: int) -> bool:
    """Whether a pre-token begins at a code point of class `kind`, between `state` and the class `following`."""
    if state == START:
        return True
    if kind in BLANKS:  # the last of several blanks stays with what follows, unless the text ends
        return state not in (AT_SPACE, AT_WHITE) or following not in (*BLANKS, NO_NEXT)
    if state == AT_SPACE:
        return False
    if kind in LETTERS:
        if state == AT_QUOTE:
            return not (kind == SHORT or (kind, following) in ((TWO, E), (EL, EL)))
        return state not in (IN_LETTERS, AT_TWO, AT_EL)
    if kind == NUMBER:
        return state != IN_NUMBERS
    return state not in (IN_OTHERS, AT_QUOTE)


def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, products, generators): what function f makes of each state, f and then g as a number, and the number of a
    class's function; 10 further on, of a class at the start of a text, which forgets all states. Function 0 is identity."""
    makers = [tuple(_after(s, k) for s in STATES) for k in CLASSES] + [(_after(START, k),) * len(STATES) for k in CLASSES]
    known = {tuple(STATES): 0}
    queue = list(known)
    for f in queue:
        for g in makers:
            both = tuple(g[s] for s in f)
            if both not in known:
                known[both] = len(known)
                queue.append(both)
    values = np.array(list(known), dtype=np.uint8)
    products = np.array([[known[tuple(g[s] for s in f)] for g in known] for f in known], dtype=np.uint8)
    return values, products, np.array([known[g] for g in makers], dtype=np.uint8)


VALUES, PRODUCTS, GENERATORS = _functions()
BEGINS = np.array([[[_begins(s, k, n) for n in range(NO_NEXT + 1)] for k in CLASSES] for s in STATES])


def scan(steps: np.ndarray, rows: int = 256) -> np.ndarray:
    """The state after each step, from START: prefix products of functions given by their numbers."""
    n, many, flat = len(steps), len(PRODUCTS), PRODUCTS.ravel()
    if not n:
        return np.zeros(0, dtype=np.uint8)
    columns = -(-n // rows)
    f = np.zeros(columns * rows, dtype=np.uint8)  # padded with the identity
    f[:n] = steps
    f = np.ascontiguousarray(f.reshape(columns, rows).T)
    for t in range(1, rows):  # within blocks, all of them side by side
        f[t] = flat[f[t - 1].astype(np.intp) * many + f[t]]
    total, reach = f[-1].copy(), 1
    while reach < columns:  # over the blocks' totals
        total[reach:] = flat[total[:-reach].astype(np.intp) * many + total[reach:]]
        reach *= 2
    entry = np.concatenate(([START], VALUES[total[:-1], START])).astype(np.intp)
    states = VALUES.ravel()[f.astype(np.intp) * len(STATES) + entry]
    return states.T.reshape(-1)[:n]


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions in `points` (code points of texts in a row) where pre-tokens begin; texts begin at `first`."""
    kinds = class_table()[points]
    steps = kinds.copy()
    steps[first] += len(CLASSES)
    before = np.empty_like(kinds)
    before[1:] = scan(GENERATORS[steps])[:-1]
    before[first] = START
    following = np.empty_like(kinds)
    following[:-1] = kinds[1:]
    following[-1:] = NO_NEXT
    following[first[1:] - 1] = NO_NEXT
    return np.flatnonzero(BEGINS.ravel()[(before.astype(np.intp) * len(CLASSES) + kinds) * (NO_NEXT + 1) + following])


class Pairs(dict):
    """Slices' ids as little-endian bytes, of at most CACHE_PIECES slices or of those of one part of the texts.

    The slices that a part of the texts brings anew are merged side by side; those of more than CACHE_BYTES one by one, and
    they aren't kept.
    """

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes = _Table(self.tokens)
        self.decimals = _Table([b"%d," % i for i in range(len(self.tokens))])
        self.single = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int64)
        # Every way to put a token together from two.
        halves = sorted((self.ranks[t[:i]] << 32 | self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks)
        self.halves, self.wholes = np.array(halves, dtype=np.int64).reshape(-1, 2).T.copy()

    def __missing__(self, piece: bytes) -> bytes:
        return np.array(self.merge(piece), dtype="<u4").tobytes()

    def learn(self, pieces: set[bytes]) -> None:
        new = [p for p in pieces if p not in self and len(p) <= CACHE_BYTES]
        if len(self) + len(new) > CACHE_PIECES and len(self):
            self.clear()
            return self.learn(pieces)
        self.update((p, np.array([self.ranks[p]], dtype="<u4").tobytes()) for p in new if p in self.ranks)
        new = sorted((p for p in new if p not in self.ranks), key=len)
        for at in range(0, len(new), 8192):
            self._merge_all(new[at : at + 8192])

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token of two neighbours, which is its rank; a number above all ranks if there is none."""
        key = left << 32 | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.halves, key), len(self.halves) - 1)
        return np.where((right >= 0) & (left >= 0) & (self.halves[at] == key), self.wholes[at], len(self.tokens))

    def _merge_all(self, pieces: list[bytes]) -> None:
        """Of each piece (in order of length) the lowest of its pairs is merged, the leftmost of equal ones, until none is left."""
        sizes, none = np.array([len(p) for p in pieces]), len(self.tokens)
        width = int(sizes[-1])
        parts = np.full((len(pieces), width + 1), -1, dtype=np.int64)  # and one more, which stays empty
        parts[np.arange(width + 1) < sizes[:, None]] = self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        pair = self._merged(parts[:, :-1], parts[:, 1:])
        live, column = np.arange(len(pieces)), np.arange(width + 1)
        done = np.empty_like(parts)
        while True:
            place = pair.argmin(axis=1)
            rank = pair[np.arange(len(live)), place]
            over = rank == none
            done[live[over]] = parts[over]
            if over.all():
                break
            live, parts, pair, place, rank = live[~over], parts[~over], pair[~over], place[~over], rank[~over]
            row = np.arange(len(live))
            moved = np.minimum(column + (column > place[:, None]), width)
            parts = np.take_along_axis(parts, moved, axis=1)
            parts[row, place] = rank
            pair = np.take_along_axis(pair, np.minimum(moved[:, :-1], width - 1), axis=1)
            pair[:, -1] = none
            pair[row, place] = self._merged(rank, parts[row, place + 1])
            more = place > 0
            row, place = row[more], place[more]
            pair[row, place - 1] = self._merged(parts[row, place - 1], parts[row, place])
        ends = (4 * (done >= 0).sum(axis=1)).tolist()
        raw, step = done.astype("<u4").tobytes(), 4 * (width + 1)
        self.update((p, raw[i * step : i * step + n]) for i, (p, n) in enumerate(zip(pieces, ends)))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice of any length, by a heap of its pairs."""
        ranks, n = self.ranks, len(piece)
        if piece in ranks:
            return [ranks[piece]]
        after, before = list(range(1, n + 1)), list(range(-1, n))  # parts begin where `after` isn't -1
        heap = [(ranks[piece[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
        heapify(heap)
        while heap:
            _, i, middle, end = heappop(heap)
            if after[i] != middle or after[middle] != end:
                continue  # one of the two has grown since
            after[i], after[middle], before[end] = end, -1, i
            for low, mid, high in ((before[i], i, end), (i, end, after[end] if end < n else n + 1)):
                if low >= 0 and high <= n and (rank := ranks.get(piece[low:high])) is not None:
                    heappush(heap, (rank, low, mid, high))
        return [ranks[piece[i : after[i]]] for i in range(n) if after[i] > 0]


class _Table:
    """Byte strings by number, looked up for whole arrays of numbers."""

    def __init__(self, items: list[bytes]):
        self.flat = np.frombuffer(b"".join(items), dtype=np.uint8)
        self.sizes = np.array([len(x) for x in items], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def joined(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(all strings in a row, the place of each and of the end)."""
        sizes = self.sizes[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(self.starts[ids] - ends[:-1], sizes)
        at += np.arange(len(at))
        return self.flat[at].tobytes(), ends


_PAIRS: dict[str, Pairs] = {}


def pairs(path: str) -> Pairs:
    """The worker's own cache, kept between its tasks."""
    if path not in _PAIRS:
        _PAIRS[path] = Pairs(path)
    return _PAIRS[path]


def _parts(texts: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
    """(bytes in a row, places where texts begin and the last ends) for some texts at a time; null is empty, and bytes that
    aren't UTF-8 are replaced by U+FFFD."""
    raw = texts.cast(pa.binary())
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(raw), 0))
    if not len(sizes):
        return
    group = np.cumsum(sizes) // PART_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        items = [x or b"" for x in raw[a:b].to_pylist()]
        joined = b"".join(items)
        try:
            joined.decode()
        except UnicodeDecodeError:
            items = [x.decode("utf-8", "replace").encode() for x in items]
            joined = b"".join(items)
        yield joined, np.concatenate(([0], np.cumsum([len(x) for x in items])))


def encode_part(raw: bytes, bounds: np.ndarray, merged: Pairs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, the byte where each begins in its text, places in ids where texts begin and the last ends)."""
    if not raw:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.zeros(len(bounds), dtype=np.int64)
    points = np.frombuffer(raw.decode().encode("utf-32-le"), dtype=np.uint32)
    lead = np.flatnonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)  # the first byte of each code point
    texts = bounds[:-1][np.diff(bounds) > 0]
    at = lead[piece_starts(points, np.searchsorted(lead, texts))]
    places = [*at.tolist(), len(raw)]
    pieces = [raw[a:b] for a, b in zip(places, places[1:])]
    merged.learn(set(pieces))
    found = list(map(merged.__getitem__, pieces))
    count = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4)))
    ids = np.frombuffer(b"".join(found), dtype="<u4")
    sizes = merged.bytes.sizes[ids]
    cuts = count[np.searchsorted(at, bounds)]
    starts = np.cumsum(sizes) - sizes
    return ids, starts - np.repeat(bounds[:-1], np.diff(cuts)), cuts


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, starts): of each whole text its token ids, and the byte of its UTF-8 form where each token begins.

    `path` is a file of ranks, as one line of base64 and rank for each token; no special tokens are known. A null or empty
    text has no ids. Ids of rows may be null or repeated, rows are encoded one by one; other columns are not read. A text is
    never cut: it must fit a task, and its longest slice costs n log n steps.
    """

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = pairs(path)
        for batch in batches:
            row = 0
            for raw, bounds in _parts(batch.column(1)):
                ids, starts, cuts = encode_part(raw, bounds, merged)
                lists = (pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x.astype(np.int32))) for x in (ids, starts))
                yield pa.RecordBatch.from_arrays([batch.column(0)[row : row + len(bounds) - 1], *lists], ["doc_id", "ids", "starts"])
                row += len(bounds) - 1

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, ids array<int>, starts array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes) of rows (doc_id, ids): what the ids stand for. A null or empty list gives no bytes; any slice of a
    text's ids can be decoded, which may begin or end within a code point. An id beyond the table is an error."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pairs(path).bytes
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
            raw, ends = table.joined(np.asarray(pa.compute.list_flatten(lists)))
            cuts = ends[np.concatenate(([0], np.cumsum(sizes)))].tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())], ["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each text's ids and of the bytes that they decode to.

    Texts go to Python once: encode_part() and the table that decode() looks in work on the same part of a batch.
    """

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = pairs(path)
        sha = lambda raw, a, b: hashlib.sha256(raw[a:b]).hexdigest()
        for batch in batches:
            row = 0
            for raw, bounds in _parts(batch.column(1)):
                ids, _, cuts = encode_part(raw, bounds, merged)
                names, name_ends = merged.decimals.joined(ids)
                out, ends = merged.bytes.joined(ids)
                n, m = name_ends[cuts].tolist(), ends[cuts].tolist()
                columns = [
                    batch.column(0)[row : row + len(bounds) - 1], pa.array(np.diff(cuts)),
                    pa.array([sha(names, a, max(a, b - 1)) for a, b in zip(n, n[1:])], pa.string()), pa.array([sha(out, a, b) for a, b in zip(m, m[1:])], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                row += len(bounds) - 1

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
