"""Language-model scores by online logistic context mixing of hashed-context bit predictors.

A token (a word, or the end of a text) is sent as the `CODE_BITS` leading bits of its hash, most significant first, and
then as itself among the tokens with that code. The code's bits are predicted by three predictors whose contexts are the
bits so far with nothing else, with the token before, and with the two tokens before. Each predictor predicts from the
bits that followed its context, known by its hash, in all training texts; an occurrence that is itself being scored is
left out of the counts, so that training and other texts are scored alike. In a text, the predictions are mixed in the
logistic domain: a gate, the evidence of the longest context, picks the weights to start from, and sets of factors, one
a bit's position, move along the coding error's gradient after each bit; an adaptive probability map refines the mixed
prediction. Factors and map start anew in each text, so its score doesn't depend on how the table is dealt out. What is
left of the token, given its code, has its smoothed unigram probability, so the bits a text costs are those of a
compressor.

All that is gathered grows with the corpus: there is no table of fixed size. Texts are read once into batches of tokens.
A batch's distinct words and contexts, not its occurrences, go with their counts to the fragment of the hash space that
they belong to, so a common word is one entry a batch; the fragment adds up all batches' counts and sends each batch the
predictions for its own entries. What is broadcast is the table of codes, `NODES` entries.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.shared_store import materialize
from textloom.llm.worker_memory import gives_back

CODE_BITS = 10
NODES = 1 << CODE_BITS
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))  # no word holds white space
CACHE_WORDS = 150_000
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: A batch ends with the text that reaches one of these.
BATCH_TOKENS, BATCH_TEXTS = 2_000_000, 4096
#: Tokens for each fragment, about; a token has an entry for each context at most.
FRAGMENT_TOKENS = 2_000_000
#: Predictions are natural logarithms of odds in halves, up to LIMIT of them.
SCALE, LIMIT = 2, 15
#: Weights to start from, of the three predictors (columns), without, with little and with more evidence of two tokens.
START_WEIGHTS = np.array([[0.3, 0.8, 0.0], [0.15, 0.6, 0.6], [0.05, 0.35, 0.9]], dtype=np.float32)
MUCH = 3
RATE = np.float32(0.01)
MAP_CELLS = 24


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = WordHash()


def word_hashes() -> WordHash:
    """The Python worker's own cache, kept between its tasks."""
    return _HASHES


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * M1
    h = (h ^ (h >> np.uint64(33))) * M2
    return h ^ (h >> np.uint64(33))


def token_hashes(text: str | None, words: WordHash) -> np.ndarray:
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.empty(len(found) + 1, dtype=np.uint64)
    h[:-1] = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    h[-1] = END
    return h


def contexts(h: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the one and the two tokens before each token; `fresh` marks a text's first tokens."""
    zero = np.zeros_like(h[:1])
    before = np.where(fresh, np.uint64(0), np.concatenate([zero, h[:-1]]))
    c1 = mix(before + np.uint64(1))
    c2 = mix(np.where(fresh, np.uint64(0), np.concatenate([zero, c1[:-1]])) + before * np.uint64(3))
    return c1, c2


def codes(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CODE_BITS)).astype(np.int64)


def context_bits(tokens: int) -> int:
    """Bits of a context's hash that are kept: with so many more than tokens have, one context in 2^15 meets another."""
    return min(54, max(40, tokens.bit_length() + 15))


def context_keys(h: np.ndarray, fresh: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For the one and the two tokens before each token: `bits` of the context's hash and the token's code in one number."""
    code = codes(h).astype(np.uint64)
    return tuple(c >> np.uint64(64 - bits) << np.uint64(CODE_BITS) | code for c in contexts(h, fresh))


def planes(x: np.ndarray) -> bytes:
    """The bytes of the numbers, first all lowest ones, compressed."""
    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def from_planes(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(size, -1).T).view(dtype).ravel()


def steps_of(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def is_training(doc_id="doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 != 2


def by_frequency(n: np.ndarray) -> np.ndarray:
    """Places of the counts `n`, the largest first."""
    return np.argsort(-n.astype(np.int64), kind="stable")


BATCH = "batch long, train boolean, tokens long, ids binary, null_ids binary, bytes binary, lengths binary, words binary, n binary, at binary"


def _batches(docs: DataFrame) -> DataFrame:
    """Rows BATCH of (doc_id, none, train, text): distinct word hashes of some texts, their counts, and each token's place among them.

    Places go from the most to the least frequent word, so most are small numbers. A batch has training texts only or none.
    """

    @gives_back
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, number = word_hashes(), TaskContext.get().partitionId() << 32
        held = {True: [], False: []}
        tokens = {True: 0, False: 0}

        def batch(train: bool) -> pd.DataFrame:
            nonlocal number
            rows, held[train], tokens[train], number = held[train], [], 0, number + 1
            distinct, at, n = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True, return_counts=True)
            place = np.empty(len(distinct), dtype=np.uint16 if len(distinct) <= 1 << 16 else np.uint32)
            place[by_frequency(n)] = np.arange(len(distinct))
            ids = np.array([r[0] for r in rows], dtype=np.int64)
            sizes = np.array([r[1] for r in rows], dtype=np.int64)
            lengths = np.array([len(r[2]) for r in rows], dtype=np.int64)
            none = np.array([r[3] for r in rows], dtype=bool)
            return pd.DataFrame([(number - 1, train, int(lengths.sum()), planes(ids), none.tobytes(), planes(sizes), planes(lengths), steps_of(distinct), planes(n.astype(np.uint32)), planes(place[at]))], columns=[c.split()[0] for c in BATCH.split(", ")])

        for pdf in frames:
            for i, none, train, text in pdf[["doc_id", "none", "train", "text"]].itertuples(index=False):
                h = token_hashes(text, words)
                held[train].append((i, len(text.encode("utf-8", "replace")), h, none))
                tokens[train] += len(h)
                if tokens[train] >= BATCH_TOKENS or len(held[train]) >= BATCH_TEXTS:
                    yield batch(train)
        for train in (True, False):
            if held[train]:
                yield batch(train)

    return materialize(docs.mapInPandas(read, BATCH), "batches")


def _tokens(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a row BATCH: distinct words, each token's place there, its hash, whether it is a text's first, texts' lengths."""
    lengths, words = from_planes(row.lengths, np.int64), from_steps(row.words)
    at = by_frequency(from_planes(row.n, np.uint32))[from_planes(row.at, np.uint16 if len(words) <= 1 << 16 else np.uint32)]
    fresh = np.zeros(len(at), dtype=bool)
    fresh[np.r_[0, np.cumsum(lengths)[:-1]]] = True
    return words, at, words[at], fresh, lengths


SENT = "frag long, batch long, kind int, train boolean, keys binary, n binary"


def _pieces(row, kind: int, keys: np.ndarray, n: np.ndarray, fragments: int, bits: int) -> pd.DataFrame:
    """The sorted keys of `bits` bits, cut where a fragment of the key space ends."""
    width = 2**bits // fragments + 1
    cuts = np.searchsorted(keys, np.array([f * width for f in range(1, fragments)], dtype=np.uint64))
    bounds = np.r_[0, cuts, len(keys)]
    rows = [(kind * fragments + f, row.batch, kind, row.train, steps_of(keys[a:b]), planes(n[a:b])) for f, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SENT.split(", ")])


def _counted(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a fragment's rows SENT: distinct keys, their training counts, each entry's place there, where each row begins."""
    keys = [from_steps(k) for k in pdf["keys"]]
    n = np.concatenate([from_planes(x, np.uint32) * np.uint32(t) for x, t in zip(pdf["n"], pdf["train"], strict=True)])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(at, weights=n, minlength=len(distinct)), at, np.r_[0, np.cumsum([len(k) for k in keys])]


def _word_counts(batches: DataFrame, fragments: int) -> DataFrame:
    """Rows (batch, kind 0, frag, data): training counts of the batch's words; and (-1, 3, frag, data): code, tokens, words."""

    @gives_back
    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                yield _pieces(row, 0, from_steps(row.words), from_planes(row.n, np.uint32), fragments, 64)

    @gives_back
    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        distinct, n, at, begin = _counted(pdf)
        n = n.astype(np.int64)
        own = [(b, 0, f, planes(n[at[x:y]])) for b, f, x, y in zip(pdf["batch"], pdf["frag"], begin[:-1], begin[1:], strict=True)]
        used, back = np.unique(codes(distinct), return_inverse=True)
        sums = np.stack([used, np.bincount(back, weights=n).astype(np.int64), np.bincount(back, weights=n > 0).astype(np.int64)])
        return pd.DataFrame([*own, (-1, 3, pdf["frag"].iloc[0], sums.tobytes())], columns=["batch", "kind", "frag", "data"])

    return materialize(batches.mapInPandas(send, SENT).groupBy("frag").applyInPandas(total, "batch long, kind int, frag long, data binary"), "word_counts")


def log_odds(same: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(np.log((same + 0.2) / (other + 0.2)) * SCALE), -LIMIT, LIMIT).astype(np.int8)


def path_odds(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the sorted context keys with counts: log odds of the code's own bit, for each bit on the way to the key's code.

    Two arrays of a column a bit: for an occurrence that is not in the counts, and for one that is and is left out.
    """
    out = np.empty((2, len(keys), CODE_BITS), dtype=np.int8)
    above = None
    for b in range(CODE_BITS + 1):
        prefix = keys >> np.uint64(CODE_BITS - b)
        begin = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
        below = np.repeat(np.add.reduceat(n, begin), np.diff(np.r_[begin, len(keys)])).astype(np.float32)
        if above is not None:
            out[0, :, b - 1] = log_odds(below, above - below)
            out[1, :, b - 1] = log_odds(np.maximum(below - 1, 0), above - below)
        above = below
    return out[0], out[1]


def new_bits(keys: np.ndarray) -> np.ndarray:
    """For each bit of the sorted keys' codes, a row: whether the way to it isn't that of the key before."""
    apart = np.concatenate([~np.zeros_like(keys[:1]), keys[1:] ^ keys[:-1]])
    return apart >> np.arange(CODE_BITS - 1, -1, -1, dtype=np.uint64)[:, None] != 0


def _like(columns: np.ndarray, b: int, rows: np.ndarray) -> np.ndarray:
    """Order of the `rows` by what is known of them before their bit b: the two bits before it."""
    one, two = (columns[c][rows].astype(np.int16) if c >= 0 else np.int16(0) for c in (b - 1, b - 2))
    return np.argsort(one * np.int16(2 * LIMIT + 1) + two, kind="stable") if b else np.arange(np.count_nonzero(rows))


def packed_odds(odds: np.ndarray, keys: np.ndarray | None = None) -> bytes:
    """Rows of path_odds(), compressed: of the code's own bit, which the batch knows, so like contexts have like rows whatever the codes.

    Bit by bit, rows that are alike so far side by side. With the rows' sorted `keys`, a bit that a key shares with the
    key before it is sent once: its odds are the same.
    """
    columns = np.ascontiguousarray(odds.T)
    new = np.ones(columns.shape, dtype=bool) if keys is None else new_bits(keys)
    parts = [columns[b][new[b]][_like(columns, b, new[b])].tobytes() for b in range(CODE_BITS)]
    return np.array([len(odds), keys is not None], dtype="<u4").tobytes() + zstandard.compress(b"".join(parts), 1)


def _unpacked(keys: np.ndarray, data: bytes) -> np.ndarray:
    """A row of odds for each bit, from packed_odds() of the first of `keys`."""
    size, by_key = np.frombuffer(data, dtype="<u4", count=2).tolist()
    values, at = np.frombuffer(zstandard.decompress(data[8:]), dtype=np.int8), 0
    columns = np.empty((CODE_BITS, size), dtype=np.int8)
    new = new_bits(keys[:size]) if by_key else np.ones(columns.shape, dtype=bool)
    for b in range(CODE_BITS):
        order = _like(columns, b, new[b])
        own = np.empty(len(order), dtype=np.int8)
        own[order] = values[at : at + len(order)]
        columns[b], at = own[np.cumsum(new[b]) - 1], at + len(order)
    return columns


def odds_of_ones(keys: np.ndarray, data: Iterable[bytes]) -> np.ndarray:
    """Log odds of ones for the sorted `keys`, from packed_odds() of parts of them in turn."""
    odds, at = np.empty((len(keys), CODE_BITS), dtype=np.int8), 0
    for x in data:
        columns = _unpacked(keys[at:], x)
        odds[at : at + columns.shape[1]] = columns.T
        at += columns.shape[1]
    for b in range(CODE_BITS):
        odds[:, b] *= (2 * (keys >> np.uint64(CODE_BITS - 1 - b) & np.uint64(1)).astype(np.int8) - 1).astype(np.int8)
    return odds


def _predictions(batches: DataFrame, fragments: int, bits: int) -> DataFrame:
    """Rows (batch, kind, frag, data): log odds of the batch's distinct keys with one (kind 1) and two tokens of context."""

    @gives_back
    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                _, _, h, fresh, _ = _tokens(row)
                for kind, keys in enumerate(context_keys(h, fresh, bits), 1):
                    keys, n = np.unique(keys, return_counts=True)
                    yield _pieces(row, kind, keys, n.astype(np.uint32), fragments, bits + CODE_BITS)

    @gives_back
    def predict(pdf: pd.DataFrame) -> pd.DataFrame:
        distinct, n, at, begin = _counted(pdf)
        odds = path_odds(distinct, n)
        rows = [(b, k, f, packed_odds(odds[int(t)][at[x:y]], distinct[at[x:y]])) for b, k, f, t, x, y in zip(pdf["batch"], pdf["kind"], pdf["frag"], pdf["train"], begin[:-1], begin[1:], strict=True)]
        return pd.DataFrame(rows, columns=["batch", "kind", "frag", "data"])

    return batches.mapInPandas(send, SENT).groupBy("frag").applyInPandas(predict, "batch long, kind int, frag long, data binary")


def node_odds(n: np.ndarray) -> np.ndarray:
    """Log odds of ones of the predictor without a token of context, for each node, from the codes' counts."""
    out = np.zeros(NODES, dtype=np.int8)
    for b in range(CODE_BITS):
        below = n.reshape(1 << b, 2, -1).sum(axis=2)
        out[1 << b : 2 << b] = log_odds(below[:, 1], below[:, 0])
    return out


def code_log10(lengths: np.ndarray, code: np.ndarray, order0: np.ndarray, order1: np.ndarray, order2: np.ndarray, steps: int = 32, group: int = 4096) -> np.ndarray:
    """log10 of the probability of each text's codes, the texts side by side, a bit of each at a time.

    `code` has the texts' codes one after the other; `order0` log odds for each node, `order1` and `order2` a row of
    them for each token, a column a bit.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    out = np.zeros(len(lengths))
    f = np.float32
    for at in range(0, len(order), group):
        rows = order[at : at + group]
        n, begin, d = lengths[rows], starts[rows], len(rows)
        w = np.ones((CODE_BITS, 3, d), dtype=f)
        centers = (np.arange(MAP_CELLS) - (MAP_CELLS - 1) / 2) / 1.5
        apm = np.repeat((1 / (1 + np.exp(-centers))).astype(f)[:, None], d, axis=1).ravel()
        cost = np.zeros(d)
        texts_at = np.arange(d)
        for t0 in range(0, int(n[0]), steps):
            k = int(np.searchsorted(-n, -t0, side="left"))  # texts with more than t0 tokens
            t1 = min(t0 + steps, int(n[0]))
            idx = np.minimum(begin[:k] + np.arange(t0, t1)[:, None], len(code) - 1)
            own = code[idx]
            two = order2[idx].transpose(0, 2, 1)
            gate = np.abs(two) >= MUCH
            gate = gate.astype(np.int8) + (two != 0)
            inputs = np.empty((t1 - t0, CODE_BITS, 3, k), dtype=f)
            bits = np.empty((t1 - t0, CODE_BITS, k), dtype=f)
            for b in range(CODE_BITS):
                inputs[:, b, 0] = order0.take((own >> (CODE_BITS - b)) | (1 << b))
                bits[:, b] = own >> (CODE_BITS - 1 - b) & 1
            inputs[:, :, 1] = order1[idx].transpose(0, 2, 1)
            inputs[:, :, 2] = two
            for j in range(3):
                inputs[:, :, j] *= (START_WEIGHTS[:, j] / f(SCALE)).take(gate)
            right = np.ones((t1 - t0, CODE_BITS, k), dtype=f)
            counts = (np.arange(t0, t1)[:, None] < n[:k]).sum(axis=1)
            for t in range(t1 - t0):
                m = int(counts[t])
                # Each bit's position has factors of its own, so all bits of a token are mixed at once; the map is theirs together.
                x, y, ws = inputs[t, :, :, :m], bits[t, :, :m], w[:, :, :m]
                parts = ws * x
                dot = parts[:, 0] + parts[:, 1]
                dot += parts[:, 2]
                np.maximum(dot, f(-7.9), out=dot)
                np.minimum(dot, f(7.9), out=dot)
                p = np.exp(-dot)
                p += f(1)
                np.reciprocal(p, out=p)
                err = y - p
                err *= RATE
                np.multiply(x, err[:, None], out=parts)
                ws += parts
                dot *= f(1.5)
                dot += f(MAP_CELLS / 2)
                cell = dot.astype(np.intp)
                cell *= d
                cell += texts_at[:m]
                step = y * f(0.02)
                refined = err  # whose values have been used
                for at_bit, r, up in zip(cell, refined, step):
                    apm.take(at_bit, out=r, mode="clip")  # cells lie in the map; "raise" would copy
                    up += r * f(0.98)
                    apm[at_bit] = up
                p *= f(0.7)
                refined *= f(0.3)
                p += refined
                p += y
                p -= f(1)
                np.abs(p, out=right[t, :, :m])  # the probability of the bit that came
            cost[:k] += np.log10(np.clip(right, 1e-5, 1)).sum(axis=(0, 1), dtype=np.float64)
        out[rows] = cost
    return out


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row of (doc_id, text).

    Learns from the rows whose crc32(doc_id as text) mod 7 is not 2. In `score`, an occurrence in a training row is left
    out of the counts that predict it; `base_score` counts all. A null text is empty; an empty text is its end alone.
    A null doc_id counts as an empty text in that rule and is kept. Repeated rows are learned from as often as they occur
    and give equal results each. An empty table gives an empty result; other columns are not read. bits_per_byte is null
    for an empty text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    batches = _batches(docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), is_training().alias("train"), "text"))
    tokens = batches.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    fragments, bits = max(8, -(-tokens // FRAGMENT_TOKENS)), context_bits(tokens)
    counts = _word_counts(batches, fragments)
    of_code, words_of_code = np.zeros(NODES, dtype=np.int64), np.zeros(NODES, dtype=np.int64)
    for (data,) in counts.where("kind = 3").select("data").toLocalIterator():
        code, n, v = np.frombuffer(data, dtype=np.int64).reshape(3, -1)
        of_code[code] += n
        words_of_code[code] += v
    total, known_words = int(of_code.sum()), int(words_of_code.sum())
    order0 = node_odds(of_code)
    rest = (of_code + words_of_code + 1).astype(np.float64)

    @gives_back
    def run(batch: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        row = next(batch.itertuples(index=False))
        words, at, h, fresh, lengths = _tokens(row)
        parts = parts.sort_values("frag")
        c = np.concatenate([from_planes(x, np.int64) for x in parts.loc[parts["kind"] == 0, "data"]])
        code = codes(h)
        odds = []
        for kind, keys in enumerate(context_keys(h, fresh, bits), 1):
            distinct, back = np.unique(keys, return_inverse=True)
            odds.append(odds_of_ones(distinct, parts.loc[parts["kind"] == kind, "data"])[back])
        begin, own = np.r_[0, np.cumsum(lengths)[:-1]], int(row.train)
        base = np.add.reduceat(np.log10(c + 1.0)[at], begin) - lengths * np.log10(float(total + known_words + 1))
        word_code = codes(words)
        left = np.add.reduceat((np.log10(c + 1.0 - own) - np.log10(rest[word_code] - own))[at], begin)
        value = code_log10(lengths, code, order0, *odds) + left
        size = from_planes(row.bytes, np.int64)
        return pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(from_planes(row.ids, np.int64), np.frombuffer(row.null_ids, dtype=bool).copy()),
            "held_out": not row.train, "n_tokens": lengths, "n_known": np.add.reduceat((c > 0).astype(np.int64)[at], begin),
            "train_tokens": total, "base_score": base, "score": value,
            "bits_per_byte": pd.arrays.FloatingArray(-value * np.log2(10) / np.maximum(size, 1), size == 0),
        })

    parts = counts.where("kind = 0").unionByName(_predictions(batches, fragments, bits))
    return batches.groupBy("batch").cogroup(parts.groupBy("batch")).applyInPandas(run, RESULT)
