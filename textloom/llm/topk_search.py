"""Exact top-k BM25 search: an inverted index with block bounds in shards, searched by WAND's pivot and block-max bounds.

A shard is a run of documents that one task reads; it is indexed where it is read, so texts are never shuffled, and kept
as packed arrays in the shared folder: of each term its postings in ascending order of documents, of which the largest
score is known for the term and for each block of documents (block-max WAND, Ding and Suel, 2011). Document frequencies,
the number of documents and their mean length are those of the whole corpus, so scores of all shards are comparable and
the k best of the shards' k best are the k best of all.

Queries are searched in blocks of a bounded size, each sent to all tasks that hold shards, and within a task many at a
time. WAND's pivot: with a query's terms in rising order of their bounds, those before the pivot can't reach a small share
of the k-th best score together, so they are looked at only in documents that nearly reach it with the others. Rare terms are
added up along their postings. With the bounds of the common terms in a block of documents their sums tell which blocks may hold
an answer, and only there the common terms, kept as a table, are added up by a matrix product; the documents that then may
be answers are scored whole. Documents of a shard stand by their commonest term and by length, and queries likewise, so that blocks
differ. The k-th best score rises from shard to shard of a task, and every shard starts from that of a few pilot shards,
which are searched first: so shards return few rows that aren't answers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.shared_store import materialize

K1, B = 1.2, 0.75
#: Documents in a block.
BLOCK = 64
#: Blocks that are multiplied together, for the queries that may have answers in one of them.
BLOCKS = 4
CACHE_WORDS = 150_000
#: Characters of text in a shard, about, and documents at most: bounds what is indexed at a time.
SHARD_CHARS = 16 << 20
SHARD_DOCS = 60_000
#: Terms of the queries that are searched at a time, about.
BLOCK_TERMS = 600_000
#: Terms in at least one of so many of a shard's documents are in its table, as long as that has no more cells.
COMMON, TABLE_CELLS = 32, 4_000_000
#: Queries whose common terms are added up at a time.
TOGETHER = 128
#: Postings of rare terms that are added up at a time.
CHUNK = 1 << 17
#: The share of the least score that terms before the pivot may reach together: a lower one leaves fewer documents.
PIVOT = 0.02
#: Sums in single precision are true to this share: all their terms are positive, and there are a few thousand at most.
ROUNDING = 1e-3


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def term_id(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - 2**63


def idf(n: float, df: np.ndarray) -> np.ndarray:
    return np.log(1 + (n - df + 0.5) / (df + 0.5))


class TermIds(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = x = term_id(word)
        return x


class Index:
    """Postings of a shard by term: documents in ascending order with their BM25 score, less the idf.

    Documents are in blocks of `BLOCK` by position; of each term, and of each term and block, the largest score is known.
    """

    def __init__(self, ids: np.ndarray, texts: list, mean_length: float):
        order = np.argsort(ids, kind="stable")
        self._load(unpacked(packed(ids[order], [texts[i] for i in order], TermIds())), mean_length)

    @classmethod
    def of(cls, row: dict, mean_length: float) -> Index:
        index = cls.__new__(cls)
        index._load(unpacked(row), mean_length)
        return index

    def _load(self, x: dict[str, np.ndarray], mean_length: float) -> None:
        self.ids, self.terms, self.docs = x["ids"], x["terms"], x["docs"]
        n = len(self.docs)
        self.entry_first = x["first"]  # of each term, and the end
        tf = x["tfs"].astype(np.float64)
        norm = K1 * (1 - B + B * x["lengths"].astype(np.float64) / max(mean_length, 1e-9))
        self.scores = tf * (K1 + 1) / (tf + norm[self.docs]) if n else tf
        term_of = np.repeat(np.arange(len(self.terms), dtype=np.int32), np.diff(self.entry_first))
        # The same postings by document, in the order of terms: equal documents have equal sums in every shard.
        by_doc = np.argsort(x["docs"], kind="stable")
        self.own_terms, self.own_scores = term_of[by_doc], self.scores[by_doc]
        self.doc_first = np.searchsorted(self.docs[by_doc], np.arange(len(self.ids) + 1)).tolist()
        self.top = np.maximum.reduceat(self.scores, self.entry_first[:-1]) if n else tf
        self.weight = np.zeros(len(self.terms))
        sizes = np.diff(self.entry_first)
        common = np.flatnonzero(sizes * COMMON >= max(1, len(self.ids)))
        common = common[np.argsort(-sizes[common], kind="stable")][: TABLE_CELLS // max(1, len(self.ids))]
        self.row = np.full(len(self.terms), -1, dtype=np.int32)  # of a term in the table
        self.row[common] = np.arange(len(common))
        self.table = np.zeros((len(common), len(self.ids)), dtype=np.float32)
        for r, a, b in zip(range(len(common)), self.entry_first[common].tolist(), self.entry_first[common + 1].tolist(), strict=True):
            self.table[r, self.docs[a:b]] = self.scores[a:b]
        starts = np.arange(0, len(self.ids), BLOCK)
        self.table_top = np.maximum.reduceat(self.table, starts, axis=1) if len(starts) else self.table
        self.skipped = 0  # blocks of all queries whose bounds were too low

    def postings(self, term: int) -> tuple | None:
        """(documents, scores) of a term."""
        i = int(np.searchsorted(self.terms, term))
        if i == len(self.terms) or self.terms[i] != term:
            return None
        x = slice(self.entry_first[i], self.entry_first[i + 1])
        return self.docs[x], self.scores[x]

    def search(self, terms: list[tuple[int, float]], k: int, skip: int | None = None) -> list[tuple[float, int]]:
        """The k best (score, doc_id), higher scores first, then smaller ids, without the id `skip`; exact."""
        terms = sorted(terms)
        score, ids = self.search_arrays(np.array([t for t, _ in terms], dtype=np.int64), np.array([w for _, w in terms], dtype=np.float64), k, skip)
        return list(zip(score.tolist(), ids.tolist(), strict=True))

    def search_arrays(self, term: np.ndarray, weight: np.ndarray, k: int, skip: int | None = None, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """search() for distinct terms in ascending order, of documents that score `least` or more: (scores, ids)."""
        return next(self.search_many([(term, weight, skip, least)], k))

    def search_many(self, queries: list[tuple], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """search_arrays() for each of some (term, weight, skip, least)."""
        n, m = len(queries), len(self.ids)
        if k <= 0 or not len(self.terms):
            yield from ((np.zeros(0), np.zeros(0, dtype=np.int64)) for _ in queries)
            return
        least = np.array([x[3] for x in queries], dtype=np.float64) * (1 - ROUNDING)
        at, weight, owner, low, rest = self._plan(queries, least)
        need = least - rest
        part = self._parts(at[~low], weight[~low], owner[~low], need)
        query, doc = np.divmod(np.flatnonzero((part > 0) & (part >= need[:, None])), m)
        first, own = (np.searchsorted(x, np.arange(n + 1)) for x in (query, owner))
        for q, (_, _, skip, asked) in enumerate(queries):
            x = slice(own[q], own[q + 1])
            found = self._cut(doc[first[q] : first[q + 1]], part[q], at[x], weight[x], low[x], least[q], k)
            score = self._scored(found, at[x], weight[x])
            keep = (score > 0) & (score >= asked)
            if skip is not None:
                keep &= self.ids[found] != skip
            score, ids = score[keep], self.ids[found[keep]]
            best = np.lexsort((ids, -score))[:k]
            yield score[best], ids[best]

    def _plan(self, queries: list[tuple], least: np.ndarray) -> tuple[np.ndarray, ...]:
        """(terms' places, weights, queries, whether they are before the query's pivot), and the bound of the latter by query.

        Of queries that can't reach `least` with all their terms nothing is left.
        """
        n = len(queries)
        term, weight = (np.concatenate([x[c] for x in queries]) for c in (0, 1))
        owner = np.repeat(np.arange(n), [len(x[0]) for x in queries])
        at = np.searchsorted(self.terms, term)
        at[at == len(self.terms)] = 0
        known = self.terms[at] == term
        at, weight, owner = at[known], weight[known], owner[known]
        bound = weight * self.top[at]
        some = (np.bincount(owner, bound, minlength=n) >= least)[owner]
        at, weight, owner, bound = at[some], weight[some], owner[some], bound[some]
        order = np.lexsort((bound, owner))
        upto = np.r_[0, np.cumsum(bound[order])]
        upto = upto[1:] - upto[np.searchsorted(owner, np.arange(n))][owner]
        low = np.zeros(len(at), dtype=bool)
        low[order] = upto < least[owner] * PIVOT
        return at, weight, owner, low, np.bincount(owner[low], bound[low], minlength=n)

    def _parts(self, at: np.ndarray, weight: np.ndarray, owner: np.ndarray, need: np.ndarray) -> np.ndarray:
        """The terms' rounded sums by query and document, whole in the blocks where a document may reach `need`.

        The rare terms are added up first. Their largest sum in a block and the block's bounds of the common terms tell
        which blocks are multiplied.
        """
        n, m = len(need), len(self.ids)
        part = np.zeros((n, m))
        rare = self.row[at] < 0
        places, own, factor = at[rare], owner[rare], weight[rare]
        sizes = self.entry_first[places + 1] - self.entry_first[places]
        chunk = np.cumsum(sizes) // CHUNK
        for x in np.split(np.arange(len(places)), np.flatnonzero(np.diff(chunk)) + 1) if len(places) else ():
            lo, hi = own[x[0]], own[x[-1]] + 1
            runs = spread(self.entry_first[places[x]], sizes[x])
            cell = np.repeat((own[x] - lo) * m, sizes[x]) + self.docs[runs]
            part[lo:hi] += np.bincount(cell, weights=np.repeat(factor[x], sizes[x]) * self.scores[runs], minlength=(hi - lo) * m).reshape(-1, m)
        rows, column = np.unique(self.row[at[~rare]], return_inverse=True)
        sums = np.zeros((n, len(rows)), dtype=np.float32)
        sums[owner[~rare], column] = weight[~rare]
        most = np.maximum.reduceat(part, np.arange(0, m, BLOCK), axis=1) + sums @ self.table_top[rows]
        live = (most > 0) & (most >= need[:, None])
        self.skipped += live.size - int(live.sum())
        table = self.table[rows]
        for b in range(0, live.shape[1], BLOCKS):
            some, x = np.flatnonzero(live[:, b : b + BLOCKS].any(axis=1)), slice(b * BLOCK, (b + BLOCKS) * BLOCK)
            if len(some):
                part[some, x] += sums[some] @ table[:, x]
        return part

    def _cut(self, found: np.ndarray, part: np.ndarray, at: np.ndarray, weight: np.ndarray, low: np.ndarray, least: float, k: int) -> np.ndarray:
        """Of `found`, the documents that may be among the k + 1 best and score `least` or more, with the terms before the pivot."""
        part, row = part[found], self.row[at]
        if len(found) <= k + 1:
            return found
        known, other = low & (row >= 0), low & (row < 0)
        if known.any():
            part = part + weight[known].astype(np.float32) @ self.table[np.ix_(row[known], found)]
        keep = part + float((weight[other] * self.top[at[other]]).sum()) >= least
        found, part = found[keep], part[keep]
        return found if other.any() else self._best(found, part, k)

    def _best(self, found: np.ndarray, part: np.ndarray, k: int) -> np.ndarray:
        """Of documents with the rounded sums `part`, those that may be among the k + 1 best: one may be the query itself."""
        if len(found) <= k + 1:
            return found
        return found[part >= np.partition(part, len(part) - k - 1)[len(part) - k - 1] * (1 - ROUNDING)]

    def _scored(self, docs: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        self.weight[at] = weight
        rows = [slice(self.doc_first[d], self.doc_first[d + 1]) for d in docs.tolist()]
        out = np.array([(self.weight[self.own_terms[x]] * self.own_scores[x]).sum() for x in rows])
        self.weight[at] = 0
        return out


SHARD = "n long, words long, ids binary, lengths binary, terms binary, first binary, docs binary, tfs binary"
KINDS = {"ids": np.int64, "lengths": np.int32, "terms": np.int64, "first": np.int64, "docs": np.uint16, "tfs": np.int32}


def _alike(terms: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
    """An order of documents by the commonest of their terms, which tells languages apart, and by length."""
    top, sizes = np.full(len(terms), -1), np.array([len(t) for t in terms])
    if sizes.any():
        _, of, counts = np.unique(np.concatenate(terms), return_inverse=True, return_counts=True)
        rank = np.argsort(np.argsort(counts, kind="stable"))
        top[sizes > 0] = np.maximum.reduceat(rank[of], (np.cumsum(sizes) - sizes)[sizes > 0])
    return np.lexsort((lengths, -top))


def packed(ids: np.ndarray, texts: list, known: TermIds, alike: bool = False) -> dict:
    """A shard's documents and words, and its postings as arrays, by term and document; with `alike`, like documents in a row."""
    terms, tfs, lengths = [], [], np.zeros(len(ids), dtype=np.int32)
    for i, text in enumerate(texts):
        found = words(text)
        t, n = np.unique(np.fromiter(map(known.__getitem__, found), dtype=np.int64, count=len(found)), return_counts=True)
        terms.append(t)
        tfs.append(n.astype(np.int32))
        lengths[i] = len(found)
    if alike:
        order = _alike(terms, lengths)
        ids, lengths, terms, tfs = ids[order], lengths[order], [terms[i] for i in order], [tfs[i] for i in order]
    docs = np.repeat(np.arange(len(ids), dtype=np.uint16), [len(t) for t in terms])
    term, tf = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (terms, tfs))
    by = np.argsort(term, kind="stable")
    kinds, first = np.unique(term[by], return_index=True)
    x = {"ids": ids, "lengths": lengths, "terms": kinds, "first": np.r_[first, len(term)], "docs": docs[by], "tfs": tf[by]}
    return {"n": len(ids), "words": int(lengths.sum())} | {c: np.ascontiguousarray(v, dtype=KINDS[c]).tobytes() for c, v in x.items()}


def unpacked(row) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(row[c], dtype=kind) for c, kind in KINDS.items()}


def spread(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of runs of the given sizes, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + sizes, sizes)


def _shards(docs: DataFrame) -> DataFrame:
    """A row for each shard of `docs` (doc_id, text)."""
    chars, most = SHARD_CHARS, SHARD_DOCS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, ids, texts, size = TermIds(), [], [], 0
        for pdf in batches:
            for d, t in zip(pdf["doc_id"].tolist(), pdf["text"], strict=True):
                ids.append(d)
                texts.append(t)
                size += len(t)
                if size >= chars or len(ids) >= most:
                    yield pd.DataFrame([packed(np.array(ids, dtype=np.int64), texts, known, True)])
                    ids, texts, size = [], [], 0
        if ids:
            yield pd.DataFrame([packed(np.array(ids, dtype=np.int64), texts, known, True)])

    return docs.select("doc_id", "text").mapInPandas(run, SHARD)


def _frequencies(shards: DataFrame) -> DataFrame:
    """(term, df): documents that have the term, to be added up by term."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for terms, first in zip(pdf["terms"], pdf["first"], strict=True):
                yield pd.DataFrame({"term": np.frombuffer(terms, dtype=np.int64), "df": np.diff(np.frombuffer(first, dtype=np.int64))})

    return shards.select("terms", "first").mapInPandas(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _query_words(queries: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for q, text in zip(pdf["query_id"], pdf["text"], strict=True):
                counts = Counter(words(text))
                yield pd.DataFrame({"query_id": np.int64(q), "term": np.array([term_id(w) for w in counts], dtype=np.int64), "tf": np.fromiter(counts.values(), dtype=np.int64, count=len(counts))})

    return queries.mapInPandas(run, "query_id long, term long, tf long")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, query_terms: int | None = None, skip_self: bool = True) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of `docs` (doc_id, text) for each of `queries` (query_id, text).

    A query is every distinct word of its whole text; with `query_terms`, only that many with the largest tf times idf
    (ties: smaller term hash). Score is the sum of idf times BM25's saturated frequency over them. Ties go to the smaller doc_id. Every row of `docs` is
    indexed, whole. `skip_self` leaves out the document with the query's own id. Documents without a term of the query are
    no answers, so an empty text is never found and an empty query has none. Rows with a null id are not searched or
    asked; repeated rows are one document (the first by text). An empty table gives an empty result; other columns are
    not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("query_id IS NOT NULL")
    queries = queries.groupBy("query_id").agg(F.min("text").alias("text"))
    shards = materialize(_shards(docs), "shards")
    size = shards.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0)), F.count("*")).first()
    n, mean = float(size[0]), float(size[1]) / max(size[0], 1)
    twice = materialize(docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "repeated_ids")
    searched = shards
    if not twice.isEmpty():
        # Statistics are of all rows; of rows with one id only the first by text is searched.
        once = docs.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        searched = materialize(_shards(docs.join(twice, "doc_id", "left_anti").unionByName(once)), "shards")

    asked = materialize(_query_words(queries), "query_words")
    total = _frequencies(shards).join(asked.select("term").distinct(), "term", "left_semi")
    weight = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = asked.join(total, "term").withColumn("idf", weight)
    if query_terms is not None:
        best = Window.partitionBy("query_id").orderBy((F.col("tf") * F.col("idf")).desc(), "term")
        asked = asked.withColumn("r", F.row_number().over(best)).where(F.col("r") <= query_terms)
    asked = materialize(asked.select("query_id", "term", "idf"), "queries")
    blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    # Pilots are one in so many shards that they return about as many rows as all shards do afterwards.
    every = max(1, round(size[2] ** 0.5))
    searched = searched.withColumn("pilot", F.pmod(F.xxhash64("ids"), F.lit(every)) == 0)

    def answers(part: DataFrame, sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asked_ids, first, terms, idfs, least = sent.value
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, dtype=np.int64))] * len(asked_ids)
            least = least.copy()
            # Queries that are searched together have the same commonest term, and so often the same language, and are about as long.
            common = [terms[a + np.argmin(idfs[a:b])] for a, b in zip(first, first[1:])]
            turn = np.lexsort((np.diff(first), common)).tolist()
            for pdf in batches:
                for row in pdf.to_dict("records"):
                    index = Index.of(row, mean)
                    for at in range(0, len(turn), TOGETHER):
                        some = turn[at : at + TOGETHER]
                        parts = [slice(first[i], first[i + 1]) for i in some]
                        asked_now = [(terms[x], idfs[x], int(asked_ids[i]) if skip_self else None, least[i]) for i, x in zip(some, parts, strict=True)]
                        for i, (score, ids) in zip(some, index.search_many(asked_now, k), strict=True):
                            if not len(score):
                                continue
                            score, ids = np.r_[best[i][0], score], np.r_[best[i][1], ids]
                            order = np.lexsort((ids, -score))[:k]
                            best[i] = score[order], ids[order]
                            if len(order) == k:
                                least[i] = max(least[i], score[order[-1]])
                    del index  # before the next one is made
            sizes = [len(s) for s, _ in best]
            if sum(sizes):
                yield pd.DataFrame({"query_id": np.repeat(asked_ids, sizes), "doc_id": np.concatenate([d for _, d in best]), "score": np.concatenate([s for s, _ in best])})

        return part.select(*KINDS).mapInPandas(run, "query_id long, doc_id long, score double")

    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    best_of = lambda df: df.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    out = []
    for b in range(blocks):
        x = asked.where(F.col("block") == b).select("query_id", "term", "idf").toArrow()  # BLOCK_TERMS rows, about
        q, term, idfs = (x.column(c).to_numpy() for c in ("query_id", "term", "idf"))
        order = np.lexsort((term, q))
        q, term, idfs = q[order], term[order], idfs[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][: len(q)])
        sent = [q[first], np.r_[first, len(q)], term, idfs]
        pilot = materialize(best_of(answers(searched.where("pilot"), spark.sparkContext.broadcast((*sent, np.zeros(len(first)))))).drop("rank"), "pilot")
        known = pilot.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") == k).select("query_id", "s").toArrow()  # a row a query
        least = np.zeros(len(first))
        least[np.searchsorted(q[first], known.column("query_id").to_numpy())] = known.column("s").to_numpy()
        rest = answers(searched.where("NOT pilot"), spark.sparkContext.broadcast((*sent, least)))
        out.append(materialize(best_of(pilot.unionByName(rest)), "answers"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.select("query_id", "rank", "doc_id", "score")


def search_rows(docs: DataFrame, every: int = 100, k: int = 10, query_terms: int | None = 12) -> DataFrame:
    """search() for the rows of `docs` whose id is divisible by `every`, against all rows; `query_terms` None for every word."""
    asked = docs.where(F.col("doc_id") % every == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search(docs, asked, k, query_terms)
