"""N-gram Jaccard join by vertical partitioning (after FS-Join, Rong et al., 2017).

Every document is the set of its distinct word n-grams, each a 64-bit hash. The hash space is cut into fragments; a
document's n-grams in one fragment are its segment there. A task that holds a fragment sees every occurrence of the
n-grams in it, so it knows their document frequencies and counts partial overlaps without any other fragment; partial
counts are summed per document or per pair.

1. Segments go to their fragments once. A fragment returns, for each set, the n-grams that occur in other sets too.
   Summed up, a set of which less than 80 % is shared with any other set can have no partner and is done.
2. Of the rest, each set is paired with one well-shared set for each of a few min-hashes (a number of pairs in
   proportion to the sets), the pairs' partial overlaps are counted and summed, and the links are joined to components.
3. What is left are links between different components. Each set belongs to a hub, the centre of its component or, if
   it has no link yet, of its best match's. With D(x), the n-grams in which x differs from the hub's shared ones, two sets
   differ by |D(x)| + |D(y)| - 2 |D(x) & D(y)|. So with V(x) = |D(x)| - |x| (100 - p) / (100 + p), two sets are linked
   exactly if |D(x) & D(y)| >= (V(x) + V(y)) / 2. Sets of a hub whose V and the hub's least V add up to no more than 0
   are thereby linked with the set of the least V. All other pairs must share n-grams of D, and are found by a prefix
   filter on D, which is small and whose n-grams are rare, with bounds by position. Pairs of different hubs are found by
   the prefix filter under the global order (document frequency, hash) on the whole sets, with the same kind of bounds;
   in each posting list the sets of its most frequent hub meet only those of other hubs. The pairs that are left are
   counted fragment by fragment as before.

Equal sets are one class throughout, so copies are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.shared_store import materialize
from textloom.llm.names import keeps_other_columns
from textloom.llm.worker_memory import gives_back
from textloom.operators.components import connected_components

M1, M2, ROLL = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
#: N-grams in a fragment, about: bounds what one task holds.
FRAGMENT_GRAMS = 1_000_000
#: Min-hashes of a set, each of which gives it one pair in step 2.
KEYS = 4
CACHE_WORDS = 150_000


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * M1
    h = (h ^ (h >> np.uint64(33))) * M2
    return h ^ (h >> np.uint64(33))


def gram_set(text: str | None, words: WordHash, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of the text's words (A-Z lower-cased); fewer words are one gram."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        h = h * ROLL + mix(w[j : len(w) - k + 1 + j] + np.uint64(j + 1))
    return np.unique(mix(h))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, set_id): set_id is a hash of the whole set, 0 for an empty one."""

    @gives_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHash()
        for pdf in batches:
            sets = [gram_set(t, words, n) for t in pdf["text"]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"),
                "n_shingles": np.fromiter(map(len, sets), dtype=np.int64, count=len(sets)),
                "set_id": np.array([xxhash.xxh64_intdigest(s.tobytes(), seed=len(s)) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64),
            })

    return docs.mapInPandas(run, "doc_id long, n_shingles long, set_id long")


#: Grams that a task gathers before it sends their segments.
SEND_GRAMS = 500_000


def _segments(docs: DataFrame, n: int, fragments: int) -> DataFrame:
    """(frag, set_ids, sizes, lengths, grams): segments of many sets in a fragment, laid end to end.

    A task sends a set once, however many copies it reads.
    """
    width = np.uint64(min(2**64 - 1, 2**64 // fragments + 1))

    def packed(ids: list[int], sets: list[np.ndarray]) -> pd.DataFrame:
        sizes = np.array([len(s) for s in sets], dtype=np.int32)
        grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        frag = (grams // width).astype(np.int32)
        order = np.argsort(frag, kind="stable")
        grams, owner, frag = grams[order], owner[order], frag[order]
        set_ids, rows = np.array(ids, dtype=np.uint64).view(np.int64), []
        first = np.flatnonzero(np.r_[True, frag[1:] != frag[:-1]])
        for x, y in zip(first, np.r_[first[1:], len(frag)], strict=True):
            who, lengths = np.unique(owner[x:y], return_counts=True)
            rows.append((int(frag[x]), set_ids[who].tobytes(), sizes[who].tobytes(), lengths.astype(np.int32).tobytes(), grams[x:y].tobytes()))
        return pd.DataFrame(rows, columns=["frag", "set_ids", "sizes", "lengths", "grams"])

    @gives_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, seen, ids, sets, total = WordHash(), set(), [], [], 0
        for pdf in batches:
            for text in pdf["text"]:
                s = gram_set(text, words, n)
                if not len(s) or (set_id := xxhash.xxh64_intdigest(s.tobytes(), seed=len(s))) in seen:
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(set_id)
                ids.append(set_id)
                sets.append(s)
                total += len(s)
                if total > SEND_GRAMS:
                    yield packed(ids, sets)
                    ids, sets, total = [], [], 0
        if ids:
            yield packed(ids, sets)

    return docs.select("text").mapInPandas(run, "frag int, set_ids binary, sizes binary, lengths binary, grams binary")


def _shared(buckets: int):
    @gives_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _shared_grams(batches, buckets)

    return run


def _shared_grams(batches: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    """A fragment's task: for each set, the grams that other sets have too, with their document frequencies.

    Sets are dealt to `buckets`, with a row for each: (bucket, set_ids, sizes, lengths, grams, dfs), all laid end to end.
    """
    parts = {k: [] for k in ("set_ids", "sizes", "lengths", "grams")}
    for pdf in batches:
        for k, v in parts.items():
            v.extend(pdf[k])
    if not parts["grams"]:
        return
    # The same set may come from several tasks, and a partition may hold several fragments: a gram counts once a set.
    lengths = np.frombuffer(b"".join(parts["lengths"]), dtype=np.int32)
    ids, which = np.unique(np.frombuffer(b"".join(parts["set_ids"]), dtype=np.int64), return_inverse=True)
    sizes = np.zeros(len(ids), dtype=np.int32)
    sizes[which] = np.frombuffer(b"".join(parts["sizes"]), dtype=np.int32)
    owner = np.repeat(which, lengths)
    flat = np.frombuffer(b"".join(parts["grams"]), dtype=np.uint64)
    del parts
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    keep = np.r_[True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])]
    flat, owner = flat[keep], owner[keep]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    df = np.diff(np.r_[first, len(flat)])
    keep = np.repeat(df, df) >= 2
    flat, owner, df = flat[keep], owner[keep], np.repeat(df, df)[keep].astype(np.int32)
    bucket = (ids.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((owner, bucket[owner]))
    flat, owner, df = flat[order], owner[order], df[order]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, dtype=np.int64)
    last = np.r_[first[1:], len(owner)]
    who = owner[first]
    cuts = np.flatnonzero(np.diff(bucket[who])) + 1
    for w in np.split(np.arange(len(who)), cuts) if len(who) else []:
        a, b = first[w[0]], last[w[-1]]
        yield pd.DataFrame({
            "bucket": [int(bucket[who[w[0]]])], "set_ids": [ids[who[w]].tobytes()], "sizes": [sizes[who[w]].tobytes()],
            "lengths": [(last[w] - first[w]).astype(np.int32).tobytes()], "grams": [flat[a:b].tobytes()], "dfs": [df[a:b].tobytes()],
        })


def need(n: np.ndarray | int, percent: int):
    """Least overlap that a set of n needs with any partner."""
    return -(-n * percent // 100)


def _candidates(percent: int, keys: int):
    """Adds up the fragments' counts of each set; of those that may have partners (set_id, n, shared, centre, mins, prefix,
    grams), where grams are the shared ones. A task holds the shared grams of its buckets."""
    seeds = [np.uint64(0xA0761D6478BD642F * (i + 1) % 2**64) for i in range(keys)]

    @gives_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = {k: [] for k in ("set_ids", "sizes", "lengths", "grams", "dfs")}
        for pdf in batches:
            for k, v in parts.items():
                v.extend(pdf[k])
        join = lambda k, kind: np.frombuffer(b"".join(parts[k]), dtype=kind)
        lengths = join("lengths", np.int32)
        ids, sizes = np.repeat(join("set_ids", np.int64), lengths), np.repeat(join("sizes", np.int32), lengths)
        grams, dfs = join("grams", np.uint64), join("dfs", np.int32)
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0]) if len(ids) else np.zeros(0, dtype=np.int64)
        count = np.diff(np.r_[first, len(ids)])
        enough = count >= need(sizes[order[first]].astype(np.int64), percent) if len(ids) else np.zeros(0, dtype=bool)
        rows = []
        for a, m in zip(first[enough], count[enough], strict=True):
            at = order[a : a + m]
            g, d, n = grams[at], dfs[at], int(sizes[at[0]])
            mins = [int(_signed(mix(g ^ s).min(keepdims=True))[0]) for s in seeds]
            length = n - need(n, percent) + 1 - (n - len(g))  # grams of no other set come first in the global order
            prefix = g[np.lexsort((g, d))[:length]] if length > 0 else g[:0]
            rows.append((int(ids[at[0]]), n, len(g), float(d.sum()) / n, mins, _signed(prefix).tolist(), np.sort(g).tobytes()))
            if len(rows) == 5000:
                yield pd.DataFrame(rows, columns=["set_id", "n", "shared", "centre", "mins", "prefix", "grams"])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["set_id", "n", "shared", "centre", "mins", "prefix", "grams"])

    return run


def _sliced(fragments: int):
    """(set_id, grams) -> (set_id, frag, grams) for each fragment with grams of the set."""
    width = np.uint64(min(2**64 - 1, 2**64 // fragments + 1))

    @gives_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for set_id, g in zip(pdf["set_id"], pdf["grams"], strict=True):
                g = np.frombuffer(g, dtype=np.uint64)
                frag = (g // width).astype(np.int32)
                cuts = np.flatnonzero(np.diff(frag)) + 1
                rows += [(set_id, int(f), part.tobytes()) for part, f in zip(np.split(g, cuts), frag[np.r_[0, cuts]], strict=True)]
            yield pd.DataFrame(rows, columns=["set_id", "frag", "grams"])

    return run


def _difference(grams, hub_grams):
    """array<long> of the n-grams of one packed list that the other lacks, of either side."""

    @F.pandas_udf("array<long>")
    @gives_back
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([np.setxor1d(np.frombuffer(p, dtype=np.int64), np.frombuffer(q, dtype=np.int64), assume_unique=True) for p, q in zip(x, y, strict=True)], dtype="object")

    return run(grams, hub_grams)


def _enough(most, percent: int):
    """Whether an overlap of `most` makes a link of the sets a and b."""
    return (100 + percent) * most >= percent * (F.col("a_n") + F.col("b_n"))


def _overlaps(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """A fragment's segments and pairs: each pair's partial overlap."""
    at = {s: np.frombuffer(g, dtype=np.uint64) for s, g in zip(left["set_id"], left["grams"], strict=True)}
    none, rows = np.zeros(0, dtype=np.uint64), []
    for a, partners in zip(right["a"], right["partners"], strict=True):
        x = at.get(a, none)
        for b in partners:
            y = at.get(b, none)
            part = 0
            if len(y):
                spot = np.searchsorted(y, x)
                spot[spot == len(y)] = 0
                part = int((y[spot] == x).sum())
            rows.append((a, b, part))
    return pd.DataFrame(rows, columns=["a", "b", "part"]).astype({"a": "int64", "b": "int64", "part": "int32"})


def _counted(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """`pairs` (a, b, a_n, b_n, ...) with o, the sum of their partial overlaps.

    A set's partners go to its fragments as lists, of which a set with very many has several.
    """
    lists = pairs.groupBy("a", F.pmod(F.xxhash64("b"), F.lit(16)).alias("k")).agg(F.collect_list("b").alias("partners"))
    where = segments.select(F.col("set_id").alias("a"), F.col("frag").alias("at")).join(lists, "a").select("a", "at", "partners")
    parts = segments.groupBy("frag").cogroup(where.groupBy("at")).applyInPandas(_overlaps, "a long, b long, part int")
    return parts.groupBy("a", "b").agg(F.sum("part").alias("o")).join(pairs, ["a", "b"])


def _members(kept: DataFrame, star: DataFrame, first: DataFrame) -> DataFrame:
    """(set_id, n, shared, comp, hub, prefix) of every candidate."""
    like = F.col("o") / (F.col("a_n") + F.col("b_n") - F.col("o"))
    middle = star.groupBy(F.col("a").alias("set_id")).agg(F.max_by("b", F.struct(like, "b")).alias("mid"))
    own = kept.select("set_id", "n", "shared", "prefix").join(middle, "set_id", "left").join(first.select(F.col("node").alias("set_id"), "component"), "set_id", "left")
    own = own.join(first.select(F.col("node").alias("mid"), F.col("component").alias("mid_comp")), "mid", "left")
    own = materialize(own, "placed")
    # A set with a link is linked with its best match, so every component has such a pair.
    hubs = own.where("component = mid_comp").groupBy("component", "mid").agg(F.count("*").alias("size"))
    hubs = hubs.groupBy(F.col("component").alias("of")).agg(F.max_by("mid", F.struct("size", "mid")).alias("hub"))
    own = own.withColumn("of", F.coalesce("component", "mid_comp", "mid", "set_id")).join(hubs, "of", "left")
    return own.select("set_id", "n", "shared", F.coalesce("component", "set_id").alias("comp"), F.coalesce("hub", "mid", "set_id").alias("hub"), "prefix")


def _near_hubs(members: DataFrame, kept: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links that the hubs prove, between components (src, dst), and the pairs (a, b, a_n, b_n) within a hub that may be links.

    V is kept in whole numbers, 100 + percent times as large.
    """
    up, down = 100 + percent, 100 - percent
    mixed = members.groupBy("hub").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("hub")
    own = members.select("set_id", "n", "shared", "comp", "hub").join(mixed, "hub")
    own = own.join(kept.select("set_id", "grams"), "set_id").join(kept.select(F.col("set_id").alias("hub"), F.col("grams").alias("hub_grams")), "hub")
    own = own.withColumn("d", _difference("grams", "hub_grams")).withColumn("size", F.col("n") - F.col("shared") + F.size("d"))
    own = materialize(own.select("set_id", "n", "comp", "hub", "d", "size", (F.col("size") * up - F.col("n") * down).cast("long").alias("v")), "differences")
    least = own.groupBy("hub").agg(F.min("v").alias("v0"), F.min_by("comp", F.struct("v", "set_id")).alias("comp0"))
    own = own.join(least, "hub").withColumn("core", F.col("v") + F.col("v0") <= 0)
    proved = materialize(own.where("core AND comp <> comp0").select(F.col("comp").alias("src"), F.col("comp0").alias("dst")).distinct(), "proved")
    outer = own.where("NOT core").groupBy("hub").agg(F.min("v").alias("v1"))
    need_ = lambda v: F.ceil(v / (2 * up))
    own = own.join(outer, "hub").withColumn("t_outer", need_(F.col("v") + F.col("v0"))).withColumn("t_any", need_(F.col("v") + F.col("v1")))
    posts = own.select("hub", "set_id", "n", "comp", "size", "v", "core", "t_outer", "t_any", F.explode("d").alias("g"))
    df = posts.groupBy("hub", "g").agg(F.count("*").alias("df"), F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("core").alias("all_core"))
    # Grams that only one set has come first in the order; lists of one component or without an outer set join nothing.
    posts = posts.join(df.where("df > 1"), ["hub", "g"])
    order = Window.partitionBy("hub", "set_id").orderBy("df", "g")
    posts = posts.withColumn("rank", F.col("size") - F.count("*").over(Window.partitionBy("hub", "set_id")) + F.row_number().over(order)).where("x < y AND NOT all_core")
    posts = materialize(posts.where(F.col("rank") <= F.col("size") - F.least("t_any", F.when(~F.col("core"), F.col("t_outer")).otherwise(F.col("t_any"))) + 1), "hub_postings")
    a = posts.where(~F.col("core") & (F.col("rank") <= F.col("size") - F.col("t_outer") + 1))
    b = posts.where(F.col("rank") <= F.col("size") - F.col("t_any") + 1)
    a, b = (x.select("hub", "g", *(F.col(c).alias(f"{p}_{c}") for c in ("set_id", "n", "comp", "size", "v", "rank"))) for p, x in (("a", a), ("b", b)))
    most = F.least(F.col("a_size") - F.col("a_rank"), F.col("b_size") - F.col("b_rank")) + 1
    pairs = a.join(b, ["hub", "g"]).where(F.col("a_comp") != F.col("b_comp")).where(2 * up * most >= F.col("a_v") + F.col("b_v"))
    return proved, _ordered(pairs)


def _across_hubs(members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, a_n, b_n) of different hubs and components that may be links."""
    posts = members.select("set_id", "n", "comp", "hub", (F.col("n") - F.col("shared")).alias("alone"), F.posexplode("prefix").alias("pos", "g"))
    posts = materialize(posts.withColumn("rank", F.col("alone") + F.col("pos") + 1).drop("alone", "pos"), "postings")
    kinds = posts.groupBy("g", "hub").agg(F.count("*").alias("size")).groupBy("g").agg(F.max_by("hub", F.struct("size", "hub")).alias("main"), F.count("*").alias("kinds"))
    posts = posts.join(kinds.where("kinds > 1").select("g", "main"), "g").withColumn("of_main", F.col("hub") == F.col("main"))
    a, b = (x.select("g", *(F.col(c).alias(f"{p}_{c}") for c in ("set_id", "n", "comp", "hub", "rank", "of_main"))) for p, x in (("a", posts.where("NOT of_main")), ("b", posts)))
    most = F.least(F.col("a_n") - F.col("a_rank"), F.col("b_n") - F.col("b_rank")) + 1
    apart = (F.col("a_hub") != F.col("b_hub")) & (F.col("a_comp") != F.col("b_comp")) & (F.col("b_of_main") | (F.col("a_set_id") < F.col("b_set_id")))
    return _ordered(a.join(b, "g").where(apart).where(_enough(most, percent)))


def _ordered(pairs: DataFrame) -> DataFrame:
    swap = F.col("a_set_id") > F.col("b_set_id")
    side = lambda c, p, q: F.when(swap, F.col(f"{q}_{c}")).otherwise(F.col(f"{p}_{c}"))
    return pairs.select(side("set_id", "a", "b").alias("a"), side("set_id", "b", "a").alias("b"), side("n", "a", "b").alias("a_n"), side("n", "b", "a").alias("b_n"))


def ngram_jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs` (doc_id, text).

    Two documents are linked when the Jaccard similarity of their n-gram sets is at least `percent` / 100, compared in
    whole numbers. component_id is the smallest doc_id that links reach, the document itself included. A null or empty
    text, or one of white space only, has no n-grams and no links; fewer than n words are one n-gram. Repeated rows and
    copies are linked with each other. A null doc_id takes part and counts as larger than any other. An empty table gives
    an empty result; other columns are not read. Grams are 64-bit hashes, sets are known by a 64-bit hash of all of them.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = materialize(_sets(docs, n), "sets")
    total = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    fragments = max(8, -(-total // FRAGMENT_GRAMS))

    buckets = max(8, fragments // 4)
    shared = _segments(docs, n, fragments).repartitionById(fragments, "frag").mapInPandas(_shared(buckets), "bucket int, set_ids binary, sizes binary, lengths binary, grams binary, dfs binary")
    kept = shared.repartitionById(buckets, "bucket").mapInPandas(
        _candidates(percent, KEYS), "set_id long, n int, shared int, centre double, mins array<long>, prefix array<long>, grams binary"
    )
    kept = materialize(kept, "candidates")
    slices = max(1, -(-(kept.agg(F.sum("shared")).first()[0] or 0) // FRAGMENT_GRAMS))
    segments = kept.select("set_id", "grams").mapInPandas(_sliced(slices), "set_id long, frag int, grams binary")

    # Step 2: for each min-hash, the set with the most common grams stands for its group.
    keyed = kept.select("set_id", "n", "shared", "centre", F.posexplode("mins").alias("k", "m"))
    best = keyed.groupBy("k", "m").agg(F.max(F.struct("centre", "set_id", "n", "shared")).alias("x"), F.count("*").alias("size")).where("size > 1")
    best = best.select("k", "m", F.col("x.set_id").alias("b"), F.col("x.n").alias("b_n"))
    pairs = keyed.join(best, ["k", "m"]).where("set_id <> b").select(F.col("set_id").alias("a"), F.col("n").alias("a_n"), "b", "b_n")
    pairs = materialize(pairs.distinct(), "pairs")
    star = materialize(_counted(pairs, segments), "star")
    near = star.where(_enough(F.col("o"), percent)).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    first = materialize(connected_components(near), "parts")

    # Step 3: links between components.
    members = materialize(_members(kept, star, first), "members")
    proved, pairs = _near_hubs(members, kept, percent)
    across = materialize(pairs.unionByName(_across_hubs(members, percent)).distinct(), "across")
    comp = members.select("set_id", "comp")
    late = _counted(across, segments).where(_enough(F.col("o"), percent)).select("a", "b")
    late = late.join(comp.select(F.col("set_id").alias("a"), F.col("comp").alias("src")), "a").join(comp.select(F.col("set_id").alias("b"), F.col("comp").alias("dst")), "b")
    last = connected_components(late.select("src", "dst").unionByName(proved))
    last = last.select(F.col("node").alias("comp"), F.col("component").alias("over"))
    label = comp.join(last, "comp", "left").select("set_id", F.coalesce("over", "comp").alias("label"))

    grams = sets.where("n_shingles > 0").join(label, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("label", "set_id").alias("label"))
    least = grams.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    empty = sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grams.join(least, "label").select("doc_id", "n_shingles", "component_id").unionByName(empty)


@keeps_other_columns
def near_duplicate_free(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, with all columns, of which one stays for each component: the smallest doc_id, and one of its
    repeated rows (the first by text). Documents without words are linked with nothing and stay; rows with a null doc_id
    stay too. An empty table stays empty."""
    joined = ngram_jaccard_join(docs, n, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    known = docs.withColumn("__id", F.col("doc_id").cast("long"))
    kept = known.join(joined, F.col("__id") == F.col("__gone"), "left_anti")
    twice = materialize(docs.select(F.col("doc_id").cast("long").alias("__twice")).where("__twice IS NOT NULL").groupBy("__twice").agg(F.count("*").alias("__rows")).where("__rows > 1").select("__twice"), "repeated_ids")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    # Only rows with a repeated id are sorted, by id.
    nth = F.row_number().over(Window.partitionBy("__id").orderBy(F.col("text")))
    one = kept.join(twice, F.col("__id") == F.col("__twice"), "left_semi").withColumn("__nth", nth).where("__nth = 1")
    return kept.join(twice, F.col("__id") == F.col("__twice"), "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))
