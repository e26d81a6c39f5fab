import math
import random
from collections import Counter

import numpy as np

from textloom.llm import topk_search
from textloom.llm.topk_search import Index, search, search_rows, term_id


def brute(rows, queries, k, n_terms):
    texts = {}
    for d, t in sorted(((d, t or "") for d, t in rows if d is not None)):
        texts.setdefault(d, t)
    all_rows = [(d, (t or "").encode().lower().split()) for d, t in rows if d is not None]
    n, mean = len(all_rows), sum(len(w) for _, w in all_rows) / len(all_rows)
    df = Counter(x for _, w in all_rows for x in set(w))
    idf = {t: math.log1p((n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    out = {}
    for q, t in queries:
        tf = Counter(t.encode().lower().split())
        terms = sorted((x for x in tf if x in df), key=lambda x: (-tf[x] * idf[x], term_id(x)))[:n_terms]
        scores = []
        for d, text in texts.items():
            c = Counter(text.encode().lower().split())
            size = sum(c.values())
            s = sum(idf[x] * c[x] * 2.2 / (c[x] + 1.2 * (0.25 + 0.75 * size / mean)) for x in terms if c[x])
            if s > 0 and d != q:
                scores.append((s, d))
        out[q] = sorted(scores, key=lambda x: (-x[0], x[1]))[:k]
    return out


def test_search_against_brute_force(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD_CHARS", 4000)
    asked = [(d, t) for d, t in texts if d is not None and d % 10 == 0 and t]
    want = brute(texts, dict(asked).items(), 5, 12)
    got = {}
    for r in search_rows(docs, every=10, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["doc_id"]))
    assert set(got) == {q for q, v in want.items() if v}
    for q, rows in got.items():
        assert np.allclose([s for s, _ in rows], [s for s, _ in want[q]])
        clear = [i for i in range(len(rows)) if all(abs(want[q][i][0] - want[q][j][0]) > 1e-9 for j in range(len(rows)) if j != i)]
        assert all(rows[i][1] == want[q][i][1] for i in clear[:-1])


def test_every_word_of_a_query_counts(spark, monkeypatch):
    """Query rows of far more than 12 words, against brute force over all words."""
    monkeypatch.setattr(topk_search, "SHARD_CHARS", 4000)
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(vocab, weights=range(1, 401), k=rng.randrange(1, 120)))) for i in range(1, 150)]
    rows += [(200, rows[9][1] + " " + rows[19][1]), (201, " ".join(rows[9][1].split()[:8])), (202, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    asked = [(d, t) for d, t in rows if d % 10 == 0 and t]
    assert max(len(set(t.split())) for _, t in asked) > 40
    want = brute(rows, asked, 5, None)
    queries = df.where("doc_id % 10 = 0").selectExpr("doc_id AS query_id", "text")
    for found in (search(df, queries, k=5), search_rows(df, every=10, k=5, query_terms=None)):
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["score"], r["doc_id"]))
        assert set(got) == set(want)
        for q, x in got.items():
            assert [d for _, d in x] == [d for _, d in want[q]]
            assert np.allclose([s for s, _ in x], [s for s, _ in want[q]])


def test_the_query_asks_every_word(spark, tmp_path):
    """op5 finds a row that shares only a light word with a query row of many heavier ones."""
    from textloom.llm.queries import op5_block_max_wand

    rows = [(0, "light " + " ".join(f"heavy{i}" for i in range(30))), (1, "light"), *((i, f"light other{i}") for i in range(2, 6))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"] for r in op5_block_max_wand(spark, str(tmp_path)).collect()} == {1, 2, 3, 4, 5}


def test_pruning_skips_and_stays_exact():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocab, weights=range(1, 61), k=rng.randrange(1, 40))) for _ in range(1500)]
    index = Index(np.arange(1500), texts, 20.0)
    for _ in range(60):
        terms = [(term_id(w.encode()), rng.uniform(0.1, 3)) for w in rng.sample(vocab, rng.randrange(1, 9))]
        scores = np.zeros(1500)
        for t, w in sorted(terms, key=lambda x: -x[1]):
            d, s, *_ = index.postings(t) or (np.zeros(0, int), np.zeros(0))
            scores[d] += w * s
        want = sorted(((-x, i) for i, x in enumerate(scores) if x > 0))[:10]
        assert np.allclose([-s for s, _ in index.search(terms, 10)], [s for s, _ in want])


def test_a_known_threshold_prunes_and_loses_nothing(monkeypatch):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choices(vocab, weights=[1 + 3000 // (i + 1) for i in range(200)], k=rng.randrange(5, 60))) for _ in range(2000)]
    ids = np.array(rng.sample(range(10_000), 2000))
    index, scored = Index(ids, texts, 30.0), []
    whole = Index._scored
    monkeypatch.setattr(Index, "_scored", lambda self, docs, *x: (scored.append(len(docs)), whole(self, docs, *x))[1])
    for _ in range(40):
        terms = sorted({term_id(w.encode()): rng.uniform(0.2, 4) for w in rng.sample(vocab, rng.randrange(2, 30))}.items())
        term, weight = np.array([t for t, _ in terms]), np.array([w for _, w in terms])
        want = index.search_arrays(term, weight, 10)
        got = index.search_arrays(term, weight, 10, least=want[0][-1])
        assert want[0].tolist() == got[0].tolist() and want[1].tolist() == got[1].tolist()
    assert len(scored) > 20 and np.mean(scored) < 1000


def test_ties_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD_CHARS", 40)
    rows = [(i, "same words here") for i in (9, 3, 30, 12, 7, 21, 40, 5)] + [(3, "same words here"), (9, "also same words"), (50, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([(1, "same words here"), (3, "same words")], "query_id long, text string")
    got = {}
    for r in search(df, asked, k=4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == {1: [3, 5, 7, 12], 3: [5, 7, 9, 12]}


def test_empty(spark, docs, no_docs):
    none = spark.createDataFrame([], "query_id long, text string")
    assert search(docs, none).collect() == [] and search(no_docs, none).collect() == []
    odd = spark.createDataFrame([(1, ""), (2, None), (None, "the"), (3, "nowordlikethis")], "query_id long, text string")
    assert search(docs, odd).collect() == []


def test_many_queries_at_once_with_and_without_a_table(monkeypatch):
    """Common terms from the shard's table, or none: the same documents and the same scores, for thresholds up to the k-th."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocab, weights=[1 + 3000 // (i + 1) for i in range(300)], k=rng.randrange(5, 60))) for _ in range(900)]
    queries = []
    for i in range(70):
        terms = sorted({term_id(w.encode()): rng.uniform(0.2, 4) for w in texts[i].split() + ["unknown"]}.items())
        queries.append((np.array([t for t, _ in terms]), np.array([w for _, w in terms]), i, 0.0))
    index = Index(np.arange(900), texts, 30.0)
    want = list(index.search_many(queries, 10))
    for q, (score, ids) in zip(queries, want, strict=True):
        whole = index._scored(np.arange(900), *((at := np.searchsorted(index.terms, q[0][np.isin(q[0], index.terms)])), q[1][np.isin(q[0], index.terms)]))
        whole[q[2]] = 0
        best = np.lexsort((np.arange(900), -whole))[:10]
        best = best[whole[best] > 0]
        assert ids.tolist() == best.tolist() and score.tolist() == whole[best].tolist() and len(at)
    assert 0 < len(index.table) < len(index.terms)
    for cells in (0, 900 * 20, 4_000_000):
        monkeypatch.setattr(topk_search, "TABLE_CELLS", cells)
        other = Index(np.arange(900), texts, 30.0)
        for share in (0.5, 1.0):
            got = list(other.search_many([(t, w, i, s[-1] * share) for (t, w, i, _), (s, _) in zip(queries, want, strict=True)], 10))
            assert all(a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist() for a, b in zip(got, want, strict=True))


def test_shards_tell_their_sizes_without_a_second_worker(spark):
    """A function over the shards would keep another Python worker a task, with its memory."""
    shards = topk_search._shards(spark.createDataFrame([(1, "a b"), (2, ""), (3, "b c d")], "doc_id long, text string").coalesce(1))
    assert [(r["n"], r["words"]) for r in shards.collect()] == [(3, 5)]


def test_blocks_of_like_documents_are_skipped():
    """Documents of two languages and all lengths: most blocks of a query are left out by their bounds, and nothing is lost."""
    rng = random.Random(7)
    texts = []
    for i in range(1600):
        vocab = [f"{'ab'[i % 2]}{j}" for j in range(300)]
        texts.append(" ".join(rng.choices(vocab, weights=[1 + 3000 // (j + 1) for j in range(300)], k=rng.choice((3, 30, 300)))))
    ids = np.array(rng.sample(range(9000), 1600))
    plain = Index(ids, texts, 100.0)
    index = Index.of(topk_search.packed(ids, texts, topk_search.TermIds(), True), 100.0)
    assert sorted(index.ids.tolist()) == sorted(ids.tolist()) and index.ids.tolist() != sorted(ids.tolist())
    queries = []
    for i in range(0, 1600, 50):
        terms = sorted({term_id(w.encode()): 6 / (1 + int(w[1:]) % 7) for w in texts[i].split()}.items())
        queries.append((np.array([t for t, _ in terms]), np.array([w for _, w in terms]), int(ids[i]), 0.0))
    want = list(plain.search_many(queries, 5))
    skipped = index.skipped
    got = list(index.search_many([(t, w, i, s[-1]) for (t, w, i, _), (s, _) in zip(queries, want, strict=True)], 5))
    assert all(a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist() for a, b in zip(got, want, strict=True))
    assert index.skipped - skipped > 0.4 * len(queries) * index.table_top.shape[1]
