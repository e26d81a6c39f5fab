import itertools
import random
import re

import pytest

from textloom.llm.ngram_join import near_duplicate_free, ngram_jaccard_join


def grams(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def classes(rows, n=5, percent=80):
    sets = [grams(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        o = len(sets[a] & sets[b])
        if o and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
            up[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_against_brute_force(docs, texts):
    assert got(ngram_jaccard_join(docs)) == classes(texts)


def test_rings_of_near_copies(spark):
    """Copies at all distances of shared bases, and passages that other documents share: links at the threshold's edge."""
    rng = random.Random(3)
    bases = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(3)]
    passage = [f"p{i}" for i in range(25)]
    rows = []
    for i in range(90):
        w = list(bases[i % 3])
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(0, 3)] = [f"e{rng.randrange(6)}"] * rng.randrange(0, 3)
        if i % 4 == 0:
            w[20:20] = passage
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(ngram_jaccard_join(df)) == classes(rows)
    assert got(ngram_jaccard_join(df, n=3, percent=60)) == classes(rows, 3, 60)


def test_empty_table(no_docs):
    assert ngram_jaccard_join(no_docs).collect() == []


def test_one_of_each_stays(docs, texts):
    kept = near_duplicate_free(docs)
    assert kept.columns == docs.columns
    want = {d for d, _, c in classes(texts) if d is not None and d == c}
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(x for x in ids if x is not None) == sorted(want)
    assert ids.count(None) == 2


@pytest.mark.parametrize("text", ["", None, "\t"])
def test_wordless(spark, text):
    assert got(ngram_jaccard_join(spark.createDataFrame([(4, text), (3, text)], "doc_id long, text string"))) == [(3, 0, 3), (4, 0, 4)]
