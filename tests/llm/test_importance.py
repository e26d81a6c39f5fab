import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from textloom.llm import importance as I

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def buckets_of(text):
    w = words_of(text)
    return [zlib.crc32(x.encode()) % 10_000 for x in [*w, *map(" ".join, zip(w, w[1:]))]]


def brute(rows, target, percent, least):
    s, t = Counter(b for _, x in rows for b in buckets_of(x)), Counter(b for x in target for b in buckets_of(x))
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1.0) * (s.total() + 10_000.0)) / ((s[b] + 1.0) * (t.total() + 10_000.0))))
    out = []
    for i, x in rows:
        b = buckets_of(x)
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, b)) // len(b) if b else 0
        out.append([i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(x)) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_features():
    rng = random.Random(3)
    texts = ["".join(rng.choice(["é", "a", "B", "9", " ", "-", "漢", "\n", "`", "Z" * 60, "q", "\x7f"]) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += ["", "x" * 100 + " " + "y" * 49 + " " + "z" * 48 + " " + "k" * 47, "one"]
    bucket, owner, words = I.features([t.encode() for t in texts])
    assert words.tolist() == [len(words_of(t)) for t in texts]
    for i, t in enumerate(texts):
        assert sorted(bucket[owner == i].tolist()) == sorted(buckets_of(t))
    assert all(len(x) == 0 for x in I.features([])[:2])


def test_resampling(spark, docs, no_docs, texts, monkeypatch):
    target = ["the idea of the stone", "stone and river", None, ""]
    items = spark.createDataFrame([(k, t, 1) for k, t in enumerate(target)], "item_id long, text string, weight int")
    want = brute(texts, target, 40, 10)
    assert sorted((tuple(r) for r in I.resample(docs.repartition(5), items, 40, 10).collect()), key=str) == want
    assert sum(r[4] is not None for r in want) > 10
    none = items.limit(0)
    assert sorted((tuple(r) for r in I.resample(docs, none, 25, 20).collect()), key=str) == brute(texts, [], 25, 20)
    assert I.resample(no_docs, items).collect() == []


def test_rows_that_repeat_tie(spark):
    text = " ".join("abcdefghijklmnopqrstuvwxyz")
    df = spark.createDataFrame([(4, text)] * 8 + [(9, text)], "doc_id long, text string")
    rows = I.resample(df, df, percent=100).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 10)) and len({r["score"] for r in rows if r["doc_id"] == 4}) == 1


def test_counts_add_up_over_partitions(spark, docs, texts):
    want = np.bincount([b for _, t in texts for b in buckets_of(t)], minlength=I.BUCKETS)
    for n in (1, 7, 70):
        assert (I.bucket_counts(docs.repartition(n)) == want).all()
