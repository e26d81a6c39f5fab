import random
import re
import zlib
from collections import Counter

import pytest

from textloom.llm.spelling import near_words, spelling_variants, variant_words


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] is not None else None))
    return sorted(out)


def vocabulary(seed, size):
    rng = random.Random(seed)
    out = Counter()
    for _ in range(size):
        w = "".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 3, 4, 7, 8, 9])))
        out[w] = rng.choice([2, 2, 3, 25, 400, 5000])
    out |= {"x" * 3000: 7, "x" * 2999: 80, "x" * 1500 + "y" + "x" * 1499: 800, "漢字かな\U0001f600": 2, "漢字かな": 20}
    return out


@pytest.mark.parametrize("limit", [200, 3, 1])
def test_variants(spark, limit):
    """The same rows whether ranges are divided or not; words of one character and very long ones are among them."""
    counts = vocabulary(8, 400)
    rows = [(w, n, 1) for w, n in counts.items()]
    df = spark.createDataFrame(rows, "word string, n long, size int").repartition(5)
    assert sorted(map(tuple, spelling_variants(df, 10, limit).collect()), key=lambda r: r[0]) == brute(counts, 10)


def test_each_pair_is_found_once(spark):
    counts = vocabulary(9, 300)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    for limit in (1, 1000):
        got = Counter((bytes(r.code).decode("utf-32-be"), bytes(r.near).decode("utf-32-be")) for r in near_words(df, limit).collect())
        assert got == Counter((a, b) for a in counts for b in counts if a != b and one_edit(a, b))


def test_ties_repeats_nulls_and_no_rows(spark):
    df = spark.createDataFrame([("stone", 1), ("stonee", 50), ("stoned", 50), ("stone", 2), (None, 9), ("", 9), ("stoneed", 600)], "word string, n long")
    want = {"stone": ("stoned", "stoneed", 3, 2, 50), "stoned": ("stoneed", "stoneed", 50, 3, 600), "stonee": ("stoneed", "stoneed", 50, 3, 600), "stoneed": (None, "stoneed", 600, 2, None)}
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(df).collect()} == want
    assert spelling_variants(df.limit(0)).collect() == []


def test_words(docs, texts, no_docs, spark):
    rows = [*texts, (900, "ÀÉÎõü÷× ÀÉÎõü÷× WoRd-Wordword ǅabcdefg ſtrange_letters"), (None, "Repeated repeated")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows[len(texts) :], "doc_id long, text string"))
    for every in (31, 2):
        want = Counter()
        for i, t in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % every == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= 4:
                    want[run] += 1
        assert {r.word: r.n for r in variant_words(df, 4, every).collect()} == want
    assert variant_words(no_docs).collect() == []
