import hashlib
import random

from pyspark.sql import functions as F

from textloom.llm.winnowing import CHUNK, edited, edited_fingerprint, fingerprint, fingerprint_table, with_next


def chosen(hashes, w):
    """Rightmost smallest of each window."""
    m = len(hashes)
    starts = range(max(1, m - w + 1)) if m else []
    return sorted({max(range(i, min(i + w, m)), key=lambda j: (-hashes[j], j)) for i in starts})


def marks(spark, text, k=8, w=16):
    return [tuple(x) for x in spark.createDataFrame([(text,)], "t string").select(fingerprint(F.col("t"), k, w)).first()[0]]


def gram_hashes(spark, text, k):
    grams = [text[i : i + k] for i in range(len(text) - k + 1)]
    df = spark.createDataFrame(list(enumerate(grams)), "i int, g string").select("i", F.xxhash64("g").bitwiseAND(F.lit(0x7FFFFFFF)).alias("h"))
    return [r["h"] for r in df.orderBy("i").collect()]


def test_windows_by_brute_force(spark, texts):
    long = (texts[-6][1] or "")[:3000] + "é𠮷" * 20 + "ab" * (CHUNK // 2)
    for text in ["", "abc", "abcdefgh", "abcdefghijk", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", texts[3][1], long]:
        got = marks(spark, text)
        if not text:
            assert got == []
        elif len(text) < 8:
            assert [p for p, _ in got] == [0]
        else:
            h = gram_hashes(spark, text, 8)
            assert got == [(p, h[p]) for p in chosen(h, 16)]


def test_shared_passages_are_met(spark, texts):
    passage = "a passage of exactly 23!"[:23]
    a, b = marks(spark, "left " + texts[5][1] + passage + "zz"), marks(spark, "qq" + passage + texts[6][1])
    assert {h for _, h in a} & {h for _, h in b}


def test_table(docs, texts, spark):
    rows = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = fingerprint_table(docs).collect()
    assert len(got) == len(rows)
    want = {}
    for (d, t), (_, o) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, o = t or "", o or ""
        cut = len(t) // 4
        want.setdefault((d, hashlib.sha256((t[: len(t) - cut] + o[:cut]).encode()).hexdigest(), len(t)), []).append(t)
    by_text = {}
    for r in got:
        text = want[r["doc_id"], r["edited_sha256"], r["n_chars"]][0]
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    apart = [r for r in got if r["n_chars"] > 200 and 0 < (r["doc_id"] or 0) < 40]  # whose next isn't a near copy
    assert apart and all(r["near_edited"] > 0.4 > 0.2 > r["near_next"] for r in apart)


def following(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    return sorted((str(d), hashlib.sha256(((t or "")[: len(t or "") - len(t or "") // 4] + (o or "")[: len(t or "") // 4]).encode()).hexdigest()) for (d, t), (_, o) in zip(rows, rows[1:] + rows[:1], strict=True))


def test_ids_of_any_kind(spark):
    """Wide and outlying ids, and rows without ids."""
    rng = random.Random(2)
    text = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randrange(40)))
    wide = [(rng.randrange(-(2**63), 2**63), text()) for _ in range(300)] + [(2**63 - 1, "top"), (-(2**63), "bottom"), (2**63 - 2, "under")]
    far = [(i, text()) for i in range(200)] + [(2**62, "far")]
    none = [(None, text()) for _ in range(60)] + [(None, None)]
    for rows in (wide, far, none, far + none):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = with_next(df, 20).select("doc_id", F.sha2(edited(F.col("text"), F.col("n_chars"), F.col("next_text")).cast("binary"), 256).alias("e")).collect()
        assert sorted((str(r["doc_id"]), r["e"]) for r in got) == following(rows)


def test_edited_marks_are_those_of_the_edited_text(spark, texts):
    rows = [(t[: n], t[: n - n // 4] + texts[9][1][: n // 4], n - n // 4) for _, t in texts[:8] for n in (5, 20, 30, 31, 40, 100) if len(t) >= n]
    df = spark.createDataFrame(rows, "t string, e string, kept long")
    out = df.select(edited_fingerprint(fingerprint(F.col("t")), F.col("e"), F.col("kept")).alias("a"), fingerprint(F.col("e")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in out)


def test_empty_and_single(spark, no_docs):
    assert fingerprint_table(no_docs).collect() == []
    one = fingerprint_table(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
