import hashlib
import random
import tracemalloc
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions import fixed, unicode
from textloom.functions import text as T
from textloom.operators.audit import vocabulary_hash


def one(spark, text, *cols):
    return spark.createDataFrame([(text,)], "text string").select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


def test_tokens_and_tags(spark):
    toks = T.tokens(F.col("text"))
    row = one(spark, "見よhttps://a.b/c カタカナ abc_d 12 é! 𠮷x", toks, T.skeleton(toks))
    assert row[0] == ["見", "よ", "https://a.b/c", "カタカナ", "abc_d", "12", "!", "x"]
    assert row[1] == ["<KW>", "よ", "<URL>", "<KW>", "<KW>", "<NUM>", "!", "<KW>"]


@pytest.mark.parametrize(("text", "want"), [("", 0.0), ("aab", 2 / 3), ("𠮷𠮷", 0.5)])
def test_density(spark, text, want):
    assert one(spark, text, T.character_density(F.col("text")))[0] == want


def test_shingles_of_short_lists(spark):
    toks = T.tokens(F.col("text"))
    for text, want in (("", []), ("a b", ["<KW>_<KW>"]), ("a 1 b 2 c", ["<KW>_<NUM>_<KW>_<NUM>_<KW>"])):
        assert one(spark, text, T.structure_features(toks))[0] == want
    assert one(spark, "", T.blocking_grams(F.col("text"), toks))[0] == [""]
    assert one(spark, "a b", T.blocking_grams(F.col("text"), toks))[0] == ["a", "b"]
    assert one(spark, "a b c d", T.blocking_grams(F.col("text"), toks))[0] == ["abc", "bcd"]


def test_content_features(spark):
    assert sorted(one(spark, "abc x 12", T.content_features(F.col("text")))[0]) == ["ab", "abc", "bc", "x"]


def test_windows(spark):
    rows = one(spark, " 甲。乙正。\n\n丙！", T.windows(F.col("text")))[0]
    assert [(r["chunk_id"], r["window_size"], r["text"]) for r in rows] == [(0, 1, "甲。"), (1, 1, "乙。"), (2, 1, "丙。"), (3, 2, "甲。乙。"), (4, 2, "乙。丙。")]
    assert one(spark, " ", T.windows(F.col("text")))[0] == []


def plain_quotes(text, least=10):
    out, i = "", 0
    while True:
        a = text.find("「", i)
        b = text.find("」", a + 1) if a >= 0 else -1
        if b < 0:
            return out + text[i:]
        out += text[i:a] if b - a - 1 >= least else text[i : b + 1]
        i = b + 1


def test_quotes_against_a_scan(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("「」ab") for _ in range(rng.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.without_quotes(F.col("text"), 3).alias("q"))
    assert all(r["q"] == plain_quotes(r["text"], 3) for r in df.collect())


def test_bibliography(spark):
    cases = {"a\n# References \nb": "a", "a\n\nworks cited\nb": "a", "a\n参考文献\n": "a", "References of\nb": "References of\nb", "": "", "参考文献": ""}
    for text, want in cases.items():
        assert one(spark, text, T.without_bibliography(F.col("text")))[0] == want


def test_vocabulary_hashes():
    assert vocabulary_hash(fixed.QUANTIFIERS_JA).startswith("77d1258e")
    assert vocabulary_hash(fixed.MODIFIERS_JA).startswith("4215c12b")
    assert vocabulary_hash(fixed.QUANTIFIERS_EN).startswith("d6a1141b")
    assert vocabulary_hash(fixed.MODIFIERS_EN).startswith("3657afc8")
    assert vocabulary_hash(fixed.EXCLUSIONS_EN).startswith("b2d99729")
    assert [len(x) for x in (fixed.QUANTIFIERS_JA, fixed.MODIFIERS_JA, fixed.QUANTIFIERS_EN, fixed.MODIFIERS_EN, fixed.EXCLUSIONS_EN)] == [21, 17, 17, 17, 34]


def test_position_map():
    assert unicode.position_map("か\u3099た") == ("がた", [0, 2, 3])
    assert unicode.position_map("\ufb01x") == ("fix", [0, 0, 1, 2])
    assert unicode.position_map("") == ("", [0])
    assert unicode.position_map("\uff76\uff9ex\u0301y") == ("ガx\u0301y", [0, 2, 3, 4, 5])
    assert unicode.position_map("x\u0301y") == ("x\u0301y", [0, 0, 2, 3])
    assert unicode.position_map("ᄀ\u1161ᄀ\u1161") == ("가가", [0, 0, 4])
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice("aがか\u3099\u0301ﬁ㈱ᄀ\u1161e") for _ in range(rng.randrange(12)))
        norm, starts = unicode.position_map(t)
        assert norm == unicodedata.normalize("NFKC", t)
        assert len(starts) == len(norm) + 1 and starts == sorted(starts) and starts[-1] == len(t)


def test_prefix_sizes():
    rng = random.Random(4)
    for _ in range(500):
        t = "".join(rng.choice("aがか\u3099\u0301\u0323ﬁ㈱ᄀ\u1161\u11a8\uff76\uff9e\u0344s") for _ in range(rng.randrange(14)))
        assert unicode._prefix_sizes(t).tolist() == [len(unicodedata.normalize("NFKC", t[: j + 1])) for j in range(len(t))]


def test_nfkc_and_rounding(spark):
    row = one(spark, "ﬁＡ", unicode.nfkc(F.col("text")), unicode.rounded(F.lit(0.78125)))
    assert tuple(row) == ("fiA", 0.7812)


def test_winnowed(spark):
    rows = one(spark, "abcdefghijklmnopqrst", unicode.winnowed(F.col("text")))[0]
    hashes = unicode.gram_hashes("abcdefghijklmnopqrst")
    want = sorted({min(range(i, i + 5), key=lambda j: (hashes[j], j)) for i in range(len(hashes) - 4)})
    assert [r["pos"] for r in rows] == want
    assert [int.from_bytes(r["hash"], "big") for r in rows] == [hashes[p] for p in want]
    assert one(spark, "short", unicode.winnowed(F.col("text")))[0] == []


def test_fingerprints_of_a_batch_are_arrays(monkeypatch):
    """Memory of a batch's fingerprints is bounded by their bytes; places and hashes are those of plain code, runs of windows cut anywhere."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é海") for _ in range(n)) for n in (0, 3, 7, 8, 11, 12, 40, 200)] + ["a" * 90, None]
    for windows, k, w in ((1, 8, 5), (7, 3, 9), (65_536, 8, 5)):
        monkeypatch.setattr(unicode, "WINDOWS", windows)
        for t, got in zip(texts, unicode._fingerprints(pa.array(texts), k, w).to_pylist(), strict=True):
            hashes = [hashlib.blake2b((t or "")[i : i + k].encode(), digest_size=8).digest() for i in range(len(t or "") - k + 1)]
            picked = {min(range(i, min(i + w, len(hashes))), key=lambda j: (hashes[j], j)) for i in range(max(1, len(hashes) - w + 1))} if hashes else set()
            assert [(x["pos"], x["hash"]) for x in got] == [(j, hashes[j]) for j in sorted(picked)]
    batch = pa.array(["".join(rng.choice("abcdef ") for _ in range(400)) for _ in range(500)])
    tracemalloc.start()
    found = unicode._fingerprints(batch, 8, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found.flatten()) > 50_000 and peak < 60 * len(found.flatten())


def test_file_bytes():
    assert unicode.read_text("テスト".encode("cp932")) == ("テスト", None)
    assert unicode.read_text(b"") == (None, "empty_input")
    assert unicode.read_text(b" \n") == (None, "empty_input")
    assert unicode.read_text(b"\x81\x7f" * 3) == (None, "unreadable")
    assert unicode.read_text(None) == (None, "unreadable")


def test_token_diff():
    assert unicode.token_diff(["a", "<", "b"], ["a", "c", "b", "d"]) == ("[EQUAL:a][REPLACE:&lt;][EQUAL:b]", "[EQUAL:a][REPLACE:c][EQUAL:b][UNIQUE:d]", 2, 1)


def test_blocking_grams_without_slices(spark):
    """Grams of any length equal plain ones, and no list is cut out and joined for each of them."""
    rows = spark.createDataFrame([("a 1 b a 1 b c",), ("a b",), ("",), (" ",), (None,)], "text string")
    for n in (1, 2, 3):
        out = rows.select("text", T.blocking_grams(F.col("text"), T.tokens(F.col("text")), n).alias("grams"))
        for text, grams in out.collect():
            x = (text or "").split()
            want = ["".join(x[i : i + n]) for i in range(len(x) - n + 1)] if len(x) >= n else x or [text]
            assert grams == list(dict.fromkeys(want))
        assert "slice(" not in out._jdf.queryExecution().optimizedPlan().toString()
