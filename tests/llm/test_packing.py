import random
import zlib

import numpy as np
import pytest

from textloom.llm.packing import best_two_fit, pack, pieces
from textloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_pieces_are_the_tokenizers(docs, texts, tokenizer, spark):
    odd = [(900, "<|endoftext|> it's THE <|startoftext|>x… don't stop　é́"), (901, "Σας ΟΔΟΣ İstanbul ...hello!!! a--b \x1c q"), (902, "naïve “quoted” text, ﬁne 𝒳 12a 3.14")]
    rows = texts + odd
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = sorted((tuple(r) for r in pieces(df, tokenizer_path(), 64).collect()), key=str)
    want = []
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(d, k, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    assert got == sorted(want, key=str)


def layout_is_sound(rows, capacity):
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(x <= capacity for x in at.values())
    return len(at)


def test_packing(docs, no_docs):
    rows = pack(pieces(docs, tokenizer_path(), 64), 64, blocks=4).collect()
    total = sum(r["length"] for r in rows)
    assert layout_is_sound(rows, 64) <= 1.05 * -(-total // 64) + 1
    assert pack(pieces(no_docs, tokenizer_path())).collect() == []


def test_one_length_of_a_third(spark):
    rows = [(i, 0, 0, 7, i) for i in range(300)] + [(i, 0, 0, 1 + i % 40, i) for i in range(300, 900)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    assert layout_is_sound(pack(df, 40).collect(), 40) <= 1.05 * sum(r[3] for r in rows) / 40


def test_patterns_use_every_piece():
    rng = random.Random(1)
    for _ in range(60):
        cap = rng.choice([10, 50, 200])
        counts = {rng.randrange(1, cap + 1): rng.randrange(1, 30) for _ in range(rng.randrange(1, 25))}
        used = {}
        for times, bin_ in best_two_fit(counts, cap):
            assert times > 0 and sum(bin_) <= cap
            for x in bin_:
                used[x] = used.get(x, 0) + times
        assert used == counts
    # 6 + 3 leave 1; in place of 3, two pieces of 2 fill the bin.
    assert best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [6, 2, 2])


def test_words_are_learned_once(tokenizer):
    """Whatever their case and the signs after them; the ids are the tokenizer's."""
    import pyarrow as pa

    from textloom.llm.packing import WordIds

    words = WordIds(tokenizer_path())
    texts = ["Word word, WORD... (word) word\x0b", "a.b, é., ”. 1,5. x\x7f. -- ... ß!\n.\x85.", "<|endoftext|>, Word,", "word.", None, "Ünder, Ünder! naïve.) 𝒳. q.\x1c"]
    assert list(words.encode_all(pa.array(texts[:1]))) and set(words) == {b"word", b",", b"...", b"(word", b")"}
    want = [np.asarray(tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert list(words.encode_all(pa.array(texts))) == want


def test_signs_after_and_before_every_letter(tokenizer):
    """Each letter, mark and number of Unicode alone, after a letter and between signs: the ids are the tokenizer's."""
    import unicodedata

    import pyarrow as pa

    from textloom.llm.packing import WordIds

    points = [chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c))[0] in "LMN" and not 0xAC10 <= c < 0xD7A0 and not 0x3500 <= c < 0x9F00 and not 0x17010 <= c < 0x18CD0 and not 0x20010 <= c < 0x323A0]
    texts = [f"{c}! a{c}. ({c}) .{c}{c},; é{c}?" for c in points]
    words = WordIds(tokenizer_path())
    got = list(words.encode_all(pa.array(texts)))
    want = [np.asarray(x.ids, dtype="<u4").tobytes() for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, got, want) if a != b] == []


def test_random_texts(tokenizer):
    import pyarrow as pa

    from textloom.llm.packing import WordIds

    rng = random.Random(6)
    chars = "aB1.!?,;:'-\"() \n" * 4 + "İıſßéÉ়ক়য়़ा٣²Ⅷ漢ｶﾞ가각\u1100\u1161\u11a8\u0301\u0338Σς’“…\u00ad\u200d\u3000K\u212a\U0001d4b3"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(1, 30))) for _ in range(50_000)]
    got = list(WordIds(tokenizer_path()).encode_all(pa.array(texts)))
    want = [np.asarray(x.ids, dtype="<u4").tobytes() for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, got, want) if a != b] == []
