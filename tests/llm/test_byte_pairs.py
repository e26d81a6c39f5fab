import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import byte_pairs as B
from textloom.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_classes_of_all_code_points():
    """As the library's pattern sees them: with a vocabulary of pairs, two code points of one run are one token."""
    import public_tokenizers
    import tiktoken

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    table = B.class_table()
    for first, kinds in (("a", B.LETTERS), ("1", (B.NUMBER,)), ("\t", B.BLANKS)):
        ranks = {bytes([i]): i for i in range(256)}
        for c in points:
            ranks.setdefault((first + chr(c)).encode(), len(ranks))
        pairs = tiktoken.Encoding("pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        joined = [len(pairs.encode_ordinary(first + chr(c))) == 1 for c in points]
        assert joined == np.isin(table[points], kinds).tolist()


def encoded(texts):
    merged = B.Pairs(PATH)
    for raw, bounds in B._parts(pa.array(texts, pa.string())):
        ids, starts, cuts = B.encode_part(raw, bounds, merged)
        yield from (ids[a:b].tolist() for a, b in zip(cuts, cuts[1:]))


def test_ids_are_the_librarys(library, texts, monkeypatch):
    rng = random.Random(1)
    chars = list("'''  \n\tsstmdrvel lab12!?.éß漢　́٣ \U0001f600")
    made = ["".join(rng.choice(chars) for _ in range(rng.randrange(40))) for _ in range(20_000)]
    made += ["", None, "x" * 5000, " " * 3000, "'" * 999, "it's we'll they're I'v 'lL 'S o'clock''s", "<|endoftext|>", "é" * 700, *(t for _, t in texts)]
    want = [library.encode_ordinary(t or "") for t in made]
    assert list(encoded(made)) == want
    monkeypatch.setattr(B, "CACHE_PIECES", 50)  # a cache too small for a part, and parts of few texts
    monkeypatch.setattr(B, "PART_CHARS", 3000)
    assert list(encoded(made)) == want


def test_scan_equals_steps_one_by_one():
    rng = np.random.default_rng(2)
    for n in (0, 1, 255, 256, 257, 5000):
        steps = rng.integers(0, 2 * len(B.CLASSES), n)
        state, want = B.START, []
        for s in steps:
            state = B._after(B.START if s >= len(B.CLASSES) else state, s % len(B.CLASSES))
            want.append(state)
        assert B.scan(B.GENERATORS[steps]).tolist() == want


def test_merging_side_by_side_equals_the_heap(library):
    merged, rng = B.Pairs(PATH), random.Random(4)
    pieces = {bytes(rng.choice(b"aeinrst \xc3\xa9") for _ in range(rng.randrange(1, 33))) for _ in range(3000)}
    merged.learn(pieces)
    assert pieces == merged.keys()
    assert all(np.frombuffer(merged[p], dtype="<u4").tolist() == merged.merge(p) for p in pieces)


def test_tables(spark, docs, no_docs, texts, library):
    rows = B.encode(docs, PATH).collect()
    assert sorted(((r.doc_id, r.ids) for r in rows), key=str) == sorted(((i, library.encode_ordinary(t or "")) for i, t in texts), key=str)
    by_text = {(i, tuple(library.encode_ordinary(t or ""))): (t or "").encode() for i, t in texts}
    for r in rows:  # a token's bytes stand where it says
        raw = by_text[r.doc_id, tuple(r.ids)]
        ends = [*r.starts, len(raw)][1:]
        assert all(library.decode_single_token_bytes(k) == raw[a:b] for k, a, b in zip(r.ids, r.starts, ends, strict=True))
    back = B.decode(B.encode(docs, PATH), PATH).collect()
    assert sorted(((r.doc_id, bytes(r.bytes)) for r in back), key=str) == sorted(((i, (t or "").encode()) for i, t in texts), key=str)
    lists = spark.createDataFrame([(1, [64, 257]), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.bytes) for r in B.decode(lists, PATH).collect()} == {1: library.decode_bytes([64, 257]), 2: b"", 3: b""}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for i, t in texts:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(map(tuple, B.round_trip(docs, PATH).collect()), key=str) == sorted(want, key=str)
    assert B.round_trip(no_docs, PATH).collect() == [] == B.encode(no_docs, PATH).collect()


def test_bytes_that_are_no_text(spark):
    df = spark.createDataFrame([(1, b"a\xffb")], "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) as text")
    assert bytes(B.decode(B.encode(df, PATH), PATH).first().bytes) == "a�b".encode()
