import math
import zlib
from collections import Counter

import numpy as np
import xxhash

from textloom.llm.context_mixing import CODE_BITS, END, LIMIT, MAP_CELLS, MUCH, NODES, RATE, SCALE, START_WEIGHTS, code_log10, score


def toks(t):
    return [*(t or "").encode().lower().split(), None]


def test_base_scores_by_plain_code(docs, texts):
    counts = Counter()
    for d, t in texts:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2:
            counts.update(toks(t))
    n, v = sum(counts.values()), len(counts)
    got = score(docs).collect()
    assert len(got) == len(texts)
    want = {}
    for d, t in texts:
        w = toks(t)
        want.setdefault(d, []).append((len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
    for r in got:
        assert r["train_tokens"] == n
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 7 == 2)
        assert any((r["n_tokens"], r["n_known"]) == x[:2] and math.isclose(r["base_score"], x[2], rel_tol=1e-9) for x in want[r["doc_id"]])
        assert r["score"] < 0 and (r["bits_per_byte"] is None or r["bits_per_byte"] > 0)


def predictors(rng, tokens):
    """Log odds for each node of the code's tree, and for three contexts, whatever the bits that follow."""
    order0 = rng.integers(-LIMIT, LIMIT + 1, NODES).astype(np.int8)
    return order0, rng.integers(-LIMIT, LIMIT + 1, (tokens, NODES)).astype(np.int8)


def on_path(by_node, code):
    return np.stack([by_node[np.arange(len(code)), (code >> (CODE_BITS - b)) | (1 << b)] for b in range(CODE_BITS)], axis=1)


def test_codes_have_a_probability_each():
    """The probabilities of all codes of one token add up to one, whatever was counted."""
    rng = np.random.default_rng(1)
    order0, by_node = predictors(rng, 2)
    code = np.arange(NODES)
    order1, order2 = (on_path(np.repeat(x[None], NODES, axis=0), code) for x in by_node)
    assert math.isclose(np.sum(10 ** code_log10(np.ones(NODES, dtype=np.int64), code, order0, order1, order2)), 1, rel_tol=1e-3)


def test_scores_do_not_depend_on_neighbours():
    rng = np.random.default_rng(2)
    lengths = np.array([1, 2, 6, 34, 71, 201])
    order0, by_node = predictors(rng, int(lengths.sum()))
    code = rng.integers(0, NODES, lengths.sum())
    order1, order2 = on_path(by_node, code), on_path(by_node[::-1], code)
    together = code_log10(lengths, code, order0, order1, order2)
    for i, begin in enumerate(np.r_[0, np.cumsum(lengths)[:-1]]):
        x = slice(begin, begin + lengths[i])
        alone = code_log10(lengths[i : i + 1], code[x], order0, order1[x], order2[x], steps=7)[0]
        assert math.isclose(together[i], alone, rel_tol=1e-4)


def odds(same, other):
    return max(-LIMIT, min(LIMIT, round(math.log((same + 0.2) / (other + 0.2)) * SCALE)))


def scalar_scores(texts):
    """Scores of all rows by plain counts and a loop over tokens and bits."""
    trains = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2 for d, _ in texts]
    rows = [toks(t) for _, t in texts]
    code = {w: (int(END) if w is None else xxhash.xxh64_intdigest(w)) >> (64 - CODE_BITS) for r in rows for w in r}
    path = lambda w, b: (code[w] >> (CODE_BITS - b)) | (1 << b)
    count, tree, of_code, of_words = Counter(), Counter(), Counter(), Counter()
    before = lambda r, i: [(), (r[i - 1] if i else "start",), ("start" if i < 1 else r[i - 1], "start" if i < 2 else r[i - 2])]
    for r, train in zip(rows, trains):
        for i, w in enumerate(r if train else []):
            count[w] += 1
            of_code[code[w]] += 1
            for c in before(r, i):
                tree.update((c, path(w, b)) for b in range(1, CODE_BITS + 1))
    of_words.update(code[w] for w in count)
    for r, train in zip(rows, trains):
        factors = [[1.0] * 3 for _ in range(CODE_BITS)]
        apm = [1 / (1 + math.exp(-(i - (MAP_CELLS - 1) / 2) / 1.5)) for i in range(MAP_CELLS)]
        out = 0.0
        for i, w in enumerate(r):
            own = int(train)
            out += math.log10(count[w] + 1 - own) - math.log10(of_code[code[w]] + of_words[code[w]] + 1 - own)
            for b in range(CODE_BITS):
                bit = path(w, b + 1) & 1
                st = []
                for k, c in enumerate(before(r, i)):
                    same, other = tree[c, path(w, b + 1)], tree[c, path(w, b + 1) ^ 1]
                    if k == 0:  # its counts hold all tokens
                        st.append(odds(*((same, other) if bit else (other, same))))
                    else:
                        st.append(odds(same - own, other) * (1 if bit else -1))
                start = START_WEIGHTS[(st[2] != 0) + (abs(st[2]) >= MUCH)]
                x = [float(start[k]) * st[k] / SCALE for k in range(3)]
                dot = max(-7.9, min(7.9, sum(f * v for f, v in zip(factors[b], x))))
                p = 1 / (1 + math.exp(-dot))
                factors[b] = [f + v * float(RATE) * (bit - p) for f, v in zip(factors[b], x)]
                cell = int(dot * 1.5 + MAP_CELLS / 2)
                refined = 0.7 * p + 0.3 * apm[cell]
                apm[cell] += (bit - apm[cell]) * 0.02
                out += math.log10(max(refined if bit else 1 - refined, 1e-5))
        yield out


def test_scores_by_plain_loops(docs, texts):
    want = {}
    for (d, _), x in zip(texts, scalar_scores(texts)):
        want.setdefault(d, []).append(x)
    got = {}
    for r in score(docs).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    assert got.keys() == want.keys()
    for d in want:
        assert np.allclose(sorted(got[d]), sorted(want[d]), rtol=2e-3), d


def test_wide_ids_beside_a_null_id(spark):
    rows = [(2**62 + 1, "a b"), (None, "a b"), (-(2**62) - 1, "c")]
    out = {r["doc_id"] for r in score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {2**62 + 1, None, -(2**62) - 1}


def test_one_copy_elsewhere_tells(spark):
    rng = np.random.default_rng(5)
    text = lambda: " ".join(f"w{rng.integers(3000)}" for _ in range(80))
    twice = [text() for _ in range(20)]
    rows = [*enumerate(twice), *enumerate(twice, 100), *((i, text()) for i in range(200, 400))]
    out = {r["doc_id"]: r["bits_per_byte"] for r in score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    in_training = [i for i in range(20) if all(zlib.crc32(str(j).encode()) % 7 != 2 for j in (i, i + 100))]
    assert in_training and max(out[i] for i in in_training) < min(out[i] for i in range(200, 400))


def test_context_helps_on_held_out_rows(spark):
    rng = np.random.default_rng(3)
    line = [f"w{rng.integers(200)}" for _ in range(60)]
    rows = [(i, " ".join(line[i % 7 : i % 7 + 50])) for i in range(300)]
    out = [r for r in score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["held_out"]]
    assert out and all(r["score"] > r["base_score"] for r in out)


def test_empty(no_docs):
    assert score(no_docs).collect() == []


def test_bits_of_a_token_are_mixed_at_once(monkeypatch):
    """The steps are a long text's tokens, not their bits."""
    rng = np.random.default_rng(6)
    order0, by_node = predictors(rng, 80)
    code = rng.integers(0, NODES, 80)
    calls, own = [], np.exp
    monkeypatch.setattr(np, "exp", lambda *a, **b: (calls.append(1), own(*a, **b))[1])
    assert code_log10(np.array([80]), code, order0, on_path(by_node, code), on_path(by_node[::-1], code))[0] < 0
    assert len(calls) < 2 * 80


def test_predictions_are_small_where_contexts_are_alike():
    """Contexts that one code follows twice have the same row each, whatever the code; a batch puts back the signs."""
    from textloom.llm.context_mixing import odds_of_ones, packed_odds, path_odds

    rng = np.random.default_rng(7)
    keys = np.sort(np.arange(20_000, dtype=np.uint64) << np.uint64(CODE_BITS) | rng.integers(0, NODES, 20_000).astype(np.uint64))
    whole, left = path_odds(keys, np.full(20_000, 2))
    parts = [packed_odds(x) for x in (whole[:7_000], whole[7_000:])]
    assert sum(map(len, parts)) < 1_000 and len(packed_odds(left)) < 1_000
    bits = keys[:, None] >> np.arange(CODE_BITS - 1, -1, -1, dtype=np.uint64) & np.uint64(1)
    assert (odds_of_ones(keys, parts) == odds(2, 0) * (2 * bits.astype(int) - 1)).all()


def test_odds_on_a_shared_way_are_sent_once():
    """Keys of one context share the odds of their codes' common bits; parts may begin within a context."""
    import zstandard

    from textloom.llm.context_mixing import odds_of_ones, packed_odds, path_odds

    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(0, 2_000, 20_000).astype(np.uint64) << np.uint64(CODE_BITS) | rng.integers(0, NODES, 20_000).astype(np.uint64))
    signs = 2 * (keys[:, None] >> np.arange(CODE_BITS - 1, -1, -1, dtype=np.uint64) & np.uint64(1)).astype(int) - 1
    for rows in path_odds(keys, rng.geometric(0.3, len(keys))):
        parts = [packed_odds(rows[a:b], keys[a:b]) for a, b in ((0, 0), (0, 7_003), (7_003, len(keys)))]
        assert (odds_of_ones(keys, parts) == rows * signs).all()
        assert sum(map(len, parts)) < 0.8 * len(zstandard.compress(rows.tobytes(), 1))


def test_places_of_frequent_words_are_small(spark):
    """A batch's tokens come back in their order, in fewer bytes than as places among its sorted words."""
    from textloom.llm.context_mixing import WordHash, _batches, _tokens, planes, token_hashes

    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 400) % 5_000) for _ in range(100)]
    rows = _batches(spark.createDataFrame([(i, False, True, t) for i, t in enumerate(texts)], "doc_id long, none boolean, train boolean, text string").coalesce(1)).collect()
    h = np.concatenate([token_hashes(t, WordHash()) for t in texts])
    assert len(rows) == 1 and (_tokens(rows[0])[2] == h).all()
    assert len(rows[0]["at"]) + len(rows[0]["n"]) < 0.9 * len(planes(np.unique(h, return_inverse=True)[1].astype(np.uint16)))
