import itertools
import math
import random
import zlib

import numpy as np

from textloom.llm.toxicity import Emissions, drop_toxic, features, fit, forward_backward, score, train


def test_marginals_by_enumeration():
    rng = np.random.default_rng(4)
    moves = rng.normal(size=(2, 2))
    lengths = np.array([3, 0, 5, 1, 4])
    e = rng.normal(size=lengths.sum())
    odds, _, _ = forward_backward(e, lengths, moves)
    at = 0
    for n in lengths:
        x = e[at : at + n]
        for t in range(n):
            p = [0.0, 0.0]
            for y in itertools.product((0, 1), repeat=int(n)):
                p[y[t]] += math.exp(sum(x[i] * y[i] for i in range(n)) + sum(moves[a, b] for a, b in itertools.pairwise(y)))
            assert math.isclose(odds[at + t], p[1] / p[0], rel_tol=1e-9)
        at += n


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(500)]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["scumbag", "Morons!", "vilest" + rng.choice("abcdefgh")]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_held_out_rows(spark):
    rows = corpus(1500, 2)
    df = spark.createDataFrame([(i, t, "x", 0.5, 1) for i, t, _ in rows] + [(9000, None, "x", 0.5, 1), (9001, "", "x", 0.5, 1), (0, rows[0][1], "x", 0.5, 1)], "doc_id long, text string, source string, score double, toxic int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None)], "doc_id long, toxic int")
    model = train(df, labels)
    got = score(df, model).collect()
    truth = {i: y for i, _, y in rows}
    assert len(got) == len(rows) + 3
    wrong = 0
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        text = dict((i, t) for i, t, _ in rows).get(r["doc_id"])
        if r["held_out"] and text is not None:
            wrong += r["predicted"] != truth[r["doc_id"]]
        for s in r["spans"]:
            assert any(x in text[s["start"] : s["end"]].lower() for x in ("scumbag", "morons", "vilest"))
    assert wrong <= 3
    kept = drop_toxic(df, model)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in got if not r["predicted"]}


def test_unlabelled_and_empty(spark, no_docs):
    none = train(no_docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert score(no_docs, none).collect() == []
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert len(score(df, none).collect()) == 2
    assert fit(["a"], np.array([True])).score[0] > 0


def test_emissions_are_sums_of_weights():
    model = fit([t for _, t, _ in corpus(400, 5)], np.array([y for *_, y in corpus(400, 5)]))
    e = Emissions(model)
    assert math.isclose(e[b"Morons!"], model.bias + sum(model.weights.get(f, 0) for f in features("morons")))
