import random

import pytest
from pyspark.sql import functions as F

from textloom.llm.mixing import DIMS, rake, sample, scale_to, weigh


def test_raking_by_plain_code(spark):
    rng = random.Random(3)
    cells = {(f"s{a}", f"l{b}", f"t{c}"): rng.randrange(0, 50) for a in range(4) for b in range(3) for c in range(2) if rng.random() < 0.9}
    targets = {"__source": [0.4, 0.3, 0.2, 0.1], "__lang": [0.5, 0.25, 0.25], "__topic": [0.7, 0.3]}
    want = {k: v / sum(cells.values()) for k, v in cells.items()}
    for _ in range(200):
        for d, t in enumerate(targets.values()):
            for i, x in enumerate(t):
                own = [k for k in want if k[d][1:] == str(i)]
                s = sum(want[k] for k in own)
                for k in own:
                    want[k] *= x / s if s else 1
    df = spark.createDataFrame([(*k, float(v)) for k, v in cells.items()], ", ".join(f"{d} string" for d in DIMS) + ", mass double")
    goal = spark.createDataFrame([(d, f"{d[2]}{i}", x) for d, t in targets.items() for i, x in enumerate(t)], "dim string, value string, target double")
    got = {tuple(r[d] for d in DIMS): r["fitted"] for r in rake(df, goal, DIMS, rounds=60, tolerance=1e-9).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)
    far = rake(df, goal, DIMS, rounds=60, tolerance=1e-9, array_cells=0).collect()
    assert all(abs(r["fitted"] - want[tuple(r[d] for d in DIMS)]) < 1e-6 and r["off"] <= 1e-6 for r in far) and len(far) == len(want)


def test_what_misses_its_targets_is_told(spark):
    df = spark.createDataFrame([("a", "x", "t", 1.0), ("b", "y", "t", 3.0)], ", ".join(f"{d} string" for d in DIMS) + ", mass double")
    goal = spark.createDataFrame([("__source", "a", 0.5), ("__source", "b", 0.5), ("__lang", "x", 0.25), ("__lang", "y", 0.75)], "dim string, value string, target double")
    for most in (0, 100):
        rows = rake(df, goal, DIMS, array_cells=most).collect()
        assert sorted(r["fitted"] for r in rows) == pytest.approx([0.25, 0.75]) and {round(r["off"], 6) for r in rows} == {0.25}


def test_weights_and_sample(docs, texts):
    rows = weigh(docs, keep=0.5).collect()
    assert len(rows) == len(texts)
    total = sum(r["__tokens"] for r in rows)
    assert total == sum(len((t or "").split()) for _, t in texts)
    assert abs(sum(r["__tokens"] * r["__probability"] for r in rows) / total - 0.5) < 1e-6
    mass = {}
    for r in rows:
        mass.setdefault(r["__lang"], [0, 0.0])
        mass[r["__lang"]][0] += r["__tokens"]
        mass[r["__lang"]][1] += r["__tokens"] * (r["__weight"] or 0)
    roots = {k: (v[0] / total) ** 0.5 for k, v in mass.items()}
    for k, v in mass.items():
        assert v[1] / total == pytest.approx(roots[k] / sum(roots.values()), abs=1e-4)
    slim = weigh(docs, keep=0.5, columns=False).collect()
    assert sorted((str(r["doc_id"]), r["__probability"], r["__sampled"]) for r in slim) == sorted((str(r["doc_id"]), r["__probability"], r["__sampled"]) for r in rows)
    kept = sample(docs, keep=0.5)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["__sampled"] for r in rows)
    twins = [r["__sampled"] for r in rows if r["doc_id"] == 0]
    assert len(set(twins)) == 1


def test_many_draws_follow_the_probabilities(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 5), f"s{i % 2}" if i % 7 else "s9", "en") for i in range(6000)], "doc_id long, text string, source string, lang string")
    out = weigh(df, keep=0.3).groupBy("__source").agg(F.avg("__probability").alias("p"), F.avg(F.col("__sampled").cast("int")).alias("f")).collect()
    assert all(abs(r["p"] - r["f"]) < 0.05 for r in out)


def test_scale_and_empty(spark, no_docs):
    cells = spark.createDataFrame([(10.0, 0.9), (10.0, 0.1)], "mass double, fitted double")
    s = scale_to(cells, 15.0)
    assert abs(10 * min(1, s * 0.09) + 10 * min(1, s * 0.01) - 15) < 1e-5
    assert abs(scale_to(cells, 15.0, array_cells=0) - s) < 1e-6
    assert scale_to(cells, 20.0) >= 100.0 - 1e-9
    assert weigh(no_docs).collect() == []
