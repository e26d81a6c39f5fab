from pathlib import Path

import numpy as np

from textloom.llm.worker_memory import gives_back


def anonymous_mb() -> float:
    return sum(int(x.split()[1]) for x in Path("/proc/self/smaps_rollup").read_text().splitlines() if x.startswith("Anonymous:")) / 1024


def rows(batches):
    for n in batches:
        kept = [np.ones(5_000) for _ in range(n)]  # below the size that malloc() maps by itself
        last = np.ones(1)
        yield len(kept) + len(last)


def test_a_worker_gives_back_what_its_task_freed():
    """Small arrays under one that stays would hold 160 MB in the allocator."""
    before = anonymous_mb()
    stays = []

    def task(batches):
        for n in rows(batches):
            stays.append(np.ones(3_000))  # above them, so that the heap's end can't fall
            yield n

    assert list(gives_back(task)([4_000])) == [4_001] and len(stays) == 1
    assert anonymous_mb() - before < 40
    assert gives_back(lambda x: x + 1)(1) == 2


def test_the_pipelines_functions_give_back(spark, monkeypatch):
    from textloom.llm import ngram_join, privacy

    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    seen, own = [], type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, run, schema: (seen.append(run), own(self, run, schema))[1])
    privacy._counts(df.select("text"))
    privacy._own_terms(df.withColumnRenamed("doc_id", "row_key"), spark.createDataFrame([], "entity long, term long, alone boolean"))
    ngram_join._segments(df, 5, 8)
    assert len(seen) == 3 and all(hasattr(run, "__wrapped__") for run in seen)


def test_columns_made_by_workers_give_back_too(spark, monkeypatch):
    """The functions of sanitised texts and of sets' differences; only texts that change are sent to the former."""
    import pandas as pd

    from textloom.llm import ngram_join, privacy

    assert hasattr(privacy.clean, "__wrapped__")
    out = privacy.clean(iter([(pd.Series(["to a@b.cd", None, ""]), pd.Series([[{"start": 3, "kind": 0, "end": 9}], None, []]), pd.Series([None, None, None]))]))
    assert [x.tolist() for x in out] == [["to <EMAIL>", None, ""]]
    seen, own = [], privacy.F.pandas_udf
    with monkeypatch.context() as m:
        m.setattr(ngram_join.F, "pandas_udf", lambda kind: lambda f: (seen.append(f), own(kind)(f))[1])
        ngram_join._difference(privacy.F.lit(b""), privacy.F.lit(b""))
    assert len(seen) == 1 and hasattr(seen[0], "__wrapped__")
    df = spark.createDataFrame([(1, "to a@b.cd"), (2, "plain words"), (None, None)], "doc_id long, text string")
    plan = privacy.sanitise_texts(df)._jdf.queryExecution().optimizedPlan().toString()
    sent = next(x for x in plan.splitlines() if "ArrowEvalPython" in x)
    assert "clean(text#" not in sent


def test_packing_holds_a_part_of_a_batch(spark, monkeypatch):
    """Python objects of a task are less than its batch's texts, and it gives back what it freed."""
    import tracemalloc

    import pyarrow as pa

    from textloom.llm.packing import pieces, word_ids
    from textloom.llm.queries import tokenizer_path

    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    seen = []
    for name in ("mapInPandas", "mapInArrow"):
        monkeypatch.setattr(type(df), name, lambda self, run, schema, name=name: seen.append((name, run)))
    pieces(df, tokenizer_path())
    (name, run), texts = seen[0], [f"{i} " + f"{i % 7}{'x' * 98} " * 20 for i in range(6_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6_000), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    assert hasattr(run, "__wrapped__")
    word_ids(tokenizer_path()).learn({b"x"})
    tracemalloc.start()
    assert sum(len(out) if name == "mapInPandas" else out.num_rows for out in run(iter([batch.to_pandas() if name == "mapInPandas" else batch]))) == 6_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6_000 * 2_000


def test_the_word_cache_holds_no_more_than_its_bound(spark, monkeypatch):
    """All that a worker keeps counts: words, and the parts that words are put together from."""
    import pyarrow as pa

    from textloom.llm import packing
    from textloom.llm.queries import tokenizer_path

    monkeypatch.setattr(packing, "CACHE_WORDS", 1_000)
    words = packing.WordIds(tokenizer_path())
    for at in range(0, 6_000, 200):
        list(words.encode_all(pa.array([" ".join(f"é{i}é, Z{i}" for i in range(at, at + 200))])))
        assert len(words) + sum(len(x) for x in vars(words).values() if isinstance(x, dict)) <= 1_000
