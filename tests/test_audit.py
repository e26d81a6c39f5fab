import hashlib
import itertools
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.fixed import ABBREVIATIONS_EN, EXCLUSIONS_EN, QUANTIFIERS_EN
from textloom.operators import audit, risk
from textloom.plans.screening import audit_receipt
from textloom.sources.files import TagFileError, load_tags, load_vocabulary, parse_tags, tag_table, text_with_map
from textloom.sources.reports import worksheet


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def units(spark, text, lang):
    return [(r["start"], r["end"], r["text"]) for r in audit.sentence_rows(docs(spark, text), lang).orderBy("start").collect()]


def test_units(spark):
    assert units(spark, "ああ。い！\n。う", "ja") == [(0, 3, "ああ。"), (3, 5, "い！"), (7, 8, "う")]
    assert units(spark, "Dr. A has 3.14. See run.py. Hi!!", "en") == [(0, 15, "Dr. A has 3.14."), (15, 27, " See run.py."), (27, 31, " Hi!"), (31, 32, "!")]


def plain_units(text):
    out, start = [], 0
    for i, c in enumerate(text):
        if c == ".":
            if i + 1 < len(text) and not text[i + 1].isspace():
                continue
            if re.search(r"[A-Za-z.]*\Z", text[: i + 1])[0].lower() in ABBREVIATIONS_EN:
                continue
        elif c not in "!?\n":
            continue
        out.append((start, i + 1, text[start : i + 1]))
        start = i + 1
    if start < len(text):
        out.append((start, len(text), text[start:]))
    return [x for x in out if x[2].strip()]


def plain_hits(low, word):
    edge = lambda i: i < 0 or i >= len(low) or not re.match(r"[A-Za-z0-9_]", low[i])
    return [i for i in range(len(low)) if low.startswith(word, i) and edge(i - 1) and edge(i + len(word))]


def test_english_candidates_against_plain_code(spark):
    rng = random.Random(8)
    parts = [*QUANTIFIERS_EN[:12], *EXCLUSIONS_EN, "not", "node", "sync", "e.g.", "X", "rights", "know", "i", "but", "-", "_", "."]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", " ", "", ". ", "! ", "? ", "\n"]) for _ in range(rng.randrange(1, 25))) for _ in range(250)]
    got = {}
    for r in audit.candidates(docs(spark, *texts), "en").collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["patterns"], r["sentence_sha256"]))
    for i, text in enumerate(texts):
        want = []
        for s, e, raw in plain_units(text):
            if raw.strip().endswith("?"):
                continue
            low = raw.lower()
            gone = [(p, p + len(x)) for x in EXCLUSIONS_EN for p in plain_hits(low, x)]
            hits = [(p, v, w) for v, w in enumerate(QUANTIFIERS_EN) for p in plain_hits(low, w) if not any(p < b and a < p + len(w) for a, b in gone)]
            if hits:
                want.append((s, e, list(dict.fromkeys(w for *_, w in sorted(hits))), hashlib.sha256(raw.strip().encode()).hexdigest()))
        assert sorted(got.get(i, [])) == sorted(want), text


def test_japanese_candidates(spark):
    rows = audit.candidates(docs(spark, "次は常にすべて正しい。明らかに全て50％。ない。"), "ja").orderBy("seq").collect()
    assert [(r["seq"], r["patterns"], r["scope_hint"], r["certainty_markers"]) for r in rows] == [(1, ["常に", "すべて"], "universal", []), (2, ["全て"], "measured", ["明らかに"])]
    with pytest.raises(ValueError):
        audit.candidates(docs(spark, "x"), "fr")


def test_tags():
    key = "A" * 64
    assert parse_tags(json.dumps({key: "theorem"})) == [(0, "a" * 64, "theorem", None, None)]
    assert parse_tags(json.dumps({key: {"scope": "measured", "evidence": "e"}})) == [(0, "a" * 64, None, "measured", "e")]
    for bad in ('{"x": "theorem"}', "[]", "{", json.dumps({key: "unbacked"}), json.dumps({key: 3}), json.dumps({key: {"evidence": 1}}), json.dumps({key: {"scope": "all"}})):
        with pytest.raises(TagFileError):
            parse_tags(bad)


def test_receipt_and_sheet(spark):
    text = "# T\nAll nodes sync. Clearly every test passed 3 times.\nIs it all?\n"
    sha = hashlib.sha256(b"All nodes sync.").hexdigest()
    tags = tag_table(spark, parse_tags(json.dumps({sha: "sample", "f" * 64: "theorem"})))
    found, sheets = audit_receipt(docs(spark, text, "nothing here"), "en", tags=tags, risk=True)
    assert found["unused_tags"] == ["f" * 64] and found["tag_counts"] == {"theorem": 0, "enumerated": 0, "sample": 1, "unbacked": 1}
    first, second = found["documents"]
    assert first["signal_counts"] == {"GREEN": 0, "YELLOW": 1, "RED": 1} and first["certainty_flagged"] == 1 and first["unverified_remaining"] == 1
    assert [c["risk_index"] for c in first["candidates"]] == [77, 68]
    assert second["candidates"] == [] and second["sentence_count"] == 1
    assert "sync" not in json.dumps(found)
    sheet = worksheet(found, sheets)
    assert "UNVERIFIED REMAINING: 1" in sheet and "(no quantifier candidates)" in sheet and "--- PRIORITY" in sheet and "unused tags (not matched to any candidate): 1" in sheet


def test_headings(spark):
    text = "# A\ntext\n## B \n#nope\n####### seven\n```\n# fenced\n```\n  ### C"
    rows = risk.headings(docs(spark, text)).orderBy("offset").collect()
    assert [(r["offset"], r["depth"]) for r in rows] == [(0, 1), (9, 2), (52, 3)]


def test_risk_scores(spark):
    text = "All every each.\n# H\nAll a.\n### D\nNo a. No b. No c. No d."
    rows = risk.with_risk(docs(spark, text), audit.candidates(docs(spark, text), "en")).orderBy("seq").collect()
    assert [(r["heading_depth"], r["section_rank"], r["pattern_count"], r["risk_index"]) for r in rows] == [
        (0, 1, 3, 100), (1, 1, 1, 77), (3, 1, 1, 61), (3, 2, 1, 52), (3, 3, 1, 52), (3, 4, 1, 43)]


def test_language(spark):
    assert audit.resolve_lang(docs(spark, "か" * 5 + "a" * 95)) == "ja"
    assert audit.resolve_lang(docs(spark, "か" * 4 + "a" * 96)) == "en"
    assert audit.resolve_lang(docs(spark, "")) == "en"
    assert audit.resolve_lang(docs(spark, "a"), "ja") == "ja"


def test_markers_at_edges(spark):
    df = docs(spark, "Clearly, by definition; unclearly").select(audit.markers(F.col("text"), ("clearly", "by definition", "manifestly"), "en").alias("m"))
    assert df.first()["m"] == ["clearly", "by definition"]


def test_file_map():
    assert text_with_map("  ﬁx ") == ("fix", [2, 2, 3, 4])
    assert text_with_map(" \n") is None


def test_missing_and_empty_files(spark, tmp_path):
    with pytest.raises(TagFileError, match="not found"):
        load_tags(spark, str(tmp_path / "none.json"))
    with pytest.raises(FileNotFoundError):
        load_vocabulary(spark, str(tmp_path / "none.txt"))
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "words.txt").write_text("# words\n\n all \nnone\n")
    assert load_vocabulary(spark, str(tmp_path / "empty.txt")) == ()
    assert load_vocabulary(spark, str(tmp_path / "words.txt")) == ("all", "none")
    with pytest.raises(TagFileError, match="JSON"):
        load_tags(spark, str(tmp_path / "empty.txt"))


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 127, 128, 129, 256, 257, 5000)] + [None]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, v array<int>")
    got = {r["i"]: r["s"] for r in df.select("i", T.running_sums(F.col("v")).alias("s")).collect()}
    assert got == {i: None if v is None else list(itertools.accumulate(v)) for i, v in enumerate(rows)}


def test_units_of_a_text_of_200_000_sentences(spark):
    """Places as of plain code; twice the sentences take no four times as long."""
    text = lambda n: "".join(f"Line {i} ends.{' ' if i % 3 else chr(10)}" for i in range(n))
    times = []
    for n in (100_000, 200_000):
        df = spark.createDataFrame([(0, text(n))], "doc_id int, text string").cache()
        df.count()
        began = time.time()
        got = audit.sentence_rows(df, "en").agg(F.count("*").alias("n"), F.sum(F.col("start").cast("long")).alias("s"), F.sum(F.col("end").cast("long")).alias("e")).first()
        times.append(time.time() - began)
        at, starts, ends = 0, 0, 0
        for i in range(n):
            starts += at + (i > 0 and (i - 1) % 3 == 0)  # a line's end is a blank unit of its own; a space begins the next
            ends += (at := at + (i > 0)) + len(f"Line {i} ends.")
            at += len(f"Line {i} ends.")
        assert (got["n"], got["s"], got["e"]) == (n, starts, ends)
    assert times[1] < 3.5 * times[0] + 2


def test_sections_over_parts(spark):
    """Headings, sections and ranks don't depend on where documents are divided."""
    rng = random.Random(5)
    lines = ["# A", "## B c", "###### f", "```", "~~~", "We must do it. All are well.", "It never ends. They always go.", "plain", ""]
    df = docs(spark, *("\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 60))) for _ in range(15)), "", None)
    rows = audit.candidates(df, "en")
    plain = lambda x: sorted(tuple(r) for r in x.collect())
    want = plain(risk.headings(df))
    assert want and all(plain(risk.headings(df, n)) == want for n in (1, 3))
    pick = lambda n: plain(risk.with_risk(df, rows, n).select("doc_id", "seq", "heading_depth", "section_rank", "risk_index"))
    whole = pick(1 << 20)
    assert max(r[3] for r in whole) > 3 and pick(40) == whole


def test_candidates_are_found_once(spark):
    """Tags, decisions and risks read a table of candidates: no plan splits the documents again."""
    from textloom.plans import queries

    for name in ("audit_tagged", "audit_unused_tags", "audit_backing_totals"):
        files = queries.QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
        assert files and not any("documents.parquet" in f for f in files), name


def test_whole_texts_are_tested_first(spark):
    """The test of a whole text keeps each that has a sentence with a word, also where a word ends its sentence."""
    texts = ["x no!y", "no!", "No", "a_no", "snow.", "x\nALL\ny", "now. every one", None, ""]
    for vocab in (("no!", "all"), ("no", "every"), ("",), ()):
        rows = docs(spark, *texts)
        got = sorted((r.doc_id, r.start) for r in audit.candidates(rows, "en", vocab, ()).collect())
        low = audit.sentence_rows(rows, "en").withColumn("low", T.ascii_lower(F.col("text")))
        assert got == sorted((r.doc_id, r.start) for r in low.where(audit._any_word(F.col("low"), vocab, "en", ())).collect())
