"""Quantifier audit: sentences with universal claims, tags, decisions, receipts; all per document until the totals."""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.fixed import ABBREVIATIONS_EN, AUDIT_TABLE, EXCLUSIONS_EN, LANGS, WS

EDGE = r"[A-Za-z0-9_]"


def _low(word: str) -> str:
    return word.translate({c: c + 32 for c in range(65, 91)})


def _pieces(text: Column, lang: str) -> Column:
    """array<string>: the text cut after each terminator; empty and blank pieces are still there."""
    if lang == "ja":
        cut = r"(?<=[。！？\n])"
    elif lang == "en":
        words = "|".join(re.escape(a[:-1]) for a in ABBREVIATIONS_EN)
        cut = rf"(?<=[!?\n.])(?<!\.(?![{WS}]|\z))(?<!(?<![\p{{L}}.])(?i:{words})\.)"
    else:
        raise ValueError(f"unsupported audit lang: {lang!r}")
    return F.split(text, cut)


def _is_unit(piece: Column) -> Column:
    """Whether a piece is more than white space and one bare terminator."""
    return ~piece.rlike(rf"^[{WS}]*(?:[。！？][{WS}]*)?\z")


def sentence_units(text: Column, lang: str) -> Column:
    """array<struct<start, end, text>>: units that end after a terminator, blank ones and bare terminators left out."""
    ends = lambda p: F.zip_with(p, T.running_sums(F.transform(p, F.length)), lambda x, e: F.struct((e - F.length(x)).alias("start"), e.alias("end"), x.alias("text")))
    return F.filter(T.let(_pieces(text, lang), ends), lambda u: _is_unit(u["text"]))


def _claim_pattern(word: str, phrases: tuple[str, ...]) -> str:
    """A regex of `word` between word edges that no phrase, itself between word edges, overlaps.

    For each place that a phrase can take over the word, where their letters agree, a look-around rules it out.
    """
    guards = []
    for p in phrases:
        for shift in range(-len(p) + 1, len(word)):  # the phrase begins `shift` characters after the word does
            lo, hi = max(0, shift), min(len(word), shift + len(p))
            if word[lo:hi] != p[lo - shift : hi - shift]:
                continue
            if shift < 0:
                before, rest = re.escape(p[:-shift]), re.escape(p[-shift:])
                guards.append(rf"(?!(?<=(?<!{EDGE}){before}){rest}(?!{EDGE}))")
            else:
                edge = rf"(?<!{EDGE})" if shift else ""
                guards.append(rf"(?!{re.escape(word[:shift])}{edge}{re.escape(p)}(?!{EDGE}))")
    return rf"(?<!{EDGE})" + "".join(dict.fromkeys(guards)) + re.escape(word) + rf"(?!{EDGE})"


def _found(sentence: Column, vocab: tuple[str, ...], lang: str, phrases: tuple[str, ...]) -> Column:
    """array<struct<at, idx, word>> of the words found, by (first position, index).

    `at` orders and isn't an offset to report: the length of what stands before the first hit.
    """
    hits = []
    for i, w in enumerate(dict.fromkeys(vocab)):
        if lang == "en":
            pattern = _claim_pattern(_low(w), phrases)
            at = F.when(sentence.rlike(pattern), F.length(F.element_at(F.split(sentence, pattern, 2), 1)))
        else:
            at = F.when(F.contains(sentence, F.lit(w)), F.locate(w, sentence) if w else F.lit(0))
        hits.append(F.struct(at.alias("at"), F.lit(i).alias("idx"), F.lit(w).alias("word")))
    if not hits:
        return F.array().cast("array<struct<at:int,idx:int,word:string>>")
    return F.array_sort(F.filter(F.array(*hits), lambda h: h["at"].isNotNull()))


def _any_word(sentence: Column, vocab: tuple[str, ...], lang: str, phrases: tuple[str, ...]) -> Column:
    """Whether `_found` finds a word."""
    tests = []
    for w in dict.fromkeys(vocab):
        has = F.contains(sentence, F.lit(_low(w) if lang == "en" else w))
        tests.append(has & sentence.rlike(_claim_pattern(_low(w), phrases)) if lang == "en" else has)
    return reduce(or_, tests, F.lit(False))


def _may_have_word(text: Column, vocab: tuple[str, ...], lang: str) -> Column:
    """False only where no sentence of `text` has a word: one test of a whole text, or a sentence, before it is looked at closely.

    A sentence begins after a terminator, which is no letter, so edges before words are those of the text; a word that ends
    in a terminator itself may end its sentence before a letter.
    """
    words = dict.fromkeys(vocab)
    if lang != "en":
        return reduce(or_, (F.contains(text, F.lit(w)) for w in words), F.lit(False))
    tests = "|".join(re.escape(_low(w)) + ("" if not w or w[-1] in "!?.\n" else rf"(?!{EDGE})") for w in words)
    return text.rlike(rf"(?i)(?<!{EDGE})(?:{tests})") if words else F.lit(False)


def markers(sentence: Column, vocab: tuple[str, ...], lang: str) -> Column:
    """Certainty markers in the sentence, in the vocabulary's order. Their letters are looked for before their edges are."""
    words = [w for w in dict.fromkeys(vocab) if w]
    if not words:
        return F.array().cast("array<string>")

    def found(low: Column) -> Column:
        edges = lambda w: low.rlike(rf"(?<!{EDGE}){re.escape(_low(w))}(?!{EDGE})") if lang == "en" else F.lit(True)
        return F.filter(F.array(*(F.when(F.contains(low, F.lit(_low(w) if lang == "en" else w)) & edges(w), F.lit(w)) for w in words)), lambda x: x.isNotNull())

    return T.let(T.ascii_lower(sentence) if lang == "en" else sentence, found)


def scope_hint(sentence: Column) -> Column:
    return F.when(sentence.rlike("[0-9０-９％%割]"), "measured").otherwise("universal")


def sentence_rows(docs: DataFrame, lang: str) -> DataFrame:
    """(doc_id, start, end, text) of each unit."""
    return docs.select("doc_id", F.explode(sentence_units(F.col("text"), lang)).alias("u")).select("doc_id", "u.start", "u.end", "u.text")


def candidates(docs: DataFrame, lang: str = "ja", vocab: tuple[str, ...] | None = None, exclusions: tuple[str, ...] | None = None,
               modifiers: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, seq, start, end, patterns, sentence_text, sentence_sha256, scope_hint, certainty_markers) of `docs` (doc_id, text).

    English words are found between word edges, in any case, except where an exclusion phrase overlaps them, and never in
    questions; Japanese ones anywhere. A null text has no candidates.
    """
    if lang not in LANGS:
        raise ValueError(f"unsupported audit lang: {lang!r} (valid: ja, en)")
    vocab = LANGS[lang][0] if vocab is None else tuple(vocab)
    modifiers = LANGS[lang][1] if modifiers is None else tuple(modifiers)
    phrases = tuple(_low(p) for p in (EXCLUSIONS_EN if exclusions is None else exclusions)) if lang == "en" else ()
    # Forms that the tests share are made with the units: above the explode they'd be computed anew in every test.
    forms = lambda u: F.struct(u["start"], u["end"], T.strip(u["text"]).alias("sentence_text"), (T.ascii_lower(u["text"]) if lang == "en" else u["text"]).alias("low"))
    may = lambda x: _may_have_word(x, vocab, lang)
    units = F.transform(F.filter(sentence_units(F.col("text"), lang), lambda u: may(u["text"])), forms)
    rows = docs.where(may(F.col("text"))).select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.*")
    if lang == "en":
        rows = rows.where(~F.col("sentence_text").endswith("?"))
    # The words are listed for sentences that have one; letters are looked for before a word's pattern is tried.
    rows = rows.where(_any_word(F.col("low"), vocab, lang, phrases)).withColumn("hits", _found(F.col("low"), vocab, lang, phrases))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("start"))
    s = F.col("sentence_text")
    return rows.select(
        "doc_id", seq.alias("seq"), "start", "end", F.transform("hits", lambda h: h["word"]).alias("patterns"), "sentence_text",
        F.sha2(s.cast("binary"), 256).alias("sentence_sha256"), scope_hint(s).alias("scope_hint"), markers(s, modifiers, lang).alias("certainty_markers"),
    )


def audit_table(spark: SparkSession, lang: str) -> DataFrame:
    return spark.createDataFrame([(b, s, x[0], x[1], x[3 if lang == "en" else 2]) for (b, s), x in AUDIT_TABLE.items()], "backing string, scope string, signal string, pattern_name string, reason string")


def decided(found: DataFrame, tags: DataFrame | None, lang: str = "ja") -> DataFrame:
    """Candidates with backing, scope, evidence, signal, pattern_name and reason.

    `tags`: (sentence_sha256, backing, scope, evidence), as load_tags() gives; a missing tag or value is unbacked and
    universal. A hand-written file is small, but no hint is given: Spark broadcasts it below its threshold.
    """
    if tags is None:
        rows = found.withColumns({"backing": F.lit(None).cast("string"), "scope": F.lit(None).cast("string"), "evidence": F.lit(None).cast("string")})
    else:
        rows = found.join(tags.select("sentence_sha256", "backing", "scope", "evidence"), "sentence_sha256", "left")
    rows = rows.withColumns({"backing": F.coalesce("backing", F.lit("unbacked")), "scope": F.coalesce("scope", F.lit("universal"))})
    return rows.join(F.broadcast(audit_table(found.sparkSession, lang)), ["backing", "scope"])


def unused_tags(tags: DataFrame, found: DataFrame) -> DataFrame:
    """Tags of no candidate, in the file's order (`n`)."""
    return tags.join(found.select("sentence_sha256").distinct(), "sentence_sha256", "left_anti").select("n", "sentence_sha256")


def document_receipts(docs: DataFrame, rows: DataFrame, lang: str = "ja") -> DataFrame:
    """(doc_id, char_count, sentence_count, green, yellow, red, certainty_flagged) for every document, zeros included."""
    counts = rows.groupBy("doc_id").agg(*(F.count_if(F.col("signal") == s.upper()).alias(s) for s in ("green", "yellow", "red")), F.count_if(F.size("certainty_markers") > 0).alias("certainty_flagged"))
    own = docs.select("doc_id", F.length("text").cast("long").alias("char_count"), F.size(F.filter(_pieces(F.col("text"), lang), _is_unit)).cast("long").alias("sentence_count"))
    out = own.join(counts, "doc_id", "left")
    return out.select("doc_id", "char_count", "sentence_count", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("green", "yellow", "red", "certainty_flagged")))


def totals(receipts: DataFrame) -> DataFrame:
    """One row: documents, candidates, green, yellow, red, certainty_flagged."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return receipts.agg(F.count("*").alias("documents"), s(F.col("green") + F.col("yellow") + F.col("red")).alias("candidates"), s("green").alias("green"), s("yellow").alias("yellow"), s("red").alias("red"), s("certainty_flagged").alias("certainty_flagged"))


def backing_totals(rows: DataFrame) -> DataFrame:
    """(backing, n): candidates of each of the four backings, zeros included."""
    kinds = rows.sparkSession.createDataFrame([("theorem",), ("enumerated",), ("sample",), ("unbacked",)], "backing string")
    return kinds.join(rows.groupBy("backing").agg(F.count("*").alias("n")), "backing", "left").select("backing", F.coalesce("n", F.lit(0)).alias("n"))


def vocabulary_hash(vocab: tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(vocab).encode()).hexdigest()


def resolve_lang(docs: DataFrame, lang: str = "auto", least: float = 0.05) -> str:
    """ja if at least `least` of all characters are kana, else en; a stated language is kept."""
    if lang != "auto":
        return lang
    kana, total = T.kana_ratio(F.coalesce("text", F.lit("")))
    row = docs.agg(kana.alias("kana"), total.alias("total")).first()
    return "ja" if row["total"] and row["kana"] / row["total"] >= least else "en"
