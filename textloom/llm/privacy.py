"""Personal data: exact patterns, and terms that the corpus shows to reveal a protected entity.

The second part follows information-theoretic sanitisation (Sanchez and Batet, 2013): the corpus estimates how much a
term t tells about a protected entity e by their pointwise mutual information, PMI(t; e) = log(N p(t,e) / (p(t) p(e))),
against the information e itself carries, IC(e) = -log p(e). A term that discloses at least the share `threshold` of
IC(e) gives e away. Such a term is generalised to its class (a number, a name, an identifier of letters and digits), of
which too many texts have one to tell of e, and removed if it is of none of them.

All counts are of distinct texts: n, those with e, those with t and those with both, wherever in the text they stand. An
entity in fewer than `min_contexts` distinct texts has no terms, as every rare word of its text would be one.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.shared_store import materialize
from textloom.llm.names import keeps_other_columns
from textloom.llm.worker_memory import gives_back

#: The kinds in the order of the digest; the method's own spans come last.
KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = ".,;:!?()[]{}<>\"'*&%$#|/\\-_=+~`"
CACHE_WORDS = 150_000
#: Revealing (entity, term) rows that are sent to all tasks.
BROADCAST_ROWS = 200_000
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the four exact kinds, leftmost and non-overlapping in each kind, failing matches dropped."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        # The local part has no @: the leftmost match through this @ starts where its run of characters does.
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def term_key(word: str) -> str:
    return word.strip(EDGE).lower()


class TermHash(dict):
    """Hashes of words' terms; 0 for words without one."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        key = term_key(word)
        self[word] = h = signed_hash(key) if key else 0
        return h


def signed_hash(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass")) - 2**63


def entity_hashes(text: str, spans: list[tuple[int, int, int]]) -> set[int]:
    return {signed_hash(f"{KINDS[k]}:{text[s:e].lower()}") for s, k, e in spans}


def places(text: str, spans: list[tuple[int, int, int]], terms: TermHash) -> list[tuple[int, int, int]]:
    """(term hash, start, end) of the words that no base span touches."""
    words = [(terms[m[0]], m.start(), m.end()) for m in WORD.finditer(text)]
    if spans:
        starts, ends = np.array([w[1] for w in words]), np.array([w[2] for w in words])
        inside = np.zeros(len(words), dtype=bool)
        for s, _, e in spans:
            inside[int(np.searchsorted(ends, s, side="right")) : int(np.searchsorted(starts, e, side="left"))] = True
        words = [w for w, x in zip(words, inside, strict=True) if not x]
    return [w for w in words if w[0]]


def term_set(text: str, spans: list[tuple[int, int, int]], terms: TermHash) -> set[int]:
    if spans:
        return {t for t, _, _ in places(text, spans, terms)}
    return set(map(terms.__getitem__, set(WORD.findall(text)))) - {0}


def _counts(texts: DataFrame) -> DataFrame:
    """(entity, term, texts): a null entity counts the texts with the term, a null term those with the entity."""

    @gives_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = TermHash()

        def table(entity: list, term: list, count: list) -> pd.DataFrame:
            e, t = np.concatenate(entity), np.concatenate(term)
            return pd.DataFrame({"entity": pd.arrays.IntegerArray(e, e == 0), "term": pd.arrays.IntegerArray(t, t == 0), "texts": np.concatenate(count)})

        for pdf in batches:
            df: Counter[int] = Counter()
            entity, term, waiting = [], [], 0
            for text in pdf["text"]:
                spans = base_spans(text)
                own = term_set(text, spans, terms)
                df.update(own)
                if spans:
                    own = np.fromiter([0, *own], dtype=np.int64, count=len(own) + 1)
                    for e in entity_hashes(text, spans):
                        entity.append(np.full(len(own), e, dtype=np.int64))
                        term.append(own)
                        waiting += len(own)
                        if waiting > 250_000:
                            yield table(entity, term, [np.ones(waiting, dtype=np.int64)])
                            entity, term, waiting = [], [], 0
            entity.append(np.zeros(len(df), dtype=np.int64))
            term.append(np.fromiter(df, dtype=np.int64, count=len(df)))
            yield table(entity, term, [np.ones(waiting, dtype=np.int64), np.fromiter(df.values(), dtype=np.int64, count=len(df))])

    return texts.mapInPandas(run, "entity long, term long, texts long").groupBy("entity", "term").agg(F.sum("texts").alias("texts"))


#: Hashes of texts with copies that are sent to all tasks; beyond that number they are joined by shuffle.
BROADCAST_COPIES = 500_000


def distinct_texts(docs: DataFrame, broadcast_copies: int = BROADCAST_COPIES) -> tuple[DataFrame, int]:
    """(text) of one row for each distinct text of `docs` (doc_id, text), and their number.

    Texts aren't shuffled for it, but their hashes and ids: of a text's rows the one with the smallest id stays. Only rows
    that are repeated with their id are compared as whole rows.
    """
    rows = docs.select("text", F.xxhash64("text").alias("h"), F.coalesce("doc_id", F.lit(-(2**63))).alias("i"))
    own = rows.groupBy("h", "i").agg(F.count("*").alias("n"))
    kinds = materialize(own.groupBy("h").agg(F.min(F.struct("i", "n")).alias("first"), F.sum("n").alias("n")).select(F.col("h").alias("h_"), F.col("first.i").alias("i_"), F.col("first.n").alias("same"), "n"), "texts")
    size = kinds.agg(F.count("*"), F.coalesce(F.sum((F.col("n") > 1).cast("int")), F.lit(0)), F.coalesce(F.sum((F.col("same") > 1).cast("int")), F.lit(0))).first()
    copied = kinds.where("n > 1").select("h_", "i_", "same")
    kept = rows.join(F.broadcast(copied) if size[1] <= broadcast_copies else copied, F.col("h") == F.col("h_"), "left").where("h_ IS NULL OR i = i_")
    if size[2]:
        repeated = kept.where("same > 1").select("text", "h").dropDuplicates(["h"])
        kept = kept.where("same IS NULL OR same = 1").select("text", "h").unionByName(repeated)
    return kept.select("text"), size[0]


def revealing_terms(texts: DataFrame, total: int, threshold: float, min_contexts: int) -> DataFrame:
    """(entity, term, alone) of the terms that exceed the disclosure threshold; `texts` are the `total` distinct texts.

    alone: most of the texts with the term have the entity, so the term gives it away where the entity isn't told, too.
    """
    counts = materialize(_counts(texts), "counts")
    entity = counts.where("term IS NULL").select("entity", F.col("texts").alias("contexts")).where(F.col("contexts") >= min_contexts)
    df = counts.where("entity IS NULL").select("term", F.col("texts").alias("df"))
    pairs = counts.where("entity IS NOT NULL AND term IS NOT NULL").withColumnRenamed("texts", "both").where(F.col("both") >= min_contexts)
    n = F.lit(float(max(total, 2)))
    told = pairs.join(entity, "entity").join(df, "term")
    told = told.withColumn("ic", F.log(n / F.col("contexts"))).withColumn("pmi", F.log(n * F.col("both") / (F.col("contexts") * F.col("df"))))
    return told.where((F.col("ic") > 0) & (F.col("pmi") >= threshold * F.col("ic"))).select("entity", "term", (F.col("both") * 2 > F.col("df")).alias("alone"))


def _own_terms(docs: DataFrame, told: DataFrame) -> DataFrame:
    """(row_key, own): the terms of each row to be marked, by shuffle joins."""

    @gives_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = TermHash()
        for pdf in batches:
            for key, text in zip(pdf["row_key"], pdf["text"], strict=True):
                spans = base_spans(text)
                for kind, own in ((0, entity_hashes(text, spans)), (1, term_set(text, spans, terms))):
                    if own:
                        yield pd.DataFrame({"row_key": key, "kind": kind, "x": np.fromiter(own, dtype=np.int64, count=len(own))})

    rows = docs.select("row_key", "text").mapInPandas(run, "row_key long, kind int, x long")
    by_entity = rows.where("kind = 0").select("row_key", F.col("x").alias("entity")).join(told, "entity").select("row_key", "term")
    alone = rows.where("kind = 1").select("row_key", F.col("x").alias("term")).join(told.where("alone"), "term", "left_semi").select("row_key", "term")
    return by_entity.unionByName(alone).groupBy("row_key").agg(F.collect_set("term").alias("own"))


def find_private(docs: DataFrame, threshold: float = 0.75, min_contexts: int = 2, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, row_key, base, terms) for each row of `docs` (doc_id, text): base spans and added term spans.

    Corpus statistics cover all distinct texts, whole. In a row with an entity every occurrence of its terms is marked;
    in all other rows every occurrence of a term of which most texts have the entity. A null text is empty; an empty
    text has no spans. Repeated rows give equal results each; a null doc_id is kept. An empty table gives an empty
    result and other columns are not read. The revealing terms are sent to all tasks up to `broadcast_rows` of them and
    joined by row beyond.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    texts, total = distinct_texts(docs)
    told = materialize(revealing_terms(texts, total, threshold, min_contexts), "revealing")
    sent = None
    if told.count() <= broadcast_rows:
        rows = told.toPandas()
        by_entity: dict[int, set[int]] = {}
        for e, t in zip(rows["entity"].tolist(), rows["term"].tolist(), strict=True):
            by_entity.setdefault(e, set()).add(t)
        sent = docs.sparkSession.sparkContext.broadcast((by_entity, set(rows["term"][rows["alone"].astype(bool)].tolist())))
        docs = docs.withColumn("own", F.lit(None).cast("array<long>"))
    else:
        docs = docs.join(_own_terms(docs, told), "row_key", "left")

    @gives_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = TermHash()
        by_entity, alone = sent.value if sent is not None else ({}, set())
        for pdf in batches:
            rows = []
            for doc_id, row_key, text, own in zip(pdf["doc_id"].astype("Int64"), pdf["row_key"], pdf["text"], pdf["own"], strict=True):
                spans = base_spans(text)
                wanted = set() if own is None else set(own.tolist())
                for e in entity_hashes(text, spans) if by_entity else ():
                    wanted |= by_entity.get(e, set())
                terms = None
                if wanted or (alone and not alone.isdisjoint(map(hashes.__getitem__, set(WORD.findall(text))))):
                    terms = [(a, b) for t, a, b in places(text, spans, hashes) if t in wanted or t in alone]
                    terms = [{"start": a + len(w) - len(w.lstrip(EDGE)), "kind": 4, "end": a + len(w.rstrip(EDGE))} for a, b in terms for w in (text[a:b],)] or None
                rows.append((doc_id, row_key, [{"start": s, "kind": k, "end": e} for s, k, e in spans], terms))
            yield pd.DataFrame(rows, columns=["doc_id", "row_key", "base", "terms"]).astype({"doc_id": "Int64"})

    span = "array<struct<start:int,kind:int,end:int>>"
    return materialize(docs.select("doc_id", "row_key", "text", "own").mapInPandas(run, f"doc_id long, row_key long, base {span}, terms {span}"), "found")


def spans_digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term) of each row that find_private() gives.

    Of a row without spans the counts are 0, base_sha256 is that of an empty string and spans is empty. A null doc_id and
    repeated rows are kept; an empty table gives an empty result.
    """

    @gives_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, base, terms in zip(pdf["doc_id"].astype("Int64"), pdf["base"], pdf["terms"], strict=True):
                own = [(x["start"], x["kind"], x["end"]) for x in base]
                more = [(x["start"], x["kind"], x["end"]) for x in terms] if terms is not None else []
                n = [sum(k == i for _, k, _ in own) for i in range(4)]
                rows.append((doc_id, *n, hashlib.sha256(digest(own).encode()).hexdigest(), digest(sorted(own + more)), len(more)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term"]).astype({"doc_id": "Int64"})

    return found.mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long")


def generalised(term: str) -> str:
    """The class that stands for a revealing term; nothing for a term without one."""
    digits, letters = any(c.isdigit() for c in term), any(c.isalpha() for c in term)
    if digits:
        return "<ID>" if letters else "<NUMBER>"
    return "<NAME>" if term[:1].isupper() else ""


def sanitise(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each personal datum generalised to its kind and each revealing term to its class, or removed if it has
    none; overlaps are merged. Spans are (start, kind, end); without spans the text is unchanged."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out.append(text[at:start])
            out.append(generalised(text[start:end]) if kind == 4 else f"<{KINDS[kind].upper()}>")
        at = max(at, end)
    return "".join(out) + text[at:]


@gives_back
def clean(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The sanitised texts of (text, base spans, term spans or null); null for a null text."""
    for text, base, terms in batches:
        spans = ([] if b is None else [(x["start"], x["kind"], x["end"]) for x in [*b, *([] if m is None else m)]] for b, m in zip(base, terms, strict=True))
        yield pd.Series([None if t is None else sanitise(t, s) for t, s in zip(text, spans, strict=True)], dtype="object")


@keeps_other_columns
def sanitise_texts(docs: DataFrame, **settings) -> DataFrame:
    """`docs` with every column, its texts sanitised; see find_private() for `settings`.

    A null text stays null, a text without personal data stays as it is. Repeated rows give equal rows each, a null doc_id is
    kept, an empty table stays empty.
    """
    found = find_private(docs, **settings).where((F.size("base") > 0) | F.col("terms").isNotNull())
    found = found.groupBy("row_key").agg(F.first("base").alias("__base"), F.first("terms").alias("__terms"))
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    joined = docs.withColumn("__key", key).join(found.withColumnRenamed("row_key", "__key"), "__key", "left")

    # Python gets the texts that change, no others.
    cleaned = F.pandas_udf(clean, "string")(F.when(F.col("__base").isNotNull(), F.col("text")), "__base", "__terms")
    text = F.when(F.col("__base").isNull(), F.col("text")).otherwise(cleaned)
    return joined.withColumn("text", text).select(*docs.columns)
