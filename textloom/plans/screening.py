"""Whole flows: the audit of documents, and what the command line runs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from textloom.functions.fixed import LANGS
from textloom.functions.shared_store import materialize
from textloom.operators.audit import candidates, decided, document_receipts, unused_tags
from textloom.operators.risk import with_risk
from textloom.sources.reports import receipt


def audit(docs: DataFrame, lang: str = "ja", vocab: tuple[str, ...] | None = None, tags: DataFrame | None = None, modifiers: tuple[str, ...] | None = None,
          risk: bool = False) -> tuple[DataFrame, DataFrame, list[str]]:
    """(candidates, receipts by document, unused tags)."""
    found = materialize(candidates(docs, lang, vocab, None, modifiers), "candidates")
    rows = decided(found, tags, lang)
    if risk:
        rows = with_risk(docs, rows)
    rows = materialize(rows, "decided")
    left = [] if tags is None else [r["sentence_sha256"] for r in unused_tags(tags, found).orderBy("n").collect()]  # of a hand-written file
    return rows, document_receipts(docs, rows, lang), left


def audit_receipt(docs: DataFrame, lang: str = "ja", vocab: tuple[str, ...] | None = None, tags: DataFrame | None = None, modifiers: tuple[str, ...] | None = None, risk: bool = False) -> tuple[dict, dict]:
    """The receipt and the sheets, for reports of a size that people read."""
    rows, receipts, left = audit(docs, lang, vocab, tags, modifiers, risk)
    return receipt(receipts, rows, left, lang, LANGS[lang][0] if vocab is None else tuple(vocab), LANGS[lang][1] if modifiers is None else tuple(modifiers), risk)
