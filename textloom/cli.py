"""Command line: screens the *.txt files of a folder, with the options and exit codes of the reports."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from textloom.operators.audit import resolve_lang
from textloom.operators.pairs import clusters, in_report_order, indirect_chains, members, screen
from textloom.operators.spans import explain_files
from textloom.plans.screening import audit_receipt
from textloom.sources.files import TagFileError, documents, load_tags, load_vocabulary, name_collisions, read_files, skipped
from textloom.sources.folders import write_pages
from textloom.sources.reports import as_json, dashboard, diff_pages, payload, standalone, worksheet


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom")
    p.add_argument("target_dir")
    p.add_argument("--output-dir", default="reports")
    p.add_argument("--json", action="store_true")
    p.add_argument("--json-file")
    p.add_argument("--fail-on-risk", action="store_true")
    p.add_argument("-j", "--jobs", type=int, help="shuffle partitions")
    p.add_argument("--standalone", action="store_true")
    p.add_argument("--audit", action="store_true")
    p.add_argument("--audit-vocab")
    p.add_argument("--audit-modifier-vocab")
    p.add_argument("--audit-tags")
    p.add_argument("--lang", choices=("auto", "ja", "en"), default="ja")
    p.add_argument("--risk-index", action="store_true")
    p.add_argument("--fail-on-unverified", action="store_true")
    p.add_argument("--spans", action="store_true")
    p.add_argument("--base")
    p.add_argument("--exclude-quotes", action="store_true")
    p.add_argument("--exclude-bibliography", action="store_true")
    return p


def fail(why: str) -> int:
    print(f"error: {why}", file=sys.stderr)
    return 2


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Returns the exit code: 1 for a gate that a result fails, 2 for an input that can't be used."""
    args = parser().parse_args(argv)
    auditing = args.audit or args.risk_index or args.fail_on_unverified or any((args.audit_vocab, args.audit_modifier_vocab, args.audit_tags))
    if args.spans and (args.base or args.exclude_quotes or args.exclude_bibliography):
        return fail("--spans can't be combined with options that change the texts")
    if not Path(args.target_dir).is_dir():
        return fail(f"no such folder: {args.target_dir}")
    spark = spark or SparkSession.builder.appName("textloom").getOrCreate()
    if args.jobs:
        spark.conf.set("spark.sql.shuffle.partitions", args.jobs)
    files = read_files(spark, args.target_dir).persist()
    docs = documents(files)
    left_out = [{"path": r["path"].removeprefix("file:"), "reason": r["reason"]} for r in skipped(files).collect()]
    for x in left_out:
        print(f"skipped: {x['path']} ({x['reason']})", file=sys.stderr)
    bases = None
    if args.base:
        if not Path(args.base).is_dir():
            return fail(f"no such base folder: {args.base}")
        base_files = read_files(spark, args.base).persist()
        bases = documents(base_files)
        if base_files.isEmpty() or not skipped(base_files).isEmpty():
            return fail("base documents must all be readable, and there must be some")
        if not name_collisions(docs, bases).isEmpty():
            return fail("a base document has the name of a target")
    n = docs.count()
    if n < (1 if auditing else 2):
        return fail("not enough readable documents")
    rows, chains, results = [], [], None
    if n >= 2:
        results = screen(docs, bases, args.exclude_quotes, args.exclude_bibliography).persist()
        rows = in_report_order(results).collect()
        found = clusters(results)
        lists = members(found)
        chains = [(r["item_id_a"], r["item_id_b"], r["members"]) for r in indirect_chains(results, found).join(lists, "component").orderBy("item_id_a", "item_id_b").collect()]
    audit, sheets = None, {}
    if auditing:
        try:
            lang = resolve_lang(docs, args.lang)
            vocab = load_vocabulary(spark, args.audit_vocab) if args.audit_vocab else None
            modifiers = load_vocabulary(spark, args.audit_modifier_vocab) if args.audit_modifier_vocab else None
            tags = load_tags(spark, args.audit_tags) if args.audit_tags else None
            audit, sheets = audit_receipt(docs, lang, vocab, tags, modifiers, args.risk_index)
        except (TagFileError, OSError) as e:
            return fail(str(e))
    spans = None
    if args.spans and results is not None:
        found_in = explain_files(files.where("reason IS NULL"), results)
        spans = {r["pair_key"]: [s.asDict() for s in r["spans"]] for r in found_in.orderBy("item_id", "matched_peer_id").toLocalIterator()}
    text = as_json(payload(rows, left_out, spans, audit))
    if args.json:
        print(text)
    if args.json_file:
        Path(args.json_file).write_text(text, encoding="utf-8")
    if audit is not None and not args.json:
        print(worksheet(audit, sheets))
    if results is not None:
        out = Path(args.output_dir)
        out.mkdir(parents=True, exist_ok=True)
        pages = diff_pages(results, docs)
        if args.standalone:  # one file that holds all pages
            (out / "standalone_dashboard.html").write_text(standalone({r["pair_key"]: r["html"] for r in pages.toLocalIterator()}), encoding="utf-8")
        else:
            write_pages(pages, str(out / "diff_htmls"))
        red = [(r["item_id"], r["matched_peer_id"]) for r in rows if r["evaluation_signal"] == "RED"]
        (out / "dashboard.html").write_text(dashboard(red, chains, len(left_out)), encoding="utf-8")
        if args.fail_on_risk and red:
            return 1
    if args.fail_on_unverified and audit is not None and audit["unverified_remaining"]:
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
