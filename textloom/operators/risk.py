"""Positional risk index of audit candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.fixed import BY_DEPTH, BY_PATTERNS, BY_RANK, WEIGHTS, WS
from textloom.functions.shared_store import materialize


#: Lines, and characters, of a document that one task looks at in order: longer documents go to several.
LINES_PART, CHARS_PART = 4096, 1 << 20


def headings(docs: DataFrame, part: int = LINES_PART) -> DataFrame:
    """(doc_id, line, offset, depth) of the ATX headings outside fences; offset is where the line starts.

    A line's state, its offset and whether a fence is open, is that of its part of `part` lines and what is summed over the
    parts before. A null text has no headings.
    """
    # A text without a line of marks has none: its lines aren't made.
    docs = docs.where(F.col("text").rlike(rf"(?:^|\n)[{WS}]*#{{1,6}}(?:[{WS}]|\z)"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw")).withColumn("part", F.floor(F.col("line") / part))
    lines = lines.withColumn("s", T.strip(F.col("raw"))).withColumn("fence", (F.col("s").startswith("```") | F.col("s").startswith("~~~")).cast("int")).withColumn("n", F.length("raw") + 1)
    mark = F.regexp_extract("s", rf"^(#{{1,6}})(?:[{WS}]|\z)", 1)
    lines = lines.select("doc_id", "part", "line", "fence", "n", F.length(mark).alias("depth"))  # texts stay behind
    before = lambda x, w: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts, own = Window.partitionBy("doc_id").orderBy("part"), Window.partitionBy("doc_id", "part").orderBy("line")
    sums = lines.groupBy("doc_id", "part").agg(F.sum("n").alias("n"), F.sum("fence").alias("fence"))
    sums = sums.select("doc_id", "part", before("n", parts).alias("offset_before"), before("fence", parts).alias("fences_before"))
    found = lines.select("doc_id", "part", "line", "fence", "depth", before("n", own).alias("offset"), before("fence", own).alias("fences"))
    found = found.where((F.col("fence") == 0) & (F.col("depth") > 0)).join(sums, ["doc_id", "part"])
    found = found.where((F.col("fences") + F.col("fences_before")) % 2 == 0)
    return found.select("doc_id", "line", (F.col("offset") + F.col("offset_before")).cast("int").alias("offset"), "depth")


def _pick(values: tuple[int, ...], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), F.least(index, F.lit(len(values))))


def with_risk(docs: DataFrame, rows: DataFrame, part: int = CHARS_PART) -> DataFrame:
    """Candidates with risk_index, heading_depth, section_rank and pattern_count.

    A candidate's section is that of the last heading that starts strictly before it, as in an as-of join: headings and
    candidates are merged by position, by parts of `part` characters, and the last heading is carried forward within a part,
    from the part before that has one. Ranks in a section are those in its part and the number in the parts before. `rows` are
    read several times, so they should be a table and not a computation.
    """
    docs = docs.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")  # others' headings are of no use
    h = headings(docs).select("doc_id", F.col("offset").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("seq"), F.struct(F.col("line").alias("section"), "depth").alias("h"))
    c = rows.select("doc_id", F.col("start").alias("at"), F.lit(0).alias("kind"), "seq", F.lit(None).cast("struct<section:int,depth:int>").alias("h"))
    merged = materialize(h.unionByName(c).withColumn("part", F.floor(F.col("at") / part)), "sections")
    parts, own = Window.partitionBy("doc_id").orderBy("part"), Window.partitionBy("doc_id", "part").orderBy("at", "kind")
    last = merged.groupBy("doc_id", "part").agg(F.max("h").alias("h"))  # lines grow with positions
    carried = last.select("doc_id", "part", F.last("h", ignorenulls=True).over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    found = merged.withColumn("h", F.last("h", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("kind = 0").join(carried, ["doc_id", "part"])
    found = found.withColumn("h", F.coalesce("h", "carried")).select("doc_id", "part", "seq", F.coalesce("h.section", F.lit(-1)).alias("section"), F.coalesce("h.depth", F.lit(0)).alias("heading_depth"))
    sizes = found.groupBy("doc_id", "section", "part").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id", "section").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = found.withColumn("own", F.row_number().over(Window.partitionBy("doc_id", "section", "part").orderBy("seq"))).join(sizes.select("doc_id", "section", "part", earlier.alias("earlier")), ["doc_id", "section", "part"])
    found = found.select("doc_id", "seq", "heading_depth", (F.col("own") + F.col("earlier")).cast("int").alias("section_rank"))
    out = rows.join(found, ["doc_id", "seq"]).withColumn("pattern_count", F.size("patterns"))
    order = F.when(F.col("section_rank") == 1, BY_RANK[0]).when(F.col("section_rank") <= 3, BY_RANK[1]).otherwise(BY_RANK[2])
    score = WEIGHTS["heading"] * _pick(BY_DEPTH, F.col("heading_depth") + 1) + WEIGHTS["order"] * order + WEIGHTS["density"] * _pick(BY_PATTERNS, F.col("pattern_count"))
    return out.withColumn("risk_index", F.floor((score + 5000) / 10000).cast("int"))


def priority(rows: DataFrame, k: int | None = None) -> DataFrame:
    """RED candidates by falling risk; the first `k` of them if stated."""
    out = rows.where("signal = 'RED'").orderBy(F.col("risk_index").desc(), "doc_id", "seq")
    return out if k is None else out.limit(k)
