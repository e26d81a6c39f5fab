"""Winnowing fingerprints (Schleimer, Wilkerson and Aiken, 2003), in DataFrame functions only.

Each k-gram of characters has a rolling position and a hash; of every window of w k-grams the smallest hash is chosen, the
rightmost of equal ones, and its position is kept. Two texts that share a passage of w + k - 1 characters share a
fingerprint whose positions lie in it. A text of fewer than w k-grams is one window; one shorter than k is one k-gram.

A text is cut into chunks that overlap by w + k - 2 characters, so that every window lies in one chunk whole. Within a
chunk the windows' minima come from passes that each widen the windows by a factor of four, not from w comparisons each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters in a k-gram; k-grams in a window (a power of two).
K, W = 8, 16
#: Window starts in a chunk.
CHUNK = 4096
#: A k-gram's key is its 31-bit hash and, in the low bits, 2**32 - 1 less its position: the smallest key is the smallest hash, rightmost.
SHIFT = 32
LAST = (1 << SHIFT) - 1


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once, however often `body` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _minima(keys: Column, w: int) -> Column:
    """Minima of all windows of w; of fewer keys than w, the minimum of all."""

    def least_of(parts: int, step: int):
        def run(x: Column) -> Column:
            n = F.size(x) - step * (parts - 1)
            some = F.transform(F.slice(x, F.lit(1), F.greatest(n, F.lit(1))), lambda a, i: F.least(a, *(F.get(x, i + step * j) for j in range(1, parts))))
            return F.when(n > 0, some).otherwise(F.array(F.array_min(x)))

        return run

    out, step = keys, 1
    while step < w:
        parts = 4 if step * 4 <= w else 2
        out = let(out, least_of(parts, step))
        step *= parts
    return out


def _chunk(text: Column, at: Column, k: int, w: int) -> Column:
    """Chosen keys of the chunk of `text` that starts at character `at` (from 0)."""
    piece = F.substring(text, at + 1, F.lit(CHUNK + w + k - 2))
    grams = F.regexp_extract_all(piece, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))
    keys = F.transform(grams, lambda g, i: F.shiftleft(F.xxhash64(g).bitwiseAND(F.lit(0x7FFFFFFF)), SHIFT) + (F.lit(LAST) - i))
    return F.transform(F.array_distinct(_minima(keys, w)), lambda key: key - at)


def fingerprint(text: Column, k: int = K, w: int = W) -> Column:
    """array<struct<pos:int, hash:int>> in the order of pos; empty for an empty text.

    `text` must not be null. Positions are code points. A text shorter than k gives its own hash at position 0.
    """
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - F.lit(w + k - 1), F.lit(0)), F.lit(CHUNK))
    keys = F.array_distinct(F.flatten(F.transform(starts, lambda at: _chunk(text, at, k, w))))
    short = F.array(F.shiftleft(F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)), SHIFT) + F.lit(LAST))
    keys = F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, short).otherwise(keys)
    return F.transform(keys, lambda x: F.struct((F.lit(LAST) - x.bitwiseAND(F.lit(LAST))).cast("int").alias("pos"), F.shiftright(x, SHIFT).cast("int").alias("hash")))


def hashes(marks: Column) -> Column:
    return F.array_distinct(F.transform(marks, lambda m: m["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; one if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def as_text(marks: Column) -> Column:
    """pos:hash, hash in hexadecimal, comma-joined."""
    return F.array_join(F.transform(marks, lambda m: F.concat(m["pos"].cast("string"), F.lit(":"), F.lower(F.hex(m["hash"])))), ",")


#: Quantiles of the ids between which ranges are cut evenly.
KNOTS = 256
#: Ranges of the rows without an id.
NULL_RANGES = 4096


def _range_of(doc_id: Column, text: Column, knots: list[float], ranges: int) -> Column:
    """A number that grows with (doc_id, text): the knots below the id, and one of `ranges` even ranges between two of them.

    All steps are monotone in floating point, so no range overlaps another. Null ids come first, by their texts' first bytes.
    """
    x, at = doc_id.cast("double"), F.array(*(F.lit(float(k)) for k in knots))
    below = F.size(F.filter(at, lambda k: k <= x))
    lo, hi = F.get(at, F.greatest(below - 1, F.lit(0))), F.get(at, F.least(below, F.lit(len(knots) - 1)))
    inner = F.when(hi > lo, F.least(F.floor((x - lo) / (hi - lo) * ranges), F.lit(ranges - 1))).otherwise(0)
    prefix = F.conv(F.rpad(F.hex(F.substring(text.cast("binary"), 1, 5)), 10, "0"), 16, 10).cast("double")
    null = F.floor(prefix / float(1 << 40) * NULL_RANGES) - NULL_RANGES
    # Never null, and said so: a join on it adds no filter to one of its sides, and both use one shuffle of the texts.
    return F.coalesce(F.when(doc_id.isNull(), null).otherwise(below * F.lit(ranges) + F.greatest(inner, F.lit(0))).cast("long"), F.lit(0).cast("long"))


def with_next(docs: DataFrame, rows_in_bucket: int = 64) -> DataFrame:
    """`docs` (doc_id, text) with n_chars, marks, own (their hashes), and next_text and next_own of the row after it by (doc_id, text).

    The row after the last is the first. Ids are cut into ranges of about `rows_in_bucket` rows each, evenly between
    quantiles, so an outlying id doesn't stretch the others' ranges; rows are shuffled once, to their range, and no window
    spans the table; the first rows of the ranges, one in `rows_in_bucket`, are shuffled once more, to the range before. Ids
    that are very uneven between two quantiles make ranges uneven, not results wrong. A null id comes before all others;
    rows without one are dealt by their texts' first bytes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    span = docs.agg(F.percentile_approx("doc_id", [k / KNOTS for k in range(KNOTS + 1)]).alias("knots"), F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n = max(span["n"], 1)
    knots = sorted({float(k) for k in span["knots"] or ()}) or [0.0]
    parts = max(8, min(-(-n // (4 * rows_in_bucket)), -(-(span["bytes"] or 0) // (8 << 20))))  # many ranges to a part, so parts are even
    bucket = _range_of(F.col("doc_id"), F.col("text"), knots, max(1, n // (rows_in_bucket * len(knots))))
    docs = docs.withColumn("bucket", bucket).repartition(parts, "bucket")
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    rows = docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("marks", fingerprint(F.col("text")))
    rows = rows.withColumn("own", hashes(F.col("marks")))
    rows = rows.select("*", F.lead("text").over(order).alias("lead_text"), F.lead("own").over(order).alias("lead_own"))

    # The bucket whose last row each bucket's first row follows: found from the list of buckets, in two steps.
    full = docs.select("bucket").groupBy("bucket").agg(F.count("*").alias("size")).withColumn("over", F.floor(F.col("bucket") / 4096))
    near = Window.partitionBy("over").orderBy("bucket")
    full = full.select("bucket", "over", F.lag("bucket").over(near).alias("before"))
    tops = full.groupBy("over").agg(F.max("bucket").alias("top"))
    every = Window.orderBy("over")
    tops = tops.select("over", F.lag("top").over(every).alias("under"), F.last("top").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"))
    before = full.join(tops, "over").select("bucket", F.coalesce("before", "under", "last").alias("to"))
    heads = docs.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("bucket", "text").join(before, "bucket")
    heads = heads.select(F.col("to").alias("bucket"), F.col("text").alias("head_text"), hashes(fingerprint(F.col("text"))).alias("head_own"))
    out = rows.join(heads, (rows["bucket"] == heads["bucket"]) & rows["lead_text"].isNull(), "left")
    return out.select("doc_id", "text", "n_chars", "marks", "own", F.coalesce("lead_text", "head_text").alias("next_text"), F.coalesce("lead_own", "head_own").alias("next_own"))


def edited(text: Column, n: Column, other: Column) -> Column:
    """`text` with its last floor(n / 4) characters replaced by the first as many of `other`."""
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n.cast("int") - cut), F.substring(other, F.lit(1), cut))


def edited_fingerprint(marks: Column, changed: Column, kept: Column, k: int = K, w: int = W) -> Column:
    """fingerprint(changed), from the marks of a text with the same first `kept` characters.

    A k-gram is chosen or not by the windows that hold it. Of those that begin at or before the last window within the
    kept part nothing has changed; the rest is chosen anew from the characters that their windows reach.
    """
    last = kept.cast("int") - (w + k - 1)
    start = F.greatest(last - (w - 2), F.lit(0))
    tail = F.transform(fingerprint(F.substring(changed, start + 1, F.length(changed)), k, w), lambda m: F.struct((m["pos"] + start).alias("pos"), m["hash"].alias("hash")))
    return F.when(last < 0, fingerprint(changed, k, w)).otherwise(F.concat(F.filter(marks, lambda m: m["pos"] <= last), F.filter(tail, lambda m: m["pos"] > last)))


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of `docs`.

    `docs`: (doc_id, text); a null text is empty and has an empty fingerprint, which is like another empty one (1) and
    unlike any other (0). Equal texts have equal fingerprints. Repeated rows follow each other; the next document of a
    single row is itself. An empty table gives an empty result; other columns are not read.
    """
    rows = with_next(docs)
    kept = F.col("n_chars") - F.floor(F.col("n_chars") / 4)
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("n_chars"), F.col("next_text"))).withColumn("edited_marks", edited_fingerprint(F.col("marks"), F.col("edited"), kept))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("marks")).alias("fingerprint"),
        as_text(F.col("edited_marks")).alias("edited_fingerprint"), likeness(F.col("own"), hashes(F.col("edited_marks"))).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
