"""Text features as Column expressions: all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.fixed import BIBLIOGRAPHY_HEADINGS, QUOTE_LEAST, WS

TOKEN = rf"https?://[^{WS}]+|www\.[^{WS}]+|\p{{Nd}}+|[\u4e00-\u9fff]+|[\u30a0-\u30ff]+|[\u3040-\u309f]+|[a-zA-Z_]+|[^\p{{L}}\p{{N}}_{WS}]"
KEYWORD = r"^[\u4e00-\u9fff\u30a0-\u30ffa-zA-Z_]"


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{WS}]+|[{WS}]+\z", "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text: Column) -> Column:
    """array<string>: runs of one script, numbers, URLs, single symbols; white space and other letters are left out."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def is_url(token: Column) -> Column:
    return token.rlike(r"^(https?://|www\.)")


def is_keyword(token: Column) -> Column:
    return token.rlike(KEYWORD) & ~is_url(token)


def skeleton_tag(token: Column) -> Column:
    return F.when(is_url(token), "<URL>").when(token.rlike(r"^\p{Nd}"), "<NUM>").when(token.rlike(KEYWORD), "<KW>").otherwise(token)


def skeleton(toks: Column) -> Column:
    return F.transform(toks, skeleton_tag)


def keywords(toks: Column) -> Column:
    return F.array_distinct(F.filter(toks, is_keyword))


def character_density(text: Column) -> Column:
    """H1: distinct characters by all characters, 0 for an empty text."""
    return F.when(F.length(text) > 0, F.size(F.array_distinct(F.split(text, ""))) / F.length(text)).otherwise(F.lit(0.0))


def _joined(items: Column, n: int, sep: str) -> Column:
    grams = F.transform(F.sequence(F.lit(1), F.size(items) - (n - 1)), lambda i: F.array_join(F.slice(items, i, F.lit(n)), sep))
    return F.when(F.size(items) >= n, grams).when(F.size(items) > 0, F.array(F.array_join(items, sep))).otherwise(F.array().cast("array<string>"))


def shingles(items: Column, n: int, sep: str = "_") -> Column:
    """Distinct n-grams of a list of strings; all of a shorter list is one gram, an empty list has none."""
    return F.array_distinct(_joined(items, n, sep))


def structure_features(toks: Column) -> Column:
    """H2: distinct 5- and 6-grams of the skeleton."""
    longer = lambda s, g: F.transform(F.sequence(F.lit(0), F.size(s) - 6), lambda i: F.concat(F.get(g, i), F.lit("_"), F.get(s, i + 5)))
    # A 6-gram is the 5-gram at its place and one tag; of fewer than six tags both are the same.
    both = lambda s: let(_joined(s, 5, "_"), lambda g: F.when(F.size(s) >= 6, F.array_union(g, longer(s, g))).otherwise(F.array_distinct(g)))
    return let(skeleton(toks), both)


def blocking_grams(text: Column, toks: Column, n: int = 3) -> Column:
    """Distinct n-grams of raw tokens without a separator; single tokens of a shorter text; the text if it has no token."""
    grams = F.transform(F.sequence(F.lit(0), F.size(toks) - n), lambda i: F.concat(*(F.get(toks, i + k) for k in range(n))))
    return F.array_distinct(F.when(F.size(toks) >= n, grams).when(F.size(toks) > 0, toks).otherwise(F.array(text)))


def content_features(text: Column, min_gram: int = 2) -> Column:
    """H3: keywords and their character n-grams."""

    def grams(word: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.length(word) - (min_gram - 1)), lambda i: F.substring(word, i, F.lit(min_gram)))
        return F.when(F.length(word) >= min_gram, F.concat(F.array(word), parts)).otherwise(F.array(word))

    return F.array_distinct(F.flatten(F.transform(keywords(tokens(text)), grams)))


def sentences(text: Column) -> Column:
    """Stripped, non-empty sentences, each with a closing full stop."""
    parts = F.filter(F.transform(F.split(text, "正?。|！|？|\n"), strip), lambda s: F.length(s) > 0)
    return F.transform(parts, lambda s: F.concat(s, F.lit("。")))


def windows(text: Column, sizes: tuple[int, ...] = (1, 2)) -> Column:
    """array<struct<chunk_id, window_size, text>>: windows of adjacent sentences, numbered across the sizes."""

    def window(s: Column, w: int, start: Column):
        return lambda i: F.struct((start + i - 1).alias("chunk_id"), F.lit(w).alias("window_size"), F.array_join(F.slice(s, i, F.lit(w)), "").alias("text"))

    def of(s: Column) -> Column:
        parts, start = [], F.lit(0)
        for w in sizes:
            one = F.transform(F.sequence(F.lit(1), F.size(s) - (w - 1)), window(s, w, start))
            parts.append(F.when(F.size(s) >= w, one).otherwise(F.array().cast("array<struct<chunk_id:int,window_size:int,text:string>>")))
            start = start + F.greatest(F.size(s) - (w - 1), F.lit(0))
        return F.concat(*parts)

    return let(sentences(text), of)


def sentence_count(text: Column) -> Column:
    """Pieces between full stops that aren't blank: the denominator of coverage."""
    return F.size(F.filter(F.split(text, "。"), lambda s: F.length(strip(s)) > 0))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def without_quotes(text: Column, least: int = QUOTE_LEAST) -> Column:
    """The text without 「…」 pairs of at least `least` inner characters."""
    return F.regexp_replace(text, f"「[^」]{{{least},}}」", "")


def without_bibliography(text: Column, headings: tuple[str, ...] = BIBLIOGRAPHY_HEADINGS) -> Column:
    """The text before its first line that is a heading word, its closing line breaks taken off; all of it if there is none."""
    known = F.array(*(F.lit(h.lower()) for h in headings))
    title = lambda line: F.lower(strip(F.regexp_replace(strip(line), "^#+", "")))

    def cut(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda x: F.array_contains(known, title(x))), True)
        return F.when(at > 0, F.regexp_replace(F.array_join(F.slice(lines, F.lit(1), (at - 1).cast("int")), "\n"), r"\n+\z", "")).otherwise(text)

    return let(F.split(text, "\n"), cut)


def kana_ratio(text: Column) -> tuple[Column, Column]:
    """Sums over a table: characters from U+3041 to U+30FF, and all characters."""
    return F.sum(F.length(F.regexp_replace(text, r"[^\u3041-\u30ff]", ""))), F.sum(F.length(text))


#: Elements of an array that running_sums() adds up at a time.
SUM_BLOCK = 128


def _sums_from(values: Column, start: Column) -> Column:
    """Running sums by a fold, which copies its array at each step: for short arrays."""
    fold = F.aggregate(values, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, x: F.struct(
        (acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"] + x).alias("out")))
    return fold["out"]


def running_sums(values: Column) -> Column:
    """array<int> of the sums of an int array up to each element; null of null.

    Arrays longer than SUM_BLOCK are summed by blocks, then within each from where the block starts, so that the arrays which
    a fold copies stay short and time grows in proportion.
    """
    zero = F.lit(0)

    def by_blocks(v: Column) -> Column:
        block = lambda i: F.slice(v, i * SUM_BLOCK + 1, SUM_BLOCK)
        blocks = F.sequence(zero, F.floor((F.size(v) - 1) / SUM_BLOCK).cast("int"))
        ends = _sums_from(F.transform(blocks, lambda i: F.aggregate(block(i), zero, lambda acc, x: acc + x)), zero)
        return let(ends, lambda e: F.flatten(F.transform(blocks, lambda i: _sums_from(block(i), F.when(i == 0, zero).otherwise(F.get(e, i - 1))))))

    return let(values, lambda v: F.when(F.size(v) <= SUM_BLOCK, _sums_from(v, zero)).otherwise(by_blocks(v)))
