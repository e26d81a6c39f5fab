"""Main text of web pages by equivalence-class template deduction (after ExAlg, Arasu and Garcia-Molina, 2003).

A page is a sequence of tokens: its tags and its words, each told apart by its path in the page. A token's occurrence
vector is how often each page of a host has it. Tokens with one vector form an equivalence class; the tokens of classes
that are large and frequent enough are ordered and nested into the host's template; a block of text is a slot if any word of
it is not the template's. A host's pages are never brought together: a vector is known by two sums over
the host's distinct pages of a hash of (page, count), which add up in any order and on any number of machines, and equal
vectors have equal sums.

Only tokens that may be frequent enough are summed: what is on a share of all pages of a host is on that share of them in
one chunk of pages at least, so a first pass counts each chunk by itself and keeps the tokens that reach the share there.
Classes are valid if they keep one order and nest: in order of their mean places, a class lies between two tokens of
another, or the other between two of its own, or the two lie apart. Of two classes that cross, the smaller is dropped.

The template decides the slots of every page, in articles and outside, and, by the text that flows through them, which
container is the main one. Of the slots, pages then keep those of their article, or else of the host's main container,
without menus, headers, footers, sidebars, notices, adverts, forms and comments.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.shared_store import materialize
from textloom.llm.worker_memory import gives_back

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|\b(hidden)\b")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an opening tag of a block ends.
SELF_ENDING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
DROPPED = frozenset("nav footer aside form button select option svg canvas object dialog menu audio video map head datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts of class names and ids that mark what is no article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments commentary disqus reply replies respond cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets toolbar pagination pager paging copyright masthead topbar skip alert".split()
)
#: Of these, those that count on an article or main element.
ARTICLE_MARKS = frozenset("ad ads advert comment comments reply replies promo related sponsored recommended".split())


def _attributes(text: str) -> dict[str, str]:
    return {(m[1] or m[3]).lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(text)}


def _names(value: str) -> set[str]:
    return {x.lower() for x in NAME.findall(value)}


class WordsOf(dict):
    """Token hashes of the words under one path."""

    def __init__(self, path: str, cache: WordKeys):
        super().__init__()
        self.path, self.cache = path, cache

    def __missing__(self, word: str) -> int:
        self[word] = key = token_hash(f"{self.path}|{word}")
        self.cache.size += 1
        return key


class WordKeys(dict):
    """WordsOf by path, kept between a worker's pages; emptied when full."""

    size = 0

    def of(self, path: str) -> WordsOf:
        if self.size > 200_000:
            self.clear()
            self.size = 0
        if path not in self:
            self[path] = WordsOf(path, self)
            self.size += 1
        return self[path]


WORD_KEYS = WordKeys()


#: Tags with longer paths and attributes are read anew each time, so that what is kept is bounded.
KEPT_CHARS = 500


@lru_cache(maxsize=20_000)
def _tag(above: str, name: str, attributes: str) -> tuple[str, int, bool, bool, bool]:
    """Of an opening tag under the path `above`: its path and token hash; whether it begins an article; whether it is dropped,
    and whether it is outside articles only."""
    a = _attributes(attributes) if attributes else {}
    label = _names(a.get("class", "") + " " + a.get("id", "")) if a else set()
    path = f"{above}/{name}" + (f".{'.'.join(sorted(label))}" if label else "")
    key, begins, drops, heads = token_hash("<" + path), False, False, False
    if name in ("article", "main") or a.get("role") in ("main", "article") or a.get("itemprop") == "articleBody":
        begins, drops = True, bool(label & ARTICLE_MARKS)
    elif name not in ("html", "body"):
        heads = name == "header" or "header" in label
        drops = name in DROPPED or a.get("role") in ROLES or bool(label & MARKS)
        drops |= "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "")
    return path, key, begins, drops, heads


@lru_cache(maxsize=20_000)
def _end_key(path: str) -> int:
    return token_hash(">" + path)


class Page:
    """Blocks of a page: (text, whether in an article, path of its container); and the tokens of its template."""

    def __init__(self, html: str | None, with_tokens: bool = False):
        self.blocks: list[tuple[str, bool, str]] = []
        self.mass: Counter[str] = Counter()
        self._stack: list[tuple[str, bool, bool, str]] = []  # name, dropped, in an article, path
        self._text: list[str] = []
        self._seen: list[str] = []  # the text and what is dropped outside articles, whose words are tokens
        self._links = 0
        self._with_tokens = with_tokens
        self._sequence: list[int] = []
        self._read(html or "")
        #: How often each token occurs, by hash, in order of first occurrences.
        self.tokens: Counter[int] = Counter(self._sequence)

    @cached_property
    def places(self) -> dict[int, int]:
        """Of a token's first occurrence."""
        return dict(zip(self.tokens, range(len(self.tokens)), strict=True))

    def _top(self) -> tuple[str, bool, bool, str]:
        return self._stack[-1] if self._stack else ("", False, False, "")

    def _flush(self) -> None:
        if not self._text and not self._seen:
            return
        words = unescape("".join(self._text)).split()
        seen = words if len(self._seen) == len(self._text) else unescape("".join(self._seen)).split()
        self._text, self._seen = [], []
        links, self._links = self._links, 0
        _, dropped, article, path = self._top()
        if self._with_tokens and seen:
            self._sequence.extend(map(WORD_KEYS.of(path).__getitem__, seen))
        if words and not dropped:
            text = " ".join(words)
            self.blocks.append((text, article, path))
            self.mass[path.rpartition("/")[0]] += max(0, len(text) - 2 * links)

    def _open(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self._flush()
            if self._stack and self._inside("p"):
                self._close_to("p")
        for other in SELF_ENDING.get(name, ()):
            if self._stack and self._top()[0] == other:
                self._close_to(other)
        _, dropped, article, path = self._top()
        path, key, begins, drops, heads = (_tag if len(path) + len(attributes) < KEPT_CHARS else _tag.__wrapped__)(path, name, attributes)
        if self._with_tokens:
            self._sequence.append(key)
        if name not in VOID:
            self._stack.append((name, dropped or drops or (heads and not article), article or begins, path))

    def _inside(self, name: str) -> bool:
        """Whether an element is open with only inline ones in it."""
        for x, *_ in reversed(self._stack):
            if x == name:
                return True
            if x in BLOCK:
                return False
        return False

    def _close_to(self, name: str) -> None:
        while self._stack and self._stack.pop()[0] != name:
            pass

    def _close(self, name: str) -> None:
        if name in BLOCK:
            self._flush()
        for x, _, _, path in reversed(self._stack):
            if x == name:
                if self._with_tokens:
                    self._sequence.append((_end_key if len(path) < KEPT_CHARS else _end_key.__wrapped__)(path))
                self._close_to(name)
                break

    def _say(self, text: str) -> None:
        if text:
            _, dropped, article, _ = self._top()
            if not (dropped and article):
                self._seen.append(text)
            if dropped:
                return
            self._text.append(text)
            if any(x[0] == "a" for x in self._stack[-3:]):
                self._links += len(text)

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = TOKEN.search(html, at)
            if not m:
                self._say(html[at:])
                break
            self._say(html[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                self._close(name)
            elif name in RAW:
                if not (m[3] or m[6] or "").rstrip().endswith("/") or name not in ("iframe",):
                    end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                    at = end.end() if end else n
            elif name == "br":
                self._text.append(" ")
                self._seen.append(" ")
            else:
                self._open(name, m[3] or m[6] or "")
                if (m[3] or m[6] or "").endswith("/") and name in ("svg", "canvas", "object"):
                    self._close_to(name)
        self._flush()


def token_hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token) - 2**63


def host_of(url: Column) -> Column:
    """The host of an url in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


#: Tokens that a chunk of pages holds, about, each page's distinct ones.
CHUNK_TOKENS = 1_000_000
PARSED = "host string, own long, seed long, keys array<long>, counts array<int>, boxes array<string>, masses array<long>"


def _lists(rows: list[list], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array([x for row in rows for x in row], kind))


def parsed(pages: DataFrame) -> DataFrame:
    """`pages` (url, html) as PARSED: hashes of the host and of the page, tokens and their counts by first occurrence, and text
    by container."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                read = [Page(h, with_tokens=True) for h in part.column("html").to_pylist()]
                lists = [
                    _lists([list(x.tokens) for x in read], pa.int64()), _lists([list(x.tokens.values()) for x in read], pa.int32()),
                    _lists([list(x.mass) for x in read], pa.string()), _lists([list(x.mass.values()) for x in read], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("host", "own", "seed")), *lists], names=["host", "own", "seed", "keys", "counts", "boxes", "masses"])

    html = F.coalesce("html", F.lit(""))
    own = pages.select(host_of(F.col("url")).alias("host"), html.alias("html"))
    return own.select("host", F.xxhash64("host").alias("own"), F.xxhash64("html").alias("seed"), "html").mapInArrow(run, PARSED)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together until they hold CHUNK_TOKENS tokens."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column("keys").flatten())
        if size > CHUNK_TOKENS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and the row of each."""
    lists = table.column(name)
    return pc.list_flatten(lists).to_numpy(), np.repeat(np.arange(table.num_rows), pc.list_value_length(lists).to_numpy())


def _frequent(support: float):
    """Parsed pages to x, the key of a host's token: tokens on the share `support` of a host's pages in one chunk."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            own = _column(chunk, "own")
            keys, row = _flat(chunk, "keys")
            _, place, pages = np.unique(own, return_inverse=True, return_counts=True)
            x, first, n = np.unique(keys ^ own[row], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x[n >= support * pages[place[row[first]]]])], names=["x"])

    return run


def _noise(seed: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash of (page, count)."""
    with np.errstate(over="ignore"):
        z = seed.astype(np.uint64) + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _sums(bits: np.ndarray, mask: int):
    """Parsed pages to (host, kind, key, pages, count, v1, v2, place), to be added up: kind 0 are tokens whose bit is set, 1
    containers (count: characters), 2 the page itself."""

    def added(chunk: pa.Table, own: np.ndarray, kind: int, keys: np.ndarray, row: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
        x = keys ^ own[row]
        order = np.argsort(x, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(x[order]) != 0]) if len(x) else np.zeros(0, dtype=np.int64)
        first = order[starts]
        total = lambda v: np.add.reduceat(v[order], starts) if len(x) else v
        return pa.RecordBatch.from_arrays([
            chunk.column("host").combine_chunks().take(pa.array(row[first])), pa.array(np.full(len(first), kind, dtype=np.int32)), pa.array(keys[first]),
            *(pa.array(total(v.astype(np.int64))) for v in (np.ones(len(x)), *values)),
        ], names=["host", "kind", "key", "pages", "count", "v1", "v2", "place"])

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            own, seed = _column(chunk, "own"), _column(chunk, "seed")
            keys, row = _flat(chunk, "keys")
            sizes = np.bincount(row, minlength=len(own))
            place = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = (keys ^ own[row]) & mask
            wanted = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            count = _flat(chunk, "counts")[0][wanted]
            v = _noise(seed[row[wanted]], count)
            yield added(chunk, own, 0, keys[wanted], row[wanted], [count, v & np.uint64(0x7FFFFFFF), v >> np.uint64(32) & np.uint64(0x7FFFFFFF), place[wanted]])
            boxes, row = _flat(chunk, "boxes")
            nothing = np.zeros(len(boxes))
            names = {b: token_hash(b) for b in set(boxes.tolist())}
            yield added(chunk, own, 1, np.array([names[b] for b in boxes], dtype=np.int64), row, [_flat(chunk, "masses")[0], nothing, nothing, nothing])
            row, nothing = np.arange(len(own)), np.zeros(len(own))
            yield added(chunk, own, 2, nothing.astype(np.int64), row, [nothing, nothing, nothing, nothing])

    return run


#: Bits for the tokens that may be frequent: 16 for each, up to this power of two (32 MB). A bit that two tokens share lets
#: more rows through, never fewer, and every token that passes is summed whole, so results don't depend on it.
MOST_BITS = 28


def _bitmap(found: DataFrame, most_bits: int) -> tuple[np.ndarray, int]:
    """The bits of `found` (x) and the mask of their places."""
    bits = min(most_bits, max(15, (16 * found.count()).bit_length()))
    mask = (1 << bits) - 1
    place = F.col("x").bitwiseAND(F.lit(mask)) + 1  # bitmap functions count from 1
    rows = found.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).toArrow()
    out = np.zeros(max(4096, 1 << bits - 3), dtype=np.uint8)
    for part, b in zip(rows.column("part").to_pylist(), rows.column("bits"), strict=True):
        out[(part - 1) * 4096 : part * 4096] = np.frombuffer(b.as_buffer(), dtype=np.uint8)
    return out, mask


def nested(classes: list[list[tuple[float, int]]]) -> list[list[tuple[float, int]]]:
    """The valid ones of a host's classes, each a list of (mean place, token): largest first, those that cross none before."""

    def crosses(a: list[float], b: list[float]) -> bool:
        if a[-1] < b[0] or b[-1] < a[0]:
            return False
        gap = lambda x, outer: bisect(outer, x)
        return gap(b[0], a) != gap(b[-1], a) and gap(a[0], b) != gap(a[-1], b)

    kept: list[tuple[list[float], list[tuple[float, int]]]] = []
    for c in sorted(classes, key=lambda c: (-len(c), sorted(c))):
        places = sorted(p for p, _ in c)
        if not any(crosses(other, places) for other, _ in kept):
            kept.append((places, c))
    return [c for _, c in kept]


def _template(pdf: pd.DataFrame) -> pd.DataFrame:
    """The template of one host from its frequent tokens: no more than two average pages have."""
    classes: dict[tuple, list[tuple[float, int]]] = {}
    for key, pages, v1, v2, place in zip(pdf["key"].tolist(), pdf["pages"].tolist(), pdf["v1"].tolist(), pdf["v2"].tolist(), pdf["place"].tolist(), strict=True):
        classes.setdefault((pages, v1, v2), []).append((place / pages, key))
    least = int(pdf["least"].iloc[0])
    valid = nested([c for c in classes.values() if len(c) >= least])
    tokens = [k for c in valid for _, k in c]
    firm = set(pdf["key"][pdf["pages"] >= pdf["firmly"]])
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "tokens": [tokens], "firm": [[k for k in tokens if k in firm]]})


def deduce_templates(pages: DataFrame, min_pages: int = 3, support: float = 0.5, min_tokens: int = 2, most_bits: int = MOST_BITS, firm_support: float = 0.9) -> DataFrame:
    """(host, tokens, firm, container) of each host with at least `min_pages` distinct pages; copies of a page are no template.

    tokens: hashes of the tokens of valid equivalence classes of `min_tokens` or more that occur on the share `support` of
    the host's pages at least; there are no more of them than two average pages have, whatever the host's size. firm: those
    on the share `firm_support` and on `min_pages` pages at least, which few pages with one title don't reach. container:
    the path that holds most of the host's text. Null pages are empty, null urls are of the empty host; an empty table has
    no template. Which tokens may be frequent is sent to all tasks as bits, 2 ** `most_bits` at most.
    """
    # What is counted first and summed after is read once. Texts aren't kept with it: they'd take 0.6 of the input again.
    once = materialize(parsed(pages), "parsed_pages")
    # Copies are found by hashes: what was read of a page isn't shuffled for it.
    copied = materialize(once.groupBy("own", "seed").agg(F.count("*").alias("n")).where("n > 1"), "page_copies")
    if not copied.isEmpty():
        single = once.join(copied.select("own", "seed"), ["own", "seed"], "left_anti")
        once = single.unionByName(once.join(copied.select("own", "seed"), ["own", "seed"], "left_semi").dropDuplicates(["own", "seed"]))
    bits, mask = _bitmap(materialize(once.select("own", "keys").mapInArrow(_frequent(support), "x long"), "frequent"), most_bits)
    sent = pages.sparkSession.sparkContext.broadcast(bits)
    sums = once.mapInArrow(lambda batches: _sums(sent.value, mask)(batches), "host string, kind int, key long, pages long, count long, v1 long, v2 long, place long")
    sums = sums.groupBy("host", "kind", "key").agg(*(F.sum(c).alias(c) for c in ("pages", "count", "v1", "v2", "place")))
    sums = materialize(sums, "occurrences")
    hosts = sums.where("kind = 2").select("host", F.col("pages").alias("total")).where(F.col("total") >= min_pages)
    tokens = sums.where("kind = 0").join(hosts, "host").where(F.col("pages") >= support * F.col("total")).withColumn("least", F.lit(min_tokens)).withColumn("firmly", F.greatest(firm_support * F.col("total"), F.lit(float(min_pages))))
    tokens = tokens.select("host", "key", "pages", "v1", "v2", "place", "least", "firmly").groupBy("host").applyInPandas(_template, "host string, tokens array<long>, firm array<long>").where(F.size("tokens") > 0)
    main = sums.where("kind = 1").groupBy("host").agg(F.max_by("key", F.struct("count", "key")).alias("container"))
    return tokens.join(main, "host", "left")


#: The last element of a heading's path.
HEADING = re.compile(r"(^|/)h[1-6]$")


def main_text(html: str | None, tokens=None, container: int | None = None, firm=None) -> str:
    """The main text of one page, given its host's template if there is one.

    Within an article only blocks of `firm` tokens, which nearly all pages of the host have, are the template's, and headings
    never are; `firm` is `tokens` if not given.
    """
    page = Page(html)
    own = frozenset() if tokens is None else frozenset(tokens)
    sure = own if firm is None else frozenset(firm)
    made = lambda block, known: bool(known) and all(token_hash(f"{block[2]}|{w}") in known for w in block[0].split(" "))
    blocks = [x for x in page.blocks if not (made(x, sure) and not HEADING.search(x[2]) if x[1] else made(x, own))]
    if any(article for _, article, _ in page.blocks):
        # An article of the template's words alone is all that such a page has to say.
        return "\n\n".join(text for text, article, _ in (blocks if any(x[1] for x in blocks) else page.blocks) if article)
    if container is None:
        paths = Counter({p: m for p, m in page.mass.items() if m > 0})
        best = max(paths, key=lambda p: (paths[p], p)) if paths else ""
        inside = lambda path: path == best or path.startswith(best + "/")
    else:
        def inside(path: str) -> bool:
            while path:
                if token_hash(path) == container:
                    return True
                path = path.rpartition("/")[0]
            return token_hash("") == container

    if not any(inside(path) for _, _, path in page.blocks):
        inside = lambda path: True
    return "\n\n".join(text for text, _, path in blocks if inside(path))


#: Templates are sent to all tasks up to this size, and joined by host beyond it.
BROADCAST_BYTES = 32 << 20
#: Parts of a host's pages in the join beyond it, so that no task gets a large host whole.
HOST_PARTS = 16


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of `pages` (page_id, url, html).

    A page is read twice, for its tokens and, once its host's template is known, for its text. A null html is an empty page, with
    an empty text. A null or odd url has the empty host. Repeated rows give equal results each, an empty table an empty result;
    other columns are not read.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    templates = materialize(deduce_templates(pages), "templates")
    size = templates.agg(F.coalesce(F.sum((F.size("tokens") + F.size("firm")) * 8 + F.length("host") + 32), F.lit(0))).first()[0]
    hosted = pages.withColumn("host", host_of(F.col("url")))
    if size <= broadcast_bytes:
        joined = hosted.join(F.broadcast(templates), "host", "left")
    else:
        parts = templates.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(HOST_PARTS - 1))))
        joined = hosted.withColumn("part", F.pmod(F.xxhash64("html"), F.lit(HOST_PARTS)).cast("int")).join(parts, ["host", "part"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, frozenset[int]] = {}  # of the hosts of a batch: their pages have the same lists

        def of(tokens) -> frozenset[int] | None:
            if tokens is None:
                return None
            key = tokens.tobytes()
            if key not in known:
                known[key] = frozenset(tokens.tolist())
            return known[key]

        for pdf in batches:
            known.clear()
            text = [main_text(h, of(t), None if c is None or c != c else int(c), of(f)) for h, t, c, f in zip(pdf["html"], pdf["tokens"], pdf["container"].astype("object"), pdf["firm"], strict=True)]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": text, "n_chars": np.array([len(t) for t in text], dtype=np.int64)})

    return joined.select("page_id", "url", "html", "tokens", "container", "firm").mapInPandas(run, "page_id long, url string, text string, n_chars long")
