import random

import pytest

from textloom.llm import page_template
from textloom.llm.page_template import Page, deduce_templates, extract, main_text, nested

ARTICLE = "<article><h1>Head &amp; all</h1><p>One<br>two  three.<p>Four <b>five</p><aside>side</aside><form>mail <input></form><div class='share-bar'>share</div></article>"


@pytest.mark.parametrize(("html", "want"), [
    (None, ""), ("", ""), ("plain &lt;text&gt;", "plain <text>"),
    (f"<html><head><title>t</title><style>p{{}}</style></head><body><nav>menu</nav><header>top</header><div class=ad>buy</div>{ARTICLE}<section id='comments'><p>me too</p></section><footer>&copy;</footer>", "Head & all\n\nOne two three.\n\nFour five"),
    ("<body><script>var a='<p>x</p>';</script><p>kept</p><!-- <p>no</p> --><p hidden>not</p>", "kept"),
    ("<main><p>a &#233; &nbsp; b</p><p></p><ul><li>c<li>d</ul></main><p>out", "a é b\n\nc\n\nd"),
    ("<article><p>in</p><article class='comment'><p>reader</p></article></article>", "in"),
    ("<p>cut < here and <b", "cut < here and"),
])
def test_main_text(html, want):
    assert main_text(html) == want


def test_template_of_a_host(spark):
    """Pages without an article: the host's own words and side blocks go, its main container stays."""
    page = lambda i: f"<body><div id='top'><p>Welcome to our site</p></div><div id='c1'><p>Story number {i} tells of {'abc'[i % 3] * 9} and more and more of it.</p><p>It ends {i * 7}.</p></div><div id='low'><p>Call us</p></div>"
    rows = [(i, "http://h.example/%d" % i, page(i), "clash") for i in range(12)] + [(50, "http://other.example/", ARTICLE, "x"), (51, None, None, "x"), (52, "nonsense", "<p>q</p>", "x"), (0, "http://h.example/0", page(0), "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = {r["host"]: r for r in deduce_templates(df).collect()}
    assert set(found) == {"h.example"} and len(found["h.example"]["tokens"]) > 4
    for limit in (1 << 20, 0):  # by broadcast, and by shuffle
        got = [(r["page_id"], r["text"], r["n_chars"]) for r in extract(df, limit).collect()]
        assert len(got) == len(rows)
        for i, text, n in got:
            want = f"Story number {i} tells of {'abc'[i % 3] * 9} and more and more of it.\n\nIt ends {i * 7}." if i < 12 else {50: "Head & all\n\nOne two three.\n\nFour five", 51: "", 52: "q"}[i]
            assert (text, n) == (want, len(want))


def test_template_inside_articles(spark):
    """What a host repeats in its articles goes, whatever its class name; copies of a page and other hosts lose nothing."""
    page = lambda i: f"<body><article><h1>Head {i}</h1><p>The story {i} has the word{i} the end{i}.</p><p class='tip'>Our staff wrote this page</p></article></body>"
    text = lambda i: f"Head {i}\n\nThe story {i} has the word{i} the end{i}."
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(8)] + [(20 + i, "http://copies.example/", page(3)) for i in range(6)]
    rows += [(30 + i, "http://mixed.example/", f"<article><p>The one</p><p>other{i} thing{i}</p></article>") for i in range(2)] + [(40 + i, "http://mixed.example/", "<article><p>The long day</p><p>Quiet sea</p></article>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == text(i) for i in range(8))
    assert all(got[20 + i] == text(3) + "\n\nOur staff wrote this page" for i in range(6))
    assert all(got[40 + i] == "The long day\n\nQuiet sea" for i in range(6))


def test_empty(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_long_and_odd_pages():
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert main_text(deep) == "x"
    assert main_text("<" * 5000) == "<" * 5000
    assert len(Page("<p>" + "a " * 100_000).blocks) == 1


def test_classes_nest_or_go():
    outer, inner, apart = [(0, 1), (10, 2), (20, 3)], [(12, 4), (15, 5)], [(30, 6), (31, 7)]
    crossing = [(5, 8), (12, 9)]
    assert nested([inner, crossing, apart, outer]) == [outer, inner, apart]


def brute_tokens(pages, support=0.5, least=2):
    """Tokens of the host's classes by whole occurrence vectors."""
    own = [Page(h, with_tokens=True) for h in sorted(set(pages))]
    vectors = {}
    for t in {t for p in own for t in p.tokens}:
        v = tuple(p.tokens.get(t, 0) for p in own)
        if sum(x > 0 for x in v) >= support * len(own):
            at = [p.places[t] for p in own if t in p.places]
            vectors.setdefault(v, []).append((sum(at) / len(at), t))
    return {k for c in nested([c for c in vectors.values() if len(c) >= least]) for _, k in c}


def test_templates_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(page_template, "CHUNK_TOKENS", 60)
    rng = random.Random(3)
    rows, by_host = [], {}
    for i in range(90):
        h = f"h{rng.choice([0, 0, 1, 2])}.example"
        words = " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(3, 20)))
        extra = "<aside><b>Read also</b> tip</aside>" if rng.random() < 0.6 else ""
        html = f"<html><body><div class=top>Menu {h}</div><article><p>{words}</p>{extra}<p>by staff of {h}</p></article></body></html>"
        for _ in range(rng.choice([1, 1, 2])):
            rows.append((i, f"https://{h}/{i}", html))
        by_host.setdefault(h, []).append(html)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for most in (28, 15, 9):
        got = {r["host"]: set(r["tokens"]) for r in deduce_templates(df, most_bits=most).collect()}
        assert got == {h: brute_tokens(v) for h, v in by_host.items()}


def test_tags_are_read_once(monkeypatch):
    """Tags like those of pages before are known; long ones aren't kept. Tokens, counts and places are those of a plain count."""
    read, own = [], page_template._attributes
    monkeypatch.setattr(page_template, "_attributes", lambda text: (read.append(text), own(text))[1])
    for i in range(50):
        page = Page(f"<div class='once-only'><p id='o1'>a b{i} a</p><p id='o1'>b{i} c</p></div>", with_tokens=True)
        key = page_template.token_hash
        at = "/div.once.only/p.o"
        want = [key("<" + at[:14]), key("<" + at), *(key(f"{at}|{w}") for w in ("a", f"b{i}", "a")), key(">" + at), key("<" + at), *(key(f"{at}|{w}") for w in (f"b{i}", "c")), key(">" + at), key(">" + at[:14])]
        assert dict(page.tokens) == {k: want.count(k) for k in want}
        assert page.places == {k: n for n, k in enumerate(dict.fromkeys(want))}
    assert len(read) == 2
    kept = page_template._tag.cache_info().currsize
    assert main_text(f"<p><img src='{'x' * 1000}'>a</p>") == main_text(f"<p><img src='{'y' * 1000}'>a</p>") == "a"
    assert page_template._tag.cache_info().currsize <= kept + 1
    # All white space of Unicode is one space.
    spaces = "".join(c for c in map(chr, range(0x110000)) if c.isspace())
    assert main_text(f"<p>{spaces}a{spaces}b{spaces}</p>") == "a b" and page_template.re.sub(r"\s+", "", spaces) == ""


def test_pages_that_share_a_title(spark):
    """Two of three pages with one headline, also in bold below it, keep both; what all pages' articles end with goes."""
    page = lambda title, body: f"<body><nav>Home News About</nav><article><h1>{title}</h1><p><b>{title}</b></p><p>{body}</p><p>Share this story now</p></article><footer>All rights</footer></body>"
    rows = [(1, "One headline here", "first words"), (2, "One headline here", "other words follow"), (3, "Another title", "third text")]
    df = spark.createDataFrame([(i, f"http://a.example/{i}", page(t, b)) for i, t, b in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract(df).collect()}
    assert got == {i: "\n\n".join([t, t, b]) for i, t, b in rows}
    same = spark.createDataFrame([(i, f"http://b.example/{i}", page("One headline here", f"body {i} own{i}")) for i in range(5)], "page_id long, url string, html string")
    assert all(r.text.startswith("One headline here\n\n") for r in extract(same).collect())  # a headline of all pages
