import hashlib
import math
import random
import re

from textloom.llm.privacy import EDGE, base_spans, digest, distinct_texts, find_private, generalised, luhn, sanitise, sanitise_texts, spans_digest

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS):
        for m in re.finditer(p.replace(r"\x20-]", r"\x20\-]"), text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_spans_against_the_patterns():
    rng = random.Random(6)
    parts = ["a", "b.c", "@", "@x.y", ".", "-", "_", "+1", "+49 (0)", "192.168", ".1.1", "4111 1111 1111 1111", "4111-1111-1111-111", "37828224631000", " ", " ", "555-0100-22", "é", "%", "0012"]
    for _ in range(6000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert base_spans(t) == plain(t), t


def test_long_texts_are_linear():
    assert base_spans("a" * 300_000 + "@") == [] and base_spans("1." * 100_000) and base_spans("+" * 100_000) == []


def test_long_digit_runs():
    assert base_spans("1.2.3." + "0" * 5000) == [(0, 1, 5006)] and base_spans("1.2.3." + "9" * 5000) == []
    assert base_spans("1" * 5000) == [] and base_spans("+" + "1" * 5000) == []


def brute_terms(rows, threshold=0.75, least=2):
    """The term spans of each row, from the definition."""
    def parts(text):
        spans = plain(text)
        words = [(m[0].strip(EDGE).lower(), m.start() + len(m[0]) - len(m[0].lstrip(EDGE)), m.start() + len(m[0].rstrip(EDGE)), m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        words = [w for w in words if w[0] and not any(w[3] < e and s < w[4] for s, _, e in spans)]
        return {(k, text[s:e].lower()) for s, k, e in spans}, words

    texts = {t or "": parts(t or "") for _, t in rows}
    n, told, alone = max(2, len(texts)), {}, set()
    entities, terms = {e for es, _ in texts.values() for e in es}, {w[0] for _, ws in texts.values() for w in ws}
    own = {t: {w[0] for w in ws} for t, (_, ws) in texts.items()}
    for e in entities:
        have = [t for t, (es, _) in texts.items() if e in es]
        for x in terms if len(have) >= least else ():
            both, df = sum(x in own[t] for t in have), sum(x in o for o in own.values())
            ic = math.log(n / len(have))
            if both >= least and ic > 0 and math.log(n * both / (len(have) * df)) >= threshold * ic:
                told.setdefault(e, set()).add(x)
                if both * 2 > df:
                    alone.add(x)
    out = {}
    for i, t in rows:
        es, ws = texts[t or ""]
        want = set().union(alone, *(told.get(e, set()) for e in es))
        out[i] = sorted((a, b) for x, a, b, *_ in ws if x in want)
    return out


def test_terms_by_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(90):
        w = [f"w{min(rng.randrange(60), rng.randrange(60))}" + rng.choice(["", ".", ","]) for _ in range(rng.randrange(2, 25))]
        if i % 3 == 0:
            who = rng.randrange(6)
            w[rng.randrange(len(w))] = (f"p{who}@x.example", f"10.0.0.{who}", f"+49 30 555 000{who}")[who % 3]
            w.insert(rng.randrange(len(w)), rng.choice([f"(Name{who})", f"name{who}"]))
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[3 * i][1]) for i in range(6)] + [(300, None), (301, ""), (302, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_terms(rows)
    assert sum(map(len, want.values())) > 10
    for limit in (1 << 20, 0):
        for r in spans_digest(find_private(df, broadcast_rows=limit)).collect():
            assert [(int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x) if k == "term"] == want[r["doc_id"]]


def test_distinct_texts(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (None, "b"), (None, "b"), (3, "b"), (4, ""), (5, "c"), (5, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (100, 0):
        texts, n = distinct_texts(df, most)
        assert n == 5 and sorted(r["text"] for r in texts.collect()) == ["", "a", "b", "c", "d"]


def test_terms_that_reveal(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, fill(30)) for i in range(200)]
    rows += [(1000 + i, f"{fill(10)} director Zanzibar {rng.choice(words)} writes from boss@corp.example about {fill(10)}") for i in range(8)]
    rows += [(2000 + i, f"{fill(10)} about me{i}@x.example {fill(10)}") for i in range(8)]
    rows += [(3000, None), (3001, ""), (1000, rows[200][1])]
    df = spark.createDataFrame([(*r, 9, "c", 2) for r in rows], "doc_id long, text string, n_chars long, base string, term int")
    out = {r["doc_id"]: r for r in spans_digest(find_private(df)).collect()}
    texts = dict(rows)
    for i, r in out.items():
        t = texts[i] or ""
        base = digest(plain(t))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        terms = {t[int(a) : int(b)] for k, a, b in (s.split(":") for s in r["spans"].split(",") if s) if k == "term"}
        if 1000 <= i < 2000:
            assert "Zanzibar" in terms and "director" in terms
        else:
            assert not terms
    clean = sanitise_texts(df)
    assert clean.columns == df.columns and clean.count() == len(rows)
    for r in clean.collect():
        if r["text"]:
            assert "@" not in r["text"] and "Zanzibar" not in r["text"]
        assert (r["text"] is None) == (texts[r["doc_id"]] is None)


def _marked(found, texts):
    out = {}
    for r in spans_digest(found).collect():
        t = texts[r["doc_id"]] or ""
        out[r["doc_id"]] = [t[int(a) : int(b)] for k, a, b in (x.split(":") for x in r["spans"].split(",") if x) if k == "term"]
    return out


def test_terms_far_from_the_entity_and_without_it(spark):
    rng = random.Random(3)
    fill = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    rows = [(i, fill(40)) for i in range(200)]
    rows += [(1000 + i, f"Zanzibar {fill(30)} boss@corp.example {fill(30)} (Zanzibar), {fill(3)}") for i in range(8)]
    rows += [(2000, f"{fill(20)} zanzibar. {fill(20)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (1 << 20, 0):  # by broadcast, and by shuffle
        got = _marked(find_private(df, broadcast_rows=limit), dict(rows))
        assert all(got[1000 + i].count("Zanzibar") == 2 for i in range(8)) and got[2000] == ["zanzibar"]
        assert not any(got[i] for i in range(200))
    assert all("anzibar" not in r["text"] for r in sanitise_texts(df).collect())


def test_copies_do_not_hide_terms(spark):
    rng = random.Random(5)
    fill = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    texts = [f"{fill(12)} Zanzibar boss@corp.example {fill(12)}" for _ in range(2)]
    rows = [(i, fill(30)) for i in range(300)] + [(1000 + i, texts[i % 2]) for i in range(60)] + [(2000 + i, "Timbuktu me@x.example once") for i in range(20)]
    got = _marked(find_private(spark.createDataFrame(rows, "doc_id long, text string")), dict(rows))
    assert all("Zanzibar" in got[1000 + i] for i in range(60))
    assert not any(got[2000 + i] for i in range(20))  # one distinct text is no evidence


def test_empty(spark):
    assert spans_digest(find_private(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_sanitise():
    assert [generalised(x) for x in ("Ann", "ann", "1200", "a-17")] == ["<NAME>", "", "<NUMBER>", "<ID>"]
    assert sanitise("ab x@y.z cd e", [(3, 0, 8), (9, 4, 11)]) == "ab <EMAIL>  e"
    assert sanitise("0123456789", [(1, 2, 5), (3, 3, 7)]) == "0<CARD>789"
