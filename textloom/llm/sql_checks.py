"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations


def crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, bit by bit, as an expression."""
    code = f"hex(encode({text}))"
    codes = f"list_transform(range(1, length({code}) + 1, 2), lambda i: ('0x' || substr({code}, i, 2))::BIGINT)"
    step = "list_reduce(list_prepend(xor(c, x), range(8)), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, x: {step}))"


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

IMPORTANCE = f"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, {WORDS} AS w FROM documents
  UNION ALL SELECT 'b', item_id, {WORDS} FROM benchmark
), runs AS (
  SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM texts
), counted AS (SELECT side, id, f, count(*) AS n FROM runs GROUP BY ALL
), buckets AS (SELECT f, {crc32("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM counted)
), sums AS (
  SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM counted JOIN buckets USING (f) GROUP BY bucket
), totals AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM sums
), gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain
  FROM sums, totals
), weights AS (
  SELECT id, sum(n * gain) AS total, sum(n) AS n_features FROM counted JOIN buckets USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / n_features), 0)::BIGINT AS weight, len(w) >= 20 AS able,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
  FROM documents JOIN (SELECT id, w FROM texts WHERE side = 'd') x ON doc_id = x.id LEFT JOIN weights ON doc_id = weights.id
), ranked AS (
  SELECT *, weight + noise AS score, row_number() OVER (ORDER BY able DESC, weight + noise DESC, doc_id) AS place, 25 * count(*) FILTER (able) OVER () // 100 AS drawn
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END::BIGINT AS rank FROM ranked
"""

SPELLING = f"""
WITH runs AS (
  SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[a-zÀ-ÿ]+')) AS run FROM documents
), counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (SELECT run, n, {crc32("doc_id::VARCHAR || ':' || run")} AS h FROM counted
), changed AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed
), words AS (SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT word, n, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b USING (rest, i) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word
), named AS (
  SELECT best.word, n_near, top, min(other) AS other FROM best JOIN near ON near.word = best.word AND near.n = top GROUP BY ALL
), forms AS (
  SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 10 * words.n THEN other END AS form,
    CASE WHEN top >= 10 * words.n THEN top END::BIGINT AS form_n
  FROM words LEFT JOIN named ON words.word = named.word
), paths AS (
  SELECT word, word AS here FROM forms
  UNION ALL SELECT paths.word, forms.form FROM paths JOIN forms ON forms.word = paths.here WHERE forms.form IS NOT NULL
), ends AS (SELECT paths.word, here AS root FROM paths JOIN forms ON forms.word = paths.here WHERE forms.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
""".replace("WITH runs", "WITH RECURSIVE runs", 1)
