"""DuckDB equivalents of the queries that SQL can express over whole tables."""

_WORDS = "trim(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'))"
_P1 = """
WITH f AS (SELECT DISTINCT feedback_id AS id, {a} AS x, {b} AS y FROM feedback WHERE feedback_id IS NOT NULL),
h AS (SELECT DISTINCT history_id AS id, {c} AS x, {d} AS y FROM user_history WHERE history_id IS NOT NULL),
r AS (SELECT 'feedback' AS tbl, id, least(x, y) AS lo, greatest(x, y) AS hi FROM f
      UNION ALL SELECT 'user_history', id, least(x, y), greatest(x, y) FROM h),
g AS (SELECT tbl, id, min(id) OVER w AS rep, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY tbl, lo, hi))
""".format(a=_WORDS.format(c="original_text"), b=_WORDS.format(c="corrected_text"), c=_WORDS.format(c="erronea"), d=_WORDS.format(c="corregida"))
_P4 = r"""
WITH v AS (
  SELECT 'word' AS field, regexp_replace(lower(word), '^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$', '', 'g') AS value, req_id, pos FROM word_errors
  UNION ALL SELECT 'correction', regexp_replace(lower(correction), '^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$', '', 'g'), req_id, pos FROM word_errors
  UNION ALL SELECT 'type', trim(lower(type)), req_id, pos FROM word_errors),
c AS (SELECT field, value, count(DISTINCT (req_id, pos))::BIGINT AS occurrences, count(DISTINCT req_id)::BIGINT AS records
      FROM v WHERE value <> '' AND req_id IS NOT NULL GROUP BY field, value),
m AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.01 * (SELECT count(DISTINCT req_id) FROM word_errors) THEN 'common' END AS mark FROM c)
"""
# problem 8: patterns without look-behind, values stated again
_SAYS = (
    "sigue|continúa|continua|continuará|cont|(?:texto )?(?:cortado|truncado|incompleto)|(?:leer |ver )?más|seguir leyendo|(?:read )?more|(?:to be )?continued|(?:text )?(?:cut|truncated)"
    "|(?:lire la )?suite|à suivre|(?:texte )?(?:coupé|tronqué)|mehr|weiterlesen|fortsetzung(?: folgt)?|(?:text )?(?:gekürzt|abgeschnitten)|(?:ler )?mais"
)
_READ_ON = r"\(?(?:leer más|ver más|seguir leyendo|read more|more|mehr|lire la suite|ler mais)\)?"
_MARK = rf"(?i)(?:\s*(?:(?:…|[.]{{3}})\s*{_READ_ON}|[…→>+*]|[.]{{3,}}|\[[^\[\]]{{1,30}}\]|[\[(]\s*(?:[.…+>→*\s-]+|(?:{_SAYS})[.…+>\s]*)[\])]))+\s*$"
_SIGN = rf"(?:\p{{L}}-|�|(?:…|[.]{{3}}|\[…\])\s*{_READ_ON})$"
_LISTED = r"^\s*[-*•–]\s|^[ \t]{2,}"
_TOKEN = r"""[\p{L}\p{M}]+(?:[''’-][\p{L}\p{M}]+)*|[0-9]+(?:[.,:][0-9]+)*|[,;:]|[.!?…]+["»”’)\]]*(?:\s|$)"""
_STOP = "(left({x}, 1) IN ('.', '!', '?', '…'))"


def _counted(x: str) -> str:
    return f"CASE WHEN strlen({x}) > 100 THEN '?' WHEN {_STOP.format(x=x)} THEN '^' WHEN {x} >= '0' AND {x} < ':' THEN '#' ELSE {x} END"


def _level(n: int) -> str:
    keys = ("listed", "a", "b")[: n] if n == 3 else ("listed", "b") if n == 2 else ("listed",)
    k, source = ", ".join(keys), ("uni", "bi", "counts")[n - 1]
    return f"""level{n} AS (SELECT {k}, left(c, k) AS c, sum(CASE WHEN k = length(c) THEN inside + ends ELSE 0 END) AS w, sum(CASE WHEN k = length(c) THEN ends ELSE 0 END) AS ends,
  sum(CASE WHEN k = length(c) THEN seen ELSE 0 END) AS seen, sum(CASE WHEN k < length(c) THEN seen ELSE 0 END) AS forms
  FROM (SELECT *, unnest(range(1, length(c) + 1)) AS k FROM {source}) GROUP BY {k}, left(c, k))"""


_P8 = rf"""
WITH whole AS (SELECT doc_id, source, regexp_replace(text, '[\x{{00ad}}\x{{200b}}-\x{{200f}}\x{{2060}}\x{{feff}}]', '', 'g') AS whole FROM documents WHERE doc_id IS NOT NULL AND text <> ''),
full_ AS (SELECT *, rtrim(whole, ' ' || chr(10) || chr(13) || chr(9)) AS full_ FROM whole),
cut AS (SELECT *, left(full_, length(full_) - length(right(full_, 60))) || CASE WHEN regexp_matches(right(full_, 60), '{_MARK}') THEN regexp_replace(right(full_, 60), '{_MARK}', '')
  ELSE regexp_replace(regexp_replace(right(full_, 60), '(\p{{L}})-$', '\1'), '�+$', '') END AS text FROM full_),
docs AS (SELECT doc_id, source, whole, full_, CASE WHEN regexp_matches(text, '\p{{L}}') AND NOT regexp_matches(text, '\p{{Ll}}') THEN lower(text) ELSE text END AS text FROM cut),
lines AS (SELECT doc_id, i = len(l) AS last_, l[i] AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM docs))),
tokens AS (SELECT doc_id, last_, regexp_matches(line, '{_LISTED}') AS listed, regexp_extract_all(line, '{_TOKEN}') AS w FROM lines),
grams AS (SELECT doc_id, last_, listed, i = len(w) AS at_end, CASE WHEN i > 2 THEN w[i - 2] ELSE '^' END AS a, CASE WHEN i > 1 THEN w[i - 1] ELSE '^' END AS b, w[i] AS c, w[i + 1] AS d FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM tokens) ),
spoken AS (SELECT doc_id, last_, listed, at_end, CASE WHEN {_STOP.format(x='b')} THEN '^' ELSE {_counted('a')} END AS a, {_counted('b')} AS b, {_counted('c')} AS c,
  CASE WHEN d IS NULL THEN CASE WHEN last_ THEN 0 ELSE 1 END WHEN {_STOP.format(x='d')} THEN 1 ELSE 2 END AS how FROM grams WHERE NOT {_STOP.format(x='c')}),
counts AS (SELECT listed, a, b, c, count(*) AS seen, count(*) FILTER (how = 1) AS ends, count(*) FILTER (how = 2) AS inside FROM spoken GROUP BY listed, a, b, c),
bi AS (SELECT listed, b, c, sum(seen) AS seen, sum(ends) AS ends, sum(inside) AS inside FROM counts GROUP BY listed, b, c),
uni AS (SELECT listed, c, sum(seen) AS seen, sum(ends) AS ends, sum(inside) AS inside FROM bi GROUP BY listed, c),
{_level(3)}, {_level(2)}, {_level(1)},
tails AS (SELECT s.doc_id, source, length(whole) AS n_chars, strlen(replace(whole, '�', '')) AS n_bytes, right(text, 60) AS body, listed, a, b, c,
  regexp_matches(right(full_, 60), '{_SIGN}') OR regexp_matches(right(text, 60), '{_SIGN}') AS signed FROM spoken s JOIN docs d ON d.doc_id = s.doc_id WHERE last_ AND at_end),
joined AS (SELECT o.*, coalesce(t.w, 0) AS w3, coalesce(t.ends, 0) AS end3, coalesce(t.seen, 0) AS seen3, coalesce(t.forms, 0) AS f3, coalesce(d.w, 0) AS w2, coalesce(d.ends, 0) AS end2, coalesce(d.seen, 0) AS seen2, coalesce(d.forms, 0) AS f2,
  coalesce(u.w, 0) AS w1, coalesce(u.ends, 0) AS end1, coalesce(u.seen, 0) AS seen1, coalesce(u.forms, 0) AS f1
  FROM tails o LEFT JOIN level3 t ON t.listed = o.listed AND t.a = o.a AND t.b = o.b AND t.c = o.c LEFT JOIN level2 d ON d.listed = o.listed AND d.b = o.b AND d.c = o.c LEFT JOIN level1 u ON u.listed = o.listed AND u.c = o.c),
backed AS (SELECT *, (end3 + 4 * p2) / (w3 + 4) AS p3 FROM (SELECT *, (end2 + 4 * p1) / (w2 + 4) AS p2 FROM (SELECT *, (end1 + 4 * 0.1::DOUBLE) / (w1 + 4) AS p1 FROM joined))),
lengths AS (SELECT source, unit, size, count(DISTINCT body) AS n FROM (SELECT source, body, 'char' AS unit, n_chars AS size FROM tails UNION ALL SELECT source, body, 'byte', n_bytes FROM tails) GROUP BY source, unit, size),
limits AS (SELECT source, unit, size FROM (SELECT *, sum(n) OVER (PARTITION BY source, unit ORDER BY size RANGE BETWEEN 25 PRECEDING AND 25 FOLLOWING) - n AS others FROM lengths) WHERE n >= 5 AND n >= 10 * (others / 50.0) AND size >= 40),
found AS (SELECT doc_id, source FROM backed j WHERE CASE
    WHEN seen3 - w3 >= 4 AND seen3 - w3 > w3 AND f3 <= seen3 - w3 OR NOT regexp_matches(body, '[\p{{L}}\p{{M}}\p{{Nd}},;:]$') THEN signed
    ELSE p3 < 0.003 OR f3 >= 2 AND f3 >= 50 * w3 AND (w1 <= 0.02 * f1 OR f3 >= 1000 * (w3 + 1)) OR f3 = 0 AND f2 >= 2 AND f2 >= 50 * w2 AND f2 >= 10 * seen2 AND w1 <= 0.02 * f1
      OR w2 = 0 AND f1 >= 20 AND seen1 <= 0.01 * f1 OR signed
      OR EXISTS (SELECT 1 FROM limits l WHERE l.source IS NOT DISTINCT FROM j.source AND (l.unit = 'char' AND l.size = j.n_chars OR l.unit = 'byte' AND l.size = j.n_bytes)) END)
"""
ORACLE = {
    "p1_found": _P1 + "SELECT tbl, rep AS id_a, id AS id_b FROM g WHERE id <> rep",
    "p1_collapsed": _P1 + "SELECT tbl, id, n AS n_copies FROM g WHERE id = rep",
    "p4_found": _P4 + "SELECT field, value, mark FROM m WHERE mark IS NOT NULL",
    "p4_frequencies": _P4 + "SELECT field, value, occurrences, records, mark FROM m",
    "p8_found": _P8 + "SELECT doc_id FROM found",
    "p8_shares": _P8 + """SELECT d.source, count(*) AS n_docs, count(f.doc_id) AS n_cut, count(f.doc_id) / count(*) AS cut_share
      FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id GROUP BY d.source""",
}
