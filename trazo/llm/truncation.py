"""Problem 8: text cut off by field limits.

Method: word trigrams are counted inside texts and at ends of sentences, the last trigram of
each text is joined to the counts, and texts are flagged whose last trigram often goes on
but almost never ends; all of it in SQL. A comma is a word of its own here, so a text that
stops behind one is told in the same way. A trigram that is rare borrows from its last two
words and from its last word (interpolated backoff), and a last word that its context only
knows as the beginning of longer words is a word cut in two: its trigram is held against the
trigrams that begin like it. Markers and dots that the cutter left at the end are taken off
first, so what stands before them is judged. Two kinds of evidence come after the trigrams,
for the texts on which they are silent: a sign that only a cutter leaves, and a length at
which many texts of a source end without a mark.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trazo.session import durable

#: A last trigram almost never ends if the estimated share of its ends is below ENDS.
ENDS = 0.003
#: Occurrences that the shorter context weighs in the estimate, and the share of ends of a word never seen.
WEIGHT, UNKNOWN = 4, 0.1
#: Occurrences that make a context's evidence its own; as many open ends make a closing line.
LEAST = 4
#: A word is cut in two if its longer forms follow the context so often, and so many times as often as the word itself.
LEAST_FORMS, FORMS_TIMES = 2, 50
#: Share of the longer forms up to which the word itself may occur anywhere; beyond it the context has to be so many times clearer.
ALSO_WORD, CLEAR_TIMES = 0.02, 1000
#: The same where only the word speaks, without its context.
LEAST_ALONE, ALSO_ALONE = 20, 0.01
#: A length is a field limit if so many texts of a source have it, and so many times as many as its neighbours on average.
LIMIT_TEXTS, LIMIT_TIMES = 5, 10
#: No word has more bytes; longer tokens are all one.
WORD_BYTES = 100
#: Characters of a last line that are looked at first; the whole line is if they hold too few words.
NEAR = 400

#: SQL literals. Characters nobody sees, a line of a list, a token: word, number, comma, or the mark that ends a sentence.
UNSEEN = ("\\u00ad", "\\u200b", "\\u200c", "\\u200d", "\\u200e", "\\u200f", "\\u2060", "\\ufeff")
LISTED = r"'^\\s*[-*\\u2022\\u2013]\\s|^[ \\t]{2,}'"
TOKEN = r"""'[\\p{L}\\p{M}]+(?:[\\u0027\\u2019-][\\p{L}\\p{M}]+)*|[0-9]+(?:[.,:][0-9]+)*|[,;:]|[.!?\\u2026]+["\\u00bb\\u201d\\u2019)\\]]*(?:\\s|$)'"""
#: What a cutter leaves: dots, or words that say that the text goes on or was cut, in brackets of either kind; anything short in square ones.
MARK = (
    r"'(?iu)(?:\\s*(?:[\\u2026\\u2192>+*]|[.]{3,}|\\[[^\\[\\]]{1,30}\\]|[\\[(]\\s*(?:[.\\u2026+>\\u2192*\\s-]+"
    r"|(?:sigue|contin\\u00faa|continua|continuar\\u00e1|cont|(?:texto )?(?:cortado|truncado|incompleto)|(?:leer |ver )?m\\u00e1s|seguir leyendo"
    r"|(?:read )?more|(?:to be )?continued|(?:text )?(?:cut|truncated)|(?:lire la )?suite|\\u00e0 suivre|(?:texte )?(?:coup\\u00e9|tronqu\\u00e9)"
    r"|mehr|weiterlesen|fortsetzung(?: folgt)?|(?:text )?(?:gek\\u00fcrzt|abgeschnitten)|(?:ler )?mais)[.\\u2026+>\\s]*)[\\])]"
    r"|(?<=\\u2026|[.]{3})\\s*\\(?(?:leer m\\u00e1s|ver m\\u00e1s|seguir leyendo|read more|more|mehr|lire la suite|ler mais)\\)?))+\\s*$|(?<=\\p{L})-$|\\ufffd+$'"
)
#: What only a cutter leaves behind a word.
SIGN = r"'(?:\\p{L}-|\\ufffd|(?:\\u2026|[.]{3}|\\[\\u2026\\])\\s*\\(?(?:leer m\\u00e1s|ver m\\u00e1s|seguir leyendo|read more|more|mehr|lire la suite|ler mais)\\)?)$'"


def _letters(x: str) -> str:
    """Most words are told from marks and numbers by one comparison."""
    return f"{x} >= 'A' AND {x} < '\\u2026'"


def _stop(x: str) -> str:
    return f"(NOT ({_letters(x)}) AND left({x}, 1) IN ('.', '!', '?', '\\u2026'))"


def _word(x: str) -> str:
    """A token as it is counted: numbers are all alike, a mark is the border of its sentence."""
    return (
        f"CASE WHEN octet_length({x}) > {WORD_BYTES} THEN '?' WHEN {_letters(x)} THEN {x} WHEN left({x}, 1) IN ('.', '!', '?', '\\u2026') THEN '^'"
        f" WHEN {x} >= '0' AND {x} < ':' THEN '#' ELSE {x} END"
    )


def _once(expression: str, name: str) -> str:
    """A column computed once a row: the optimizer copies an expression into every place that names it, but not out of a generator."""
    return f"LATERAL VIEW OUTER explode(array({expression})) {name}_ AS {name}"


#: {docs} is a relation with doc_id, source, text. Written for Spark SQL; every aggregate combines before its shuffle.
PARTS = rf"""
WITH seen_ AS (
  SELECT doc_id, source, IF({" OR ".join(f"contains(text, '{c}')" for c in UNSEEN)}, regexp_replace(text, '[{"".join(UNSEEN)}]', ''), text) AS whole
  FROM {{docs}} WHERE doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''
),
full_ AS (SELECT doc_id, source, whole, full FROM seen_ {_once("rtrim(' \\n\\r\\t', whole)", "full")}),
-- a mark the cutter left is cut off the last 60 characters
docs AS (
  SELECT doc_id, source, whole, full, IF(text RLIKE '\\p{{{{L}}}}' AND NOT text RLIKE '\\p{{{{Ll}}}}', lower(text), text) AS text
  FROM full_ {_once("IF(right(full, 60) RLIKE {mark}, concat(left(full, length(full) - length(right(full, 60))), regexp_replace(right(full, 60), {mark}, '')), full)", "text")}
)
"""
COUNTS = rf"""{PARTS},
lines AS (
  SELECT p.pos = n - 1 AS last_, p.col AS line FROM (SELECT l, size(l) AS n FROM docs {_once("split(text, '\\n')", "l")}) LATERAL VIEW OUTER posexplode(l) p
),
tokens AS (SELECT last_, line RLIKE {{listed}} AS listed, regexp_extract_all(line, {{token}}, 0) AS w FROM lines),
grams AS (
  SELECT last_, listed, g.`0` AS a, g.`1` AS b, g.`2` AS c, g.`3` AS d
  FROM tokens LATERAL VIEW OUTER inline(arrays_zip(concat(array('^', '^'), w), concat(array('^'), w), w, slice(w, 2, size(w)))) g AS `0`, `1`, `2`, `3`
),
-- how: 1 ends a sentence or a line, 2 goes on, 0 is the open end of a text; a line of a list has counts of its own
spoken AS (
  SELECT listed, IF({_stop("b")}, '^', {_word("a")}) AS a, {_word("b")} AS b, {_word("c")} AS c,
         CASE WHEN d IS NULL THEN IF(last_, 0, 1) WHEN {_stop("d")} THEN 1 ELSE 2 END AS how
  FROM grams WHERE c IS NOT NULL AND NOT {_stop("c")}
)
SELECT listed, a, b, c, count(*) AS seen, count_if(how = 1) AS ends, count_if(how = 2) AS inside FROM spoken GROUP BY listed, a, b, c
"""
#: The last trigram of every text with an open end; no shuffle.
TAILS = rf"""{PARTS},
near AS (
  SELECT doc_id, source, whole, right(text, 60) AS body, right(full, 60) AS tail, line
  FROM docs {_once("substring_index(text, '\\n', -1)", "line")}
),
some_ AS (SELECT *, length(line) > {NEAR} AS long_ FROM near {_once(f"regexp_extract_all(right(line, {NEAR}), {{token}}, 0)", "some")}),
tokens AS (SELECT * FROM some_ {_once("IF(long_ AND size(some) < 5, regexp_extract_all(line, {token}, 0), some)", "w")}),
last_ AS (
  SELECT *, coalesce(try_element_at(w, -3), '^') AS x, coalesce(try_element_at(w, -2), '^') AS y, try_element_at(w, -1) AS z FROM tokens WHERE size(w) > 0
)
SELECT doc_id, source, length(whole) AS n_chars, octet_length(replace(whole, '�', '')) AS n_bytes, body, line RLIKE {{listed}} AS listed, IF({_stop("y")}, '^', {_word("x")}) AS a, {_word("y")} AS b, {_word("z")} AS c,
       tail RLIKE {{sign}} OR body RLIKE {{sign}} AS signed
FROM last_ WHERE NOT {_stop("z")}
"""
#: {counts} and {tails} are the results of COUNTS and TAILS. Each level gives, for the contexts that open ends have, how often
#: the end itself occurs there and how often longer words that begin like it do (forms); only as long as those ends are.
VERDICTS = r"""
WITH counts AS (SELECT * FROM {counts}),
tails AS (SELECT * FROM {tails}),
bi AS (SELECT listed, b, c, sum(inside) AS inside, sum(ends) AS ends, sum(seen) AS seen FROM counts GROUP BY listed, b, c),
uni AS (SELECT listed, c, sum(inside) AS inside, sum(ends) AS ends, sum(seen) AS seen FROM bi GROUP BY listed, c),
asked3 AS (SELECT listed, a, b, collect_set(length(c)) AS lens FROM tails GROUP BY listed, a, b),
asked2 AS (SELECT listed, b, collect_set(length(c)) AS lens FROM tails GROUP BY listed, b),
level3 AS (
  SELECT listed, a, b, left(c, k) AS c, sum(IF(k = length(c), inside, 0)) AS inside, sum(IF(k = length(c), ends, 0)) AS ends, sum(IF(k = length(c), seen, 0)) AS seen, sum(IF(k < length(c), seen, 0)) AS forms
  FROM (SELECT listed, a, b, c, inside, ends, seen, explode(lens) AS k FROM counts JOIN asked3 USING (listed, a, b)) WHERE k <= length(c) GROUP BY listed, a, b, left(c, k)
),
level2 AS (
  SELECT listed, b, left(c, k) AS c, sum(IF(k = length(c), inside, 0)) AS inside, sum(IF(k = length(c), ends, 0)) AS ends, sum(IF(k = length(c), seen, 0)) AS seen, sum(IF(k < length(c), seen, 0)) AS forms
  FROM (SELECT listed, b, c, inside, ends, seen, explode(lens) AS k FROM bi JOIN asked2 USING (listed, b)) WHERE k <= length(c) GROUP BY listed, b, left(c, k)
),
level1 AS (
  SELECT listed, left(c, k) AS c, sum(IF(k = length(c), inside, 0)) AS inside, sum(IF(k = length(c), ends, 0)) AS ends, sum(IF(k = length(c), seen, 0)) AS seen, sum(IF(k < length(c), seen, 0)) AS forms
  FROM (SELECT listed, c, inside, ends, seen, explode(sequence(1, length(c))) AS k FROM uni) GROUP BY listed, left(c, k)
),
joined AS (
  SELECT o.doc_id, o.source, o.n_chars, o.n_bytes, o.body, o.signed,
         coalesce(t.inside + t.ends, 0) AS w3, coalesce(t.ends, 0) AS end3, coalesce(t.seen, 0) AS seen3, coalesce(t.forms, 0) AS f3,
         coalesce(d.inside + d.ends, 0) AS w2, coalesce(d.ends, 0) AS end2, coalesce(d.seen, 0) AS seen2, coalesce(d.forms, 0) AS f2,
         coalesce(u.inside + u.ends, 0) AS w1, coalesce(u.ends, 0) AS end1, coalesce(u.seen, 0) AS seen1, coalesce(u.forms, 0) AS f1
  FROM tails o
  LEFT JOIN level3 t ON o.listed = t.listed AND o.a = t.a AND o.b = t.b AND o.c = t.c
  LEFT JOIN level2 d ON o.listed = d.listed AND o.b = d.b AND o.c = d.c
  LEFT JOIN level1 u ON o.listed = u.listed AND o.c = u.c
),
-- the share of ends, each context filled up from the shorter one
backed1 AS (SELECT *, (end1 + {weight} * {unknown}) / (w1 + {weight}) AS p1 FROM joined),
backed2 AS (SELECT *, (end2 + {weight} * p1) / (w2 + {weight}) AS p2 FROM backed1),
backed AS (SELECT *, (end3 + {weight} * p2) / (w3 + {weight}) AS p3 FROM backed2),
lengths AS (
  -- copies of one text count once
  SELECT source, unit, size, count(DISTINCT body) AS n FROM (SELECT source, body, stack(2, 'char', n_chars, 'byte', n_bytes) AS (unit, size) FROM tails)
  GROUP BY source, unit, size
),
around AS (
  SELECT source, unit, size, n,
         sum(n) OVER (PARTITION BY source, unit ORDER BY size RANGE BETWEEN 25 PRECEDING AND 25 FOLLOWING) - n AS others
  FROM lengths
),
limits AS (SELECT source, unit, size FROM around WHERE n >= {limit_texts} AND n >= {limit_times} * (others / 50.0) AND size >= 40),
judged AS (
  SELECT j.doc_id, j.source,
    CASE
      -- what many texts close with, and hardly any goes on from
      WHEN seen3 - w3 >= {least} AND seen3 - w3 > w3 AND f3 <= seen3 - w3 THEN IF(signed, 'sign', NULL)
      -- neither letter, digit nor comma stands at the end
      WHEN NOT body RLIKE '[\\p{{L}}\\p{{M}}\\p{{Nd}},;:]$' THEN IF(signed, 'sign', NULL)
      WHEN p3 < {ends} AND w3 >= {least} THEN 'trigram'
      WHEN f3 >= {least_forms} AND f3 >= {forms_times} * w3 AND (w1 <= {also_word} * f1 OR f3 >= {clear_times} * (w3 + 1)) THEN 'trigram'
      WHEN p3 < {ends} AND w2 >= {least} THEN 'bigram'
      WHEN f3 = 0 AND f2 >= {least_forms} AND f2 >= {forms_times} * w2 AND f2 >= 10 * seen2 AND w1 <= {also_word} * f1 THEN 'bigram'
      WHEN p3 < {ends} THEN 'unigram'
      WHEN w2 = 0 AND f1 >= {least_alone} AND seen1 <= {also_alone} * f1 THEN 'unigram'
      WHEN signed THEN 'sign'
      WHEN l.size IS NOT NULL OR m.size IS NOT NULL THEN 'limit'
    END AS why
  FROM backed j
  LEFT JOIN limits l ON j.source <=> l.source AND j.n_chars = l.size AND l.unit = 'char'
  LEFT JOIN limits m ON j.source <=> m.source AND j.n_bytes = m.size AND m.unit = 'byte'
)
SELECT doc_id, source, why FROM judged WHERE why IS NOT NULL
"""


def statement(text: str, **views: str) -> str:
    """A statement over the given views."""
    named = {"listed": LISTED, "token": TOKEN, "mark": MARK, "sign": SIGN, "ends": ENDS, "weight": WEIGHT, "unknown": UNKNOWN, "least": LEAST, "least_forms": LEAST_FORMS, "forms_times": FORMS_TIMES}
    named |= {"also_word": ALSO_WORD, "clear_times": CLEAR_TIMES, "least_alone": LEAST_ALONE, "also_alone": ALSO_ALONE, "limit_texts": LIMIT_TEXTS, "limit_times": LIMIT_TIMES}
    return text.format(**named, **views)


def truncated(docs: DataFrame) -> DataFrame:
    """(doc_id, source, why) of the texts that were cut before their end.

    why names the evidence: the last trigram, its last two words, its last word, a sign the
    cutter left, or a field limit. Null and empty texts and null ids are left out; a text
    without words is never cut. doc_id is taken as unique; extra columns are ignored.
    """
    spark, mark = docs.sparkSession, uuid.uuid4().hex
    docs.select("doc_id", "source", "text").createOrReplaceTempView(f"texts_{mark}")
    views = {"docs": f"texts_{mark}"}
    for name, text in (("counts", COUNTS), ("tails", TAILS)):
        durable(spark.sql(statement(text, **views))).createOrReplaceTempView(f"{name}_{mark}")
        views[name] = f"{name}_{mark}"
    out = spark.sql(statement(VERDICTS, **views))
    for view in views.values():  # the plan is resolved; the names are no longer needed
        spark.catalog.dropTempView(view)
    return out


def shares(docs: DataFrame) -> DataFrame:
    """(source, n_docs, n_cut, cut_share); a null source is a source of its own, null texts count as documents."""
    cut = truncated(docs).groupBy("source").count().withColumnRenamed("count", "n_cut")
    every = docs.groupBy("source").count().withColumnRenamed("count", "n_docs")
    cut = cut.withColumnRenamed("source", "cut_source")
    joined = every.join(cut, F.col("source").eqNullSafe(F.col("cut_source")), "left")
    return joined.selectExpr("source", "n_docs", "coalesce(n_cut, 0) AS n_cut", "coalesce(n_cut, 0) / n_docs AS cut_share")
