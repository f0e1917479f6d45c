"""DuckDB equivalents of the queries, written from the definitions; nothing of the code they check is used."""

from __future__ import annotations

# Severe errors and homophones, stated here again so that a wrong one shows.
_MANUAL = (
    "uillos niños|ciubab ciudad|caíbas caídas|bamo vamos|bamos vamos|oy hoy|ise hice|iso hizo|iva iba|aiga haya|haiga haya|ay hay|dondis donde|dodes donde|dondes donde|be de"
)
_HOMOPHONES = "beses beses veces|tubo tubo tuvo|asia asia hacia|baya baya vaya valla|valla valla vaya baya|bello bello vello|vello vello bello|asta asta hasta|echo echo hecho|ola ola hola|olla olla hola|a a ha|e e he"
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_AFFIX = r"(?s)^([^\p{L}\p{N}_]*)(.*?)([^\p{L}\p{N}_]*)$"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_WS}+'), lambda t: t <> '')"


def _part(x: str, i: int) -> str:
    return f"regexp_extract({x}, '{_AFFIX}', {i})"


def _bare(x: str) -> str:
    return f"translate(lower({x}), 'áéíóúü', 'aeiouu')"


def _sound(x: str) -> str:
    s = f"replace(translate({_bare(x)}, 'qwv', 'pmb'), 'h', '')"
    for a, b in ("ll", "y"), ("qu", "k"), ("z", "s"), ("ce", "se"), ("ci", "si"), ("ca", "ka"), ("co", "ko"), ("cu", "ku"), ("ge", "je"), ("gi", "ji"):
        s = f"replace({s}, '{a}', '{b}')"
    return f"list_aggregate(list_filter(string_split({s}, ''), lambda c, i: i = 1 OR c = 'r' OR c <> string_split({s}, '')[i - 1]), 'string_agg', '')"


def _case(o: str, c: str) -> str:
    title = r"^[^\p{Lu}\p{Ll}]*(?:\p{Lu}\p{Ll}*(?:[^\p{Lu}\p{Ll}]+|$))+$"
    return (
        f"CASE WHEN {o} = '' THEN {c} WHEN upper({o}) = {o} AND lower({o}) <> {o} AND length({o}) > 1 THEN upper({c}) "
        f"WHEN regexp_matches({o}, '{title}') THEN upper(substr({c}, 1, 1)) || lower(substr({c}, 2)) ELSE lower({c}) END"
    )


_LEX = "lex AS (SELECT lower(trim(term)) AS term, min(rank)::INT AS rank, arg_max(freq, rank) AS freq FROM lexicon WHERE trim(term) <> '' GROUP BY 1)"
_REQ = "req AS (SELECT DISTINCT req_id, user_id, text FROM requests)"
_TOK0 = f"tok0 AS (SELECT req_id, user_id, {_tokens('text')} AS t FROM req)"
_TOK = (
    f"tok AS (SELECT req_id, user_id, i - 1 AS pos, {_part('t[i]', 1)} AS prefix, {_part('t[i]', 2)} AS core, {_part('t[i]', 3)} AS suffix,"
    f" CASE WHEN i > 1 THEN lower({_part('t[i - 1]', 2)}) ELSE '' END AS left_, CASE WHEN i < len(t) THEN lower({_part('t[i + 1]', 2)}) ELSE '' END AS right_"
    " FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM tok0))"
)
_CORES = f"{_REQ}, {_TOK0}, cores AS (SELECT DISTINCT {_part('w', 2)} AS word FROM (SELECT unnest(t) AS w FROM tok0) WHERE {_part('w', 2)} <> '')"
_ACC = f"""acc AS (SELECT u AS unaccented, arg_max(term, (freq, -rank)) AS accented FROM (
  SELECT l.term, l.freq, l.rank, {_bare('l.term')} AS u, b.freq AS bf FROM lex l LEFT JOIN lex b ON b.term = {_bare('l.term')}
  WHERE length(l.term) > 2 AND {_bare('l.term')} <> l.term) WHERE freq > 5 * coalesce(bf, 0) GROUP BY u)"""
_PHO = f"pho AS (SELECT {_sound('term')} AS sound, arg_min(term, rank) AS heard FROM lex WHERE length(term) > 2 GROUP BY 1)"
_HIST = "hist AS (SELECT DISTINCT history_id, user_id, seq, erronea, corregida FROM user_history)"
_VOC = f"""voc AS (SELECT user_id, wrong, arg_max(right_, (seq, pos, right_)) AS learnt FROM (
  SELECT user_id, seq, i - 1 AS pos, lower({_part('e[i]', 2)}) AS wrong, lower({_part('c[i]', 2)}) AS right_ FROM (
    SELECT *, unnest(range(1, len(e) + 1)) AS i FROM (SELECT user_id, seq, {_tokens("coalesce(erronea, '')")} AS e, {_tokens("coalesce(corregida, '')")} AS c FROM hist) WHERE len(e) = len(c)))
  WHERE wrong <> '' AND wrong <> right_ GROUP BY user_id, wrong)"""
_MAN = "man AS (SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(*x.split()) for x in _MANUAL.split("|")) + ") m(wrong, manual))"
_HOM = "hom AS (SELECT * FROM (VALUES " + ", ".join(f"('{x.split()[0]}', {i}, '{c}')" for x in _HOMOPHONES.split("|") for i, c in enumerate(x.split()[1:])) + ") h(word, i, cand))"
_ES = "es AS (SELECT text FROM documents WHERE starts_with(lower(trim(lang)), 'es') AND text IS NOT NULL)"
_BIG = f"""big AS (SELECT a, b, count(*) AS n FROM (SELECT unnest(list_zip(list_prepend('', w), list_append(w, ''))) AS p, p[1] AS a, p[2] AS b
  FROM (SELECT list_transform({_tokens('text')}, lambda t: lower({_part('t', 2)})) AS w FROM es)) GROUP BY a, b)"""
_LAY = f"""cand AS (SELECT t.*, lower(core) AS low, m.manual, v.term IS NOT NULL AS valid, f.term AS folded, u.learnt, h.cand AS first_, p.heard FROM tok t
  LEFT JOIN man m ON m.wrong = lower(core) LEFT JOIN lex v ON v.term = lower(core) LEFT JOIN lex f ON f.term = translate(lower(core), 'qwb', 'pmd')
  LEFT JOIN voc u ON u.user_id = t.user_id AND u.wrong = lower(core) LEFT JOIN hom h ON h.word = lower(core) AND h.i = 0 LEFT JOIN pho p ON p.sound = {_sound('core')}),
lay AS (SELECT *, CASE WHEN core = '' THEN 'H0' WHEN manual IS NOT NULL THEN 'H1' WHEN NOT valid AND folded IS NOT NULL THEN 'H2' WHEN learnt IS NOT NULL THEN 'H3'
  WHEN first_ IS NOT NULL THEN 'H4' WHEN length(core) <= 2 THEN 'H5' WHEN valid THEN 'H6' WHEN heard IS NOT NULL AND heard <> low THEN 'H7' ELSE 'H8' END AS layer FROM cand),
said AS (SELECT *, CASE layer WHEN 'H4' THEN {_case('core', 'first_')} WHEN 'H7' THEN {_case('core', 'heard')} ELSE core END AS said FROM lay),
best AS (SELECT s.*, CASE layer WHEN 'H0' THEN '' WHEN 'H1' THEN {_case('core', 'manual')} WHEN 'H2' THEN {_case('core', 'folded')} WHEN 'H3' THEN {_case('core', 'learnt')}
  WHEN 'H5' THEN core ELSE {_case('said', 'coalesce(a.accented, lower(said))')} END AS best FROM said s LEFT JOIN acc a ON a.unaccented = lower(said))"""
# the fuzzy terms of the words that reach the last layer; DuckDB's own distance counts bytes and edits a part twice, so it only narrows
_ASCII = "translate({}, 'áéíóúüñ', '0123456')"
_NEAR = f"""pairs AS (SELECT word, term, freq FROM unknown, lex WHERE abs(length(word) - length(term)) <= 3
  AND (strlen({_ASCII.format('word')}) <> length(word) OR damerau_levenshtein({_ASCII.format('word')}, {_ASCII.format('term')}) <= 3)),
osa AS (
  SELECT word, term, freq, 0::BIGINT AS i, []::BIGINT[] AS two, range(0, length(term) + 1) AS one FROM pairs
  UNION ALL
  SELECT word, term, freq, i + 1, one, list_reduce(list_transform(range(1, length(term) + 1), lambda j: [j]), lambda acc, x: list_append(acc, least(
      one[x[1] + 1] + 1, acc[-1] + 1, one[x[1]] + (word[i + 1] <> term[x[1]])::BIGINT,
      CASE WHEN i > 0 AND x[1] > 1 AND word[i + 1] = term[x[1] - 1] AND word[i] = term[x[1]] THEN two[x[1] - 1] + 1 ELSE 999 END)), [i + 1])
  FROM osa WHERE i < length(word)),
dist AS (SELECT word, term, freq, one[-1] AS distance FROM osa WHERE i = length(word) AND one[-1] <= 3),
near AS (SELECT word, row_number() OVER (PARTITION BY word ORDER BY freq DESC, term) - 1 AS nth, distance, freq, term FROM dist d
  WHERE distance = (SELECT min(distance) FROM dist e WHERE e.word = d.word) QUALIFY nth < 3)"""
# all layers, judged by the corpus's neighbours
_JUDGED = f"""unknown AS (SELECT DISTINCT low AS word FROM lay WHERE layer = 'H8'), {_NEAR},
asked AS (SELECT l.req_id, l.pos, l.left_, l.right_, h.i, h.cand FROM lay l JOIN hom h ON h.word = l.low WHERE layer = 'H4'
  UNION ALL SELECT l.req_id, l.pos, l.left_, l.right_, n.nth, n.term FROM lay l JOIN near n ON n.word = l.low WHERE layer = 'H8'),
judged AS (SELECT req_id, pos, arg_max(cand, (score, -i)) AS chosen FROM (
  SELECT q.*, round(ln(1 + coalesce(l.n, 0)) + ln(1 + coalesce(r.n, 0)), 9) AS score FROM asked q LEFT JOIN big l ON l.a = left_ AND l.b = cand LEFT JOIN big r ON r.a = cand AND r.b = right_) GROUP BY req_id, pos),
said2 AS (SELECT l.*, j.chosen, CASE WHEN layer = 'H4' THEN {_case('core', 'j.chosen')} WHEN layer = 'H7' THEN {_case('core', 'heard')} WHEN layer = 'H8' AND j.chosen IS NOT NULL THEN j.chosen ELSE core END AS said
  FROM lay l LEFT JOIN judged j ON j.req_id = l.req_id AND j.pos = l.pos),
accented AS (SELECT s.*, {_case('said', 'coalesce(a.accented, lower(said))')} AS acc FROM said2 s LEFT JOIN acc a ON a.unaccented = lower(said)),
full_ AS (SELECT *, CASE layer WHEN 'H0' THEN '' WHEN 'H1' THEN {_case('core', 'manual')} WHEN 'H2' THEN {_case('core', 'folded')} WHEN 'H3' THEN {_case('core', 'learnt')} WHEN 'H5' THEN core
  WHEN 'H8' THEN CASE WHEN chosen IS NULL THEN acc ELSE {_case('core', 'acc')} END ELSE acc END AS best FROM accented),
corrected AS (SELECT req_id, string_agg(prefix || best || suffix, ' ' ORDER BY pos) AS corrected FROM full_ GROUP BY req_id)"""
_FBREQ = "fbreq AS (SELECT DISTINCT feedback_id AS req_id, user_id, original_text AS text, corrected_text FROM feedback WHERE accepted AND original_text IS NOT NULL AND corrected_text IS NOT NULL), req AS (SELECT req_id, user_id, text FROM fbreq)"
#: The full correction turns a text without tokens into an empty one; the shallow one leaves it out.
_BLANK = "blank AS (SELECT req_id, '' AS corrected FROM fbreq WHERE req_id NOT IN (SELECT req_id FROM corrected){})"
_SHALLOW_TEXT = "corrected AS (SELECT req_id, string_agg(prefix || best || suffix, ' ' ORDER BY pos) AS corrected FROM best GROUP BY req_id)"


def _letters(u: str, x: str) -> str:
    """A list as a string, every distinct item as one byte; the native distance then counts items."""
    return f"array_to_string(list_transform({x}, lambda c: chr(list_position({u}, c)::INT)), '')"


_MEASURES = f"""r AS (SELECT text AS s, corrected AS p, corrected_text AS t FROM fbreq JOIN (SELECT req_id, corrected FROM blank UNION ALL SELECT * FROM corrected) USING (req_id)),
parts AS (SELECT string_split(s, '') AS s, string_split(p, '') AS p, string_split(t, '') AS t, {_tokens('p')} AS pw, {_tokens('t')} AS tw, length(t) AS nt, t = '' AS no_t, p = '' AS no_p, s = '' AS no_s FROM r),
alphabets AS (SELECT *, list_distinct(list_concat(list_concat(s, p), t)) AS u, list_distinct(list_concat(pw, tw)) AS uw FROM parts),
sums AS (SELECT sum(levenshtein({_letters('uw', 'pw')}, {_letters('uw', 'tw')})) AS we, sum(len(tw)) AS wn, sum(levenshtein({_letters('u', 'p')}, {_letters('u', 't')})) AS ce, sum(nt) AS cn,
  sum(levenshtein({_letters('u', 's')}, {_letters('u', 't')})) AS before FROM alphabets)
SELECT round(we / wn, 6) AS wer, round(ce / cn, 6) AS cer, CASE WHEN before > 0 THEN round((before - ce) / before, 6) ELSE 0.0 END AS improvement_ratio FROM sums"""
_LOOKUPS = f"{_TOK0}, {_TOK}, {_LEX}, {_ACC}, {_PHO}, {_HIST}, {_VOC}, {_MAN}, {_HOM}, {_LAY}"
_CASCADE = f"WITH {_REQ}, {_TOK0}, {_TOK}, {_LEX}, {_ACC}, {_PHO}, {_HIST}, {_VOC}, {_MAN}, {_HOM}, {_LAY} "
_FB = "fb AS (SELECT DISTINCT feedback_id, user_id, original_text, corrected_text, accepted FROM feedback)"
_FOLD = "translate({}, 'áéíóúüñÁÉÍÓÚÜÑ', '0123456789:;<=')"
_CLASS = """CASE WHEN length(word) = length(correction) AND len(d) = 1 THEN CASE WHEN d[1] IN ('bd','db','pq','qp','un','nu') THEN 'Dislexia Visual (Espejamiento)'
  WHEN d[1] IN ('bv','vb','cs','sc','zs','sz') THEN 'Disgrafía Fonológica' WHEN regexp_matches(d[1], '^[aeiou]{2}$') THEN 'Sustitución de Vocales' ELSE 'Otro (Gramática/Léxico)' END
  ELSE 'Otro (Gramática/Léxico)' END"""
_DET = f"""{_FB}, zipped AS (SELECT feedback_id, {_tokens("lower(coalesce(original_text, ''))")} AS a, {_tokens("lower(coalesce(corrected_text, ''))")} AS b FROM fb),
words AS (SELECT feedback_id, i - 1 AS pos, a[i] AS word, b[i] AS correction FROM (SELECT *, unnest(range(1, least(len(a), len(b)) + 1)) AS i FROM zipped)),
diffs AS (SELECT *, [word[j] || correction[j] FOR j IN range(1, length(word) + 1) IF word[j] <> correction[j]] AS d FROM words WHERE word <> correction),
det AS (SELECT feedback_id, pos, word, correction, {_CLASS} AS type FROM diffs)"""
_TRUE = "coalesce(lower(accepted), 'false') IN ('true', '1', 't', 'y', 'yes')"
_FR = f"fr AS (SELECT DISTINCT fb_req_id, user_id, original, corrected, {_TRUE} AS accepted FROM feedback_requests)"
_KEEP = "accepted AND coalesce(original, '') <> '' AND coalesce(corrected, '') <> ''"
# RE2 has no look-behind: the mark is kept by putting a line break behind it
_SENT = f"""{_ES}, sent AS (SELECT DISTINCT regexp_replace(s, '^{_WS}+|{_WS}+$', '', 'g') AS text FROM (
  SELECT unnest(regexp_split_to_array(regexp_replace(text, '([.!?…])[ \\t\\n\\x{{0b}}\\f\\r]+', '\\1' || chr(10), 'g'), '\\n+')) AS s FROM es)),
pool AS (SELECT text FROM sent WHERE length(text) BETWEEN 15 AND 80)"""

# noise: every draw is the beginning of a digest of its key
_SIGHT, _SOUND = "b d|d b|p q|q p|n u|u n|m w|w m", "v b|b v|s c|c s|z s|j g|g j|y ll"


def _draw(*key: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '7', text, {', '.join(key)})), 1, 8))::BIGINT / 4294967296.0)"


def _swapped(rules: str, purpose: str) -> str:
    """The first letter that has a rule and wins its coin is replaced, its capital kept."""
    keys = ", ".join(f"'{r.split()[0]}'" for r in rules.split("|"))
    new = "CASE lower(word[hit_at]) " + " ".join("WHEN '{}' THEN '{}'".format(*r.split()) for r in rules.split("|")) + " END"
    at = f"list_filter(range(1, length(word) + 1), lambda j: lower(word[j]) IN ({keys}) AND {_draw('pos', repr(purpose), 'j - 1')} < 0.6)[1]"
    cased = f"CASE WHEN upper(word[hit_at]) = word[hit_at] AND lower(word[hit_at]) <> word[hit_at] THEN upper({new}) ELSE {new} END"
    return f"(SELECT CASE WHEN hit_at IS NULL THEN word ELSE substr(word, 1, hit_at - 1) || {cased} || substr(word, hit_at + 1) END FROM (SELECT {at} AS hit_at))"


_NOISE = f"""split AS (SELECT text, {_tokens('text')} AS w FROM pool),
won AS (SELECT text, w, list_filter(range(0, len(w)), lambda i: length(w[i + 1]) >= 2 AND {_draw('i', "'draw'")} < 0.30)[1:(1 + floor({_draw("'most'")} * 3))::INT] AS won FROM split),
each AS (SELECT text, pos, w[pos + 1] AS word, list_contains(won, pos) AS hit FROM (SELECT *, unnest(range(0, len(w))) AS pos FROM won)),
spoilt AS (SELECT text, pos, CASE WHEN NOT hit THEN word
    WHEN {_draw('pos', "'rule'")} < 0.40 THEN {_swapped(_SOUND, 'sound')}
    WHEN {_draw('pos', "'rule'")} < 0.70 THEN {_swapped(_SIGHT, 'sight')}
    WHEN {_draw('pos', "'rule'")} < 0.85 THEN CASE WHEN lower(word[1]) = 'h' THEN substr(word, 2) WHEN lower(word[1]) IN ('a', 'e', 'i', 'o', 'u', 'á', 'é', 'í', 'ó', 'ú')
      THEN CASE WHEN upper(word[1]) = word[1] AND lower(word[1]) <> word[1] THEN 'H' ELSE 'h' END || word ELSE word END
    WHEN length(word) <= 3 THEN word ELSE substr(word, 1, 1 + floor({_draw('pos', "'omit'")} * (length(word) - 2))::INT) || substr(word, 3 + floor({_draw('pos', "'omit'")} * (length(word) - 2))::INT) END AS word FROM each),
again AS (SELECT text, list(word ORDER BY pos) AS w, floor({_draw("'where'")} * (count(*) - 1))::INT AS place, {_draw("'join'")} < 0.15 AND count(*) > 2 AS join_ FROM spoilt GROUP BY text),
noisy AS (SELECT text, array_to_string(CASE WHEN join_ THEN list_concat(list_concat(w[1:place], [w[place + 1] || w[place + 2]]), w[place + 3:]) ELSE w END, ' ') AS noisy FROM again)"""

ORACLE = {
    "lexicon_build": f"WITH {_LEX} SELECT term, rank, freq FROM lex",
    "lexicon_counted": f"""WITH {_ES}, w AS (SELECT lower({_part('t', 2)}) AS term FROM (SELECT unnest({_tokens('text')}) AS t FROM es)),
      c AS (SELECT term, count(*) AS freq FROM w WHERE regexp_matches(term, '^[a-záéíóúüñ]+$') GROUP BY term HAVING count(*) >= 3)
      SELECT term, row_number() OVER (ORDER BY freq DESC, term) AS rank, freq FROM c""",
    "tokens_split": f'WITH {_REQ}, {_TOK0}, {_TOK} SELECT req_id, pos, prefix, core, suffix, left_ AS "left", right_ AS "right" FROM tok',
    "accent_fold": f"WITH {_CORES} SELECT word, {_bare('word')} AS folded FROM cores",
    "phonetic_key": f"WITH {_CORES} SELECT word, coalesce({_sound('word')}, '') AS sound FROM cores",
    "phonetic_index": f"WITH {_LEX}, {_PHO} SELECT sound, heard AS term FROM pho",
    "accent_index": f"WITH {_LEX}, {_ACC} SELECT * FROM acc",
    "match_case": f"WITH {_CORES} SELECT word, {_case('word', repr('niÑo'))} AS cased FROM cores",
    "restore_accent": f"WITH {_CORES}, {_LEX}, {_ACC} SELECT word, {_case('word', 'coalesce(accented, lower(word))')} AS restored FROM cores LEFT JOIN acc ON unaccented = lower(word)",
    "phonetic_lookup": f"WITH {_CORES}, {_LEX}, {_PHO} SELECT word, coalesce(heard, word) AS heard FROM (SELECT DISTINCT lower(word) AS word FROM cores) LEFT JOIN pho ON sound = coalesce({_sound('word')}, '')",
    "visual_fold": f"WITH {_CORES}, {_LEX} SELECT DISTINCT lower(word) AS word, translate(lower(word), 'qwb', 'pmd') AS folded FROM cores WHERE lower(word) NOT IN (SELECT term FROM lex) AND translate(lower(word), 'qwb', 'pmd') IN (SELECT term FROM lex)",
    "masked_context": f"""WITH {_REQ}, {_TOK0}, {_HOM}, w AS (SELECT req_id, list_transform(t, lambda x: {_part('x', 2)}) AS w FROM tok0)
      SELECT req_id, i - 1 AS pos, array_to_string(list_transform(w, lambda x, j: CASE WHEN j = i THEN '[MASK]' ELSE x END), ' ') AS context
      FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w) WHERE lower(w[i]) IN (SELECT word FROM hom)""",
    "corpus_bigrams": f"WITH {_ES}, {_BIG} SELECT a, b, n FROM big",
    "homophone_judge": f"""WITH {_REQ}, {_TOK0}, {_TOK}, {_HOM}, {_ES}, {_BIG}, s AS (
      SELECT req_id, pos, lower(core) AS lower, cand, h.i, round(ln(1 + coalesce(l.n, 0)) + ln(1 + coalesce(r.n, 0)), 9) AS score FROM tok JOIN hom h ON h.word = lower(core)
      LEFT JOIN big l ON l.a = left_ AND l.b = cand LEFT JOIN big r ON r.a = cand AND r.b = right_)
      SELECT req_id, pos, lower, arg_max(cand, (score, -i)) AS chosen FROM s GROUP BY req_id, pos, lower""",
    "correct_layers": _CASCADE + "SELECT req_id, pos, core, layer, best FROM best",
    "layer_histogram": _CASCADE + "SELECT layer, count(*) AS n FROM best GROUP BY layer",
    "correct_shallow": _CASCADE + "SELECT req_id, string_agg(prefix || best || suffix, ' ' ORDER BY pos) AS corrected FROM best GROUP BY req_id",
    "fuzzy_top3": f"""WITH RECURSIVE {_CORES}, {_LEX}, unknown AS (SELECT DISTINCT lower(word) AS word FROM cores WHERE lower(word) NOT IN (SELECT term FROM lex)), {_NEAR}
      SELECT word, nth::INT AS nth, distance::INT AS distance, freq, term FROM near""",
    "correct_text": f"""WITH RECURSIVE {_REQ}, {_LOOKUPS}, {_ES}, {_BIG}, {_JUDGED}
      SELECT req_id, coalesce(corrected, '') AS corrected, coalesce(text <> coalesce(corrected, ''), false) AS was_modified FROM req LEFT JOIN corrected USING (req_id)""",
    "evaluate": f"WITH RECURSIVE {_FBREQ}, {_LOOKUPS}, {_ES}, {_BIG}, {_JUDGED}, {_BLANK.format('')}, {_MEASURES}",
    "evaluate_shallow": f"WITH {_FBREQ}, {_LOOKUPS}, {_SHALLOW_TEXT}, {_BLANK.format(' AND false')}, {_MEASURES}",
    "error_details": f"WITH {_DET} SELECT * FROM det",
    "error_histogram": f"WITH {_DET} SELECT type, count(*) AS n FROM det GROUP BY type",
    "feedback_status": f"WITH {_FR} SELECT fb_req_id, accepted, CASE WHEN {_KEEP} THEN 'saved' ELSE 'ignored' END AS status FROM fr",
    "history_append": f"WITH {_FR} SELECT user_id, fb_req_id AS seq, lower(original) AS erronea, lower(corrected) AS corregida FROM fr WHERE {_KEEP}",
    "user_vocabulary": f'WITH {_HIST}, {_VOC} SELECT user_id, wrong, learnt AS "right" FROM voc',
    "user_pairs": f"WITH {_HIST} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY seq, erronea NULLS FIRST, corregida NULLS FIRST) AS nth, erronea, corregida FROM hist",
    "user_training_eligible": f"WITH {_HIST} SELECT user_id, count(*) AS n_pairs FROM hist GROUP BY user_id HAVING count(*) >= 5",
    "sentence_pool": f"WITH {_SENT} SELECT text FROM pool ORDER BY text LIMIT 15000",
    "sentence_pool_limited": f"WITH {_SENT} SELECT text FROM pool ORDER BY text LIMIT 500",
    "noise_pairs": f"WITH {_SENT}, {_NOISE} SELECT CASE WHEN noisy <> text THEN noisy ELSE replace(translate(text, 'vs', 'bz'), 'h', '') END AS erronea, text AS corregida FROM noisy",
    "fallback_noise": f"WITH {_SENT} SELECT text, replace(translate(text, 'vs', 'bz'), 'h', '') AS noisy FROM pool",
    # the body's key is text, input, or a null text before an input: a key that is there counts, whatever it holds
    "request_parse": f"""WITH {_REQ}, bodies AS (SELECT req_id, CASE req_id % 3 WHEN 2 THEN NULL WHEN 1 THEN coalesce(text, '') ELSE text END AS text, CASE WHEN req_id % 3 = 1 THEN coalesce(user_id, 'default_user') ELSE user_id END AS user_id FROM req)
      SELECT req_id, text, user_id, CASE WHEN coalesce(text, '') = '' THEN '{{"error":"Texto vacío"}}' END AS error FROM bodies""",
    "feedback_parse": f"WITH {_FR} SELECT fb_req_id, user_id, original, corrected, accepted FROM fr",
    "frequency_file": "SELECT row_number() OVER (ORDER BY rank)::INT AS rank, lower(trim(term)) AS term, freq FROM lexicon WHERE trim(term) <> ''",
    "parallel_side": f"WITH {_ES} SELECT text FROM es",
    "pairs_csv": f"WITH {_HIST} SELECT coalesce(erronea, '') AS erronea, coalesce(corregida, '') AS corregida FROM hist",
    "response_json": f"""WITH {_DET}, g AS (SELECT feedback_id, count(*) AS n, arg_min(word, pos) AS w, arg_min(type, pos) AS t FROM det GROUP BY feedback_id)
      SELECT f.feedback_id, original_text AS input, corrected_text AS corrected, coalesce(n, 0) AS n_details, w AS first_word, t AS first_type
      FROM fb f LEFT JOIN g ON g.feedback_id = f.feedback_id WHERE original_text IS NOT NULL AND corrected_text IS NOT NULL""",
    "feedback_stream": f"WITH {_FR} SELECT fb_req_id AS seq, lower(original) AS erronea, lower(corrected) AS corregida, user_id FROM fr WHERE {_KEEP}",
}
