"""Problem 5: broken prompt and response pairs.

Method: prompt and response tokens are aligned, by containment of five-word shingles and by
the longest common subsequence, to flag copies and answers that stop early; answers that
don't follow the prompt are aligned, word by word, against refusal templates; what is left is held against
the prompt's language, told by letter trigrams fitted on labelled texts.

Every pair is judged by itself in one pass. An answer that gives back the prompt's words and
nothing else is a copy, whether or not the prompt held anything to correct.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE, SIMILAR = 5, 0.8
#: Texts of more letters are aligned by words instead of letters, which keeps the longest pairs affordable.
BY_WORDS = 20_000
#: Languages are told by profiles of so many letter trigrams, fitted on about so many labelled texts each; rarer languages than LEAST_TEXTS have none.
PROFILE, FIT_TEXTS, LEAST_TEXTS, MOST_LANGUAGES = 4_000, 400, 10, 30
#: Least lead of an answer's language over the prompt's, in nats a trigram.
LEAD = 0.25
#: Templates of so many words are aligned, the others stand in one piece; share of a template's words, words put in between, letters of a misspelt word.
ALIGNED_WORDS, ALIGNED_SHARE, BETWEEN, MISSPELT = 3, 0.8, 2, 5
#: What the service reads as true.
TRUE_WORDS = ("true", "1", "t", "y", "yes")
#: Answers that only fill the field.
FILLERS = frozenset(
    "nan none null nil na n/a s/r s/n nd n/d ns nc ns/nc nsnc vacío vacio vacía empty todo tbd pendiente ninguna ninguno nada undefined x xx xxx xxxx - -- --- . .. ... ? ¿? sin_respuesta".split()
) | {"sin respuesta", "sin contestar", "sin corregir", "no contesta", "no procede", "no aplica", "en blanco", "por hacer", "sin datos", "no answer", "no response", "not available", "por completar", "respuesta pendiente", "sin texto", "no hay respuesta", "no consta", "no disponible"}
#: Cores of refusals.
REFUSALS = tuple(
    t.split()
    for t in """no puedo corregir
no puedo ayudar
no puedo ayudarte
no puedo responder
no puedo hacer eso
no puedo hacerlo
no puedo procesar
no puedo revisar
no puedo atender
no puedo completar
no puedo realizar
no puedo cumplir
no me es posible
no es posible corregir
no voy a
no me corresponde
no estoy en condiciones de
no estoy autorizado
no estoy autorizada
no tengo permiso
no tengo permitido
no tengo datos suficientes
no dispongo de datos
no dispongo de información
no soy capaz de
no sé cómo ayudarte
no debo
no trabajo con
no se me permite
no quiero corregir
no quiero responder
me niego a
prefiero no
preferiría no
rechazo esta petición
tendrás que pedir a otra persona
tendrá que pedir a otra persona
como asistente no
como modelo de lenguaje
como inteligencia artificial
lo siento pero no
lamento no poder
lamentablemente no
soy incapaz de
me resulta imposible
es imposible para mí
va contra mis normas
incumple mis normas
fuera de mi alcance
fuera de lo que hago
fuera de lo que puedo
no me encargo de
no me ocupo de
no es mi función
no es tarea mía
i can't
i cannot
i am not able to
i'm not able to
i am unable to
i'm sorry but
i won't
as an ai
as a language model
je ne peux pas
je suis désolé
ich kann nicht
ich kann das nicht
es tut mir leid
não posso
sinto muito mas""".split("\n")
)
_word = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
_unseen = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")


def accepted(c: Column) -> Column:
    """The raw value as the service reads it; null is false."""
    return F.coalesce(F.lower(c), F.lit("false")).isin(*TRUE_WORDS)


def words(text: str | None) -> list[str]:
    return _word.findall(_unseen.sub("", text or "").lower())


class Languages:
    """Tells languages by letter trigrams. counts: {language: {trigram: how often}}."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.logs, self.floor = {}, {}
        for lang, grams in counts.items():
            total = sum(grams.values()) + PROFILE
            self.logs[lang] = {g: log((n + 1) / total) for g, n in grams.items()}
            self.floor[lang] = log(1 / total)

    def scores(self, tokens: list[str]) -> dict[str, float]:
        """Mean log-likelihood of a trigram by language; empty without words."""
        grams = [g for t in tokens if not t.isdigit() for g in (f" {t} "[i : i + 3] for i in range(len(t)))]
        if not grams:
            return {}
        return {lang: sum(map(lambda g, at=logs.get, f=self.floor[lang]: at(g, f), grams)) / len(grams) for lang, logs in self.logs.items()}


def fit_languages(texts: DataFrame, lang: str = "lang", key: str = "doc_id") -> dict[str, dict[str, int]]:
    """Profiles {language: {trigram: how often}} of (key, text, lang), fitted on about FIT_TEXTS texts of each language.

    The language is the label's first letters, trimmed and lower-cased. Texts are drawn by a
    hash of their key, so the same ones are drawn on any cluster. Null texts and labels are
    left out; at most MOST_LANGUAGES languages, the most frequent ones, have profiles.
    """
    rows = texts.where("text is not null").select(F.regexp_extract(F.lower(F.trim(F.col(lang))), "^[a-z]{2,3}", 0).alias("lang"), F.col(key).alias("key"), "text").where("lang <> ''")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect() if r["count"] >= LEAST_TEXTS}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, FIT_TEXTS / n))])
    drawn = rows.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < F.try_element_at(share, F.col("lang")) * 1_000_000)
    words = drawn.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{M}]+")).alias("w")).where("w <> '' and length(w) <= 50")
    grams = words.groupBy("lang", "w").agg(F.count("*").alias("n")).select("lang", "n", F.explode(F.expr("transform(sequence(1, length(w)), i -> substr(concat(' ', w, ' '), i, 3))")).alias("g"))
    counts = grams.groupBy("lang", "g").agg(F.sum("n").alias("n"))
    kept = counts.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "g"))).where(F.col("nth") <= PROFILE)
    out: dict[str, dict[str, int]] = {}
    for r in kept.select("lang", "g", "n").collect():
        out.setdefault(r["lang"], {})[r["g"]] = r["n"]
    return out


def lcs_table(a: str | list, b: str | list) -> list[int]:
    """Length of the longest common subsequence of a and b[:j], for every j from 0; bit-parallel over a."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, out = full, [0]
    for y in b:
        u = v & at.get(y, 0)
        v = (v + u | v - u) & full
        out.append(len(a) - v.bit_count())
    return out


def containment(prompt: list[str], answer: list[str]) -> float:
    """Share of the prompt's five-word shingles that the answer has; shorter prompts are one shingle."""
    k = min(SHINGLE, len(prompt))
    if not k or len(answer) < k:
        return 0.0
    have = {tuple(answer[i : i + k]) for i in range(len(answer) - k + 1)}
    own = [tuple(prompt[i : i + k]) for i in range(len(prompt) - k + 1)]
    return sum(s in have for s in own) / len(own)


def refuses(answer: list[str]) -> bool:
    """A refusal template stands among the answer's words, in one piece."""
    text = " " + " ".join(answer) + " "
    return any(" " + " ".join(t) + " " in text for t in REFUSALS)


_LONG = tuple((t, frozenset(t)) for t in REFUSALS if len(t) >= ALIGNED_WORDS)
_REFUSAL_WORDS = frozenset(w for t, _ in _LONG for w in t)


@lru_cache(100_000)
def _meant(word: str) -> str:
    """The templates' word that a misspelt one is an edit away from, else the word."""
    if len(word) < MISSPELT - 1 or word in _REFUSAL_WORDS:
        return word
    return min((w for w in _REFUSAL_WORDS if len(w) >= MISSPELT and _near(word, w)), default=word)


def refuses_nearly(answer: list[str], known=None) -> bool:
    """A refusal template is aligned with the answer: a few words stand in between, are misspelt, or one of many is missing. known: tells words that aren't misspelt."""
    meant = [w if known and known(w) else _meant(w) for w in answer]
    have = frozenset(meant)
    for t, own in _LONG:
        least = ALIGNED_SHARE * len(t)
        if len(own & have) < least - (len(t) - len(own)):
            continue
        for i, w in enumerate(meant):
            if w in own and lcs_table(t, meant[i : i + len(t) + BETWEEN])[-1] >= least:
                return True
    return False


def is_copy(prompt: list[str], answer: list[str]) -> bool:
    """Every word of the prompt comes back unchanged and in order; besides it the answer has only a lead or the prompt again."""
    if not prompt or len(answer) < len(prompt) or answer != prompt and containment(prompt, answer) < SIMILAR:
        return False
    if lcs_table(prompt, answer)[-1] < len(prompt):
        return False
    rest = len(answer) - len(prompt)
    if rest == 0:
        return True
    times, over = divmod(len(answer), len(prompt))
    if times > 1 and over == 0 and answer == prompt * times:
        return True
    # a lead or a tail of a few words around the whole prompt
    return rest <= max(6, len(prompt) // 2) and f" {' '.join(prompt)} " in f" {' '.join(answer)} "


def alignment(prompt: list[str], answer: list[str]) -> list[int]:
    """For every beginning of the prompt, in letters, how many letters of the answer are aligned with it.

    Aligned without blanks, so joined or split words don't count; texts of more than BY_WORDS
    letters are aligned by whole words.
    """
    p, a = "".join(prompt), "".join(answer)
    if len(p) <= BY_WORDS and len(a) <= BY_WORDS:
        return lcs_table(a, p)
    # letters of the words that are aligned, spread over the letters of the prompt's words
    mean, table = len(a) / len(answer), [0]
    words_ = lcs_table(answer, prompt)
    for w, before, now in zip(prompt, words_, words_[1:]):
        table += [round(mean * (before + (now - before) * k / len(w))) for k in range(1, len(w) + 1)]
    return table


def stops_early(prompt: list[str], answer: list[str], known=None, table: list[int] | None = None) -> bool:
    """The answer follows the prompt and ends before it.

    The first place in the prompt at which the alignment has all it ever gets is where the
    answer ends. table: the result of ``alignment``, if it is at hand.
    """
    p, a = "".join(prompt), "".join(answer)
    if not a or not p or answer == prompt:
        return False
    table = table or alignment(prompt, answer)
    if table[-1] < 0.7 * len(a) or table[-1] < len(a) - max(6, 0.25 * len(a)):
        return False
    end = table.index(table[-1])
    # a character more may be matched by chance far behind the real end
    for slack in (1, 2):
        e = next(j for j, x in enumerate(table) if x >= table[-1] - slack)
        if len(p) - e > 6 and end - e > 8 * slack:
            end = e
    left = len(p) - end
    if left == 0:
        return False
    at = 0
    for i, w in enumerate(prompt):
        at += len(w)
        if at >= end:
            break
    whole_left = len(prompt) - 1 - i
    if whole_left >= 2 or whole_left == 1 and left >= 3:
        return True
    last = answer[-1]
    if whole_left == 0 and left <= 3:  # inside the prompt's last word: a beginning of it that isn't a word
        return last != prompt[-1] and prompt[-1].startswith(last) and (left == 3 or not (known and known(last)))
    return left >= 3 and not last == prompt[-1]


def defect(prompt: str | None, answer: str | None, known=None, languages: Languages | None = None) -> str | None:
    """empty, truncated, refusal, copy, other_language or null; without ``languages`` no answer is in another language."""
    visible = _unseen.sub("", answer or "").strip()
    a = words(answer)
    if not a or visible.lower().strip(" .…-_*\"'«»()[]") in FILLERS or " ".join(a) in FILLERS:
        return "empty"
    p = words(prompt)
    if not p:
        return None
    if is_copy(p, a):
        return "copy"
    table = alignment(p, a)
    near = table[-1] / sum(map(len, a))
    if near < 0.75 and (refuses(a) or refuses_nearly(a, known)):
        return "refusal"
    if near < 0.8 and len(a) >= 3 and languages is not None:
        ours, theirs = languages.scores(p), languages.scores(a)
        if ours and theirs and max(theirs.values()) - theirs[max(ours, key=lambda x: (ours[x], x))] > LEAD:
            return "other_language"
    if refuses(a) and near < 0.85 and not refuses(p):
        return "refusal"
    return "truncated" if stops_early(p, a, known, table) else None


def _near(a: str, b: str) -> bool:
    """One edit apart, a swap of neighbours included."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1]


def pairs(history: DataFrame, requests: DataFrame) -> DataFrame:
    """(history_id, prompt, answer) of the pairs to look at: imports without a request, and accepted ones. Null ids are left out."""
    asked = requests.where(accepted(F.col("accepted"))).select(F.col("fb_req_id").alias("ok_id")).where("ok_id is not null").distinct()
    rows = history.where("history_id is not null").select(F.col("history_id").cast("long").alias("history_id"), "fb_req_id", F.col("erronea").alias("prompt"), F.col("corregida").alias("answer"))
    old = rows.where("fb_req_id is null").drop("fb_req_id")
    new = rows.where("fb_req_id is not null").join(asked, F.col("fb_req_id") == F.col("ok_id"), "left_semi").drop("fb_req_id")
    return old.unionByName(new).dropDuplicates(["history_id"])


def defects(rows: DataFrame, lexicon: list[str], profiles: dict[str, dict[str, int]]) -> DataFrame:
    """(history_id, defect) of the defective pairs among (history_id, prompt, answer).

    lexicon: the correct words; profiles: the result of ``fit_languages``; both are of a size that
    may go to every task. A pair has at most one defect; a null or empty prompt can only
    have an empty answer as its defect. Pairs are judged one by one, so any number of equal
    ones is no burden.
    """
    lex = frozenset(w.lower() for w in lexicon if w)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        languages = Languages(profiles)
        for b in batches:
            out = b[["history_id"]].assign(defect=[defect(p, a, lex.__contains__, languages) for p, a in zip(b["prompt"], b["answer"])])
            yield out[out["defect"].notna()]

    return rows.mapInPandas(judge, "history_id long, defect string")
