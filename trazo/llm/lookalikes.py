"""Problem 3: text that looks the same but holds other characters.

Method: script-aware repair. A token is read in each script that has a letter, or a twin
that looks like it, for every one of its letters. Where several scripts can read it, the Latin
reading is taken if the corpus vocabulary holds it, else a mixed token goes to its dominant
script and a token of one script stays. A mixed token that one script alone can read takes that
reading without the vocabulary: names and misspelt words are in no vocabulary, and no word
mixes scripts on purpose. Around it stand the repairs that need no vocabulary: invisible
characters, blanks other than the plain ones, full-width forms, ligatures and decomposed accents.

``fold`` works on one string and also returns where each kept character came from, so
other operators can search the repaired text and cut the original one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trazo.session import durable

#: Letters of Greek and Cyrillic drawn like a Latin one.
LATIN_TWINS = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ё": "ë", "ї": "ï",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ё": "Ë", "Ї": "Ï",
    # Greek
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian and others
    "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S", "ɡ": "g", "ı": "i",
}
#: A token of one foreign letter is a word only with these; α or Ω alone is meant.
ONE_LETTER = set("аеоуАЕОУοΟΑΕ")
#: Characters nobody sees. U+200D and U+FE0F have a use inside emoji.
UNSEEN = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\ufe00\ufe01\ufe02\ufe0e\ufe0f\ufeff\ufffc"
#: Blanks that stand in for a plain one, and line breaks other than the plain ones.
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\u2800\u3164\uffa0"
BREAKS = "\u0085\u2028\u2029"
_FORMS = "\uff01-\uff5e\ufb00-\ufb06\U0001d400-\U0001d7ff"
_MARKS = "\u0300-\u0333\u0338"
_FOREIGN = "\u0370-\u03ff\u0400-\u052f\u0530-\u058f\u0261\u0131"
#: For either engine's regular expressions: a text without these needs no repair.
SUSPECT = f"[{UNSEEN}{BLANKS}{BREAKS}{_FORMS}{_MARKS}{_FOREIGN}]"
_suspect = re.compile(SUSPECT)
_token = re.compile(rf"[^\W\d_{_FOREIGN}]*[{_FOREIGN}](?:[^\W\d_]|[{_MARKS}]|[{UNSEEN}])*")
#: What makes a capital behind or before it part of a number.
_numbered, _numbering = re.compile(r"\d[ -]{0,2}$"), re.compile(r"[ -]{0,2}\d{4}")
_emoji = re.compile("[\u00a9\u00ae\u203c-\u3299\U0001f000-\U0001faff\U000e0020-\U000e007f]")


def _script(ch: str) -> str:
    o = ord(ch)
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0x530 <= o < 0x590:
        return "armenian"
    return "latin"


def plain(text: str) -> bool:
    """True if no character of the text can need repair."""
    return text.isascii() or _suspect.search(text) is None


def _bare(token: str) -> str:
    """Latin twin of each letter; letters with marks keep them, other letters stay."""
    out = []
    for ch in token:
        base, *marks = unicodedata.normalize("NFD", ch)
        out.append(unicodedata.normalize("NFC", LATIN_TWINS[base] + "".join(marks)) if base in LATIN_TWINS else ch)
    return "".join(out)


#: Letters of another script that look like a Latin one, by script; the first of each in the table above.
TWINS_OF_LATIN: dict[str, dict[str, str]] = {}
for _foreign, _latin in LATIN_TWINS.items():
    TWINS_OF_LATIN.setdefault(_script(_foreign), {}).setdefault(_latin, _foreign)


def _in_script(token: str, script: str) -> str | None:
    """The token with its Latin letters replaced by their twins in a script, or None if a letter has none."""
    twins, out = TWINS_OF_LATIN.get(script, {}), []
    for ch in token:
        base, *marks = unicodedata.normalize("NFD", ch)
        if not ch.isalpha() or _script(base) == script:
            out.append(ch)
            continue
        both = unicodedata.normalize("NFC", twins[base] + "".join(marks)) if base in twins else ""
        if len(both) != 1:
            return None
        out.append(both)
    return "".join(out)


def readings(token: str) -> tuple[dict[str, str], str | None]:
    """The token in every script that can read all of it, and its dominant script: the one of most of its letters, Latin at a tie."""
    count: dict[str, int] = {}
    for c in token:
        if c.isalpha():
            script = _script(unicodedata.normalize("NFD", c)[0])
            count[script] = count.get(script, 0) + 1
    if not count or set(count) == {"latin"} and not any(c in LATIN_TWINS for c in token):
        return {}, None
    out = {s: r for s in count if s != "latin" and (r := _in_script(token, s)) is not None}
    fixed = _bare(token)
    if all(_script(unicodedata.normalize("NFD", c)[0]) == "latin" for c in fixed if c.isalpha()):
        out["latin"] = fixed
    return out, max(count, key=lambda s: (count[s], s == "latin"))


def repair_token(token: str, known=None) -> str:
    """A token after the repair of look-alikes.

    It stays if no script reads all of it, and takes the reading if only one does. Of several, the Latin
    one is taken if ``known(lower-cased reading)`` says that the corpus has it, else the
    one of the dominant script. A single foreign letter is a word only if it is one of
    ONE_LETTER; without ``known`` nothing is known.
    """
    read, dominant = readings(token)
    if not read:
        return token
    if len(read) > 1 and known is not None and known(read["latin"].lower()) and not _lone(token):
        return read["latin"]
    return next(iter(read.values())) if len(read) == 1 else read.get(dominant, read["latin"])


def _lone(token: str) -> bool:
    letters = [c for c in token if c.isalpha()]
    return len(letters) == 1 and letters[0] not in ONE_LETTER


def _chars(text: str) -> tuple[list[str], list[int]]:
    """Characters after every repair that needs no token, and the place each came from."""
    out: list[str] = []
    at: list[int] = []
    n, i = len(text), 0
    while i < n:
        ch = text[i]
        if ch in UNSEEN:
            if ch in "\u200d\ufe0f\ufe0e" and i and (_emoji.match(text[i - 1]) or text[i - 1] in "\ufe0f#*0123456789" and (i + 1 < n and text[i + 1] == "\u20e3" or text[i - 1] == "\ufe0f")):
                out.append(ch)
                at.append(i)
            i += 1
            continue
        if ch in BLANKS:
            out.append(" ")
        elif ch in BREAKS:
            out.append("\n")
        elif ch == "\r" and i + 1 < n and text[i + 1] == "\n":
            out.append(ch)
        elif "\uff01" <= ch <= "\uff5e" or "\ufb00" <= ch <= "\ufb06" or "\U0001d400" <= ch <= "\U0001d7ff":
            for c in unicodedata.normalize("NFKC", ch):
                out.append(c)
                at.append(i)
            i += 1
            continue
        elif out and ("\u0300" <= ch <= "\u0333" or ch == "\u0338"):
            both = unicodedata.normalize("NFC", out[-1] + ch)
            if len(both) == 1:
                out[-1] = both
                i += 1
                continue
            twin = LATIN_TWINS.get(out[-1])
            if twin and len(both := unicodedata.normalize("NFC", twin + ch)) == 1:
                out[-1] = both
                i += 1
                continue
            out.append(ch)
        else:
            out.append(ch)
        at.append(i)
        i += 1
    return out, at


def fold(text: str, known=None) -> tuple[str, list[int] | None]:
    """The repaired text, and for each of its characters its place in the given text.

    None instead of the places means that nothing changed.
    """
    if plain(text):
        return text, None
    out, at = _chars(text)
    joined = "".join(out)
    fixed = _token.sub(lambda m: _bare(m[0]) if len(m[0]) == 1 and m[0].isupper() and (_numbered.search(joined, max(0, m.start() - 3), m.start()) or _numbering.match(joined, m.end())) else repair_token(m[0], known), joined)
    if len(fixed) != len(joined):  # a twin of two characters: keep the places right by leaving it out
        fixed = _token.sub(lambda m: r if len(r := repair_token(m[0], known)) == len(m[0]) else m[0], joined)
    return fixed, at


def foreign_tokens(text: str) -> list[str]:
    """The Latin readings, in lower case, of the tokens that another script can read too."""
    if plain(text):
        return []
    found = set()
    for m in _token.finditer("".join(_chars(text)[0])):
        read, _ = readings(m[0])
        if len(read) > 1 and "latin" in read and not _lone(m[0]):
            found.add(read["latin"].lower())
    return sorted(found)


def texts(tables: list[tuple[str, DataFrame, str, list[str]]]) -> DataFrame:
    """(tbl, row_id, field, text) of every named column that isn't null. tables: name, frame, id column, text columns."""
    out = None
    for tbl, df, key, fields in tables:
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
        one = df.select(F.lit(tbl).alias("tbl"), F.col(key).cast("long").alias("row_id"), F.explode(pairs).alias("p"))
        one = one.select("tbl", "row_id", "p.field", "p.text").where("text is not null")
        out = one if out is None else out.unionAll(one)
    return out


def repair(rows: DataFrame) -> DataFrame:
    """Adds ``repaired`` to (tbl, row_id, field, text); other columns aren't kept.

    Null texts are left out, an empty or blank text is its own repair. Rows delivered
    twice come out once. Every row that needs a vocabulary names its candidate words;
    these meet the corpus's own words in a shuffle join, so neither the vocabulary nor
    the candidates are ever sent to one place.
    """
    rows = rows.select("tbl", "row_id", "field", "text").where("text is not null")
    odd = rows.where(F.col("text").rlike(SUSPECT)).dropDuplicates(["tbl", "row_id", "field", "text"])

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [foreign_tokens(t) for t in b["text"]]
            yield b.assign(words=words)

    odd = durable(odd.mapInPandas(candidates, "tbl string, row_id long, field string, text string, words array<string>"))
    keys = ["tbl", "row_id", "field", "text"]
    asked = odd.where("size(words) > 0").select(*keys, F.explode("words").alias("word"))
    # whole words of the corpus, met only where a candidate, which has Latin letters alone, asks for them
    corpus = rows.select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{M}]+")).alias("word"))
    corpus = corpus.where("word <> ''").groupBy("word").agg(F.count("*").alias("n")).where("n > 1").select("word")
    met = asked.join(corpus.hint("shuffle_hash"), "word", "left_semi").groupBy(*keys).agg(F.collect_set("word").alias("known"))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [fold(t, set(k if k is not None else ()).__contains__)[0] for t, k in zip(b["text"], b["known"])]
            yield b[keys].assign(repaired=done)

    schema = "tbl string, row_id long, field string, text string, repaired string"
    return odd.drop("words").join(met, keys, "left").mapInPandas(apply, schema)


def found(rows: DataFrame) -> DataFrame:
    """(tbl, row_id, field) of the texts that the repair changes."""
    return repair(rows).where("not (text <=> repaired)").select("tbl", "row_id", "field").distinct()


def normalise(rows: DataFrame) -> DataFrame:
    """(tbl, row_id, field, text, repaired) of all texts, repaired or not."""
    same = rows.where("text is not null").where(~F.col("text").rlike(SUSPECT)).select("tbl", "row_id", "field", "text", F.col("text").alias("repaired")).dropDuplicates(["tbl", "row_id", "field", "text"])
    return repair(rows).unionByName(same)
