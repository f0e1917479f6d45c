"""Word-level string functions; all are native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space as Python's str.split sees it.
WHITE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Fixed value: a character outside words.
_OUTER = r"[^\p{L}\p{N}_]"
TITLE = r"^[^\p{Lu}\p{Ll}]*(?:\p{Lu}\p{Ll}*(?:[^\p{Lu}\p{Ll}]+|$))+$"


def tokens(text: Column) -> Column:
    """Tokens between white space; none of them is empty. Null stays null."""
    return F.filter(F.split(text, WHITE + "+"), lambda x: x != "")


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def prefix(token: Column) -> Column:
    """What stands before the first letter, number or underscore; the whole token if it has none."""
    return F.regexp_extract(token, f"^{_OUTER}*+", 0)


def core(token: Column) -> Column:
    """The token without its prefix and suffix."""
    return F.regexp_replace(token, f"^{_OUTER}++|{_OUTER}++$", "")


def suffix(token: Column) -> Column:
    """What stands behind the last letter, number or underscore; a token that has none is all prefix."""
    return F.when(F.regexp_like(token, F.lit(f"^{_OUTER}*+$")), "").otherwise(F.regexp_extract(token, f"(?<!{_OUTER}){_OUTER}*+$", 0))


def remove_accents(word: Column) -> Column:
    """Lower case, vowels without accent or diaeresis; the tilde of the n stays."""
    return F.translate(F.lower(word), "áéíóúü", "aeiouu")


#: Sound rules in their order.
SOUND_RULES = (("ll", "y"), ("qu", "k"), ("z", "s"), ("ce", "se"), ("ci", "si"), ("ca", "ka"), ("co", "ko"), ("cu", "ku"), ("ge", "je"), ("gi", "ji"))


def phonetic_key(word: Column) -> Column:
    """Words that sound alike have the same key."""
    w = F.translate(remove_accents(word), "qwvh", "pmb")
    for a, b in SOUND_RULES:
        w = F.replace(w, F.lit(a), F.lit(b))
    return collapse_runs(w)


def collapse_runs(word: Column) -> Column:
    """Every run of one character becomes that character; runs of r stay."""
    return F.regexp_replace(word, "([^r])\\1+", "$1")


def visual_fold(lower: Column) -> Column:
    """Mirrored letters of a lower-case word set right."""
    return F.translate(lower, "qwb", "pmd")


def match_case(original: Column, corrected: Column) -> Column:
    """The corrected word in the original's way of capitals.

    An empty original leaves it alone; all capitals of more than one character, a title and
    everything else give capitals, a capital and small letters.
    """
    title = F.concat(F.upper(F.substring(corrected, 1, 1)), F.lower(F.substr(corrected, F.lit(2))))
    upper = (F.upper(original) == original) & (F.lower(original) != original) & (F.length(original) > 1)
    return F.when(original == "", corrected).when(upper, F.upper(corrected)).when(original.rlike(TITLE), title).otherwise(F.lower(corrected))


def truthy(raw: Column) -> Column:
    """A raw value as true or false; null is false."""
    return F.coalesce(F.lower(raw.cast("string")), F.lit("false")).isin("true", "1", "t", "y", "yes")


def masked(words: Column, position: Column, mask: str = "[MASK]") -> Column:
    """The words joined by blanks, the one at the position (from 0) replaced by the mask."""
    return F.array_join(F.transform(words, lambda w, i: F.when(i == position, F.lit(mask)).otherwise(w)), " ")


def uniform(*key: Column | str) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    parts = [F.lit(k) if isinstance(k, str) else k.cast("string") for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
