"""Word errors between a text and its correction, and their types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trazo.functions import text as X

#: Names of the types.
VISUAL, PHONOLOGICAL, VOWELS, OTHER = "Dislexia Visual (Espejamiento)", "Disgrafía Fonológica", "Sustitución de Vocales", "Otro (Gramática/Léxico)"
MIRRORED = ("bd", "db", "pq", "qp", "un", "nu")
SOUNDS = ("bv", "vb", "cs", "sc", "zs", "sz")


def classify(wrong: Column, right: Column) -> Column:
    """The type of an error: one substituted letter that mirrors, sounds alike or is a vowel, else other."""
    # the first place at which the words differ is behind their common beginning
    same = F.length(wrong) == F.length(right)
    pairs = F.filter(F.zip_with(F.split(wrong, ""), F.split(right, ""), lambda a, b: F.when(a != b, F.concat(a, b))), lambda p: p.isNotNull())
    pair = F.when(same & (F.levenshtein(wrong, right) == 1), F.try_element_at(pairs, F.lit(1)))
    return (
        F.when(pair.isin(*MIRRORED), VISUAL).when(pair.isin(*SOUNDS), PHONOLOGICAL).when(pair.rlike("^[aeiou]{2}$"), VOWELS).otherwise(OTHER)
    )


def details(pairs: DataFrame, key: str, original: str, corrected: str) -> DataFrame:
    """(key, pos, word, correction, type): positions at which both texts, lower-cased, hold different tokens.

    The longer text's surplus is ignored; null texts have no tokens; punctuation belongs to
    the tokens. Other columns aren't read.
    """
    a, b = X.tokens(F.lower(F.coalesce(F.col(original), F.lit("")))), X.tokens(F.lower(F.coalesce(F.col(corrected), F.lit(""))))
    rows = pairs.select(F.col(key).alias(key), a.alias("_a"), b.alias("_b")).withColumn("_n", F.least(F.size("_a"), F.size("_b"))).where("_n > 0")
    zipped = F.arrays_zip(F.slice("_a", 1, F.col("_n")).alias("word"), F.slice("_b", 1, F.col("_n")).alias("correction"))
    words = rows.select(key, F.posexplode(zipped).alias("pos", "w")).select(key, "pos", "w.word", "w.correction").where("word <> correction")
    return words.withColumn("type", classify(F.col("word"), F.col("correction")))


def details_column(original: Column, corrected: Column) -> Column:
    """The same as an array in the row."""
    a, b = X.tokens(F.lower(F.coalesce(original, F.lit("")))), X.tokens(F.lower(F.coalesce(corrected, F.lit(""))))
    n = F.least(F.size(a), F.size(b))
    zipped = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.struct(x.alias("word"), y.alias("correction"), classify(x, y).alias("type")))
    return F.when(n > 0, F.filter(zipped, lambda e: e["word"] != e["correction"])).otherwise(F.array().cast("array<struct<word:string,correction:string,type:string>>"))
