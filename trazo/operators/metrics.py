"""Measures of a correction against its reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trazo.functions import text as X


def word_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of words, natively: every distinct word of both becomes a character of its own.

    Characters count from U+0100 on and leave the surrogates out, so there are enough for a million words.
    """
    every = F.array_distinct(F.concat(a, b))

    def letters(words: Column) -> Column:
        at = lambda w: F.array_position(every, w) + 255
        code = lambda w: F.lpad(F.hex(F.when(at(w) < 0xD800, at(w)).otherwise(at(w) + 0x800)), 8, "0")
        return F.decode(F.unhex(F.array_join(F.transform(words, code), "")), "UTF-32")

    # nothing to decode means no words
    return F.when(F.size(a) == 0, F.size(b)).when(F.size(b) == 0, F.size(a)).otherwise(F.levenshtein(letters(a), letters(b)))


def evaluate(rows: DataFrame, source: str = "source", prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """One row (wer, cer, improvement_ratio), rounded to six digits.

    wer and cer are edits over the reference's length, summed over the whole set; the ratio
    is the share of the edit distance between source and reference that the prediction
    removed, 0 if there was none. Rows with a null are left out; with an empty reference
    side the rates are null. One pass over the rows and one aggregate.
    """
    r = rows.select(F.col(source).alias("s"), F.col(prediction).alias("p"), F.col(reference).alias("r")).dropna()
    each = r.select("s", "p", "r", X.tokens(F.col("p")).alias("pw"), X.tokens(F.col("r")).alias("rw"))
    one = each.agg(
        F.sum(word_distance(F.col("pw"), F.col("rw"))).alias("we"), F.sum(F.size("rw")).alias("wn"),
        F.sum(F.levenshtein("p", "r")).alias("ce"), F.sum(F.length("r")).alias("cn"), F.sum(F.levenshtein("s", "r")).alias("before"),
    )
    rate = lambda a, n: F.round(F.try_divide(F.col(a), F.col(n)), 6)
    ratio = F.when(F.col("before") > 0, F.round((F.col("before") - F.col("ce")) / F.col("before"), 6)).otherwise(0.0)
    return one.select(rate("we", "wn").alias("wer"), rate("ce", "cn").alias("cer"), ratio.alias("improvement_ratio"))
