"""The lexicon and what is looked up in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trazo.functions import text as X
from trazo.session import numbered


def lexicon(raw: DataFrame) -> DataFrame:
    """(term, rank, freq) from (rank, term, freq): lower-cased terms, each with its first rank and its last frequency. Null and blank terms are left out."""
    rows = raw.select("rank", F.lower(X.strip(F.col("term"))).alias("term"), "freq").where("term <> ''")
    return rows.groupBy("term").agg(F.min("rank").alias("rank"), F.max_by("freq", "rank").alias("freq"))


def lexicon_from_texts(texts: DataFrame, least: int = 3) -> DataFrame:
    """(term, rank, freq) counted from (text): lower-cased letters-only cores seen at least so often, by frequency and then term."""
    words = texts.select(F.explode(X.tokens(F.col("text"))).alias("w")).select(F.lower(X.core(F.col("w"))).alias("term")).where(F.col("term").rlike("^[a-záéíóúüñ]+$"))
    counts = words.groupBy("term").agg(F.count("*").alias("freq")).where(F.col("freq") >= least)
    return numbered(counts.orderBy(F.desc("freq"), "term"), "rank").select("term", F.col("rank").cast("int").alias("rank"), "freq")


def phonetic_index(lex: DataFrame) -> DataFrame:
    """(sound, term): the first term, by rank, of every sound; terms of one or two letters have none."""
    rows = lex.where("length(term) > 2").select(X.phonetic_key(F.col("term")).alias("sound"), "term", "rank")
    return rows.groupBy("sound").agg(F.min_by("term", "rank").alias("term"))


def accent_index(lex: DataFrame) -> DataFrame:
    """(unaccented, accented): the most frequent accented term, the first one at a tie, if it is over five times as frequent as the bare term."""
    accented = lex.where("length(term) > 2").withColumn("unaccented", X.remove_accents(F.col("term"))).where("unaccented <> term")
    bare = lex.select(F.col("term").alias("unaccented"), F.col("freq").alias("bare_freq"))
    rows = accented.join(bare, "unaccented", "left").where("freq > 5 * coalesce(bare_freq, 0)")
    return rows.groupBy("unaccented").agg(F.max_by("term", F.struct(F.col("freq"), -F.col("rank"))).alias("accented"))


def restore_accent(words: DataFrame, index: DataFrame, column: str = "word", out: str = "restored") -> DataFrame:
    """Adds the word with its accent, in its own way of capitals."""
    from trazo.sources.tables import small

    joined = words.join(small(index.withColumnsRenamed({"unaccented": "_u", "accented": "_a"})), F.lower(F.col(column)) == F.col("_u"), "left")
    return joined.withColumn(out, X.match_case(F.col(column), F.coalesce("_a", F.lower(F.col(column))))).drop("_u", "_a")


def phonetic_lookup(words: DataFrame, index: DataFrame, column: str = "word", out: str = "heard") -> DataFrame:
    """Adds the first term that sounds like the word, or the word itself."""
    from trazo.sources.tables import small

    joined = words.join(small(index.withColumnsRenamed({"sound": "_s", "term": "_t"})), X.phonetic_key(F.col(column)) == F.col("_s"), "left")
    return joined.withColumn(out, F.coalesce("_t", F.col(column))).drop("_s", "_t")
