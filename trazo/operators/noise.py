"""Wrong and right training pairs made from right sentences.

Every draw is a hash of seed, sentence, position and purpose, so the same sentence gets the
same noise on any cluster, whatever its partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trazo.functions import text as X

#: Letters that are confused by sight and by sound.
SIGHT = {"b": "d", "d": "b", "p": "q", "q": "p", "n": "u", "u": "n", "m": "w", "w": "m"}
SOUND = {"v": "b", "b": "v", "s": "c", "c": "s", "z": "s", "j": "g", "g": "j", "y": "ll"}
VOWELS = "aeiouáéíóú"
SHORTEST, LONGEST, MOST_SENTENCES = 15, 80, 15_000
ERROR_RATE, COIN, JOIN_RATE = 0.30, 0.6, 0.15


def sentences(texts: DataFrame, most: int | None = MOST_SENTENCES) -> DataFrame:
    """(text): distinct stripped sentences of 15 to 80 characters of (text), the first ``most`` in order of their letters."""
    split = texts.where("text is not null").select(F.explode(F.split("text", r"(?<=[.!?…])\s+|\n+")).alias("t"))
    kept = split.select(X.strip(F.col("t")).alias("text")).where(F.length("text").between(SHORTEST, LONGEST)).distinct()
    return kept.orderBy("text").limit(most) if most else kept


def fallback(text: Column) -> Column:
    """Plain confusion of v, s and h; it may change nothing."""
    return F.translate(text, "vsh", "bz")


def _letter(word: Column, rules: dict[str, str], key: list, purpose: str) -> Column:
    """The first letter that has a rule and wins its coin is replaced; capitals stay capitals."""
    table = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])
    chars = F.split(word, "")
    hits = F.transform(chars, lambda c, i: F.when(F.lower(c).isin(*rules) & (X.uniform(*key, purpose, i) < COIN), i))
    at = F.array_min(F.filter(hits, lambda i: i.isNotNull()))
    old = F.substr(word, at + 1, F.lit(1))
    new = F.try_element_at(table, F.lower(old))
    new = F.when((F.upper(old) == old) & (F.lower(old) != old), F.upper(new)).otherwise(new)
    return F.when(at.isNull(), word).otherwise(F.concat(F.substr(word, F.lit(1), at), new, F.substr(word, at + 2)))


def _h(word: Column) -> Column:
    first, rest = F.substring(word, 1, 1), F.substr(word, F.lit(2))
    h = F.when((F.upper(first) == first) & (F.lower(first) != first), "H").otherwise("h")
    return F.when(F.lower(first) == "h", rest).when(F.lower(first).isin(*VOWELS), F.concat(h, word)).otherwise(word)


def _omit(word: Column, key: list) -> Column:
    at = F.lit(1) + F.floor(X.uniform(*key, "omit") * (F.length(word) - 2)).cast("int")
    return F.when(F.length(word) <= 3, word).otherwise(F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2)))


def spoil(word: Column, key: list) -> Column:
    """One rule applied to the word: sound 40 %, sight 30 %, h 15 %, omission 15 %. It may change nothing."""
    u = X.uniform(*key, "rule")
    return F.when(u < 0.40, _letter(word, SOUND, key, "sound")).when(u < 0.70, _letter(word, SIGHT, key, "sight")).when(u < 0.85, _h(word)).otherwise(_omit(word, key))


def inject(pool: DataFrame, seed: int = 7) -> DataFrame:
    """(text, noisy): each sentence with one to three errors at most, spent on words of two letters or more; sometimes two words are joined.

    The budget is spent even where a rule changes nothing. Sentences are taken as distinct.
    """
    s = str(seed)
    words = pool.where("text is not null").select("text", X.tokens(F.col("text")).alias("w"))
    most = 1 + F.floor(X.uniform(s, F.col("text"), "most") * 3).cast("int")
    # places that win their draw, in order; the first ``most`` of them spend the budget
    won = F.filter(F.transform("w", lambda x, i: F.when((F.length(x) >= 2) & (X.uniform(s, F.col("text"), i, "draw") < ERROR_RATE), i)), lambda i: i.isNotNull())
    rows = words.withColumn("won", won).withColumn("won", F.slice("won", F.lit(1), most))
    exploded = rows.select("text", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"), "won")
    hit = F.array_contains("won", F.col("pos"))
    exploded = exploded.withColumn("word", F.when(hit, spoil(F.col("word"), [s, F.col("text"), F.col("pos")])).otherwise(F.col("word")))
    lists = exploded.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("l"))
    rows = lists.select("text", F.transform("l", lambda x: x["word"]).alias("w"))
    at = F.floor(X.uniform(s, F.col("text"), "where") * (F.size("w") - 1)).cast("int")
    join = (X.uniform(s, F.col("text"), "join") < JOIN_RATE) & (F.size("w") > 2)
    joined = F.concat(F.slice("w", F.lit(1), at), F.array(F.concat(F.get("w", at), F.get("w", at + 1))), F.slice("w", at + 3, F.greatest(F.size("w") - at - 2, F.lit(0))))
    return rows.select("text", F.array_join(F.when(join, joined).otherwise(F.col("w")), " ").alias("noisy"))


def pairs(pool: DataFrame, noise: Callable[[DataFrame], DataFrame] = inject) -> DataFrame:
    """(erronea, corregida): the noisy sentence, or the fallback noise where it equals the right one. noise: any function like ``inject``."""
    rows = noise(pool)
    return rows.select(F.when(F.col("noisy") != F.col("text"), F.col("noisy")).otherwise(fallback(F.col("text"))).alias("erronea"), F.col("text").alias("corregida"))
