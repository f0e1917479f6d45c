"""The layered correction of every token.

Tokens are decided one by one from the original text alone, so a text is exploded into
tokens and put together again by position. What a token's layer depends on is its lower-cased
word and its user, so lexicon, sounds and fuzzy terms are looked up once for every distinct
word, users' own corrections once for every distinct user and word, and tokens meet the
outcome in a single join; only the judge looks at neighbours, once for every distinct context.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trazo.functions import text as X
from trazo.operators import fuzzy, indexes
from trazo.session import durable
from trazo.sources.tables import small

#: Severe errors and what they stand for.
MANUAL = {
    "uillos": "niños", "ciubab": "ciudad", "caíbas": "caídas", "bamo": "vamos", "bamos": "vamos", "oy": "hoy", "ise": "hice", "iso": "hizo",
    "iva": "iba", "aiga": "haya", "haiga": "haya", "ay": "hay", "dondis": "donde", "dodes": "donde", "dondes": "donde", "be": "de",
}
#: Homophones and their candidates; the order decides ties.
HOMOPHONES = {
    "beses": ["beses", "veces"], "tubo": ["tubo", "tuvo"], "asia": ["asia", "hacia"], "baya": ["baya", "vaya", "valla"], "valla": ["valla", "vaya", "baya"],
    "bello": ["bello", "vello"], "vello": ["vello", "bello"], "asta": ["asta", "hasta"], "echo": ["echo", "hecho"], "ola": ["ola", "hola"],
    "olla": ["olla", "hola"], "a": ["a", "ha"], "e": ["e", "he"],
}

#: A judge takes rows with left, right and cands (an array) and adds ``chosen``.
Judge = Callable[[DataFrame], DataFrame]


def first_candidate(rows: DataFrame) -> DataFrame:
    """The judge that trusts the order of the candidates."""
    return rows.withColumn("chosen", F.col("cands")[0])


def bigram_judge(bigrams: DataFrame) -> Judge:
    """A judge that scores a candidate by the corpus: log counts of (left, candidate) and (candidate, right).

    bigrams: (a, b, n). The highest score wins, the first candidate at a tie; a single
    candidate wins unscored. It keeps a masked language model's contract, not its choices.
    """

    def judge(rows: DataFrame) -> DataFrame:
        asked = rows.where("size(cands) > 1").select("left", "right", "cands").distinct()
        each = asked.select("left", "right", "cands", F.posexplode("cands").alias("i", "cand"))
        pairs = each.join(bigrams.select(F.col("a").alias("left"), F.col("b").alias("cand"), F.col("n").alias("n_left")), ["left", "cand"], "left")
        pairs = pairs.join(bigrams.select(F.col("a").alias("cand"), F.col("b").alias("right"), F.col("n").alias("n_right")), ["cand", "right"], "left")
        score = F.log1p(F.coalesce("n_left", F.lit(0))) + F.log1p(F.coalesce("n_right", F.lit(0)))
        best = pairs.withColumn("score", F.round(score, 9)).groupBy("left", "right", "cands").agg(F.max_by("cand", F.struct(F.col("score"), -F.col("i"))).alias("chosen"))
        # a single candidate meets no context and stays
        return rows.join(best, ["left", "right", "cands"], "left").withColumn("chosen", F.coalesce("chosen", F.col("cands")[0]))

    return judge


def bigrams(texts: DataFrame) -> DataFrame:
    """(a, b, n): neighbouring lower-cased cores of (text); '' stands before the first and behind the last."""
    words = F.concat(F.array(F.lit("")), F.transform(X.tokens(F.col("text")), lambda t: F.lower(X.core(t))), F.array(F.lit("")))
    pairs = F.arrays_zip(F.slice(words, 1, F.size(words) - 1).alias("a"), F.slice(words, 2, F.size(words) - 1).alias("b"))
    return texts.where("text is not null").select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))


def explode(requests: DataFrame) -> DataFrame:
    """(req_id, user_id, pos, prefix, core, suffix, lower, left, right) of (req_id, user_id, text); a null or blank text has no tokens."""
    words = requests.select("req_id", "user_id", F.transform(X.tokens(F.col("text")), lambda t: F.struct(X.prefix(t).alias("prefix"), X.core(t).alias("core"), X.suffix(t).alias("suffix"))).alias("w"))
    rows = words.select("req_id", "user_id", F.posexplode("w").alias("pos", "t"), F.col("w.core").alias("cores"))
    near = lambda i: F.lower(F.coalesce(F.try_element_at("cores", i), F.lit("")))
    return rows.select(
        "req_id", "user_id", "pos", "t.prefix", "t.core", "t.suffix", F.lower("t.core").alias("lower"),
        F.when(F.col("pos") > 0, near(F.greatest(F.col("pos"), F.lit(1)))).otherwise("").alias("left"), near(F.col("pos") + 2).alias("right"),
    )


def _map(values: dict, key: Column) -> Column:
    flat = []
    for k, v in values.items():
        flat += [F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)]
    return F.try_element_at(F.create_map(*flat), key)


def _facts(words: DataFrame, lex: DataFrame) -> DataFrame:
    """(lower, short) with valid, folded, heard, manual, homophones, and ``plain``: the layer of a user without corrections."""
    terms, sounds = lex.select("term"), indexes.phonetic_index(lex)
    rows = words.join(small(terms.withColumn("valid", F.lit(True))), F.col("lower") == F.col("term"), "left").drop("term")
    rows = rows.join(small(terms.select(F.col("term").alias("folded"))), X.visual_fold(F.col("lower")) == F.col("folded"), "left")
    rows = rows.join(small(sounds.withColumnsRenamed({"sound": "_s", "term": "heard"})), X.phonetic_key(F.col("lower")) == F.col("_s"), "left").drop("_s")
    rows = rows.withColumn("manual", _map(MANUAL, F.col("lower"))).withColumn("homophones", _map(HOMOPHONES, F.col("lower")))
    plain = (
        F.when(F.col("lower") == "", "H0")
        .when(F.col("manual").isNotNull(), "H1")
        .when(F.col("valid").isNull() & F.col("folded").isNotNull(), "H2")
        .when(F.col("homophones").isNotNull(), "H4")
        .when(F.col("short"), "H5")
        .when(F.col("valid").isNotNull(), "H6")
        .when(F.col("heard").isNotNull() & (F.col("heard") != F.col("lower")), "H7")
        .otherwise("H8")
    )
    return rows.select("lower", "short", plain.alias("plain"), "manual", "folded", "homophones", "heard")


def layers(tokens: DataFrame, lex: DataFrame, vocabulary: DataFrame, judge: Judge = first_candidate, fuzzy_layer: bool = True, protect_numeric: bool = False) -> DataFrame:
    """Adds layer (H0 to H8) and best to the rows of ``explode``.

    lex: (term, rank, freq); vocabulary: (user_id, wrong, right), a word once for a user.
    Without the fuzzy layer its tokens only get their accent back. protect_numeric leaves
    numbers alone, which the faithful default doesn't. A null user has no corrections.
    ``tokens`` is read twice, so it should be cheap to read.
    """
    lex = durable(lex.select("term", "rank", "freq"))
    keyed = tokens.withColumn("short", F.length("core") <= 2)
    own = keyed.groupBy("user_id", "lower", "short").agg(F.count("*").alias("_n")).drop("_n")
    words = _facts(own.select("lower", "short").distinct(), lex)
    if fuzzy_layer:
        words = durable(words)
        unknown = F.col("plain") == "H8"
        if protect_numeric:
            unknown &= ~F.col("lower").rlike(r"^\p{Nd}+$")
        near = fuzzy.closest(words.where(unknown).select(F.col("lower").alias("word")), lex)
        near = near.select(F.col("word").alias("_w"), F.transform("suggestions", lambda s: s["term"]).alias("near"))
        words = words.join(near, (F.col("lower") == F.col("_w")) & unknown, "left").drop("_w")
    else:
        words = words.withColumn("near", F.lit(None).cast("array<string>"))
    learnt = vocabulary.select(F.col("user_id").alias("_u"), F.col("wrong").alias("_w"), F.col("right").alias("learnt"))
    own = own.join(learnt, (F.col("user_id") == F.col("_u")) & (F.col("lower") == F.col("_w")), "left").drop("_u", "_w").join(words, ["lower", "short"])
    layer = F.when(F.col("plain").isin("H0", "H1", "H2") | F.col("learnt").isNull(), F.col("plain")).otherwise("H3")
    own = own.withColumn("layer", layer).select(
        F.col("user_id").alias("_u"), F.col("lower").alias("_l"), F.col("short").alias("_s"), "layer",
        F.when(F.col("layer") == "H1", F.col("manual")).when(F.col("layer") == "H2", F.col("folded")).when(F.col("layer") == "H3", F.col("learnt")).when(F.col("layer") == "H7", F.col("heard")).alias("given"),
        F.when(F.col("layer") == "H4", F.col("homophones")).when(F.col("layer") == "H8", F.col("near")).alias("cands"),
    )
    rows = keyed.join(own, F.col("user_id").eqNullSafe(F.col("_u")) & (F.col("lower") == F.col("_l")) & (F.col("short") == F.col("_s"))).drop("_u", "_l", "_s")
    if judge is first_candidate:
        rows = rows.withColumn("chosen", F.col("cands")[0])
    else:
        rows = durable(rows)
        contexts = judge(rows.where("cands is not null").select("left", "right", "cands").distinct())
        contexts = contexts.select(F.col("left").alias("_left"), F.col("right").alias("_right"), F.col("cands").alias("_cands"), "chosen")
        # only tokens with candidates meet the contexts; the others would all share the null key
        asked = rows.where("cands is not null").join(contexts, (F.col("left") == F.col("_left")) & (F.col("right") == F.col("_right")) & (F.col("cands") == F.col("_cands")), "left")
        rows = rows.where("cands is null").withColumn("chosen", F.lit(None).cast("string")).unionByName(asked.drop("_left", "_right", "_cands"))
    # the word whose accent comes back, by layer
    said = F.when(F.col("layer") == "H4", X.match_case(F.col("core"), F.col("chosen")))
    said = said.when(F.col("layer") == "H7", X.match_case(F.col("core"), F.col("given"))).when((F.col("layer") == "H8") & F.col("chosen").isNotNull(), F.col("chosen")).otherwise(F.col("core"))
    rows = indexes.restore_accent(rows.withColumn("said", said), indexes.accent_index(lex), "said", "accented")
    best = (
        F.when(F.col("layer") == "H0", "")
        .when(F.col("layer").isin("H1", "H2", "H3"), X.match_case(F.col("core"), F.col("given")))
        .when(F.col("layer") == "H5", F.col("core"))
        .when((F.col("layer") == "H8") & F.col("chosen").isNotNull(), X.match_case(F.col("core"), F.col("accented")))
        .otherwise(F.col("accented"))
    )
    return rows.withColumn("best", best).select(*tokens.columns, "layer", "best")


def reassemble(decided: DataFrame) -> DataFrame:
    """(req_id, corrected): tokens with their affixes, in order, one blank between."""
    word = F.struct("pos", F.concat("prefix", "best", "suffix").alias("w"))
    lists = decided.groupBy("req_id").agg(F.array_sort(F.collect_list(word)).alias("l"))
    return lists.select("req_id", F.array_join(F.transform("l", lambda x: x["w"]), " ").alias("corrected"))


def correct(requests: DataFrame, lex: DataFrame, vocabulary: DataFrame, judge: Judge = first_candidate, **options) -> DataFrame:
    """(req_id, user_id, input, corrected, was_modified) of every request; req_id is unique. A null or blank text is corrected to ''."""
    decided = reassemble(layers(durable(explode(requests)), lex, vocabulary, judge, **options))
    out = requests.select("req_id", "user_id", F.col("text").alias("input")).join(decided, "req_id", "left")
    out = out.withColumn("corrected", F.coalesce("corrected", F.lit("")))
    return out.withColumn("was_modified", F.coalesce(F.col("input") != F.col("corrected"), F.lit(False)))
