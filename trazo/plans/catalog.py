"""One query for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trazo.functions import text as X
from trazo.operators import cascade, errors, fuzzy, indexes, metrics, noise, tokenised
from trazo.session import folder, spread
from trazo.sources import history as H
from trazo.sources import tables as T

_t = T.table


def _lex(spark: SparkSession, sf: str) -> DataFrame:
    return indexes.lexicon(_t(spark, sf, "lexicon"))


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return spread(T.once(_t(spark, sf, "requests"), "req_id").select("req_id", "user_id", "text"))


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return cascade.explode(_requests(spark, sf))


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return T.once(_t(spark, sf, "user_history"), "history_id").select("user_id", "seq", "erronea", "corregida")


def _spanish(spark: SparkSession, sf: str) -> DataFrame:
    return spread(_t(spark, sf, "documents").where(F.lower(F.trim("lang")).startswith("es")).select("text"))


def _cores(spark: SparkSession, sf: str) -> DataFrame:
    return _requests(spark, sf).select(F.explode(X.tokens(F.col("text"))).alias("t")).select(X.core(F.col("t")).alias("word")).where("word <> ''").distinct()


def lexicon_build(spark: SparkSession, sf: str) -> DataFrame:
    return _lex(spark, sf)


def lexicon_counted(spark: SparkSession, sf: str) -> DataFrame:
    return indexes.lexicon_from_texts(_spanish(spark, sf))


def tokens_split(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).select("req_id", "pos", "prefix", "core", "suffix", "left", "right")


def accent_fold(spark: SparkSession, sf: str) -> DataFrame:
    return _cores(spark, sf).select("word", X.remove_accents(F.col("word")).alias("folded"))


def phonetic_key(spark: SparkSession, sf: str) -> DataFrame:
    return _cores(spark, sf).select("word", X.phonetic_key(F.col("word")).alias("sound"))


def phonetic_index(spark: SparkSession, sf: str) -> DataFrame:
    return indexes.phonetic_index(_lex(spark, sf))


def accent_index(spark: SparkSession, sf: str) -> DataFrame:
    return indexes.accent_index(_lex(spark, sf))


def match_case(spark: SparkSession, sf: str) -> DataFrame:
    return _cores(spark, sf).select("word", X.match_case(F.col("word"), F.lit("niÑo")).alias("cased"))


def restore_accent(spark: SparkSession, sf: str) -> DataFrame:
    return indexes.restore_accent(_cores(spark, sf), indexes.accent_index(_lex(spark, sf)))


def phonetic_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return indexes.phonetic_lookup(_cores(spark, sf).select(F.lower("word").alias("word")).distinct(), indexes.phonetic_index(_lex(spark, sf)))


def visual_fold(spark: SparkSession, sf: str) -> DataFrame:
    words = _cores(spark, sf).select(F.lower("word").alias("word")).distinct()
    terms = _lex(spark, sf).select("term")
    unknown = words.join(terms, words["word"] == terms["term"], "left_anti").withColumn("folded", X.visual_fold(F.col("word")))
    return unknown.join(T.small(terms), F.col("folded") == F.col("term"), "left_semi")


def masked_context(spark: SparkSession, sf: str) -> DataFrame:
    rows = _requests(spark, sf).select("req_id", F.transform(X.tokens(F.col("text")), X.core).alias("w"))
    return rows.select("req_id", F.posexplode("w").alias("pos", "core"), "w").where(F.lower("core").isin(*cascade.HOMOPHONES)).select("req_id", "pos", X.masked(F.col("w"), F.col("pos")).alias("context"))


def corpus_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    return cascade.bigrams(_spanish(spark, sf))


def homophone_judge(spark: SparkSession, sf: str) -> DataFrame:
    rows = _tokens(spark, sf).withColumn("cands", cascade._map(cascade.HOMOPHONES, F.col("lower"))).where("cands is not null")
    return cascade.bigram_judge(cascade.bigrams(_spanish(spark, sf)))(rows).select("req_id", "pos", "lower", "chosen")


def fuzzy_top3(spark: SparkSession, sf: str) -> DataFrame:
    words = _cores(spark, sf).select(F.lower("word").alias("word")).distinct()
    lex = _lex(spark, sf)
    unknown = words.join(lex, words["word"] == lex["term"], "left_anti")
    top = fuzzy.closest(unknown, lex).select("word", F.posexplode("suggestions").alias("nth", "s"))
    return top.select("word", "nth", "s.distance", "s.freq", "s.term")


def _vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return H.user_vocabulary(_history(spark, sf))


def correct_layers(spark: SparkSession, sf: str) -> DataFrame:
    """The cascade without its fuzzy layer, the first homophone winning: what SQL can follow."""
    out = cascade.layers(_tokens(spark, sf), _lex(spark, sf), _vocabulary(spark, sf), fuzzy_layer=False)
    return out.select("req_id", "pos", "core", "layer", "best")


def layer_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return correct_layers(spark, sf).groupBy("layer").agg(F.count("*").alias("n"))


def correct_shallow(spark: SparkSession, sf: str) -> DataFrame:
    out = cascade.layers(_tokens(spark, sf), _lex(spark, sf), _vocabulary(spark, sf), fuzzy_layer=False)
    return cascade.reassemble(out)


def correct_text(spark: SparkSession, sf: str) -> DataFrame:
    """All layers, judged by the corpus's bigrams."""
    judge = cascade.bigram_judge(cascade.bigrams(_spanish(spark, sf)))
    return cascade.correct(_requests(spark, sf), _lex(spark, sf), _vocabulary(spark, sf), judge).select("req_id", "corrected", "was_modified")


def error_details(spark: SparkSession, sf: str) -> DataFrame:
    return errors.details(T.once(_t(spark, sf, "feedback"), "feedback_id"), "feedback_id", "original_text", "corrected_text")


def error_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return error_details(spark, sf).groupBy("type").agg(F.count("*").alias("n"))


def _feedback_requests(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.once(_t(spark, sf, "feedback_requests"), "fb_req_id")
    return rows.select("fb_req_id", "user_id", F.col("fb_req_id").alias("seq"), "original", "corrected", X.truthy(F.col("accepted")).alias("accepted"))


def feedback_status(spark: SparkSession, sf: str) -> DataFrame:
    return H.status(_feedback_requests(spark, sf)).select("fb_req_id", "accepted", "status")


def history_append(spark: SparkSession, sf: str) -> DataFrame:
    return H.history_rows(_feedback_requests(spark, sf))


def user_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return _vocabulary(spark, sf)


def user_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return H.ordered_pairs(_history(spark, sf))


def user_training_eligible(spark: SparkSession, sf: str) -> DataFrame:
    return H.eligible_users(_history(spark, sf))


def sentence_pool(spark: SparkSession, sf: str) -> DataFrame:
    return noise.sentences(_spanish(spark, sf))


def sentence_pool_limited(spark: SparkSession, sf: str) -> DataFrame:
    """The pool with a limit that small tables reach too."""
    return noise.sentences(_spanish(spark, sf), 500)


def noise_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of every sentence; the service's limit is kept in sentence_pool."""
    return noise.pairs(noise.sentences(_spanish(spark, sf), None))


def fallback_noise(spark: SparkSession, sf: str) -> DataFrame:
    return noise.sentences(_spanish(spark, sf), None).select("text", noise.fallback(F.col("text")).alias("noisy"))


def _accepted(spark: SparkSession, sf: str) -> DataFrame:
    fb = T.once(_t(spark, sf, "feedback"), "feedback_id").where("accepted and original_text is not null and corrected_text is not null")
    return spread(fb).select(F.col("feedback_id").alias("req_id"), "user_id", F.col("original_text").alias("text"), "corrected_text")


def _measured(fb: DataFrame, got: DataFrame) -> DataFrame:
    rows = fb.join(got.select("req_id", "corrected"), "req_id").select(F.col("text").alias("source"), F.col("corrected").alias("prediction"), F.col("corrected_text").alias("reference"))
    return metrics.evaluate(rows)


def evaluate(spark: SparkSession, sf: str) -> DataFrame:
    """The corrections of the accepted feedback, made as in correct_text, against what the users accepted."""
    fb = _accepted(spark, sf)
    judge = cascade.bigram_judge(cascade.bigrams(_spanish(spark, sf)))
    return _measured(fb, cascade.correct(fb.select("req_id", "user_id", "text"), _lex(spark, sf), _vocabulary(spark, sf), judge))


def evaluate_shallow(spark: SparkSession, sf: str) -> DataFrame:
    """The same of the cascade without its fuzzy layer, the first homophone winning."""
    fb = _accepted(spark, sf)
    return _measured(fb, cascade.reassemble(cascade.layers(cascade.explode(fb.select("req_id", "user_id", "text")), _lex(spark, sf), _vocabulary(spark, sf), fuzzy_layer=False)))


def request_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of three kinds, by the request's number: text and user as they are, nulls spelled out; input without a missing user; a null text before an input."""
    kind, options = F.pmod("req_id", F.lit(3)), {"ignoreNullFields": "false"}
    body = F.when(kind == 0, F.to_json(F.struct("text", "user_id"), options)).when(kind == 1, F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("input"), "user_id")))
    body = body.otherwise(F.to_json(F.struct(F.lit(None).cast("string").alias("text"), F.col("text").alias("input"), "user_id"), options))
    rows = T.once(_t(spark, sf, "requests"), "req_id").select("req_id", T.parse_correct(body).alias("r"))
    return rows.select("req_id", "r.text", "r.user_id", T.empty_text(F.col("r.text")).alias("error"))


def feedback_parse(spark: SparkSession, sf: str) -> DataFrame:
    body = F.to_json(F.struct("user_id", "original", "corrected", "accepted"), {"ignoreNullFields": "false"})
    rows = T.once(_t(spark, sf, "feedback_requests"), "fb_req_id").select("fb_req_id", T.parse_feedback(body).alias("r"))
    return rows.select("fb_req_id", "r.user_id", "r.original", "r.corrected", "r.accepted")


def _fresh(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def frequency_file(spark: SparkSession, sf: str) -> DataFrame:
    """The lexicon written as a frequency file and read back, ranks from the order of its lines."""
    path = _fresh(spark, "frequencies")
    T.write_frequency_file(_t(spark, sf, "lexicon"), path)
    return T.read_frequency_file(spark, path)


def parallel_side(spark: SparkSession, sf: str) -> DataFrame:
    """The Spanish side of a corpus of nested records, one field for each language."""
    lang = F.substring(F.lower(F.trim("lang")), 1, 2)
    sides = [F.when(lang == x, F.col("text")).alias(x) for x in ("es", "en", "fr", "de", "pt")]
    return T.parallel_sentences(_t(spark, sf, "documents").select(F.struct(*sides).alias("translation"))).where("text is not null")


def pairs_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The users' pairs written as CSV and read back."""
    path = _fresh(spark, "pairs")
    T.write_pairs_csv(_history(spark, sf), path)
    return T.read_pairs_csv(spark, path)


def tokenised_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The users' pairs as a tokenised training set."""
    return tokenised.dataset(_history(spark, sf).where("erronea is not null and corregida is not null"))


def response_json(spark: SparkSession, sf: str) -> DataFrame:
    """Responses read back: the number of details and the first one, next to both texts."""
    fb = T.once(_t(spark, sf, "feedback"), "feedback_id").where("original_text is not null and corrected_text is not null")
    body = T.response(F.col("original_text"), F.col("corrected_text"), errors.details_column(F.col("original_text"), F.col("corrected_text")))
    schema = "input string, original string, corrected string, analysis struct<details:array<struct<word:string,correction:string,type:string>>>"
    rows = fb.select("feedback_id", F.from_json(body, schema).alias("r"))
    first = F.try_element_at("r.analysis.details", F.lit(1))
    return rows.select("feedback_id", "r.input", "r.corrected", F.size("r.analysis.details").cast("long").alias("n_details"), first["word"].alias("first_word"), first["type"].alias("first_type"))


def feedback_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The feedback requests taken through the stream into a fresh store, and the store's pairs."""
    from trazo.streaming import feedback as S

    base = _fresh(spark, "feedback")
    store = H.HistoryStore(spark, f"{base}/history")
    source = f"{sf}/feedback_requests.parquet"
    schema = spark.read.parquet(source).schema
    # a stream reads folders; a table of one file is found by its name
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(source if _is_folder(spark, source) else sf + "/feedback_requests*.parquet")
    S.save_stream(S.deduplicated(stream), store, f"{base}/state").awaitTermination()
    return store.all_pairs()


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


QUERIES = {f.__name__: f for f in (
    lexicon_build, lexicon_counted, tokens_split, accent_fold, phonetic_key, phonetic_index, accent_index, match_case, restore_accent, phonetic_lookup,
    visual_fold, masked_context, corpus_bigrams, homophone_judge, fuzzy_top3, correct_layers, layer_histogram, correct_shallow, correct_text,
    error_details, error_histogram, feedback_status, history_append, user_vocabulary, user_pairs, user_training_eligible, sentence_pool,
    noise_pairs, fallback_noise, evaluate, evaluate_shallow, request_parse, feedback_parse, response_json, feedback_stream,
    frequency_file, parallel_side, pairs_csv, tokenised_pairs, sentence_pool_limited,
)}
