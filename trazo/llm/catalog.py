"""Queries of the training-data operators; one function each, all over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trazo.llm import duplicates, lookalikes, mixing, packing, pairs, personal, terms, tokens, truncation
from trazo.llm.sql import ORACLE  # noqa: F401
from trazo.session import durable


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return lookalikes.texts([
        ("requests", _t(spark, sf, "requests"), "req_id", ["text"]),
        ("feedback", _t(spark, sf, "feedback"), "feedback_id", ["original_text", "corrected_text"]),
    ])


def _lexicon(spark: SparkSession, sf: str) -> list[str]:
    """The terms of the lexicon table, which has a fixed size; a larger one is refused."""
    most = 2_000_000
    rows = _t(spark, sf, "lexicon").select("term").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    return [r[0] for r in rows if r[0]]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.found_pairs([
        ("feedback", _t(spark, sf, "feedback"), "feedback_id", ["original_text", "corrected_text"]),
        ("user_history", _t(spark, sf, "user_history"), "history_id", ["erronea", "corregida"]),
    ])


def p1_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    one = duplicates.collapse(_t(spark, sf, "feedback"), "feedback_id", ["original_text", "corrected_text"]).select(F.lit("feedback").alias("tbl"), "id", "n_copies")
    two = duplicates.collapse(_t(spark, sf, "user_history"), "history_id", ["erronea", "corregida"]).select(F.lit("user_history").alias("tbl"), "id", "n_copies")
    return one.unionByName(two)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    given = personal.given_list(_t(spark, sf, "given_names"))
    return personal.find(_texts(spark, sf), given, _lexicon(spark, sf)).select("tbl", "row_id", "field", "kind", "ord")


def p2_redacted(spark: SparkSession, sf: str) -> DataFrame:
    given = personal.given_list(_t(spark, sf, "given_names"))
    return personal.redact(_texts(spark, sf), given, _lexicon(spark, sf))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalikes.found(_texts(spark, sf))


def p3_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return lookalikes.normalise(_texts(spark, sf)).select("tbl", "row_id", "field", "repaired")


def _p4(spark: SparkSession, sf: str) -> DataFrame:
    we = _t(spark, sf, "word_errors")
    fields = {"word": terms.trimmed(F.col("word")), "correction": terms.trimmed(F.col("correction")), "type": terms.despaced(F.col("type"))}
    return terms.marked(terms.frequencies(we, "req_id", "pos", fields), we.agg(F.count_distinct("req_id").alias("n")))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p4(spark, sf).where("mark is not null").select("field", "value", "mark")


def p4_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return _p4(spark, sf)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = pairs.pairs(_t(spark, sf, "user_history"), _t(spark, sf, "feedback_requests"))
    return pairs.defects(rows, _lexicon(spark, sf), pairs.fit_languages(_t(spark, sf, "documents")))


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", "source", tokens.n_tokens(F.col("text")).alias("tokens"))


def _capacities(spark: SparkSession, sf: str) -> list[int]:
    """The different capacities, which are few; more than the bound are refused."""
    most = 10_000
    rows = _t(spark, sf, "containers").select("capacity_tokens").where("capacity_tokens > 0").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} capacities")
    return [r[0] for r in rows]


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """(id, size), counted once: the number of items is needed before they are dealt."""
    return durable(_sized(spark, sf).select(F.col("doc_id").alias("id"), F.col("tokens").alias("size")))


def p6_packed(spark: SparkSession, sf: str) -> DataFrame:
    """All capacities jointly."""
    return packing.assign(_items(spark, sf), _capacities(spark, sf))


def p6_packed_each(spark: SparkSession, sf: str) -> DataFrame:
    """Every capacity by itself, one assignment of all texts for each."""
    return packing.assign_each(_items(spark, sf), _capacities(spark, sf))


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing.report(p6_packed(spark, sf))


def p7_mixed(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_sized(spark, sf), _t(spark, sf, "mix_targets"))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(p7_mixed(spark, sf), _t(spark, sf, "mix_targets"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated(_t(spark, sf, "documents")).select("doc_id")


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.shares(_t(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (
    p1_found, p1_collapsed, p2_found, p2_redacted, p3_found, p3_repaired, p4_found, p4_frequencies, p5_found,
    p6_packed, p6_packed_each, p6_report, p7_mixed, p7_shares, p8_found, p8_shares,
)}
