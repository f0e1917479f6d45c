"""Reading and writing of the tables and files the engine works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trazo.functions import text as X
from trazo.session import numbered

#: Dimension tables of a fixed size may go to every task up to this many rows.
MOST_DIMENSION_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, key: str) -> DataFrame:
    """One row for each key; rows delivered twice hold the same content."""
    return df.dropDuplicates([key])


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint if the frame has at most MOST_DIMENSION_ROWS rows, else the frame as it is."""
    return F.broadcast(df) if df.limit(MOST_DIMENSION_ROWS + 1).count() <= MOST_DIMENSION_ROWS else df


def read_frequency_file(spark: SparkSession, path: str) -> DataFrame:
    """(rank, term, freq) of a text file with a term and a count a line; blank lines are skipped, rank is the line's order.

    The line order is the order of the file's blocks, so ranks are right for one file of any size.
    """
    parts = spark.read.text(path).select(X.tokens(F.col("value")).alias("p")).where("size(p) > 1")
    parts = parts.select(F.lower(F.col("p")[0]).alias("term"), F.try_to_number(F.col("p")[1], F.lit("9999999999999999")).cast("long").alias("freq"))
    return numbered(parts, "rank").select(F.col("rank").cast("int").alias("rank"), "term", "freq")


def parallel_sentences(df: DataFrame, column: str = "translation.es") -> DataFrame:
    """(text) of one side of a parallel corpus, read as nested records."""
    return df.select(F.col(column).alias("text"))


def write_frequency_file(terms: DataFrame, path: str) -> None:
    """(rank, term, freq) as one text file with a term and its count a line, in the order of rank; blank terms are left out."""
    rows = terms.where(F.coalesce(X.strip(F.col("term")), F.lit("")) != "").select("rank", F.concat_ws(" ", X.strip(F.col("term")), F.col("freq").cast("string")).alias("value"))
    rows.coalesce(1).sortWithinPartitions("rank").select("value").write.mode("overwrite").text(path)


#: Blanks at the ends of a text are part of it.
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_pairs_csv(pairs: DataFrame, path: str) -> None:
    """Two columns with a header; a null becomes an empty text."""
    pairs.select(F.coalesce("erronea", F.lit("")).alias("erronea"), F.coalesce("corregida", F.lit("")).alias("corregida")).write.mode("overwrite").options(**_CSV).csv(path)


def read_pairs_csv(spark: SparkSession, path: str) -> DataFrame:
    """Pairs as they were written; texts such as null stay texts."""
    schema = T.StructType([T.StructField("erronea", T.StringType()), T.StructField("corregida", T.StringType())])
    return spark.read.options(**_CSV).option("multiLine", True).option("nullValue", "\u0000").option("emptyValue", "").schema(schema).csv(path)


# -- request and response bodies -----------------------------------------------------


def _key(body: Column, key: str, default: Column) -> Column:
    """The value of a body's key, null where it holds null; the default only where the key is missing or the body is no object."""
    values = F.from_json(body, "map<string,string>")
    return F.when(F.coalesce(F.map_contains_key(values, key), F.lit(False)), F.try_element_at(values, F.lit(key))).otherwise(default)


def parse_correct(body: Column) -> Column:
    """struct(text, user_id) of a correction request's JSON: text if the key is there, else input, else empty. An explicit null stays null."""
    text = _key(body, "text", _key(body, "input", F.lit("")))
    return F.struct(text.alias("text"), _key(body, "user_id", F.lit("default_user")).alias("user_id"))


def parse_feedback(body: Column) -> Column:
    """struct(user_id, original, corrected, accepted) of a feedback request's JSON. An explicit null stays null; accepted is then false."""
    return F.struct(
        _key(body, "user_id", F.lit("default_user")).alias("user_id"), _key(body, "original", F.lit("")).alias("original"), _key(body, "corrected", F.lit("")).alias("corrected"),
        X.truthy(_key(body, "accepted", F.lit("false"))).alias("accepted"),
    )


def empty_text(text: Column) -> Column:
    """The error a request without text gets, else null."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit('{"error":"Texto vacío"}'))


def response(text: Column, corrected: Column, details: Column) -> Column:
    """JSON of a correction response."""
    return F.to_json(F.struct(text.alias("input"), text.alias("original"), corrected.alias("corrected"), F.struct(details.alias("details")).alias("analysis")))
