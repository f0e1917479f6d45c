"""The users' history as a table partitioned by a hash of the user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trazo.functions import text as X

#: Sequence numbers of a user that one task orders.
BUCKET_SEQ = 100_000

#: Folders of a store; part of its layout, as a user's folder is found by this number.
STORE_BUCKETS = 32

#: Files that one append may put into a folder, so that no task writes all rows of a frequent user.
STORE_FILES = 4


def accepted_feedback(feedback: DataFrame) -> DataFrame:
    """Feedback that is kept: accepted, and neither text empty or null. Columns user_id, original, corrected, accepted and others."""
    return feedback.where(F.col("accepted") & (F.coalesce("original", F.lit("")) != "") & (F.coalesce("corrected", F.lit("")) != ""))


def status(feedback: DataFrame) -> DataFrame:
    """Adds status: saved or ignored."""
    keep = F.coalesce(F.col("accepted"), F.lit(False)) & (F.coalesce("original", F.lit("")) != "") & (F.coalesce("corrected", F.lit("")) != "")
    return feedback.withColumn("status", F.when(keep, "saved").otherwise("ignored"))


def history_rows(feedback: DataFrame) -> DataFrame:
    """(user_id, seq, erronea, corregida), lower-cased, of the feedback that is kept."""
    return accepted_feedback(feedback).select("user_id", "seq", F.lower("original").alias("erronea"), F.lower("corrected").alias("corregida"))


def user_vocabulary(history: DataFrame) -> DataFrame:
    """(user_id, wrong, right): the last correction of each word.

    history: (user_id, seq, erronea, corregida). Rows with different numbers of tokens are
    skipped; a word counts if its core isn't empty and differs but for case. The last is the
    one with the greatest (seq, pos); equal ones are told apart by the word itself. The
    right word may be empty. Null users form a user of their own.
    """
    both = history.select("user_id", "seq", X.tokens(F.coalesce("erronea", F.lit(""))).alias("e"), X.tokens(F.coalesce("corregida", F.lit(""))).alias("c")).where("size(e) = size(c)")
    words = both.select("user_id", "seq", F.posexplode(F.arrays_zip("e", "c")).alias("pos", "w"))
    words = words.select("user_id", "seq", "pos", F.lower(X.core(F.col("w.e"))).alias("wrong"), F.lower(X.core(F.col("w.c"))).alias("right")).where("wrong <> '' and wrong <> right")
    last = words.groupBy("user_id", "wrong").agg(F.max(F.struct("seq", "pos", "right")).alias("last"))
    return last.select("user_id", "wrong", F.col("last.right").alias("right"))


def eligible_users(history: DataFrame, least: int = 5) -> DataFrame:
    """(user_id, n_pairs) of the users with enough pairs to train on."""
    return history.groupBy("user_id").agg(F.count("*").alias("n_pairs")).where(F.col("n_pairs") >= least)


def _bucket(user_id: Column) -> Column:
    return F.pmod(F.xxhash64(user_id), F.lit(STORE_BUCKETS)).cast("int")


class HistoryStore:
    """History as a parquet table under a path; a user's bucket is found by partition pruning, their rows in it by the files' order.

    An append writes STORE_BUCKETS * STORE_FILES files at most, however many users it holds.
    No user id ever becomes part of a path, so it may hold any character, be empty or of any length.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save_feedback(self, feedback: DataFrame) -> None:
        """Appends the accepted feedback (user_id, seq, original, corrected, accepted)."""
        self._exists()
        rows = history_rows(feedback).withColumn("user_id_bucket", _bucket(F.col("user_id")))
        rows = rows.repartition("user_id_bucket", F.pmod(F.xxhash64("seq"), F.lit(STORE_FILES))).sortWithinPartitions("user_id_bucket", "user_id", "seq")
        rows.write.mode("append").partitionBy("user_id_bucket").parquet(self.path)

    def _rows(self) -> DataFrame:
        schema = "seq long, erronea string, corregida string, user_id string, user_id_bucket int"
        if not self._exists():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def _rows_of(self, user_id: str) -> DataFrame:
        return self._rows().where((F.col("user_id_bucket") == _bucket(F.lit(user_id))) & (F.col("user_id") == user_id)).drop("user_id_bucket")

    def all_pairs(self) -> DataFrame:
        return self._rows().drop("user_id_bucket")

    def user_pairs(self, user_id: str) -> DataFrame:
        """(erronea, corregida, seq) of one user; no rows for an unknown one."""
        return self._rows_of(user_id).select("erronea", "corregida", "seq")

    def user_vocabulary(self, user_id: str | None = None) -> DataFrame:
        return user_vocabulary(self.all_pairs() if user_id is None else self._rows_of(user_id))

    def _exists(self) -> bool:
        """A store in the earlier layout, with a folder for each user, is refused: lookups by bucket would miss its rows."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return False
        if any(s.getPath().getName().startswith("user_id=") for s in fs.listStatus(path)):
            raise ValueError(f"{self.path} is a store with a folder for each user; write it again")
        return True


def ordered_pairs(history: DataFrame, bucket: int = BUCKET_SEQ) -> DataFrame:
    """(user_id, nth, erronea, corregida): each user's pairs numbered in file order.

    A user may hold any share of the rows: pairs are numbered within stretches of ``bucket``
    sequence numbers, and each stretch begins where the ones before it end.
    """
    rows = history.select("user_id", "seq", F.floor(F.col("seq") / F.lit(bucket)).alias("b"), "erronea", "corregida")
    counts = rows.groupBy("user_id", "b").agg(F.count("*").alias("n"))
    before = counts.select(F.col("user_id").alias("_u"), F.col("b").alias("_b"), (F.sum("n").over(Window.partitionBy("user_id").orderBy("b")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("user_id", "b").orderBy("seq", "erronea", "corregida"))
    joined = rows.withColumn("i", inside).join(before, F.col("user_id").eqNullSafe(F.col("_u")) & F.col("b").eqNullSafe(F.col("_b")))
    return joined.select("user_id", (F.col("before") + F.col("i")).alias("nth"), "erronea", "corregida")
