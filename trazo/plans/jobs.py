"""Batch jobs: python -m trazo.plans.jobs pairs|user-pairs|tokens|correct --sf_dir DIR --out DIR [--user_id ID]."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trazo.operators import noise, tokenised
from trazo.plans import catalog
from trazo.sources import history as H
from trazo.sources import tables as T


def training_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Noisy pairs of the Spanish documents; an empty set is an error."""
    pairs = noise.pairs(noise.sentences(T.table(spark, sf, "documents").where(F.lower(F.trim("lang")).startswith("es")).select("text"), None))
    if pairs.isEmpty():
        raise ValueError("no training pairs")
    return pairs


def user_pairs(spark: SparkSession, sf: str, user_id: str, least: int = 5) -> DataFrame:
    """A user's own pairs in order, if there are enough of them to train on."""
    rows = T.once(T.table(spark, sf, "user_history"), "history_id").where(F.col("user_id") == user_id)
    if H.eligible_users(rows, least).isEmpty():
        raise ValueError(f"fewer than {least} pairs")
    return H.ordered_pairs(rows).select("erronea", "corregida")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("job", choices=["pairs", "user-pairs", "tokens", "correct"])
    p.add_argument("--sf_dir", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--user_id", default="default_user")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.job == "correct":
        catalog.correct_text(spark, a.sf_dir).write.mode("overwrite").parquet(a.out)
    elif a.job == "tokens":
        tokenised.dataset(training_pairs(spark, a.sf_dir)).write.mode("overwrite").parquet(a.out)
    else:
        T.write_pairs_csv(training_pairs(spark, a.sf_dir) if a.job == "pairs" else user_pairs(spark, a.sf_dir, a.user_id), a.out)


if __name__ == "__main__":
    main()
