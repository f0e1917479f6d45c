import random
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from trazo.llm import duplicates as D

SCHEMA = "id bigint, a string, b string"


def brute(rows):
    key = lambda t: tuple(re.findall(r"[^\W_]+", (t or "").lower()))
    groups = {}
    for i, a, b in {r for r in rows if r[0] is not None}:
        groups.setdefault(tuple(sorted((key(a), key(b)))), set()).add(i)
    return {(i, min(g)) for g in groups.values() if len(g) > 1 for i in g}


def pairs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.id, r.rep) for r in D.groups(df, "id", ["a", "b"]).collect()}


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = ["Hola", "hola", "ÁRBOL", "árbol", "arbol", "¡sí!", "...", "", "x1", " ", "\t"]
    text = lambda: rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))])
    rows = [(i, text(), text()) for i in range(400)]
    rows += rows[:20]
    assert pairs(spark, rows) == brute(rows)


def test_nulls_case_and_order(spark):
    rows = [(1, "¡Hola, MUNDO!", "b"), (2, "B", "hola mundo"), (3, "hola mundo b", ""), (4, None, None), (5, "", " "), (None, "b", "hola mundo"), (6, "straße", "x"), (7, "X", "STRASSE")]
    assert pairs(spark, rows) == {(1, 1), (2, 1), (4, 4), (5, 4), (6, 6), (7, 6)}


def test_hot_group_long_text_and_empty(spark, monkeypatch):
    monkeypatch.setattr(D, "HOT_SHARE", 1 / 100)
    rows = [(i, "la misma frase", "otra") for i in range(1500)] + [(5000 + i, f"frase {i}", "x" * 20000 if i < 3 else "y") for i in range(1500)] + [(9000, "frase 7!", "y"), (9001, "FRASE 0", "x" * 20000)]
    got = pairs(spark, rows)
    assert {(i, 0) for i in range(1500)} <= got and len(got) == 1504
    assert pairs(spark, []) == set()


def test_digest_collision_is_split(spark, monkeypatch):
    monkeypatch.setattr(D, "_hash", lambda c: F.lit(b"same"))
    rows = [(1, "a", "b"), (2, "B", "A"), (3, "c", "d"), (4, "C", "d."), (5, "z", "z")]
    assert pairs(spark, rows) == {(1, 1), (2, 1), (3, 3), (4, 3)}


def test_collapse_counts_and_clashing_names(spark):
    rows = [(1, "a", "b"), (2, "b", "a"), (2, "b", "a"), (3, "c", "d")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("root", F.lit(1)).withColumn("rep", F.lit(2)).withColumn("whole", F.lit("x"))
    assert {tuple(r) for r in D.collapse(df, "id", ["a", "b"]).collect()} == {(1, 2), (3, 1)}


def test_nested_records(spark):
    kind = T.StructType([T.StructField("t", T.StringType()), T.StructField("l", T.ArrayType(T.StringType())), T.StructField("m", T.MapType(T.StringType(), T.StringType()))])
    rows = [(1, ("A b", ["x", "Y"], {"k": "v", "q": "w"})), (2, ("a, B", ["y", "X"], {"Q": "W", "K": "V"})), (3, ("a b", ["x", "z"], {"k": "v"})), (4, None), (5, (None, None, None))]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("id", T.LongType()), T.StructField("r", kind)]))
    assert {(r.id, r.rep) for r in D.groups(df, "id", ["r"]).collect()} == {(1, 1), (2, 1), (4, 4), (5, 4)}
    assert D.groups(df, "id", ["r"], ordered=True).where("id = 2").count() == 0
