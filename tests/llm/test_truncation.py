import random

from pyspark.sql import functions as F

from trazo.llm import truncation as T

SCHEMA = "doc_id bigint, source string, text string"


def corpus(rng, n):
    who, did = ["el gato gris", "la tortuga vieja", "mi hermana", "un pastor"], ["vio", "compró", "guardó"]
    what, where = ["una bicicleta", "el paraguas", "la guitarra", "un cuaderno"], ["en la cocina", "al lado de la fuente", "junto al río", "a la vuelta del mercado"]
    say = lambda: " ".join(rng.choice(x) for x in (who, did, what, where)).capitalize() + "."
    return [" ".join(say() for _ in range(rng.randrange(2, 6))) for _ in range(n)]


def test_cut_texts(spark):
    rng = random.Random(9)
    docs = [(i, "s", t) for i, t in enumerate(corpus(rng, 400))]
    cut = {1000: "Mi hermana vio una bici", 1001: "La tortuga vieja compró el", 1002: "Un pastor guardó la guitarra en la", 1003: "El gato gris vio el para-", 1004: "Mi hermana compró un cuader… leer más", 1005: "Mi hermana vio una bicicleta al lado de"}
    whole = {2000: "Mi hermana vio una bicicleta en la cocina", 2001: "Un pastor compró el paraguas junto al río", 2002: "Hola", 2003: "Un pastor vio la guitarra en la cocina.\nGracias", 2004: "", 2005: None, 2006: "...", 2007: "El gato gris vio el paraguas junto al río..."}
    df = spark.createDataFrame(docs + [(i, None, t) for i, t in {**cut, **whole}.items()] + [(None, "s", "Mi hermana vio una bici")], SCHEMA).withColumn("a", F.lit(1)).withColumn("n_chars", F.lit(0))
    assert {r.doc_id for r in T.truncated(df).collect()} == set(cut)
    shares = {r.source: (r.n_docs, r.n_cut) for r in T.shares(df).collect()}
    assert shares == {None: (len(cut) + len(whole), len(cut)), "s": (401, 0)}


def test_field_limit(spark):
    rng = random.Random(10)
    docs = [(i, "s", " ".join(corpus(rng, 3))[:120]) for i in range(60)] + [(100 + i, "t", x) for i, x in enumerate(corpus(rng, 100))]
    got = {r.doc_id: r.why for r in T.truncated(spark.createDataFrame(docs, SCHEMA)).collect()}
    closed = {i for i, _, t in docs if t.endswith(".")}
    assert set(got) == set(range(60)) - closed


def test_empty_and_long(spark):
    assert T.truncated(spark.createDataFrame([], SCHEMA)).count() == 0
    long = " ".join(corpus(random.Random(11), 2000))
    df = spark.createDataFrame([(1, "s", long), (2, "s", long + " La tortuga vieja compró el")], SCHEMA)
    assert [r.doc_id for r in T.truncated(df).collect()] == [2]


def test_markers_in_brackets(spark):
    docs = [(i, "s", t) for i, t in enumerate(corpus(random.Random(9), 400))]
    marks = ["(sigue)", "[texto cortado]", "[...]", "[+]", "(…)"]
    cut = {1000 + i: f"Un pastor guardó la guitarra en la {m}" for i, m in enumerate(marks)} | {1010 + i: f"Mi hermana vio una bici {m}" for i, m in enumerate(marks)} | {1020: "La tortuga vieja compró el (sigue)...", 1021: "Mi hermana compró un cuader… (leer más)"}
    whole = {2000 + i: f"Un pastor guardó la guitarra en la cocina.\n{m}" for i, m in enumerate(marks + ["(continuará)"])} | {2010 + i: f"Un pastor guardó la guitarra en la cocina {m}" for i, m in enumerate(marks)}
    whole |= {2020: "Un pastor guardó la guitarra en la (cocina)", 2021: "(sigue)", 2022: "[...]", 2023: "Un pastor guardó la guitarra en la [1]."}
    got = T.truncated(spark.createDataFrame(docs + [(i, None, t) for i, t in {**cut, **whole}.items()], SCHEMA)).collect()
    assert {r.doc_id for r in got} == set(cut)


def test_commas_capitals_and_beginnings(spark):
    base = corpus(random.Random(12), 300) + [t.replace(" en la cocina", " en la cocina, como siempre") for t in corpus(random.Random(13), 300)] + [f"El lunes, {t[0].lower()}{t[1:]}" for t in corpus(random.Random(14), 100)]
    cut = {1000: "Un pastor vio la guitarra en la cocina,", 1001: "MI HERMANA COMPRÓ EL PARAGUAS A LA", 1002: "El lunes,", 1003: "Mi hermana vio el para�", 1004: "Un pastor compró una​ bici­cle"}
    whole = {2000: "UN PASTOR VIO LA GUITARRA JUNTO AL RÍO", 2001: "Un pastor vio la guitarra en la cocina", 2002: "x" * 5000, 2003: "12,5"}
    docs = [(i, "s", t) for i, t in enumerate(base)] + [(i, "s", t) for i, t in {**cut, **whole}.items()]
    got = {r.doc_id: r.why for r in T.truncated(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert set(got) == set(cut) and set(got.values()) <= {"trigram", "bigram", "unigram"}
    assert T.truncated(spark.createDataFrame([(1, None, None), (None, None, None), (2, None, " \n")], SCHEMA)).count() == 0


def test_a_line_many_texts_close_with_is_whole(spark):
    docs = [(i, "s", t + "\nFirmado, la clase de Rolla") for i, t in enumerate(corpus(random.Random(15), 60))] + [(100 + i, "s", t) for i, t in enumerate(corpus(random.Random(16), 300))]
    assert T.truncated(spark.createDataFrame(docs, SCHEMA)).count() == 0
