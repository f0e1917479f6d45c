import random

import pytest
from pyspark.sql import functions as F

from trazo.llm import pairs as P

LEX = "el la gato gris vio una casa grande en plaza de quiero comprar un hilo madera y zorro tiene sueño que no sabe nada tambor".split()
PROMPT = "el gato gris bio una casa grande en la plaza de rufeli"
FIXED = "El gato gris vio una casa grande en la plaza de Rufeli."
CASES = {
    FIXED: None, None: "empty", "": "empty", " ​": "empty", "nan": "empty", "N/A": "empty", "s/r": "empty", "(vacío)": "empty", "¿?": "empty", "sin respuesta": "empty",
    PROMPT: "copy", PROMPT.upper() + "!!": "copy", f"aquí tienes: «{PROMPT}»": "copy", f"{PROMPT} {PROMPT}": "copy", "el gato gris vio una casa gr": "truncated", "El gato gris vio una": "truncated", "el gato gris vio una casa grande en la...": "truncated",
    "Lo siento, no puedo corregir este texto.": "refusal", "disculpa, esto queda fuera de lo que hago": "refusal", "uf, prefiero no tocar tu redacción…": "refusal",
    "the grey cat saw a big house in the garden of rufeli": "other_language", "le chat gris a vu une grande maison près de rufeli": "other_language", "der alte mann sah das haus auf dem markt von rufeli": "other_language", "o gato cinzento viu uma casa na feira de rufeli": "other_language",
    "el gato gris vio una casagrande en la plaza de rufeli": None,
}


SPOKEN = {
    "es": "el gato gris vio una casa grande en la plaza y quiero comprar un hilo de madera porque la niña tiene sueño y no sabe nada del tambor",
    "en": "the grey cat saw a big house in the garden and she wants to buy the thread because her brother was tired and they had nothing to do with that drum",
    "fr": "le chat gris a vu une grande maison près de la place et elle veut acheter un fil parce que son frère était fatigué dans le jardin avec les autres",
    "de": "der alte mann sah das haus auf dem markt und sie wollte einen faden kaufen weil ihr bruder müde war und nichts von der trommel wusste",
    "pt": "o gato cinzento viu uma casa na feira e ela quer comprar um fio porque o irmão estava cansado e não sabia nada do tambor com os outros",
}


def counted(text):
    out = {}
    for w in P.words(text):
        for i in range(len(w)):
            g = f" {w} "[i : i + 3]
            out[g] = out.get(g, 0) + 1
    return out


LANGUAGES = P.Languages({k: counted(v) for k, v in SPOKEN.items()})


@pytest.mark.parametrize("answer", CASES)
def test_single_pairs(answer):
    assert P.defect(PROMPT, answer, set(LEX).__contains__, LANGUAGES) == CASES[answer]


def test_lcs_against_dynamic_programme():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert P.lcs_table(a, b) == t[len(a)]


def test_null_and_long():
    assert P.defect(None, "algo de texto") is None and P.defect(None, None) == "empty" and P.defect("", "") == "empty"
    long = " ".join(f"palabra{i}" for i in range(3000))
    assert P.defect(long, long) == "copy" and P.defect(long, long[: len(long) // 2]) == "truncated"
    longer = " ".join(f"palabra{i}" for i in range(40_000))  # aligned by words
    assert P.defect(longer, longer[: len(longer) // 2]) == "truncated" and P.defect(longer, longer.replace("palabra7 ", "palabro7 ")) is None


def test_tables(spark):
    h = [
        (1, None, PROMPT, PROMPT), (1, None, PROMPT, PROMPT), (2, 10, PROMPT, None), (3, 11, PROMPT, None), (4, 12, PROMPT, FIXED), (5, None, "el gato gris vio una casa", "el gato gris vio una casa"),
        (6, None, "el gato gato vio una casa", "el gato gato vio una casa"), (None, None, "x", None), (7, 99, "x", None), (8, None, None, None),
    ] + [(20 + i, None, "el zorro bio nada", "el zorro vio nada") for i in range(3)]
    history = spark.createDataFrame(h, "history_id bigint, fb_req_id bigint, erronea string, corregida string").withColumn("defect", F.lit("clash")).withColumn("word", F.lit("clash"))
    requests = spark.createDataFrame([(10, "Yes"), (10, "Yes"), (11, "sí"), (12, "1"), (None, "yes"), (13, None)], "fb_req_id bigint, accepted string")
    rows = P.pairs(history, requests)
    # 5 too: an answer that only gives back the prompt's words is a copy, whatever the prompt needed
    assert {tuple(r) for r in P.defects(rows, LEX, {}).collect()} == {(1, "copy"), (2, "empty"), (5, "copy"), (6, "copy"), (8, "empty")}
    assert P.defects(rows.limit(0), [], {}).count() == 0


def test_refusals_with_other_words():
    known = set(LEX).__contains__
    for a in "Lo siento, no puedo, de momento, corregir este texto", "uf, no puedo corrregir esa redacción", "disculpa, esto queda fuera ya de lo que hago":
        assert P.defect(PROMPT, a, known) == "refusal"
    assert P.defect(PROMPT, "un zorro no puede nunca dormir", set(LEX + ["puede"]).__contains__) is None


def test_languages_are_fitted_on_labels(spark, monkeypatch):
    rows = [(i, SPOKEN["es"], " ES-es ") for i in range(30)] + [(100 + i, SPOKEN["en"], "en") for i in range(20)] + [(200, SPOKEN["fr"], "fr"), (201, None, "es"), (202, "x", None), (203, "", "es"), (204, "w" * 10_000, "es")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("n", F.lit("clash"))
    got = P.fit_languages(df)
    assert set(got) == {"es", "en"} and got["en"] == {g: 20 * n for g, n in counted(SPOKEN["en"]).items()}
    monkeypatch.setattr(P, "FIT_TEXTS", 10)
    assert P.fit_languages(df) == P.fit_languages(df.repartition(3)) and sum(P.fit_languages(df)["en"].values()) < sum(got["en"].values())
    assert P.fit_languages(df.limit(0)) == {}
    pairs = spark.createDataFrame([(1, "quiero comprar una casa grande", "she had nothing to do with the house"), (2, "quiero conprar una casa grande", "quiero comprar una casa grande")], "history_id bigint, prompt string, answer string")
    assert [tuple(r) for r in P.defects(pairs, [], got).collect()] == [(1, "other_language")]
