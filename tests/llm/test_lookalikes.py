from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trazo.llm import lookalikes as L

SCHEMA = "tbl string, row_id bigint, field string, text string"
CHANGED = {
    "ｈｏｌａ　ａｌｌá": "hola allá", "café": "café", "mañana": "mañana", "a​b": "ab", "ho­la": "hola", "a b": "a b", "ﬁesta": "fiesta",
    "lа mоnіtora": "la monitora", "dосumento": "documento", "CΑMINΟ": "CAMINO", "LΆΜΡARA": "LÁMPARA", "﻿sí": "sí", "a b": "a\nb",
}
KEPT = ["", " ", "hola\tallá\r\n", "n.º 2.ª ½ 30 °C… “ya” «no» — 3 €", "👩‍🏫 ❤️ 🙂👍🏽", "La palabra «мир»", "Ω y α antes que β", "naïve façade größe œuvre"]


def test_single_texts():
    for a, b in CHANGED.items():
        assert L.fold(a)[0] == b
        assert L.fold(b) == (b, None)
    for t in KEPT:
        assert L.fold(t)[0] == t


def test_whole_foreign_tokens_need_the_vocabulary():
    assert L.fold("еѕ")[0] == "еѕ" and L.fold("еѕ", {"es"}.__contains__)[0] == "es"
    assert L.fold("сосо", {"es"}.__contains__)[0] == "сосо"
    assert L.fold("α", lambda w: True)[0] == "α" and L.fold("а", lambda w: True)[0] == "a"
    assert L.foreign_tokens("еѕ мир а hola") == ["a", "es"]


@given(st.text(alphabet="aeñ éоеаνοΆ​‍❤️ｈﬁ 🙂я", max_size=30))
def test_places_and_stability(text):
    fixed, at = L.fold(text, lambda w: True)
    if at is None:
        assert fixed == text
    else:
        assert len(at) == len(fixed) and at == sorted(at) and all(0 <= i < len(text) for i in at)
    again = L.fold(fixed, lambda w: True)[0]
    assert L.fold(again, lambda w: True)[0] == again


def test_rows(spark):
    rows = [("t", 1, "f", "еѕ tarde"), ("t", 2, "f", "es mi casa"), ("t", 3, "f", "es"), ("t", 4, "f", None), ("t", 5, "f", ""), ("t", 6, "f", "сосо"), ("t", 1, "f", "еѕ tarde"), ("t", 7, "f", "x​y" * 5000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("words", F.lit(1)).withColumn("known", F.lit(1))
    assert {r.row_id for r in L.found(df).collect()} == {1, 7}
    out = {r.row_id: r.repaired for r in L.normalise(df).collect()}
    assert out == {1: "es tarde", 2: "es mi casa", 3: "es", 5: "", 6: "сосо", 7: "xy" * 5000}
    assert L.found(df.limit(0)).count() == 0


def test_texts(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, None)], "id int, a string, b string")
    assert [tuple(r) for r in L.texts([("t", df, "id", ["a", "b"])]).collect()] == [("t", 1, "a", "a")]


def test_the_dominant_script_decides_what_the_vocabulary_does_not():
    known = {"poca", "casa"}.__contains__
    assert L.fold("рoса")[0] == "роса" and L.fold("рoса", known)[0] == "poca"  # three Cyrillic letters and a Latin o
    assert L.fold("cаsа")[0] == "casa" and L.fold("сasa")[0] == "casa"  # Latin at least half
    assert L.fold("саѕa")[0] == "саѕа" and L.fold("саѕa", known)[0] == "casa"
    assert L.fold("јоvrе")[0] == "jovre" and L.fold("Τаsinеνі")[0] == "Tasinevi"  # only Latin can read all letters
    assert L.fold("мaмa")[0] == "мама" and L.fold("мaмaq")[0] == "мамаԛ" and L.fold("жab")[0] == "жab"  # no script reads the last one
    assert L.readings("рoса") == ({"cyrillic": "роса", "latin": "poca"}, "cyrillic") and L.readings("casa") == ({}, None)


def test_tainted_words_give_no_fragments(spark):
    rows = [("t", i, "f", "un cаsoж") for i in range(5)] + [("t", 9, "f", "с аѕо")]
    out = {r.row_id: r.repaired for r in L.normalise(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[9] == "с аѕо"  # neither "c" nor "aso" is a word of the corpus, parts of tainted words aren't
