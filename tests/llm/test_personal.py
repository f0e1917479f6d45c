import pytest
from pyspark.sql import functions as F

from trazo.llm import personal as P

GIVEN = ["Marta", "Vega", "Lucía", "Pilar"]
COMMON = "la el casa tortuga verde una que con me ayudó los deberes tengo abuelo hoja como mi tarde de tienda hablé señora es maestra contó hojas gentes cuesta".split()
CASES = {
    "Escribe a marta.x+1@correo.example hoy": ["email"], "ANA@MAIL.EXAMPLE.NET": ["email"], "va x_1 arroba correo punto example.": ["email"], "a b(at)c.test y d[at]e.org": ["email", "email"],
    "x (arroba) y.example": ["email"], "<z-1@escuela.invalid>": ["email"], "y @ z.example": ["email"], "Cita @ las cinco. Pregunta a @profe en clase.": [],
    "Llama al 612345678": ["phone"], "+34 612 34 56 78 o 0034612345678": ["phone", "phone"], "(+34) 612345678": ["phone"], "76 70 99 36 4": ["phone"], "+1 202-555-0183": ["phone"], "+44 7700 900409": ["phone"],
    "612-34-56-78 y 612.345.678.": ["phone", "phone"], "seis uno dos tres cuatro cinco seis siete ocho": ["phone"], "seiscientos doce trescientos cuarenta y cinco seiscientos setenta y ocho": ["phone"],
    "La suma da 480 215 377. Del 600 al 650 de cinco en cinco. Sumó 12345678 puntos.": [], "12/05/2016 a las 17:30, 84-0000-111-2, 3.000 m, Exp. 2023-00451": [],
    "12345678Z": ["id_number"], "DNI 12.345.678-Z, 12 345 678 z": ["id_number", "id_number"], "X1234567L o x-1234567-l": ["id_number", "id_number"], "99/57673505/68": ["id_number"], "dni 12345678A": ["id_number"], "12345678A": [],
    "Vivo en c/ Olmo Seco, 12, 3.º B, 28001 Lugo": ["address"], "avda. de la Luna Chica n.º 6 5º izda. (Rufe)": ["address"], "plaza del Farol 40, piso 2": ["address"], "el camino 3 de la maqueta. Cuesta 3 €.": [],
    "en la plaza contó 30 hojas": [], "Soy Marta Ruzábal y tengo 3": ["name"], "vega carballosa me ayudó": ["name"], "Ruzábal, Lucía": ["name"], "A. Garrigaz": ["name"], "Sra. Peñulrra": ["name"], "D.ª Morgodrán": ["name"],
    "Dile a Óscar Zubilte que ya": ["name"], "me llamo celso berronval": ["name"], "CELSO BERRONVAL me ayudó": ["name"], "Marta María de Ruzábal": ["name"],
    "Tiene don de gentes. Hablé con la señora de la tienda. La maestra cntó hojas": [], "Semana Santa. Sala Verde. Soy Tortuga Veloz": [], "Me llamo como mi abuelo. Marta. la Vega": [], "": [], " ": [],
    "Móvil: ６１２ 345​ 678": ["phone"], "Hablo con Ｍａｒｔａ Ruzábal": ["name"],
}


@pytest.fixture(scope="module")
def finder():
    return P.Finder(GIVEN, COMMON)


@pytest.mark.parametrize("text", CASES)
def test_cases(finder, text):
    assert [k for k, _, _ in finder.spans(text)] == CASES[text]


def test_redaction_keeps_the_rest(finder):
    assert finder.redact("Hola, soy Marta Ruzábal;  tel. 612 345 678.") == "Hola, soy [NAME];  tel. [PHONE]."
    assert finder.redact("ｄｅｊａ ６１２３４５６７８ aquí") == "ｄｅｊａ [PHONE] aquí"
    assert finder.redact("Vivo en c/ Olmo Seco, 12, 3.º B, 28001 Lugo. Adiós") == "Vivo en [ADDRESS]. Adiós"
    assert finder.redact(None) is None and finder.redact("") == "" and finder.spans(None) == []


def test_long_text(finder):
    text = "La casa es verde. " * 5000 + "Soy Marta Ruzábal. " + "1 " * 3000 + "612345678"
    assert [k for k, _, _ in finder.spans(text)] == ["name", "phone"]


def test_rows(spark):
    rows = [("t", 1, "f", "612345678 y 698765432; a@b.example"), ("t", 1, "f", "612345678 y 698765432; a@b.example"), ("t", 2, "f", None), ("t", 3, "f", "")]
    df = spark.createDataFrame(rows, "tbl string, row_id bigint, field string, text string").withColumn("kind", F.lit(1)).withColumn("ord", F.lit(1))
    got = {tuple(r)[:5] for r in P.find(df, GIVEN, COMMON).collect()}
    assert got == {("t", 1, "f", "phone", 1), ("t", 1, "f", "phone", 2), ("t", 1, "f", "email", 1)}
    assert P.find(df, GIVEN, COMMON).count() == 3 and P.find(df.limit(0), [], []).count() == 0
    out = {r.row_id: r.redacted for r in P.redact(df, [], []).collect()}
    assert out == {1: "[PHONE] y [PHONE]; [EMAIL]", 2: None, 3: ""}


def test_given_names_are_bounded(spark, monkeypatch):
    df = spark.createDataFrame([("Ana",), (None,), ("Luz",)], "given_name string")
    assert sorted(P.given_list(df)) == ["Ana", "Luz"]
    monkeypatch.setattr(P, "MOST_GIVEN_NAMES", 1)
    with pytest.raises(ValueError):
        P.given_list(df)


def test_accounts_and_control_numbers(finder):
    spans = lambda t: [(k, t[a:b]) for k, a, b in finder.spans(t)]
    assert spans("IBAN ES91 2100 0418 4502 0005 1332 y tarjeta 4111 1111 1111 1111.") == [("account", "ES91 2100 0418 4502 0005 1332"), ("account", "4111 1111 1111 1111")]
    assert spans("ES92 2100 0418 4502 0005 1332 y 4111 1111 1111 1112") == []  # wrong check digits
    assert spans("000000000000 y 281234567840, afiliación 281234567800") == [("id_number", "281234567840"), ("id_number", "281234567800")]
    assert finder.redact("Paga a ES9121000418450200051332 ya") == "Paga a [ACCOUNT] ya"


def test_time_grows_with_the_length_only(finder):
    import time

    one = "Escribe a ana.lopez@example.org o llama al 612 345 678, DNI 12345678Z, vive en calle Mayor 12, 3º B. Me llamo Jimena Coruzabal. "
    text = one * 2000 + "Soy " * 100_000 + "@" * 100_000 + " " * 100_000 + "a" * 200_000 + "@x.example"
    start = time.time()
    found = finder.spans(text)
    assert len(text) > 10**6 - 300_000 and len(found) >= 10_000 and time.time() - start < 15


def test_accounts_are_found_only_if_asked(spark):
    df = spark.createDataFrame([("t", 1, "f", "ES9121000418450200051332 612345678")], "tbl string, row_id bigint, field string, text string")
    assert {r.kind for r in P.find(df, [], []).collect()} == {"phone"}
    assert {r.kind for r in P.find(df, [], [], (*P.KINDS, "account")).collect()} == {"phone", "account"}
