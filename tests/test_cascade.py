import pytest
from pyspark.sql import functions as F

from trazo.operators import cascade, fuzzy, indexes

LEX = "de 1000, que 900, no 800, la 700, una 500, como 400, casa 300, niños 250, vamos 240, haya 230, donde 220, hacia 215, vaca 200, noche 190, quiero 180, canción 170, papel 160, cancion 20, dedo 15, árbol 12, arbol 3, perro 10"
GOLD = """¿Bamos! H1 ¿Vamos!
OY H1 HOY
Be H1 De
qaqel H2 papel
BEDO H2 DEDO
kiero H3 quiero
Qe H3 Que
asia H4 asia
A H4 A
Y H5 Y
mI H5 mI
casa H6 casa
CASA H6 CASA
cancion H6 canción
Arbol H6 Arbol
baca H7 vaca
noze H7 noche
ninnos H8 niños
teh H8 de
perrro H8 perro
uan H8 una
noxe H8 no
mCasa H8 casa
123 H8 de
casa-casa H8 casa-casa
zzzzzzzzz H8 zzzzzzzzz
¡¡ H0 ¡¡"""


@pytest.fixture(scope="module")
def lex(spark):
    rows = [(i, *x.rsplit(" ", 1)) for i, x in enumerate(LEX.split(", "), 1)]
    return indexes.lexicon(spark.createDataFrame([(i, t, int(n)) for i, t, n in rows], "rank int, term string, freq bigint")).cache()


@pytest.fixture(scope="module")
def vocabulary(spark):
    return spark.createDataFrame([("u", "kiero", "quiero"), ("u", "qe", "que"), ("u", "bamos", "bambú"), ("v", "casa", "")], "user_id string, wrong string, right string")


def test_golden_rows(spark, lex, vocabulary):
    gold = [g.split() for g in GOLD.split("\n")]
    req = spark.createDataFrame([(1, "u", " ".join(g[0] for g in gold)), (2, "v", "La casa."), (3, "u", None), (4, None, "  "), (5, None, "baca")], "req_id bigint, user_id string, text string")
    rows = cascade.layers(cascade.explode(req), lex, vocabulary).where("req_id = 1").orderBy("pos").collect()
    assert [(r.prefix + r.core + r.suffix, r.layer, r.prefix + r.best + r.suffix) for r in rows] == [tuple(g) for g in gold]
    out = {r.req_id: r.corrected for r in cascade.correct(req, lex, vocabulary).collect()}
    assert out == {1: " ".join(g[2] for g in gold), 2: "La .", 3: "", 4: "", 5: "vaca"}


def test_numbers_can_be_protected(spark, lex, vocabulary):
    req = spark.createDataFrame([(1, "u", "123 teh")], "req_id bigint, user_id string, text string")
    assert cascade.correct(req, lex, vocabulary, protect_numeric=True).first().corrected == "123 de"


def test_bigram_judge(spark):
    big = cascade.bigrams(spark.createDataFrame([("Lo tuvo ayer. lo tuvo",), ("el tubo roto",), (None,)], "text string"))
    rows = spark.createDataFrame([(1, "lo", "ayer", ["tubo", "tuvo"]), (2, "el", "roto", ["tubo", "tuvo"]), (3, "x", "y", ["tubo", "tuvo"]), (4, "", "", ["uno"])], "id int, left string, right string, cands array<string>")
    assert {r.id: r.chosen for r in cascade.bigram_judge(big)(rows).collect()} == {1: "tuvo", 2: "tubo", 3: "tubo", 4: "uno"}


def test_lexicon_rules(spark):
    raw = spark.createDataFrame([(1, "Que", 5), (2, "que", 9), (3, None, 1), (4, " ", 1), (5, "él", 3)], "rank int, term string, freq bigint")
    assert {tuple(r) for r in indexes.lexicon(raw).collect()} == {("que", 1, 9), ("él", 5, 3)}


def brute(word, terms):
    if word in terms:
        return [(0, word)]
    for k in range(1, 4):
        hits = sorted((-n, t) for t, n in terms.items() if fuzzy.osa(word, t, 10) == k)
        if hits:
            return [(k, t) for _, t in hits[:3]]
    return []


def slow_osa(a, b):
    d = {(i, j): i + j if not i * j else 0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_fuzzy_against_brute_force(spark, lex):
    import random

    rng = random.Random(3)
    words = ["".join(rng.choice("acdeinoqrs") for _ in range(rng.randrange(0, 9))) for _ in range(150)] + ["ninnos", "perrro", "uan", "abc", "ca"]
    for a in words[:60]:
        for b in words[60:90]:
            assert min(fuzzy.osa(a, b, 3), 4) == min(slow_osa(a, b), 4)
    terms = {r.term: r.freq for r in lex.collect()}
    expected = {w: brute(w, terms) for w in words if brute(w, terms)}
    df = spark.createDataFrame([(w,) for w in words + [None, words[0]]], "word string")
    got = {r.word: [(s.distance, s.term) for s in r.suggestions] for r in fuzzy.closest(df, lex).collect()}
    keyed = {r.word: [(s.distance, s.term) for s in r.suggestions] for r in fuzzy.by_keys(df.where("word is not null").distinct(), lex).collect()}
    assert got == expected
    assert keyed == expected


def test_empty_tables(spark, lex):
    req = spark.createDataFrame([], "req_id bigint, user_id string, text string")
    voc = spark.createDataFrame([], "user_id string, wrong string, right string")
    assert cascade.correct(req, lex, voc).count() == 0
    none = indexes.lexicon(spark.createDataFrame([], "rank int, term string, freq bigint"))
    one = spark.createDataFrame([(1, "u", "hola be")], "req_id bigint, user_id string, text string")
    assert cascade.correct(one, none, voc).first().corrected == "hola de"
    assert indexes.phonetic_index(none).count() == 0 == indexes.accent_index(none).count()


def test_restore_accent_recases(spark):
    lex = indexes.lexicon(spark.createDataFrame([(1, "canción", 100), (2, "cancion", 2)], "rank int, term string, freq bigint"))
    words = spark.createDataFrame([("Cancion",), ("McDonald",), (None,)], "word string")
    got = [r.restored for r in indexes.restore_accent(words, indexes.accent_index(lex)).orderBy(F.col("word").desc_nulls_last()).collect()]
    assert got == ["mcdonald", "Canción", None]
