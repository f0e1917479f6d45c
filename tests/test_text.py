import random
import re

from pyspark.sql import functions as F

from trazo.functions import text as X

SOUNDS = dict(p.split("→") for p in "queso→pueso noche→nose chico→siko acción→acsion pingüino→pinguino carro→karro hielo→ielo valla→baya vaya→baya guerra→guerra cielo→sielo whisky→misky leer→ler LLAMA→yama".split())
CASES = {"": "niÑo", "A": "Niño", "AB": "NIÑO", "Ab": "Niño", "aB": "niño", "McD": "niño", "O'Neil": "Niño", "A1": "NIÑO", "12": "niño", "Ñu": "Niño"}


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, w string")
    return [r[1] for r in df.select("i", f(F.col("w"))).orderBy("i").collect()]


def test_golden_sounds_and_cases(spark):
    assert column(spark, SOUNDS, X.phonetic_key) == list(SOUNDS.values())
    assert column(spark, CASES, lambda w: X.match_case(w, F.lit("niÑo"))) == list(CASES.values())


def plain_sound(w):
    w = w.lower().translate(str.maketrans("áéíóúü", "aeiouu"))
    for a, b in ("q", "p"), ("w", "m"), ("h", ""), ("v", "b"), *X.SOUND_RULES:
        w = w.replace(a, b)
    return re.sub(r"([^r])\1+", r"\1", w)


def test_agreement_with_python(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijlmnñopqrrstuvwxyzáéíóúüABCÑÓ'-.,¿!1  \t") for _ in range(rng.randrange(1, 12))) for _ in range(1500)]
    assert column(spark, words, X.phonetic_key) == [plain_sound(w) for w in words]
    assert column(spark, words, X.tokens) == [w.split() for w in words]
    assert column(spark, words, X.strip) == [w.strip() for w in words]
    tokens = [w for x in words for w in x.split()]
    affix = re.compile(r"^([^\w]*)(.*?)([^\w]*)$", re.S)
    for i, f in enumerate((X.prefix, X.core, X.suffix), 1):
        assert column(spark, tokens, f) == [affix.match(t).group(i) for t in tokens]
    title = lambda o, c: c if not o else c.upper() if o.isupper() and len(o) > 1 else c.capitalize() if o.istitle() else c.lower()
    assert column(spark, tokens, lambda w: X.match_case(w, F.lit("camIón"))) == [title(t, "camIón") for t in tokens]


def test_null_and_empty(spark):
    assert column(spark, [None, "", "   "], X.tokens) == [None, [], []]
    assert column(spark, [None, "TRUE", "y", "0", "", "Sí"], X.truthy) == [False, True, True, False, False, False]
    assert column(spark, [None], X.phonetic_key) == [None]
    assert X.WHITE.isascii()


def test_uniform_is_keyed(spark):
    df = spark.range(2000).select(X.uniform("s", F.col("id")).alias("u"), X.uniform("s", F.col("id")).alias("v"))
    rows = df.collect()
    assert all(r.u == r.v and 0 <= r.u < 1 for r in rows) and 0.45 < sum(r.u for r in rows) / 2000 < 0.55


def test_masked(spark):
    df = spark.createDataFrame([(["a", "b", "c"], 1)], "w array<string>, p int")
    assert df.select(X.masked(F.col("w"), F.col("p"))).first()[0] == "a [MASK] c"
