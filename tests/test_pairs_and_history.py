import re

import pytest
from pyspark.sql import functions as F

from trazo.operators import errors, metrics, noise
from trazo.sources import history as H
from trazo.sources import tables as T

TYPES = """dola bola 0|qan pan 0|baca vaca 1|zapo sapo 1|casa caza 3|piso peso 2|arbol árbol 3|teh the 3|yama llama 3|m w 3|c z 3"""


def test_error_types(spark):
    rows = [r.split() for r in TYPES.split("|")]
    names = [errors.VISUAL, errors.PHONOLOGICAL, errors.VOWELS, errors.OTHER]
    # s and z sound alike in both orders
    gold = [names[int(k)] if (a, b) != ("casa", "caza") else errors.PHONOLOGICAL for a, b, k in rows]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, a string, b string")
    assert [r[1] for r in df.select("i", errors.classify(F.col("a"), F.col("b"))).orderBy("i").collect()] == gold


def test_details_zip_truncates(spark):
    df = spark.createDataFrame([(1, "La baca, come mas", "la vaca, come"), (2, None, "x"), (3, "", ""), (4, "a", "a")], "id int, original string, corrected string").withColumn("pos", F.lit("clash")).withColumn("type", F.lit("clash"))
    assert [tuple(r)[:4] for r in errors.details(df, "id", "original", "corrected").collect()] == [(1, 1, "baca,", "vaca,")]
    sizes = [r[0] for r in df.orderBy("id").select(F.size(errors.details_column(F.col("original"), F.col("corrected")))).collect()]
    assert sizes == [1, 0, 0, 0]


def test_user_vocabulary(spark):
    rows = [("u", 1, "kiero pan", "quiero pan"), ("u", 2, "kiero", "Quiero!"), ("u", 3, "kiero", "creo"), ("u", 4, "a b", "a"), ("u", 5, "¡ola!", "..."), ("v", 1, None, "x"), (None, 1, "qe", "que"), ("u", 3, "kiero", "creo")]
    df = spark.createDataFrame(rows, "user_id string, seq bigint, erronea string, corregida string")
    got = {(r.user_id, r.wrong): r.right for r in H.user_vocabulary(df).collect()}
    assert got == {("u", "kiero"): "creo", ("u", "ola"): "", (None, "qe"): "que"}
    assert H.eligible_users(df).collect()[0].user_id == "u"


def test_store_keeps_odd_ids_and_words(spark, tmp_path):
    store = H.HistoryStore(spark, str(tmp_path / "h"))
    assert store.user_pairs("x").count() == 0
    fb = spark.createDataFrame([("../x", 1, "NULL", "Na", True), ("../x", 2, "a", "", True), ("y", 3, "b", "c", False), ("y", 4, "b", "c", None)], "user_id string, seq bigint, original string, corrected string, accepted boolean")
    store.save_feedback(fb)
    store.save_feedback(fb.where("seq = 1").withColumn("seq", F.lit(9).cast("long")))
    assert [tuple(r) for r in store.user_pairs("../x").orderBy("seq").collect()] == [("null", "na", 1), ("null", "na", 9)]
    assert {r.seq: r.status for r in H.status(fb).collect()} == {1: "saved", 2: "ignored", 3: "ignored", 4: "ignored"}
    assert "PartitionFilters: [isnotnull(user_id" in store.user_pairs("y")._jdf.queryExecution().toString()


def test_store_files_do_not_grow_with_users(spark, tmp_path):
    store = H.HistoryStore(spark, str(tmp_path / "h"))
    ids = [f"u{i}" for i in range(300)] + ["007", "7", "U1", "a/b=c", "x" * 300]
    rows = [(u, i, "A", "B", True) for i, u in enumerate([*ids, "", None])] + [("u0", i, "C", "D", True) for i in range(1000, 1200)]
    store.save_feedback(spark.createDataFrame(rows, "user_id string, seq bigint, original string, corrected string, accepted boolean").repartition(8))
    folders = [p for p in (tmp_path / "h").iterdir() if p.is_dir()]
    assert len(folders) <= H.STORE_BUCKETS and len(list((tmp_path / "h").rglob("*.parquet"))) <= H.STORE_BUCKETS * H.STORE_FILES
    assert sorted((str(r.user_id), r.seq, r.erronea, r.corregida) for r in store.all_pairs().collect()) == sorted((str(u), i, a.lower(), b.lower()) for u, i, a, b, _ in rows)
    assert store.all_pairs().columns == ["seq", "erronea", "corregida", "user_id"] and store.all_pairs().where("user_id is null").count() == 1
    assert [store.user_pairs(u).count() for u in ("u0", "u1", "U1", "007", "a/b=c", "x" * 300, "", "none")] == [201, 1, 1, 1, 1, 1, 1, 0]
    assert [tuple(r) for r in store.user_vocabulary("u1").collect()] == [("u1", "a", "b")]
    store.all_pairs().where("seq < 2").write.partitionBy("user_id").parquet(str(tmp_path / "old"))  # the layout before
    for read in (H.HistoryStore.all_pairs, lambda s: s.user_pairs("u0"), lambda s: s.save_feedback(spark.createDataFrame(rows[:1], "user_id string, seq bigint, original string, corrected string, accepted boolean"))):
        with pytest.raises(ValueError):
            read(H.HistoryStore(spark, str(tmp_path / "old")))


def test_noise_is_reproducible_and_bounded(spark):
    pool = spark.createDataFrame([(f"la vaca número {i} come hierba en el huerto del abuelo" if i else "",) for i in range(120)] + [(None,)], "text string")
    a = {r.text: r.noisy for r in noise.inject(pool).collect()}
    b = {r.text: r.noisy for r in noise.inject(pool.repartition(7)).collect()}
    assert a == b
    changed = [sum(x != y for x, y in zip(t.split(), n.split())) for t, n in a.items() if t and len(t.split()) == len(n.split())]
    assert max(changed) <= 3 and sum(c > 0 for c in changed) > len(changed) / 2
    joined = [n for t, n in a.items() if len(n.split()) == len(t.split()) - 1]
    assert 0 < len(joined) < 45
    rows = noise.pairs(pool.where("text <> ''")).collect()
    assert all(r.erronea != r.corregida or not set("vsh") & set(r.corregida) for r in rows)


def test_sentences(spark):
    df = spark.createDataFrame([("Corta. Esta frase sí que entra. " + "x" * 81 + ". Esta frase sí que entra.",), (None,), ("",)], "text string")
    assert [r.text for r in noise.sentences(df).collect()] == ["Esta frase sí que entra."]
    assert noise.sentences(df, 0).count() in (0, 1)


def test_metrics(spark):
    rows = [("baca lola", "vaca lola", "vaca Lola"), ("x", "x", "x"), (None, "a", "b")]
    df = spark.createDataFrame(rows, "source string, prediction string, reference string")
    r = metrics.evaluate(df).first()
    assert (r.wer, r.cer, r.improvement_ratio) == (round(1 / 3, 6), 0.1, 0.5)
    assert tuple(metrics.evaluate(df.limit(0)).first()) == (None, None, 0.0)
    pairs = [("a b c", "a c d", 2), ("", "a b", 2), ("a", "", 1), ("", "", 0), ("kitten sat here", "sitting sat here now", 2)]
    words = spark.createDataFrame(pairs, "a string, b string, n int").selectExpr("filter(split(a, ' '), x -> x <> '') AS a", "filter(split(b, ' '), x -> x <> '') AS b", "n")
    assert all(r.n == r.d for r in words.select("n", metrics.word_distance(F.col("a"), F.col("b")).alias("d")).collect())


def test_bodies(spark):
    bodies = ['{"text":"hola","user_id":"u"}', '{"input":"x"}', '{"text":"","input":"x"}', "{}", "no json", None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string")
    got = [tuple(r) for r in df.select("i", T.parse_correct(F.col("b")).alias("r")).orderBy("i").select("r.text", "r.user_id", T.empty_text(F.col("r.text"))).collect()]
    err = '{"error":"Texto vacío"}'
    assert got == [("hola", "u", None), ("x", "default_user", None), ("", "default_user", err), ("", "default_user", err), ("", "default_user", err), ("", "default_user", err)]
    nulls = spark.createDataFrame([('{"text":null,"input":"x"}',), ('{"user_id":null,"input":"x"}',), ('{"text":7,"user_id":false}',), ('[1]',)], "b string").select(T.parse_correct(F.col("b")).alias("r"))
    assert [tuple(r.r) for r in nulls.collect()] == [(None, "default_user"), ("x", None), ("7", "false"), ("", "default_user")]
    spelled = spark.createDataFrame([('{"original":null,"user_id":null,"accepted":null}',)], "b string").select(T.parse_feedback(F.col("b")).alias("r")).first().r
    assert tuple(spelled) == (None, None, "", False)
    fb = spark.createDataFrame([('{"original":"a","corrected":"b","accepted":true}',), ('{"accepted":"Yes"}',), ("{}",)], "b string")
    assert [r.f.accepted for r in fb.select(T.parse_feedback(F.col("b")).alias("f")).collect()] == [True, True, False]


def test_files(spark, tmp_path):
    path = tmp_path / "f.txt"
    path.write_text("Que 10\n\nde 7\nque 3\n", encoding="utf8")
    assert [tuple(r) for r in T.read_frequency_file(spark, str(path)).orderBy("rank").collect()] == [(1, "que", 10), (2, "de", 7), (3, "que", 3)]
    pairs = spark.createDataFrame([("null", 'di "a", b'), ("x\ny", "na")], "erronea string, corregida string")
    T.write_pairs_csv(pairs, str(tmp_path / "csv"))
    assert {tuple(r) for r in T.read_pairs_csv(spark, str(tmp_path / "csv")).collect()} == {("null", 'di "a", b'), ("x\ny", "na")}


def test_stream_saves_once(spark, tmp_path):
    from trazo.streaming import feedback as S

    schema = "fb_req_id bigint, user_id string, original string, corrected string, accepted string, sent_at timestamp"
    rows = spark.sql("SELECT * FROM VALUES (1L,'u','A','B','yes',TIMESTAMP'2024-01-01 00:10:00'),(1L,'u','A','B','yes',TIMESTAMP'2024-01-01 00:10:00'),(2L,'u','A','B','no',TIMESTAMP'2024-01-01 00:20:00'),(3L,'v',NULL,'B','t',TIMESTAMP'2024-01-01 01:20:00') AS t(fb_req_id,user_id,original,corrected,accepted,sent_at)")
    rows.write.parquet(str(tmp_path / "in"))
    store = H.HistoryStore(spark, str(tmp_path / "out"))
    S.save_stream(S.deduplicated(S.feedback_stream(spark, str(tmp_path / "in"), schema)), store, str(tmp_path / "state")).awaitTermination()
    assert [tuple(r) for r in store.all_pairs().collect()] == [(1, "a", "b", "u")]
    hourly = S.hourly_acceptance(rows).orderBy("hour").collect()
    assert [(r.n, r.n_accepted) for r in hourly] == [(3, 2), (1, 1)]


def test_large_dimension_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(T, "MOST_DIMENSION_ROWS", 3)
    assert "broadcast" not in T.small(spark.range(10))._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" in T.small(spark.range(2))._jdf.queryExecution().logical().toString().lower()


@pytest.mark.parametrize("name", ["correct_layers", "tokens_split", "accent_index", "user_vocabulary", "error_details", "homophone_judge"])
def test_queries_agree_with_sql(spark, name):
    import os

    import duckdb

    from trazo.plans import catalog, oracle

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(sf):
        if re.search(r"\.parquet$", f):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    df = catalog.QUERIES[name](spark, sf)
    cur = con.execute(oracle.ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r[c] for c in cols)) for r in df.collect())


def test_numbers_over_stretches(spark):
    rows = [("u", i, f"e{i}", "c") for i in (5, 1, 9, 3, 7)] + [(None, 2, "x", "y"), (None, 1, "x", None)]
    df = spark.createDataFrame(rows, "user_id string, seq bigint, erronea string, corregida string")
    for bucket in (2, 1000):
        got = sorted((str(r.user_id), r.nth, r.erronea, r.corregida) for r in H.ordered_pairs(df, bucket).collect())
        assert got == [("None", 1, "x", None), ("None", 2, "x", "y")] + [("u", n, f"e{i}", "c") for n, i in enumerate((1, 3, 5, 7, 9), 1)]


def test_numbered_over_partitions(spark):
    from trazo.session import numbered

    df = spark.range(100).repartition(7).orderBy("id")
    assert [(r.id, r.n) for r in numbered(df, "n").orderBy("id").collect()] == [(i, i + 1) for i in range(100)]


def test_jobs(spark, tmp_path):
    from trazo.plans import jobs

    docs = spark.createDataFrame([("es ", "Una frase bastante larga para entrar."), ("en", "A sentence long enough to enter.")], "lang string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(i, "u", i, f"e{i}", f"c{i}") for i in range(5)] + [(9, "v", 1, "e", "c")]
    spark.createDataFrame(rows, "history_id bigint, user_id string, seq bigint, erronea string, corregida string").write.parquet(str(tmp_path / "user_history.parquet"))
    jobs.main(["pairs", "--sf_dir", str(tmp_path), "--out", str(tmp_path / "p")])
    assert [r.corregida for r in T.read_pairs_csv(spark, str(tmp_path / "p")).collect()] == ["Una frase bastante larga para entrar."]
    jobs.main(["user-pairs", "--sf_dir", str(tmp_path), "--out", str(tmp_path / "q"), "--user_id", "u"])
    assert T.read_pairs_csv(spark, str(tmp_path / "q")).count() == 5
    with pytest.raises(ValueError):
        jobs.user_pairs(spark, str(tmp_path), "v")


def test_only_small_inputs_are_spread(spark, monkeypatch):
    from trazo import session

    assert session.spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "CORE_BYTES", 1)
    assert session.spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == 1


def test_pairs_csv_keeps_blanks_and_line_breaks(spark, tmp_path):
    rows = [("\t", " a "), ("null", "x\ny"), ('say "hi", you', "\\"), (None, "")]
    T.write_pairs_csv(spark.createDataFrame(rows, "erronea string, corregida string"), str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in T.read_pairs_csv(spark, str(tmp_path / "csv")).collect()) == sorted((a or "", b) for a, b in rows)


def test_frequency_file_round_trip(spark, tmp_path):
    terms = spark.createDataFrame([(2, " De ", 5), (1, "que", 9), (3, "", 1), (4, None, 1), (5, "que", 2)], "rank int, term string, freq bigint")
    T.write_frequency_file(terms, str(tmp_path / "f"))
    assert [tuple(r) for r in T.read_frequency_file(spark, str(tmp_path / "f")).orderBy("rank").collect()] == [(1, "que", 9), (2, "de", 5), (3, "que", 2)]


def test_tokenised_pairs(spark):
    from trazo.operators import tokenised as K

    rows = [("el gato bio", "el gato vio"), ("", None), ("palabra " * 300, "corto")]
    got = K.texts(K.dataset(spark.createDataFrame(rows, "erronea string, corregida string").coalesce(1))).collect()
    assert all(len(r.input_ids) == len(r.attention_mask) == len(r.labels) == 128 for r in got)
    assert [r.text for r in got] == ["el gato vio", "", "corto"] and got[1].input_ids[:3] == [1, 2, 0] and sum(got[2].attention_mask) == 128
    assert got[0].labels.count(-100) == 128 - sum(1 for x in got[0].labels if x != -100) and K.decode(got[0].input_ids) == "el gato bio"
