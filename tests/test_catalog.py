from trazo.plans import catalog

LEX = [(i, t, 1000 - i) for i, t in enumerate("la casa tiene una biblioteca muy grande".split())]


def test_noise_pairs_of_every_sentence(spark, tmp_path):
    texts = [(f"La casa {i} tiene una biblioteca.", "es") for i in range(15_010)] + [("¿Tiene la casa una biblioteca?", "es")]
    spark.createDataFrame(texts, "text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog.noise_pairs(spark, str(tmp_path)).count() == 15_011
    assert catalog.sentence_pool(spark, str(tmp_path)).count() == 15_000


def test_evaluate_measures_the_fuzzy_layer(spark, tmp_path):
    spark.createDataFrame(LEX, "rank int, term string, freq bigint").write.parquet(f"{tmp_path}/lexicon.parquet")
    spark.createDataFrame([("La casa tiene una biblioteca muy grande.", "es")], "text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "history_id bigint, user_id string, seq bigint, erronea string, corregida string").write.parquet(f"{tmp_path}/user_history.parquet")
    fb = [(1, "u", "la casa tiene una bibloteca", "la casa tiene una biblioteca", True)]
    spark.createDataFrame(fb, "feedback_id bigint, user_id string, original_text string, corrected_text string, accepted boolean").write.parquet(f"{tmp_path}/feedback.parquet")
    assert catalog.evaluate(spark, str(tmp_path)).first()[0] == 0
    assert catalog.evaluate_shallow(spark, str(tmp_path)).first()[0] > 0


def test_jobs(spark, tmp_path):
    import pytest

    from trazo.plans import jobs

    sf = str(tmp_path)
    spark.createDataFrame([("La casa tiene una biblioteca muy grande.", "es"), ("short", "es"), (None, "es")], "text string, lang string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, "u", i, f"bio {i}", f"vio {i}") for i in range(5)] + [(9, "v", 1, "a", "b")], "history_id bigint, user_id string, seq bigint, erronea string, corregida string").write.parquet(f"{sf}/user_history.parquet")
    for job, n in ("pairs", 1), ("user-pairs", 5):
        jobs.main([job, "--sf_dir", sf, "--out", f"{sf}/{job}", "--user_id", "u"])
        assert spark.read.option("header", True).csv(f"{sf}/{job}").count() == n
    jobs.main(["tokens", "--sf_dir", sf, "--out", f"{sf}/tokens"])
    assert spark.read.parquet(f"{sf}/tokens").count() == 1
    with pytest.raises(ValueError):
        jobs.main(["user-pairs", "--sf_dir", sf, "--out", f"{sf}/x", "--user_id", "v"])  # fewer than five
    spark.createDataFrame([], "text string, lang string").write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    with pytest.raises(ValueError):
        jobs.main(["pairs", "--sf_dir", sf, "--out", f"{sf}/x"])  # nothing to train on
