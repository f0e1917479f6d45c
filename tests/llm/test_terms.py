import random

from pyspark.sql import functions as F

from trazo.llm import terms


def run(spark, rows, partitions=None):
    df = spark.createDataFrame(rows, "rec bigint, pos int, w string, t string").withColumn("value", F.lit("clash")).withColumn("field", F.lit("clash"))
    fields = {"w": terms.trimmed(F.col("w")), "t": terms.despaced(F.col("t"))}
    return {(r.field, r.value): (r.occurrences, r.records) for r in terms.frequencies(df, "rec", "pos", fields, partitions).collect()}


def brute(rows):
    out = {}
    for name, i in ("w", 2), ("t", 3):
        for r in rows:
            v = r[i]
            if v is None or r[0] is None:
                continue
            v = v.lower()
            if name == "w":
                while v and not v[0].isalnum():
                    v = v[1:]
                while v and not v[-1].isalnum():
                    v = v[:-1]
            else:
                v = v.strip(" ")
            if v:
                out.setdefault((name, v), ([], set()))
                out[name, v][0].append((r[0], r[1]))
                out[name, v][1].add(r[0])
    return {k: (len({x for x in o if x[1] is not None}) + sum(x[1] is None for x in o), len(s)) for k, (o, s) in out.items()}


def test_against_brute_force(spark):
    rng = random.Random(2)
    words = ["Casa", "casa!", "«CASA»", None, "", "...", "ñu", "le ", "x-y", "hot"]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, 0, 1, 2]), rng.choice(words), rng.choice(["A", " a", "hot", "hot", "hot", None, " "])) for _ in range(3000)]
    expected = brute(rows)
    for partitions in (None, 1, 13):
        assert run(spark, rows, partitions) == expected
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # runs go on over batches
    try:
        assert run(spark, rows, 3) == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_and_long(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, 0, "a" * 50000, None)]) == {("w", "a" * 50000): (1, 1)}


def test_marks(spark):
    rows = [(i, 0, "hot", f"t{i % 150}") for i in range(300)]
    df = spark.createDataFrame(rows, "rec bigint, pos int, w string, t string")
    counts = terms.frequencies(df, "rec", "pos", {"w": F.col("w"), "t": F.col("t")})
    marks = {(r.field, r.value): r.mark for r in terms.marked(counts, df.agg(F.count_distinct("rec"))).collect()}
    assert marks["w", "hot"] == "common" and marks["t", "t1"] == "rare"
    plan = terms.frequencies(df, "rec", "pos", {"w": F.col("w")})._jdf.queryExecution().toString()
    assert "rangepartitioning(field" in plan and "Cartesian" not in plan


def test_partitions_follow_the_size(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from trazo.llm import terms as T

    spark.range(2000).selectExpr("id AS r", "id % 3 AS p", "concat('w', id % 50) AS w").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plain = {tuple(r) for r in T.frequencies(df, "r", "p", {"w": F.col("w")}).collect()}
    monkeypatch.setattr(T, "SORT_BYTES", 100)
    many = T.frequencies(df, "r", "p", {"w": F.col("w")})
    assert "rangepartitioning" in many._jdf.queryExecution().executedPlan().toString() and {tuple(r) for r in many.collect()} == plain and len(plain) == 50
