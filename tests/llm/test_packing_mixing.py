import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trazo.llm import catalog
from trazo.llm import mixing as M
from trazo.llm import packing as P
from trazo.llm import tokens


@given(st.lists(st.integers(1, 100), max_size=60), st.sets(st.integers(100, 140), min_size=1, max_size=1), st.sets(st.integers(5, 99), max_size=3))
def test_packing_is_valid(sizes, top, more):
    caps = sorted(top | more)
    where, size, filled = P.pack_jointly(sizes, caps)
    assert len(where) == len(sizes)
    for b in range(len(size)):
        held = sum(s for s, w in zip(sizes, where) if w == b)
        assert held == filled[b] <= size[b] and size[b] == min(c for c in caps if c >= held)
    single = P.pack(sizes, caps)
    assert sum(size) <= sum(single[1])


def test_close_to_the_bound():
    rng = random.Random(6)
    sizes = [rng.randrange(1, 400) for _ in range(5000)]
    for caps in ([512], [128, 512, 1024]):
        _, size, _ = P.pack_jointly([min(s, caps[-1]) for s in sizes], caps)
        assert sum(sizes) / sum(size) > 0.995


def test_assign_splits_only_what_is_too_long(spark):
    rows = [(1, 10), (2, 4096), (3, 10000), (4, 0), (None, 5), (5, 1)]
    df = spark.createDataFrame(rows, "id bigint, size bigint").withColumn("bin", F.lit("clash"))
    got = P.assign(df, [128, 512, 4096], 6, shard_items=2).collect()
    assert sorted((r.id, r.part, r.size) for r in got) == [(1, 0, 10), (2, 0, 4096), (3, 0, 4096), (3, 1, 4096), (3, 2, 1808), (5, 0, 1)]
    for b in {r.bin for r in got}:
        held = [r for r in got if r.bin == b]
        assert sum(r.size for r in held) == held[0].filled <= held[0].capacity
    assert P.assign(df.limit(0), [128], 0).count() == 0
    with pytest.raises(ValueError):
        P.assign(df, [], 6)
    assert P.report(P.assign(df, [4096], 6)).first().used == 10 + 4096 + 10000 + 1


@given(st.dictionaries(st.sampled_from("abcdefg"), st.integers(1, 50), min_size=1))
def test_pfair_never_deviates_by_a_block(weights):
    k = M.slots({s: w for s, w in weights.items()}, 200)
    order, period = M.schedule(k), sum(k.values())
    assert len(order) == period == 200
    done = dict.fromkeys(k, 0)
    for t, s in enumerate(order, 1):
        done[s] += 1
        for x in k:
            assert abs(done[x] * period - k[x] * t) < period
    assert done == k


def test_mix(spark):
    rng = random.Random(8)
    docs = [(i, s, rng.randrange(1, 60)) for i, s in enumerate(rng.choices(["a", "b", "c", None], [5, 3, 1, 1], k=4000))] + [(9000, "a", 0)]
    sized = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint").withColumn("slot", F.lit("clash"))
    targets = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.3, 2), ("m", "c", 0.2, 3), ("m", "none", 0.1, 2), ("n", "c", 1.0, 2), ("z", "none", 1.0, 1), ("m", "a", 0.5, 1)], "mix string, source string, target_share double, max_repeats int")
    rows = M.mix(sized, targets, block_tokens=100).collect()
    assert max(r["pass"] for r in rows) <= 2 and len({(r.mix, r.doc_id, r["pass"]) for r in rows}) == len(rows)
    share = {(r.mix, r.source): r for r in M.shares(M.mix(sized, targets, block_tokens=100), targets).collect()}
    for s, w in ("a", 0.5), ("b", 0.3), ("c", 0.2):
        assert abs(share["m", s].actual_share - w) < 0.005
    assert share["m", "none"].actual_share == 0 and share["z", "none"].tokens == 0 and share["n", "c"].most_passes == 2
    # at any slot no source is far from its share: a block and a document at most
    total, got = 0, dict.fromkeys("abc", 0)
    for r in sorted((r for r in rows if r.mix == "m"), key=lambda r: r.slot):
        total += r.tokens
        got[r.source] += r.tokens
        if total > 2000:
            assert all(abs(got[s] - w * total) < 400 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    assert M.mix(sized.limit(0), targets).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hola, ¿qué tal?"), (2, None), (3, ""), (4, "palabra " * 20000)], "id int, text string")
    for vocabulary in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"):
        n = {r.id: r.n for r in df.select("id", tokens.n_tokens(F.col("text"), vocabulary=vocabulary).alias("n")).collect()}
        assert n[2] == n[3] == 0 and 4 <= n[1] < 15 and n[4] >= 20000


def test_small_shares_are_kept(spark):
    sized = spark.createDataFrame([(i, "a", 500) for i in range(4000)] + [(5000 + i, "b", 1) for i in range(900)], "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("m", "a", 0.9996, 1), ("m", "b", 0.0004, 1)], "mix string, source string, target_share double, max_repeats int")
    share = {r.source: r.actual_share for r in M.shares(M.mix(sized, targets, block_tokens=100), targets).collect()}
    assert abs(share["b"] - 0.0004) < 1e-5
    assert M.fitting({"a": 0.65, "b": 0.35}) == 1000 and M.slots({"a": 0.9996, "b": 0.0004}, M.fitting({"a": 0.9996, "b": 0.0004}))["b"] == 1
    with pytest.raises(ValueError):
        M.fitting({"a": 1.0, "b": 1e-7})
    with pytest.raises(ValueError):
        M.mix(sized, targets, period=1000)


def test_more_capacities_than_the_bound_are_refused(spark, tmp_path):
    spark.range(1, 10_003).selectExpr("id AS capacity_tokens").write.parquet(f"{tmp_path}/containers.parquet")
    with pytest.raises(ValueError):
        catalog._capacities(spark, str(tmp_path))


def test_no_source_is_a_block_from_its_share(spark):
    """After every slot, in tokens, with documents longer than the block that was asked for."""
    rng = random.Random(18)
    for n, longest, weights in ((5, 400, (0.3, 0.25, 0.2, 0.15, 0.1)), (2, 3000, (0.65, 0.35)), (4, 30, (0.97, 0.01, 0.01, 0.01)), (1, 50, (1.0,))):
        names = "abcdefgh"[:n]
        docs = [(i, rng.choice(names), max(1, int(longest * rng.random() ** 3))) for i in range(1500)]
        sized = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
        targets = spark.createDataFrame([("m", s, w, 3) for s, w in zip(names, weights)], "mix string, source string, target_share double, max_repeats int")
        rows = M.mix(sized, targets, block_tokens=100).collect()
        block, got, slots = rows[0].block, dict.fromkeys(names, 0), {}
        for r in rows:
            slots.setdefault(r.slot, []).append(r)
        ends = {s: max(r.slot for r in rows if r.source == s) for s in names}
        assert block >= 2 * max(r.tokens for r in rows) and all(k in slots for k in range(min(ends.values())))  # the last slots are partly filled
        for k in sorted(slots):
            for r in slots[k]:
                got[r.source] += r.tokens
            if k <= min(ends.values()):
                total = sum(got.values())
                assert all(abs(got[s] - w * total) < block and abs(got[s] - w * (k + 1) * block / 2) < block for s, w in zip(names, weights))


def test_each_capacity_in_one_plan(spark):
    rng = random.Random(19)
    sized = spark.createDataFrame([(i, rng.randrange(0, 300)) for i in range(500)] + [(None, 7)], "id bigint, size bigint")
    got = P.assign_each(sized, [128, 64, None, 0], shard_items=100).collect()
    for c in (64, 128):
        rows = [r for r in got if r.capacity == c]
        assert sum(r.size for r in rows) == sum(r["size"] for r in sized.where("id is not null").collect()) and max(r["size"] for r in rows) <= c
        for b in {r.bin for r in rows}:
            held = [r for r in rows if r.bin == b]
            assert sum(r.size for r in held) == held[0].filled <= c
        assert all(r["size"] == c for r in rows if any(x.id == r.id and x.part > r.part for x in rows))  # only what is longer is split
    assert P.assign_each(sized.limit(0), [64]).count() == 0


def test_shards_stay_apart(spark):
    sized = spark.range(3000).selectExpr("id", "1 + id % 50 AS size")
    got = P.assign(sized, [128], shard_items=500)
    assert got.rdd.getNumPartitions() == 6 and len({r.bin.split("-")[0] for r in got.collect()}) == 6
