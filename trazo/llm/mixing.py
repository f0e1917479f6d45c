"""Problem 7: mixing sources to target weights.

Method: Pfair scheduling. A source's tokens are cut into slots of half a block; slot j of a
source with weight w is released at floor(j / w) and due at ceil((j + 1) / w); earliest deadline
first fills the slots, so no source is ever a whole slot ahead of or behind its share. A
document belongs to the slot in which its middle lies and is never cut, which moves a source
by half a document at most. Half a block is chosen to hold the longest document and what all
sources' half documents can add up to; so after every slot each source is less than one block
of tokens from its share, and no slot is empty.
Weights are whole numbers of slots in a period, so the schedule repeats after a period: the
driver schedules one period, whose length is chosen from the weights, whatever the size of the data.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import ceil, lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trazo.session import durable

#: Slots of a period at least and at most; shares that need more are refused.
PERIOD, MOST_PERIOD = 1000, 100_000
#: Tokens of a block at least; a mix with long documents has larger ones.
BLOCK_TOKENS = 2048
#: Rows that one window orders for a running sum.
BUCKET_ROWS = 20_000
#: Mixes and sources are sent to every task; more rows than this are refused.
MOST_TARGETS = 10_000


def slots(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole slots in a period by source, of the given proportions; largest remainders get what is left. A weight of 0 or less gets none."""
    live = {k: Fraction(w).limit_denominator(10**9) for k, w in weights.items() if w and w > 0}
    total = sum(live.values())
    exact = {k: w * period / total for k, w in live.items()}
    out = {k: int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[: period - sum(out.values())]:
        out[k] += 1
    return {k: v for k, v in out.items() if v}


def fitting(weights: dict[str, float]) -> int:
    """A period that holds every positive weight exactly; if that is above the bound, one in which every one has ten slots, or at least one."""
    live = [Fraction(w).limit_denominator(10**9) for w in weights.values() if w and w > 0]
    total = sum(live)
    if 0 in live:
        raise ValueError("a share is too small")
    exact = lcm(*[(w / total).denominator for w in live])
    if exact <= MOST_PERIOD:
        return exact * -(-PERIOD // exact)
    least = ceil(total / min(live))
    if least > MOST_PERIOD:
        raise ValueError(f"a share is below 1/{MOST_PERIOD}")
    return min(MOST_PERIOD, max(PERIOD, 10 * least))


def schedule(weights: dict[str, int]) -> list[str]:
    """The source of each slot of one period, by earliest deadline first among released blocks."""
    period = sum(weights.values())
    done = dict.fromkeys(weights, 0)
    ready: list[tuple[int, str]] = []
    later = [(0, s) for s in weights]
    heapq.heapify(later)
    out = []
    for t in range(period):
        while later and later[0][0] <= t:
            s = heapq.heappop(later)[1]
            heapq.heappush(ready, (-(-(done[s] + 1) * period // weights[s]), s))
        s = heapq.heappop(ready)[1]
        out.append(s)
        done[s] += 1
        if done[s] < weights[s]:
            heapq.heappush(later, (done[s] * period // weights[s], s))
    return out


def half_block(longest: int, share: dict[str, int], block_tokens: int = BLOCK_TOKENS) -> int:
    """Tokens of a slot: half a block, the longest document, or half a document of each source weighed by the largest share, whichever is most."""
    total, n = sum(share.values()), len(share)
    others = -(-longest * (total + (n - 2) * max(share.values())) // (2 * total)) if n > 1 else 0
    return max(-(-block_tokens // 2), longest, others)


def mix(sized: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, period: int | None = None) -> DataFrame:
    """(mix, source, doc_id, pass, slot, tokens, block): every use of a document in every mix, in the order of slot; block is the mix's block in tokens.

    sized: (doc_id, source, tokens); a null source is in no mix, documents without tokens
    are left out. targets: (mix, source, target_share, max_repeats).
    A mix is as large as its scarcest source allows: source s may give max_repeats times its
    tokens. Each source gives its share of that size, in whole passes over its documents and
    a last pass over the first of them in an order fixed by a hash, up to the document that
    brings it nearest. A source without documents, share or repeats gives nothing, and the
    others share in proportion.
    """
    spark = sized.sparkSession
    want = targets.select("mix", "source", "target_share", "max_repeats").dropDuplicates(["mix", "source"]).limit(MOST_TARGETS + 1).collect()
    if len(want) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    used = sorted({r.source for r in want if r.source is not None})
    rows = durable(sized.where(F.col("source").isin(used) & (F.col("tokens") > 0)).select("doc_id", "source", "tokens"))
    have = {r.source: (r.tokens, r.n, r.longest) for r in rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.max("tokens").alias("longest")).collect()}
    plan, places = [], []
    for name in sorted({r.mix for r in want if r.mix is not None}):
        live = {r.source: r for r in want if r.mix == name and r.source in have and (r.target_share or 0) > 0 and (r.max_repeats or 0) > 0}
        if not live:
            continue
        weights = {s: r.target_share for s, r in live.items()}
        n_slots = period or fitting(weights)
        share = slots(weights, n_slots)
        if len(share) < len(live):
            raise ValueError(f"{name}: a share gets none of {n_slots} slots")
        size = min(live[s].max_repeats * have[s][0] * n_slots // k for s, k in share.items())
        half = half_block(max(have[s][2] for s in share), share, block_tokens)
        for s, k in share.items():
            plan.append((name, s, int(size * k // n_slots), have[s][0], live[s].max_repeats, k, n_slots, half))
        seen = dict.fromkeys(share, 0)
        for t, s in enumerate(schedule(share)):
            places.append((name, s, seen[s], t))
            seen[s] += 1
    plan_df = spark.createDataFrame(plan, "mix string, source string, need long, have long, max_repeats int, k int, period int, half long")
    places_df = spark.createDataFrame(places, "mix string, source string, nth int, place int")
    # running sums by source: a bounded number of rows in each bucket, then the buckets' offsets
    n_buckets = {s: max(1, -(-n // BUCKET_ROWS)) for s, (_, n, _) in have.items()}
    sizes = spark.createDataFrame(sorted(n_buckets.items()), "source string, n_buckets int") if n_buckets else spark.createDataFrame([], "source string, n_buckets int")
    keyed = rows.join(F.broadcast(sizes), "source").withColumn("key", F.xxhash64("doc_id", F.lit("order")))
    keyed = keyed.withColumn("bucket", F.pmod("key", F.col("n_buckets")).cast("int"))
    totals = keyed.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
    offsets = totals.select("source", "bucket", (F.sum("t").over(Window.partitionBy("source").orderBy("bucket")) - F.col("t")).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id")
    run = keyed.withColumn("before", F.sum("tokens").over(inside) - F.col("tokens")).join(offsets, ["source", "bucket"])
    run = run.select("doc_id", "source", "tokens", (F.col("offset") + F.col("before")).alias("start"))
    # pass r of a document begins at r * have + start; it is used if its middle lies within need
    uses = run.join(F.broadcast(plan_df), "source")
    uses = uses.where("start * 2 + tokens <= need * 2").withColumn("last", F.expr("CAST(least((need * 2 - tokens - start * 2) div (have * 2), max_repeats - 1) AS int)"))
    uses = uses.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("last"))))
    uses = uses.withColumn("block", F.expr("((pass * have + start) * 2 + tokens) div (half * 2)"))
    uses = uses.withColumn("nth", (F.col("block") % F.col("k")).cast("int"))
    placed = uses.join(F.broadcast(places_df), ["mix", "source", "nth"])
    slot = F.floor(F.col("block") / F.col("k")) * F.col("period") + F.col("place")
    return placed.select("mix", "source", "doc_id", "pass", slot.cast("long").alias("slot"), "tokens", (F.col("half") * 2).alias("block"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix, source, target_share, actual_share, tokens, uses, most_passes) for every target, those without documents too."""
    got = mixed.groupBy("mix", "source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("uses"), (F.max("pass") + 1).alias("most_passes"))
    all_ = targets.select("mix", "source", "target_share").dropDuplicates(["mix", "source"]).join(got, ["mix", "source"], "left")
    total = F.sum("tokens").over(Window.partitionBy("mix"))
    return all_.select(
        "mix", "source", "target_share", F.round(F.coalesce(F.col("tokens") / total, F.lit(0.0)), 6).alias("actual_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("most_passes", F.lit(0)).alias("most_passes"),
    )
