"""Problem 6: filling fixed-capacity containers with items.

Method: variable-capacity best fit. All permitted capacities are optimised jointly: items go,
largest first, into the fullest open bin that still holds them; if none does, a bin of the
least-cost size is opened; at the end every bin is downsized to the smallest capacity that
holds its contents. With a single capacity this is best-fit decreasing.

Items, as they are after the splitting, are dealt to shards of a bounded number of items by a
hash of their id. A shard is optimised jointly over all capacities by one task, and shards are
spread over tasks by number, so the adaptive reader never puts them together again. Shards are
independent: each may waste what one partly filled bin of each size leaves.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items a task packs; a shard's memory and time are bounded by it.
SHARD_ITEMS = 8_000
#: Tasks that shards are spread over at most; beyond it a task packs several, one after another.
MOST_TASKS = 20_000


def pack(sizes: list[int], capacities: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, capacity of each bin, contents of each bin); every size is between 0 and the largest capacity."""
    caps = sorted(set(capacities))
    largest = caps[-1]
    where, filled = [0] * len(sizes), []
    # open bins by remaining room against the largest capacity; a bin's final size is chosen at the end
    room: list[list[int]] = [[] for _ in range(largest + 1)]
    keys: list[int] = []  # rooms that have bins, sorted
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    for i in order:
        s = sizes[i]
        k = bisect.bisect_left(keys, s)
        if k < len(keys):
            r = keys[k]
            b = room[r].pop()
            if not room[r]:
                keys.pop(k)
        else:
            b, r = len(filled), largest
            filled.append(0)
        where[i] = b
        filled[b] += s
        r -= s
        if not room[r]:
            bisect.insort(keys, r)
        room[r].append(b)
    return where, [caps[bisect.bisect_left(caps, f)] for f in filled], filled


def pack_jointly(sizes: list[int], capacities: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The packing with the least total capacity among those that open bins of one ladder of sizes.

    For every prefix of the capacities the items that fit its largest size are packed into
    bins of that size and the larger items into larger ones; the cheapest opening rule wins.
    """
    caps = sorted(set(capacities))
    best = None
    for top in caps:
        small = [i for i, s in enumerate(sizes) if s <= top]
        large = [i for i, s in enumerate(sizes) if s > top]
        where, size, filled = [0] * len(sizes), [], []
        if large:
            w, size, filled = pack([sizes[i] for i in large], caps)
            for i, b in zip(large, w):
                where[i] = b
            # small items first fill what the large bins leave, after those are downsized
            gaps = sorted((c - f, b) for b, (c, f) in enumerate(zip(size, filled)))
            left = []
            for i in sorted(small, key=lambda i: (-sizes[i], i)):
                k = bisect.bisect_left(gaps, (sizes[i], -1))
                if k == len(gaps):
                    left.append(i)
                    continue
                g, b = gaps.pop(k)
                where[i] = b
                filled[b] += sizes[i]
                bisect.insort(gaps, (g - sizes[i], b))
            small = left
        if small:
            w, size2, filled2 = pack([sizes[i] for i in small], [c for c in caps if c <= top])
            for i, b in zip(small, w):
                where[i] = b + len(size)
            size, filled = size + size2, filled + filled2
        cost = sum(size)
        if best is None or cost < best[0]:
            best = (cost, where, size, filled)
    return best[1:] if best else ([], [], [])


def items(sized: DataFrame, largest: int) -> DataFrame:
    """(id, part, size) from (id, size): an item above the largest capacity is split into pieces of it and a rest; others are part 0. Items of size 0 take no room and are left out."""
    pieces = F.sequence(F.lit(0), F.ceil(F.col("size") / F.lit(largest)).cast("int") - 1)
    split = sized.where("id is not null and size > 0").select("id", "size", F.explode(pieces).alias("part"))
    return split.select("id", "part", F.least(F.lit(largest).cast("long"), F.col("size") - F.col("part") * F.lit(largest)).alias("size"))


def assign(sized: DataFrame, capacities: list[int], n_items: int | None = None, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(id, part, size, bin, capacity, filled) for every item of (id bigint, size bigint), all capacities jointly.

    bin is a string, unique over all shards. n_items: how many items there are, which sets the
    number of shards; counted if it isn't given, so ``sized`` should be cheap to read then. An
    empty input gives no rows; ids are taken as unique.
    """
    caps = _valid(capacities)
    every = items(sized, caps[-1])
    return _packed(every, [caps], n_items if n_items is not None else every.count(), shard_items).drop("ladder")


def assign_each(sized: DataFrame, capacities: list[int], shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(capacity, bin, id, part, size, filled): every capacity by itself, one assignment of all items for each; bins are named anew for each capacity."""
    caps = _valid(capacities)
    ladder = F.posexplode(F.array(*[F.lit(c).cast("long") for c in caps]))
    pieces = F.sequence(F.lit(0), F.ceil(F.col("size") / F.col("largest")).cast("int") - 1)
    each = sized.where("id is not null and size > 0").select("id", "size", ladder.alias("ladder", "largest")).select("ladder", "id", "size", "largest", F.explode(pieces).alias("part"))
    each = each.select("ladder", "id", "part", F.least("largest", F.col("size") - F.col("part") * F.col("largest")).alias("size"))
    most = sized.agg(F.sum(F.ceil(F.col("size") / F.lit(caps[0])))).first()[0] or 0
    return _packed(each, [[c] for c in caps], int(most), shard_items).select("capacity", "bin", "id", "part", "size", "filled")


def _valid(capacities: list[int]) -> list[int]:
    caps = sorted({int(c) for c in capacities if c and c > 0})
    if not caps:
        raise ValueError("no capacity")
    return caps


def _packed(every: DataFrame, ladders: list[list[int]], n_items: int, shard_items: int) -> DataFrame:
    """The items (id, part, size, and ladder where there are several) packed into the sizes of their ladder, shard by shard."""
    shards = max(1, -(-n_items // shard_items))
    if "ladder" not in every.columns:
        every = every.withColumn("ladder", F.lit(0))
    dealt = every.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    dealt = dealt.repartition(min(shards * len(ladders), MOST_TASKS), "ladder", "shard")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id", "part"], ascending=[False, True, True], ignore_index=True)
        ladder, shard = int(pdf["ladder"].iloc[0]), int(pdf["shard"].iloc[0])
        where, size, filled = pack_jointly(pdf["size"].tolist(), ladders[ladder])
        return pd.DataFrame({
            "ladder": pdf["ladder"], "id": pdf["id"], "part": pdf["part"], "size": pdf["size"], "bin": [f"{shard}-{b}" for b in where],
            "capacity": [size[b] for b in where], "filled": [filled[b] for b in where],
        })

    return dealt.groupBy("ladder", "shard").applyInPandas(run, "ladder int, id long, part int, size long, bin string, capacity long, filled long")


def report(assigned: DataFrame) -> DataFrame:
    """(capacity, n_bins, n_items, room, used, unused_share) by capacity."""
    bins = assigned.groupBy("bin", "capacity").agg(F.sum("size").alias("used"), F.count("*").alias("n"))
    out = bins.groupBy("capacity").agg(F.count("*").alias("n_bins"), F.sum("n").alias("n_items"), F.sum("capacity").alias("room"), F.sum("used").alias("used"))
    return out.withColumn("unused_share", F.round(1 - F.col("used") / F.col("room"), 6))
