"""Sharding by longest processing time: groups that stay together, largest first.

Equal texts are a group. Groups sorted by size go to the least loaded shard, kept in a
heap. Groups of one size class are dealt together, so the heap works on the histogram of
sizes, whose number of classes is bounded, and not on the groups.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, functions as F

from .common import join_hot, ranked, stage

#: Sizes are told apart to one part in so many: at most 2 * PRECISION exact small classes and
#: PRECISION classes per power of two beyond, below 60,000 classes for all 63-bit sizes.
PRECISION = 1_024
ROW_BYTES = 8


def size_class(size: Column) -> Column:
    """Sizes below 2 * PRECISION themselves, larger ones cut to their leading bits."""
    bits = F.length(F.bin(size)) - len(bin(PRECISION)[2:])
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(bits, F.lit(0)))
    return size - size % step


def schedule(
    classes: list[tuple[int, int, int]], shards: int
) -> list[tuple[int, list[int], list[int]]]:
    """Longest processing time over (class, groups, total size) rows.

    For each class, largest first: which shards take how many of its groups, as
    (class, shards, groups before each of them). Each group of a class counts with the
    class's mean size. A class with many groups first fills all shards evenly as far as
    whole rounds go, then the heap takes the rest one by one.
    """
    loads = [(0.0, s) for s in range(shards)]
    heapq.heapify(loads)
    out = []
    for name, groups, total in sorted(classes, reverse=True):
        mean = total / groups
        given = [0] * shards
        left = groups
        if groups > 4 * shards:
            # What the heap would come to: all shards at one level, less a round of slack.
            level = _level([load for load, _ in loads], total - 2 * shards * mean)
            filled = []
            for load, shard in loads:
                given[shard] = max(0, int((level - load) / mean))
                left -= given[shard]
                filled.append((load + given[shard] * mean, shard))
            loads = filled
            heapq.heapify(loads)
        for _ in range(left):
            load, shard = loads[0]
            given[shard] += 1
            heapq.heapreplace(loads, (load + mean, shard))
        takers = [s for s in range(shards) if given[s]]
        before = [sum(given[:s]) for s in takers]
        out.append((name, takers, before))
    return out


def _level(loads: list[float], amount: float) -> float:
    """The common level after pouring ``amount`` on top of the lowest loads."""
    ordered = sorted(loads)
    below = 0.0
    for i, load in enumerate(ordered):
        if i and load * i - below >= amount:
            return (amount + below) / i
        below += load
    return (amount + below) / len(ordered)


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with its shard and slot; law ``bytes``.

    ``size`` is the UTF-8 bytes of the text plus ROW_BYTES. Rows with equal texts get the
    same shard; a null text counts as an empty one and goes with these. ``slot`` numbers a
    shard's rows from 0 without gaps. ``grown_shard`` is null under this law. Shards are as
    even as the groups allow: a group of a third of all bytes makes a shard of that size.
    Other columns are ignored; an empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage(docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"),
    ), "rows")
    groups = rows.groupBy("digest").agg(
        F.count("*").alias("copies"), F.sum("size").alias("bytes")
    ).withColumn("class", size_class(F.col("bytes")))
    groups = stage(ranked(groups, ["class"], ["digest"], "rank"), "groups")
    histogram = groups.groupBy("class").agg(
        F.count("*").alias("groups"), F.sum("bytes").alias("bytes"), F.sum("copies").alias("rows")
    ).collect()  # bounded by the number of classes
    spark = docs.sparkSession
    dealt = spark.createDataFrame(
        schedule([(r["class"], r["groups"], r["bytes"]) for r in histogram], shards),
        "class long, takers array<int>, before array<long>",
    )
    # The taker is the last one whose groups begin at or before this rank.
    turn = F.size(F.filter("before", lambda n: n <= F.col("rank")))
    home = groups.join(dealt, "class").select(
        "digest", "copies", F.element_at("takers", turn).alias("shard")
    )
    total = sum(r["rows"] for r in histogram)
    placed = join_hot(rows, stage(home, "home"), "digest", "copies", total)
    placed = placed.select("doc_id", "size", "text_crc32", "shard")
    return ranked(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"),
    )
