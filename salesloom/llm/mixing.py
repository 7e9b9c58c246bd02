"""Mixing sources to target weights along a time-varying curriculum, native throughout.

Every source has a weight that changes linearly over training time 0..1. Its integral is
the source's share of all tokens; the share is met by taking the source's documents in a
fixed random order, again from the start after the last. The inverse of the integral turns
a document's place in that order into a training position, and a range sort by position
gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stage

WEIGHTS = (1, 2, 3)
#: Change of a weight over time: it starts at 1 - tilt and ends at 1 + tilt times its mean.
TILTS = (-0.5, 0.0, 0.5)
#: A source is taken at most so many times.
CEILING = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, tilts=TILTS, ceiling: int = CEILING) -> DataFrame:
    """Add weight, tilt, ``target`` and ``quota`` (whole words) to rows (source, source_size).

    Sources in code point order, null last, weigh ``weights`` in turn. They share all
    words by weight; a source whose share is beyond ``ceiling`` times its size stops there
    and the others share the excess. Sources sorted by size per weight reach their ceiling
    in that order, so running sums find who does, without iteration.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(
        F.array(*[F.lit(v) for v in values]), (F.pmod(turn, F.lit(len(values))) + 1).cast("int")
    )
    exact = lambda x: F.col(x).cast("decimal(19,0)")
    everything = Window.partitionBy()
    rows = (
        sizes.withColumn("weight", pick(weights).cast("long"))
        .withColumn("tilt", pick(tilts).cast("double"))
        .withColumn("cap", F.col("source_size") * ceiling)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
    )
    earlier = Window.orderBy(
        F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()
    ).rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("gone", F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
        .withColumn("gone_weight", F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
        .withColumn("rest", F.col("total") - F.col("gone"))
        .withColumn("rest_weight", F.col("weights") - F.col("gone_weight"))
        .withColumn("full", exact("cap") * exact("rest_weight") <= exact("rest") * exact("weight"))
    )
    rows = (
        rows.withColumn("at_cap", F.coalesce(
            F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0)
        ))
        .withColumn("at_cap_weight", F.coalesce(
            F.sum(F.when(F.col("full"), F.col("weight"))).over(everything), F.lit(0)
        ))
    )
    open_weight = F.nullif(F.col("weights") - F.col("at_cap_weight"), F.lit(0))
    share = ((F.col("total") - F.col("at_cap")) * F.col("weight")).cast("double") / (
        open_weight.cast("double")
    )
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share)
    return rows.withColumn("target", target).withColumn(
        "quota", F.floor(F.col("target") + 0.5).cast("long")
    ).select("source", "source_size", "weight", "tilt", "target", "quota")


def training_time(share: Column, tilt: Column) -> Column:
    """The time at which a source has spent ``share`` of its tokens.

    The weight 1 + tilt (2t - 1) has the integral t + tilt (t^2 - t), whose inverse this is.
    """
    low = 1 - tilt
    root = F.sqrt(low * low + 4 * tilt * share)
    return F.when(low + root > 0, 2 * share / (low + root)).otherwise(F.lit(0.0))


def mix(
    docs: DataFrame, weights=WEIGHTS, tilts=TILTS, ceiling: int = CEILING,
    text_key: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source) with what the mix takes of it.

    ``size`` counts words (null text: 0); ``taken`` is ``copies`` full takes, or fewer words
    of the last take of the one document at which the source's quota ends; ``position`` is
    the training time of the first take, null if there is none. A source's taken words add
    up to its rounded target. Documents without words cost nothing and come along like
    their neighbours. The order inside a source is that of md5(doc_id), so reruns agree;
    rows with the same doc_id follow size and ``text_key`` (by default md5 of the text; another
    expression that tells rows apart may be given). Other columns are ignored.

    A source may hold most rows: it is dealt into buckets of that order (about sqrt(n) of
    them), whose sums are added up before rows are looked at inside each bucket.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = stage(docs.select(
        "doc_id", "source", word_count().alias("size"), key.alias("key"),
        (F.md5(F.coalesce(F.col("text"), F.lit(""))) if text_key is None else text_key).alias("text_key"),
    ), "sized")
    rows = sized.count()
    digits = 1
    while 256**digits < rows:
        digits += 1
    bucket = F.substring("key", 1, digits).alias("bucket")
    buckets = stage(sized.groupBy("source", bucket).agg(F.sum("size").alias("words")), "buckets")
    sources = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = targets(sources, weights, tilts, ceiling).withColumnRenamed("source", "s")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = buckets.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    starts = starts.join(plan, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), "start", "source_size",
        "tilt", "target", "quota",
    )
    inside = Window.partitionBy("source", "bucket").orderBy(
        "key", "doc_id", "size", "text_key"
    ).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.withColumn("bucket", bucket)
        .join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("times", F.when(
            F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))
        ).otherwise(F.lit(1)).cast("long"))
        .withColumn("rest", F.col("quota") - F.col("times") * F.col("source_size"))
    )
    share = F.when(F.col("quota") > 0, F.col("at").cast("double") / F.col("quota").cast("double"))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("at")))
    copies = F.col("times") + F.when(F.col("at") < F.col("rest"), 1).otherwise(0)
    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("times") * F.col("size") + last).alias("taken"),
        copies.cast("long").alias("copies"),
        F.when(copies > 0, training_time(F.coalesce(share, F.lit(0.0)), F.col("tilt")))
        .alias("position"), "text_key", "at", "quota", "tilt",
    )


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Range-sort by position; documents that are not taken come last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "source", "doc_id")


def takes(mixed: DataFrame) -> DataFrame:
    """A row per take, in training order: ``take`` 0, 1, ... of a document and its position."""
    each = mixed.where("copies > 0").withColumn(
        "take", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    )
    share = (F.col("take") * F.col("source_size") + F.col("at")).cast("double")
    quota = F.greatest(F.col("quota"), F.lit(1)).cast("double")
    return each.withColumn(
        "position", training_time(F.least(share / quota, F.lit(1.0)), F.col("tilt"))
    ).orderBy("position", "source", "doc_id", "take")
