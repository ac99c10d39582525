"""Mixing sources to target weights, with DataFrame operations only.

Sizes (words) are aggregated per source; the sum of all sizes is shared out by
weight, a target stops at `max_repeats` times its source's size and the excess
is shared again by weight among the rest. A document is then taken
floor(rate) times, rate = target / source size, and once more with probability
equal to the fraction, by a draw that hashes doc_id and the seed: reruns agree.

Defined cases: a null text has size 0; documents of size 0 are taken at the
rate of their source too; a null source is a source of its own, last in order;
sources whose sizes are all 0 have target and rate 0; rows that share a doc_id
share its draw, a null doc_id draws as the word "null". Other columns pass
through `mix`. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Sources up to which their targets are sent to the documents (about 100 bytes each); beyond it both are shuffled.
BROADCAST_SOURCES = 1 << 17

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Weights repeat over the sources by code point, null last. The windows run over
    one row per source, after the aggregation. With sources in ascending order
    of cap / weight, those that stop at their cap are a prefix of that order:
    the first k stop, for the least k whose level (what is left over the weight
    that is left) does not lift the next source above its cap.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    nth = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), nth.cast("int")).cast("long"))
    weighed = weighed.withColumn("cap", F.col("source_size") * max_repeats)
    # cap / weight is compared exactly, over the common multiple of the weights.
    multiple = 1
    for w in weights:
        multiple *= w
    ratio = (F.col("cap") * multiple / F.col("weight")).cast("long")
    whole = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    steps = weighed.withColumn("ratio", ratio).select(
        "*",
        F.sum("source_size").over(whole).alias("total"),
        F.sum("weight").over(whole).alias("weights"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("capped"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("capped_weight"),
    )
    # This source and all later ones stay at or below their caps at this level.
    level_left, level_weight = F.col("total") - F.col("capped"), F.col("weights") - F.col("capped_weight")
    free = level_left * F.lit(multiple) <= F.col("ratio") * level_weight
    steps = steps.withColumn("free", free).withColumn("level", F.when(F.col("free"), F.struct("ratio", F.col("source").isNull().alias("last"), F.col("source").alias("name"), level_left.alias("left"), level_weight.alias("over"))))
    steps = steps.withColumn("first", F.min("level").over(whole))
    above = F.col("first").isNotNull() & (F.col("ratio") >= F.col("first.ratio")) & F.col("free")
    shared = F.col("first.left").cast("double") * F.col("weight").cast("double") / F.col("first.over").cast("double")
    target = F.when(above, F.least(shared, F.col("cap").cast("double"))).otherwise(F.col("cap").cast("double"))
    return steps.select("source", "source_size", target.alias("target"))


def draw(seed: int, doc_id: str = "doc_id") -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 over seed and doc_id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(rate: Column, seed: int, doc_id: str = "doc_id") -> Column:
    return (F.floor(rate) + (draw(seed, doc_id) < rate - F.floor(rate)).cast("long")).cast("long")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target and n_copies beside its other columns; `mix` keeps columns of docs that have these names."""
    sized = docs.withColumn("size", size_of())
    targets = source_targets(docs.select("source", size_of().alias("size")), weights, max_repeats)
    targets = materialize(targets.withColumnRenamed("source", "_source"), "mix-targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = sized.join(targets, sized["source"].eqNullSafe(targets["_source"])).drop("_source")
    return joined.withColumn("n_copies", copies(rate, seed))


def mix_digest(docs: DataFrame, **options) -> DataFrame:
    plan = mix_plan(docs.select("doc_id", "source", "text"), **options)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken, in docs' own columns."""
    keep = [f"_{i}" for i in range(len(docs.columns))]
    renamed = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, keep)), "doc_id", "source", "text")
    plan = mix_plan(renamed, **options).where("n_copies > 0")
    repeated = plan.select(*keep, F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("_copy"))
    return repeated.select(*(F.col(k).alias(c) for k, c in zip(keep, docs.columns)))
