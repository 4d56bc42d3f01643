"""Mixing sources to target weights by hash-threshold histograms.

A document's size is its number of words. Sources in code-point order, null last, weigh 3, 1, 2,
repeating, and share 150 % of all sizes. A target stops at twice the size of its source; the excess goes
to the others by weight. In closed form every target is min(2 * size, level * weight) with one level.

A source takes whole passes over its documents and then, for the rest of its target, those whose hash is
below a threshold. The threshold is found without sorting: sizes are summed by source and hash
bucket, the bucket in which the budget ends is the boundary, and only documents in boundary
buckets are summed again by the next bits of the hash, until all 60 bits are used. Hence a source takes the
largest prefix in hash order that does not exceed the target.

Hashes are of doc_id alone, so reruns agree. Defined cases: null texts have size 0; null doc_ids and
repeated ids share a hash and are taken together; a source without words has target 0; an
empty input gives an empty result. Other columns are carried along by `mix`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barrio.llm.common import words
from barrio.session import materialise

#: Fixed by the contract.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2

#: Bits of the hash per histogram, and histograms.
BITS, LEVELS = 15, 4


def hash60(key: Column, text: Column) -> Column:
    """60 hash bits of an id and a text, so that rows of one id are told apart; null counts as the empty string."""
    both = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    digits = F.substring(F.md5(both), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: one row per source of (source, source_size).

    The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), place + 1))
    rank = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = rank.rowsBetween(Window.unboundedPreceding, -1), rank.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(1))
    # If the sources before this one in rank stop at their limit, the others share the rest by weight. Too few at their
    # limit give a level that does not fit, too many a lower one than the right one.
    level = weighed.withColumn(
        "level",
        (F.sum("source_size").over(everything) * SHARE - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        / F.sum("weight").over(after),
    )
    fits = F.when(F.col("level") * F.col("weight") <= MOST * F.col("source_size"), F.col("level"))
    return level.withColumn("level", F.max(fits).over(everything)).select(
        "source", "source_size",
        F.least((MOST * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")).alias("target"),
    )


def _boundary(items: DataFrame, bounds: DataFrame, level: int) -> DataFrame:
    """Bounds refined by the next bits: the bucket in which the budget of a source ends."""
    shift = BITS * (LEVELS - 1 - level)
    inside = items.join(
        bounds.select(F.col("source").alias("b_source"), "prefix", "left"), F.col("source").eqNullSafe(F.col("b_source")),
    ).where(F.shiftright("h", shift + BITS) == F.col("prefix"))
    bucket = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(
        F.sum("size").alias("n"), F.first("left").alias("left"),
    )
    upto = Window.partitionBy("source").orderBy("bucket")
    summed = bucket.withColumn("upto", F.sum("n").over(upto))
    over = summed.where(F.col("upto") > F.col("left")).groupBy("source").agg(
        F.min(F.struct("bucket", (F.col("left") - (F.col("upto") - F.col("n"))).alias("left"))).alias("first"),
    )
    return over.select("source", F.col("first.bucket").alias("prefix"), F.col("first.left").alias("left"))


def thresholds(items: DataFrame) -> DataFrame:
    """Per source of (source, size, h): target, whole passes, and the hash below which one more copy is taken."""
    sizes = items.groupBy("source").agg(F.sum("size").alias("source_size"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    shares = materialise(targets(sizes).withColumn("passes", passes.cast("bigint")), "mix-targets")
    bounds = shares.select(
        "source", F.lit(0).cast("bigint").alias("prefix"),
        (F.col("target") - F.col("passes") * F.col("source_size")).alias("left"),
    )
    for level in range(LEVELS):
        bounds = materialise(_boundary(items, bounds, level), f"mix-bounds-{level}")
    return shares.join(
        bounds.select(F.col("source").alias("b_source"), F.col("prefix").alias("below")),
        F.col("source").eqNullSafe(F.col("b_source")), "left",
    ).select(
        F.col("source").alias("t_source"), "source_size", "target", "passes",
        F.coalesce("below", F.lit(1 << (BITS * LEVELS))).alias("below"),
    )


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("size"), hash60(F.col("doc_id"), F.col("text")).alias("h"),
    )


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words the mix takes, one row per document."""
    items = materialise(sized(docs), "mix-sizes")
    rules = thresholds(items)
    times = F.col("passes") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    return items.join(rules, F.col("source").eqNullSafe(F.col("t_source"))).select(
        "doc_id", "size", "source_size", "target", (times * F.col("size")).cast("bigint").alias("taken"),
    )


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken; columns as given.

    A text without words has no size, hence it is taken with its hash like any other.
    """
    rules = thresholds(materialise(sized(docs), "mix-sizes"))
    packed = docs.select(
        F.struct("*").alias("row"), F.col("source").alias("of"), hash60(F.col("doc_id"), F.col("text")).alias("h"),
    )
    times = F.col("passes") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    taken = packed.join(rules, F.col("of").eqNullSafe(F.col("t_source"))).select(
        "row", F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("copy"),
    )
    return taken.select(*[F.col("row").getField(n).alias(n) for n in docs.columns])
