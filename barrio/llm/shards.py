"""Shards by jump consistent hashing, with gapless slots.

A document's shard follows from its doc_id and the number of shards alone. When a shard is
appended, the rows that move all move into it. No ring table is kept.

The jump walks b -> floor((b + 1) / r) with r uniform in (0, 1], until it leaves the shard range. The
r are hashes of (doc_id, step), so that the walk for n + 1 shards is the walk for n and at most one step.

Slots: rows are cut into small blocks by another hash of doc_id, the blocks of a shard are counted and
laid one after the other, and rows are numbered within their block. No task sees a whole shard.

Defined cases: a null text has size 8 and checksum 0, as an empty one; all rows with a null doc_id go
to one shard by the law, as do rows that repeat an id, and get slots of their own; an
empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a block of consecutive slots has on average.
BLOCK_ROWS = 2_000


def jump_shards(key: Column, counts: tuple[int, ...]) -> Column:
    """An array with the shard of `key` for each number of shards, by one walk."""
    most = max(counts)
    start = F.struct(
        F.lit(0.0).alias("at"), *[F.lit(0).alias(f"b{i}") for i in range(len(counts))],
    )

    def step(state: Column, i: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, i), 33)
        jump = F.floor((state["at"] + 1) * (F.lit(float(1 << 31)) / (bits + 1).cast("double"))).cast("double")
        # The walk never comes back, so a place within the range is the last one seen there.
        return F.struct(
            F.when(state["at"] < most, jump).otherwise(state["at"]).alias("at"),
            *[
                F.when((state["at"] < most) & (jump < n), jump.cast("int")).otherwise(state[f"b{i}"]).alias(f"b{i}")
                for i, n in enumerate(counts)
            ],
        )

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(most)), start, step, lambda s: F.array(*[s[f"b{i}"] for i in range(len(counts))]),
    )


def shard(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard under one more shard."""
    key = F.col("doc_id")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    # Only the number of rows is asked for, which the file footers hold.
    blocks = max(1, docs.count() // (n_shards * BLOCK_ROWS))
    placed = rows.withColumn("shards", jump_shards(key, (n_shards, n_shards + 1))).select(
        "*", F.col("shards")[0].alias("shard"), F.col("shards")[1].alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit(-1), key, "text_crc32", "size"), F.lit(blocks)).alias("block"),
    )
    counted = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select(
        F.col("shard").alias("of_shard"), F.col("block").alias("of_block"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
    )
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("at", F.row_number().over(within) - 1)
    return numbered.join(
        offsets, (F.col("shard") == F.col("of_shard")) & (F.col("block") == F.col("of_block")),
    ).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("at") + F.col("offset")).cast("bigint").alias("slot"), "grown_shard",
    )
