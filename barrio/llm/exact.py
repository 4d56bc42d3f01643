"""Exact duplicates by Grace hash partitioning and open-addressing tables of whole contents.

Texts are equal when they are identical after lower-casing A-Z. The row with the largest doc_id
of a group of equal texts stays.

How it runs: each task first combines the copies it meets in a bounded table, so that a group of
copies, however large, sends at most a few records from each task. The records are then partitioned
by digest into shuffle files. Within a partition Spark's external sort orders them by digest, which
partitions them further, down to single digests, with spill files where memory is short. The
table takes as many of these sub-buckets as fit its limit and is emptied at a digest boundary, so its
memory is bounded and equal contents always meet in it.

Defined cases: null and empty texts are equal to each other; a null doc_id is a member but stays
only if its group has no other id; of rows that repeat both id and text one stays; very long
texts are handled whole; an empty input gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barrio.llm.common import utf8

#: Bytes of distinct contents that a table holds.
TABLE_BYTES = 16 << 20

PARTIAL = "digest binary, content binary, keep_id bigint, n bigint"
GROUP = "digest binary, keep_id bigint, group_size bigint"


class ContentTable:
    """Open addressing with linear probing; a hit needs equal hash bits and equal content."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots = [-1] * 1024
        self.digests: list[bytes] = []
        self.contents: list[bytes] = []
        self.keeps: list[int | None] = []
        self.counts: list[int] = []
        self.bytes = 0

    def add(self, digest: bytes, content: bytes, doc_id: int | None, n: int) -> None:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[8:16], "little") & mask
        while (entry := self.slots[at]) >= 0:
            if self.digests[entry] == digest and self.contents[entry] == content:
                self.counts[entry] += n
                kept = self.keeps[entry]
                if doc_id is not None and (kept is None or doc_id > kept):
                    self.keeps[entry] = doc_id
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.digests)
        self.digests.append(digest)
        self.contents.append(content)
        self.keeps.append(doc_id)
        self.counts.append(n)
        self.bytes += len(content) + 200
        if 2 * len(self.digests) > len(self.slots):
            self.grow()

    def grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, digest in enumerate(self.digests):
            at = int.from_bytes(digest[8:16], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [hashlib.sha256(t.lower()).digest() for t in utf8(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "digest"])


def _partials(table: ContentTable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(table.digests, pa.binary()), pa.array(table.contents, pa.binary()),
            pa.array(table.keeps, pa.int64()), pa.array(table.counts, pa.int64()),
        ],
        ["digest", "content", "keep_id", "n"],
    )


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The copies that one task meets as one record, before anything is shuffled."""
    table = ContentTable()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            content = text.lower()  # bytes.lower() changes A-Z only
            table.add(hashlib.sha256(content).digest(), content, doc_id, 1)
            if table.bytes > TABLE_BYTES:
                yield _partials(table)
                table.clear()
    yield _partials(table)


def _groups(table: ContentTable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(table.digests, pa.binary()), pa.array(table.keeps, pa.int64()), pa.array(table.counts, pa.int64())],
        ["digest", "keep_id", "group_size"],
    )


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of a partition whose records come in the order of their digests."""
    table, last = ContentTable(), None
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for digest, content, keep_id, n in zip(*columns):
            if digest != last and table.bytes > TABLE_BYTES:
                yield _groups(table)
                table.clear()
            last = digest
            table.add(digest, content, keep_id, n)
    yield _groups(table)


def content_groups(docs: DataFrame) -> DataFrame:
    """One row per distinct text: digest, largest doc_id, number of rows."""
    partials = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_combine, PARTIAL)
    return partials.repartition("digest").sortWithinPartitions("digest").mapInArrow(_bucket, GROUP)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    members = (
        docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_digests, "doc_id bigint, digest binary")
        .groupBy("doc_id", "digest").agg(F.count("*").alias("copies"))
    )
    joined = members.join(content_groups(docs), "digest")
    # Rows that repeat id and text are written out again; the first of them can stay.
    copy = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return copy.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
