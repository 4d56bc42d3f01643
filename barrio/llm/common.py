"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the contract: a word is a run of characters outside this class.
BLANK = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), BLANK + "+")
    return F.filter(parts, lambda w: w != "")


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body names it.

    A column expression named twice in a lambda is evaluated for each element; an element of a
    one-element array is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def content_key(text: Column) -> list[Column]:
    """96 hash bits that stand for a text within one source; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("content_a"), F.hash(text).alias("content_b")]


def packed(docs: DataFrame) -> DataFrame:
    """All columns in one struct `row` beside `doc_id`, `text` and `source`.

    Extra columns of the input, whatever their names, cannot clash with the operator's own.
    """
    return docs.select(F.struct("*").alias("row"), "doc_id", "text", "source")


def unpacked(df: DataFrame, names: list[str], text: Column | None = None) -> DataFrame:
    """The columns `names` of the struct `row`, with another text if one is given."""
    return df.select(*[
        text.alias(n) if text is not None and n == "text" else F.col("row").getField(n).alias(n) for n in names
    ])


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """The texts of an Arrow column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Record batches joined or cut so that each holds about `limit` bytes; a row is never cut."""
    held, size = [], 0
    for batch in batches:
        rows = max(1, int(batch.num_rows * limit / max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, rows):
            held.append(batch.slice(start, rows))
            size += held[-1].nbytes
            if size >= limit:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def read_bytes(path: str) -> bytes:
    """A vocabulary file of the driver; its size does not depend on the data."""
    with open(path, "rb") as f:
        return f.read()


class Numbering(dict):
    """Numbers strings in the order they are first asked for; `fresh` holds those not yet worked on."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        self.fresh.append(key)
        return number


class Store:
    """Ragged integer rows in one flat array."""

    def __init__(self, kind) -> None:
        self.flat, self.starts, self.counts = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def append(self, flat: np.ndarray, counts: np.ndarray) -> None:
        starts = len(self.flat) + np.cumsum(counts) - counts
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype)])
        self.starts, self.counts = np.concatenate([self.starts, starts]), np.concatenate([self.counts, counts])

    def rows(self, which: np.ndarray) -> np.ndarray:
        """The rows `which`, one after the other."""
        counts = self.counts[which]
        shift = np.repeat(self.starts[which] - (np.cumsum(counts) - counts), counts)
        return self.flat[shift + np.arange(len(shift))]
