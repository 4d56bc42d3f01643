"""Line dedup by site-relative frequency.

Lines are normalised (lower case, blanks at their ends cut) and hashed. For each host, the pages that contain
a line are divided by the host's pages; lines above `ratio`, in at least `least_pages` pages, are
dropped from every page of the host. The first occurrence goes as well: such a line is boilerplate.

The host of a document is its `source`. A page is a distinct text of the host, so that copies of a whole
page, which are for the duplicate operators, do not turn its lines into boilerplate.

Scale: a host has fewer than (distinct lines of its pages) / ratio boilerplate lines per page on average, a
number that does not grow with its pages, hence its list of hashes is one short row. The lists are
joined to the documents by host; the planner broadcasts them if they are small and splits hot hosts
otherwise. Lines are shuffled as hashes, counted by partial sums.

Defined cases: null stays null; a text whose lines all go becomes empty; blank lines stay; a null source is a
host of its own; rows that repeat are treated alike; an empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barrio.llm.common import content_key, packed, unpacked
from barrio.session import materialise

RATIO = 0.1
LEAST_PAGES = 10


def normal_line(line: Column) -> Column:
    return F.trim(F.lower(line))


def boilerplate(docs: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Per host the hashes of its boilerplate lines: b_host, hashes."""
    hashes = F.array_distinct(F.transform(
        F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != ""),
        lambda x: F.xxhash64(normal_line(x)),
    ))
    lines = docs.select(F.col("source").alias("host"), *content_key(F.col("text")), F.explode(hashes).alias("line"))
    page = ["host", "content_a", "content_b"]
    counted = (
        lines.groupBy(*page, "line").agg(F.lit(1).alias("one")).groupBy("host", "line")
        .agg(F.count("*").alias("with_line")).where(F.col("with_line") >= least_pages)
    )
    totals = (
        docs.select(F.col("source").alias("host"), *content_key(F.col("text"))).groupBy(*page)
        .agg(F.lit(1).alias("one")).groupBy(F.col("host").alias("p_host")).agg(F.count("*").alias("pages"))
    )
    above = counted.join(totals, F.col("host").eqNullSafe(F.col("p_host"))).where(
        F.col("with_line") > ratio * F.col("pages"),
    )
    return above.groupBy(F.col("host").alias("b_host")).agg(F.sort_array(F.collect_set("line")).alias("hashes"))


def dedup_lines(docs: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """All columns of the documents as `row`, the `doc_id`, the cleaned `text`, lines and dropped lines."""
    # Read back, the lists are shuffled for the join if they are not small, and the planner may split a hot host.
    lists = materialise(boilerplate(docs, ratio, least_pages), "line-lists")
    marked = packed(docs).join(
        lists, F.col("source").eqNullSafe(F.col("b_host")), "left",
    )
    drop = lambda x: (F.trim(x) != "") & F.array_contains("hashes", F.xxhash64(normal_line(x)))
    lines = marked.withColumn("lines", F.split("text", "\n"))
    kept = lines.withColumn(
        "kept", F.when(F.col("hashes").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~drop(x))),
    )
    return kept.select(
        "row", "doc_id", F.when(F.col("text").isNotNull(), F.array_join("kept", "\n")).alias("text"),
        F.when(F.col("text").isNotNull(), F.size("lines")).otherwise(0).cast("bigint").alias("n_lines"),
        F.when(F.col("text").isNotNull(), F.size("lines") - F.size("kept")).otherwise(0).cast("bigint").alias("n_dropped"),
    )


def drop_lines(docs: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """The documents with their boilerplate lines dropped; all columns as given."""
    return unpacked(dedup_lines(docs, ratio, least_pages), docs.columns, F.col("text"))
