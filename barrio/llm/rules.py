"""Quality rules: counts of a text, and lines that too many documents of a host share.

A document fails the base rules if it has fewer than 50 words or if more than half of its words stand in
three-word windows found twice or more in it. Of the others, the method decides: lines are normalised
(blanks at their ends cut, lower case) and hashed, distinct documents are counted per host and line, lines
above both limits are removed, and a document is rejected as depleted if less than
`least_left` of the characters of its lines is left. `quality` only judges; `keep_good` returns the documents without those lines.

The host of a document is its `source`. Copies of a text within a host count as one document, so that
a group of copies does not look like boilerplate. A line counts against a document only
if more than `most_documents` distinct documents and more than `most_share` of the host's have it. The first limit is a parameter
for hosts of few documents, where a share of 1 in 100 would be one document: there no line counts.

Scale: the counts of a text are array expressions of its own row. Only hashes of lines are shuffled, once per
distinct (host, line, text); a very common line is counted by partial sums and its join is one that
the adaptive planner splits. Texts are never shuffled by `quality`.

Defined cases: a null text has no word and fails; an empty line is no line; a null source is a
host of its own; rows that repeat get the same verdict; an empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barrio.llm.common import BLANKS, content_key, let, packed, unpacked, words
from barrio.session import materialise

#: Fixed by the contract.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
WINDOW = 3

MOST_DOCUMENTS = 50
MOST_SHARE = 0.01
LEAST_LEFT = 0.2


def repeated_words(found: Column) -> Column:
    """Words in windows of three that occur twice or more among the words `found`, overlaps counted once.

    Windows are compared as whole strings. They are sorted with their places, so equal windows are
    neighbours; the places of those, in order, each cover up to three words not covered by the next.
    """
    places = F.sequence(F.lit(0), F.size(found) - WINDOW)
    windows = F.transform(
        places, lambda i: F.struct(
            F.xxhash64(found[i], found[i + 1], found[i + 2]).alias("h"),
            F.concat_ws(" ", found[i], found[i + 1], found[i + 2]).alias("w"), i.alias("i"),
        ),
    )

    def covered(ordered: Column) -> Column:
        same = lambda a, b: (ordered[a]["h"] == ordered[b]["h"]) & (ordered[a]["w"] == ordered[b]["w"])
        twice = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda j: ((j > 0) & same(F.greatest(j - 1, F.lit(0)), j))
            | ((j < F.size(ordered) - 1) & same(F.least(j + 1, F.size(ordered) - 1), j)),
        )
        at = F.array_sort(F.transform(twice, lambda j: ordered[j]["i"]))
        return let(at, lambda p: F.aggregate(
            F.sequence(F.lit(0), F.size(p) - 1), F.lit(0),
            lambda total, k: total + F.when(
                k < F.size(p) - 1, F.least(F.lit(WINDOW), p[F.least(k + 1, F.size(p) - 1)] - p[k]),
            ).otherwise(WINDOW),
        ))

    def any_twice(sorted_windows: Column) -> Column:
        return F.when(F.size(sorted_windows) > 0, covered(sorted_windows)).otherwise(0)

    hashes = F.transform(places, lambda i: F.xxhash64(found[i], found[i + 1], found[i + 2]))
    # Most texts repeat no window; a hash set of plain numbers tells that without a sort.
    repeats = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(found) <= WINDOW, 0).when(~repeats, 0).otherwise(let(F.array_sort(windows), any_twice))


def word_counts(text: Column) -> Column:
    """n_words and n_repeat_words of a text, as one struct."""
    return let(words(text), lambda found: F.struct(
        F.size(found).cast("bigint").alias("n_words"),
        F.coalesce(repeated_words(found), F.lit(0)).cast("bigint").alias("n_repeat_words"),
    ))


def failed(counts: Column) -> Column:
    """The base verdict from `word_counts`."""
    return let(counts, lambda c: (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > 50 * c["n_words"]))


def host_lines(docs: DataFrame) -> DataFrame:
    """Distinct (host, text, line hash) with the characters the line has in the text."""
    line = lambda x: F.trim(F.lower(x))
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), lambda x: x != "")
    exploded = docs.select(
        F.col("source").alias("host"), *content_key(F.col("text")),
        F.explode(F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("n")))).alias("line"),
    )
    return exploded.select("host", "content_a", "content_b", F.col("line.h").alias("line"), F.col("line.n").alias("n"))


def shared_lines(lines: DataFrame, docs: DataFrame, most_documents: int, most_share: float) -> DataFrame:
    """(host, line) in more than `most_documents` and `most_share` of the distinct documents of the host."""
    pages = docs.groupBy(F.col("source").alias("p_host"), *content_key(F.col("text"))).agg(F.lit(1).alias("one"))
    totals = pages.groupBy("p_host").agg(F.count("*").alias("pages"))
    once = lines.groupBy("host", "line", "content_a", "content_b").agg(F.lit(1).alias("one"))
    counted = once.groupBy("host", "line").agg(F.count("*").alias("with_line")).where(F.col("with_line") > most_documents)
    return counted.join(totals, F.col("host").eqNullSafe(F.col("p_host"))).where(
        F.col("with_line") > most_share * F.col("pages"),
    ).select(F.col("host").alias("s_host"), F.col("line").alias("s_line"))


def judged_lines(docs: DataFrame, most_documents: int, most_share: float) -> tuple[DataFrame, DataFrame]:
    """The lines of `host_lines`, and those above the limits as a written table."""
    lines = host_lines(docs)
    # Read back, both sides of a join are shuffled for it, and the planner may split a very common line.
    return lines, materialise(shared_lines(lines, docs, most_documents, most_share), "rules-shared")


def depleted(docs: DataFrame, lines: DataFrame, shared: DataFrame, least_left: float = LEAST_LEFT) -> DataFrame:
    """(host, text) keys of the documents whose shared lines leave too little of them."""
    # Copies of a text within a host add up on both sides of the comparison.
    per_line = lines.groupBy("host", "content_a", "content_b", "line").agg(
        F.sum("n").alias("n"),
    )
    removed = per_line.join(shared, F.col("host").eqNullSafe(F.col("s_host")) & (F.col("line") == F.col("s_line")))
    gone = removed.groupBy("host", "content_a", "content_b").agg(F.sum("n").alias("gone"))
    copies = docs.groupBy(F.col("source").alias("host"), *content_key(F.col("text"))).agg(
        F.sum(F.length(F.translate(F.coalesce("text", F.lit("")), "\n", ""))).alias("total"),
    )
    both = gone.join(
        copies.select(*[F.col(c).alias(f"c_{c}") for c in copies.columns]),
        F.col("host").eqNullSafe(F.col("c_host")) & (F.col("content_a") == F.col("c_content_a"))
        & (F.col("content_b") == F.col("c_content_b")),
    )
    return both.where(F.col("c_total") - F.col("gone") < least_left * F.col("c_total")).select(
        F.col("host").alias("d_host"), F.col("content_a").alias("d_a"), F.col("content_b").alias("d_b"),
    )


def _is_depleted(df: DataFrame, bad: DataFrame) -> DataFrame:
    key = (
        F.col("source").eqNullSafe(F.col("d_host")) & (F.col("content_a") == F.col("d_a"))
        & (F.col("content_b") == F.col("d_b"))
    )
    return df.join(bad, key, "left")


def quality(
    docs: DataFrame, most_documents: int = MOST_DOCUMENTS, most_share: float = MOST_SHARE, least_left: float = LEAST_LEFT,
) -> DataFrame:
    """doc_id, the base counts, base_failed, depleted and kept, one row per document."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    counted = docs.select(
        "doc_id", "source", *content_key(F.col("text")), word_counts(F.col("text")).alias("counts"),
        F.length(F.translate(text, BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
    )
    bad = depleted(docs, *judged_lines(docs, most_documents, most_share), least_left)
    judged = _is_depleted(counted.withColumn("base_failed", failed(F.col("counts"))), bad)
    gone = F.col("d_a").isNotNull()
    return judged.select(
        "doc_id", "counts.n_words", "word_chars", "n_symbols", "n_dup_lines", "counts.n_repeat_words", "base_failed",
        gone.alias("depleted"), (~F.col("base_failed") & ~gone).alias("kept"),
    )


def keep_good(
    docs: DataFrame, most_documents: int = MOST_DOCUMENTS, most_share: float = MOST_SHARE, least_left: float = LEAST_LEFT,
) -> DataFrame:
    """The documents that `quality` keeps, without the lines above the limits; all columns as given.

    Per host these lines are at most 1 / `most_share` times the mean number of lines of its documents, so their hashes
    travel as one list a host.
    """
    lines, shared = judged_lines(docs, most_documents, most_share)
    sound = packed(docs).where(~failed(word_counts(F.col("text")))).select("row", "text", "source", *content_key(F.col("text")))
    kept = _is_depleted(sound, depleted(docs, lines, shared, least_left)).where(F.col("d_a").isNull())
    lists = materialise(shared.groupBy("s_host").agg(F.sort_array(F.collect_set("s_line")).alias("hashes")), "rules-lists")
    listed = kept.join(lists, F.col("source").eqNullSafe(F.col("s_host")), "left")
    drop = lambda x: (F.trim(x) != "") & F.array_contains("hashes", F.xxhash64(F.trim(F.lower(x))))
    clean = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~drop(x)), "\n")
    return unpacked(listed, docs.columns, F.when(F.col("hashes").isNull(), F.col("text")).otherwise(clean))
