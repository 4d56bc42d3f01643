"""Spelling variants by neighbourhoods over a reduced alphabet.

Words are counted over all documents. A hash sends each letter to one of a few symbols, so that a word becomes a reduced word, and
two words that differ by one edit have reduced words that differ by one edit or not at all. Every word sends out the full
neighbourhood of its reduced word: each deletion, each replacement (the reduced word itself among them) and each insertion. These
are joined with the reduced words of the vocabulary, and the candidates found are verified on the words themselves in the join.

With few symbols a neighbourhood is small, but many words share a reduced word. The number of symbols follows the seventh root of
the vocabulary's size, so that the words of a reduced word stay few however large the vocabulary is; the result does not depend
on it. Reduced words are joined by a polynomial hash of 64 bits, which costs one step per neighbour whatever the
word's length; words that only share the hash fail the verification.

A word longer than `LONG` is not sent along with each of its neighbours, only its number is; its candidates fetch the two
words afterwards.

The root of a word is found by doubling: each round replaces a word's goal by the goal's own. As a form is at least `DOMINANT` times as
frequent as its word, chains are no longer than the logarithm of the largest count.

Defined cases: a null text has no words; a null id counts as empty in the hash that decides on deletions; repeated rows count as often as they
stand there; words of equal frequency are never each other's form; an empty table gives an empty result; columns other than doc_id and text
are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barrio.llm.common import blocks, texts
from barrio.llm.minhash import mixed
from barrio.session import materialise

#: Fixed by the contract: runs of letters, the shortest word and least frequency, how often a letter is deleted, and how much more
#: frequent a form is.
LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LETTERS, LEAST_COUNT = 6, 5
DELETION = 199
DOMINANT = 5

#: Letters of a word up to which it is sent along.
LONG = 64
#: Base of the polynomial hash, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)

BLOCK_BYTES = 4 << 20
#: Distinct words that a task counts before it passes them on, and neighbours made at once.
WORDS = 200_000
NEIGHBOURS = 1 << 19

# A shorter run is no word, whether or not it loses a letter.
_RUN = re.compile(LETTERS + "{%d,}" % LEAST_LETTERS)


def words_of(doc_id: int | None, text: str) -> Counter:
    """The words of a text with their number, deletions made."""
    lowered: Counter = Counter()
    for run, n in Counter(_RUN.findall(text)).items():
        lowered[run.encode().lower()] += n  # bytes know only A-Z
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in lowered.items():
        word, h = run.decode(), zlib.crc32(run, seed)
        if h % DELETION == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
        if len(word) >= LEAST_LETTERS:
            out[word] += n
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def passed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"],
        )

    for block in blocks(batches, BLOCK_BYTES):
        for doc_id, text in zip(block.column(0).to_pylist(), texts(block.column(1))):
            total.update(words_of(doc_id, text))
        if len(total) > WORDS:
            yield passed()
            total.clear()
    yield passed()


def vocabulary(docs: DataFrame) -> DataFrame:
    """id, word, n of the words that are frequent enough; ids are numbers without gaps in a part only."""
    spark = docs.sparkSession
    parts = docs.select("doc_id", "text").mapInArrow(_counted, "word string, n bigint")
    # Dealt out by number, so that the few rows that grow into neighbourhoods are not put together in few tasks.
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word")
    counted = parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    return materialise(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words")


def alphabet(size: int) -> int:
    """The number of symbols for a vocabulary."""
    return max(4, math.ceil(size ** (1 / 7)))


def reduced(words: np.ndarray, symbols: int) -> np.ndarray:
    """Symbols 1, 2, … of letters, given as code points."""
    return mixed(words.astype(np.uint64)) % np.uint64(symbols) + np.uint64(1)


def keys(words: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each reduced word and of its neighbourhood; `words` holds the code points of words of one length, a row each."""
    s = reduced(words, symbols)
    length = s.shape[1]
    power = np.full(length + 1, BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    upto = np.concatenate([np.zeros((len(s), 1), np.uint64), np.cumsum(s * power[:length], axis=1, dtype=np.uint64)], axis=1)
    own = upto[:, -1:]
    letters = np.arange(1, symbols + 1, dtype=np.uint64)
    deleted = upto[:, :-1] + (own - upto[:, 1:]) * np.uint64(INVERSE)
    replaced = own[:, :, None] + (letters - s[:, :, None]) * power[:length, None]
    inserted = (upto + (own - upto) * np.uint64(BASE))[:, :, None] + letters * power[:, None]
    around = np.concatenate([deleted, replaced.reshape(len(s), -1), inserted.reshape(len(s), -1)], axis=1)
    return mixed(own[:, 0]), mixed(around)


def _by_length(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of words of one length, few enough to be worked on at once, with their code points."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        step = max(1, NEIGHBOURS // int(2 * (length + 1) * (symbols + 1)))
        for at in range(0, len(rows), step):
            part = rows[at:at + step]
            flat = np.frombuffer("".join([words[i] for i in part]).encode("utf-32-le"), np.uint32)
            yield part, flat.reshape(len(part), int(length))


def _owner(word: str) -> str | None:
    return word if len(word) <= LONG else None


def neighbourhoods(words: DataFrame, symbols: int) -> DataFrame:
    """key, id, word: a row for each distinct neighbour of each reduced word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1).to_pylist()
            sent = pa.array([_owner(w) for w in found], pa.string())
            for part, points in _by_length(found, symbols):
                around = np.sort(keys(points, symbols)[1], axis=1)
                first = np.concatenate([np.ones((len(part), 1), bool), around[:, 1:] != around[:, :-1]], axis=1)
                at = pa.array(np.repeat(part, first.sum(axis=1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(around[first].view(np.int64)), batch.column(0).take(at), sent.take(at)], ["key", "id", "word"],
                )

    return words.select("id", "word").mapInArrow(run, "key bigint, id bigint, word string")


def reduced_words(words: DataFrame, symbols: int) -> DataFrame:
    """own_key, near_id, near, near_n: the vocabulary by its reduced words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1).to_pylist()
            own = np.zeros(len(found), np.uint64)
            for part, points in _by_length(found, symbols):
                own[part] = keys(points, symbols)[0]
            sent = pa.array([_owner(w) for w in found], pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.view(np.int64)), batch.column(0), sent, batch.column(2)], ["own_key", "near_id", "near", "near_n"],
            )

    return words.select("id", "word", "n").mapInArrow(run, "own_key bigint, near_id bigint, near string, near_n bigint")


def near_words(words: DataFrame) -> DataFrame:
    """id, near, near_n for every two words that differ by one edit, in both directions."""
    symbols = alphabet(words.count())
    sent, own = neighbourhoods(words, symbols), reduced_words(words, symbols).hint("shuffle_hash")
    edits = F.levenshtein("word", "near", 1)
    found = sent.join(own, (F.col("key") == F.col("own_key")) & (F.coalesce(edits, F.lit(1)) == 1) & (F.col("id") != F.col("near_id")))
    found = materialise(found.select("id", "word", "near_id", "near", "near_n"), "spelling-near")
    # Pairs with a word too long to be sent along are still candidates.
    names = words.select(F.col("id").alias("w_id"), F.col("word").alias("name"))
    longer = found.where(F.col("word").isNull() | F.col("near").isNull()).select("id", "near_id", "near_n")
    longer = longer.join(names, F.col("id") == F.col("w_id")).select("id", F.col("name").alias("word"), "near_id", "near_n")
    longer = longer.join(names, F.col("near_id") == F.col("w_id")).where(F.levenshtein("word", "name", 1) == 1)
    return found.where(F.col("word").isNotNull() & F.col("near").isNotNull()).select("id", "near", "near_n").unionByName(
        longer.select("id", F.col("name").alias("near"), "near_n"),
    )


def roots(forms: DataFrame) -> DataFrame:
    """r_word, root: where the forms (word, form) lead to in the end, for the words that have one."""
    goals = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not goals.where("moved").isEmpty():
        onward = goals.select(F.col("word").alias("root"), F.col("root").alias("next"))
        goals = materialise(goals.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"),
        ), "spelling-roots")
    return goals.select(F.col("word").alias("r_word"), "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n, one row per word."""
    words = vocabulary(docs)
    around = near_words(words).groupBy(F.col("id").alias("a_id")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"),
    )
    dominant = -F.col("best.less") >= DOMINANT * F.col("n")
    formed = materialise(words.join(around, F.col("id") == F.col("a_id"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(dominant, F.col("best.near")).alias("form"), F.when(dominant, -F.col("best.less")).alias("form_n"),
    ), "spelling-forms")
    goals = roots(formed.where(F.col("form").isNotNull()))
    return formed.join(goals, F.col("word") == F.col("r_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n",
    )
