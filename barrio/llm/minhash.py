"""Near duplicates by ProbMinHash signatures, banding and verification.

Texts are compared by their sets of five-word shingles; they are near duplicates if the Jaccard similarity is
0.8 or more. A class is a connected component of that relation. A text of one to four words has
one shingle, all its words; a text without words is near to none but to its exact copies.

Signatures. Each distinct shingle sends arrivals of a Poisson process of rate 1 to the registers, a register keeps its first
arrival, and the shingle that sent it is the register's value: two texts agree in it with the probability of
their Jaccard similarity, the one that is verified, however often a shingle is repeated. Arrivals come in rounds and a
shingle stops when its next one is later than every register's. All shingles of a block of texts are
handled at once, in arrays.

Banding. Copies of a text are one text. Three registers make a band; two texts of similarity 0.8 share one
of the 21 bands with a probability above 0.9999995. All pairs of a bucket of up to `SMALL` texts become
candidates. The texts of a larger bucket are each paired with its smallest text only. A bucket whose texts are then
all in one class has no link to add. All texts of the others are joined exactly.

Exact join. The shingles of a text are ordered by the number of those texts that have them, rarest first. Two texts of n and
m shingles are near only if they share (n + m) * 0.8 / 1.8 of them, so their first common shingle stands among the
n - ceil(0.8 n) + 1 rarest of each, with at least that many left from there on in both. Texts of different classes that meet so are
candidates; the lengths and places decide that before a text is read. In a crowd the rarest shingles are mostly a text's
own, which join nothing. The join's tasks of a shingle with many texts are split by the planner, so no group of unknown size is gathered
anywhere, and no row is made but the candidates.

Verification recomputes the shingle sets of candidate pairs and keeps the pairs of 0.8 or more.

Components. Labels fall to the smallest label among neighbours, and to the label of that label, until nothing
changes. Each round is written to the shared folder, which cuts the lineage.

Defined cases: null counts as empty; a null id joins the class of an equal text, or is a class of its own; rows that repeat an id
are one class; an empty input gives an empty result; other columns are ignored or carried along by `keep_one`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barrio.llm.common import blocks, content_key, texts
from barrio.session import materialise

#: Fixed by the contract.
SHINGLE = 5
SIMILAR = 0.8

REGISTERS, ROWS = 63, 3
BANDS = REGISTERS // ROWS
#: Texts of a bucket up to which all pairs are candidates.
SMALL = 8

BLOCK_BYTES = 4 << 20
WORDS = 200_000


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values from others."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a limit."""

    def __missing__(self, word: str) -> int:
        if len(self) > WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = WordHashes()
#: Fixed by the contract; str.split would cut at more characters.
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str) -> np.ndarray:
    """64-bit hashes of the five-word shingles in order; one of all words if there are fewer."""
    found = _WORD.findall(text)
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    span = min(SHINGLE, len(h))
    n = len(h) - span + 1
    out = np.full(n, np.uint64(len(found) if len(found) < SHINGLE else SHINGLE))
    for k in range(span):
        out = mixed(out ^ h[k:k + n])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """ProbMinHash signatures, one row per text with at least one shingle."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = np.concatenate(sets)
    order = np.lexsort((element, owner))
    owner, element = owner[order], element[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (element[1:] != element[:-1])]))
    owner, element = owner[first], element[first]

    arrival = np.full((len(sets), REGISTERS), np.inf)
    winner = np.zeros((len(sets), REGISTERS), np.uint64)
    at = np.zeros(len(element))
    state = mixed(element)
    while len(element):
        state = mixed(state)
        uniform = ((state >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
        at = at - np.log(uniform)
        register = (mixed(state ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(REGISTERS)).astype(np.int64)
        np.minimum.at(arrival, (owner, register), at)
        hit = arrival[owner, register] == at
        winner[owner[hit], register[hit]] = element[hit]
        alive = at < arrival.max(axis=1)[owner]
        owner, element, at, state = owner[alive], element[alive], at[alive], state[alive]
    return winner


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, BLOCK_BYTES):
        found = texts(block.column(1))
        sets = [shingles(t) for t in found]
        rows = [i for i, s in enumerate(sets) if len(s)]
        lengths = np.zeros(len(found), np.int32)
        lengths[rows] = BANDS
        key = np.zeros((len(rows), BANDS), np.uint64)
        if rows:
            winners = signatures([sets[i] for i in rows]).reshape(len(rows), BANDS, ROWS)
            for k in range(ROWS):
                key = mixed(key ^ winners[:, :, k])
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                block.column(0), pa.array([hashlib.sha256(t.encode()).digest() for t in found], pa.binary()),
                pa.ListArray.from_arrays(offsets, pa.array(key.ravel().view(np.int64))),
            ],
            ["doc_id", "digest", "keys"],
        )


def signed(docs: DataFrame) -> DataFrame:
    """Per document the digest of its text and the keys of its bands, none for a text without words."""
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(_signed, "doc_id bigint, digest binary, keys array<bigint>")


def with_band(key: Column, band: Column) -> Column:
    """A bucket's key with the number of its band in the low bits."""
    return key.bitwiseAND(F.lit(~31).cast("bigint")).bitwiseOR(band.cast("bigint"))


def _deal(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of the buckets of (key, id, label), and the items of larger buckets.

    Texts of one label are never paired, and buckets with one label are left out.
    """
    buckets = items.groupBy("key").agg(
        F.count("*").alias("n"), F.min(F.struct("id", "label")).alias("least"),
        F.min("label").alias("low"), F.max("label").alias("high"),
    ).where(F.col("low") < F.col("high"))
    # Read back, both sides of the joins are shuffled for them, and the planner may split a hot key.
    buckets = materialise(buckets.select(F.col("key").alias("b_key"), "n", "least"), "near-buckets")
    same = F.col("key") == F.col("b_key")
    few = items.join(buckets.where(F.col("n") <= SMALL), same)
    small = few.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("id", "label"))).alias("ids"))
    later = F.flatten(F.transform(
        "ids", lambda a, i: F.transform(
            F.filter(F.slice("ids", i + 2, SMALL), lambda b: b["label"] != a["label"]),
            lambda b: F.struct(a["id"].alias("a"), b["id"].alias("b")),
        ),
    ))
    pairs = small.select(F.explode(later).alias("p")).select("p.a", "p.b")
    large = items.join(buckets.where(F.col("n") > SMALL), same)
    stars = large.where(F.col("label") != F.col("least.label")).select(F.col("least.id").alias("a"), F.col("id").alias("b"))
    return pairs.unionByName(stars).distinct(), large.select("key", "id")


def _unsettled(items: DataFrame, labels: DataFrame) -> DataFrame:
    """The ids of the items (key, id) of buckets that hold more than one label, with their labels."""
    named = items.join(
        labels.select(F.col("id").alias("l_id"), "label"), F.col("id") == F.col("l_id"), "left",
    ).select("key", "id", F.coalesce("label", "id").alias("label"))
    named = materialise(named, "near-named")
    mixed_keys = named.groupBy(F.col("key").alias("m_key")).agg(
        F.min("label").alias("low"), F.max("label").alias("high"),
    ).where(F.col("low") < F.col("high")).select("m_key")
    open_rows = named.join(materialise(mixed_keys, "near-open-keys"), F.col("key") == F.col("m_key"))
    return materialise(open_rows.select("id", "label").distinct(), "near-open")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each text, one row a shingle."""
    for block in blocks(batches, BLOCK_BYTES):
        found = texts(block.column(2))
        sets = [np.unique(shingles(t)) for t in found]
        n = np.array([len(x) for x in sets], np.int64)
        at = pa.array(np.repeat(np.arange(len(sets)), n))
        flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
        # Rows may repeat an id with another text.
        own = pa.array(np.array([xxhash.xxh3_64_intdigest(t) for t in found], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [block.column(0).take(at), block.column(1).take(at), own.take(at), pa.array(np.repeat(n, n)), pa.array(flat)],
            ["id", "label", "own", "n", "key"],
        )


def _prefixes(open_texts: DataFrame) -> DataFrame:
    """key, id, label, n, rest: the rarest shingles of each text (id, label, text), with the shingles left from there on."""
    listed = materialise(open_texts.mapInArrow(_listed, "id bigint, label bigint, own bigint, n bigint, key bigint"), "near-shingles")
    # A shingle of one text joins nothing, but counts among the rarest.
    held = listed.groupBy(F.col("key").alias("h_key")).agg(F.count("*").alias("texts")).where(F.col("texts") > 1)
    counted = listed.join(materialise(held, "near-counts"), F.col("key") == F.col("h_key"), "left")
    ordered = counted.groupBy("id", "label", "own", "n").agg(
        F.sort_array(F.collect_set(F.struct(F.coalesce("texts", F.lit(1)).alias("texts"), "key"))).alias("keys"),
    )
    # A hair below, so that rounding never makes a prefix too short.
    most = F.col("n") - F.ceil(F.col("n") * F.lit(SIMILAR) - F.lit(1e-9)) + 1
    rows = ordered.select("id", "label", "n", F.posexplode(F.slice("keys", F.lit(1), most.cast("int"))).alias("at", "k"))
    return rows.where(F.col("k.texts") > 1).select(F.col("k.key").alias("key"), "id", "label", "n", (F.col("n") - F.col("at")).alias("rest"))


def _meeting(rows: DataFrame) -> DataFrame:
    """Candidate pairs of different labels among the rows that `_prefixes` gives."""
    held = rows.groupBy(F.col("key").alias("s_key")).agg(
        F.min("label").alias("low"), F.max("label").alias("high"),
    ).where(F.col("low") < F.col("high")).select("s_key")
    # Read back, both sides are shuffled for the join, and the planner may split the tasks of a hot shingle.
    rows = materialise(rows.join(materialise(held, "near-mixed"), F.col("key") == F.col("s_key")).drop("s_key"), "near-meeting")
    one, two = (rows.select(*[F.col(c).alias(f"{c}_{side}") for c in rows.columns]) for side in "ab")
    need = (F.col("n_a") + F.col("n_b")) * F.lit(SIMILAR / (1 + SIMILAR)) - F.lit(1e-6)
    both = one.join(two, (
        (F.col("key_a") == F.col("key_b")) & (F.col("id_a") < F.col("id_b")) & (F.col("label_a") != F.col("label_b"))
        & (F.least("rest_a", "rest_b") >= need)
    ))
    return both.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def similar_labels(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """id, label of the texts (id, keys) that are near to another, as the module text says."""
    items = texts.select("id", F.posexplode("keys").alias("band", "at")).select(
        with_band(F.col("at"), F.col("band")).alias("key"), "id", F.col("id").alias("label"),
    )
    pairs, large = _deal(items)
    links = materialise(verify(pairs, docs), "near-links")
    labels = components(links)
    left = _unsettled(large, labels)
    if left.isEmpty():
        return labels
    # From here on only the texts of open buckets are read.
    ids = left.select(F.col("id").alias("o_id"), "label")
    docs = docs.select(F.col("doc_id").cast("bigint"), "text").join(ids.hint("merge"), F.col("doc_id") == F.col("o_id"))
    docs = materialise(docs.select("doc_id", "label", "text"), "near-open-texts")
    rows = materialise(_prefixes(docs.withColumnRenamed("doc_id", "id")), "near-prefixes")
    return components(materialise(links.unionByName(verify(_meeting(rows), docs)), "near-links"))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    remembered: dict[tuple[int, str], np.ndarray] = {}

    def distinct(i: int, text: str) -> np.ndarray:
        if (i, text) not in remembered:
            if len(remembered) > 500:
                remembered.clear()
            remembered[i, text] = np.unique(shingles(text))
        return remembered[i, text]

    for block in blocks(batches, BLOCK_BYTES):
        a, b = block.column(0).to_pylist(), block.column(1).to_pylist()
        similar = []
        for i, j, s, t in zip(a, b, texts(block.column(2)), texts(block.column(3))):
            x, y = distinct(i, s), distinct(j, t)
            common = 0
            if min(len(x), len(y)) >= SIMILAR * max(len(x), len(y)):
                common = len(np.intersect1d(x, y, assume_unique=True))
            similar.append(common > 0 and common >= SIMILAR * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays(block.columns[:2], ["a", "b"]).filter(pa.array(similar))


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts have the similarity asked for."""
    pairs = materialise(pairs, "near-pairs")
    wanted = pairs.select(F.col("a").alias("w_id")).unionByName(pairs.select(F.col("b").alias("w_id"))).distinct()
    # Only the texts of candidates go on. The ids grow with the data, hence a merge at every size.
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(
        wanted.hint("merge"), F.col("id") == F.col("w_id"),
    )
    chosen = materialise(chosen.select("id", "text"), "near-texts")
    one = chosen.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = chosen.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_verified, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """id, label: the smallest id of the component, for every id in a written link (a, b) with a < b."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("label")).unionByName(
        links.select(F.col("a").alias("id"), F.col("a").alias("label")),
    ).groupBy("id").agg(F.min("label").alias("label")), "near-labels")
    while True:
        # The smallest label around a node goes to the node and to the node its label names.
        seen = both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("far")), "b").groupBy(
            F.col("a").alias("id")).agg(F.min("far").alias("far"))
        lower = seen.join(labels, "id").select("id", "label", F.least("far", "label").alias("low"))
        hooks = lower.select("id", "low").unionByName(lower.select(F.col("label").alias("id"), "low"))
        hooked = hooks.groupBy("id").agg(F.min("low").alias("low"))
        jump = hooked.select(F.col("id").alias("low"), F.col("low").alias("lower"))
        new = hooked.join(jump, "low", "left").select("id", F.least("low", F.coalesce("lower", "low")).alias("label"))
        new = materialise(new, "near-labels")
        changed = new.join(labels.select("id", F.col("label").alias("was")), "id").where(F.col("label") != F.col("was"))
        labels = new
        if changed.isEmpty():
            return labels


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id: the smallest doc_id of the class, one row per document."""
    members = materialise(signed(docs), "near-signed")
    # Equal texts have equal keys, so any of them will do.
    firsts = members.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"))
    firsts = materialise(firsts.where(F.col("id").isNotNull()), "near-firsts")
    labels = similar_labels(firsts, docs)
    classed = firsts.join(labels, "id", "left").select(
        F.col("digest").alias("c_digest"), F.coalesce("label", "id").alias("class_id"),
    )
    return members.join(classed, F.col("digest") == F.col("c_digest"), "left").select("doc_id", "class_id")


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size and kept, one row per document."""
    placed = materialise(classes(docs), "near-classes")
    # Read back, both sides are shuffled for the join, and the planner may split a hot class.
    sizes = materialise(placed.groupBy(F.col("class_id").alias("s_class")).agg(F.count("*").alias("class_size")), "near-sizes")
    sized = placed.join(sizes, F.col("class_id") == F.col("s_class"), "left")
    return sized.select(
        "doc_id", "class_id", F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull()).alias("kept"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, that with the smallest doc_id; all columns as given.

    Rows that repeat id and text become one; rows with a null id stay.
    """
    stay = classes(docs).where(F.col("doc_id") == F.col("class_id")).select(F.col("class_id").alias("k_id")).distinct()
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("r_id"), *content_key(F.col("text")),
    )
    named = rows.join(stay, F.col("r_id") == F.col("k_id")).dropDuplicates(["r_id", "content_a", "content_b"])
    kept = named.select("row").unionByName(rows.where(F.col("r_id").isNull()).select("row"))
    return kept.select(*[F.col("row").getField(n).alias(n) for n in docs.columns])
