"""Repeated passages by suffix arrays.

Every byte covered by a 200-byte string that also starts anywhere else is removed; the same document
counts, overlaps count, matches never cross documents, and strings are judged on the input.

Sharding. Each 200-byte window is given to the 64-byte string in it with the smallest hash, the leftmost of equals. Equal
windows choose equal strings, so they meet under the same key. Neighbouring windows with one choice form a context,
the stretch of text that holds them all; every window of a document lies in exactly one context.
Equal contexts are counted by partial sums: what stands twice is covered as a whole, and only one copy goes on.
A key with a single context is done. The distinct contexts of the others are dealt to shards by key.

In a shard, contexts are joined to one string, each with its own end sign. Its suffix array is built by induced sorting:
suffixes are classified, leftmost-smaller substrings are sorted by induction and named, the string of
names is sorted recursively, and the order of all suffixes is induced from it. Inducing goes through the array in
stretches as long as nothing falls into the stretch itself. Permuted common prefixes are computed where
a match cannot be extended to the left and follow elsewhere. A window whose suffix shares 200 bytes with a
neighbour in the array stands elsewhere too.

Keys with more than `MANY` distinct contexts, such as those of a phrase that a third of all documents hold, are not
gathered: the windows of their contexts are counted by hash, 128 bits, with partial sums.

Defined cases: null counts as empty; texts under 200 bytes lose nothing; equal texts of 200 bytes or more lose all,
also if rows repeat an id; null ids are carried along; very long texts are cut into overlapping
parts, each window in one of them; an empty input gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barrio.llm.common import blocks, utf8
from barrio.llm.minhash import mixed
from barrio.session import materialise

#: Fixed by the contract.
SPAN = 200

ANCHOR = 64
CHOICES = SPAN - ANCHOR + 1
#: Distinct contexts up to which the windows of a key are compared in a shard.
MANY = 4096
#: Small enough for the arrays of a block to stay in a processor's cache.
BLOCK_BYTES = 256 << 10
SHARD_BYTES = 512 << 10
#: Bits for a position within a block; the others are for the hash.
PLACE = np.uint64(28)


# ---- contexts -------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = mixed(np.arange(256, dtype=np.uint64))
_KNOWN: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """The first n powers of an odd number, modulo 2**64."""
    if len(_KNOWN.get(base, ())) < n:
        size = 1 << max(18, n.bit_length())
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        _KNOWN[base] = np.cumprod(factors)
    return _KNOWN[base][:n]


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each 64-byte string, and for each window the place of its smallest one."""
    n = len(data)
    # Differences of running sums of byte value times power, brought to the same power.
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * _powers(n, _BASE), out=sums[1:])
    h = (sums[ANCHOR:] - sums[:-ANCHOR]) * _powers(n, _INVERSE)[:max(0, n - ANCHOR + 1)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    least = (h >> PLACE << PLACE) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= CHOICES:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = CHOICES - width
    least = np.minimum(least[:len(least) - rest], least[rest:])
    return h, (least & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)


def _parts(documents: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(document, offset, bytes) such that each window lies in one part."""
    for d, text in enumerate(documents):
        for start in range(0, max(0, len(text) - SPAN + 1), BLOCK_BYTES):
            yield d, start, text[start:start + BLOCK_BYTES + SPAN - 1]


def contexts(documents: list[bytes]) -> tuple[np.ndarray, ...]:
    """document, first window, number of windows, key and digest of the contexts of texts."""
    parts = list(_parts(documents))
    joined = b"".join(p for _, _, p in parts)
    if not joined:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    data = np.frombuffer(joined, np.uint8)
    h, place = anchors(data)
    lengths = np.array([len(p) for _, _, p in parts])
    ends = np.cumsum(lengths)
    part = np.repeat(np.arange(len(parts)), lengths)[:len(place)]
    inside = np.arange(len(place)) + SPAN <= ends[part]
    at = np.flatnonzero(inside)
    new = np.concatenate([[True], (place[at][1:] != place[at][:-1]) | (np.diff(at) != 1) | (np.diff(part[at]) != 0)])
    first = at[new]
    count = np.diff(np.concatenate([np.flatnonzero(new), [len(at)]]))
    digest = xxhash.xxh3_64_intdigest
    view = memoryview(joined)
    digests = np.fromiter(
        (digest(view[a:b]) for a, b in zip(first.tolist(), (first + count + SPAN - 1).tolist())), np.uint64, len(first),
    )
    document = np.array([d for d, _, _ in parts])[part[first]]
    offset = np.array([o for _, o, _ in parts])[part[first]]
    start = first - (ends - lengths)[part[first]] + offset
    return document, start, count, h[place[first]].view(np.int64), digests.view(np.int64)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, BLOCK_BYTES):
        document, start, count, key, digest = contexts(utf8(block.column(2)))
        rows = pa.array(document)
        yield pa.RecordBatch.from_arrays(
            [
                block.column(0).take(rows), block.column(1).take(rows), pa.array(start.astype(np.int32)),
                pa.array(count.astype(np.int32)), pa.array(key), pa.array(digest),
            ],
            ["doc_id", "crc", "start", "windows", "key", "digest"],
        )


# ---- suffix array ---------------------------------------------------------------------------------

def _ranks(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Within equal symbols the running number of each; the distinct symbols and their counts."""
    order = symbols.argsort(kind="stable")
    ordered = symbols[order]
    new = np.empty(len(symbols), bool)
    new[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    first = new.nonzero()[0]
    counts = np.empty_like(first)
    np.subtract(first[1:], first[:-1], out=counts[:-1])
    counts[-1] = len(symbols) - first[-1]
    rank = np.empty(len(symbols), np.int64)
    rank[order] = np.arange(len(symbols)) - first.repeat(counts)
    return rank, ordered[first], counts


def _induce(text: np.ndarray, smaller: np.ndarray, bounds: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The array induced from leftmost-smaller suffixes `seeds`, which are in order within their first symbol."""
    n = len(text)
    if len(bounds) <= 1 << 16:
        text = text.astype(np.uint16)  # sorts faster
    starts, ends = bounds[:-1], bounds[1:]
    array = np.full(n, -1, np.int64)
    symbols = text[seeds]
    rank, present, counts = _ranks(symbols)
    per = np.zeros(len(starts), np.int64)
    per[present] = counts
    array[ends[symbols] - per[symbols] + rank] = seeds

    head, at, step = starts.copy(), 0, 1024
    while at < n:
        stretch = array[at:at + step]
        good = (stretch > 0).nonzero()[0]
        source = stretch[good] - 1
        larger = ~smaller[source]
        good, source = good[larger], source[larger]
        upto = min(at + step, n)
        if len(source):
            symbols = text[source]
            rank, present, counts = _ranks(symbols)
            to = head[symbols] + rank
            least = int(to.min())
            if least < upto:  # what lies behind may still change
                upto = least
                use = int(good.searchsorted(upto - at))
                source, to = source[:use], to[:use]
                np.maximum.at(head, symbols[:use], to + 1)
            else:
                head[present] += counts
            array[to] = source
        step = min(max(64, 2 * (upto - at)), 1 << 16)
        at = upto

    array[1:][smaller[array[1:]]] = -1
    tail, at, step = ends.copy(), n, 1024
    while at > 0:
        low = max(0, at - step)
        stretch = array[low:at][::-1]
        good = (stretch > 0).nonzero()[0]
        source = stretch[good] - 1
        small = smaller[source]
        good, source = good[small], source[small]
        downto = low
        if len(source):
            symbols = text[source]
            rank, present, counts = _ranks(symbols)
            to = tail[symbols] - 1 - rank
            most = int(to.max())
            if most >= low:
                downto = most + 1
                use = int(good.searchsorted(at - downto))
                source, to = source[:use], to[:use]
                np.minimum.at(tail, symbols[:use], to)
            else:
                tail[present] -= counts
            array[to] = source
        step = min(max(64, 2 * (at - downto)), 1 << 16)
        at = downto
    return array


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes of `text`, whose last symbol is 0 and stands nowhere else."""
    n = len(text)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    step = np.sign(np.diff(text))
    # A suffix is smaller than the next if the next symbol that differs is larger.
    differs = np.where(step != 0, np.arange(n - 1), n - 1)
    following = np.minimum.accumulate(differs[::-1])[::-1]
    smaller = np.concatenate([step[np.minimum(following, n - 2)] > 0, [True]])
    leftmost = np.concatenate([[False], smaller[1:] & ~smaller[:-1]])
    places = np.flatnonzero(leftmost)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(text))])
    array = _induce(text, smaller, bounds, places)

    ordered = array[leftmost[array]]
    length = np.zeros(n, np.int64)
    length[places] = np.diff(np.concatenate([places, [n - 1]])) + 1
    one, two = ordered[:-1], ordered[1:]
    same = length[one] == length[two]
    open_pairs, k = np.flatnonzero(same), 0
    while len(open_pairs):
        equal = text[one[open_pairs] + k] == text[two[open_pairs] + k]
        same[open_pairs[~equal]] = False
        k += 1
        open_pairs = open_pairs[equal]
        open_pairs = open_pairs[length[one[open_pairs]] > k]
    names = np.concatenate([[0], np.cumsum(~same)])
    if names[-1] + 1 < len(places):
        name = np.empty(n, np.int64)
        name[ordered] = names
        ordered = places[suffix_array(name[places])]
    return _induce(text, smaller, bounds, ordered)


def common_prefixes(data: np.ndarray, left: np.ndarray, array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place its predecessor in the array and the bytes both have in common.

    `left` holds the bytes from each place to the end of its context.
    """
    n = len(data)
    before = np.empty(n, np.int64)
    before[array[1:]] = array[:-1]
    before[array[0]] = -1
    place = np.arange(n)
    partner = np.maximum(before, 0)
    # If both can be extended to the left by the same byte, the match is the longer one less a byte.
    follows = np.zeros(n, bool)
    follows[1:] = (
        (before[1:] > 0) & (data[:-1] == data[np.maximum(before[1:] - 1, 0)]) & (left[:-1] > 1)
        & (left[np.maximum(before[1:] - 1, 0)] > 1)
    )
    anchor = np.flatnonzero(~follows)
    limit = np.minimum(left[anchor], left[partner[anchor]])
    limit[before[anchor] < 0] = 0
    length = np.zeros(len(anchor), np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (n + 1, 8), (1, 1))
    live = np.flatnonzero(limit > 0)
    while len(live):
        a, b = anchor[live] + length[live], partner[anchor[live]] + length[live]
        equal = eight[np.minimum(a, n)] == eight[np.minimum(b, n)]
        run = np.where(equal.all(axis=1), 8, np.argmin(equal, axis=1))
        length[live] += run
        live = live[(run == 8) & (length[live] < limit[live])]
    length = np.minimum(length, limit)
    base = np.maximum.accumulate(np.where(follows, 0, place))
    value = np.zeros(n, np.int64)
    value[anchor] = length
    return before, np.maximum(value[base] - (place - base), 0)


def repeated_windows(pieces: list[bytes]) -> list[np.ndarray]:
    """Per context the offsets of windows that stand elsewhere in the contexts."""
    lengths = np.array([len(p) for p in pieces])
    ends = np.cumsum(lengths + 1)
    data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    text = data.astype(np.int64) + len(pieces)
    text[ends - 1] = np.arange(len(pieces))[::-1]
    owner = np.repeat(np.arange(len(pieces)), lengths + 1)
    left = ends[owner] - 1 - np.arange(len(data))
    # Only symbols in use get a bucket.
    used = np.zeros(256, bool)
    used[np.unique(data)] = True
    text[text >= len(pieces)] = len(pieces) + (np.cumsum(used) - 1)[text[text >= len(pieces)] - len(pieces)]
    before, common = common_prefixes(data, left, suffix_array(text))
    twice = common >= SPAN
    found = twice.copy()
    found[before[twice]] = True
    at = np.flatnonzero(found)
    cuts = np.searchsorted(at, ends)
    starts = ends - lengths - 1
    return [at[a:b] - s for a, b, s in zip(np.concatenate([[0], cuts[:-1]]), cuts, starts)]


# ---- Spark ----------------------------------------------------------------------------------------

def _runs(offsets: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive offsets as (first, behind the last)."""
    if not len(offsets):
        return []
    cut = np.flatnonzero(np.diff(offsets) != 1)
    first = offsets[np.concatenate([[0], cut + 1])]
    last = offsets[np.concatenate([cut, [len(offsets) - 1]])] + 1
    return list(zip(first.tolist(), last.tolist()))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts asked for of each text."""
    for batch in batches:
        for k in range(batch.num_rows):
            part = batch.slice(k, 1)
            wanted = part.column(1).flatten()
            text = utf8(part.column(0))[0]
            start, windows = wanted.field("start").to_numpy(), wanted.field("windows").to_numpy()
            pieces = [text[a:a + w + SPAN - 1] for a, w in zip(start.tolist(), windows.tolist())]
            yield pa.RecordBatch.from_arrays(
                [wanted.field("key"), wanted.field("id"), wanted.field("many"), pa.array(pieces, pa.binary())],
                ["key", "id", "many", "piece"],
            )


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows; the contexts come in the order of their keys."""

    def solve() -> pa.RecordBatch:
        runs = [_runs(o) for o in repeated_windows(pieces)]
        flat = [(i, a, b) for i, r in zip(ids, runs) for a, b in r]
        columns = list(zip(*flat)) or [(), (), ()]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())],
            ["id", "first", "behind"],
        )

    ids, pieces, size, last = [], [], 0, None
    for batch in batches:
        for key, i, piece in zip(*[batch.column(k).to_pylist() for k in range(3)]):
            if key != last and size > SHARD_BYTES:
                yield solve()
                ids, pieces, size = [], [], 0
            last = key
            ids.append(i)
            pieces.append(piece)
            size += len(piece)
    if pieces:
        yield solve()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of a context with 128 bits of hash."""
    for batch in batches:
        ids, offsets, hashes = [], [], []
        for i, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for o in range(len(piece) - SPAN + 1):
                ids.append(i)
                offsets.append(o)
                hashes.append(xxhash.xxh3_128_digest(piece[o:o + SPAN]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(offsets, pa.int32()), pa.array(hashes, pa.binary())],
            ["id", "first", "window"],
        )


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the bytes that the runs of windows cover."""
    for batch in batches:
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for text, runs in zip(utf8(batch.column(1)), batch.column(2)):
            spans: list[list[int]] = []
            if runs.is_valid and len(runs):
                flat = runs.values
                pairs = zip(flat.field("first").to_pylist(), flat.field("behind").to_pylist())
                for a, b in sorted((a, b + SPAN - 1) for a, b in pairs):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
            at, pieces = 0, []
            for a, b in spans:
                pieces.append(text[at:a])
                at = b
            pieces.append(text[at:])
            left = b"".join(pieces)
            n_bytes.append(len(text))
            n_removed.append(len(text) - len(left))
            n_spans.append(len(spans))
            kept.append(left)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
                pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary()),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def _with_crc(docs: DataFrame) -> DataFrame:
    """doc_id, crc, text: rows that have the first two in common hold the same text."""
    return docs.select(
        F.col("doc_id").cast("bigint"), F.crc32(F.coalesce("text", F.lit(""))).alias("crc"), "text",
    )


def _same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["r_doc_id"]) & (left["crc"] == right["r_crc"])


def _row_runs(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """(r_doc_id, r_crc, first, behind): runs of windows of a document that also start elsewhere."""
    seen = _with_crc(docs).mapInArrow(
        _contexts, "doc_id bigint, crc bigint, start int, windows int, key bigint, digest bigint",
    )
    twice = seen.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1).select(F.col("key").alias("t_key"))
    # Read back, both sides of the join are shuffled for it, and the planner may split a hot key.
    twice = materialise(twice, "repeats-keys")
    shared = materialise(seen.join(twice, F.col("key") == F.col("t_key")).drop("t_key"), "repeats-contexts")

    one = F.min(F.struct("doc_id", "crc", "start", "windows")).alias("one")
    distinct = shared.groupBy("key", "digest").agg(F.count("*").alias("n"), one)
    per_key = distinct.groupBy(F.col("key").alias("k_key")).agg(F.count("*").alias("contexts"))
    marked = materialise(
        distinct.join(per_key, F.col("key") == F.col("k_key")).select(
            "key", "digest", "n", "one.*", "contexts", F.xxhash64("key", "digest").alias("id"),
        ), "repeats-distinct",
    )
    whole = marked.where(F.col("n") > 1).select(F.col("key").alias("w_key"), F.col("digest").alias("w_digest"))
    copies = shared.join(whole, (F.col("key") == F.col("w_key")) & (F.col("digest") == F.col("w_digest"))).select(
        F.col("doc_id").alias("r_doc_id"), F.col("crc").alias("r_crc"),
        F.col("start").alias("first"), (F.col("start") + F.col("windows")).alias("behind"),
    )

    unsure = marked.where(F.col("contexts") > 1)
    asked = unsure.select(
        F.col("doc_id").alias("r_doc_id"), F.col("crc").alias("r_crc"),
        F.struct("start", "windows", "key", "id", (F.col("contexts") > MANY).alias("many")).alias("want"),
    ).groupBy("r_doc_id", "r_crc").agg(F.collect_list("want").alias("wants"))
    pieces = stored.join(asked, _same_row(stored, asked)).select("text", "wants").mapInArrow(
        _cut, "key bigint, id bigint, many boolean, piece binary",
    )
    sharded = pieces.where(~F.col("many")).select("key", "id", "piece").repartition("key").sortWithinPartitions("key")
    runs = sharded.mapInArrow(_shard, "id bigint, first int, behind int")

    windows = pieces.where("many").select("id", "piece").mapInArrow(_windows, "id bigint, first int, window binary")
    again = windows.groupBy("window").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    single = windows.join(again.select(F.col("window").alias("t_window")), F.col("window") == F.col("t_window")).select(
        "id", "first", (F.col("first") + 1).alias("behind"),
    )
    # A context that stands once has its one place; the others are covered already.
    places = unsure.where(F.col("n") == 1).select(
        F.col("id").alias("p_id"), F.col("doc_id").alias("r_doc_id"), F.col("crc").alias("r_crc"), "start",
    )
    partly = runs.unionByName(single).join(places, F.col("id") == F.col("p_id")).select(
        "r_doc_id", "r_crc", (F.col("start") + F.col("first")).alias("first"),
        (F.col("start") + F.col("behind")).alias("behind"),
    )
    return copies.unionByName(partly)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes, one row per document."""
    stored = _with_crc(docs)
    runs = _row_runs(docs, stored).groupBy("r_doc_id", "r_crc").agg(
        F.collect_list(F.struct("first", "behind")).alias("runs"),
    )
    return stored.join(runs, _same_row(stored, runs), "left").select("doc_id", "text", "runs").mapInArrow(
        _remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary",
    )
