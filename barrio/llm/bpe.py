"""Byte-level BPE encoding and decoding by a pair occurrence index.

A text is cut at special strings and by the pattern of the vocabulary into pieces that merges never
cross. The distinct pieces that a task meets are encoded together: their symbols stand in one array,
an index maps the rank of each adjacent pair to all positions where it stands, and ranks are applied in
ascending order. Applying a rank merges all its positions at once and enters the pairs that arise into
the lists of their ranks. Lists are not cleaned: a position that no longer holds the pair is skipped when
its rank comes.

Encoded pieces are remembered by the worker up to a limit and forgotten when it is reached, so memory is bounded
whatever the number of distinct pieces. A text is one row and is handled whole.

Defined cases: null counts as the empty text, which has no tokens and decodes to itself; repeated rows are
encoded alike; null ids are carried along; an empty input gives an empty result; bytes of invalid sequences decode
to replacement characters.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from barrio.llm.common import Numbering, Store, blocks, read_bytes, texts

#: Fixed by the vocabulary: how a text is cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes of text that are encoded together, and distinct pieces that a worker remembers.
BLOCK_BYTES = 6 << 20
PIECES = 250_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is printable, else the next from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Vocabulary:
    """Merges and tokens of a byte-level BPE file."""

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        byte_of = {letter: b for b, letter in enumerate(letters)}
        self.byte_ids = np.array([ids[letter] for letter in letters], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        codes = self.left << 32 | self.right
        self.rank_of_sorted = np.argsort(codes)
        self.sorted_codes = codes[self.rank_of_sorted]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*ids.values(), *self.specials.values()])
        self.bytes_of = [b""] * size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        self.split = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.specials, key=len, reverse=True)) or "(?!)")
        self.pieces = regex.compile(PATTERN)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs; the number of merges where there is none."""
        codes = left << 32 | right
        at = np.minimum(np.searchsorted(self.sorted_codes, codes), len(self.sorted_codes) - 1)
        return np.where(self.sorted_codes[at] == codes, self.rank_of_sorted[at], len(self.sorted_codes))

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after the other, and how many each piece has."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        symbol = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        n, none = len(symbol), len(self.left)
        ends = np.cumsum(lengths)
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        following[ends - 1] = -1
        before[ends - lengths] = -1

        index: dict[int, list[int]] = defaultdict(list)
        at = np.flatnonzero(following >= 0)
        ranks = self.ranks(symbol[at], symbol[following[at]])
        found = ranks < none
        at, ranks = at[found], ranks[found]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for group in np.split(at, cuts) if len(at) else []:
            index[int(self.ranks(symbol[group[:1]], symbol[following[group[:1]]])[0])] = group.tolist()
        waiting = list(index)
        heapq.heapify(waiting)

        while waiting:
            rank = heapq.heappop(waiting)
            left, right = self.left[rank], self.right[rank]
            at = np.unique(np.array(index.pop(rank), np.int64))
            second = following[at]
            holds = (symbol[at] == left) & (second >= 0) & (symbol[second] == right)
            at = at[holds]
            if left == right and len(at) > 1:
                at = self._apart(at, following)
            if not len(at):
                continue
            second = following[at]
            third = following[second]
            symbol[at] = self.merged[rank]
            symbol[second] = -1
            following[at] = third
            inner = third >= 0
            before[third[inner]] = at[inner]
            first = np.concatenate([before[at][before[at] >= 0], at[inner]])
            ranks = self.ranks(symbol[first], symbol[following[first]])
            found = ranks < none
            for r, p in zip(ranks[found].tolist(), first[found].tolist()):
                if r not in index:
                    heapq.heappush(waiting, r)
                index[r].append(p)

        alive = symbol >= 0
        upto = np.concatenate([[0], np.cumsum(alive)])
        return symbol[alive], upto[ends] - upto[ends - lengths]

    @staticmethod
    def _apart(at: np.ndarray, following: np.ndarray) -> np.ndarray:
        """Of positions whose pairs overlap, every other one from the left."""
        linked = np.concatenate([[False], following[at[:-1]] == at[1:]])
        run = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
        return at[(np.arange(len(at)) - run) % 2 == 0]


class Encoder:
    """Encodes texts; remembers pieces up to a limit."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.known, self.store = Numbering(), Store(np.int32)

    def _pieces(self, text: str) -> list[str]:
        cut = self.vocabulary.pieces.findall
        if not any(s in text for s in self.vocabulary.specials):
            return cut(text)
        out: list[str] = []
        for part in self.vocabulary.split.split(text):
            if part in self.vocabulary.specials:
                out.append("\0special" + part)  # no piece of the pattern begins so
            elif part:
                out += cut(part)
        return out

    def encode(self, documents: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has."""
        if len(self.known) > PIECES:
            self.forget()
        numbers, lengths = [], []
        for text in documents:
            pieces = self._pieces(text)
            lengths.append(len(pieces))
            numbers.append(np.fromiter(map(self.known.__getitem__, pieces), np.int32, len(pieces)))
        self._learn()
        which = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
        upto = np.concatenate([[0], np.cumsum(self.store.counts[which])])
        ends = np.cumsum(np.array(lengths, np.int64))
        return self.store.rows(which), upto[ends] - upto[ends - np.array(lengths, np.int64)]

    def _learn(self) -> None:
        fresh, self.known.fresh = self.known.fresh, []
        plain = [p for p in fresh if not p.startswith("\0special")]
        if plain:
            ids, counts = self.vocabulary.encode_pieces([p.encode() for p in plain])
        else:
            ids, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(plain) < len(fresh):
            ends, out, out_counts, k = np.cumsum(counts), [], [], 0
            for p in fresh:
                if p.startswith("\0special"):
                    out.append(np.array([self.vocabulary.specials[p.removeprefix("\0special")]]))
                else:
                    out.append(ids[ends[k] - counts[k]:ends[k]])
                    k += 1
                out_counts.append(len(out[-1]))
            ids, counts = np.concatenate(out), np.array(out_counts, np.int64)
        self.store.append(ids, counts)


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    """The text of token ids, special tokens included."""
    table = vocabulary.bytes_of
    return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


_WORKER: dict[int, Encoder] = {}


def _encoder(content) -> Encoder:
    """The worker's encoder for a broadcast vocabulary, kept from task to task."""
    if content.id not in _WORKER:
        _WORKER.clear()
        _WORKER[content.id] = Encoder(Vocabulary(content.value))
    return _WORKER[content.id]


class Broadcast:
    """A broadcast file with the id under which workers keep what they made of it."""

    def __init__(self, spark, path: str) -> None:
        self.broadcast = spark.sparkContext.broadcast(read_bytes(path))
        self.id = hash(path)

    @property
    def value(self) -> bytes:
        return self.broadcast.value


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, the token ids of the text and the text decoded from them."""
    content = Broadcast(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content)
        for block in blocks(batches, BLOCK_BYTES):
            ids, counts = encoder.encode(texts(block.column(1)))
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            decoded = [decode(encoder.vocabulary, ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(decoded, pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, ids array<int>, decoded string")
