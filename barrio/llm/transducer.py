"""Byte-level BPE as a finite-state transducer that is determinised as it is used.

A sequence of tokens is what merging makes of its bytes exactly if each two neighbours are what merging makes of the
bytes of the two: a merge across a border would already happen between the two tokens alone. So a transducer that reads
bytes only has to remember its last token and the place in the tree of token bytes where the next one
stands; which pairs may follow each other is found by merging the two, once per pair. It is not deterministic, since a
token may end or go on. The subset construction makes it so: a state holds all beginnings of a token that the read bytes
allow, each with the tokens it presupposes, and tokens that all of them share have been put out. As every prefix of a
piece is tokenised in one way only, a state holds at most one beginning per byte of the longest token; that is
the lookahead. States and their moves are made when a piece first needs them and forgotten when there are too many.

At the end of a piece the tokens of the beginning that is complete are put out. A piece that is a token as a whole
is that token, even where no merges lead to it.

Decoding follows token bytes with a state machine of UTF-8: complete characters are put out at once, an incomplete one waits
for the next token, and what can no longer become a character is replaced as the Unicode standard recommends.

Defined cases: null counts as the empty text, which has no tokens and decodes to itself; repeated rows and null ids are
carried along; a text is one row and is handled whole, however long; an empty input gives an empty result; columns
other than doc_id and text are not looked at.
"""

from __future__ import annotations

import base64
import gc
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from barrio.llm.bpe import Broadcast
from barrio.llm.common import Numbering, Store, blocks, texts

#: Bytes of text that are encoded together; distinct pieces, states and token pairs that a worker remembers.
BLOCK_BYTES = 6 << 20
PIECES, STATES, PAIRS = 200_000, 250_000, 400_000


def merge(ranks: dict[bytes, int], piece: bytes) -> tuple[list[int], int]:
    """The tokens of a short byte string by its merges in the order of ranks, the leftmost of equal ones first.

    The second result is the length of the left side of the last merge, 0 without any.
    """
    parts, cut = [piece[i:i + 1] for i in range(len(piece))], 0
    while len(parts) > 1:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            break
        at = min(found)[1]
        cut = len(parts[at])
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts], cut


class Ranks:
    """Tokens of a rank file and the tree of their bytes."""

    def __init__(self, content: bytes) -> None:
        lines = (line.split() for line in content.splitlines() if line)
        self.of = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.bytes_of = [b""] * (1 + max(self.of.values()))
        #: Node numbers by (node << 8 | byte); node 0 is the root.
        self.child: dict[int, int] = {}
        self.token_at: list[int | None] = [None]
        #: Nodes that longer tokens go through.
        self.inner = [True]
        for token, rank in self.of.items():
            self.bytes_of[rank] = token
            node = 0
            for b in token:
                step = node << 8 | b
                if step not in self.child:
                    self.child[step] = len(self.token_at)
                    self.token_at.append(None)
                    self.inner.append(False)
                    self.inner[node] = True
                node = self.child[step]
            self.token_at[node] = rank


class Neighbours:
    """Which tokens may follow each other: those whose bytes, merged together, give the two again.

    Up to a merge across their border, both sides are merged as each would be alone. The parts that touch the border are
    thus the spines of the two trees of merges: the last parts of the left token, the first parts of the right one, each
    there until the next is made. The next merge at the border is the one of lowest rank: of the left spine, of
    the right one, or across; of equal ranks the one further left.
    """

    def __init__(self, ranks: Ranks) -> None:
        self.of, self.bytes_of = ranks.of, ranks.bytes_of
        self.known: dict[tuple[int | None, int], bool] = {}
        self.cuts: dict[bytes, int | None] = {}
        self.plain: dict[bytes, bool] = {}
        self.spines: dict[tuple[int, bool], list[tuple[int, bytes]] | None] = {}

    def _cut(self, token: bytes) -> int | None:
        """Where the last merge of a token joins its sides; None if merges do not lead to the token."""
        if token not in self.cuts:
            made, cut = merge(self.of, token)
            self.cuts[token] = cut if len(made) == 1 else None
        return self.cuts[token]

    def _spine(self, rank: int, last: bool) -> list[tuple[int, bytes]] | None:
        """The last or first parts of a token in the order of making; None if merges do not go by rank alone."""
        if (rank, last) not in self.spines:
            part, out = self.bytes_of[rank], []
            while part:
                cut = self._cut(part)
                if cut is None:
                    break
                out.append((self.of[part] if cut else -1, part))
                part = (part[cut:] if last else part[:cut]) if cut else b""
            self.spines[rank, last] = None if part or not self._plain(rank) else out[::-1]
        return self.spines[rank, last]

    def may_follow(self, before: int | None, token: int) -> bool:
        """The second of two tokens may come next; without one before, merges lead to the token."""
        key = before, token
        found = self.known.get(key)
        if found is None:
            if len(self.known) > PAIRS:
                self.known.clear()
            found = self.known[key] = self._find(before, token)
        return found

    def _find(self, before: int | None, token: int) -> bool:
        if before is None:
            return self._cut(self.bytes_of[token]) is not None
        left, right = self._spine(before, True), self._spine(token, False)
        if left is None or right is None:
            return merge(self.of, self.bytes_of[before] + self.bytes_of[token])[0] == [before, token]
        i = j = 0
        none = len(self.bytes_of)
        while True:
            across = self.of.get(left[i][1] + right[j][1], none)
            up = left[i + 1][0] if i + 1 < len(left) else none
            down = right[j + 1][0] if j + 1 < len(right) else none
            if up <= across and up <= down and up < none:
                i += 1
            elif across <= down and across < none:
                return False
            elif down < none:
                j += 1
            else:
                return True

    def _plain(self, rank: int) -> bool:
        """Every part of the token is made after its own parts, so merges go by rank alone."""
        part = self.bytes_of[rank]
        if part not in self.plain:
            cut = self._cut(part)
            sides = (part[:cut], part[cut:]) if cut else ()
            self.plain[part] = cut is not None and all(
                (len(x) == 1 or self.of[x] < rank) and self._plain(self.of[x]) for x in sides
            )
        return self.plain[part]


#: A beginning: tokens put out before it but not by all (from the last shared one), and its node in the tree.
Beginning = tuple[tuple[int, ...], int]


class Transducer:
    """The deterministic transducer, made as far as the pieces so far need it.

    A state is a pair: the last token put out (None at the start) and the beginnings, each with the tokens it adds to it.
    """

    def __init__(self, ranks: Ranks) -> None:
        self.ranks, self.neighbours = ranks, Neighbours(ranks)
        self.child, self.token_at, self.inner = ranks.child.get, ranks.token_at, ranks.inner
        self.known = self.neighbours.known.get
        self.forget()

    def forget(self) -> None:
        self.number: dict[tuple[int | None, tuple[Beginning, ...]], int] = {}
        self.states: list[tuple[int | None, tuple[Beginning, ...]]] = []
        #: The next state and the tokens put out, by (state << 8 | byte); the tokens put out if the piece ends.
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}
        self.state(None, (((), 0),))

    def state(self, last: int | None, beginnings: tuple[Beginning, ...]) -> int:
        key = last, beginnings
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.states)
            self.states.append(key)
        return found

    def move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state, and the tokens that all beginnings left agree on."""
        last, beginnings = self.states[state]
        child, token_at, inner = self.child, self.token_at, self.inner
        done, left = None, []
        for added, node in beginnings:
            node = child(node << 8 | byte)
            if node is None:
                continue
            if done is None and (token := token_at[node]) is not None:
                before = added[-1] if added else last
                follows = self.known((before, token))
                if self.neighbours.may_follow(before, token) if follows is None else follows:
                    done = (*added, token)
            # The start of the piece is kept for one byte more, as the piece may be a token as a whole.
            if inner[node] or (last is None and not added):
                left.append((added, node))
        out = ()
        if not left:
            last, out, left = done[-1], done, [((), 0)]
        else:
            shared = 0
            if left[0][0]:
                shared = len(done)
                for added, _ in left:
                    upto = min(shared, len(added))
                    shared = 0
                    while shared < upto and added[shared] == done[shared]:
                        shared += 1
                    if not shared:
                        break
            left.append((done, 0))
            if shared:
                out = done[:shared]
                last, left = out[-1], [(added[shared:], node) for added, node in left]
        found = self.moves[state << 8 | byte] = self.state(last, tuple(left)), out
        return found

    def end(self, state: int) -> tuple[int, ...]:
        """The tokens still to be put out if the piece ends here."""
        last, beginnings = self.states[state]
        out = beginnings[-1][0]
        if last is None:
            added, node = beginnings[0]
            if not added and self.ranks.token_at[node] is not None:
                out = (self.ranks.token_at[node],)
        self.ends[state] = out
        return out

    def tokens(self, piece: bytes) -> list[int]:
        """The tokens of one piece, put out while its bytes are read."""
        if len(self.states) > STATES:
            self.forget()
        state, out, known = 0, [], self.moves.get
        for byte in piece:
            state, put = known(state << 8 | byte) or self.move(state, byte)
            if put:
                out += put
        out += self.ends.get(state) or self.end(state)
        return out


#: A character of each class that no other part of a pattern names, and a mark for the probe.
STAND_INS = {"L": "é", "N": "²", "": "§"}


def late_characters(pattern: str) -> dict[int, str]:
    """Characters that the library takes for another class than the regular expressions here, with a stand-in.

    The two follow different versions of Unicode. Only characters on which two versions at hand disagree are asked for: each
    is put after a character of a class, with a rank that merges the two if they are in one piece.
    """
    kind = regex.compile(r"(\p{L})|(\p{N})|(.)", regex.S)

    def here(c: str) -> str:
        return ("L", "N", "")[kind.match(c).lastindex - 1]

    asked = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]) if here(c) != (
        k if (k := unicodedata.category(c)[0]) in "LN" else "")]
    ranks = {bytes([b]): b for b in range(256)}
    for mark in "a1":
        ranks |= {mark.encode() + bytes([b]): len(ranks) + b for b in range(0x80, 0x100)}
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    out = {}
    for c in asked:
        there = next((k for mark, k in (("a", "L"), ("1", "N")) if probe(mark + c)[0] >= 256), "")
        if there != here(c):
            out[ord(c)] = STAND_INS[there]
    return out


class Encoder:
    """Encodes texts piece by piece; remembers pieces up to a limit."""

    def __init__(self, content: bytes, pattern: str, late: dict[int, str] | None = None) -> None:
        self.ranks = Ranks(content)
        self.transducer = Transducer(self.ranks)
        self.findall = regex.compile(pattern).findall
        self.late = late_characters(pattern) if late is None else late
        self.is_late = np.zeros(0x110000, bool)
        self.is_late[list(self.late)] = True
        self.first_late = min(self.late, default=0x110000)
        self.decoder = Decoder(self.ranks.bytes_of)
        self.known, self.store = Numbering(), Store(np.int32)
        #: How often each remembered piece was met since pieces were last forgotten.
        self.met = np.zeros(0, np.int64)

    def forget(self) -> None:
        """Forgets the pieces met once since the last time, and as many more as leave half the limit at most."""
        least = 2
        while np.count_nonzero(self.met >= least) > PIECES // 2:
            least *= 2
        keep, names = np.flatnonzero(self.met >= least), list(self.known)
        known, store = Numbering(), Store(np.int32)
        for number in keep.tolist():
            known[names[number]] = len(known)
        store.append(self.store.rows(keep), self.store.counts[keep])
        self.known, self.store, self.met = known, store, np.zeros(len(keep), np.int64)

    def has_late(self, text: str) -> bool:
        """A character of the text is one that the library takes for another class."""
        if text.isascii():
            return False
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return bool(points.max() >= self.first_late) and bool(self.is_late[points].any())

    def cut(self, text: str) -> list[str]:
        """The pieces of a text; tokens never cross them."""
        if not self.has_late(text):
            return self.findall(text)
        out, at = [], 0
        for piece in self.findall(text.translate(self.late)):
            out.append(text[at:at + len(piece)])
            at += len(piece)
        return out

    def encode(self, documents: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has."""
        if len(self.known) > PIECES:
            self.forget()
        numbers, lengths = [np.zeros(0, np.int32)], []
        for text in documents:
            pieces = self.cut(text)
            lengths.append(len(pieces))
            numbers.append(np.fromiter(map(self.known.__getitem__, pieces), np.int32, len(pieces)))
        fresh, self.known.fresh = self.known.fresh, []
        # States form no cycles; walking over all of them in search of some took a third of the time.
        gc.disable()
        rows = [self.transducer.tokens(p.encode()) for p in fresh]
        gc.freeze()
        gc.enable()
        counts = np.array([len(r) for r in rows], np.int64)
        self.store.append(np.fromiter(chain.from_iterable(rows), np.int64, int(counts.sum())), counts)
        which = np.concatenate(numbers)
        met = np.bincount(which, minlength=len(self.known))
        met[:len(self.met)] += self.met
        self.met = met
        upto = np.concatenate([[0], np.cumsum(self.store.counts[which])])
        ends = np.cumsum(np.array(lengths, np.int64))
        return self.store.rows(which), upto[ends] - upto[ends - np.array(lengths, np.int64)]


def utf8_moves() -> list[list[int]]:
    """Next states by state and byte: 0 between characters, -1 where no character can go on.

    States 1 to 3 wait for that many bytes of any continuation; 4 to 7 for one of a narrower range, after a lead byte
    whose wide range would allow overlong forms, surrogates or numbers beyond the last.
    """
    table = [[-1] * 256 for _ in range(8)]

    def allow(state: int, low: int, high: int, to: int) -> None:
        table[state][low:high + 1] = [to] * (high - low + 1)

    allow(0, 0x00, 0x7F, 0)
    allow(0, 0xC2, 0xDF, 1)
    allow(0, 0xE1, 0xEF, 2)
    allow(0, 0xF1, 0xF3, 3)
    for lead, state, low, high, to in (
        (0xE0, 4, 0xA0, 0xBF, 1), (0xED, 5, 0x80, 0x9F, 1), (0xF0, 6, 0x90, 0xBF, 2), (0xF4, 7, 0x80, 0x8F, 2),
    ):
        allow(0, lead, lead, state)
        allow(state, low, high, to)
    for state in (1, 2, 3):
        allow(state, 0x80, 0xBF, state - 1)
    return table


class Decoder:
    """Decodes tokens one by one; a character may stretch over several."""

    MOVES = utf8_moves()

    def __init__(self, bytes_of: list[bytes]) -> None:
        self.bytes_of = bytes_of
        #: Tokens of complete characters only, which need no state machine where none is waited for.
        self.closed = np.zeros(len(bytes_of), bool)
        for i, token in enumerate(bytes_of):
            state = 0
            for b in token:
                state = self.MOVES[max(state, 0)][b] if state >= 0 else state
            self.closed[i] = state == 0

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text that each token completes; a last one for what stays incomplete."""
        state, held = 0, bytearray()
        for i in ids:
            out = []
            for b in self.bytes_of[i]:
                after = self.MOVES[state][b]
                if after < 0 and held:
                    out.append("�")  # what was held is no character; the byte may begin one
                    held.clear()
                    after = self.MOVES[0][b]
                if after < 0:
                    out.append("�")
                    state = 0
                    continue
                held.append(b)
                state = after
                if state == 0:
                    out.append(held.decode())
                    held.clear()
            yield "".join(out)
        if held:
            yield "�"

    def text(self, ids: np.ndarray) -> str:
        """The text of all tokens; runs of tokens of complete characters are taken at once."""
        own, out, at = self.bytes_of, [], 0
        open_at = np.flatnonzero(~self.closed[ids])
        while at < len(ids):
            k = np.searchsorted(open_at, at)
            stop = int(open_at[k]) if k < len(open_at) else len(ids)
            out.append(b"".join([own[i] for i in ids[at:stop].tolist()]).decode())
            # From an open token on, until a closed one begins while nothing is held.
            at = stop
            while at < len(ids) and not self.closed[ids[at]]:
                at += 1
            out += self.stream(ids[stop:at].tolist())
        return "".join(out)


_WORKER: dict[int, Encoder] = {}


def _encoder(content: Broadcast, pattern: str, late: dict[int, str]) -> Encoder:
    """The worker's encoder for a broadcast rank file, kept from task to task."""
    key = hash((content.id, pattern))
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Encoder(content.value, pattern, late)
    return _WORKER[key]


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, the token ids of the text by a rank file, and the text decoded from them."""
    content, late = Broadcast(docs.sparkSession, path), late_characters(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content, pattern, late)
        for block in blocks(batches, BLOCK_BYTES):
            ids, counts = encoder.encode(texts(block.column(1)))
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            decoded = [encoder.decoder.text(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(decoded, pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, ids array<int>, decoded string")
