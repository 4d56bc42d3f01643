"""Token counts by prefix dynamic programming.

For a BPE vocabulary every prefix of a text has exactly one last token, and it can stand behind
the last token of the shorter prefix before it. Going through a text once, the last token and the
number of tokens of every prefix follow from those of shorter prefixes:

    count(j) = count(i) + 1, where the token text[i:j] may stand behind the last token of text[:i].

Two tokens may stand side by side if merging their joined letters gives these two again. Answers are
remembered by pair. A character without a token counts one token per UTF-8 byte.

The counts at every prefix answer truncation and budget questions without encoding again: `fit_chars` is the
longest prefix of a text that has at most `limit` tokens.

Tokens never cross the start of a run of blanks or characters that are tokens by themselves only, so a text is cut
there and the counts of distinct segments are remembered by the worker, up to a limit.

Defined cases: null counts as empty and has no tokens; strings like `<s>` in a text are plain characters; a
text is handled whole; null ids are carried along; an empty input gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barrio.llm.bpe import Broadcast
from barrio.llm.common import Numbering, Store, blocks, texts

#: Fixed by the vocabulary: the sign for a blank, which also stands before every text.
BLANK = "▁"

BLOCK_BYTES = 12 << 20
SEGMENTS = 500_000
UNKNOWN = -2


class Pieces:
    """The tokens of a vocabulary and which may stand side by side."""

    def __init__(self, content: bytes) -> None:
        model = sentencepiece.SentencePieceProcessor(model_proto=content)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        tokens = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not special(i)}
        self.score = {t: model.get_score(i) for t, i in tokens.items()}
        self.names = {i: t for t, i in tokens.items()}
        #: Every beginning of a token: its id, or UNKNOWN if it is none itself.
        self.begins = {t[:k]: UNKNOWN for t in tokens for k in range(1, len(t))} | tokens
        inside = {c for t in tokens if len(t) > 1 for c in t}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in inside)
        # What the cuts and the walk below rest on.
        assert not any(BLANK in t.lstrip(BLANK) for t in tokens) and inside <= tokens.keys()
        self.cut = re.compile(f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+|[{alone}]")
        self.beside: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    def merge(self, text: str) -> list[str]:
        """Plain merging: the best adjacent pair first, the left one of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_start(self, token: int) -> bool:
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merge(self.names[token]) == [self.names[token]]
        return known

    def may_follow(self, left: int, token: int) -> bool:
        if left == UNKNOWN:
            return self.may_start(token)
        key = left << 20 | token
        known = self.beside.get(key)
        if known is None:
            a, b = self.names[left], self.names[token]
            known = self.beside[key] = self.merge(a + b) == [a, b]
        return known

    def prefix_counts(self, segment: str) -> list[int]:
        """The number of tokens of every prefix but the empty one."""
        n = len(segment)
        last: list[int | None] = [UNKNOWN] + [None] * n
        count = [0] * (n + 1)
        begins, may_follow = self.begins, self.may_follow
        for i in range(n):
            left = last[i]
            token = begins.get(segment[i])
            if token is None:
                last[i + 1] = UNKNOWN
                count[i + 1] = count[i] + len(segment[i].encode())
                continue
            j = i + 1
            while token is not None:
                if token >= 0 and last[j] is None and may_follow(left, token):
                    last[j], count[j] = token, count[i] + 1
                j += 1
                if j > n:
                    break
                token = begins.get(segment[i:j])
        return count[1:]


class Counter:
    """Counts texts; remembers segments up to a limit."""

    def __init__(self, content: bytes) -> None:
        self.pieces = Pieces(content)
        self.forget()

    def forget(self) -> None:
        self.known, self.store, self.totals = Numbering(), Store(np.int32), np.zeros(0, np.int64)

    def count(self, documents: list[str], limit: int) -> tuple[list[int], list[int]]:
        """Per text its tokens, and the characters of its longest prefix with at most `limit` tokens."""
        if len(self.known) > SEGMENTS:
            self.forget()
        if len(self.pieces.beside) > 4 * SEGMENTS:
            self.pieces.beside.clear()
        cut, number = self.pieces.cut.findall, self.known.__getitem__
        rows = []
        for text in documents:
            segments = cut(BLANK + text.replace(" ", BLANK)) if text else []
            rows.append(np.fromiter(map(number, segments), np.int32, len(segments)))
        fresh, self.known.fresh = self.known.fresh, []
        counts = [self.pieces.prefix_counts(s) for s in fresh]
        self.store.append(
            np.array([x for c in counts for x in c], np.int32), np.array([len(c) for c in counts], np.int64),
        )
        self.totals = np.concatenate([self.totals, np.array([c[-1] for c in counts], np.int64)])
        tokens = [int(self.totals[r].sum()) for r in rows]
        fits = [len(t) if n <= limit else self.fit(r, limit) for t, r, n in zip(documents, rows, tokens)]
        return tokens, fits

    def prefixes(self, row: np.ndarray) -> np.ndarray:
        """Token counts of all prefixes of a text of these segments, the empty one first."""
        totals = self.totals[row]
        base = np.repeat(np.cumsum(totals) - totals, self.store.counts[row])
        # The first count is that of the blank before the text.
        return np.concatenate([[0], (base + self.store.rows(row))[1:]])

    def fit(self, row: np.ndarray, limit: int) -> int:
        return int(np.flatnonzero(self.prefixes(row) <= limit)[-1])


_WORKER: dict[int, Counter] = {}


def _counter(content: Broadcast) -> Counter:
    if content.id not in _WORKER:
        _WORKER.clear()
        _WORKER[content.id] = Counter(content.value)
    return _WORKER[content.id]


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_chars, one row per document."""
    content = Broadcast(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(content)
        for block in blocks(batches, BLOCK_BYTES):
            found = texts(block.column(1))
            tokens, fits = counter.count(found, limit)
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0), pa.array([len(t.encode()) for t in found], pa.int64()),
                    pa.array(tokens, pa.int64()), pa.array(fits, pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "fit_chars"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, fit_chars bigint"
    counted = docs.select("doc_id", "text").mapInArrow(run, schema)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars")
