"""Language identification by interpolated Kneser-Ney character models, one per language.

A text's letters are lower-cased and cut into words. A model gives the probability of each letter of a word, and of its end, after
the three before it. Four-letter counts are gathered from every labelled document; lower orders count in how
many different contexts a letter follows (Kneser-Ney), and every order is interpolated with the next lower one,
the last one with a uniform share.

A model is stored as sorted arrays of 64-bit hashes: of grams with their log probability and of contexts
with the log weight of the lower order. The language with the lowest cross-entropy per letter wins, the
first in code-point order of equals. A text is `rejected` if its cross-entropy lies more than `DEVIATIONS` standard deviations
above the mean of its language's own documents, measured on all that were learned from and
are recognised.

Scale. Every gram is kept. Counts, continuation counts, discounts and probabilities are group-bys and joins on language and
gram; the driver sees none of them. The hashed tables lie in the shared folder, and each worker reads them once, so they
grow with the distinct grams of the corpus. Counting combines in each task before the shuffle. Workers remember the
scores of words up to a limit.

Defined cases: null texts and texts without a letter get `und`, score 0 and are not rejected; rows without a language are not learned from;
a null id counts as the empty text in the checksum; an empty input gives an empty result; if nothing
can be learned every text gets `und`.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import regex
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barrio.llm.common import Numbering, blocks, texts
from barrio.llm.minhash import mixed
from barrio.session import materialise, new_path

ORDER = 4
DEVIATIONS = 5.0
UNKNOWN = "und"

BEGIN, END = "\x02", "\x03"
BLOCK_BYTES = 8 << 20
WORDS = 400_000
#: Share of the alphabet that a letter never seen gets.
UNIFORM = 1e-5

_WORDLIKE = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")


def words(text: str) -> list[str]:
    """Runs of letters, lower case."""
    found = _WORDLIKE.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for f in found for w in ([f] if f.isalpha() else _LETTERS.findall(f))]


def held_out(doc_id: Column) -> Column:
    """Fixed by the contract: these documents are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


# ---- model ----------------------------------------------------------------------------------------

def hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n symbols that end at each place from n - 1 on."""
    h = np.full(len(codes) - n + 1, np.uint64(n))
    for k in range(n):
        h = mixed(h ^ codes[k:len(codes) - n + 1 + k].astype(np.uint64))
    return h


def _find(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, values = table
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return keys[at] == h, values[at]


def log_probabilities(tables, grams: list[tuple]) -> np.ndarray:
    """Log probability of the last symbol of each place, from its (gram, context) hashes of order 1 to ORDER."""
    out = np.zeros(len(grams[0][0]), np.float32)
    open_places = np.arange(len(out))
    for n in range(ORDER, 0, -1):
        (gram_table, context_table) = tables[n - 1]
        found, value = _find(gram_table, grams[n - 1][0][open_places])
        out[open_places[found]] += value[found]
        open_places = open_places[~found]
        if not len(open_places):
            break
        if n > 1:
            seen, weight = _find(context_table, grams[n - 1][1][open_places])
            out[open_places] += np.where(seen, weight, 0)
        else:
            out[open_places] += context_table[1][0] + math.log(UNIFORM)
    return out


class Scorer:
    """Cross-entropies of texts under every model; remembers words up to a limit."""

    def __init__(self, models: dict[str, list]) -> None:
        self.languages = sorted(models)
        self.models = [models[x] for x in self.languages]
        self.forget()

    def forget(self) -> None:
        self.known = Numbering()
        self.scores = np.zeros((0, len(self.languages)), np.float32)
        self.lengths = np.zeros(0, np.int64)

    def _learn(self) -> None:
        fresh, self.known.fresh = self.known.fresh, []
        if not fresh:
            return
        lengths = np.array([len(w) + 1 for w in fresh])
        joined = "".join([BEGIN * (ORDER - 1) + w + END for w in fresh])
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(lengths + ORDER - 1)
        places = np.arange(len(codes)) - np.repeat(ends - lengths - ORDER + 1, lengths + ORDER - 1)
        at = np.flatnonzero(places >= ORDER - 1)
        grams = []
        for n in range(1, ORDER + 1):
            context = hashes(codes, n - 1)[at - (n - 1)] if n > 1 else None
            grams.append((hashes(codes, n)[at - (n - 1)], context))
        starts = np.cumsum(lengths) - lengths
        scores = [np.add.reduceat(log_probabilities(m, grams), starts) for m in self.models]
        self.scores = np.concatenate([self.scores, np.stack(scores, axis=1)])
        self.lengths = np.concatenate([self.lengths, lengths])

    def score(self, documents: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language, posterior among the languages and cross-entropy per letter of each text."""
        if len(self.known) > WORDS:
            self.forget()
        number = self.known.__getitem__
        rows = []
        for text in documents:
            found = words(text)
            rows.append(np.fromiter(map(number, found), np.int32, len(found)))
        self._learn()
        names, posterior, entropy = [], [], []
        for row in rows:
            if not len(row) or not self.languages:
                names.append(UNKNOWN)
                posterior.append(0.0)
                entropy.append(0.0)
                continue
            total = self.scores[row].sum(axis=0, dtype=np.float64)
            best = int(total.argmax())
            names.append(self.languages[best])
            posterior.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
            entropy.append(float(-total[best] / self.lengths[row].sum()))
        return names, posterior, entropy


# ---- Spark ----------------------------------------------------------------------------------------

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four-letter counts of what one task reads, by language; given out when they grow large."""
    seen: dict[str, Counter] = defaultdict(Counter)

    def given() -> pa.RecordBatch:
        grams: Counter = Counter()
        for lang, counted in seen.items():
            for word, n in counted.items():
                padded = BEGIN * (ORDER - 1) + word + END
                for k in range(len(padded) - ORDER + 1):
                    grams[lang, padded[k:k + ORDER]] += n
        seen.clear()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x for x, _ in grams], pa.string()), pa.array([g for _, g in grams], pa.string()),
                pa.array(list(grams.values()), pa.int64()),
            ],
            ["lang", "gram", "n"],
        )

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            seen[lang].update(words(text))
        if sum(map(len, seen.values())) > WORDS:
            yield given()
    yield given()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each gram, or of each context, in place of its letters."""
    for batch in batches:
        found = batch.column(2).to_pylist()
        h = np.zeros(len(found), np.uint64)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            codes = np.frombuffer("".join([found[i] for i in at]).encode("utf-32-le"), np.uint32).reshape(len(at), n)
            h[at] = np.uint64(n)
            for k in range(n):
                h[at] = mixed(h[at] ^ codes[:, k].astype(np.uint64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(h.view(np.int64)), batch.column(3)], ["lang", "slot", "h", "value"],
        )


def kneser_ney(counts: DataFrame) -> list[DataFrame]:
    """Rows lang, slot, letters, value from four-letter counts (lang, gram, n).

    Slot 2 n holds the log probabilities of grams of n letters, slot 2 n + 1 the log weights of their contexts.
    """
    by_order = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        # In how many contexts, one symbol longer, a gram is seen.
        by_order[n] = materialise(by_order[n + 1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(
            F.count("*").alias("n"),
        ), "lang-counts")
    lower, out = None, []
    for n in range(1, ORDER + 1):
        ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discounts = by_order[n].groupBy(F.col("lang").alias("d_lang")).agg(
            F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(F.lit(0.75)).alias("d"),
        )
        grams = by_order[n].withColumn("context", F.expr(f"substring(gram, 1, {n - 1})"))
        contexts = grams.groupBy(F.col("lang").alias("c_lang"), F.col("context").alias("c_context")).agg(
            F.sum("n").alias("total"), F.count("*").alias("kinds"),
        ).join(discounts, F.col("c_lang") == F.col("d_lang"))
        contexts = materialise(contexts.select(
            "c_lang", "c_context", "total", "d", F.greatest(F.col("d") * F.col("kinds") / F.col("total"), F.lit(1e-9)).alias("weight"),
        ), "lang-contexts")
        rows = grams.join(contexts, (F.col("lang") == F.col("c_lang")) & (F.col("context") == F.col("c_context")))
        below = F.lit(UNIFORM)
        if n > 1:
            short = lower.select(F.col("lang").alias("l_lang"), F.col("gram").alias("l_gram"), F.col("p").alias("below"))
            rows = rows.join(short, (F.col("lang") == F.col("l_lang")) & (F.expr("substring(gram, 2)") == F.col("l_gram")))
            below = F.col("below")
        p = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("weight") * below
        lower = materialise(rows.select("lang", "gram", p.alias("p")), "lang-grams")
        out.append(lower.select(
            "lang", F.lit(2 * n).alias("slot"), F.col("gram").alias("letters"),
            F.log(F.greatest("p", F.lit(1e-12))).cast("float").alias("value"),
        ))
        out.append(contexts.select(
            F.col("c_lang").alias("lang"), F.lit(2 * n + 1).alias("slot"), F.col("c_context").alias("letters"),
            F.log("weight").cast("float").alias("value"),
        ))
    return out


def learn(docs: DataFrame) -> str:
    """Where the models of all languages lie, from the documents that are not held out."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("lang", "text")
    counts = known.mapInArrow(_count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    tables = kneser_ney(materialise(counts, "lang-counts"))
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.unionByName(more)
    path = new_path(docs.sparkSession, "lang-models")
    rows.mapInArrow(_hashed, "lang string, slot int, h bigint, value float").write.parquet(path)
    return qualified(docs.sparkSession, path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the file system it belongs to."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()


def load(path: str) -> dict[str, list]:
    """The models that `learn` wrote: per language and order (gram hashes, log probabilities), (context hashes, log weights)."""
    if path.startswith("file:"):
        system, path = fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    else:
        system, path = fs.FileSystem.from_uri(path)
    table = pq.read_table(path, filesystem=system, read_dictionary=["lang"]).unify_dictionaries().combine_chunks()
    if not table.num_rows:
        return {}
    lang = table["lang"].chunk(0)
    codes, slot = lang.indices.to_numpy(), table["slot"].to_numpy()
    h, value = table["h"].to_numpy().view(np.uint64), table["value"].to_numpy()
    order = np.lexsort((h, slot, codes))
    codes, slot, h, value = codes[order], slot[order], h[order], value[order]
    cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(slot) != 0)) + 1
    starts, ends = [0, *cuts], [*cuts, len(h)]
    found: dict[str, dict] = defaultdict(dict)
    for a, b in zip(starts, ends):
        found[lang.dictionary[int(codes[a])].as_py()][int(slot[a])] = h[a:b], value[a:b]
    return {x: [(t[2 * n], t[2 * n + 1]) for n in range(1, ORDER + 1)] for x, t in found.items()}


_WORKER: dict[str, Scorer] = {}


def _scorer(path: str) -> Scorer:
    """The worker's scorer for the models at a path, kept from task to task."""
    if path not in _WORKER:
        _WORKER.clear()
        _WORKER[path] = Scorer(load(path))
    return _WORKER[path]


def _scored(docs: DataFrame, models: str) -> DataFrame:
    """The rows of (doc_id, lang, text) with prediction and cross-entropy instead of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(models)
        for block in blocks(batches, BLOCK_BYTES):
            found = scorer.score(texts(block.column(2)))
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0), block.column(1), pa.array(found[0], pa.string()), pa.array(found[1], pa.float64()),
                    pa.array(found[2], pa.float64()),
                ],
                ["doc_id", "lang", "predicted", "score", "entropy"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, lang string, predicted string, score double, entropy double"
    return docs.select("doc_id", "lang", "text").mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy and rejected, one row per document."""
    models = learn(docs)
    # Every text is scored once; the limits come from all labelled ones that were learned from.
    labelled = docs.withColumn("lang", F.when(F.col("text").isNotNull(), F.col("lang")))
    scored = materialise(_scored(labelled, models), "scored")
    own = scored.where(~held_out(F.col("doc_id")) & (F.col("lang") == F.col("predicted")))
    measured = own.groupBy("lang").agg(
        F.mean("entropy").alias("mean"), F.coalesce(F.stddev("entropy"), F.lit(0.0)).alias("deviation"),
    ).collect()
    limits = {r["lang"]: r["mean"] + DEVIATIONS * max(r["deviation"], 0.05) for r in measured}
    limit = F.lit(None).cast("double")
    if limits:
        limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("predicted")]
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("predicted").alias("lang_pred"), "score", "entropy",
        F.coalesce(F.col("entropy") > limit, F.lit(False)).alias("rejected"),
    )
