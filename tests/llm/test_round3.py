"""Byte-level BPE by a transducer, spelling variants and whitening, against tiktoken and brute force."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_operators import ODD, SCHEMA, rows

from barrio.llm import minhash, mixing, queries, rules, shards, spelling, transducer, whitening

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def library(path):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    with open(RANKS, "rb") as f:
        return transducer.Encoder(f.read(), PATTERN)


def strings(n):
    rnd = random.Random(4)
    pools = [
        [*map(chr, range(32, 127))], [*map(chr, range(0x600))], ["a", "b", " ", "  ", "\n", "aa"], ["the", "ing", " ", "tion", "'s", "'S"],
        [chr(c) for c in rnd.choices([*range(0xD800), *range(0xE000, 0x110000)], k=400)], list(" \t\n\r\x0b\x1c\x1f\x85 　​"),
        [chr(c) for c in (0x558, 0xA7CE, 0x1C89, 0x11DE0, 0x32000)] + ["a", "1", " "],
    ]
    return ["".join(rnd.choice(pool) for _ in range(rnd.randrange(150))) for pool in pools for _ in range(n)]


def cut(ids, counts):
    ends = np.cumsum(counts)
    return [ids[e - c:e].tolist() for e, c in zip(ends, counts)]


def test_transducer_equals_library(encoder):
    lib, texts = library(RANKS), [*strings(150), *[t or "" for t in ODD], "x" * 50_000, " " * 3000 + "aé" * 9000]
    for text, got in zip(texts, cut(*encoder.encode(texts))):
        assert got == lib.encode_ordinary(text), text[:100]
        assert encoder.decoder.text(np.array(got, int)) == text


def test_transducer_with_merges_out_of_order():
    # Tokens that no merges lead to, and parts ranked after what they make.
    rnd = random.Random(8)
    for _ in range(60):
        tokens = {bytes([b]) for b in range(256)} | {
            bytes(rnd.choice(b"abc") for _ in range(rnd.randint(2, 6))) for _ in range(rnd.randint(3, 40))}
        order = sorted(tokens, key=lambda t: (len(t) > 1, rnd.random()))
        content = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(order))
        lib = tiktoken.Encoding("odd", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(order)}, special_tokens={})
        own = transducer.Encoder(content, PATTERN, {})
        texts = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 30))) for _ in range(60)]
        for text, got in zip(texts, cut(*own.encode(texts))):
            assert got == lib.encode_ordinary(text), (text, order[256:])


def test_transducer_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(transducer, "PIECES", 20)
    monkeypatch.setattr(transducer, "STATES", 30)
    monkeypatch.setattr(transducer, "PAIRS", 10)
    with open(RANKS, "rb") as f:
        own = transducer.Encoder(f.read(), PATTERN, {})
    lib, texts = library(RANKS), strings(15)[:60]
    for text in texts:
        assert cut(*own.encode([text])) == [lib.encode_ordinary(text)]


def test_tokens_come_out_after_bounded_lookahead(encoder):
    machine = encoder.transducer
    state, put, longest = 0, 0, max(map(len, encoder.ranks.of))
    for i, byte in enumerate(b"ab" * 400):
        state, out = machine.moves.get(state << 8 | byte) or machine.move(state, byte)
        put += sum(len(encoder.ranks.bytes_of[t]) for t in out)
        assert i + 1 - put <= 3 * longest


def test_streaming_decode(encoder):
    rnd = random.Random(2)
    single = {t: i for i, t in enumerate(encoder.ranks.bytes_of) if len(t) == 1}
    for _ in range(3000):
        data = bytes(rnd.choice(b"a\x80\xbf\xc2\xc0\xe0\xa0\xed\x9f\xe2\x82\xac\xf0\x9f\x8e\x89\xf4\x90\xff") for _ in range(rnd.randint(0, 9)))
        ids = [single[bytes([b])] for b in data]
        want = data.decode("utf-8", "replace")
        assert "".join(encoder.decoder.stream(ids)) == want
        assert encoder.decoder.text(np.array(ids, int)) == want
    euro = [single[bytes([b])] for b in "€x".encode()]
    assert list(encoder.decoder.stream(euro)) == ["", "", "€", "x"]


def test_byte_bpe_query(docs):
    lib, texts = library(RANKS), {r[0]: r[1] or "" for r in rows()}
    got = queries.op11(docs).collect()
    assert len(got) == len(rows())
    for r in got:
        ids = lib.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode_bytes(ids)).hexdigest()


def within_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def variants_brute(table):
    counts = Counter()
    for doc_id, text in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}
    near = {w: [v for v in counts if within_one(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def misspelt(seed, n_docs=150):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdeéÿß") for _ in range(rnd.randint(5, 9))) for _ in range(25)]
    base[2:2] = ["x" * 120, "x" * 119 + "y", "q" * 65, "q" * 64]
    table = []
    for i in range(n_docs):
        words = []
        for _ in range(60):
            w = base[min(int(rnd.expovariate(0.25)), len(base) - 1)]
            if rnd.random() < 0.2:
                at = rnd.randrange(len(w))
                w = rnd.choice([w[:at] + w[at + 1:], w[:at] + "a" + w[at + 1:], w[:at] + "b" + w[at:]])
            words.append(rnd.choice([w, w, w.upper(), w.capitalize()]))
        table.append((i, rnd.choice([" ", "-", "1"]).join(words)))
    return table + [(None, table[0][1]), (3, None), (4, ""), table[5], table[5]]


@pytest.mark.parametrize("symbols", [None, 1, 26])
def test_spelling_against_brute_force(spark, monkeypatch, symbols):
    if symbols:
        monkeypatch.setattr(spelling, "alphabet", lambda size: symbols)
    monkeypatch.setattr(spelling, "WORDS", 50)
    table = misspelt(1)
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in table], "doc_id bigint, text string, word string, id string").repartition(4)
    got = {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in queries.op12(df).collect()}
    want = variants_brute(table)
    assert got == want
    assert any(r[1] for r in want) and any(len(r[0]) > spelling.LONG and r[4] for r in want)


def test_spelling_chain(spark):
    words = [("abcdefgh", 5 ** 4), ("abcdefg", 5 ** 3), ("abcdefx", 25), ("abcdexx", 5)]
    text = " ".join(" ".join([w] * n) for w, n in words)
    doc = next(i for i in range(10_000) if all(zlib.crc32(f"{i}:{w}".encode()) % 199 for w, _ in words))
    df = spark.createDataFrame([(doc, text)], "doc_id bigint, text string")
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.variants(df).collect()}
    assert got["abcdexx"] == ("abcdefx", "abcdefgh") and got["abcdefx"] == ("abcdefg", "abcdefgh")
    assert got["abcdefgh"] == (None, "abcdefgh")


def whiten_brute(table):
    good = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in table
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, d = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(d)]
    off = [[Fraction(n * x[k] - s[k], n) for k in range(d)] for x in fit]
    cov = np.array([[float(sum(o[i] * o[j] for o in off) / n) for j in range(d)] for i in range(d)])
    deviation = Counter((i, sum((n * x[k] - s[k]) ** 2 for k in range(d))) for i, x in good)
    return good, n, s, cov, deviation


def embeddings(seed, n=300, d=20, scale=0.3):
    rnd = np.random.default_rng(seed)
    mix = rnd.normal(size=(d, d)) * scale
    table = [(i, [float(np.float32(c)) for c in rnd.normal(size=d) @ mix]) for i in range(n)]
    table += [(n, None), (n + 1, [None] + [0.0] * (d - 1)), (n + 2, [float("nan")] * d), (n + 3, [float("inf")] + [0.0] * (d - 1))]
    return table + [(n + 4, table[0][1]), (n + 4, table[0][1]), (None, table[1][1]), (n + 5, [1.0])]


@pytest.mark.parametrize("scale", [0.3, 3e6])
def test_whitening_against_exact_fractions(spark, scale):
    table = embeddings(5, scale=scale)
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in table], "vec_id bigint, embedding array<float>, n int, component int")
    got = whitening.whiten(df.repartition(3)).collect()
    good, n, s, cov, deviation = whiten_brute([r for r in table if r[0] != 305])
    assert len(got) == 16 * len(good)
    assert Counter((r["vec_id"], int(r["deviation"])) for r in got) == Counter({k: 16 * v for k, v in deviation.items()})
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    by_id = {i: np.array([float(Fraction(n * c - t, n)) for c, t in zip(x, s)]) for i, x in good}
    white = {}
    for r in got:
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-9
        white.setdefault(r["component"], {})[r["vec_id"]] = r["whitened"]
    for k, found in white.items():
        # The same direction for all rows, and an eigenvector of the brute-force matrix.
        x, w = np.array([by_id[i] for i in found]), np.array(list(found.values()))
        v = np.linalg.lstsq(x, w * np.sqrt(values[k - 1]), rcond=None)[0]
        assert abs(np.linalg.norm(v) - 1) < 1e-6 and np.abs(cov @ v - values[k - 1] * v).max() < 1e-6 * values[0]
        assert np.abs(x @ v / np.sqrt(values[k - 1]) - w).max() < 1e-6


@pytest.mark.parametrize("table,count", [
    ([], 0), ([(1, None)], 0), ([(1, [1.0, 2.0])], 0), ([(1, [1.0, 2.0]), (2, [1.0, 2.0])], 0),
    ([(1, [1.0, 2.0]), (2, [3.0, 2.0])], 2), ([(1, [1e30, 2.0]), (2, [3.0, 2.0])], 2), ([(1, []), (2, [])], 0),
])
def test_whitening_of_few_rows(spark, table, count):
    got = whitening.whiten(spark.createDataFrame(table, "vec_id bigint, embedding array<double>")).collect()
    assert len(got) == count and all(abs(abs(r["whitened"]) - 1) < 1e-9 for r in got)


def test_whitening_query(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    got = queries.QUERIES["op13_whitening"](spark, data)
    assert dict(got.dtypes)["deviation"] == "bigint"
    top = got.agg(F.count("*"), F.max("identity_error"), F.count("deviation")).first()
    assert top[0] == top[2] == 16 * rows.count() and top[1] < 1e-6


def test_mixture_with_null_and_repeated_ids(spark):
    rnd = random.Random(6)
    table = [(None if i % 2 else 7, " ".join(rnd.choice("abcdefgh") * 3 for _ in range(10)) + f" {i}", "s1") for i in range(1800)]
    table += [(i, "one two three four", "s2") for i in range(3000)]
    df = spark.createDataFrame(table, "doc_id bigint, text string, source string").repartition(4)
    got = mixing.mixture(df).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert len(got) == 2 and all(abs(r["taken"] - r["target"]) < 0.01 * r["target"] for r in got)


def test_shards_keep_their_law(spark, monkeypatch):
    monkeypatch.setattr(shards, "BLOCK_ROWS", 20)
    rnd = random.Random(9)
    table = [(rnd.choice([None, 5, i]), rnd.choice(["", "é", None, f"text {i}"])) for i in range(3000)]
    df = spark.createDataFrame(table, "doc_id bigint, text string").repartition(4)
    got = shards.shard(df).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in table)
    assert {r["law"] for r in got} == {"key"} and {r["shard"] for r in got} <= set(range(24))
    slots, place = {}, {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        # The id alone decides, and one more shard only takes rows into itself.
        assert place.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_near_duplicates_with_null_and_repeated_ids(spark):
    rnd = random.Random(12)
    words = [" ".join(rnd.choice("abcdefghij") + rnd.choice("klmnop") for _ in range(60)) for _ in range(3)]
    table = [(1, words[0]), (1, words[1]), (2, words[0] + " end"), (None, words[0]), (None, words[2]), (4, words[2]), (4, words[2]), (5, None), (6, "")]
    got = minhash.near_classes(spark.createDataFrame(table, "doc_id bigint, text string")).collect()
    assert len(got) == len(table)
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert of[1] == of[2] == {1} and of[4] == {4} and 4 in of[None] and of[5] == of[6] == {5}


def test_rules_remove_lines_above_the_limits(spark):
    rnd = random.Random(3)
    own = [" ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(60)) for _ in range(60)]
    table = [(i, f"Menu line \n{t}\n\nmenu LINE", "h1") for i, t in enumerate(own)] + [(100, f"menu line\n{own[0]}", None)]
    df = spark.createDataFrame(table, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r["text"] for r in rules.keep_good(df).collect()}
    assert got == {i: f"{t}\n" for i, t in enumerate(own)} | {100: f"menu line\n{own[0]}"}
