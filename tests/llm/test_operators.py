"""Every operator on a small table of odd rows, against brute force or the tokenizer libraries."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import compare
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from barrio.llm import bpe, exact, language, lines, minhash, mixing, queries, rules, shards, suffixes, tokens

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, size string"
RND = random.Random(5)
WORDS = ["".join(RND.choice("abcdefghijk") for _ in range(RND.randint(2, 8))) for _ in range(400)]
ODD = [
    None, "", " ", "\n\n", "a b", "ß É 日本 🎉", "<|endoftext|> x <s>", "Same\nSame\nSame", "AbC", "aBc", "x " * 400,
    "1234 | # $ %", "\t\r\x0b tab", "éa" * 300, "word " * 3 + "\n" + "word " * 3,
]


def prose(n, rnd):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def rows():
    rnd = random.Random(7)
    base = prose(120, rnd)
    near = base.split(" ")
    near[60] = "changed"
    texts = [*ODD, base, " ".join(near), base, prose(90, rnd) + " " + base[:300], prose(5000, rnd)]
    texts += [f"{prose(60, rnd)}\ncommon line here\n{prose(30, rnd)}" for _ in range(30)]
    sources = [None, "s1", "s2"]
    out = [(i, t, ("en", "fr", None)[i % 3], sources[i % 3], None, "clash", "clash") for i, t in enumerate(texts)]
    # Rows that repeat, and a null id.
    return [*out, out[15], out[15], (None, base, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_token_counts(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = tokens.token_counts(docs, PIECES, 50).collect()
    texts = {r[0]: r[1] or "" for r in rows()}
    assert len(got) == len(rows())
    for r in got:
        text = texts[r.doc_id]
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(model.encode(text)))
        assert r.over_limit == (r.n_tokens > 50)
        assert len(model.encode(text[:r.fit_chars])) <= 50
        if r.over_limit:
            assert all(len(model.encode(text[:r.fit_chars + k])) > 50 for k in range(1, 20))


def test_bpe(docs):
    library = Tokenizer.from_file(BYTES)
    texts = {r[0]: r[1] or "" for r in rows()}
    got = bpe.encode_decode(docs, BYTES).collect()
    assert len(got) == len(rows())
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_bpe_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 10)
    library, encoder = Tokenizer.from_file(BYTES), bpe.Encoder(bpe.Vocabulary(open(BYTES, "rb").read()))
    for text in [prose(50, RND), "aaaa" * 50, prose(50, RND)]:
        ids, counts = encoder.encode([text, text])
        assert ids[:counts[0]].tolist() == library.encode(text).ids


def test_quality_counts(docs):
    got = sorted(rules.quality(docs).collect(), key=str)
    assert len(got) == len(rows())
    texts = {r[0]: r[1] or "" for r in rows()}
    for r in got:
        text, found = texts[r.doc_id], words(texts[r.doc_id])
        windows = [tuple(found[i:i + 3]) for i in range(len(found) - 2)]
        twice = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(3)}
        full = [x for x in text.split("\n") if words(x)]
        assert r.n_words == len(found) and r.word_chars == sum(map(len, found))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert r.n_dup_lines == len(full) - len(set(full)) and r.n_repeat_words == len(covered)
        assert r.base_failed == (len(found) < 50 or 100 * len(covered) > 50 * len(found))
        assert not r.kept or not r.base_failed


def test_quality_rejects_depleted_documents(spark):
    shared = "\n".join(f"boiler plate line number {k} of the footer of this host and more words" for k in range(6))
    table = [(i, f"{shared}\nonly {i}", None, "h", None, "", "") for i in range(80)]
    table += [(100 + i, prose(80, RND), None, "h", None, "", "") for i in range(5)]
    got = {r.doc_id: r.kept for r in rules.quality(spark.createDataFrame(table, SCHEMA)).collect()}
    assert not any(got[i] for i in range(80)) and all(got[100 + i] for i in range(5))
    # Copies of one text are one document.
    copies = [(i, shared, None, "h", None, "", "") for i in range(80)]
    assert not any(r.depleted for r in rules.quality(spark.createDataFrame(copies, SCHEMA)).collect())


def test_suffix_array_and_windows():
    for n, k in [(1, 1), (40, 1), (60, 2), (200, 3), (3000, 4), (3000, 500)]:
        text = np.array([RND.randint(1, k) for _ in range(n)] + [0])
        text = np.unique(text, return_inverse=True)[1]
        assert suffixes.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


@pytest.mark.parametrize("many", [4096, 1])
def test_repeats(docs, monkeypatch, many):
    monkeypatch.setattr(suffixes, "MANY", many)
    table = [(r[0], (r[1] or "").encode()) for r in rows()]
    seen = Counter(t[i:i + 200] for _, t in table for i in range(len(t) - 199))
    want = Counter()
    for i, t in table:
        gone = [False] * len(t)
        for k in range(len(t) - 199):
            if seen[t[k:k + 200]] > 1:
                gone[k:k + 200] = [True] * 200
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want[i, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)] += 1
    got = Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffixes.remove_repeats(docs).collect())
    assert got == want


def test_mixture_meets_targets(docs):
    got = mixing.mixture(docs).collect()
    assert len(got) == len(rows()) and all(r.taken <= 2 * r["size"] for r in got)
    sources = {r[0]: r[3] for r in rows()}
    by = defaultdict(list)
    for r in got:
        by[sources[r.doc_id]].append(r)
    total = sum(r["size"] for r in got)
    assert abs(sum(x[0].target for x in by.values()) - 1.5 * total) < 1e-6
    for x in by.values():
        taken = sum(r.taken for r in x)
        assert x[0].target - max(r["size"] for r in x) * 3 <= taken <= x[0].target + 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixture(docs).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(r.taken for r in got)


def shares(sizes):
    """Targets by sharing the excess again and again; sources in order, null last."""
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {x: (3, 1, 2)[i % 3] for i, x in enumerate(order)}
    target, free, rest = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        level = rest / sum(weight[x] for x in free)
        full = {x for x in free if level * weight[x] > 2 * sizes[x]}
        if not full:
            return target | {x: level * weight[x] for x in free}
        target |= {x: 2.0 * sizes[x] for x in full}
        rest -= sum(2 * sizes[x] for x in full)
        free -= full
    return target


def test_targets_against_sharing_again(spark):
    for seed in range(6):
        rnd = random.Random(seed)
        sizes = {f"s{k}": rnd.choice([0, 5, 100, 3000, 50_000]) + rnd.randrange(50) for k in range(rnd.randint(1, 12))}
        sizes[None] = rnd.randrange(1000)
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
        assert {r.source: round(r.target, 6) for r in got} == {x: round(t, 6) for x, t in shares(sizes).items()}


def test_language(spark):
    letters = {"aa": "abcde ", "bb": "uvwxyz "}
    table = [
        (i, "".join(RND.choice(letters[x]) for _ in range(80)), x, None, None, "", "")
        for i in range(120) for x in [("aa", "bb")[i % 2]]
    ]
    table += [(500, None, "aa", None, None, "", ""), (501, "123 \n", None, None, None, "", "")]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(table, SCHEMA)).collect()}
    assert all(got[i].lang_pred == ("aa", "bb")[i % 2] and 0 <= got[i].score <= 1 for i in range(120))
    assert any(got[i].held_out for i in range(120))
    assert got[500].lang_pred == got[501].lang_pred == "und"


def discount(counts):
    ones, twos = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
    return ones / (ones + 2 * twos) if ones and twos else 0.75


def kneser_ney_brute(counts):
    by_order = {language.ORDER: Counter(counts)}
    for n in range(language.ORDER - 1, 0, -1):
        # In how many contexts, one symbol longer, a gram is seen.
        by_order[n] = Counter(g[1:] for g in by_order[n + 1])
    probability = {}
    tables = []
    for n in range(1, language.ORDER + 1):
        grams, d = by_order[n], discount(by_order[n])
        total = Counter()
        kinds = Counter()
        for g, c in grams.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        weight = {context: max(d * kinds[context] / total[context], 1e-9) for context in total}
        current = {
            g: max(c - d, 0.0) / total[g[:-1]]
            + weight[g[:-1]] * (probability.get(g[1:], language.UNIFORM) if n > 1 else language.UNIFORM)
            for g, c in grams.items()
        }
        tables.append((
            ({g: np.log(max(p, 1e-12)) for g, p in current.items()}),
            ({c: np.log(w) for c, w in weight.items()}),
        ))
        probability = current
    return tables


def test_language_keeps_every_gram(spark):
    """Grams seen once among more than 131,072 count as well, and the tables equal those of plain dictionaries."""
    table = [(i, "ab " * 60000, "aa", None, None, "", "") for i in range(6)]
    table += [(10 + i, "cd " * 60000 + f"xyzq{'rstuvw'[i]}", "bb", None, None, "", "") for i in range(6)]
    table.append((20, "xyzq xyzq", None, None, None, "", ""))
    df = spark.createDataFrame(table, SCHEMA)
    models = language.load(language.learn(df))
    learned = {r.doc_id for r in df.where(~language.held_out(F.col("doc_id"))).collect()}
    for lang in ("aa", "bb"):
        counts = Counter()
        for i, t, x, *_ in table:
            for w in language.words(t) if x == lang and i in learned else ():
                padded = language.BEGIN * (language.ORDER - 1) + w + language.END
                counts.update(padded[k:k + language.ORDER] for k in range(len(padded) - language.ORDER + 1))
        for got, want in zip(models[lang], kneser_ney_brute(counts), strict=True):
            for (keys, values), expected in zip(got, want, strict=True):
                hashed = {
                    int(language.hashes(np.array(list(map(ord, g))), len(g))[0]) if g else 0: v for g, v in expected.items()
                }
                assert set(keys.tolist()) == set(hashed) and len(keys) == len(hashed)
                assert all(abs(v - hashed[k]) < 1e-4 for k, v in zip(keys.tolist(), values.tolist()))
    got = {r.doc_id: r.lang_pred for r in language.identify(df).collect()}
    assert got[20] == "bb"


def near_brute(table):
    sets = {}
    for i, t in table:
        w = words(t)
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    label = {i: i for i, _ in table}
    texts = dict(table)
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                both = sets[a] | sets[b]
                same = (texts[a] or "") == (texts[b] or "") or both and len(sets[a] & sets[b]) >= 0.8 * len(both)
                if same and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_near_duplicates(spark):
    rnd = random.Random(11)
    base = [prose(150, rnd).split(" ") for _ in range(4)]
    table = list(enumerate(ODD))
    for g, b in enumerate(base):
        for k in range((2, 5, 12, 30)[g]):
            w = list(b)
            for _ in range(k % 4):
                w[rnd.randrange(len(w))] = f"new{rnd.randrange(999)}"
            table.append((len(table), " ".join(w)))
    table += [(len(table) + k, prose(40, rnd)) for k in range(10)]
    df = spark.createDataFrame([(i, t, None, None, None, "", "") for i, t in table], SCHEMA)
    got = {r.doc_id: r.class_id for r in minhash.near_classes(df).collect()}
    assert got == near_brute(table)
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(got.values())


def test_near_duplicates_with_repeated_own_phrases(spark):
    """Similarity is that of sets: phrases that each page repeats must not hide the shared part."""
    table = []
    for g in range(8):
        shared = " ".join(f"s{g}x{k}" for k in range(404))
        table += [(len(table) + k, shared + f" {' '.join(f'own{g}y{k}z{j}' for j in range(40))}" * 60) for k in range(2)]
    df = spark.createDataFrame([(i, t, None, None, None, "", "") for i, t in table], SCHEMA)
    want = near_brute(table)
    assert want == {i: i - i % 2 for i, _ in table}
    assert {r.doc_id: r.class_id for r in minhash.near_classes(df).collect()} == want


def test_near_duplicates_in_crowded_buckets(spark):
    """Texts that share most of a passage meet in large buckets; chains and pairs among them must be found."""
    rnd = random.Random(3)
    passage, table = prose(120, rnd), []
    for g in range(40):
        own = [f"w{g}x{k}" for k in range(30 + g % 12)]
        for k in range(1 + g % 3):
            table.append((len(table), passage + " " + " ".join([*own[:-1], f"end{g}y{k}"])))
    chain = prose(150, rnd).split(" ")
    for k in range(12):
        chain[5 + 11 * k] = f"step{k}"
        table.append((len(table), " ".join(chain)))
    df = spark.createDataFrame([(i, t, None, None, None, "", "") for i, t in table], SCHEMA).repartition(3)
    got = {r.doc_id: r.class_id for r in minhash.near_classes(df).collect()}
    assert got == near_brute(table)


@pytest.mark.parametrize("small", [8, 2])
def test_near_duplicates_that_meet_in_crowds_only(spark, monkeypatch, small):
    """Two texts share only what a crowd shares, and neither is near to the crowd's first text."""
    monkeypatch.setattr(minhash, "SMALL", small)
    rnd = random.Random(31)
    table = []
    for g in range(2):
        passage = prose(126, rnd)
        for own in [28] * 120 + [8] * 2:
            table.append((len(table), passage + " " + " ".join(f"w{len(table)}x{k}" for k in range(own))))
    want = near_brute(table)
    assert want[121] == 120 and want[243] == 242 and len(set(want.values())) == len(table) - 2
    df = spark.createDataFrame([(i, t, None, None, None, "", "") for i, t in table], SCHEMA).repartition(3)
    assert {r.doc_id: r.class_id for r in minhash.near_classes(df).collect()} == want


def test_near_duplicates_with_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 2)
    test_near_duplicates_in_crowded_buckets(spark)


def test_shards(docs):
    got = shards.shard(docs).collect()
    assert len(got) == len(rows())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_jump_is_even_and_consistent(spark):
    df = spark.range(20_000).select(shards.jump_shards(F.col("id"), (10, 11)).alias("s"))
    got = [tuple(r.s) for r in df.collect()]
    assert all(900 * 2 < n < 1100 * 2 for n in Counter(a for a, _ in got).values())
    moved = [b for a, b in got if a != b]
    assert set(moved) == {10} and 1500 < len(moved) < 2200


def test_exact_duplicates(docs, monkeypatch):
    monkeypatch.setattr(exact, "TABLE_BYTES", 2_000)
    folded = [(r[0], re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")) for r in rows()]
    groups = defaultdict(list)
    for i, t in folded:
        groups[t].append(i)
    got = exact.exact_duplicates(docs).collect()
    want = Counter((i, max(x for x in groups[t] if x is not None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in folded)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_line_dedup(spark):
    table = [(i, f"Menu\nown {i}\n menu \n", None, None, None, "", "") for i in range(12)] + [(90, None, None, "x", None, "", "")]
    df = spark.createDataFrame(table, SCHEMA)
    got = {r.doc_id: (r.text, r.n_dropped) for r in lines.dedup_lines(df).collect()}
    assert all(got[i] == (f"own {i}\n", 2) for i in range(12)) and got[90] == (None, 0)
    assert lines.drop_lines(df).columns == df.columns


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_table(spark, tmp_path, name):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert not compare.differences(df, compare.connection(data), queries.ORACLES[name])


def good_brute(table):
    """The documents (id, text, source) that the quality rules keep."""
    pages, having, left = defaultdict(set), defaultdict(set), []
    lines = lambda t: [x.lower().strip(" ") for x in t.split("\n") if x.strip(" ")]
    for _, t, s in table:
        pages[s].add(t or "")
        for x in lines(t or ""):
            having[s, x].add(t or "")
    for i, t, s in table:
        found = words(t)
        windows = [tuple(found[k:k + 3]) for k in range(len(found) - 2)]
        twice = Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if twice[w] > 1 for j in range(3)}
        if len(found) < 50 or 100 * len(covered) > 50 * len(found):
            continue
        total = len(t.replace("\n", ""))
        shared = lambda x: len(having[s, x]) > max(50, 0.01 * len(pages[s]))
        gone = sum(len(x) for x in lines(t) if shared(x))
        if total - gone >= 0.2 * total:
            left.append((i, "\n".join(x for x in t.split("\n") if not (x.strip(" ") and shared(x.lower().strip(" ")))), s))
    return left


def lines_brute(table):
    pages, having = defaultdict(set), defaultdict(set)
    for _, t, s in table:
        pages[s].add(t)
        for x in t.split("\n"):
            having[s, x.lower().strip(" ")].add(t)

    def common(s, x):
        n = len(having[s, x.lower().strip(" ")])
        return x.strip(" ") and n >= 10 and n > 0.1 * len(pages[s])

    return [(i, "\n".join(x for x in t.split("\n") if not common(s, x)), s) for i, t, s in table]


def mix_brute(table):
    sizes, by = Counter(), defaultdict(list)
    for i, t, s in table:
        sizes[s] += len(words(t))
        by[s].append((int(hashlib.md5(f"{i}:{t}".encode()).hexdigest()[:15], 16), i, t))
    out = Counter()
    for s, target in shares(sizes).items():
        passes = int(target // sizes[s]) if sizes[s] else 0
        rest = target - passes * sizes[s]
        for _, i, t in sorted(by[s]):
            rest -= len(words(t))
            out[i, t] += passes + (rest >= 0)
    return +out


def test_pipeline_against_brute_force(spark, tmp_path):
    rnd = random.Random(23)
    menu = "Shared menu of this site with some more words"
    footer = "\n".join(f"footer line {k} of the one host that has little else to say" for k in range(8))
    table = [(i, t, None) for i, t in enumerate(ODD)]
    for k in range(70):
        source = ("s1", "s2", "s3", None)[k % 7 % 4]
        table.append((100 + k, f"{menu}\n{prose(60 + k, rnd)}\n\nown ending {k}" if k % 3 else prose(80, rnd), source))
    table += [(200 + k, f"{footer}\n{k}", "s4") for k in range(60)]
    table += [(500 + k, f"{prose(70, rnd)}\n{menu}\n{prose(9, rnd)}", "s5") for k in range(60)]
    table += [(300 + k, table[30 + k % 5][1], table[30 + k % 5][2]) for k in range(12)]
    table += [(400 + k, f"{table[40 + k % 4][1]} extra{k}", "s2") for k in range(9)]
    df = spark.createDataFrame([(i, t, None, s, None, "clash", "clash") for i, t, s in table], SCHEMA)
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))

    kept = lines_brute(good_brute(table))
    assert 50 < len(kept) < len(table) and not any(200 <= i < 300 for i, _, _ in kept)
    label = near_brute([(i, t) for i, t, _ in kept])
    kept = [x for x in kept if label[x[0]] == x[0]]
    library, want = Tokenizer.from_file(BYTES), Counter()
    for (i, t), times in mix_brute(kept).items():
        want[i, tuple(library.encode(t, add_special_tokens=False).ids), hashlib.sha256(t.encode()).hexdigest()] += times
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_pipeline(spark, data, docs):
    assert [len(x) for x in corpus_pipeline.STAGES] == [2] * 5
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, data)
        assert kept.columns == docs.columns
    assert corpus_pipeline.run(spark, data).count() > 0
