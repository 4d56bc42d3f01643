"""One query per operator, over the whole table, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barrio.llm import (
    bpe, exact, language, lines, minhash, mixing, rules, shards, spelling, suffixes, tokens, transducer, whitening,
)
from barrio.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, source: str = "documents"):
    def register(fn: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(table(spark, folder, source))
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


WORD = r"[^\x20\x09-\x0D]+"

@query("op1_token_counts")
def op1(docs: DataFrame) -> DataFrame:
    return tokens.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))


def digests(encoded: DataFrame) -> DataFrame:
    """What the query shows of ids and decoded texts."""
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_bpe")
def op2(docs: DataFrame) -> DataFrame:
    return digests(bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json")))


RULES_SQL = rf"""
with d as (
    select row_number() over () as r, doc_id, source, coalesce(text, '') as text from documents
), w as (
    select r, unnest(regexp_extract_all(text, '{WORD}')) as word,
           generate_subscripts(regexp_extract_all(text, '{WORD}'), 1) as i from d
), t as (
    select r, i, word || ' ' || lead(word) over o || ' ' || lead(word, 2) over o as three from w
    window o as (partition by r order by i)
), twice as (
    select r, i from (select r, i, three, count(*) over (partition by r, three) as n from t where three is not null)
    where n > 1
), covered as (
    select r, count(distinct place) as n from (select r, unnest([i, i + 1, i + 2]) as place from twice) group by r
), lined as (
    select r, source, text, line from (select r, source, text, unnest(string_split(text, chr(10))) as line from d)
), dup as (
    select r, count(*) - count(distinct line) as n from lined where regexp_matches(line, '{WORD}') group by r
), normal as (
    select source, text, trim(lower(line), ' ') as line, count(*) as k from lined
    where trim(line, ' ') <> '' group by all
), pages as (select source, count(distinct text) as pages from d group by source),
shared as (
    select n.source, n.line from normal n join pages p on n.source is not distinct from p.source
    group by n.source, n.line, p.pages
    having count(distinct text) > 50 and count(distinct text) > 0.01 * p.pages
), gone as (
    select n.source, n.text, sum(n.k * length(n.line)) as gone
    from normal n join shared s on n.source is not distinct from s.source and n.line = s.line group by all
), copies as (
    select source, text, count(*) as c, count(*) * length(replace(text, chr(10), '')) as total
    from d group by source, text
), bad as (
    select c.source, c.text from copies c join gone g
    on c.source is not distinct from g.source and c.text = g.text where c.total - g.gone < 0.2 * c.total
), counts as (
    select d.r, d.doc_id, len(regexp_extract_all(d.text, '{WORD}'))::bigint as n_words,
           length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
           length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
           coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words,
           b.text is not null as depleted
    from d left join dup using (r) left join covered using (r)
    left join bad b on d.source is not distinct from b.source and d.text = b.text
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, depleted,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not depleted as kept
from counts
"""


@query("op3_quality_rules", RULES_SQL)
def op3(docs: DataFrame) -> DataFrame:
    return rules.quality(docs)


@query("op4_repeated_passages")
def op4(docs: DataFrame) -> DataFrame:
    return suffixes.remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
    )


MIXING_SQL = rf"""
with d as (
    select row_number() over () as r, doc_id, source,
           len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size,
           ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 15))::bigint as h from documents
), s as (
    select source, sum(size)::bigint as source_size,
           [3, 1, 2][(row_number() over (order by source asc nulls last) - 1) % 3 + 1] as weight from d group by source
), l as (
    select *, (sum(source_size) over () * 1.5::double
               - 2 * coalesce(sum(source_size) over (o rows between unbounded preceding and 1 preceding), 0))
              / sum(weight) over (o rows between current row and unbounded following) as level from s
    window o as (order by source_size / weight::double, source asc nulls last)
), t as (
    select source, source_size, least(2.0::double * source_size, weight * level) as target
    from (select source, source_size, weight,
                 max(case when level * weight <= 2 * source_size then level end) over () as level from l)
), p as (
    select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as passes from t
), u as (
    select d.*, p.source_size, p.target, p.passes,
           sum(size) over (partition by d.source order by h range between unbounded preceding and current row) as upto
    from d join p on d.source is not distinct from p.source
)
select doc_id, size, source_size, target,
       ((passes + case when upto <= target - passes * source_size then 1 else 0 end) * size)::bigint as taken from u
"""


@query("op5_mix_sources", MIXING_SQL)
def op5(docs: DataFrame) -> DataFrame:
    return mixing.mixture(docs)


@query("op6_language_id")
def op6(docs: DataFrame) -> DataFrame:
    return language.identify(docs)


@query("op7_near_duplicates")
def op7(docs: DataFrame) -> DataFrame:
    return minhash.near_classes(docs)


@query("op8_shards")
def op8(docs: DataFrame) -> DataFrame:
    return shards.shard(docs)


EXACT_SQL = """
with d as (
    select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
    from documents
)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
from d window w as (partition by t)
"""


@query("op9_exact_duplicates", EXACT_SQL)
def op9(docs: DataFrame) -> DataFrame:
    return exact.exact_duplicates(docs)


LINES_SQL = """
with d as (select row_number() over () as r, doc_id, source, text from documents),
l as (
    select r, source, coalesce(text, '') as text, unnest(string_split(text, chr(10))) as line,
           generate_subscripts(string_split(text, chr(10)), 1) as i from d
), p as (select source, count(distinct coalesce(text, '')) as pages from d group by source),
b as (
    select l.source, trim(lower(line), ' ') as line from l join p on l.source is not distinct from p.source
    where trim(line, ' ') <> '' group by l.source, trim(lower(line), ' '), p.pages
    having count(distinct text) >= 10 and count(distinct text) > 0.1 * p.pages
), k as (
    select r, count(*) as n_lines, count(b.line) as n_dropped,
           string_agg(l.line, chr(10) order by l.i) filter (b.line is null) as text
    from l left join b on l.source is not distinct from b.source and trim(lower(l.line), ' ') = b.line
    group by r
)
select d.doc_id, case when d.text is not null then coalesce(k.text, '') end as text,
       coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dropped, 0)::bigint as n_dropped
from d left join k using (r)
"""


@query("op10_line_dedup", LINES_SQL)
def op10(docs: DataFrame) -> DataFrame:
    return lines.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_dropped")


@query("op11_byte_bpe")
def op11(docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(transducer.encode_decode(docs, path, public_tokenizers.PATTERN))


@query("op12_spelling_variants")
def op12(docs: DataFrame) -> DataFrame:
    return spelling.variants(docs)


@query("op13_whitening", source="embeddings")
def op13(rows: DataFrame) -> DataFrame:
    # A deviation beyond the longs is null here; the operator itself gives it whole.
    return whitening.whiten(rows).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
