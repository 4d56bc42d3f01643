"""Name normalisation and similarity."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that only state a category.
GENERIC_NAMES = [
    "ALIMENTACION", "ALIMENTACIO", "AUTOSERVEI", "BAR", "BARS", "BEGUDES", "BODEGA", "CAFE",
    "CAFETERIA", "ESTABLECIMIENTO DE BEBIDAS", "ESTABLIMENT DE BEGUDES", "RESTAURANT",
    "RESTAURANTE", "RESTAURANTS", "SUPERMERCAT", "SUPERMERCADO",
]

# Words that carry no identity on their own.
GENERIC_TOKENS = [
    "24", "24H", "ALIMENTACION", "ALIMENTACIO", "AUTOSERVEI", "AUTOSERVICIO", "BAR", "BARS",
    "BAZAR", "BEBIDAS", "BEGUDES", "BODEGA", "CAFE", "CAFETERIA", "DE", "DEL",
    "ESTABLECIMIENTO", "ESTABLIMENT", "FRUTOS", "H", "I", "RESTAURANT", "RESTAURANTE",
    "RESTAURANTS", "SECOS", "SUPERMERCAT", "SUPERMERCADO", "TIENDA", "Y",
]

# White space as the web platform defines it; Java's \s covers ASCII only.
_SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_SPACES = "\t\n\v\f\r " + "".join(
    chr(c) for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
)
_WORD = "A-Za-z0-9_"

# The regex alternative for chain names stays small; beyond this the join form is used.
MAX_INLINE_PATTERNS = 500


def once(value: Column, use) -> Column:
    """`use` of a value that it refers to several times: the value is worked out once and not written out each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """(from, to) for `translate`: accented letter to base letter, then the marks to drop.

    Derived from the Unicode decompositions. Dropped characters must close the source list,
    since `translate` pairs the two strings by position.
    """
    marks = [chr(c) for c in (0x5E, 0x60, 0xA8, 0xAF, 0xB4, 0xB7, 0xB8)]
    spans = ((0x2B0, 0x2FF), (0x300, 0x34E), (0x350, 0x357), (0x35D, 0x362))
    marks += [chr(c) for lo, hi in spans for c in range(lo, hi + 1)]
    dropped = set(marks)
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = [c for c in unicodedata.normalize("NFD", letter) if c not in dropped]
        if len(base) == 1 and base[0] != letter:
            source.append(letter)
            target.append(base[0])
    return "".join(source + marks), "".join(target)


def strip_marks(col: Column) -> Column:
    """Decompose and drop diacritics; null stays null.

    Plain ASCII text, told by its byte length, skips the character table: only two of the marks
    are ASCII.
    """
    source, target = _fold_table()
    ascii_only = F.octet_length(col) == F.length(col)
    plain = F.replace(F.replace(col, F.lit("^"), F.lit("")), F.lit("`"), F.lit(""))
    return F.when(ascii_only, plain).otherwise(F.translate(col, source, target))


def _collapse(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, f"{_SPACE}+", " "))


def js_trim(col: Column) -> Column:
    """Trim every Unicode space, not only U+0020."""
    return F.trim(col, F.lit(_SPACES))


def fold_upper(col: Column) -> Column:
    """Scoring form: no diacritics, upper case, single spaces, punctuation kept; null to ''."""
    return F.coalesce(_collapse(F.upper(strip_marks(col))), F.lit(""))


def _alphanumeric_words(col: Column) -> Column:
    """Letters and digits in upper case, every run of other characters a single space; null to ''.

    The named class is ASCII and looked up in a table; a negated set of ranges takes some six times as long.
    """
    return F.coalesce(F.upper(F.trim(F.regexp_replace(strip_marks(col), r"\P{Alnum}+", " "))), F.lit(""))


def match_name(col: Column) -> Column:
    """Stored form: as `fold_upper`, but every run outside [A-Za-z0-9 ] becomes a space."""
    return _alphanumeric_words(col)


def activity_text(col: Column) -> Column:
    """Free-text activity form: only letters and digits, single spaces, upper case."""
    return _alphanumeric_words(col)


def tokens(col: Column) -> Column:
    """Distinct non-empty words of an already normalised name."""
    return F.array_remove(F.array_distinct(F.split(col, " ")), "")


def dice_tokens(a: Column, b: Column) -> Column:
    """Sørensen–Dice over distinct words; equal names give 1, an empty side 0."""
    ta, tb = tokens(a), tokens(b)
    shared = F.size(F.array_intersect(ta, tb))
    similarity = F.lit(2.0) * shared / F.nullif(F.size(ta) + F.size(tb), F.lit(0))
    return F.when(a == b, F.when(a == "", 0.0).otherwise(1.0)).otherwise(
        F.coalesce(similarity, F.lit(0.0))
    )


def is_generic_name(name: Column) -> Column:
    """True where the name is a category label or made of category words only.

    Every label consists of category words, so one pattern over the words covers both.
    """
    word = "(?:" + "|".join(GENERIC_TOKENS) + ")"
    return F.upper(name).rlike(f"^ *{word}(?: +{word})* *$")


def contains_any(col: Column, needles: list[str]) -> Column:
    """Substring test against a fixed list; plain byte search, no regular expression."""
    return reduce(or_, [col.contains(n) for n in needles])


def _edge(char: str, before: bool) -> str:
    word = re.match(r"[A-Za-z0-9_]", char) is not None
    if before:
        return f"(?<![{_WORD}])" if word else f"(?<=[{_WORD}])"
    return f"(?![{_WORD}])" if word else f"(?=[{_WORD}])"


def _quote(text: str) -> str:
    """Escape for a Java regular expression."""
    return re.sub(r"([\\.\[\]{}()*+?^$|\-&~#])", r"\\\1", text)


def chain_flag(folded: Column, folded_patterns: list[str]) -> Column:
    """True where a folded name holds a folded pattern at ASCII word boundaries."""
    by_edges: dict[tuple[str, str], list[str]] = {}
    for p in folded_patterns:
        if p:
            by_edges.setdefault((_edge(p[0], True), _edge(p[-1], False)), []).append(_quote(p))
    # One look-around per kind of edge, outside the alternation, keeps the search quick.
    parts = [f"{lead}(?:{'|'.join(ps)}){trail}" for (lead, trail), ps in by_edges.items()]
    if not parts:
        return F.lit(False)
    return F.coalesce(folded.rlike("|".join(parts)), F.lit(False))


def with_chain_flag(
    df: DataFrame, name: str, patterns: DataFrame, out: str = "is_chain"
) -> DataFrame:
    """Add the chain flag from a pattern table of any size.

    Up to MAX_INLINE_PATTERNS patterns become one alternation, tested in the scan stage. A
    larger table is joined: each distinct name yields its boundary-to-boundary substrings,
    which meet the patterns by equality.
    """
    folded = patterns.select(fold_upper(F.col("pattern")).alias("p")).where("p <> ''")
    head = [r.p for r in folded.limit(MAX_INLINE_PATTERNS + 1).collect()]
    if len(head) <= MAX_INLINE_PATTERNS:
        return df.withColumn(out, chain_flag(fold_upper(F.col(name)), sorted(set(head))))

    text = fold_upper(F.col(name))
    names = df.select(F.col(name).alias("_n"), text.alias("_f")).distinct().where("_f <> ''")
    is_word = lambda c: F.coalesce(c.rlike(f"[{_WORD}]"), F.lit(False))
    edges = F.filter(
        F.sequence(F.lit(1), F.length("_f") + 1),
        lambda i: is_word(F.when(i > 1, F.substring("_f", i - 1, 1)))
        != is_word(F.substring("_f", i, 1)),
    )
    pieces = (
        names.withColumn("_e", edges)
        .select("_n", "_f", F.explode("_e").alias("_from"), "_e")
        .select("_n", "_f", "_from", F.explode("_e").alias("_to"))
        .where("_to > _from")
        .select("_n", F.expr("substring(_f, _from, _to - _from)").alias("p"))
    )
    hits = pieces.join(folded, "p", "left_semi").select("_n").distinct()
    flagged = hits.withColumn(out, F.lit(True))
    return (
        df.join(flagged, df[name].eqNullSafe(flagged["_n"]), "left")
        .drop("_n")
        .withColumn(out, F.coalesce(out, F.lit(False)))
    )


def numeric_or_null(col: Column) -> Column:
    """Strict decimal text to double, anything else to null."""
    return F.when(col.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), col.try_cast("double"))


def leading_number(col: Column) -> Column:
    """The numeric prefix of a text as double, null without one."""
    prefix = F.regexp_extract(
        js_trim(col), r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1
    )
    return F.nullif(prefix, F.lit("")).try_cast("double")


def blank_to_null(col: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(js_trim(col), F.lit(""))
