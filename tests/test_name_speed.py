"""The stored form of names equals its rule and is quick on long texts."""

import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from barrio.functions import text

ODD = [None, "", " ", "\u00a0", "Café  Núria", "a_b-c", "ÑU  ñandú\t\n2", "日本 bar", "😀x😀", "^`a´", "x\u0000y", "İi ß", "  A  ", "٣ tres", "ﬁn"]


def by_rule(value):
    if value is None:
        return ""
    plain = re.sub("[^a-zA-Z0-9 ]+", " ", value)
    return re.sub(" +", " ", plain).strip(" ").upper()


@pytest.mark.parametrize("form", [text.match_name, text.activity_text])
def test_forms_of_odd_names(spark, form):
    df = spark.createDataFrame([(v,) for v in ODD], "v string")
    got = df.select(text.strip_marks(F.col("v")), form(F.col("v"))).collect()
    assert [r[1] for r in got] == [by_rule(r[0]) for r in got]
    assert unicodedata.normalize("NFC", got[4][0]) == "Cafe  Nuria"


@pytest.mark.parametrize("form", [text.match_name, text.activity_text])
def test_long_texts_are_quick(spark, form):
    """The negated set of ranges takes several times as long as the form may."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda i: F.concat(F.lit("Lola, la casa "), i.cast("string"))), " ")
    df = spark.range(0, 160, 1, 8).select(F.concat(words, F.col("id").cast("string")).alias("v")).cache()
    df.count()

    def seconds(column):
        taken = []
        for _ in range(3):
            start = time.monotonic()
            df.agg(F.sum(F.length(column))).collect()
            taken.append(time.monotonic() - start)
        return min(taken)

    slow = F.upper(F.trim(F.regexp_replace(text.strip_marks(F.col("v")), "[^a-zA-Z0-9]+", " ")))
    assert seconds(form(F.col("v"))) < 0.7 * seconds(slow)
