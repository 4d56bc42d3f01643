"""The rejection limits of language identification come from every labelled document, each scored once."""

import random
import statistics

from barrio.llm import language
from pyspark.sql import functions as F
from test_operators import SCHEMA


def test_limits_come_from_all_labelled_texts(spark, monkeypatch):
    rnd, calls, scored = random.Random(8), [], language._scored
    monkeypatch.setattr(language, "_scored", lambda docs, models: calls.append(docs.count()) or scored(docs, models))
    letters = {"aa": "abcdefgh ", "bb": "uvwxyz "}
    # One text in 400 is made of letters that are rare in its language, so it moves the deviation and may be beyond the limit.
    table = [
        (i, "".join(rnd.choice(letters[x] if i % 400 else "éèàù ") for _ in range(60)), x, None, None, "", "")
        for i in range(4000) for x in [("aa", "bb")[i % 2]]
    ]
    table.append((9000, None, "und", None, None, "", ""))
    docs = spark.createDataFrame(table, SCHEMA)
    got = language.identify(docs).join(docs.select("doc_id", "lang", F.col("text").isNull().alias("none")), "doc_id").collect()
    assert calls == [4001]
    limits = {}
    for lang in letters:
        own = [r.entropy for r in got if r.lang == r.lang_pred == lang and not r.held_out]
        limits[lang] = statistics.mean(own) + language.DEVIATIONS * max(statistics.stdev(own), 0.05)
    assert "und" not in {r.lang_pred for r in got if not r.none}
    assert all(r.rejected == (r.entropy > limits[r.lang_pred]) for r in got if not r.none)
    assert any(r.rejected for r in got)
