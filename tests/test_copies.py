"""Copies of places at one position are compared once, whatever their number."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_joins import STORE, random_stores

import __spark_entry__ as entry_module
from barrio.catalog import registry
from barrio.functions.text import dice_tokens
from barrio.operators import match

COPIES = 12


@pytest.fixture(scope="module")
def stores(spark):
    """Few sites, each with many rows."""
    df = spark.createDataFrame(random_stores(50, 21, 0.5), STORE)
    copies = df.select(F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("_c"), "*")
    return copies.withColumn("id", F.col("id") + 1000 * F.col("_c")).drop("_c").cache()


def direct_pairs(stores):
    return match.candidate_pairs(match.active_osm(stores), match.usable_censo(stores))


def qualified_directly(stores):
    return match.evaluate_pairs(direct_pairs(stores)).select(
        "osm_id", "censo_id", F.round("distance_m", 2), "method", F.round("name_similarity", 6), "match_version"
    )


def best_by_hand(stores):
    """The choice among all listed pairs, by a window."""
    score = dice_tokens(F.col("osm_name"), F.col("censo_name"))
    first = F.row_number().over(Window.partitionBy("osm_id").orderBy(F.desc("s"), "distance_m", "censo_id"))
    both = F.when((F.col("osm_name") != "") & (F.col("s") >= 0.6), "both").otherwise("spatial")
    return direct_pairs(stores).withColumn("s", score).withColumn("r", first).where("r = 1").select(
        "osm_id", "censo_id", both, F.round("distance_m", 2), F.round("s", 6)
    )


DIRECT = {"w1_evaluate_pair": qualified_directly, "w3_best_match": best_by_hand}


@pytest.mark.parametrize("name", sorted(DIRECT))
def test_copies_are_compared_once(spark, stores, monkeypatch, name):
    want = sorted(map(tuple, DIRECT[name](stores).collect()), key=str)
    near, met = match.within_distance, []

    def counted(*args):
        pairs = near(*args)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(match, "within_distance", counted)
    monkeypatch.setattr(registry, "stored_places", lambda *_: stores)
    got = sorted(map(tuple, entry_module.queries()[name](spark, "").collect()), key=str)
    assert want and got == want
    # 50 rows have at most 25 * 25 pairs; their copies have 144 times as many.
    assert len(met) == 1 and met[0] <= 625
