"""Joins of sides that both grow never go through the driver, and copies are worked out once."""

import contextlib
import io

import compare
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from barrio import fixtures
from barrio.operators import gridjoin, keyed, match, serve
from barrio.plans import ingest, snapshot
from barrio.session import settings


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def test_a_side_with_a_small_file_is_not_sent_around(spark, tmp_path):
    spark.range(100_000).selectExpr("id % 5 k", "40 + id / 1e7 c_lat", "-3.7D c_lng").write.parquet(str(tmp_path / "c"))
    centres = spark.read.parquet(str(tmp_path / "c"))
    spark.range(50).selectExpr("id", "40 + id / 1e4 lat", "-3.7D lng").write.parquet(str(tmp_path / "p"))
    places = spark.read.parquet(str(tmp_path / "p"))
    assert "Broadcast" not in plan(gridjoin.within_distance(places, centres, F.lit(30.0), 30.0))
    assert "Broadcast" not in plan(keyed.large_join(places, spark.range(9), "id", "left_anti"))


def test_matches_are_merged_into_the_stores(spark):
    sites = spark.createDataFrame(
        [((1, "osm", "n1"), (9, "censo_madrid", "7"), 1, 1, 2.0, "exact_name", 1.0, "v")],
        "osm_key struct<id:long,source_name:string,source_local_id:string>, censo_key struct<id:long,source_name:string,source_local_id:string>, "
        "osm_rows long, censo_rows long, distance_m double, method string, name_similarity double, match_version string",
    )
    matches = match.one_to_one(sites)
    stores = snapshot.as_stores(spark.createDataFrame([(1, "osm"), (9, "censo_madrid"), (5, "osm")], "id long, source_name string"))
    after = snapshot.apply_matches(stores, matches)
    assert "Broadcast" not in plan(after)
    got = {r.id: (r.matched_censo_local_id, r.publication_reason) for r in after.collect()}
    assert got == {1: ("7", None), 9: (None, "matched_to_osm"), 5: (None, None)}


def test_settings_are_put_back(spark):
    former = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    with contextlib.suppress(KeyError), settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
        raise KeyError
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == former


def test_queries_of_one_position_are_asked_once(spark):
    queries = spark.range(1000).selectExpr("id query_id", "40.4 + (id % 3) / 1e3 lat", "-3.7D lng")
    places = spark.range(900).selectExpr("id", "40.4 + (id % 3) / 1e3 lat", "-3.7D lng")
    spots = serve.asked_spots(queries)
    assert sorted(r.query_id for r in spots.collect()) == [0, 1, 2]
    assert serve.lowest_ids(places, ["lat", "lng"], 5).count() == 15
    near = serve.nearest_places(spots, places, F.lit(50.0), 5, 50.0).select("query_id", "id", "position")
    got = {tuple(r) for r in serve.for_every_query(queries, spots, near).collect()}
    assert got == {(q, q % 3 + 3 * n, n + 1) for q in range(1000) for n in range(5)}


@pytest.fixture(scope="module")
def copied(data, tmp_path_factory):
    """The test tables three times over, with shifts of keys that keep positions, schedules and requests alike."""
    folder, con = str(tmp_path_factory.mktemp("copied")), compare.connection(data)
    shifts = {"orders": {"o_orderkey": 168_000}, "customer": {"c_custkey": 33_600}, "events": {"event_id": 105_000}}
    for name in fixtures.BASE_TABLES:
        moved = ", ".join(f"({c} + r * {by})::{kind} as {c}" for c, by in shifts.get(name, {}).items() for kind in ["bigint"])
        times = 3 if moved else 1
        con.execute(
            f"copy (select * exclude (r){f' replace ({moved})' if moved else ''} from {name}, range({times}) g(r)) to '{folder}/{name}.parquet'"
        )
    return folder


@pytest.mark.parametrize("name", ["j2_nearest_per_query_point", "w4_trust_ranking", "w5_nearest_open_default", "n30_nearby_requests"])
def test_copies_of_places_and_requests(spark, copied, name):
    df = entry_module.queries()[name](spark, copied)
    found = compare.differences(df, compare.connection(copied), entry_module.oracle_sql()[name])
    assert not found, "\n".join(found)


def test_a_small_file_is_classified_by_many_tasks(spark, data):
    rows = fixtures.projection(spark, data, "fx_diba_rows").coalesce(1)
    patterns = spark.createDataFrame([("LIDL",)], "pattern string")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with settings(spark, {"spark.sql.adaptive.enabled": "false"}):
        assert ingest.diba_batch(rows, patterns).rdd.getNumPartitions() == parts
