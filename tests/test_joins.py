"""Joins under skew, against brute force on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from barrio.functions.text import GENERIC_TOKENS
from barrio.operators import crawl, gridjoin, keyed, match, serve, traffic
from barrio.plans import audit


def metres(a, b, c, d):
    mid = math.radians((a + c) / 2)
    w = 1 - 0.0066943799901413165 * math.sin(mid) ** 2
    dy = 6378137 * (1 - 0.0066943799901413165) / (w * math.sqrt(w)) * math.radians(c - a)
    dx = 6378137 / math.sqrt(w) * math.cos(mid) * math.radians(d - b)
    return math.hypot(dx, dy)


def points(n, seed, hot_share=0.4, at=(40.4, -3.7), spread=0.003):
    """Positions of which a large share is one and the same point."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if rnd.random() < hot_share:
            out.append((i, *at))
        else:
            out.append((i, at[0] + rnd.uniform(-spread, spread), at[1] + rnd.uniform(-spread, spread)))
    return out


@pytest.mark.parametrize("empty", ["", "left", "right", "both"])
def test_keyed_join_is_an_inner_join(spark, empty):
    left = spark.createDataFrame([(i, i % 3 if i < 60 else 9) for i in range(100)], "a int, k int")
    right = spark.createDataFrame([(i, 9 if i % 2 else i) for i in range(50)], "b int, k int")
    left, right = left.where(F.lit(empty not in ("left", "both"))), right.where(F.lit(empty not in ("right", "both")))
    got = keyed.keyed_join(left, right, ["k"], F.col("a") > F.col("b")).select("a", "b", "k").collect()
    want = left.join(right, "k").where("a > b").select("a", "b", "k").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("latitude", [0.0, 40.4, -71.0, 82.0])
def test_within_distance_against_brute_force(spark, latitude):
    a, b = points(120, 1, at=(latitude, -3.7)), points(40, 2, at=(latitude, -3.7))
    places = spark.createDataFrame(a, "id int, lat double, lng double")
    centres = spark.createDataFrame(b, "c int, c_lat double, c_lng double")
    got = gridjoin.within_distance(places, centres, F.lit(90.0), 90.0)
    want = {(p[0], q[0]) for p in a for q in b if metres(q[1], q[2], p[1], p[2]) <= 90}
    rows = got.select("id", "c").collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_radius_may_differ_per_centre(spark):
    a, b = points(150, 3), points(30, 4, hot_share=0.1)
    places = spark.createDataFrame(a, "id int, lat double, lng double")
    centres = spark.createDataFrame([(*q, 20.0 + 15 * q[0]) for q in b], "c int, c_lat double, c_lng double, r double")
    got = gridjoin.within_distance(places, centres, F.col("r"), 100.0)
    want = {(p[0], q[0]) for p in a for q in b if metres(q[1], q[2], p[1], p[2]) <= 20 + 15 * q[0]}
    assert {tuple(r) for r in got.select("id", "c").collect()} == want


@pytest.mark.parametrize("k", [3, 40, 500])
def test_nearest_places_with_a_hot_point(spark, k):
    a, b = points(400, 5), points(12, 6, hot_share=0.2, spread=0.006)
    places = spark.createDataFrame(a, "id int, lat double, lng double")
    queries = spark.createDataFrame(b, "query_id int, lat double, lng double")
    got = serve.nearest_places(queries, places, F.lit(300.0), k, 300.0).collect()
    want = set()
    for q in b:
        near = sorted((metres(q[1], q[2], p[1], p[2]), p[0]) for p in a)
        near = [(d, i) for d, i in near if d <= 300][:k]
        want |= {(q[0], i, n) for n, (_, i) in enumerate(near, 1)}
    assert {(r.query_id, r.id, r.position) for r in got} == want


def test_boxes_of_very_different_sizes(spark):
    a = points(300, 7)
    places = spark.createDataFrame(a, "id int, lat double, lng double")
    boxes = [(1, 41.0, 40.0, -3.0, -4.0), (2, 40.401, 40.3995, -3.699, -3.701), (3, 40.4, 40.4, -3.7, -3.7), (4, 80.0, -80.0, 170.0, -170.0)]
    views = spark.createDataFrame(boxes, "view_id int, north double, south double, east double, west double")
    got = serve.places_in_view(views, places).select("view_id", "id").collect()
    want = {(v[0], p[0]) for v in boxes for p in a if v[2] <= p[1] <= v[1] and v[4] <= p[2] <= v[3]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_cluster_counts_add_up(spark):
    places = spark.createDataFrame(points(200, 8), "id int, lat double, lng double")
    views = spark.createDataFrame([(1, 41.0, 40.0, -3.0, -4.0, 0.001)], "view_id int, north double, south double, east double, west double, cell double")
    clusters = serve.grid_clusters(views, places)
    assert clusters.agg(F.sum("n")).first()[0] == serve.places_in_view(views, places).count()


def test_large_samples_rank_in_two_steps(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 2)
    top = serve.top_k(df, ["g"], [F.md5(F.col("id").cast("string"))], 1200, "r", "id")
    assert top.count() == 2400
    small = serve.top_k(df, ["g"], [F.md5(F.col("id").cast("string"))], 1000, "r", "id")
    assert small.join(top, ["g", "id", "r"], "left_anti").count() == 0


# --- matching -----------------------------------------------------------------

WORDS = ["CASA", "PACO", "LOLA", "BAR", "DE", "SOL", "CAFE", "NORTE"]
STORE = (
    "id long, source_name string, source_local_id string, lat double, lng double, normalized_name string, place_type string, "
    "sells_onsite_beer boolean, sells_takeaway_beer boolean, badges array<string>, official_status string, confidence_level string"
)


def random_stores(n, seed, hot_share):
    rnd = random.Random(seed)
    rows = []
    for i, lat, lng in points(n, seed, hot_share, spread=0.0006):
        name = " ".join(rnd.choices(WORDS, k=rnd.randint(0, 4)))
        kind = rnd.choice(["bar", "bodega", "supermercado", "otro"])
        source = "osm" if i % 2 else "censo_madrid"
        rows.append((i, source, str(i), lat, lng, name, kind, True, False, [], None, "high"))
    return rows


def accepted_by_hand(rows):
    shops = {"supermercado", "alimentacion", "bodega", "tienda_24h"}
    generic = set(GENERIC_TOKENS)
    pairs = []
    for o in (r for r in rows if r[1] == "osm"):
        for c in (r for r in rows if r[1] != "osm"):
            d = metres(c[3], c[4], o[3], o[4])
            a, b = set(o[5].split()), set(c[5].split())
            if d > 30 or not a or not b or a <= generic or b <= generic:
                continue
            if not (o[6] == c[6] or {o[6], c[6]} <= shops):
                continue
            s = 1.0 if o[5] == c[5] else 2 * len(a & b) / (len(a) + len(b))
            if o[5] == c[5] or (s >= 0.8 and d <= 20) or (s >= 0.6 and d <= 10):
                pairs.append((o[0], c[0]))
    left, right = [p[0] for p in pairs], [p[1] for p in pairs]
    return len(pairs), {p for p in pairs if left.count(p[0]) == 1 and right.count(p[1]) == 1}


@pytest.mark.parametrize("seed,hot", [(11, 0.4), (12, 0.05), (13, 0.9)])
def test_matching_against_brute_force(spark, seed, hot):
    rows = random_stores(160, seed, hot)
    stores = spark.createDataFrame(rows, STORE)
    qualified, accepted = accepted_by_hand(rows)
    sites = match.qualified_sites(match.active_osm(stores), match.usable_censo(stores))
    assert (sites.agg(F.sum(F.col("osm_rows") * F.col("censo_rows"))).first()[0] or 0) == qualified
    got = {(r.osm_id, r.censo_id) for r in match.one_to_one(sites).collect()}
    assert got == accepted
    direct = match.evaluate_pairs(match.candidate_pairs(match.active_osm(stores), match.usable_censo(stores)))
    assert direct.count() == qualified


def test_audit_totals_equal_listed_pairs(spark):
    stores = spark.createDataFrame(random_stores(140, 14, 0.5), STORE)
    pairs = match.candidate_pairs(match.active_osm(stores), match.usable_censo(stores))
    audit_rows = {r.metric: r.value for r in match.match_audit(stores).collect()}
    assert audit_rows["candidate_pairs"] == pairs.count()
    assert audit_rows["osm_with_candidates"] == pairs.select("osm_id").distinct().count()
    assert audit_rows["censo_with_candidates"] == pairs.select("censo_id").distinct().count()


# --- other hot groups ---------------------------------------------------------


def test_duplicates_of_a_huge_group_stay_whole(spark):
    rows = [(i, "A", 1.0, 1.0, "high") for i in range(300)] + [(i, f"B{i}", 1.0, 1.0, "high") for i in range(300, 320)]
    df = spark.createDataFrame(rows, "id int, normalized_name string, lat double, lng double, confidence_level string")
    out = audit.exact_duplicates(df)
    assert out.count() == 300 and out.select("n").distinct().collect()[0].n == 300


def test_brand_pages_do_not_gather_their_stores(spark):
    rows = [("https://brand.es/", i) for i in range(500)] + [("https://one.es/", 900), ("https://one.es/", 901), ("https://x.com/a", 902)]
    groups = {r.website: r for r in crawl.url_groups(spark.createDataFrame(rows, "website string, id int")).collect()}
    assert groups["https://brand.es/"][1:] == (500, "brand.es", "brand", None)
    assert groups["https://one.es/"].ids == [900, 901] and groups["https://x.com/a"].status == "host"


def test_reprocessed_runs_across_blocks(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("ab"), rnd.choice("xy")) for i in rnd.sample(range(10_000), 200)]
    df = spark.createDataFrame(rows, "id int, source_name string, file_hash string")
    got = {r.id for r in audit.reprocessed_runs(df, block_ids=600).where("reprocessed").collect()}
    want, last = set(), {}
    for i, source, digest in sorted(rows):
        if last.get(source) == digest:
            want.add(i)
        last[source] = digest
    assert got == want


def test_reprocessed_runs_with_ids_at_both_ends(spark):
    ends = [-(2**63), -(2**63) + 1, -1, 0, 2**63 - 2, 2**63 - 1]
    df = spark.createDataFrame([(i, "a", h) for i, h in zip(ends, "xyyyzz")], "id long, source_name string, file_hash string")
    got = {r.id for r in audit.reprocessed_runs(df).where("reprocessed").collect()}
    assert got == {-1, 0, 2**63 - 1}


def test_robots_of_a_large_origin_and_odd_links(spark):
    rules = [("https://a.es", f"/p{i}/") for i in range(200)] + [("https://a.es:8443", "/"), ("https://b.es", "/%C3%BA")]
    links = {f"https://a.es/p{i}/x": i >= 200 for i in range(0, 400, 7)}
    links |= {
        "https://A.es:443/q/../p5/y": False, "https://a.es:8443/any": False, "https://b.es/ú{x}": False, "https://b.es/u": True,
        "https://a b.es/": False, "nonsense": False, "https://c.es/a|b": True,
    }
    urls = spark.createDataFrame([(u,) for u in links], "url string")
    got = crawl.robots_verdict(urls, spark.createDataFrame(rules, "origin string, disallow string")).collect()
    assert {r.url: r.allowed for r in got} == links


def test_networks_of_both_families(spark):
    networks = [
        ("10.0.0.0/8", 40.0, -3.0, "Madrid"), ("10.1.0.0/16", 41.0, 2.0, "Barcelona"), ("10.1.2.0/24", 50.0, 2.0, "Lille"),
        ("2001:db8::/32", 37.0, -6.0, "Sevilla"), ("2001:db8:0:1::/64", 42.0, -8.0, "Vigo"), ("2001:db8::5/128", 43.0, -5.0, "Gijón"),
        ("bad/8", 40.0, -3.0, "x"), ("1.2.3.4/33", 40.0, -3.0, "x"), (None, 40.0, -3.0, "x"),
    ]
    table = spark.createDataFrame([(n, a, b, None, c) for n, a, b, c in networks],
                                  "network string, lat double, lng double, city_es string, city_en string")
    want = {
        "10.9.9.9": "Madrid", "10.1.9.9": "Barcelona", "10.1.2.3": None, "::ffff:10.9.9.9": "Madrid", "::FFFF:0a01:0001": "Barcelona",
        "2001:DB8::1": "Sevilla", "2001:0db8:0000:0001:0:0:0:1": "Vigo", "2001:db8::5": "Gijón", "2001:db8:0:0:0:0:0.0.0.5": "Gijón",
        "2001:db9::": None, "::": None, "1::2::3": None, "1:2:3:4:5:6:7": None, "1:2:3:4:5:6:7::8": None, "g::1": None, ":::": None,
        "2001:db8::1%eth0": None, "10.9.9": None, "": None, None: None, "2001:db8::ff10.1.1.1": None,
    }
    visits = spark.createDataFrame([(i,) for i in want] * 2, "ip string")
    got = traffic.locate_by_prefix(visits, table).collect()
    assert len(got) == len(want)
    assert {r.ip: r.city for r in got} == want | {None: None}
    assert all((r.source == "ip") == (r.city is not None) for r in got)
    assert traffic.locate_by_prefix(visits, table.limit(0)).where("source <> 'none'").count() == 0


def test_robots(spark):
    lines = [(1, "User-agent: other"), (2, "Disallow: /"), (3, "User-Agent: PlaceBot/1.0"), (4, "Disallow: /priv # no"), (5, "Disallow:"), (6, "Allow: /priv/ok")]
    robots = spark.createDataFrame([("https://a.es", *x) for x in lines], "origin string, line_no int, line string")
    urls = spark.createDataFrame([("https://a.es/priv/ok",), ("https://a.es",), ("https://a.es/public?x=/priv",), ("https://b.es/priv",)], "url string")
    rules = crawl.applicable_rules(crawl.robots_sections(robots), "placebot")
    got = {r.url: r.allowed for r in crawl.robots_verdict(urls, rules).collect()}
    assert got == {"https://a.es/priv/ok": False, "https://a.es": True, "https://a.es/public?x=/priv": True, "https://b.es/priv": True}


def test_ip_ranges_of_mixed_width(spark):
    ranges = [(0x0A000000, 0x0A0000FF, "Madrid"), (0x0A000100, 0x0A000100, "Vigo"), (0x0B000000, 0x0BFFFFFF, "Gijón")]
    table = spark.createDataFrame([(lo, hi, 40.0, -3.0, None, city) for lo, hi, city in ranges],
                                  "lo long, hi long, lat double, lng double, city_es string, city_en string")
    ips = ["10.0.0.0", "10.0.0.255", "10.0.1.0", "10.0.1.1", "11.200.3.4", "12.0.0.0", "300.1.1.1", "x"]
    got = {r.ip: (r.city, r.source) for r in traffic.locate_visitors(spark.createDataFrame([(i,) for i in ips], "ip string"), table).collect()}
    none = (None, "none")
    assert got == dict(zip(ips, [("Madrid", "ip"), ("Madrid", "ip"), ("Vigo", "ip"), none, ("Gijón", "ip"), none, none, none]))
